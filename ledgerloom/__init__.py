"""Document-to-ledger analytics on PySpark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"
# Kernels travel to executors with their code, so that no executor needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
