"""Operators for training-data pipelines; nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Kernels travel to executors with their code, so that no executor needs this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
