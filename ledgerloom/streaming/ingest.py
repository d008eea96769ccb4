"""Files as they arrive: the batch checks on a stream. Checks and labels are row by row, so nothing is kept between batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.fields import header_fields
from ..sources.files import sniff


def arriving_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the files under path, sniffed."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return sniff(spark.readStream.format("binaryFile").schema(schema).load(path).select("path", "length", "content"))


def header_stream(pages: DataFrame, to: str, checkpoint: str) -> StreamingQuery:
    """Write the header fields of a stream of pages (with text) as Parquet, each page once, until what is there is read."""
    return header_fields(pages).writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
