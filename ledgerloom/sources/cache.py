"""Pages read by OCR once for each content, in whatever job, file or run they come."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_before(spark: SparkSession, directory: str, key: str = "digest") -> DataFrame:
    """key, text of all pages in the cache under directory; an absent one has none."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(directory)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], f"{key} string, text string")
    return spark.read.schema(f"{key} string, text string").parquet(directory)


def cached(ocr: Callable[[DataFrame], DataFrame], directory: str, key: str = "digest") -> Callable[[DataFrame], DataFrame]:
    """ocr, so that it is asked for each content once: a function from pages (with key, a digest of the page's content, and text) to pages with their text.

    Of the pages whose digest the cache lacks, one for each digest goes through ocr; what it reads is added to the cache, and
    all pages get their text from there. Appends are Spark's own: a failed one adds nothing. Two runs at once may read a
    content twice, of which the lesser text counts, always the same. A page without a digest is read by itself and not kept;
    a page that ocr gives no text for is kept as such.
    """

    def run(bare: DataFrame) -> DataFrame:
        spark = bare.sparkSession
        known = bare.filter(F.col(key).isNotNull())
        new = known.join(read_before(spark, directory, key).select(key), key, "left_anti").dropDuplicates([key])
        ocr(new).select(F.col(key).cast("string").alias(key), F.col("text").cast("string").alias("text")).write.mode("append").parquet(directory)
        text = read_before(spark, directory, key).groupBy(key).agg(F.min("text").alias("text"))
        out = known.drop("text").join(text, key, "left").select(bare.columns)
        return out.unionByName(ocr(bare.filter(F.col(key).isNull())).select(bare.columns))

    return run
