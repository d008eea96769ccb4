"""From word boxes to rows, segments and text."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import config as C
from ..functions.scalars import strip

KEY = ("job_id", "page_number")


def usable_words(words: DataFrame) -> DataFrame:
    """Words with text whose confidence, if it is a number, isn't negative."""
    return words.filter((strip(F.col("text")) != "") & ~F.coalesce(F.col("conf").cast("string").try_cast("double") < 0, F.lit(False)))


def geometry(words: DataFrame) -> DataFrame:
    """words with height (1 at least) and x_center."""
    return words.withColumns({"height": F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0)), "x_center": (F.col("x0") + F.col("x1")) / 2})


def cluster_rows(words: DataFrame, ratio: float = C.ROW_RATIO) -> DataFrame:
    """words (job_id, page_number, word_ord, text, x0, y0, x1, y1) with row_id, from 0 by page.

    In order of top, left and word_ord, a word joins the row at hand if its top is within ratio of the larger of its own
    and the last word's height from the mean top of the row. The mean runs with the row, so words are scanned in order, in
    batches of sorted pages, and a few numbers are all that is carried from word to word: time is linear in the words, and no
    page is held whole.
    """
    columns = (*KEY, "y0", "x0", "word_ord", "text", "x1", "y1")
    ordered = words.select(*columns).repartition(*KEY).sortWithinPartitions(*columns)

    def run(batches):
        page, row, n, total, last = None, 0, 0, 0.0, 0.0
        for batch in batches:
            pages = zip(*(batch.column(i).to_pylist() for i in (0, 1)), strict=True)
            out = []
            for key, top, bottom in zip(pages, batch.column(2).to_pylist(), batch.column(7).to_pylist(), strict=True):
                height = max(bottom - top, 1.0)
                if key != page:
                    page, row, n, total = key, 0, 1, top
                elif abs(top - total / n) <= ratio * max(last, height):
                    n, total = n + 1, total + top
                else:
                    row, n, total = row + 1, 1, top
                last = height
                out.append(row)
            yield pa.record_batch([*batch.columns[:2], pa.array(out, pa.int32()), *batch.columns[2:]], names=[*KEY, "row_id", *columns[2:]])

    kinds = dict(ordered.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in KEY) + ", row_id int, " + ", ".join(f"{c} {kinds[c]}" for c in columns[2:])
    return ordered.mapInArrow(run, schema)


def row_texts(rows: DataFrame) -> DataFrame:
    """job_id, page_number, row_id, text: the words of each row by x0, one space between."""
    words = F.sort_array(F.collect_list(F.struct("x0", "word_ord", "text")))
    return rows.groupBy(*KEY, "row_id").agg(F.concat_ws(" ", F.transform(words, lambda x: x["text"])).alias("text"))


def page_texts(texts: DataFrame) -> DataFrame:
    """job_id, page_number, text: the rows of each page, one to a line."""
    lines = F.sort_array(F.collect_list(F.struct("row_id", "text")))
    return texts.groupBy(*KEY).agg(F.concat_ws("\n", F.transform(lines, lambda x: x["text"])).alias("text"))


def segments(rows: DataFrame, gap: float | None = C.SEGMENT_GAP, ratio: float = C.OCR_GAP_RATIO) -> DataFrame:
    """rows with segment, from 0 in each row: a new one where the blank before a word is over gap, or, with gap null, over ratio times the height of the taller of the two words."""
    w = Window.partitionBy(*KEY, "row_id").orderBy("x0", "word_ord")
    height = F.greatest(F.col("y1") - F.col("y0"), F.lit(1.0))
    limit = F.lit(gap) if gap is not None else ratio * F.greatest(F.lag(height).over(w), height)
    marked = rows.withColumn("_new", F.coalesce(F.col("x0") - F.lag("x1").over(w) > limit, F.lit(False)).cast("int"))
    return marked.withColumn("segment", F.sum("_new").over(w).cast("int")).drop("_new")


def segment_texts(parts: DataFrame) -> DataFrame:
    """job_id, page_number, text: every segment on a line of its own."""
    return page_texts(row_texts(parts.withColumn("row_id", F.struct("row_id", "segment"))))


def leftmost(parts: DataFrame) -> DataFrame:
    return parts.filter("segment = 0")
