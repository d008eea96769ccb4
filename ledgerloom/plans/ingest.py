"""From uploaded files to jobs with their invoices: checks, page ranges, and the extraction of what passes."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..operators import grouping, splits
from ..sources import pages
from ..sources.files import page_sources
from ..shared import cut
from .extract import Extraction, extracted


class Ingested(NamedTuple):
    """jobs: those given, with file_type, page_count, ranges, error (null if taken), status and n_groups (null if refused); what was extracted of those taken; and page_errors: job_id, page_number, error of pages in a job's scope that could not be read."""

    jobs: DataFrame
    extraction: Extraction
    page_errors: DataFrame


def ingest(files: DataFrame, jobs: DataFrame, backend, ocr: Callable[[DataFrame], DataFrame] | None = None) -> Ingested:
    """Take jobs (job_id, path, split_value_raw, confirmed_no_split) over files (path, content, file_type, error, as ``sniff`` gives them).

    The first thing wrong names a job's error: missing, what ``sniff`` found, encrypted or unreadable, too_many_pages,
    confirm_no_split, or split_ and what ``parse_splits`` found. Refused jobs stay, with their error. backend opens files, see
    ``sources.pages``: once to count pages, and once to read those that some job asks for. A job with a page that can't be
    read is for review; the page is a page_error, and has the text that ocr makes of it, if any. ocr takes pages (job_id, page_number, text, digest) without a
    text layer and gives them with their text, see ``sources.cache`` for one that reads no content twice.
    """
    counts = pages.page_counts(files.filter("error is null"), backend).select("path", "page_count", F.col("error").alias("_count"))
    known = files.select("path", "file_type", F.col("error").alias("_file"), F.lit(True).alias("_there"))
    checked = splits.needs_confirmation(splits.parse_splits(jobs.join(known, "path", "left").join(counts, "path", "left")))
    error = F.coalesce(
        F.when(F.col("_there").isNull(), "missing"), "_file", "_count", F.when(F.col("page_count") > C.MAX_PAGES, "too_many_pages"),
        F.when(F.col("conflict"), "confirm_no_split"), F.concat(F.lit("split_"), "split_error"),
    )
    checked = cut(checked.withColumn("error", error).drop("_there", "_file", "_count", "conflict", "split_error"))
    taken = checked.filter("error is null")
    scope = splits.pages_in_scope(taken).select("job_id", F.col("page_number").cast("int").alias("page_number"))
    asked = cut(scope.join(taken.select("job_id", "path"), "job_id"))
    # An image is a page without words; its content is its digest.
    image = F.coalesce(F.col("file_type") != "pdf", F.lit(False))
    read = cut(pages.read_pages(files.filter(~image), backend, asked.select("path", "page_number").distinct()))
    images = files.filter(image).select("path", F.sha2("content", 256).alias("_image"))
    page = ["path", "page_number"]
    words = cut(pages.page_words(read).join(asked, page).drop("path"))
    ruled = pages.page_tables(read).join(asked, page).drop("path")
    failed = pages.page_errors(read)
    lost = cut(asked.join(failed.filter("page_number is not null"), page).unionByName(asked.join(failed.filter("page_number is null").drop("page_number"), "path")).select("job_id", "page_number", "error"))
    text = words.groupBy("job_id", "page_number").agg(F.concat_ws(" ", F.transform(F.sort_array(F.collect_list(F.struct("word_ord", "text"))), lambda w: w["text"])).alias("text"))
    bare = asked.join(read.filter("error is null").select(*page, "digest"), page, "left").join(images, "path", "left").withColumn("digest", F.coalesce("digest", "_image")).drop("path", "_image").join(text, ["job_id", "page_number"], "left").withColumn("text", F.coalesce("text", F.lit("")))
    done = extracted(words, ruled, taken.select("job_id", "ranges"), page_sources(bare.select("job_id", "page_number", "text", "digest"), ocr))
    status = grouping.job_status(taken, done.headers).join(lost.select("job_id").distinct().withColumn("_lost", F.lit(True)), "job_id", "left")
    status = status.withColumn("status", F.when(F.col("_lost"), "review_required").otherwise(F.col("status"))).drop("_lost")
    return Ingested(checked.join(status, "job_id", "left"), done, lost)
