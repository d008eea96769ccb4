"""Page ranges written as text: parsing, checks and the pages they cover."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import strip_sql

_TOKEN = r"^\\s*(\\d+)\\s*(?:-\\s*(\\d+)\\s*)?$"


def parse_splits(jobs: DataFrame, raw: str = "split_value_raw", pages: str = "page_count") -> DataFrame:
    """jobs with ranges (array of struct(start, end), by start) and split_error (null if all is well).

    Tokens stand between commas; blank ones don't count and a blank text has no ranges. The first bad token names the
    error: syntax, then reversed (start over end), then bounds; only if all are good, overlap. No row is lost or shuffled.
    """
    token = f"transform(filter(split(coalesce({raw}, ''), ','), x -> {strip_sql('x')} != ''), x -> named_struct('ok', x rlike '{_TOKEN}', 'start', try_cast(nullif(regexp_extract(x, '{_TOKEN}', 1), '') as bigint), 'end', try_cast(coalesce(nullif(regexp_extract(x, '{_TOKEN}', 2), ''), nullif(regexp_extract(x, '{_TOKEN}', 1), '')) as bigint)))"
    step = jobs.withColumn("_t", F.expr(token))
    bad = f"filter(transform(_t, x -> case when not x.ok then 'syntax' when x.start is null or x.end is null then 'bounds' when x.start > x.end then 'reversed' when x.start < 1 or x.end > {pages} then 'bounds' end), e -> e is not null)"
    step = step.withColumns({"_bad": F.expr(f"get({bad}, 0)"), "_r": F.expr("sort_array(transform(_t, x -> named_struct('start', x.start, 'end', x.end)))")})
    overlap = F.expr("exists(transform(_r, (x, i) -> coalesce(x.end >= get(_r, i + 1).start, false)), o -> o)")
    error = F.coalesce("_bad", F.when(overlap, "overlap"))
    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint>>)")
    return step.withColumns({"split_error": error, "ranges": F.when(error.isNull(), F.col("_r")).otherwise(none)}).drop("_t", "_bad", "_r")


def needs_confirmation(jobs: DataFrame, raw: str = "split_value_raw", confirmed: str = "confirmed_no_split") -> DataFrame:
    """jobs with conflict: no split was given, and that was not confirmed. A split of blanks only is one given."""
    return jobs.withColumn("conflict", F.coalesce(F.col(raw), F.lit("")).eqNullSafe(F.lit("")) & ~F.coalesce(F.col(confirmed), F.lit(False)))


def pages_in_scope(jobs: DataFrame, job: str = "job_id", ranges: str = "ranges", pages: str = "page_count") -> DataFrame:
    """job_id, page_number: the pages of the ranges, each once, or all pages of a job without ranges."""
    inside = f"if(size({ranges}) > 0, array_distinct(flatten(transform({ranges}, r -> sequence(r.start, r.end)))), if({pages} > 0, sequence(1L, cast({pages} as bigint)), cast(array() as array<bigint>)))"
    return jobs.select(F.col(job).alias("job_id"), F.explode(F.expr(inside)).alias("page_number"))
