"""Removal of repeated passages by overlapping three-line windows (operator 2, SQL functions only).

A window is three consecutive lines that have a word, compared without the blanks at their ends. The first occurrence of a
window, by doc_id and then by place, stays; every later one covers its three lines and what stands between them, and the
covered lines go. Each line that goes has an equal line earlier, so no line's content is lost altogether.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_keys, set_aside

#: The six ASCII blanks, as they are written in a SQL literal.
_BLANKS = r"\t\n\u000b\u000c\r "


def _lines(rows: DataFrame, text: str) -> DataFrame:
    """rows with the lines _all (array) and the trimmed copies _w of those with a word (place p from 0, line l)."""
    trimmed = f"filter(transform(_all, (x, p) -> named_struct('p', p, 'l', trim(both '{_BLANKS}' from x))), x -> x.l != '')"
    return rows.withColumn("_all", F.split(text, "\n")).withColumn("_w", F.coalesce(F.expr(trimmed), F.expr("cast(array() as array<struct<p: int, l: string>>)")))


def _windows(rows: DataFrame, doc_id: str, text: str) -> DataFrame:
    three = "slice(l, i, 3)"
    lines = _lines(rows.select(F.col(doc_id).alias("doc_id"), *row_keys(F.col(doc_id), F.col(text)), F.col(text).alias("_text")), "_text")
    lines = lines.select("doc_id", "_k1", "_k2", F.expr("transform(_w, x -> x.l)").alias("l")).filter("size(l) >= 3")
    each = f"transform(sequence(1, size(l) - 2), i -> named_struct('i', i, 'h1', xxhash64({three}), 'h2', xxhash64(7, {three})))"
    return lines.select("doc_id", "_k1", "_k2", F.explode(F.expr(each)).alias("x")).select("doc_id", "_k1", "_k2", "x.*")


def windows(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each window: doc_id, _k1, _k2 (the row's key), i (its first line's rank, from 1), h1, h2 (128 bits of its three lines).

    Null and empty texts, and those of under three lines with a word, have none; rows that are equal in doc_id and text
    have equal windows; a null doc_id stays null. Other columns of docs are passed over, whatever they are called.
    """
    rows, at = set_aside(docs, "doc_id", text)
    return _windows(rows, at["doc_id"], at[text])


def dedup(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without their repeated passages: all columns, with text replaced, and n_lines, n_removed (long).

    n_lines counts lines with a word. A text that loses nothing stays as it is, byte for byte; one that loses every line
    with a word becomes empty. Null texts stay null, and texts of under three such lines have no window. Rows with one
    doc_id and one text are one occurrence; a null doc_id comes before all others. Columns of docs called n_lines or
    n_removed are replaced, all others pass, whatever they are called.

    The counts of windows are combined before the shuffle. What is joined to the windows is the repeated ones only, so a
    passage in a third of all texts is one row there, and its many occurrences are split among tasks as a skewed join.
    """
    rows, at = set_aside(docs, "doc_id", text)
    doc, own = at["doc_id"], at[text]
    w = _windows(rows, doc, own)
    place = F.struct("doc_id", "_k1", "i")
    repeated = w.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2", "first")
    later = w.join(repeated, ["h1", "h2"]).filter(~place.eqNullSafe(F.col("first")))
    starts = later.groupBy("_k1", "_k2").agg(F.sort_array(F.collect_set("i")).alias("_s"))
    # Only the text goes through the join; it is split after it.
    keyed = rows.select("*", *row_keys(F.col(doc), F.col(own)))
    joined = _lines(keyed.join(starts, ["_k1", "_k2"], "left"), own)
    # Runs of covered ranks: a window that shares a line with the one before continues its run.
    runs = joined.withColumns({"_a": F.expr("filter(_s, (s, k) -> k = 0 or s > _s[k - 1] + 2)"), "_b": F.expr("filter(_s, (s, k) -> k = size(_s) - 1 or get(_s, k + 1) > s + 2)")})
    runs = runs.withColumn("_r", F.expr("zip_with(_a, _b, (a, b) -> named_struct('a', a, 'b', b + 2, 'from', _w[a - 1].p, 'to', _w[b + 1].p))"))
    left = "array_join(filter(_all, (x, p) -> not exists(_r, r -> p between r.from and r.to)), '\\n')"
    kept = F.when(F.col("_r").isNull(), F.col(own)).otherwise(F.expr(left))
    removed = F.expr("aggregate(coalesce(_r, array()), 0L, (n, r) -> n + r.b - r.a + 1)")
    columns = [(kept if old == text else F.col(new)).alias(old) for old, new in at.items() if old not in ("n_lines", "n_removed")]
    return runs.select(*columns, F.size("_w").cast("long").alias("n_lines"), removed.alias("n_removed"))


def op2_line_dedup(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup(docs).select("doc_id", "n_lines", "n_removed", "text")


OP2_SQL = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, unnest(range(1, len(a) + 1)) AS p, a FROM l),
n AS (SELECT doc_id, p, a[p] AS raw, trim(a[p], chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS t FROM e),
o AS (SELECT doc_id, p, t, row_number() OVER (PARTITION BY doc_id ORDER BY p) AS i,
        lead(t) OVER w AS t2, lead(t, 2) OVER w AS t3, lead(p, 2) OVER w AS p3
      FROM n WHERE t <> '' WINDOW w AS (PARTITION BY doc_id ORDER BY p)),
r AS (SELECT doc_id, p, p3, row_number() OVER (PARTITION BY t, t2, t3 ORDER BY doc_id NULLS FIRST, i) AS nth FROM o WHERE t3 IS NOT NULL),
g AS (SELECT DISTINCT n.doc_id, n.p FROM n JOIN r ON n.doc_id = r.doc_id AND n.p BETWEEN r.p AND r.p3 WHERE r.nth > 1),
k AS (SELECT n.doc_id, count(*) FILTER (n.t <> '')::BIGINT AS n_lines, count(*) FILTER (n.t <> '' AND g.p IS NOT NULL)::BIGINT AS n_removed,
        coalesce(string_agg(n.raw, chr(10) ORDER BY n.p) FILTER (g.p IS NULL), '') AS text
      FROM n LEFT JOIN g ON n.doc_id = g.doc_id AND n.p = g.p GROUP BY n.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_removed, 0)::BIGINT AS n_removed, k.text
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id
"""
QUERIES = {"op2_line_dedup": op2_line_dedup}
SQL = {"op2_line_dedup": OP2_SQL}
