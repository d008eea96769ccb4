"""Quality rules as a ledger of failure bits (operator 8, SQL functions only).

Every rule is evaluated once over the whole text; the ledger keeps each measurement and one failure bit for each rule.
A policy is a versioned set of rules, applied afterwards as a mask, so another policy or an ablation reads the ledger and
never the texts again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GAP, restored, set_aside, words

#: Rule, bit by place; each is SQL over the measurements and true where the rule fails. A bit never changes its meaning.
RULES: dict[str, str] = {
    "few_words": "n_words < 20",
    "repeated_windows": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "10 * n_dup_lines > 3 * n_lines AND n_lines >= 4",
    "word_length": "word_chars < 2 * n_words OR word_chars > 20 * n_words",
    "shouting": "2 * n_upper > word_chars",
    "exclamations": "10 * n_bangs > 3 * n_words",
}
BIT = {rule: 1 << i for i, rule in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A version and the rules that reject under it."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
DEFAULT = Policy("2", tuple(RULES))
POLICIES = {p.version: p for p in (BASE, Policy("1", ("few_words", "repeated_windows", "symbols", "shouting")), DEFAULT)}
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper", "n_bangs")


def _ledger(rows: DataFrame, text: str) -> DataFrame:
    """rows, whose names were set aside, with the measurements and failures."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rest = rows.columns
    step = rows.select(*rest, whole.alias("_t"), words(whole).alias("_w"))
    step = step.select(
        *rest,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", GAP, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_t", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.expr("(length(_t) - length(replace(_t, '!!', ''))) div 2").cast("long").alias("n_bangs"),
        F.expr(r"filter(split(_t, '\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')").alias("_l"),
        F.expr("if(size(_w) >= 9, transform(sequence(1, size(_w) - 7), i -> xxhash64(slice(_w, i, 8))), cast(array() as array<bigint>))").alias("_h"),
    )
    step = step.withColumns({"n_lines": F.size("_l").cast("long"), "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long")}).drop("_l")
    # A text whose windows all differ, as most do, is not sorted.
    step = step.withColumn("_s", F.expr("if(size(array_distinct(_h)) < size(_h), sort_array(transform(_h, (h, i) -> named_struct('h', h, 'i', i))), null)")).drop("_h")
    step = step.withColumn("_p", F.expr("sort_array(transform(filter(_s, (x, k) -> x.h <=> get(_s, k - 1).h or x.h <=> get(_s, k + 1).h), x -> x.i))")).drop("_s")
    covered = "aggregate(_p, named_struct('n', 0, 'end', 0), (a, i) -> named_struct('n', a.n + i + 8 - greatest(a.end, i), 'end', i + 8), a -> a.n)"
    step = step.withColumn("n_repeat_words", F.expr(f"coalesce(cast({covered} as bigint), 0L)")).drop("_p")
    bits = " | ".join(f"if({test}, {BIT[rule]}L, 0L)" for rule, test in RULES.items())
    # A filter on failures must not be carried back into the measurements, which would repeat them for each use: it stops at explode.
    held = step.select(*rest, F.explode(F.array(F.struct(*MEASURES, F.expr(bits).alias("failures")))).alias("_m"))
    return held.select(*rest, "_m.*")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the measurements (long) and failures (long, a bit for each failed rule).

    Null and empty texts have no words and fail few_words. Repeated rows each have their own measurements. Columns of docs
    with a measurement's name, or called failures, are replaced; all others pass, whatever they are called.
    n_repeat_words: the words covered by eight-word windows whose words occur in the same text again. Windows are held by a
    64-bit hash, compared only inside one text, sorted with their places: neighbours with one hash are repeats, and each
    covers as many new words as its distance to the next repeat, eight at most.
    """
    rows, at = set_aside(docs, text)
    led = _ledger(rows, at[text])
    return led.select(*restored(led, at, (*MEASURES, "failures")), *MEASURES, "failures")


def apply_policy(led: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """led with policy (its version) and kept."""
    return led.withColumns({"policy": F.lit(policy.version), "kept": F.col("failures").bitwiseAND(F.lit(policy.mask)) == 0})


def ablation(led: DataFrame, policy: Policy = DEFAULT) -> DataFrame:
    """For each rule of policy: rule, failed (rows that fail it) and sole (rows that would be kept without it).

    One pass counts each failure pattern, at most one for each subset of rules; the bits are taken apart after that. An
    empty ledger gives zeros.
    """
    patterns = led.groupBy(F.col("failures").bitwiseAND(F.lit(policy.mask)).alias("p")).count()
    each = [F.struct(F.lit(r).alias("rule"), F.coalesce(F.sum(F.expr(f"if(p & {BIT[r]}L != 0, count, 0L)")), F.lit(0)).alias("failed"), F.coalesce(F.sum(F.expr(f"if(p = {BIT[r]}L, count, 0L)")), F.lit(0)).alias("sole")) for r in policy.rules]
    return patterns.agg(F.array(*each).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def filtered(docs: DataFrame, policy: Policy = DEFAULT, text: str = "text") -> DataFrame:
    """The rows of docs that policy keeps, with the columns of docs as they are."""
    rows, at = set_aside(docs, text)
    kept = _ledger(rows, at[text]).filter(F.col("failures").bitwiseAND(F.lit(policy.mask)) == 0)
    return kept.select(*restored(kept, at))


def op8_quality_rules(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    led = apply_policy(ledger(docs))
    base = F.col("failures").bitwiseAND(F.lit(BASE.mask)) != 0
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], chr(10)) AS k
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 9)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, sum(least(8, coalesce(nx - i, 8)))::BIGINT AS n
        FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM rep) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
        len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
        coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
        length(regexp_replace(t, '[^\p{Lu}]+', '', 'g'))::BIGINT AS n_upper,
        ((length(t) - length(replace(t, '!!', ''))) // 2)::BIGINT AS n_bangs
      FROM w LEFT JOIN cov ON cov.doc_id = w.doc_id),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR (10 * n_dup_lines > 3 * n_lines AND n_lines >= 4)
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * n_upper > word_chars OR 10 * n_bangs > 3 * n_words) AS kept
FROM b
"""
QUERIES = {"op8_quality_rules": op8_quality_rules}
SQL = {"op8_quality_rules": OP8_SQL}
