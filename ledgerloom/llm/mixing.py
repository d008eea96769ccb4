"""Mixing sources to target weights (operator 1).

Each source is one stream of words, cut into blocks of a fixed length. Source counts for each output shard are multinomial,
given totals that meet the targets; a source's slots map through a pseudorandom permutation of its block numbers, one for
each pass over the source, and the blocks are joined to the slots by number. Nothing is drawn by state, so reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import draws
from .common import cut, n_words, permuted, row_keys, set_aside, sums_before

BLOCK = 256
#: Slots that an output shard holds about, and rows of a source that one task orders.
SHARD_SLOTS = 4096
BUCKET_ROWS = 2_000


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, ceiling: float) -> DataFrame:
    """sources (_s, source, source_size) with number (from 0, by code point, null last) and target (double).

    Targets go by weight, repeating in order, up to ceiling times the source's size; what a source can't take goes to the
    others by weight until none is above. Ordered by ceiling over weight, a source is full if the level left after those
    before it reaches its own; the first level that doesn't fixes all others. One row for each source: no task sees more.
    """
    every, ahead = Window.orderBy("_ratio", "number"), Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    s = sources.withColumn("number", (F.row_number().over(ahead) - 1).cast("int")).withColumns({"_w": w, "_cap": F.col("source_size") * F.lit(float(ceiling))})
    s = s.withColumns({"_ratio": F.col("_cap") / F.col("_w"), "_all": F.sum("source_size").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) * F.lit(float(share))})
    s = s.withColumns({"_full": F.coalesce(F.sum("_cap").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "_rest": F.sum("_w").over(every.rowsBetween(0, Window.unboundedFollowing))})
    s = s.withColumn("_level", (F.col("_all") - F.col("_full")) / F.col("_rest"))
    free = F.col("_level") < F.col("_ratio")
    s = s.withColumn("_fixed", F.max(F.when(free, F.col("_level"))).over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return s.withColumn("target", F.when(free, F.col("_w") * F.col("_fixed")).otherwise(F.col("_cap"))).select("_s", "source", "number", "source_size", "target")


def _slots_for(sources: DataFrame, block: int, seed: int) -> DataFrame:
    """sources with blocks (number of), words (to take), slots (number of) and last (words of the last slot).

    The last block of a source may be short; where its turn comes in each pass is known from the permutation's inverse, so
    the slots are counted to give exactly the words wanted.
    """
    s = sources.withColumns({"blocks": F.expr(f"(source_size + {block - 1}) div {block}"), "words": F.round("target").cast("long")})
    s = s.withColumn("_d", F.expr(f"blocks * {block} - source_size"))
    for e in (0, 1):
        s = s.withColumn(f"_p{e}", F.expr(f"if(blocks = 0, 0L, {e} * blocks + {permuted('blocks - 1', 'blocks', f'{seed}L, number, {e}', inverse=True)})"))
    s = s.withColumn("slots", F.expr(f"(words + {block - 1}) div {block}"))
    for _ in range(3):
        s = s.withColumn("slots", F.expr(f"(words + _d * (if(_p0 < slots, 1, 0) + if(_p1 < slots, 1, 0)) + {block - 1}) div {block}"))
    before = f"(slots - 1) * {block} - _d * (if(_p0 < slots - 1, 1, 0) + if(_p1 < slots - 1, 1, 0))"
    return s.withColumn("last", F.expr(f"words - ({before})")).drop("_d", "_p0", "_p1")


def mix(docs: DataFrame, weights=(5.0, 2.0, 1.0), share: float = 1.5, ceiling: float = 2.0, block: int = BLOCK, seed: int = 1, text: str = "text", source: str = "source", bucket_rows: int = BUCKET_ROWS, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame]:
    """(spans, rows) for docs with doc_id, text and source; ceiling is 2 at most.

    rows: for each row of docs _rid, doc_id, _k1 and _k2 (hashes of doc_id and text), source, size (long, words; a null text has
    none), source_size, target. spans: what the mix takes, in order of shard and place (its slot in the shard): _rid,
    doc_id, source, epoch (pass, 0 or 1), block, start (first word in the document, from 0) and n (words). Each
    source's words come to its target, rounded. A null source is a source; empty tables give empty ones; repeated rows
    each have their own place; other columns of docs are passed over, whatever they are called. Sources are ordered inside hash buckets, so a source with most rows is spread over tasks;
    the sources themselves are taken to be few (one array of them is held).
    """
    rows, at = set_aside(docs, "doc_id", text, source)
    return _mix(rows, at["doc_id"], at[text], at[source], weights, share, ceiling, block, seed, bucket_rows, shard_slots)


def _mix(docs: DataFrame, doc_id: str, text: str, source: str, weights=(5.0, 2.0, 1.0), share: float = 1.5, ceiling: float = 2.0, block: int = BLOCK, seed: int = 1, bucket_rows: int = BUCKET_ROWS, shard_slots: int = SHARD_SLOTS) -> tuple[DataFrame, DataFrame]:
    if not 0 < ceiling <= 2:
        raise ValueError("ceiling must be above 0 and at most 2")
    key = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit("!"))
    thin = cut(docs.select(F.monotonically_increasing_id().alias("_rid"), F.col(doc_id).alias("doc_id"), *row_keys(F.col(doc_id), F.col(text)), F.col(source).alias("source"), key.alias("_s"), n_words(F.col(text)).alias("size")))
    sources = thin.groupBy("_s").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    sources = cut(_slots_for(targets(sources, tuple(weights), share, ceiling), block, seed))
    n, total = thin.count(), sources.agg(F.sum("slots")).first()[0] or 0
    small = F.broadcast(sources) if sources.count() <= 10_000 else sources
    rows = thin.join(small.select("_s", "number", "source_size", "target"), "_s")

    buckets = max(1, -(-n // bucket_rows))
    spread = rows.filter("size > 0").withColumn("_b", F.pmod("_k1", F.lit(buckets)).cast("int"))
    held = spread.groupBy("number", "_b").agg(F.sum("size").alias("_t"))
    base = sums_before(held, ["number"], "_b", "_t", "_base").select("number", "_b", "_base")
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("number", "_b").orderBy("_k1", "_k2", "_rid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    stream = spread.withColumn("_in", inside).join(base, ["number", "_b"]).withColumn("at", F.col("_base") + F.col("_in"))
    pieces = stream.select("_rid", "doc_id", "source", "number", "at", "size", F.explode(F.expr(f"sequence(at div {block}, (at + size - 1) div {block})")).alias("block"))

    levels = max(0, (-(-total // shard_slots) - 1).bit_length())
    r = 2**levels
    sizes = docs.sparkSession.range(r).select(F.col("id").cast("int").alias("row"), F.expr(f"{total // r}L + if(id < {total % r}, 1L, 0L)").alias("n"))
    caps = sources.agg(F.expr("transform(sort_array(collect_list(struct(number, slots))), x -> x.slots)").alias("caps")).filter("size(caps) > 0")
    counts = draws.matrix(sizes, caps, levels, seed)
    counts = counts.withColumn("held", F.expr("aggregate(counts, 0L, (s, x) -> s + x)")).withColumn("x", F.expr("transform(counts, (c, j) -> named_struct('number', j, 'c', c, 'o', offsets[j], 'before', aggregate(slice(counts, 1, j), 0L, (s, y) -> s + y)))"))
    counts = counts.select(F.col("row").alias("shard"), "held", F.explode("x").alias("x")).filter("x.c > 0").select("shard", "held", "x.*")
    # A row stands for thousands of slots, so the rows are dealt by their number, which their bytes don't tell.
    counts = counts.repartition(max(1, r // 4), "shard")
    slots = counts.select("shard", "number", "held", "o", "before", F.explode(F.expr("sequence(o, o + c - 1)")).alias("t"))
    slots = slots.join(small.select("number", "blocks", "slots", "last"), "number")
    slots = slots.select(
        "shard",
        F.expr(permuted("before + t - o", "held", f"{seed + 1}L, shard")).alias("place"),
        "number",
        F.expr("cast(t div blocks as int)").alias("epoch"),
        F.expr(permuted("t % blocks", "blocks", f"{seed}L, number, cast(t div blocks as int)")).alias("block"),
        F.expr(f"if(t = slots - 1, last, {block}L)").alias("quota"),
    )
    spans = slots.join(pieces, ["number", "block"])
    first = f"greatest(at, block * {block}L)"
    spans = spans.withColumn("n", F.expr(f"least(least(at + size, (block + 1) * {block}L) - {first}, quota - ({first} - block * {block}L))")).filter("n > 0")
    spans = spans.select("shard", "place", "_rid", "doc_id", "source", "epoch", "block", F.expr(f"{first} - at").alias("start"), "n")
    return spans, rows.select("_rid", "doc_id", "_k1", "_k2", "source", "size", "source_size", "target")


def taken(docs: DataFrame, **how) -> DataFrame:
    """For each row of docs: doc_id, source, size, source_size, target (its source's), taken (words, repeats counted)."""
    spans, rows = mix(docs, **how)
    return rows.join(spans.groupBy("_rid").agg(F.sum("n").alias("taken")), "_rid", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", **how) -> DataFrame:
    """The mix as documents: for each row of docs and pass that takes of it, its columns with the taken words as text.

    A row taken whole keeps its text byte for byte; otherwise the taken words stand with the blanks between them. A column
    n_chars, if there, follows the text; all others pass, whatever they are called. Rows without words, and those of which
    nothing is taken, have no row.
    """
    own, at = set_aside(docs, "doc_id", text, source)
    doc, held = F.col(at["doc_id"]), at[text]
    spans, rows = _mix(own, at["doc_id"], held, at[source], **how)
    # Rows that are equal in doc_id and text share the spans of all of them, one each.
    twin = Window.partitionBy("_k1", "_k2")
    names = rows.select("_rid", "_k1", "_k2", F.row_number().over(twin.orderBy("_rid")).alias("_n"))
    parts = spans.groupBy("_rid", "epoch").agg(F.sort_array(F.collect_list(F.struct("start", "n"))).alias("_p"), F.sum("n").alias("_t")).join(names, "_rid")
    own = own.select("*", *row_keys(doc, F.col(held)), n_words(F.col(held)).alias("_size"))
    own = own.withColumn("_n", F.row_number().over(twin.orderBy("_size")))
    out = own.join(parts, ["_k1", "_k2", "_n"])
    # The words are cut once for all spans of a row.
    pieces = f"regexp_extract_all({held}, '[^\\\\x20\\\\x09-\\\\x0D]+[\\\\x20\\\\x09-\\\\x0D]*', 0)"
    cut_out = F.expr(f"transform(array({pieces}), w -> rtrim(array_join(flatten(transform(_p, x -> slice(w, cast(x.start + 1 as int), cast(x.n as int)))), '')))[0]")
    changed = {text: F.when(F.col("_t") == F.col("_size"), F.col(held)).otherwise(cut_out)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length(changed[text]).cast(docs.schema["n_chars"].dataType)
    return out.select(*[changed.get(old, F.col(new)).alias(old) for old, new in at.items()])


def op1_mixing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return taken(docs)


QUERIES = {"op1_mixing": op1_mixing}
SQL = {}
