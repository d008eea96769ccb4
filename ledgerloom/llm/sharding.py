"""A uniform shuffle into shards of exact size by a hypergeometric communication matrix (operator 4, SQL functions only).

Rows are dealt to buckets by hash. A matrix with exact margins says how many rows each bucket sends to each shard. Inside
its bucket a row's rank in random order decides its shard and its rank among what that shard gets, the shard's slots are
permuted once more, and one exchange brings the rows to their shards. No task sees more than a bucket or a part of a
shard, and every choice follows from the rows and the seed, so tasks that run again repeat it. Only where more rows than a
bucket holds are equal, the rows are kept with a number each, which deals them too, so that equal rows are spread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import draws
from .common import cut, permuted, restored, set_aside

#: Rows that a bucket holds about.
BUCKET_ROWS = 4096
#: Rows of a shard that one task writes.
CHUNK_ROWS = 4096


def shard(rows: DataFrame, n_shards: int, seed: int = 1, key: list[str] | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """rows with shard (int, from 0) and slot (long, gapless from 0 in each shard), laid out by shard and slot.

    Shard sizes differ by one row at most. key: the columns that deal rows to buckets, all of them unless named; rows that
    agree in them share a bucket, unless they are more than a bucket holds. Whole equal rows may swap places, which can't be
    seen. Nulls are values like any other; an empty table gives an empty one. Columns named shard or slot are replaced,
    all others pass, whatever they are called.
    """
    held, at = set_aside(rows, *(key or ()))
    every = [F.col(c) for c in at.values()]
    own = [F.col(at[c]) for c in key] if key else every
    alike = held.groupBy(F.xxhash64(F.lit(seed + 1), *own).alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
    n, most_alike = alike.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    if most_alike > bucket_rows:
        held = cut(held.withColumn("_id", F.monotonically_increasing_id()))
        own = [*own, F.col("_id")]
    levels = max(0, (-(-n // bucket_rows) - 1).bit_length())
    bucket = F.pmod(F.xxhash64(F.lit(seed), *own), F.lit(2**levels)).cast("int")
    # The hashes go through explode, as Catalyst would else rewrite what it knows of them for each subset of renamed columns.
    hashes = F.struct(bucket.alias("_b"), F.xxhash64(F.lit(seed + 1), *own).alias("_r"), F.xxhash64(*every).alias("_tie"))
    dealt = held.select("*", F.explode(F.array(hashes)).alias("_x")).select(*every, "_x.*")
    sizes = held.groupBy(bucket.alias("row")).agg(F.count(F.lit(1)).alias("n"))
    caps = rows.sparkSession.range(1).select(F.expr(f"transform(sequence(0, {n_shards - 1}), j -> {n // n_shards}L + if(j < {n % n_shards}, 1L, 0L))").alias("caps"))
    plan = draws.matrix(sizes, caps, levels, seed).select(F.col("row").alias("_b"), "counts", "offsets")
    plan = plan.withColumn("ends", F.expr("transform(counts, (c, j) -> aggregate(slice(counts, 1, j + 1), 0L, (s, x) -> s + x))"))
    placed = dealt.withColumn("_i", (F.row_number().over(Window.partitionBy("_b").orderBy("_r", "_tie")) - 1).cast("long")).join(plan, "_b")
    placed = placed.withColumn("shard", F.expr("size(filter(ends, e -> e <= _i))"))
    rank = "offsets[shard] + _i - if(shard = 0, 0L, ends[shard - 1])"
    most = f"({n // n_shards}L + if(shard < {n % n_shards}, 1L, 0L))"
    placed = placed.select(*at.values(), "shard", F.expr(permuted(rank, most, f"{seed}L, shard")).alias("slot"))
    parts = max(n_shards, -(-n // CHUNK_ROWS))
    laid = placed.repartition(parts, "shard", F.expr(f"slot div {CHUNK_ROWS}")).sortWithinPartitions("shard", "slot")
    return laid.select(*restored(laid, at, ("shard", "slot")), "shard", "slot")


def op4_sharding(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    # The whole row deals, so rows that share a doc_id are spread.
    out = shard(docs, 40)
    text = F.coalesce(F.col("text"), F.lit(""))
    return out.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


QUERIES = {"op4_sharding": op4_sharding}
SQL = {}
