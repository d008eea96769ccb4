"""Near-duplicate embeddings by int8 tile products with error bounds (operator 5).

Equal vectors are one. The rest are dealt to bands of bounded size, and a task compares one pair of bands, tile by tile:
each pair of tiles is one int8 matrix product. Each vector knows how far its quantised form is from it, so a product gives
an interval for the cosine; only pairs whose interval holds the threshold are computed in double precision, in the same
task. A task sends back counts and a star for each group of linked vectors, never the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import cut, set_aside
from .graph import components

THRESHOLD = 0.95
#: Bytes of the vectors of one band, as doubles; a task holds two bands.
BAND_BYTES = 32_000_000
#: Rows and columns of one product.
ROWS, TILE = 512, 4096
#: Room for rounding in double precision, far above what it can be.
SLACK = 1e-9


def quantised(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 q, scale and error for unit rows: error is the length of unit - scale * q."""
    scale = np.abs(unit).max(axis=1) / 127
    q = np.rint(unit / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((unit - scale[:, None] * q) ** 2).sum(axis=1))


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products as floats: a sum of up to 1024 products of int8 stays below 2**24."""
    out = a[:, :1024] @ b[:, :1024].T
    for k in range(1024, a.shape[1], 1024):
        out = out.astype(np.float64) + a[:, k : k + 1024] @ b[:, k : k + 1024].T
    return out


def prepared(v: np.ndarray) -> dict:
    """Unit rows of v with their quantised form."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    q, scale, error = quantised(unit)
    return {"unit": unit, "q": q, "scale": scale, "error": error}


def linked(a: dict, b: dict | None, threshold: float, rows: int = ROWS, tile: int = TILE):
    """Yield indices (into a, into b) of the pairs whose cosine is threshold or more, a product at a time; b None: the pairs inside a, once each."""
    o = a if b is None else b
    many = max(1, 4_000_000 // a["unit"].shape[1])
    for to in range(0, len(o["q"]), tile):
        fo, eo, so = o["q"][to : to + tile].astype(np.float32), o["error"][to : to + tile], o["scale"][to : to + tile]
        reach, top = eo.max(), so.max()
        for at in range(0, len(a["q"]), rows):
            if b is None and at > to + tile:
                break
            ea, sa = a["error"][at : at + rows], a["scale"][at : at + rows]
            # |cos - sa * sb * product| <= ea + eb + ea * eb, as unit vectors and their quantised forms differ by ea and eb.
            least = (threshold - SLACK - ea - reach * (1 + ea)) / (sa * top)
            least = np.where(least > 0, least, -np.inf)
            p = _product(a["q"][at : at + rows].astype(np.float32), fo)
            r, c = np.nonzero(p >= least.astype(np.float32)[:, None] - 1)
            if b is None:
                r, c = r[c + to > r + at], c[c + to > r + at]
            middle, width = sa[r] * so[c] * p[r, c], ea[r] + eo[c] + ea[r] * eo[c]
            true = middle - width >= threshold + SLACK
            open_ = np.flatnonzero(~true & (middle + width >= threshold - SLACK))
            for k in range(0, len(open_), many):
                some = open_[k : k + many]
                true[some] = np.einsum("ij,ij->i", a["unit"][r[some] + at], o["unit"][c[some] + to]) >= threshold
            if true.any():
                yield r[true] + at, c[true] + to


def roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 the smallest node of each one's component."""
    lab = np.arange(n)
    while True:
        low = np.minimum(lab[left], lab[right])
        new = lab.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, lab[left], low)
        np.minimum.at(new, lab[right], low)
        new = new[new]
        if (new == lab).all():
            return lab
        lab = new


def star(ids: np.ndarray, copies: np.ndarray, first: np.ndarray | None, v: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, root, n) of the vectors that link: of all pairs, or with first (booleans) of those between first and the others. n counts copies; root is the smallest id linked by a chain."""
    side = [np.arange(len(ids))] if first is None else [np.flatnonzero(first), np.flatnonzero(~first)]
    count, lab = np.zeros(len(ids), np.int64), np.arange(len(ids))
    if all(map(len, side)):
        parts = [prepared(v[s]) for s in side]
        for i, j in linked(parts[0], None if first is None else parts[1], threshold):
            i, j = side[0][i], side[-1][j]
            np.add.at(count, i, copies[j])
            np.add.at(count, j, copies[i])
            x, y = lab[i], lab[j]
            new = x != y
            if new.any():
                pairs = np.unique(x[new] * len(ids) + y[new])
                lab = roots(len(ids), pairs // len(ids), pairs % len(ids))[lab]
    low = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(low, lab, ids)
    hit = count > 0
    return ids[hit], low[lab][hit], count[hit]


def links(reps: DataFrame, threshold: float = THRESHOLD, band_bytes: int = BAND_BYTES) -> DataFrame:
    """id, root, n for reps (id, v array<float or double>, copies): n other vectors link with id there, copies counted; root is the smallest id linked, by a chain, in one pair of bands.

    Vectors of each length have their own bands: enough to keep all cores at work, and so many that none is over
    band_bytes. A vector is sent to each pair its band is in, so what is moved grows with the vectors times the bands:
    in proportion to the vectors while the bands hold them, and beyond that with their square over band_bytes, the least
    that tasks of bounded memory can do.
    """
    spark = reps.sparkSession
    busy = int(np.ceil(np.sqrt(4 * spark.sparkContext.defaultParallelism)))
    sizes = reps.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("m"))
    sizes = cut(sizes.select("d", F.expr(f"cast(greatest(least({busy}, ceil(m / 512)), ceil(m * d * 8 / {band_bytes})) as int)").alias("bands")))
    tasks = sizes.agg(F.sum(F.expr("cast(bands as bigint) * (bands + 1) div 2"))).first()[0] or 1
    own = reps.withColumn("d", F.size("v")).join(sizes, "d").withColumn("band", F.pmod(F.xxhash64("id"), F.col("bands")).cast("int"))
    dealt = own.select("d", "id", "copies", "v", "band", F.explode(F.expr("sequence(0, bands - 1)")).alias("other"))
    dealt = dealt.select("d", F.least("band", "other").alias("x"), F.greatest("band", "other").alias("y"), (F.col("band") <= F.col("other")).alias("first"), "id", "copies", "v")

    def compare(key, table):
        d, x, y = (k.as_py() for k in key)
        first = table["first"].to_numpy().astype(bool) if x != y else None
        flat = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
        out = star(table["id"].to_numpy().astype(np.int64), table["copies"].to_numpy().astype(np.int64), first, flat, threshold)
        return pa.table([pa.array(c) for c in out], names=["id", "root", "n"])

    return dealt.repartition(min(tasks, 20_000), "d", "x", "y").groupBy("d", "x", "y").applyInArrow(compare, "id bigint, root bigint, n bigint")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, band_bytes: int = BAND_BYTES, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept for each row of vectors; threshold lies above 0.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; vectors of different
    lengths don't link. Equal vectors (0.0 and -0.0 are equal) link whatever rounding says. A row with a null vec_id keeps
    its links and its component but is never kept, and the smallest vec_id in a component passes nulls over. Rows with one
    vec_id are vectors of their own; other columns are passed over, whatever they are called. All pairs of tiles are
    compared, so the time grows with the square of the number of distinct vectors; a task's memory doesn't.
    """
    held, at = set_aside(vectors, vec_id, embedding)
    kind = vectors.schema[embedding].dataType
    number = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"
    v = F.transform(F.col(at[embedding]), lambda x: x.cast(number) + F.lit(0.0).cast(number))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = held.select(F.col(at[vec_id]).cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.withColumn("ok", F.coalesce((F.size("v") > 0) & ~bad & F.exists("v", lambda x: x != 0), F.lit(False)))
    # Vectors that link with nothing have keys of their own, so that they don't all meet in one task.
    rows = rows.select("vec_id", "v", "ok", F.when(F.col("ok"), F.xxhash64("v")).otherwise(F.monotonically_increasing_id()).alias("_k1"), F.when(F.col("ok"), F.xxhash64(F.lit(7), "v")).otherwise(0).alias("_k2"))
    # Equal vectors meet after counting inside each task; the id of a class is a hash, as its vec_id may be null.
    classes = rows.filter("ok").groupBy("_k1", "_k2").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))
    classes = cut(classes.withColumn("id", F.xxhash64("_k1", "_k2")))
    found = cut(links(classes.select("id", "v", "copies"), threshold, band_bytes))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    comp = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    named = classes.select("id", "_k1", "_k2", "low", "copies").join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    lows = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(lows, "component").join(counts, "id", "left").select(F.lit(True).alias("ok"), "_k1", "_k2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), "component_id")
    out = rows.select("vec_id", "ok", "_k1", "_k2").join(named, ["ok", "_k1", "_k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def op5_embedding_dedup(spark, sf_dir):
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


OP5_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
ok AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
r(x, y) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.x, p.b FROM r JOIN p ON p.a = r.y),
c AS (SELECT x AS vec_id, min(y) AS component_id FROM r GROUP BY x),
k AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY a)
SELECT c.vec_id, coalesce(k.n, 0)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept FROM c LEFT JOIN k ON k.vec_id = c.vec_id
"""
QUERIES = {"op5_embedding_dedup": op5_embedding_dedup}
SQL = {"op5_embedding_dedup": OP5_SQL}
