"""Best-fit packing of documents into sequences under conflicts (operator 3).

Pieces of at most the capacity are dealt at random to groups of bounded size, and each group is packed largest first into
the tightest bin that takes the piece. Bins stand in order of the room they have left under a tree whose nodes hold the
AND of the bitmaps below, so a search skips every subtree in which all bins conflict, and goes on to the next larger room
until it finds the tightest compatible bin. (After Ding et al., "Fewer Truncations Improve Language Modeling", 2024.)
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, row_keys, set_aside, words

CAPACITY = 1024
MAX_PER_SOURCE = 4
#: Pieces that a group holds about.
GROUP_PIECES = 8192


class Bins:
    """Open bins of one capacity, found by room and bitmap.

    A bitmap has per_source bits for each source and one for each duplicate cluster; a piece fits a bin that has the room,
    one of its source's bits clear and its cluster's bit clear.
    """

    def __init__(self, capacity: int, per_source: int):
        self.capacity, self.per_source = capacity, per_source
        self.width = 1 << capacity.bit_length()
        # -1, all bits set, stands for no bin at all: everything conflicts with it.
        self.tree = [-1] * (2 * self.width)
        self.leaves: list[dict[int, list[int]]] = [{} for _ in range(capacity + 1)]
        self.count = 0

    def _find(self, node: int, low: int, high: int, room: int, own: int, cluster: int) -> tuple[int, int] | None:
        if high < room or self.tree[node] & cluster or self.tree[node] & own == own:
            return None
        if low == high:
            return next(((low, bits) for bits in self.leaves[low] if not bits & cluster and bits & own != own), None)
        mid = (low + high) // 2
        return self._find(2 * node, low, mid, room, own, cluster) or self._find(2 * node + 1, mid + 1, high, room, own, cluster)

    def _update(self, room: int) -> None:
        bits = -1
        for b in self.leaves[room]:
            bits &= b
        node = self.width + room
        self.tree[node] = bits
        while node > 1:
            node //= 2
            self.tree[node] = self.tree[2 * node] & self.tree[2 * node + 1]

    def place(self, size: int, source: int, cluster: int | None, sources: int) -> tuple[int, int]:
        """(bin, words already in it) for a piece; source and cluster are numbers, a null cluster has no duplicate."""
        k = self.per_source
        own = ((1 << k) - 1) << (source * k)
        mark = 0 if cluster is None else 1 << (sources * k + cluster)
        found = self._find(1, 0, self.width - 1, size, own, mark)
        if found is None:
            number, room, bits, self.count = self.count, self.capacity, 0, self.count + 1
        else:
            room, bits = found
            same = self.leaves[room][bits]
            number = same.pop()
            if not same:
                del self.leaves[room][bits]
            self._update(room)
        free = own & ~bits
        left = room - size
        self.leaves[left].setdefault(bits | (free & -free) | mark, []).append(number)
        self._update(left)
        return number, self.capacity - room


def pack_group(sizes: list[int], sources: list, clusters: list, capacity: int, per_source: int) -> list[tuple[int, int]]:
    """(bin, offset) for each piece, taken largest first and else in the order given."""
    names = {s: i for i, s in enumerate(dict.fromkeys(sources))}
    seen: dict = {}
    for c in clusters:
        seen[c] = seen.get(c, 0) + 1
    shared = {c: i for i, c in enumerate(c for c, n in seen.items() if n > 1 and c is not None)}
    bins, out = Bins(capacity, per_source), [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        out[i] = bins.place(sizes[i], names[sources[i]], shared.get(clusters[i]), len(names))
    return out


def _plan(rows: DataFrame, doc_id: str, text: str, source: str, cluster: str | None, capacity: int, max_per_source: int, group_pieces: int, seed: int) -> DataFrame:
    """doc_id, source, _k1, _k2 (the row's key), copy, piece, start, n, bin, offset: pieces as numbers, no text among them.

    Rows that are equal in doc_id, text, source and cluster are one row and a count until their pieces are made.
    """
    low = F.lower(F.col(text))
    # The words are cut once for the count and both hashes.
    of = F.transform(F.array(words(low)), lambda w: F.struct(F.size(w).cast("long").alias("size"), F.concat_ws("-", F.xxhash64(w), F.xxhash64(F.lit(7), w)).alias("c")))[0]
    own = F.col(cluster).cast("string") if cluster else F.lit("")
    thin = rows.select(F.col(doc_id).alias("doc_id"), F.col(source).cast("string").alias("source"), own.alias("_own"), *_keys(doc_id, text, source, cluster), of.alias("_w"))
    thin = thin.groupBy("_k1", "_k2").agg(F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.first("_own").alias("_own"), F.first("_w").alias("_w"), F.count(F.lit(1)).alias("copies"))
    thin = cut(thin.select("doc_id", "source", "_k1", "_k2", F.col("_w.size").alias("_size"), (F.col("_own") if cluster else F.col("_w.c")).alias("_c"), "copies"))
    per = F.expr(f"greatest(1L, (_size + {capacity - 1}) div {capacity}) * copies")
    groups = max(1, -(-(thin.agg(F.sum(per)).first()[0] or 0) // group_pieces))
    each = thin.withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).drop("copies")
    pieces = each.withColumn("piece", F.explode(F.expr(f"sequence(0, cast(greatest(0, _size - 1) div {capacity} as int))")))
    pieces = pieces.withColumns({"start": F.expr(f"cast(piece as bigint) * {capacity}"), "n": F.expr(f"least({capacity}L, _size - cast(piece as bigint) * {capacity})")}).drop("_size")
    pieces = pieces.withColumn("_h", F.xxhash64(F.lit(seed), "_k1", "_k2", "copy")).withColumn("_g", F.pmod(F.xxhash64("_h", "piece"), F.lit(groups)))
    kept = ["doc_id", "source", "_k1", "_k2", "copy", "piece", "start", "n", "bin", "offset"]
    types = {f.name: f.dataType.simpleString() for f in pieces.schema.fields} | {"bin": "bigint", "offset": "bigint"}

    def kernel(key, table):
        table = table.sort_by([("_h", "ascending"), ("piece", "ascending"), ("_k1", "ascending"), ("_k2", "ascending"), ("copy", "ascending")])
        sizes = table["n"].to_pylist()
        full = [i for i, n in enumerate(sizes) if n]
        source_of, cluster_of = table["source"].to_pylist(), table["_c"].to_pylist()
        places = pack_group([sizes[i] for i in full], [source_of[i] for i in full], [cluster_of[i] for i in full], capacity, max_per_source)
        bins, offsets = [None] * len(sizes), [None] * len(sizes)
        for i, (b, o) in zip(full, places, strict=True):
            bins[i], offsets[i] = (key[0].as_py() << 32) + b, o
        table = table.append_column("bin", pa.array(bins, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))
        return table.select(kept)

    return pieces.groupBy("_g").applyInArrow(kernel, ", ".join(f"{c} {types[c]}" for c in kept))


def _keys(doc_id: str, text: str, source: str, cluster: str | None) -> list:
    return row_keys(*[F.col(c) for c in (doc_id, text, source, *([cluster] if cluster else []))])


def plan(docs: DataFrame, capacity: int = CAPACITY, max_per_source: int = MAX_PER_SOURCE, cluster: str | None = None, text: str = "text", source: str = "source", group_pieces: int = GROUP_PIECES, seed: int = 1) -> DataFrame:
    """As ``pack``, but without the pieces' texts: doc_id, source, piece, start, n, bin, offset."""
    rows, at = set_aside(docs, "doc_id", text, source, *([cluster] if cluster else []))
    out = _plan(rows, at["doc_id"], at[text], at[source], at.get(cluster), capacity, max_per_source, group_pieces, seed)
    return out.select("doc_id", "source", "piece", "start", "n", "bin", "offset")


def pack(docs: DataFrame, capacity: int = CAPACITY, max_per_source: int = MAX_PER_SOURCE, cluster: str | None = None, text: str = "text", source: str = "source", group_pieces: int = GROUP_PIECES, seed: int = 1) -> DataFrame:
    """The pieces of docs with their bins: doc_id, source, piece (int, from 0), start and n (long, words), text, bin (long), offset (long).

    A text longer than capacity is cut into pieces of that length and a rest. No bin holds over capacity words, two pieces
    of one cluster (the column named, else equal words whatever their case) or over max_per_source pieces of one source.
    Null and empty texts give one row with n 0 and no bin. A null source is a source, a null cluster has no duplicate,
    repeated rows are packed each for itself. Bins are numbered group by group. Other columns of docs are left out,
    whatever they are called. Bins are found for numbers alone; the texts are joined and cut afterwards.
    """
    rows, at = set_aside(docs, "doc_id", text, source, *([cluster] if cluster else []))
    names = at["doc_id"], at[text], at[source], at.get(cluster)
    placed = _plan(rows, *names, capacity, max_per_source, group_pieces, seed)
    per = placed.groupBy("_k1", "_k2", "copy").agg(F.first("doc_id").alias("doc_id"), F.first("source").alias("source"), F.collect_list(F.struct("piece", "start", "n", "bin", "offset")).alias("_p"))
    # One of the rows with a key has the text for all of them.
    own = rows.select(*_keys(*names), F.col(at[text]).alias("_text")).withColumn("_n", F.row_number().over(Window.partitionBy("_k1", "_k2").orderBy("_k1"))).filter("_n = 1").drop("_n")
    joined = own.join(per, ["_k1", "_k2"])
    held = r"regexp_extract_all(coalesce(_text, ''), '[^\\x20\\x09-\\x0D]+[\\x20\\x09-\\x0D]*', 0)"
    whole = "named_struct('piece', p.piece, 'start', p.start, 'n', p.n, 'text', array_join(slice(w, cast(p.start + 1 as int), cast(p.n as int)), ''), 'bin', p.bin, 'offset', p.offset)"
    out = joined.select("doc_id", "source", F.explode(F.expr(f"transform(array({held}), w -> transform(_p, p -> {whole}))[0]")).alias("x"))
    return out.select("doc_id", "source", "x.*")


def op3_packing(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return pack(docs)


QUERIES = {"op3_packing": op3_packing}
SQL = {}
