"""Runs of words that repeat with a period, found by internal pattern matching (operator 13).

A run of period q and at least 2q words holds, among its first q words, a dyadic block: 2**k words from a multiple of 2**k
on, with 2**(k + 1) <= q < 2**(k + 2); that block stands again q words on. So for every block the occurrences in the window
at these distances are asked for: blocks of 2**k words are classes of the suffix array, which prefix doubling gives for all
k, and a wavelet matrix over the suffix array enumerates an interval's values in a window by range successors. An occurrence
that goes on a progression of a smaller step around the block gives that step as its candidate, any other its distance. A
candidate is a run if it extends, left and right, to twice its period; the classes of all k answer how far it extends.

Only words inside stretches that stand twice in their document can be in a run, so the rest never enters the suffix array.
Documents are whole in a task, many of them in one suffix array, with separators between; nothing is shuffled.
"""

from __future__ import annotations

from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import own_names, restored, set_aside, words

#: Words of the documents that are searched together; a longer document is searched alone.
BATCH_WORDS = 200_000
#: Words of the shortest run.
LEAST = 12
_MUL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def repeated(ids: np.ndarray, doc: np.ndarray, half: int) -> np.ndarray:
    """Whether each word is in a stretch of half words that stands twice or more in its document. (Hashes decide, which may only add words.)"""
    out = np.zeros(len(ids) + 1, np.int32)
    n = len(ids) - half + 1
    if n <= 0:
        return np.zeros(len(ids), bool)
    key = doc[:n].astype(np.uint64) * _MUL[0]
    for k in range(half):
        key = (key ^ ids[k : k + n].astype(np.uint64)) * _MUL[1]
        key ^= key >> np.uint64(29)
    inside = np.flatnonzero(doc[:n] == doc[half - 1 :])
    key = key[inside]
    by_size = np.sort(key)
    twice = np.unique(by_size[1:][by_size[1:] == by_size[:-1]])
    if not len(twice):
        return np.zeros(len(ids), bool)
    at = inside[twice[np.minimum(np.searchsorted(twice, key), len(twice) - 1)] == key]
    np.add.at(out, at, 1)
    np.add.at(out, at + half, -1)
    return np.cumsum(out[:-1]) > 0


def factors(seq: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(for k = 0, 1, ...: for each place the first index, in the suffix array, of the suffixes that begin with its 2**k symbols; the suffix array).

    The last symbol, and others, must be unique, so that suffixes differ before their end.
    """
    n = len(seq)
    key, levels = seq.astype(np.int64), []
    while True:
        order = np.argsort(key, kind="stable")
        by_size = key[order]
        new = np.r_[True, by_size[1:] != by_size[:-1]]
        first = np.empty(n, np.int64)
        first[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        levels.append(first)
        if new.all():
            return levels, order
        step = 1 << (len(levels) - 1)
        key = first * (n + 1)
        key[: n - step] += first[step:] + 1


class Wavelet:
    """A wavelet matrix over numbers: in any interval, how many are below a bound, and the k-th smallest; many intervals at once."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max(initial=0) + 1).bit_length())
        self.ones, self.zeros = [], []
        for b in reversed(range(self.bits)):
            one = (values >> b) & 1
            self.ones.append(np.r_[0, np.cumsum(one)])
            self.zeros.append(len(values) - int(self.ones[-1][-1]))
            values = np.concatenate([values[one == 0], values[one == 1]])

    def below(self, left: np.ndarray, right: np.ndarray, bound: np.ndarray) -> np.ndarray:
        out = np.zeros_like(left)
        for level, b in enumerate(reversed(range(self.bits))):
            ones, up = self.ones[level], ((bound >> b) & 1).astype(bool)
            a, z = ones[left], ones[right]
            out += np.where(up, (right - z) - (left - a), 0)
            left, right = np.where(up, self.zeros[level] + a, left - a), np.where(up, self.zeros[level] + z, right - z)
        return out

    def smallest(self, left: np.ndarray, right: np.ndarray, k: np.ndarray) -> np.ndarray:
        out, k = np.zeros_like(left), k.copy()
        for level, b in enumerate(reversed(range(self.bits))):
            ones = self.ones[level]
            a, z = ones[left], ones[right]
            low = (right - z) - (left - a)
            up = k >= low
            out |= up.astype(np.int64) << b
            k -= np.where(up, low, 0)
            left, right = np.where(up, self.zeros[level] + a, left - a), np.where(up, self.zeros[level] + z, right - z)
        return out

    def between(self, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, value) for all values of low <= value < high in each query's interval, ascending: range successors from low on."""
        first = self.below(left, right, low)
        many = self.below(left, right, high) - first
        query = np.repeat(np.arange(len(left)), many)
        k = np.arange(len(query)) - np.repeat(np.cumsum(many) - many, many) + first[query]
        return query, self.smallest(left[query], right[query], k)


def _forward(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Equal symbols from places i and j (i < j) on."""
    out = np.zeros_like(i)
    for k in reversed(range(len(levels) - 1)):
        out += (levels[k][i + out] == levels[k][j + out]).astype(np.int64) << k
    return out


def _backward(levels: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Equal symbols before places i and j (i < j)."""
    out = np.zeros_like(i)
    for k in reversed(range(len(levels) - 1)):
        at = i - out - (1 << k)
        there = at >= 0
        same = levels[k][np.where(there, at, 0)] == levels[k][np.where(there, j - out - (1 << k), 0)]
        out += (same & there).astype(np.int64) << k
    return out


def runs_of(seq: np.ndarray, end: np.ndarray, least: int = LEAST) -> np.ndarray:
    """(start, end, period) of the runs of seq, by start and end. end: for each place the end of its stretch, where a unique symbol stands."""
    levels, suffixes = factors(seq)
    places = Wavelet(suffixes)
    n, found = len(seq), []
    for k in range(len(levels) - 1):
        size, near = 1 << k, 2 << k if k else 1
        if near >= n:
            break
        many = np.bincount(levels[k], minlength=n)
        block = np.arange(0, n, size)
        left = levels[k][block]
        high = np.minimum(block + (4 << k), end[block] - size + 1)
        some = (many[left] > 1) & (block + near < high)
        block, left, high = block[some], left[some], high[some]
        query, at = places.between(left, left + many[left], block + near, high)
        block = block[query]
        # The step from the occurrence before: if all from the block to here goes on with it, it is the period to look at.
        step = np.r_[0, np.where(query[1:] == query[:-1], at[1:] - at[:-1], 0)] if len(at) else at
        small = np.flatnonzero((step > 0) & (step <= size))
        period = at - block
        same = _forward(levels, block[small], block[small] + step[small]) >= at[small] + size - step[small] - block[small]
        period[small[same]] = step[small[same]]
        block, period = np.unique(np.stack([block, period]), axis=1) if len(block) else (block, period)
        stop = block + period + _forward(levels, block, block + period)
        start = block - _backward(levels, block, block + period)
        good = stop - start >= np.maximum(least, 2 * period)
        found.append(np.stack([start, stop, period])[:, good])
    if not found:
        return np.zeros((0, 3), np.int64)
    every = np.concatenate(found, axis=1)
    every = every[:, np.lexsort((every[2], every[1], every[0]))]
    new = np.r_[True, (every[0][1:] != every[0][:-1]) | (every[1][1:] != every[1][:-1])] if every.shape[1] else np.zeros(0, bool)
    return every[:, new].T


def search(texts: list[list[bytes]], least: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """((document, start, length, period) of all runs by document, start and period; for each word of all documents whether it is kept)."""
    sizes = np.array([len(t) for t in texts], np.int64)
    total, half = int(sizes.sum()), (least + 1) // 2
    keep = np.ones(total, bool)
    none = np.zeros((0, 4), np.int64)
    if not total:
        return none, keep
    number = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(texts)))}
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, total)
    doc = np.repeat(np.arange(len(texts)), sizes)
    inside = repeated(ids, doc, half)
    # Stretches: words inside, side by side, of one document.
    edge = np.flatnonzero(np.r_[True, (inside[1:] != inside[:-1]) | (doc[1:] != doc[:-1])])
    stop = np.r_[edge[1:], total]
    some = inside[edge] & (stop - edge >= least)
    edge, stop = edge[some], stop[some]
    if not len(edge):
        return none, keep
    size = stop - edge + 1
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum())) - np.repeat(first, size) + np.repeat(edge, size)
    last = first + size - 1
    seq = ids[np.minimum(at, total - 1)]
    seq[last] = len(number) + np.arange(len(edge))
    runs = runs_of(seq, np.repeat(last, size), least)
    begin = at[runs[:, 0]]
    length = runs[:, 1] - runs[:, 0]
    drop = np.zeros(total + 1, np.int64)
    np.add.at(drop, begin + runs[:, 2], 1)
    np.add.at(drop, begin + length, -1)
    keep = np.cumsum(drop[:-1]) == 0
    before = np.cumsum(sizes) - sizes
    out = np.stack([doc[begin], begin - before[doc[begin]], length, runs[:, 2]], axis=1) if len(runs) else none
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))], keep


def find_runs(docs: DataFrame, text: str = "text", least: int = LEAST, batch_words: int = BATCH_WORDS) -> DataFrame:
    """docs with runs (array of struct(start, length, period), long, by start and period) and collapsed (the words that are kept, one space between).

    Words are runs of anything but the six ASCII blanks, compared as they are. A run is a stretch of least words or more,
    and of twice its smallest period or more, that no neighbouring word extends. A word is dropped if some run contains it
    after that run's first period. A null or blank text has no runs and an empty collapsed. Columns of docs called runs or
    collapsed are replaced, all others are passed on, as are repeated rows.
    """
    own_names(docs, text)
    held, at = set_aside(docs, text)
    source = list(at.values()).index(at[text])
    schema = ", ".join(f"`{n}` {kind}" for n, kind in held.dtypes)

    def run(batches):
        for batch in batches:
            column = batch.column(source).cast(pa.large_binary())
            row, n = 0, batch.num_rows
            while row < n:
                texts, total, begin = [], 0, row
                while row < n and (total < batch_words or row == begin):
                    texts.append((column[row].as_py() or b"").split())
                    total += len(texts[-1])
                    row += 1
                runs, keep = search(texts, least)
                collapsed, done = [], 0
                for t in texts:
                    mine = keep[done : done + len(t)]
                    collapsed.append(b" ".join(t if mine.all() else compress(t, mine.tolist())))
                    done += len(t)
                offsets = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1)).astype(np.int32)
                values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(runs[:, i])) for i in (1, 2, 3)], fields=list(_RUN))
                extra = pa.ListArray.from_arrays(pa.array(offsets), values), pa.array(collapsed, pa.binary()).cast(pa.string())
                yield pa.record_batch([*batch.slice(begin, row - begin).columns, *extra], names=[*batch.schema.names, "runs", "collapsed"])

    out = held.mapInArrow(run, f"{schema}, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    return out.select(*restored(out, at, ("runs", "collapsed")), "runs", "collapsed")


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text: one document in ten, by the CRC of its id, ends in a repetition of the words from some word on, as the query says; the others, and those with a null id, are as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    marked = docs.select("doc_id", "text", F.floor(h / 10).cast("long").alias("_g"), F.when(h % 10 == 0, words(F.col("text"))).alias("_w"))
    placed = marked.withColumns({"_a": F.expr("if(size(_w) > 0, _g % size(_w), null)"), "_n": F.size("_w").cast("long")}).withColumn("_p", F.expr("1 + (_n - _a) div (3 + _g % 8)"))
    again = F.expr("array_join(transform(_w, (x, i) -> if(i < _a, x, _w[cast(_a + (i - _a) % _p as int)])), ' ')")
    return placed.select("doc_id", F.when(F.col("_a").isNotNull(), again).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """What the query returns of documents with runs and collapsed."""
    longest = F.get(F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], y["length"] - x["length"]).when(x["start"] != y["start"], x["start"] - y["start"]).otherwise(x["period"] - y["period"]).cast("int")), F.lit(0))
    listed = F.concat_ws("", F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n")))))
    out = found.withColumn("_l", longest)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_l.start", "_l.length", "_l.period", F.expr("1000 * _l.length div _l.period").alias("exponent_milli"),
        F.sha2(F.encode(listed, "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


def op13_periodic_runs(spark, sf_dir):
    return digests(find_runs(planted(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))))


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
SQL = {}
