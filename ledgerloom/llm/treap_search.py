"""Ranked lexical search by K2-treaps over the grid of terms and documents (operator 11).

The documents of a block are the columns of a grid, ordered by id, its terms the rows, frequent ones first and like ones side
by side. A cell's impact is what one occurrence-weighted term adds to the document's score before the term's weight. The grid
is a quadtree of which only occupied quarters are kept, level by level: four bits for each node say which of its quarters
are occupied, and a byte holds the largest impact below it, rounded up; leaves hold the exact number of occurrences. An
item's terms are paths to their rows. All of them descend together over ranges of documents: the weighted sum of the maxima
on the paths bounds every score in the range, the best bound is opened first, and what can't reach the item's ten best, those
of earlier blocks in the task among them, is never opened. Within a block ranges come out in the order of the result, so
this is exact.

The index is a table of blocks, of all terms and all documents, written once in the shared folder. Weights come with the query:
the documents that hold a term are counted in the blocks' directories. Nothing but counts and best lists is shuffled.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, own_names, own_path
from .ngram_join import buffers, word_hashes

#: Documents and cells after which a block is closed; bytes of text that are hashed at once.
BLOCK_DOCS, BLOCK_CELLS, CHUNK_BYTES = 8192, 700_000, 250_000
#: Terms of items that every task gets at once; more items go in turns.
QUERY_TERMS = 200_000
BEST = 10
#: A row is 2**STRETCH wide, so that a quarter spans fewer terms than documents and its maximum is closer to each term's own.
STRETCH = 2
#: Ranges of documents that each item opens in a round.
TURN = 8
#: Maxima are stored as so many units of impact, rounded up; impacts are below 1,000,000, so a byte holds them.
UNIT = 4096
_POP = np.array([bin(i).count("1") for i in range(16)], np.int64)
#: Bytes that part terms: all below 0x80 but digits and letters.
GAP = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_BLANKED = np.where(GAP, 32, np.arange(256)).astype(np.uint8)
_BLOCK = "doc_ids array<bigint>, norms array<bigint>, terms binary, places binary, holders binary, quarters array<binary>, maxima array<binary>, counts binary"


def pieces(column: pa.Array, limit: int = CHUNK_BYTES, docs: int = BLOCK_DOCS):
    """(first document, bytes, offsets, whether the last document ends there) of runs of the column's texts of about limit bytes and so many documents at most; a long text is cut between terms."""
    data, off = buffers(column)
    at, n = 0, len(off) - 1
    i = 0
    while i < n:
        # What is left of a cut text comes alone.
        stop = min(at + limit, int(off[min(i + docs, n)] if at == off[i] else off[i + 1]))
        ends = int(np.searchsorted(off, stop, "right")) - 1
        ends = ends if at == off[i] else min(ends, i + 1)
        if ends > i:
            stop, j = int(off[ends]), ends
        else:
            part = np.flatnonzero(GAP[data[at:stop]])
            if not len(part) and stop < off[i + 1]:
                more = np.flatnonzero(GAP[data[stop : off[i + 1]]])
                stop = stop + int(more[0]) + 1 if len(more) else int(off[i + 1])
            elif stop < off[i + 1]:
                stop = at + int(part[-1]) + 1
            j = i + 1
        yield i, data[at:stop], np.clip(off[i : j + 1], at, stop) - at, stop == off[j]
        at, i = stop, j if stop == off[j] else i


def spread(x: np.ndarray) -> np.ndarray:
    """The bits of x (below 2**31) at the even places."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


def narrow(x: np.ndarray) -> bytes:
    """x, not negative, in as few bytes a number as the largest needs, after that number of bytes."""
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if x.max(initial=0) <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def impact(tf: np.ndarray, norm: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * norm)


def treap(row: np.ndarray, col: np.ndarray, value: np.ndarray) -> tuple[list[bytes], list[bytes], np.ndarray]:
    """(quarters, maxima of each level from the root on, the order of the cells as leaves) of distinct cells."""
    depth = max(1, int(row.max()).bit_length(), int(col.max()).bit_length())
    code = (spread(row) << np.uint64(1)) | spread(col)
    order = np.argsort(code)
    code, value = code[order], value[order]
    quarters, maxima = [], []
    for _ in range(depth):
        up = code >> np.uint64(2)
        first = np.flatnonzero(np.r_[True, up[1:] != up[:-1]])
        bits = np.bitwise_or.reduceat(np.uint8(1) << (code & np.uint64(3)).astype(np.uint8), first)
        code, value = up[first], np.maximum.reduceat(value, first)
        bits = np.r_[bits, np.zeros(len(bits) % 2, np.uint8)]
        quarters.append((bits[::2] | bits[1::2] << 4).tobytes())
        maxima.append((-(-value // UNIT)).astype(np.uint8).tobytes())
    return quarters[::-1], maxima[::-1], order


class Treap:
    """A block as it is searched: the nodes of all levels in one row, the root first and the leaves last."""

    def __init__(self, block: dict):
        self.ids = block["doc_ids"]
        self.terms, self.places = np.frombuffer(block["terms"], np.uint64), wide(block["places"])
        self.depth = len(block["quarters"])
        quarters, code, base, firsts = [], np.zeros(1, np.int64), 0, []
        for packed, most in zip(block["quarters"], block["maxima"], strict=True):
            p = np.frombuffer(packed, np.uint8)
            q = np.stack([p & 15, p >> 4], axis=1).reshape(-1)[: len(most)]
            quarters.append(q)
            base += len(q)
            firsts.append(base + np.cumsum(_POP[q]) - _POP[q])
            node, quarter = np.nonzero((q[:, None] >> np.arange(4, dtype=np.uint8)) & 1)
            code = code[node] << 1 | quarter & 1  # the column's bits
        self.quarters, self.first = np.concatenate(quarters), np.concatenate(firsts)
        self.leaf = base
        exact = impact(wide(block["counts"]), np.array(block["norms"], np.int64)[code])
        self.value = np.concatenate([np.frombuffer(b"".join(block["maxima"]), np.uint8).astype(np.int64) * UNIT, exact])

    def rows(self, terms: np.ndarray) -> np.ndarray:
        """The rows of terms, -1 for those that are not here."""
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return np.where(self.terms[at] == terms, self.places[at], -1)

    def best(self, asked: list[tuple[np.ndarray, np.ndarray]], best: list[list[tuple]], n: int = BEST, turn: int = TURN) -> None:
        """Put the documents of highest weighted sums into best, for each item a heap of (score, *order_of(id), id) that keeps the n best. asked: rows and weights of each item.

        An item's ranges lie in a heap by bound and first document. In each round all items open their turn best ranges
        together; an item is done when its best bound can't reach its n-th score.
        """
        rows, weights = np.concatenate([r for r, _ in asked]), np.concatenate([w for _, w in asked])
        begin = np.cumsum([0, *(len(r) for r, _ in asked)])
        heaps = [[(-int((w * self.value[0]).sum()), 0, self.depth, np.zeros(len(r), np.int64), np.arange(a, a + len(r)))] if len(r) else [] for (r, w), a in zip(asked, begin[:-1], strict=True)]
        least = np.zeros(len(asked), np.int64)
        going = [i for i, h in enumerate(heaps) if h]
        while going:
            items, cols, shifts, nodes, slots = [], [], [], [], []
            for i in going:
                heap, found, opened = heaps[i], best[i], 0
                while heap and opened < turn:
                    low, col, shift, node, slot = heapq.heappop(heap)
                    if len(found) == n and (-low, *order_of(self.ids[col])) <= found[0][:3]:
                        if -low < found[0][0]:
                            heap.clear()
                    elif shift == 0:
                        entry = (-low, *order_of(self.ids[col]), self.ids[col])
                        heapq.heappush(found, entry) if len(found) < n else heapq.heappushpop(found, entry)
                    else:
                        opened += 1
                        items.append(i)
                        cols.append(col)
                        shifts.append(shift - 1)
                        nodes.append(node)
                        slots.append(slot)
                if len(found) == n:
                    least[i] = found[0][0]
            if items:
                self._open(heaps, least, np.array(items), np.array(cols), np.array(shifts), nodes, slots, rows, weights)
            going = [i for i in going if heaps[i]]

    def _open(self, heaps, least, item, col, shift, nodes, slots, rows, weights) -> None:
        """Push both halves of the ranges (item, first column, shift of the half's bit, nodes of the terms that occur there, their slots) as far as they may still count."""
        range_ = np.repeat(np.arange(len(item)), [len(x) for x in nodes])
        node, slot = np.concatenate(nodes), np.concatenate(slots)
        bits, high = self.quarters[node].astype(np.int64), (rows[slot] >> shift[range_]) & 1
        for side in (0, 1):
            at = 2 * high + side
            here = np.flatnonzero((bits >> at) & 1)
            if not len(here):
                continue
            child = self.first[node[here]] + _POP[bits[here] & ((1 << at[here]) - 1)]
            mine, of = slot[here], range_[here]
            start = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            bound = np.add.reduceat(weights[mine] * self.value[child], start)
            one = of[start]
            some = np.flatnonzero((bound > 0) & (bound >= least[item[one]]))
            stop = np.r_[start[1:], len(of)][some].tolist()
            one = one[some]
            first = (col[one] | side << shift[one]).tolist()
            for i, b, c, s, a, z in zip(item[one].tolist(), bound[some].tolist(), first, shift[one].tolist(), start[some].tolist(), stop, strict=True):
                heapq.heappush(heaps[i], (-b, c, s, child[a:z], mine[a:z]))


def order_of(doc_id: int | None) -> tuple[int, int]:
    """Larger for ids that come first among equal scores: small ones, null last."""
    return (0, 0) if doc_id is None else (1, -doc_id)


def totals(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """(documents with a term, terms with repeats)."""

    def run(batches):
        for batch in batches:
            has, terms, open_ = 0, 0, 0
            for _, data, off, done in pieces(batch.column(0)):
                inside = ~GAP[data]
                starts = inside & np.r_[True, ~inside[:-1]] if len(data) else inside
                starts[off[(off < len(data))]] = inside[off[off < len(data)]]
                before = np.r_[0, np.cumsum(starts)]
                each = np.diff(before[off])
                each[0] += open_
                open_ = 0 if done else int(each[-1])
                each = each if done else each[:-1]
                has, terms = has + int((each > 0).sum()), terms + int(each.sum())
            yield pa.record_batch([pa.array([has]), pa.array([terms])], names=["docs", "terms"])

    row = docs.select(text).mapInArrow(run, "docs bigint, terms bigint").agg(F.sum("docs"), F.sum("terms")).first()
    return int(row[0] or 0), int(row[1] or 0)


def build(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", block_docs: int = BLOCK_DOCS, block_cells: int = BLOCK_CELLS) -> tuple[int, int]:
    """Write the index of docs to path, a table of blocks, and return ``totals``. Every document is in it, those without terms aside, which no search finds."""
    own_names(docs, doc_id, text)
    n_docs, n_terms = totals(docs, text)

    def block(ids: list, parts: list[tuple]):
        doc, term, tf = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = sorted(range(len(ids)), key=lambda i: tuple(-x for x in order_of(ids[i])))
        col_of = np.empty(len(ids), np.int64)
        col_of[order] = np.arange(len(ids))
        terms, row = np.unique(term, return_inverse=True)
        # A long text comes in pieces, so a cell may.
        cells, cell = np.unique(col_of[doc] * len(terms) + row, return_inverse=True)
        tf = np.bincount(cell, tf).astype(np.int64)
        col, row = cells // len(terms), cells % len(terms)
        size = np.bincount(col, tf, len(ids)).astype(np.int64)
        norms = np.array([100 - 90 + 90 * int(n) * n_docs // n_terms for n in size], np.int64)
        holders = np.bincount(row)
        first = np.full(len(terms), len(ids))
        np.minimum.at(first, row, col)
        places = np.empty(len(terms), np.int64)
        places[np.lexsort((first, -holders))] = np.arange(len(terms)) << STRETCH
        quarters, maxima, leaf = treap(places[row], col, impact(tf, norms[col]))
        made = {"doc_ids": [ids[i] for i in order], "norms": norms.tolist(), "terms": terms.tobytes(), "places": narrow(places), "holders": narrow(holders), "quarters": quarters, "maxima": maxima, "counts": narrow(tf[leaf])}
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.binary()]
        return pa.record_batch([pa.array([v], k) for v, k in zip(made.values(), kinds, strict=True)], names=list(made))

    def run(batches):
        ids, parts, cells, open_, base = [], [], 0, False, 0
        for batch in batches:
            every = batch.column(0).to_pylist()
            for first, data, off, done in pieces(batch.column(1), docs=block_docs):
                h, count = word_hashes(_BLANKED[data], off)
                if not open_:
                    base = len(ids)
                    ids += every[first : first + len(off) - 1]
                open_ = not done
                doc = np.repeat(np.arange(base, base + len(count)), count)
                terms, row = np.unique(h, return_inverse=True)
                if len(terms):
                    key, tf = np.unique(doc * len(terms) + row, return_counts=True)
                    parts.append((key // len(terms), terms[key % len(terms)], tf))
                    cells += len(key)
                if done and (len(ids) >= block_docs or cells >= block_cells):
                    if cells:
                        yield block(ids, parts)
                    ids, parts, cells = [], [], 0
        if parts:
            yield block(ids, parts)

    docs.select(F.col(doc_id).cast("long"), text).mapInArrow(run, _BLOCK).write.option("compression", "zstd").parquet(path)
    return n_docs, n_terms


def item_terms(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, term: the distinct terms of items, as hashes."""

    def run(batches):
        for batch in batches:
            at = []
            for first, data, off, _ in pieces(batch.column(1)):
                h, count = word_hashes(_BLANKED[data], off)
                at.append((np.repeat(np.arange(first, first + len(count)), count), h))
            if at:
                doc, h = (np.concatenate(x) for x in zip(*at, strict=True))
                yield pa.record_batch([batch.column(0).take(pa.array(doc)), pa.array(h.view(np.int64))], names=["item_id", "term"])

    kind = dict(items.dtypes)[item_id]
    return items.select(item_id, text).mapInArrow(run, f"item_id {kind}, term bigint").distinct()


def search(spark, path: str, totals_: tuple[int, int], items: DataFrame, item_id: str = "item_id", text: str = "text", n: int = BEST, query_terms: int = QUERY_TERMS) -> DataFrame:
    """item_id, rank, doc_id, score: for each item the n documents of the index at path with the highest scores above 0, equal ones by id.

    A term's weight is floor(1000 ln((2 N + 2) / (2 df + 1))); a score sums weight times impact over the item's distinct
    terms. Rows of items that share an item_id are one item, null ids too; an item without terms has no result. Equal ids
    of documents are documents of their own; null ids come last among equal scores. Items are a query set: their terms are
    sent to every task, query_terms of them at a time.
    """
    own_names(items, item_id, text)
    blocks = spark.read.parquet(path)
    asked = cut(item_terms(items, item_id, text))
    kind = dict(asked.dtypes)["item_id"]
    turns = max(1, -(-asked.count() // query_terms))
    out = None
    for turn in range(turns):
        mine = asked if turns == 1 else asked.filter(F.pmod(F.xxhash64("item_id"), F.lit(turns)) == turn)
        wanted = np.array([r[0] for r in mine.select("term").distinct().sort("term").collect()], np.int64)

        def count(batches, wanted=wanted):
            look = np.sort(wanted.view(np.uint64))
            df = np.zeros(len(look), np.int64)
            for batch in batches:
                for terms, holders in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    terms = np.frombuffer(terms, np.uint64)
                    at = np.minimum(np.searchsorted(terms, look), len(terms) - 1)
                    df += np.where(terms[at] == look, wide(holders)[at], 0)
            yield pa.record_batch([pa.array(look[df > 0].view(np.int64)), pa.array(df[df > 0])], names=["term", "df"])

        held = blocks.select("terms", "holders").mapInArrow(count, "term bigint, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
        weight = F.floor(1000 * F.ln((2.0 * totals_[0] + 2) / (2.0 * F.col("df") + 1))).cast("long")
        weighed = mine.join(held, "term").select("item_id", "term", weight.alias("w")).filter("w > 0")
        listed = [(r.item_id, np.array([x.term for x in r.t], np.int64).view(np.uint64), np.array([x.w for x in r.t], np.int64)) for r in weighed.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("term", "w"))).alias("t")).collect()]

        def look(batches, listed=listed):
            best = [[] for _ in listed]
            if not listed:
                return
            for batch in batches:
                for at in range(batch.num_rows):
                    one = Treap(batch.slice(at, 1).to_pylist()[0])
                    rows = [one.rows(terms) for _, terms, _ in listed]
                    one.best([(r[r >= 0], w[r >= 0]) for r, (_, _, w) in zip(rows, listed, strict=True)], best, n)
            at = [(i, *x) for i, found in enumerate(best) for x in found]
            yield pa.record_batch([pa.array([i for i, *_ in at], pa.int64()), pa.array([x[4] for x in at], pa.int64()), pa.array([x[1] for x in at], pa.int64())], names=["at", "doc_id", "score"])

        columns = ("doc_ids", "norms", "terms", "places", "quarters", "maxima", "counts")
        got = blocks.select(*columns).mapInArrow(look, "at bigint, doc_id bigint, score bigint")
        w = Window.partitionBy("at").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        names = spark.createDataFrame([(i, x[0]) for i, x in enumerate(listed)], f"at bigint, item_id {kind}")
        got = got.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n).join(F.broadcast(names), "at").select("item_id", "rank", "doc_id", "score")
        out = got if out is None else out.unionByName(got)
    return out


def op11_ranked_search(spark, sf_dir):
    path = own_path(spark, "treaps")
    held = build(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), path)
    return search(spark, path, held, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {"op11_ranked_search": op11_ranked_search}
_TERMS = "unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
SQL = {
    "op11_ranked_search": f"""with t as (select doc_id, {_TERMS} as term from documents), f as (select doc_id, term, count(*) as tf from t group by 1, 2),
d as (select doc_id, sum(tf)::bigint as n from f group by 1), c as (select count(*)::bigint as nn, sum(n)::bigint as ll from d),
q as (select distinct item_id, {_TERMS} as term from benchmark),
w as (select term, floor(1000 * ln((2.0::double * any_value(nn) + 2) / (2 * count(*) + 1)))::bigint as w from f, c where term in (select term from q) group by 1),
s as (select item_id, f.doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // ll))))::bigint as score from q join f using (term) join w using (term) join d on d.doc_id = f.doc_id, c group by 1, 2),
r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from s where score > 0) select * from r where rank <= 10"""
}
