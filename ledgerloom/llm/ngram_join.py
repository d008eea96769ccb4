"""Exact Jaccard self-join of word n-gram sets by signature trees (operator 7).

Who can be linked at all is found first, without sets leaving their task. Two sets with Jaccard t or more differ in few
members, so if their members are dealt by hash to more segments than that, some segment is the same in both; keys made of
whole segments bring every possible partner together (after Arasu et al., 2006), common ones where they are needed for
that, and chains of shared keys inside one class of sizes form candidate groups. In a group each document is a bitmap of
its members; a tree over them, ordered so that like documents stand together, holds at every node the OR and the AND of the bitmaps below and the range of sizes. The traversal of node pairs
drops a pair when even its largest possible overlap is too small, or when all below are linked already; what is left is
compared in full. Groups over the block size are split into blocks, and pairs of blocks are traversed by different tasks.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, own_names
from .graph import components

#: Documents of a group that one task holds, and members of their sets.
BLOCK_DOCS = 1024
BLOCK_MEMBERS = 2_000_000
FANOUT = 8
#: A key in as many documents is common, and left out where a document can spare it; the share of keys to spare, about.
COMMON, SPARE = 16, 0.12
#: Bytes of text that are hashed at once, which takes about 100 times as much memory.
CHUNK_BYTES = 500_000
#: Documents of candidate groups whose ids are sent to every task, so that no other text is shuffled; more are joined.
BROADCAST_ROWS = 100_000
_MUL = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]
_INVERSE = np.uint64(pow(0x100000001B3, -1, 2**64))
_BASE = np.uint64(0x100000001B3)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _MUL[1]
    x = (x ^ (x >> np.uint64(27))) * _MUL[2]
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of texts laid end to end (UTF-8 bytes, A-Z lower-cased) and the number of words in each.

    A word's hash is a polynomial of its bytes, read off running sums, so no word is handled alone.
    """
    blank = (data == 32) | ((data >= 9) & (data <= 13))
    upper = (data >= 65) & (data <= 90)
    byte = mixed((data + 32 * upper).astype(np.uint64) + _MUL[0])
    n = len(data)
    inside = ~blank
    cut_at = np.zeros(n + 1, bool)
    cut_at[offsets] = True
    before = np.r_[False, inside[:-1]] if n else inside
    starts = np.flatnonzero(inside & (~before | cut_at[:n]))
    after = np.r_[inside[1:], False] if n else inside
    ends = np.flatnonzero(inside & (~after | cut_at[1:])) + 1
    power = np.full(n, _BASE)
    if n:
        power[0] = 1
    power = np.multiply.accumulate(power)
    run = np.r_[np.uint64(0), np.add.accumulate(byte * power)]
    # Dividing by the power at the word's start (an odd number has an inverse) leaves a hash of the word alone.
    back = np.full(n, _INVERSE)
    if n:
        back[0] = 1
    back = np.multiply.accumulate(back)
    h = mixed((run[ends] - run[starts]) * back[starts] + (ends - starts).astype(np.uint64) * _MUL[0])
    count = np.searchsorted(starts, offsets[1:]) - np.searchsorted(starts, offsets[:-1])
    return h, count


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(members, bounds): document i has the distinct sorted hashes members[bounds[i]:bounds[i + 1]].

    A document of fewer than n words, but some, has one member for all of them.
    """
    h, words = word_hashes(data, offsets)
    first = np.r_[0, np.cumsum(words)]
    each = np.where(words == 0, 0, np.maximum(words - n + 1, 1))
    doc = np.repeat(np.arange(len(words)), each)
    at = first[doc] + np.arange(len(doc)) - np.repeat(np.r_[0, np.cumsum(each)][:-1], each)
    span = np.minimum(words[doc], n)
    g = span.astype(np.uint64)
    for k in range(n):
        has = k < span
        g = mixed(g * _MUL[0] + np.where(has, h[np.minimum(at + k, max(len(h) - 1, 0))], np.uint64(0))) if len(h) else g
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.r_[True, (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])] if len(g) else np.zeros(0, bool)
    g, doc = g[new], doc[new]
    return g, np.searchsorted(doc, np.arange(len(words) + 1))


def buffers(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    import pyarrow.compute as pc

    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = pc.fill_null(a.cast(pa.large_string()), "")
    off = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8) if a.buffers()[2] else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def chunks(column: pa.ChunkedArray | pa.Array, n: int, limit: int = CHUNK_BYTES):
    """(first, members, bounds) of the sets of a column's texts, a run of texts at a time: as many as have limit bytes, or one."""
    data, off = buffers(column)
    at = 0
    while at < len(off) - 1:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield at, *shingle_sets(data[off[at] : off[to]], off[at : to + 1] - off[at], n)
        at = to


def size_class(n: np.ndarray, growth: float) -> np.ndarray:
    """Number c of each size's class: class_start(c) is its least size."""
    c = np.floor(np.log(np.maximum(n, 1)) / np.log(growth)).astype(np.int64)
    return c + (class_start(c + 1, growth) <= n) - (class_start(c, growth) > n)


def class_start(c: np.ndarray, growth: float) -> np.ndarray:
    return np.ceil(growth ** np.asarray(c, np.float64)).astype(np.int64)


def most_apart(sizes: np.ndarray, t: Fraction) -> np.ndarray:
    """Most members by which two sets whose sizes sum to sizes may differ at Jaccard t: (1 - t) / (1 + t) of the sum."""
    p, q = t.numerator, t.denominator
    return (q - p) * sizes // (q + p)


def plan_keys(t: Fraction) -> tuple[float, float]:
    """(growth of the size classes, segments for each member that may differ): the fewest keys with room to spare.

    Members of a segment are about Poisson; in the smallest sets of a class, the share of empty segments must leave a
    share SPARE that can be left out as common. Growth is 1 / t at least, so that a set's partners lie in its class and
    the next. Only the number of keys hangs on this choice, not what is found.
    """
    c = float(2 * (1 - t) / (1 + t))
    best = None
    for growth in (g for g in (1.0 / float(t) * 1.0001, 1.3, 1.4, 1.5, 1.75, 2.0) if g * float(t) >= 1):
        for more in np.arange(1.05, 2.5, 0.05):
            empty = np.exp(-1 / (more * c * growth)) if c else 0.0
            if 1 - 1 / more - empty >= SPARE:
                both = min(1.0, -np.log(float(t)) / np.log(growth))
                count = more * c * growth * (1 + both * growth) * (1 - empty) / ((growth - 1) / np.log(growth))
                if best is None or count < best[0]:
                    best = count, growth, float(more)
    return best[1:] if best else (1.0 / float(t) * 1.0001, 1.5)


def keys(members: np.ndarray, bounds: np.ndarray, t: Fraction, growth: float, more: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, key, spare) rows: any two sets with Jaccard t or more have a key in common, even if each leaves out spare of its own.

    A class of sizes has one number of segments, more than its largest pairs can differ in; growth and more as of plan_keys.
    A document enters its own class, and the next one too if a larger set there could still be its partner. Of two partners'
    segments, more agree than either may leave out. Empty segments are left out if so many can be spared, and spare, twice
    the number that may still be left out plus 1 for the next class, counts down from there. An agreeing segment has one
    key in both, so if both leave out by the key alone, what one keeps is there in the other.
    """
    n = np.diff(bounds)
    out_doc, out_key, out_spare = [], [], []
    cls = size_class(n, growth)
    over = class_start(cls + 1, growth)
    for shift in (0, 1):
        some = np.flatnonzero((n > 0) & ((shift == 0) | (t.numerator * over <= t.denominator * n)))
        if not len(some):
            continue
        c = cls[some] + shift
        # In class c the larger set has under class_start(c + 1) members and the smaller no more than that.
        apart = most_apart(2 * (class_start(c + 1, growth) - 1), t)
        k = np.maximum(apart + 1, np.ceil(more * (apart + (apart > 0)))).astype(np.int64)
        doc = np.repeat(np.arange(len(some)), n[some])
        src = members[np.repeat(bounds[some], n[some]) + np.arange(len(doc)) - np.repeat(np.r_[0, np.cumsum(n[some])][:-1], n[some])]
        seg = (mixed(src + _MUL[0]) % k[doc].astype(np.uint64)).astype(np.int64)
        base = np.r_[0, np.cumsum(k)]
        slot = base[doc] + seg
        total = np.zeros(base[-1], np.uint64)
        np.add.at(total, slot, mixed(src ^ _MUL[1]))
        count = np.bincount(slot, minlength=base[-1])
        owner = np.repeat(np.arange(len(some)), k)
        empty = np.bincount(owner[count < 1], minlength=len(some))
        left = k - apart - 1 - empty
        kept = (count > 0) | (left < 0)[owner]
        number = np.arange(base[-1]) - base[owner]
        key = mixed(mixed(total + _MUL[0] * count.astype(np.uint64)) + mixed(c[owner].astype(np.uint64) << np.uint64(32) | number.astype(np.uint64)))
        out_doc.append(some[owner[kept]])
        out_key.append(key[kept])
        out_spare.append((2 * np.maximum(left, 0) + shift)[owner[kept]])
    if not out_doc:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_doc), np.concatenate(out_key), np.concatenate(out_spare)


class Union:
    """Sets of numbers that merge; a root is its set's smallest."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def merge(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def width(sets: list[np.ndarray]) -> int:
    """Bits of the bitmaps of sets: a power of two, four times the largest set or more, as far as 65,536."""
    most = max((len(s) for s in sets), default=0)
    return min(1 << max(6, int(np.ceil(np.log2(4 * max(most, 1))))), 1 << 16)


class Tree:
    """Signature tree over sets: nodes hold OR and AND bitmaps, the range of sizes, children or a document.

    Trees that are joined with each other need the same bits, else a position means other members in each.
    """

    def __init__(self, sets: list[np.ndarray], names: list[int], bits: int):
        self.sets, self.bits = sets, bits
        self.names, self.nodes = names, []
        marks = []
        for s in sets:
            m = np.zeros(bits, bool)
            m[(s % np.uint64(bits)).astype(np.int64)] = True
            marks.append(int.from_bytes(np.packbits(m).tobytes(), "big"))
        # The least mixed members of like sets agree with high chance, and so do their sizes.
        order = sorted(range(len(sets)), key=lambda i: (tuple(np.sort(mixed(sets[i]))[:2].tolist()), len(sets[i]), names[i]))
        level = []
        for i in order:
            level.append(len(self.nodes))
            self.nodes.append((marks[i], marks[i], len(sets[i]), len(sets[i]), i, None))
        while len(level) > 1:
            above = []
            for at in range(0, len(level), FANOUT):
                kids = level[at : at + FANOUT]
                some = [self.nodes[k] for k in kids]
                any_, all_ = 0, -1
                for x in some:
                    any_ |= x[0]
                    all_ &= x[1]
                above.append(len(self.nodes))
                self.nodes.append((any_, all_, min(x[2] for x in some), max(x[3] for x in some), None, kids))
            level = above
        self.top = level[0] if level else None


def apart_least(a: tuple, b: tuple) -> int:
    """Members in which any set below a and any below b must differ at least: bits that all of one have and none of the other."""
    return (a[1] & ~b[0]).bit_count() + (b[1] & ~a[0]).bit_count()


def join_trees(left: Tree, right: Tree, union: Union, t: Fraction) -> int:
    """Merge in union the names of all sets of left and right (which may be one tree) with Jaccard t or more, as far as it takes to connect them; the number compared in full."""
    if left.bits != right.bits:
        raise ValueError(f"bitmaps of {left.bits} and {right.bits} bits")
    p, q = t.numerator, t.denominator
    full = 0
    if left.top is None or right.top is None:
        return 0
    stack = [(left.top, right.top)]
    one = {}

    def root_of(tree: Tree, node: int) -> int | None:
        """The root in which everything below the node is, if there is one. Merges only add to that."""
        x = tree.nodes[node]
        if x[4] is not None:
            return union.find(tree.names[x[4]])
        known = one.get((id(tree), node))
        if known is not None:
            return union.find(known)
        first = None
        for kid in x[5]:
            r = root_of(tree, kid)
            if r is None or (first is not None and r != first):
                return None
            first = r
        one[(id(tree), node)] = first
        return first

    while stack:
        i, j = stack.pop()
        a, b = left.nodes[i], right.nodes[j]
        if p * a[2] > q * b[3] or p * b[2] > q * a[3]:
            continue
        # Overlap is at most (|a| + |b| - apart) / 2, so Jaccard t needs apart <= (1 - t) / (1 + t) of the sizes' sum.
        if (q + p) * apart_least(a, b) > (q - p) * (a[3] + b[3]):
            continue
        same = left is right and i == j
        if a[4] is not None and b[4] is not None:
            if same:
                continue
            x, y = left.names[a[4]], right.names[b[4]]
            if union.find(x) == union.find(y):
                continue
            s, u = left.sets[a[4]], right.sets[b[4]]
            full += 1
            both = len(np.intersect1d(s, u, assume_unique=True))
            if q * both >= p * (len(s) + len(u) - both):
                union.merge(x, y)
            continue
        ra = root_of(left, i)
        if ra is not None and ra == root_of(right, j):
            continue
        if same:
            kids = a[5]
            # Near pairs last, so that they are taken first and the rest finds them linked.
            stack += [(kids[x], kids[y]) for y in range(len(kids)) for x in range(y)][::-1]
            stack += [(x, x) for x in kids if left.nodes[x][5]]
        elif b[4] is not None or (a[4] is None and a[3] >= b[3]):
            stack += [(k, j) for k in a[5]]
        else:
            stack += [(i, k) for k in b[5]]
    return full


def classes(docs: DataFrame, n: int = 3, threshold: Fraction = Fraction(9, 10), text: str = "text", doc_id: str = "doc_id", block_docs: int = BLOCK_DOCS, block_members: int = BLOCK_MEMBERS) -> DataFrame:
    """doc_id, n_shingles (long), component_id for each row of docs.

    A document's set: distinct n-word shingles of its whole text, A-Z lower-cased; of fewer words, all of them as one;
    without words, or null, the set is empty and links with nothing. Linked: Jaccard at or above threshold, compared as a
    fraction. component_id: the smallest doc_id reachable, itself included. Sets are compared by 64-bit hashes of their
    members. Equal sets are one from the start. Rows are told apart by doc_id: those that share one are linked with
    each other, and a row with a null doc_id has a null component_id and links nothing.
    """
    own_names(docs, doc_id, text)
    growth, more = plan_keys(threshold)
    named = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def signatures(batches):
        for batch in batches:
            every = batch.column(0).to_numpy(zero_copy_only=False)
            null = np.asarray(batch.column(0).is_null())
            for at, members, bounds in chunks(batch.column(1), n):
                size = np.diff(bounds)
                bad = null[at : at + len(size)]
                clean = np.where(bad, 0, every[at : at + len(size)]).astype(np.int64)
                h1, h2 = (np.r_[np.uint64(0), np.add.accumulate(mixed(members ^ m))] for m in _MUL[:2])
                h1, h2 = h1[bounds[1:]] - h1[bounds[:-1]], h2[bounds[1:]] - h2[bounds[:-1]]
                yield pa.record_batch([pa.array(np.zeros(len(size), np.int8)), pa.array(clean, mask=bad), pa.array(size), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64))], names=["kind", "a", "b", "h1", "h2"])
                # Of equal sets in the run one has keys: they have the same.
                twin = np.lexsort((np.arange(len(size)), h2, h1))
                lone = np.zeros(len(size), bool)
                lone[twin] = np.r_[True, (h1[twin][1:] != h1[twin][:-1]) | (h2[twin][1:] != h2[twin][:-1])] if len(size) else False
                doc, key, spare = keys(members, bounds, threshold, growth, more)
                there = (lone if not bad.any() else ~bad)[doc]
                doc, key, spare = clean[doc[there]], key[there], spare[there]
                for to in range(0, len(doc), 100_000):
                    part = slice(to, to + 100_000)
                    size_of = len(doc[part])
                    yield pa.record_batch([pa.array(np.full(size_of, 2, np.int8)), pa.array(doc[part]), pa.array(spare[part]), pa.array(key[part].view(np.int64)), pa.array(np.zeros(size_of, np.int64))], names=["kind", "a", "b", "h1", "h2"])

    rows = named.mapInArrow(signatures, "kind tinyint, a bigint, b bigint, h1 bigint, h2 bigint")
    # Keys are counted before the shuffle as far as they repeat in a task; only those of two documents or more are joined to
    # the rows, and a key of very many rows can be split there.
    shared = rows.filter("kind = 2").groupBy("h1").agg(F.min(F.expr("if(b & 1L = 0L, a, null)")).alias("l0"), F.min(F.expr("if(b & 1L = 1L, a, null)")).alias("l1"), F.count(F.lit(1)).alias("docs")).filter("docs > 1")
    shared = shared.select(F.col("h1").alias("key"), F.coalesce("l0", "l1").alias("low"), F.expr("if(l0 is null, 1L, 0L)").alias("low_shift"), (F.col("docs") >= COMMON).alias("common"))
    met = rows.join(shared, (F.col("h1") == F.col("key")) & (F.col("kind") == 2), "left").filter("kind = 0 OR low IS NOT NULL")
    own = F.when(F.col("kind") == 0, F.col("h1"))
    parts = cut(met.groupBy("kind", "a", "b", own.alias("h1"), "h2", "low", "low_shift", "common").agg(F.count(F.lit(1)).alias("n")))
    sets = parts.filter("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n"), "h1", "h2", F.col("n").alias("rows"))
    reps = cut(sets.filter("n > 0").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep")))
    member = sets.join(reps, ["h1", "h2", "n"]).select("doc_id", "rep")
    # Partners share more keys than either can spare, so a document that shares no more than that, with all others together,
    # has no partner. Of the rest, one leaves out its common keys if it can spare as many; else they link it too.
    shares = parts.filter("kind = 2")
    per = shares.groupBy("a", "b").agg(F.sum("n").alias("_n"), F.sum(F.when(F.col("common"), F.col("n")).otherwise(0)).alias("_c")).filter("_n > b div 2")
    links = shares.join(per, ["a", "b"]).filter("NOT common OR _c > b div 2")
    # Partners meet in the class of the larger one, so chains are made class by class: a node is a document in its own class
    # or in the next (the last bit of spare), and a document's two groups needn't be one.
    node = lambda doc, shift: F.xxhash64(doc, shift)
    edges = links.select(node("a", F.expr("b & 1L")).alias("a"), node("low", "low_shift").alias("b")).filter("a != b")
    twins = member.filter("doc_id != rep").select("doc_id", "rep", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("_s"))
    edges = edges.unionByName(twins.select(node("doc_id", "_s").alias("a"), node("rep", "_s").alias("b")))
    groups = components(edges)
    lone = reps.filter("rep IS NOT NULL").select(F.col("rep").alias("doc_id"), "n").distinct()
    both = lone.select("doc_id", "n", F.explode(F.array(F.lit(0).cast("long"), F.lit(1).cast("long"))).alias("_s")).select("doc_id", "n", node("doc_id", "_s").alias("node"))
    held = cut(both.join(groups, "node").select("doc_id", "n", F.col("component").alias("g")).distinct())
    sizes = held.groupBy("g").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("members")).filter("docs > 1")
    sizes = sizes.withColumn("blocks", F.expr(f"greatest(cast(ceil(docs / {block_docs}d) as int), cast(ceil(members / {block_members}d) as int))"))
    # Blocks of a group take sizes in turn, each block with every other; a group of one block is the usual case.
    todo = held.join(sizes.select("g", "blocks"), "g").withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int"))
    todo = todo.select("doc_id", "g", "blocks", "block")
    few = held.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    with_text = named.filter("doc_id IS NOT NULL").join(F.broadcast(todo) if few else todo, "doc_id")
    pairs = F.expr("transform(sequence(0, blocks - 1), x -> named_struct('x', least(x, block), 'y', greatest(x, block)))")
    dealt = with_text.select("doc_id", "text", "g", "block", F.explode(pairs).alias("p")).select("doc_id", "text", "g", "block", "p.x", "p.y")

    def traverse(key, table):
        ids = table["doc_id"].to_numpy().astype(np.int64)
        order = np.argsort(ids, kind="stable")
        ids, block = ids[order], table["block"].to_numpy()[order]
        sets = [members[bounds[i] : bounds[i + 1]] for _, members, bounds in chunks(table["text"].take(pa.array(order)), n) for i in range(len(bounds) - 1)]
        union = Union(len(ids))
        for i in range(1, len(ids)):
            if ids[i] == ids[i - 1]:
                union.merge(i - 1, i)
        x, y = key[1].as_py(), key[2].as_py()
        bits = width(sets)
        trees = [Tree([sets[i] for i in some], some, bits) for some in ([i for i in range(len(ids)) if block[i] == b and len(sets[i])] for b in ([x] if x == y else [x, y]))]
        join_trees(trees[0], trees[-1], union, threshold)
        root = ids[[union.find(i) for i in range(len(ids))]]
        return pa.table([pa.array(ids), pa.array(root)], names=["a", "b"])

    found = cut(dealt.groupBy("g", "x", "y").applyInArrow(traverse, "a bigint, b bigint"))
    final = components(found.filter("a != b"))
    comp = member.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("c"))
    comp = comp.groupBy("doc_id").agg(F.min("c").alias("c"))
    out = sets.join(comp, "doc_id", "left").withColumn("_r", F.explode(F.expr("sequence(1L, rows)")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("c", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, n: int = 5, threshold: Fraction = Fraction(8, 10), text: str = "text") -> DataFrame:
    """The rows of docs without near duplicates: of each class of doc_ids the smallest stays, with all its columns. Rows with a null doc_id stay."""
    keep = classes(docs, n, threshold, text).filter("doc_id = component_id").select("doc_id").distinct()
    return docs.filter("doc_id IS NULL").unionByName(docs.join(keep, "doc_id", "left_semi"))


def op7_ngram_join(spark, sf_dir):
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op7_ngram_join": op7_ngram_join}
SQL = {}
