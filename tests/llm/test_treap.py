"""Ranked search against a loop over all documents."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import treap_search
from ledgerloom.llm.common import own_path
from ledgerloom.llm.treap_search import build, pieces, search, totals, treap

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def slow(docs, items, k=10):
    tf = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, n_terms = sum(1 for _, c in tf if c), sum(c.total() for _, c in tf)
    df = Counter(t for _, c in tf for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for i, ts in wanted.items():
        scored = []
        for d, c in tf:
            m = 10 + 90 * c.total() * n_docs // n_terms if c else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(i, rank, None if null else d, -s) for rank, (s, null, d) in enumerate(sorted(scored)[:k], 1)]
    return out


def frames(spark, seed=1, n=300):
    rng = random.Random(seed)
    words = [f"{c}{i}" for i in range(150) for c in ("a", "É", "ß-", "X", "İ")]
    text = lambda m: " ".join(rng.choice(words[: rng.choice((10, 60, 750))]) for _ in range(m))
    docs = [(rng.randrange(-40, 10_000), text(rng.randrange(0, 60))) for _ in range(n)]
    docs += docs[:60] + [(7, None), (8, ""), (9, "-- !"), (None, text(30)), (None, text(30)), (11, "a1 " * 5000 + text(4000)), (12, "a1"), (13, "A1"), (13, "a1")]
    items = [(i, text(rng.randrange(0, 15))) for i in range(25)] + [(1, "a1 a1 A1"), (None, "a2 X3"), (30, None), (31, "nowhere"), (32, "a1")]
    return docs, items


@pytest.mark.parametrize("sizes", [(8192, 2_000_000), (16, 2_000_000), (8192, 100)])
def test_search(spark, monkeypatch, sizes):
    docs, items = frames(spark)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id int, text string")
    for query_terms, chunk in ((200_000, 500_000), (20, 300)):
        monkeypatch.setattr(treap_search, "pieces", lambda c, limit=chunk, docs=64: pieces(c, limit, docs))
        path = own_path(spark, "treaps")
        held = build(df, path, block_docs=sizes[0], block_cells=sizes[1])
        got = search(spark, path, held, asked, query_terms=query_terms).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, slow(docs, items)))


def test_index_holds_all_documents(spark):
    docs, _ = frames(spark, 2)
    path = own_path(spark, "treaps")
    build(spark.createDataFrame(docs, "doc_id long, text string"), path, block_docs=50)
    held = sorted(str(i) for r in spark.read.parquet(path).collect() for i in r.doc_ids)
    assert held == sorted(str(d) for d, t in docs)
    assert totals(spark.createDataFrame(docs, "doc_id long, text string")) == (sum(1 for _, t in docs if terms(t)), sum(len(terms(t)) for _, t in docs))


def test_treap_is_the_grid():
    rng = np.random.default_rng(3)
    cells = np.unique(rng.integers(0, 40 * 90, 500))
    row, col, value = cells // 90, cells % 90, rng.integers(0, 999_999, len(cells))
    quarters, maxima, order = treap(row, col, value)
    one = treap_search.Treap({"doc_ids": [], "norms": [10] * 90, "terms": b"", "places": b"\x01", "counts": treap_search.narrow(order + 1), "quarters": quarters, "maxima": maxima})
    for r in range(64):
        for c in range(128):
            node = 0
            for level in range(one.depth):
                shift = one.depth - 1 - level
                q = 2 * ((r >> shift) & 1) + ((c >> shift) & 1)
                bits = int(one.quarters[node])
                if not bits >> q & 1:
                    node = None
                    break
                inside = (row >> (shift + 1) == r >> (shift + 1)) & (col >> (shift + 1) == c >> (shift + 1))
                assert 0 <= one.value[node] - value[inside].max() < 4096
                node = one.first[node] + (bits & ((1 << q) - 1)).bit_count()
            hit = np.flatnonzero((row == r) & (col == c))
            assert (node is None) == (not len(hit)) and (node is None or one.value[node] == treap_search.impact(hit[0] + 1, 10))


def test_pieces_cut_between_terms():
    rng = random.Random(5)
    texts = [rng.choice(["", None, "ab", "é" * 40, "a b é c " * rng.randrange(30)]) for _ in range(80)]
    for limit in (1, 7, 50, 10_000):
        got = {}
        for first, data, off, done in pieces(pa.array(texts), limit, 5):
            for k in range(len(off) - 1):
                got.setdefault(first + k, []).append(bytes(data[off[k] : off[k + 1]]))
            assert done or len(off) == 2
        assert len(got) == len(texts)
        for i, t in enumerate(texts):
            assert b"".join(got[i]).decode() == (t or "") and sum((terms(p.decode()) for p in got[i]), []) == terms(t)


def test_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a", "x")], "item_id long, text string, rank string")
    path = own_path(spark, "treaps")
    assert search(spark, path, build(none, path), asked).count() == 0
    docs = spark.createDataFrame([(1, "a b", "t"), (2, "a", "u")], "doc_id int, text string, terms string")
    path = own_path(spark, "treaps")
    held = build(docs, path)
    assert sorted(map(tuple, search(spark, path, held, asked).collect())) == sorted(slow([(1, "a b"), (2, "a")], [(1, "a")]))
    assert search(spark, path, held, asked.limit(0)).count() == 0
    with pytest.raises(ValueError):
        build(docs.drop("text"), path)
