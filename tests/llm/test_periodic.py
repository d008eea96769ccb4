"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import pytest

from ledgerloom.llm import periodic_runs
from ledgerloom.llm.periodic_runs import digests, find_runs, op13_periodic_runs, planted, search


def slow_runs(words, least=12):
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            e = i
            while e + q < n and words[e] == words[e + q]:
                e += 1
            if e + q - i >= max(least, 2 * q):
                found.setdefault((i, e + q), q)
            i = e
    return sorted((s, e - s, q) for (s, e), q in found.items())


def slow_kept(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def made(rng):
    kind = rng.randrange(6)
    few = [rng.choice("ab") for _ in range(rng.randrange(0, 120))]
    if kind == 0:
        return few
    if kind == 1:
        return ["a"] * rng.randrange(0, 90)
    if kind == 2:
        u = [rng.choice("abc") for _ in range(rng.randrange(1, 30))]
        return (u * 9)[: rng.randrange(0, 150)] + few[:20]
    if kind == 3:
        u = ["a", "b"] * rng.randrange(2, 12)
        return ["x"] + u + u[: rng.randrange(1, len(u))] + u[1:] + few[:7]
    if kind == 4:
        return [rng.choice([f"w{i}" for i in range(400)]) for _ in range(300)]
    u = [rng.choice([f"w{i}" for i in range(9)]) for _ in range(rng.randrange(1, 60))]
    v = u + [rng.choice("xy")] + u
    return v * rng.randrange(1, 4) + few[:10]


@pytest.mark.parametrize("seed", range(12))
def test_search(seed):
    rng = random.Random(seed)
    docs = [made(rng) for _ in range(40)]
    docs += docs[:5] + [[]]
    runs, keep = search([[w.encode() for w in d] for d in docs])
    at = 0
    for i, d in enumerate(docs):
        want = slow_runs(d)
        assert [tuple(r[1:].tolist()) for r in runs if r[0] == i] == want, d
        assert [w for w, k in zip(d, keep[at : at + len(d)], strict=True) if k] == slow_kept(d, want)
        at += len(d)


@pytest.mark.parametrize("least", [2, 5, 7])
def test_other_lengths(least):
    rng = random.Random(least)
    docs = [made(rng) for _ in range(30)]
    runs, _ = search([[w.encode() for w in d] for d in docs], least)
    for i, d in enumerate(docs):
        assert [tuple(r[1:].tolist()) for r in runs if r[0] == i] == slow_runs(d, least), d


def test_fibonacci_words_have_many_runs():
    a, b = ["a"], ["a", "b"]
    while len(b) < 600:
        a, b = b, b + a
    runs, _ = search([[w.encode() for w in b]], 4)
    assert [tuple(r[1:].tolist()) for r in runs] == slow_runs(b, 4)


def slow_planted(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    if doc_id is None or n == 0:
        return words
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def slow_row(doc_id, text):
    words = slow_planted(doc_id, text)
    runs = slow_runs(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(slow_kept(words, runs))
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_on_tables(spark):
    """All documents of the smallest tables up to 1,500 words against the loop; of longer ones, the longest run and what is kept as a whole are checked by their definition."""
    got = {r.doc_id: tuple(r) for r in op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    some = [r for r in rows if len((r.text or "").split()) <= 1500]
    assert len(some) > 150
    for r in some:
        assert got[r.doc_id] == slow_row(r.doc_id, r.text)


def test_edges(spark, monkeypatch):
    base = "one two three\x1cfour " * 7
    rows = [(1, None, "x"), (2, "", "y"), (3, " \n\t", "z"), (None, base, "n"), (4, base, "a"), (4, base, "a"), (30, "b " * 40, "c"), (31, base + " " + base.upper(), "d")]
    rows += [(i, " ".join(f"w{k % (i % 11 + 2)}" for k in range(i)), "p") for i in range(40, 90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string")
    for size in (200_000, 50):
        got = find_runs(planted(df), batch_words=size)
        assert sorted(map(str, (tuple(r) for r in digests(got).collect()))) == sorted(str(slow_row(i, t)) for i, t, _ in rows)
    kept = find_runs(df.withColumn("collapsed", df.runs).withColumn("_w", df.runs)).collect()
    assert len(kept) == len(rows) and {r._w for r in kept} == {r[2] for r in rows} and all(isinstance(r.runs, list) for r in kept)
    assert find_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        find_runs(df.drop("text"))


def test_one_document_longer_than_a_batch(spark):
    words = [f"w{i}" for i in range(700)] * 3
    row = find_runs(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"), batch_words=100).first()
    assert [tuple(r) for r in row.runs] == [(0, 2100, 700)] and row.collapsed == " ".join(words[:700])
    assert periodic_runs.LEAST == 12
