"""Mixing, packing, embeddings, HTML, n-gram join and WARC against brute force."""

import hashlib
import itertools
import random
import re
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import embedding_dedup, html_text, mixing, ngram_join, packing, warc
from ledgerloom.llm.graph import components


def corpus(spark, n=120, seed=4):
    rng = random.Random(seed)
    rows = [(i, " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(rng.randrange(0, 80))), rng.choice(["a", "a", "a", "b", "c", "d", None]), "x") for i in range(n)]
    rows += [(n, None, "a", "x"), (n + 1, "", "b", "x"), (n + 2, "word " * 9000, "c", "x"), (n + 3, "one", "only", "x"), (n + 4, None, "blank", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target string")


def slow_targets(sizes, weights, share=1.5, ceiling=2.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full, free = share * sum(sizes.values()), {}, set(names)
    while True:
        left = total - sum(full.values())
        level = left / sum(w[s] for s in free) if free else 0
        over = {s for s in free if level * w[s] > ceiling * sizes[s]}
        if not over:
            return full | {s: level * w[s] for s in free}
        full |= {s: ceiling * sizes[s] for s in over}
        free -= over


def test_mixing(spark):
    df = corpus(spark)
    rows = mixing.taken(df, block=16, bucket_rows=10, shard_slots=8).collect()
    assert len(rows) == df.count()
    sizes, taken = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert 0 <= r.taken <= 2 * r.size
    want = slow_targets(sizes, (5, 2, 1))
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes)
    again = mixing.taken(df.repartition(7), block=16, bucket_rows=10, shard_slots=8).collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, again)) == sorted(map(key, rows))


def test_mixed_spans(spark):
    df = corpus(spark)
    spans, rows = mixing.mix(df, block=16, bucket_rows=10, shard_slots=8)
    got = spans.collect()
    assert len({(s.shard, s.place) for s in got}) == len({(s.source, s.epoch, s.block) for s in got})
    seen = set()
    for s in got:
        for w in range(s.start, s.start + s.n):
            assert (s._rid, s.epoch, w) not in seen
            seen.add((s._rid, s.epoch, w))
    texts = {r.doc_id: r.text for r in df.collect()}
    out = mixing.mixed(df, block=16, bucket_rows=10, shard_slots=8).collect()
    assert sum(len(r.text.split()) for r in out) == len(seen) == sum(s.n for s in got)
    for r in out:
        it = iter(texts[r.doc_id].split())
        assert all(w in it for w in r.text.split())


def test_mixing_edges(spark):
    df = corpus(spark)
    assert mixing.taken(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "a b c", "s")] * 3 + [(None, None, None)], "doc_id long, text string, source string")
    rows = mixing.taken(same).collect()
    assert len(rows) == 4 and sum(r.taken for r in rows) == 14
    assert sum(len(r.text.split()) for r in mixing.mixed(same).collect()) == 14


def slow_pack(sizes, sources, clusters, capacity, per):
    bins, out = [], [None] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fits = [b for b in bins if b["room"] >= sizes[i] and b["s"].count(sources[i]) < per and clusters[i] not in b["c"]]
        best = min((b["room"] for b in fits), default=None)
        out[i] = best
        b = next(b for b in fits if b["room"] == best) if fits else None
        if b is None:
            b = {"room": capacity, "s": [], "c": []}
            bins.append(b)
        b["room"] -= sizes[i]
        b["s"].append(sources[i])
        b["c"].append(clusters[i])
    return len(bins)


def test_best_fit_finds_the_tightest_bin():
    rng = random.Random(6)
    for _ in range(40):
        n, cap, per = rng.randrange(1, 80), 50, rng.randrange(1, 4)
        sizes = [rng.randrange(1, cap + 1) for _ in range(n)]
        sources, clusters = [rng.choice("abc") for _ in range(n)], [rng.choice([*range(6), *range(100, 140)]) for _ in range(n)]
        places = packing.pack_group(sizes, sources, clusters, cap, per)
        bins = {}
        for i in sorted(range(n), key=lambda i: -sizes[i]):
            b, offset = places[i]
            held = bins.setdefault(b, [])
            assert offset == sum(sizes[j] for j in held) and offset + sizes[i] <= cap
            room = cap - offset
            for other, members in bins.items():
                if other != b and (left := cap - sum(sizes[j] for j in members)) >= sizes[i] and (left < room):
                    assert sum(sources[j] == sources[i] for j in members) >= per or clusters[i] in [clusters[j] for j in members]
            held.append(i)
            assert sum(sources[j] == sources[i] for j in held) <= per and len({clusters[j] for j in held}) == len(held)


def test_packing(spark):
    df = corpus(spark)
    rows = packing.pack(df, capacity=64, group_pieces=20).collect()
    texts = {r.doc_id: r.text for r in df.collect()}
    for doc, pieces in itertools.groupby(sorted(rows, key=lambda r: (r.doc_id, r.piece)), key=lambda r: r.doc_id):
        assert "".join(p.text for p in pieces).split() == (texts[doc] or "").split()
    held = {}
    for r in rows:
        if r.n:
            held.setdefault(r.bin, []).append(r)
        else:
            assert r.bin is None
    for pieces in held.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.n
        assert at <= 64
    assert packing.pack(df.limit(0)).count() == 0


def near(rng, base, noise):
    v = base + noise * rng.standard_normal(len(base))
    return [float(x) for x in v]


def test_embeddings_against_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = []
    for g in range(12):
        base = rng.standard_normal(16)
        rows += [near(rng, base, 0.12) for _ in range(9)]
    rows += [rows[0]] * 5 + [[2 * x for x in rows[3]], None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0] * 5, [2.0] * 5, [], [1e300] * 16]
    df = spark.createDataFrame([(i, r, "z") for i, r in enumerate(rows)], "vec_id long, embedding array<double>, tile string")
    ok = [r is not None and len(r) > 0 and all(x is not None and np.isfinite(x) for x in r) and any(r) for r in rows]
    unit = [np.array(r) / np.abs(r).max() / np.linalg.norm(np.array(r) / np.abs(r).max()) if o else None for r, o in zip(rows, ok, strict=True)]
    pairs = [(i, j) for i in range(len(rows)) for j in range(len(rows)) if i != j and ok[i] and ok[j] and len(rows[i]) == len(rows[j]) and unit[i] @ unit[j] >= 0.95]
    up = list(range(len(rows)))
    find = lambda x: x if up[x] == x else find(up[x])
    for i, j in pairs:
        a, b = sorted((find(i), find(j)))
        up[b] = a
    for band in (embedding_dedup.BAND_BYTES, 1000):
        got = {r.vec_id: r for r in embedding_dedup.near_duplicates(df, band_bytes=band).collect()}
        assert len(got) == len(rows)
        for i in range(len(rows)):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (sum(a == i for a, _ in pairs), find(i), find(i) == i)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_tiles_and_chunks_of_products():
    """Small products find the same pairs as one, those inside the error bounds and those beyond them."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 24))
    v = np.repeat(base, 5, axis=0) + 0.18 * rng.standard_normal((200, 24))
    a = embedding_dedup.prepared(v)
    cos = a["unit"] @ a["unit"].T
    want = {(i, j) for i in range(200) for j in range(i + 1, 200) if cos[i, j] >= 0.95}
    for rows, tile in ((512, 4096), (7, 13), (64, 3)):
        got = [(int(x), int(y)) for i, j in embedding_dedup.linked(a, None, 0.95, rows, tile) for x, y in zip(i, j, strict=True)]
        assert len(got) == len(set(got)) and set(got) == want
    first = rng.random(200) < 0.5
    b, c = embedding_dedup.prepared(v[first]), embedding_dedup.prepared(v[~first])
    pairs = {(int(x), int(y)) for i, j in embedding_dedup.linked(b, c, 0.95, 9, 11) for x, y in zip(np.flatnonzero(first)[i], np.flatnonzero(~first)[j], strict=True)}
    assert pairs == {(i, j) if first[i] else (j, i) for i, j in want if first[i] != first[j]}


def test_quantisation_bound():
    rng = np.random.default_rng(3)
    v = rng.standard_normal((200, 40))
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    q, scale, error = embedding_dedup.quantised(unit)
    approx = (scale[:, None] * q) @ (scale[:, None] * q).T
    assert (np.abs(unit @ unit.T - approx) <= error[:, None] + error + error[:, None] * error + 1e-12).all()


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)] + [(200, x) for x in range(201, 240)]
    up = {x: x for e in edges for x in e}
    find = lambda x: x if up[x] == x else find(up[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        up[y] = x
    linked = {x for a, b in edges if a != b for x in (a, b)}
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in linked}


def word_list(text):
    lower = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return re.findall(r"[^\x20\x09-\x0D]+", lower)


def slow_classes(rows, n, t):
    sets = {}
    for i, text in rows:
        ws = word_list(text)
        sets[i] = {tuple(ws[k : k + n]) for k in range(max(1, len(ws) - n + 1))} if ws else set()
    up = {i: i for i in sets}
    find = lambda x: x if up[x] == x else find(up[x])
    for a, b in itertools.combinations(sorted(sets), 2):
        inter = len(sets[a] & sets[b])
        if sets[a] and sets[b] and inter >= t * (len(sets[a]) + len(sets[b]) - inter):
            x, y = sorted((find(a), find(b)))
            up[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def variants(seed, n=60):
    rng = random.Random(seed)
    words = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(400)]
    common = [rng.choice(words) for _ in range(12)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            base = list(rng.choice(out))
            for _ in range(rng.randrange(0, 1 + len(base) // 20)):
                base[rng.randrange(len(base))] = rng.choice(words)
        else:
            base = common[: rng.randrange(13)] + [rng.choice(words) for _ in range(rng.randrange(1, 160))]
        out.append(base)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("n, t, blocks", [(3, Fraction(9, 10), 1024), (5, Fraction(4, 5), 3), (2, Fraction(1, 2), 1024), (1, Fraction(1, 1), 5)])
def test_ngram_join_against_brute_force(spark, n, t, blocks):
    texts = variants(n) + [None, "", "  \t", "one", "ONE", "one two", "x\x0by\x1cz", "same " * 3000, "same " * 2999]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, s, "q", "r") for i, s in rows], "doc_id long, text string, n string, kind string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(df, n, t, block_docs=blocks).collect()}
    assert got == slow_classes(rows, n, t)


def test_ngram_blocks_of_other_widths(spark):
    """Links between blocks of one group are found when their largest sets lie on both sides of a power of two."""
    base = [f"w{i}" for i in range(262)]
    rows = [(i, " ".join(base[: 252 + i])) for i in range(11)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = slow_classes(rows, 3, Fraction(9, 10))
    assert {n for n, _ in want.values()} == set(range(250, 261)) and {c for _, c in want.values()} == {0}
    for blocks in (1, 2, 3):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.classes(df, block_docs=blocks).collect()}
        assert got == want


def test_keys_meet():
    """Any two sets at the threshold share a key that neither may leave out, whatever keys are called common."""
    rng = np.random.default_rng(12)
    for t in (Fraction(9, 10), Fraction(4, 5)):
        growth, more = ngram_join.plan_keys(t)
        for _ in range(60):
            size = int(rng.integers(1, 300))
            a = rng.integers(0, 2**63, size).astype(np.uint64)
            most = int(Fraction(1 - t, 1 + t) * 2 * size)
            drop = int(rng.integers(0, most + 1)) // 2
            b = np.concatenate([a[drop:], rng.integers(0, 2**63, drop).astype(np.uint64)])
            inter = len(np.intersect1d(a, b))
            if inter < t * (len(a) + len(b) - inter):
                continue
            doc, key, spare = ngram_join.keys(np.concatenate([np.sort(a), np.sort(b)]), np.array([0, len(a), len(a) + len(b)]), t, growth, more)
            common = set(rng.choice(key, len(key) // 3).tolist())
            kept = []
            for d in (0, 1):
                own = set()
                for s in (0, 1):
                    ks = [(k, sp) for k, sp, dd in zip(key.tolist(), spare.tolist(), doc.tolist(), strict=True) if dd == d and sp % 2 == s]
                    hot = {k for k, _ in ks if k in common}
                    own |= {k for k, sp in ks if k not in hot or len(hot) > sp // 2}
                kept.append(own)
            assert kept[0] & kept[1]


def test_ngram_rows(spark):
    df = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, None), (2, "a b c d"), (3, "z")], "doc_id long, text string")
    rows = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.classes(df).collect()), key=str)
    assert rows == sorted([(1, 2, 1), (1, 2, 1), (None, 2, None), (None, 0, None), (2, 2, 1), (3, 1, 3)], key=str)
    assert ngram_join.classes(df.limit(0)).count() == 0
    assert sorted(r.doc_id or -1 for r in ngram_join.representatives(df).collect()) == [-1, -1, 1, 1, 3]


FAKE = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"


@pytest.mark.parametrize("split", [150, 10_000_000])
def test_warc_round_trip(spark, tmp_path, split):
    rows = [(1, "u", "x" * 1200), (2, "u", FAKE * 30), (3, None, None), (4, "a\r\nb", FAKE), (5, "u", "é" * 700 + "WARC/1.0\r\n"), (6, "u", "x" * 1200), (7, "u", "\r\n\r\nWARC/1.0\r\n\r\n"), (8, "q", "x" * 1200), (9, "u", FAKE * 30), (10, "u", "WARC/1.0\r\nContent-Length: 5\r\n\r\nhello")]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
        got = {r.record_id: r for r in warc.archived(pages, f"file://{tmp_path}/w").collect()}
        assert len(got) == len(rows)
        for i, url, page in rows:
            r = got[f"<urn:page:{i}>"]
            last = max(k for k, _, h in rows if h == page)
            if page and len(page.encode()) >= 1000 and last != i:
                assert (r.record_type, r.refers_to_id, r.payload) == ("revisit", f"<urn:page:{last}>", "")
            else:
                assert (r.record_type, r.payload) == ("response", page or "")
            assert r.digest == "sha1:" + hashlib.sha1((page or "").encode()).hexdigest()
        empty = warc.archived(pages.limit(0), f"file://{tmp_path}/none")
        assert empty.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_warc_repeated_page_ids(spark):
    """Responses that share a page_id don't mix: a revisit takes what has its own digest; without its response it keeps the digest alone."""
    a, b = "a" * 1500, "b" * 2000
    pages = spark.createDataFrame([(5, a), (9, a), (9, b), (None, b), (3, b), (3, None)], "page_id long, html string").withColumn("url", F.lit("u"))
    rec = warc.archived(pages)
    sha = lambda t: hashlib.sha1(t.encode()).hexdigest()
    got = sorted(map(tuple, warc.payloads(rec).collect()), key=str)
    assert got == sorted([(5, 1500, sha(a), "revisit", 9), (9, 1500, sha(a), "response", None), (9, 2000, sha(b), "response", None), (None, 2000, sha(b), "response", None), (3, 2000, sha(b), "revisit", 9), (3, 0, sha(""), "response", None)], key=str)
    lost = warc.payloads(rec.filter("record_type = 'revisit' AND record_id = '<urn:page:3>'")).collect()
    assert [tuple(r) for r in lost] == [(3, None, sha(b), "revisit", 9)]


def test_warc_ids_of_any_text(spark):
    """Ids that are no numbers come back as they were; where numbers are asked for, others are an error."""
    ids = ["a b", "x>y", "50%", "null", "", "é\r\n", "<urn:page:1>", None, "-7", "1+1"]
    body = "b" * 1200
    pages = spark.createDataFrame([(i, "u", body if i in ("a b", "x>y") else f"t{k}") for k, i in enumerate(ids)], "page_id string, url string, html string")
    got = {r.page_id: r for r in warc.payloads(warc.archived(pages), "string").collect()}
    assert set(got) == set(ids) and len(got) == len(ids)
    assert (got["a b"].record_type, got["a b"].refers_to, got["a b"].payload_bytes) == ("revisit", "x>y", 1200)
    assert all(got[i].payload_digest == hashlib.sha1(f"t{k}".encode()).hexdigest() for k, i in enumerate(ids) if k > 1)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        warc.payloads(warc.archived(pages)).collect()


def test_warc_broken_tail(spark, tmp_path):
    good = "WARC/1.0\r\nWARC-Record-ID: <a>\r\nContent-Length: 2\r\n\r\nok\r\n\r\n"
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "a.warc").write_bytes((good + "WARC/1.0\r\nWARC-Record-ID: <b>\r\nContent-Length: 99\r\n\r\nshort").encode())
    (tmp_path / "w" / "b.warc").write_bytes(("junk" + good).encode())
    assert [(r.record_id, r.payload) for r in warc.read(spark, f"file://{tmp_path}/w").collect()] == [("<a>", "ok")]


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p>One <b>bold</b>\n text<p>Two<br>line", "One bold text\n\nTwo\nline"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>", "- a\n- b\n  3. x\n  4. y\n- c"),
        ("<table><tr><th>Name<th>Qty<tr><td>Long name<td>3<tr><td colspan=2>all</table>", "Name      | Qty\nLong name | 3\nall"),
        ("<title>T</title><style>p{}</style><script>var a='<p>';</script>seen<div hidden>no</div><span style='display: none'>no</span><!-- no -->", "seen"),
        ("a &amp; b &lt;p&gt; 5 < 6", "a & b <p> 5 < 6"),
        ("<pre>\n a  b\n   c</pre>x", " a  b\n   c\n\nx"),
        ("<div>a</div><div>b</div>", "a\nb"),
        ("<h1>H</h1>text<blockquote>q</blockquote>", "H\n\ntext\n\nq"),
        ("", ""), (None, None), ("<p>unclosed <a href='x", "unclosed"), ("<select><option>a<option>b</select>", "a\nb"),
    ],
)
def test_html(page, text):
    assert html_text.page_text(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<p style='backface-visibility: hidden'>a</p><p style='-webkit-backface-visibility:hidden;color:red'>b</p>", "a\n\nb"),
        ("<p style='--x-display:none'>a</p><p style='background:url(x;display:none)'>b</p><p style='display:none;display:block'>c</p>", "a\n\nb\n\nc"),
        ("a<p style='color:red; DISPLAY : None !important; display:block'>no</p><p style='/* x */visibility:collapse'>no</p><p style='visibility:hidden'>no</p>", "a"),
        ("<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><metadata>no</metadata><text>Jan</text><text x=5>Feb<tspan>!</tspan></text></svg>", "Jan Feb!"),
        ("<svg><defs/><path d='M0'/><title/><text display='none'>no</text><text><![CDATA[a<b]]></text></svg><p>after", "a<b\n\nafter"),
        ("<svg><defs><p>out of it</p>", "out of it"),
        ("<math><semantics><mrow><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac></mrow><annotation>no</annotation><annotation-xml>no</annotation-xml></semantics></math>", "x=1 2"),
        ("<svg><foreignObject><div>in it</div></foreignObject></svg><desc>plain</desc>", "in it\nplain"),
    ],
)
def test_html_visibility(page, text):
    assert html_text.page_text(page) == text


@pytest.mark.parametrize(
    "page, text",
    [
        ("<table><tr><th>A<th hidden>no<th>B<tr><td>1<td style='display:none'>no<td>2</table>", "A | B\n1 | 2"),
        ("<table><tr><td>1<td style='visibility:hidden'>no<td>3<tr><td>4<td>5<td>6</table>", "1 |   | 3\n4 | 5 | 6"),
        ("<table><tr><td rowspan=2>a<td>b<td>c<tr><td>d<td>e<tr><td>f<td>g<td>h</table>", "a | b | c\n  | d | e\nf | g | h"),
        ("<table><tr><td>a<td rowspan=3>b<td>c<tr><td>d<td rowspan=2>e<tr><td>f</table>", "a | b | c\nd |   | e\nf |   |"),
        ("<table><tr><td rowspan=2 colspan=2>ab<td>c<tr><td>d<tr><td>e<td>f<td>g</table>", "ab    | c\n      | d\ne | f | g"),
        ("<table><thead><tr><th rowspan=9>a<th>b<tbody><tr><td>1<td rowspan=0>2<tr><td>3<tr><td>4<tfoot><tr><td>5<td>6</table>", "a | b\n1 | 2\n3 |\n4 |\n5 | 6"),
        ("<table><tr><td>a<td>b<td rowspan=2>c<tr><td>d</table>", "a | b | c\nd |   |"),
    ],
)
def test_html_cells(page, text):
    assert html_text.page_text(page) == text


def test_html_visible_words(spark):
    """On made-up pages every visible word comes out, once and in order, and no hidden one."""
    rng = random.Random(10)
    pages, want = [], []
    for i in range(60):
        out, words = [], []

        def grow(depth, seen):
            for _ in range(rng.randrange(1, 4)):
                w = f"v{len(words)}x{i}" if seen else f"hidden{rng.randrange(9)}"
                tag = rng.choice(["p", "div", "b", "li", "span", "section", "h2"])
                hide = rng.random() < 0.15
                out.append(f"<{tag}{' hidden' if hide else ''}>")
                if seen and not hide:
                    words.append(w)
                out.append(w if seen and not hide else f"hidden{rng.randrange(9)}")
                if depth < 3 and tag in ("div", "section"):
                    grow(depth + 1, seen and not hide)
                out.append(f"</{tag}>")

        grow(0, True)
        pages.append((i, "".join(out)))
        want.append(words)
    df = spark.createDataFrame(pages, "page_id long, html string")
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    for i, words in enumerate(want):
        assert re.findall(r"v\d+x\d+", got[i]) == words and "hidden" not in got[i]
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_extremes():
    assert html_text.page_text("<div>" * 20_000 + "x") == "x"
    assert "x" in html_text.page_text("<table><tr><td>" * 300 + "x")
    assert html_text.page_text("<p>a " * 5000).count("a") == 5000
