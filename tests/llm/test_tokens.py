"""Token files against the tokenizers library and plain lists."""

import itertools
import random
import zlib

import numpy as np
import pytest

from ledgerloom.llm import token_files as T
from ledgerloom.llm.common import own_path

TEXTS = [
    "", " ", "  ", "\n", "a", " a", "a ", "a  b", "a \n b", "a\n b", "a\t b", "a\t \tb c", "a\n\n\nb  \n c", "it's we'll  don't 'tis", "x1 22 3.14, (a)  [b]", "héllo  wörld\xa0 b", "a\xa0b \xa0 c", "日本語 テスト  。", "\x1c a\x1c b \x85 c",
    "word " * 50, "\tfoo\tbar \tbaz", "tail \n", "tail\n ", "🙂 🙂🙂  🙂", "<|endoftext|> a <|endoftext|>", "a\r\nb \r\n c", "  x  y", "é é",
]


@pytest.fixture(scope="module")
def tok():
    return T.tokenizer(None)


def want(tok, text):
    return tok.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("remembered", [10, 400_000])
def test_encoder_is_the_library(tok, remembered):
    rng = random.Random(3)
    bits = ["foo", "bar's", "Ünï", "12", "\n", "\t", "  ", " ", "...", "\xa0", "-", "<", "日本", "\r\n", "\x1c", "<|endoftext|>"]
    texts = TEXTS + ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 30))) for _ in range(3000)]
    one = T.Encoder(tok, remembered)
    for at in range(0, len(texts), 100):
        lot = [*texts[at : at + 100], None, ""]
        ids, each = one.encode(lot)
        assert len(each) == len(lot)
        for t, part in zip(lot, np.split(ids, np.cumsum(each)[:-1]), strict=True):
            assert part.tolist() == want(tok, t), repr(t)


def test_line_breaks_and_ends_of_stretches(tok):
    """Every short text over letters, ends and blanks, and letters of many scripts before ends."""
    short = ["".join(x) for n in range(1, 6) for x in itertools.product(["a", "'s", ".", " ", "\n", "\t"], repeat=n)]
    letters = [chr(c) + t for c in range(0x80, 0x10000, 7) if not 0xD800 <= c < 0xE000 for t in (".", "a1,", "\nB!", "'s")]
    texts = short + ["x " + w for w in letters] + ["the.\nOf it, the.\n\nOf.\n\n", "a\r\nb\n", "(<|endoftext|>.\n<|endoftext|>\n", "a\n\n<|endoftext|>b", "\n<|endoftext|>\n\n<|endof\n\n", "é\u0301. é\u0301\u0301,", "Ġa. Ġ\nĠ."]
    one = T.Encoder(tok)
    assert one.units
    for lot in (texts, texts[::-1], [""], [None], [], ["\n"], [" "]):
        ids, each = one.encode(lot)
        assert len(each) == len(lot)
        assert [p.tolist() for p in np.split(ids, np.cumsum(each)[:-1])][: len(lot)] == [want(tok, t) for t in lot]


def test_equal_units_go_to_the_library_once(tok):
    """What differs in punctuation, line breaks or place alone is no new work."""
    words = ["".join(p) for p in itertools.product(["tion", "heit", "ment", "able", "ing"], repeat=4)]

    class Counted:
        def __init__(self):
            self.chars = 0

        def __getattr__(self, name):
            return getattr(tok, name)

        def encode_batch_fast(self, texts, **how):
            self.chars += sum(map(len, texts))
            return tok.encode_batch_fast(texts, **how)

    seen = Counted()
    one = T.Encoder(seen)
    one.encode(["x " + " ".join(words)])
    before = seen.chars
    text = ["y " + " ".join(f"{w}{end}" for w in words) for end in (",", ".", "!!", ".***", " 12.")]
    ids, each = one.encode(text)
    assert [p.tolist() for p in np.split(ids, np.cumsum(each)[:-1])] == [want(tok, t) for t in text]
    assert seen.chars - before < 100


def test_other_tokenizers_are_given_whole_texts():
    import tokenizers
    from tokenizers import models, pre_tokenizers, trainers

    made = tokenizers.Tokenizer(models.BPE())
    made.pre_tokenizer = pre_tokenizers.Metaspace()
    made.train_from_iterator(TEXTS * 3, trainers.BpeTrainer(vocab_size=300))
    level = tokenizers.Tokenizer.from_str(T.tokenizer(None).to_str())
    level.add_tokens(["a b", "foo.", "word."])
    for tok in (made, level):
        one = T.Encoder(tok)
        assert not one.units
        texts = [*TEXTS, "a b foo. word.", "x\nfoo.\na b"]
        ids, each = one.encode(texts)
        assert [p.tolist() for p in np.split(ids, np.cumsum(each)[:-1])] == [want(tok, t) for t in texts]


@pytest.mark.parametrize("n,most", [(0, 1), (1, 0), (7, 3), (5000, 40_000), (200_000, 300), (65_536, 2), (70_000, 100_000)])
def test_file(n, most):
    rng = np.random.default_rng(n + most)
    ids = np.minimum(rng.geometric(0.01, n) if most > 100 else rng.integers(0, most + 1, n), most).astype(np.uint32)
    sizes = np.bincount(rng.integers(0, 5, n), minlength=5)
    docs = [5, None, -7, 5, 2**60]
    data = T.packed(ids, docs, sizes)
    reads = []
    f = T.TokenFile(lambda at, size: reads.append(size) or data[at : at + size])
    assert f.all().tolist() == ids.tolist() and f.docs()[0] == docs and f.docs()[1].tolist() == sizes.tolist()
    reads.clear()
    f = T.TokenFile(lambda at, size: reads.append(size) or data[at : at + size])
    for i in rng.integers(0, max(n, 1), 30 if n else 0).tolist():
        assert f.access(i) == ids[i]
    for t in {0, most, most + 1, 1 << 20, *ids[:8].tolist()}:
        at = np.flatnonzero(ids == t)
        assert f.count(t) == len(at) and f.locate(t, len(at)) is None and f.locate(t, -1) is None
        for stop in (0, 1, n // 3, n):
            assert f.count(t, stop) == (at < stop).sum()
        for k in {0, len(at) // 2, len(at) - 1} if len(at) else ():
            assert f.locate(t, k) == at[k]
    with pytest.raises(IndexError):
        f.access(n)
    with pytest.raises(ValueError):
        T.TokenFile(lambda at, size: b"x" * size)


def test_one_place_reads_a_chunk_of_each_plane():
    ids = np.random.default_rng(1).integers(0, 50_000, 1_000_000).astype(np.uint32)
    data = T.packed(ids, [1], np.array([len(ids)]))
    sizes = []
    f = T.TokenFile(lambda at, size: sizes.append(size) or data[at : at + size])
    assert f.access(777_777) == ids[777_777]
    assert sum(sizes) < 0.15 * len(data)


def slow(tok, rows):
    out, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        ids = [*want(tok, text), 0]
        out.append((doc, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_write_and_read(spark, tok, monkeypatch):
    rng = random.Random(9)
    ids = rng.sample(range(-500, 5000), 400)
    rows = [(ids[i], rng.choice(TEXTS) + " x" * rng.randrange(40)) for i in range(395)] + [(ids[395], None), (ids[396], ""), (ids[397], "long word " * 30_000), (None, "no id")]
    df = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, path string, task int").repartition(5)
    for shard in (10, 700, 2_000_000):
        made = T.write(df, own_path(spark, "tokens"), shard_tokens=shard)
        assert sorted(map(str, map(tuple, T.checksums(made).collect()))) == sorted(map(str, slow(tok, rows)))
        assert all(r.size_bytes == len(open(r.path.removeprefix("file:"), "rb").read()) for r in made.collect())
    back = {r.doc_id: r for r in T.read(made).collect()}
    assert all(back[d].ids == [*want(tok, t), 0] for d, t in rows)
    f = T.opened(made.orderBy("start").first().path)
    assert f.access(f.n - 1) == 0 and f.count(0) == f.docs()[1].size


def test_repeated_ids_and_no_rows(spark, tok):
    rows = [(3, "b c"), (3, "a"), (3, "a"), (1, "x")] + [(2, "same")] * 50
    df = spark.createDataFrame(rows, "doc_id int, text string")
    got = sorted(map(tuple, T.checksums(T.write(df, own_path(spark, "tokens"), shard_tokens=5)).collect()), key=lambda r: r[1])
    starts = np.cumsum([0, *(r[2] for r in got)])
    assert [r[1] for r in got] == starts[:-1].tolist() and [r[0] for r in got] == [1] + [2] * 50 + [3] * 3
    assert sorted(r[2:] for r in got) == sorted(r[2:] for r in slow(tok, rows))
    none = T.write(df.limit(0), own_path(spark, "tokens"))
    assert none.count() == 0 and T.checksums(none).count() == 0
    with pytest.raises(ValueError):
        T.write(df.drop("text"), own_path(spark, "tokens"))


def test_query_on_tables(spark, tok):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, T.op12_token_files(spark, "/root/testdata/sf0.001").collect())) == sorted(slow(tok, rows))
