"""Every operator takes rows whose further columns have any name, its own among them, and passes their data on."""

import re

import pytest

from ledgerloom.llm import embedding_dedup, html_text, license_scan, line_dedup, mixing, ngram_join, packing, quality_rules, sharding, warc

WORDS = " ".join(f"w{i}" for i in range(30))
NAMES = sorted(
    {m for mod in (embedding_dedup, html_text, license_scan, line_dedup, mixing, ngram_join, packing, quality_rules, sharding, warc) for m in re.findall(r"[\"'](_[a-z][a-z0-9]*)[\"']", open(mod.__file__, encoding="utf-8").read())}
    | {"counts", "offsets", "ends", "row", "n", "w", "x", "g", "i", "p", "h1", "h2", "bin", "offset", "piece", "start", "copy", "copies", "words", "line", "family", "kind", "low", "rep", "number", "at", "block", "target", "size", "payload", "tile", "id", "ok", "v", "_in0", "_in1", "_in5"}
)


def frame(spark):
    base = [(1, f"{WORDS}\na\nb", "s", "<p>one"), (2, f"a\nb\n{WORDS}", "t", None), (3, None, None, "")]
    rows = [(i, t, s, h, i, "u", i, [1.0, float(i)], *[f"{n}:{i}" for n in NAMES]) for i, t, s, h in base]
    fixed = "doc_id long, text string, source string, html string, page_id long, url string, vec_id long, embedding array<double>"
    return spark.createDataFrame(rows, fixed + "".join(f", `{n}` string" for n in NAMES))


@pytest.mark.parametrize(
    "run, own",
    [
        (line_dedup.dedup, ()), (quality_rules.ledger, ()), (quality_rules.filtered, ()), (lambda d: sharding.shard(d, 2), ("shard", "slot")), (mixing.mixed, ()),
        (ngram_join.representatives, ()), (html_text.extract, ()),
    ],
)
def test_columns_pass(spark, run, own):
    out = run(frame(spark))
    left = [n for n in NAMES if n not in own]
    assert set(left) <= set(out.columns)
    rows = out.select("doc_id", *left).collect()
    assert rows and all(r[n] == f"{n}:{r.doc_id}" for r in rows for n in left)


@pytest.mark.parametrize("run", [packing.pack, packing.plan, mixing.taken, ngram_join.classes, license_scan.scan, embedding_dedup.near_duplicates, line_dedup.windows, lambda d: warc.payloads(warc.archived(d))])
def test_columns_are_passed_over(spark, run):
    df = frame(spark)
    key = lambda rows: sorted(map(str, rows))
    want = run(df.select("doc_id", "text", "source", "html", "page_id", "url", "vec_id", "embedding"))
    got = run(df)
    assert got.columns == want.columns and key(got.collect()) == key(want.collect())
