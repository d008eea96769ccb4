"""Quality rules, line dedup, sharding, licence scan and the draws they use."""

import random
import textwrap
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import draws, license_scan, line_dedup, quality_rules, sharding
from ledgerloom.llm.common import permuted

DOCS = "doc_id long, text string, source string, _w string, slot string, n_words string"


def docs(spark, *texts):
    """Rows with clashing extra columns."""
    return spark.createDataFrame([(i, t, "s", "x", "y", "z") for i, t in enumerate(texts)], DOCS)


def slow_repeats(ws):
    wins = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    covered = {j for i in range(len(ws) - 7) if wins[tuple(ws[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(covered)


def test_ledger_against_brute_force(spark):
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(0, 60))) for _ in range(150)] + [None, "", " \t ", "# $ % a", "ABC!! DEF!!", "a\na\n\na", "word " * 30_000, "é" * 40]
    got = {r.doc_id: r for r in quality_rules.ledger(docs(spark, *texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ws = (t or "").split()
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words) == (len(ws), sum(map(len, ws)), slow_repeats(ws)), t
    assert got[150].failures & quality_rules.BIT["few_words"]


def test_policies_and_ablation(spark):
    led = quality_rules.ledger(docs(spark, "aaa bbb ccc", "some words that are fine " * 1 + " ".join(f"w{i}" for i in range(30)), "LOUD WORDS!! " + " ".join(f"WORD{i}!!" for i in range(30))))
    kept = [r.kept for r in quality_rules.apply_policy(led).orderBy("doc_id").collect()]
    assert kept == [False, True, False]
    assert [r.kept for r in quality_rules.apply_policy(led, quality_rules.BASE).orderBy("doc_id").collect()] == [False, True, True]
    table = {r.rule: (r.failed, r.sole) for r in quality_rules.ablation(led).collect()}
    assert table["few_words"] == (1, 1) and table["shouting"] == (1, 0) and table["symbols"] == (0, 0)
    empty = quality_rules.ledger(docs(spark, "x").limit(0))
    assert {(r.failed, r.sole) for r in quality_rules.ablation(empty).collect()} == {(0, 0)}


def slow_dedup(texts):
    seen, out = set(), []
    for t in texts:
        if t is None:
            out.append((0, 0, None))
            continue
        lines = t.split("\n")
        at = [i for i, x in enumerate(lines) if x.strip(" \t\n\x0b\f\r")]
        gone = set()
        for k in range(len(at) - 2):
            w = tuple(lines[at[j]].strip(" \t\n\x0b\f\r") for j in range(k, k + 3))
            if w in seen:
                gone |= set(range(at[k], at[k + 2] + 1))
            seen.add(w)
        out.append((len(at), sum(i in gone for i in at), "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(2)
    texts = ["\n".join(rng.choice(["a", "b", " a ", "", "c", "dd", "0xf", "\x0b\t"]) for _ in range(rng.randrange(1, 14))) for _ in range(120)] + [None, "", "x", "a\nb", "\n\n", "same\n" * 5000]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.dedup(docs(spark, *texts)).collect()}
    assert [got[i] for i in range(len(texts))] == slow_dedup(texts)


def test_line_dedup_keeps_columns_and_repeated_rows(spark):
    df = docs(spark, "a\nb\nc")
    out = line_dedup.dedup(df.unionByName(df)).collect()
    assert len(out) == 2 and all(r.text == "a\nb\nc" and r.source == "s" for r in out)
    assert line_dedup.dedup(df.limit(0)).count() == 0
    null = spark.createDataFrame([(None, "p\nq\nr"), (1, "p\nq\nr")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in line_dedup.dedup(null).collect()} == {None: "p\nq\nr", 1: ""}


@pytest.mark.parametrize("n", [1, 2, 7, 100])
def test_permutation(spark, n):
    df = spark.range(n).select("id", F.expr(permuted("id", f"{n}L", "5L")).alias("y"))
    df = df.withColumn("z", F.expr(permuted("y", f"{n}L", "5L", inverse=True)))
    rows = df.collect()
    assert sorted(r.y for r in rows) == list(range(n)) and all(r.z == r.id for r in rows)


def test_matrix_margins_and_law(spark):
    total = []
    for seed in range(12):
        sizes = spark.createDataFrame([(0, 30), (1, 0), (2, 50), (3, 20)], "row int, n long")
        caps = spark.createDataFrame([([40, 60],)], "caps array<long>")
        rows = {r.row: r for r in draws.matrix(sizes, caps, 2, seed).collect()}
        assert [sum(rows[i].counts) for i in range(4)] == [30, 0, 50, 20]
        assert [sum(rows[i].counts[j] for i in range(4)) for j in range(2)] == [40, 60]
        assert list(rows[3].offsets) == [sum(rows[i].counts[j] for i in range(3)) for j in range(2)]
        total.append(rows[2].counts[0])
    assert 16 < sum(total) / len(total) < 24 and len(set(total)) > 3


def test_matrix_in_tiers(spark, monkeypatch):
    """A tree deeper than one array of sizes has the same margins."""
    monkeypatch.setattr(draws, "TIER", 2)
    n = {i: (i * 7) % 5 for i in range(32) if i % 9}
    sizes = spark.createDataFrame(list(n.items()), "row int, n long")
    total = sum(n.values())
    caps = spark.createDataFrame([([total // 3, total - total // 3],)], "caps array<long>")
    rows = {r.row: r for r in draws.matrix(sizes, caps, 5, 3).collect()}
    assert {i: sum(r.counts) for i, r in rows.items()} == {i: n.get(i, 0) for i in range(32)}
    for i in range(32):
        assert list(rows[i].offsets) == [sum(rows[k].counts[j] for k in range(i)) for j in range(2)]
    assert [sum(r.counts[j] for r in rows.values()) for j in range(2)] == [total // 3, total - total // 3]


def test_univariate_law(spark):
    n = 4000
    got = Counter(r.x for r in spark.range(n).select(F.expr(draws.univariate("10L", "4L", "5L", "9L, id")).alias("x")).collect())
    from math import comb

    for k in range(5):
        want = n * comb(4, k) * comb(6, 5 - k) / comb(10, 5)
        assert abs(got[k] - want) < 5 * want**0.5 + 5


def test_sharding(spark):
    df = docs(spark, *[f"text {i}" for i in range(237)], None, "", "same", "same")
    out = sharding.shard(df, 7, key=["doc_id"], bucket_rows=20).collect()
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(r.doc_id for r in out) == list(range(241))
    assert len(by) == 7 and all(sorted(s) == list(range(len(s))) for s in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(df.repartition(5), 7, key=["doc_id"], bucket_rows=20).collect()}
    assert again == {r.doc_id: (r.shard, r.slot) for r in out}
    assert sharding.shard(df.limit(0), 7).count() == 0 and sharding.shard(df.limit(2), 7).count() == 2


def test_sharding_spreads_a_repeated_id(spark):
    df = spark.createDataFrame([(7 if i % 4 else i, f"text {i}") for i in range(200)], "doc_id long, text string")
    out = sharding.shard(df, 5, bucket_rows=10).collect()
    assert sorted((r.doc_id, r.text) for r in out) == sorted((r.doc_id, r.text) for r in df.collect())
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(40)) for s in range(5))


def test_sharding_spreads_equal_rows(spark):
    """Two thirds of the rows are equal in all columns; no bucket gets many more than it should hold."""
    df = spark.range(300).selectExpr("if(id < 200, 7L, id) AS doc_id", "if(id < 200, 'same', string(id)) AS text").repartition(3)
    seen, matrix = [], sharding.draws.matrix
    sharding.draws.matrix = lambda sizes, *more: seen.append(max(r.n for r in sizes.collect())) or matrix(sizes, *more)
    try:
        for key in (None, ["doc_id"]):
            out = sharding.shard(df, 7, key=key, bucket_rows=20).collect()
            assert sorted((r.doc_id, r.text) for r in out) == sorted((r.doc_id, r.text) for r in df.collect())
            assert all(sorted(r.slot for r in out if r.shard == s) == list(range(43 if s < 6 else 42)) for s in range(7))
    finally:
        sharding.draws.matrix = matrix
    assert max(seen) < 60


def test_sharding_is_uniform(spark):
    df = spark.range(60).select(F.col("id").alias("doc_id"))
    hits = Counter()
    for seed in range(20):
        hits.update(r.shard for r in sharding.shard(df, 3, seed=seed * 10 + 1, bucket_rows=16).filter("doc_id < 6").collect())
    assert all(22 <= hits[s] <= 60 for s in range(3))


def test_sharding_digest(spark, tmp_path):
    docs(spark, "é", None).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in sharding.op4_sharding(spark, str(tmp_path)).collect()}
    assert (rows[0].size, rows[0].text_crc32, rows[1].size, rows[1].text_crc32) == (18, zlib.crc32("é".encode()), 16, 0)


def test_licences_on_held_out_examples():
    rows = license_scan.examples(77)
    hits = [license_scan.predict(t) for _, t in rows]
    assert sum(h[0] == f for h, (f, _) in zip(hits, rows, strict=True)) / len(rows) > 0.97
    # Calibration: what is said to be sure is right as often as said.
    sure = [(h[1], h[0] == f) for h, (f, _) in zip(hits, rows, strict=True)]
    assert abs(sum(p for p, _ in sure) / len(sure) - sum(ok for _, ok in sure) / len(sure)) < 0.03


def slow_scan(docs, corpus):
    """Spans by identify, paragraph by paragraph."""
    out = []
    for i, text in docs:
        spans = []
        for first, last, t in license_scan.paragraphs(text or ""):
            family, p, sure = license_scan.identify(t, 1, corpus)
            if family == license_scan.NONE:
                continue
            overlap = license_scan.evidence(t, license_scan.predict(t, 1, corpus)[0])[1]
            if spans and spans[-1][1] == first - 1 and spans[-1][2] == family:
                f, _, _, q, o, s = spans.pop()
                spans.append((f, last, family, max(p, q), max(overlap, o), s or sure))
            else:
                spans.append((first, last, family, p, overlap, sure))
        out += [(i, *s) for s in spans]
    return out


#: Notices of licences that no family here is.
FOREIGN = (
    "SPDX-License-Identifier: EPL-2.0", "Licensed under the Boost Software License, Version 1.0.", "This program is licensed under the Artistic License 2.0.", "SPDX-License-Identifier: EUPL-1.2", "Released under the zlib License.",
    "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which is available at https://www.eclipse.org/legal/epl-2.0/", "SPDX-License-Identifier: OFL-1.1", "SPDX-License-Identifier: Unlicense",
    "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "Licensed under the PostgreSQL License.",
    "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions", "Licensed under the Open Software License version 3.0",
    "Licensed under the EUPL, Version 1.2 or as soon they will be approved by the European Commission subsequent versions of the EUPL (the Licence); You may not use this work except in compliance with the Licence.", "Academic Free License version 2.1",
    "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)", "Released under the Python Software Foundation License Version 2.",
    "This work may be distributed and/or modified under the conditions of the LaTeX Project Public License, either version 1.3 of this license or (at your option) any later version.", "Licensed under the Educational Community License, Version 2.0",
    "The contents of this file are subject to the terms of the Common Development and Distribution License (the License).", "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "You may not use this file except in compliance with the License. You can obtain a copy of the license at https://opensource.org/licenses/CDDL-1.0", "Microsoft Public License (Ms-PL). This license governs use of the accompanying software.",
)


def test_licences_of_other_families_are_not_named(spark):
    """Of notices of licences that are not known, one at most is named and none is confirmed; what is known is."""
    known = [(f, s) for f, ss in license_scan.TEMPLATES.items() for s in ss]
    rows = [f"Some prose.\n{s}\nSome more." for s in (*FOREIGN, *(s for _, s in known))]
    got = {r.doc_id: r for r in license_scan.scan(docs(spark, *rows)).collect()}
    named = [i for i in range(len(FOREIGN)) if i in got and got[i].family != license_scan.UNKNOWN]
    assert len(named) <= 1 and not any(r.confirmed for i, r in got.items() if i < len(FOREIGN))
    assert sum(i in got and got[i].family == license_scan.UNKNOWN for i in range(len(FOREIGN))) >= 12
    right = [got[len(FOREIGN) + i].family == f and got[len(FOREIGN) + i].confirmed for i, (f, _) in enumerate(known) if len(FOREIGN) + i in got]
    assert len(right) == len(known) and all(right)


def test_licence_scan_against_brute_force(spark):
    """Whole documents of the corpus, with notices wrapped, split and set among prose, against a loop over paragraphs."""
    rng = random.Random(3)
    base = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(120).collect()]
    for _ in range(60):
        s = rng.choice([x for ss in license_scan.TEMPLATES.values() for x in ss])
        wrapped = "\n".join(textwrap.wrap(s, rng.choice([30, 50, 72, 400])))
        base.append("\n".join(rng.sample([rng.choice(base) or "", wrapped, "", "His driving license.", "no end", wrapped], rng.randrange(1, 7))))
    base += [None, "", "\n\n", "Released under the MIT License.\nReleased under the MIT License.", "x " * 20_000 + ".\nReleased under the MIT License."]
    df = docs(spark, *base)
    corpus = license_scan.sample(df)
    got = sorted((r.doc_id, r.first_line, r.last_line, r.family, r.probability, r.overlap, r.confirmed) for r in license_scan.scan(df).collect())
    want = sorted(slow_scan(list(enumerate(base)), corpus))
    assert [g[:4] for g in got] == [w[:4] for w in want] and len(want) > 60
    assert all(abs(g[k] - w[k]) < 1e-4 for g, w in zip(got, want, strict=True) for k in (4, 5)) and [g[6] for g in got] == [w[6] for w in want]


def test_licences_among_corpus_prose(spark):
    """Fitted on some documents, the classifier is right and calibrated on notices set among the prose of others, wrapped or not."""
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("text is not null").orderBy("doc_id").limit(700).collect()]
    corpus, other = tuple(texts[:400]), tuple(license_scan.plain_paragraphs(texts[400:]))
    rows = license_scan.examples(77, other)
    hits = [license_scan.predict(t, 1, corpus) for _, t in rows]
    assert sum(h[0] == f for h, (f, _) in zip(hits, rows, strict=True)) / len(rows) > 0.99
    assert abs(sum(p for _, p in hits) / len(hits) - sum(h[0] == f for h, (f, _) in zip(hits, rows, strict=True)) / len(rows)) < 0.01
    for family, sentences in license_scan.TEMPLATES.items():
        for s in sentences:
            for width in (40, 72):
                page = "prose here.\n" + "\n".join(textwrap.wrap(s, width)) + "\nmore prose"
                found = {f for _, _, t in license_scan.paragraphs(page) for f, p in [license_scan.predict(t, 1, corpus)] if f != license_scan.NONE and p >= 0.5}
                assert found == {family}, page


def test_licence_scan(spark):
    texts = ["intro words.\nLicensed under the Apache License, Version 2.0.\nmore", "nothing here\nhis driving license", None, "", "Released under the MIT License.\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", "x " * 20_000 + ".\nReleased under the MIT License.", "intro words\nLicensed under the Apache\nLicense, Version 2.0.\nmore"]
    got = {r.doc_id: r for r in license_scan.scan(docs(spark, *texts)).collect()}
    assert {i: (r.family, r.first_line, r.last_line, r.confirmed) for i, r in got.items()} == {0: ("apache", 1, 1, True), 4: ("mit", 0, 1, True), 5: ("mit", 1, 1, True), 6: ("apache", 0, 2, True)}
    assert license_scan.scan(docs(spark, "x").limit(0)).count() == 0
    family, probability = license_scan.predict("Licensed under the Apache License, Version 2.0.")
    assert family == "apache" and probability > 0.9
