"""Licence notices in documents, by a trained paragraph classifier (operator 10, SQL functions only on the data's path).

A multinomial logistic regression over word unigrams and bigrams names the family of each paragraph, with a class for text
that is no licence, fitted on a bounded sample of the corpus's own paragraphs, and a temperature fitted on others that were
held out, so that probabilities can be read as such. What it names is compared with the family's templates: a second, small
regression, on how much of a template is there, how much of the paragraph it is, and the n-grams that tell the family from
all others, says whether it is that family or one that is not known. It is fitted by leaving families out: each one's
sentences, without that class or with its telling words replaced, are examples of the class unknown. Neighbouring
paragraphs of one family become one span. The model is fitted on the driver, a few thousand numbers; documents
only ever meet it as a small table of weights.

A paragraph is a run of lines up to one that ends a sentence or comes before a blank one, so a wrapped sentence is one
paragraph, and a notice on a line of its own under prose is another.
"""

from __future__ import annotations

import json
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import set_aside

NONE, UNKNOWN = "none", "unknown"
THRESHOLD = 0.5
#: Share of a template's bigrams that a paragraph must hold to confirm its family; a part of a template, so many bigrams that are nearly all of the paragraph.
CONFIRM, PART, OWN = 0.6, 8, 0.8
#: Examples made from each template sentence, and of text that is no licence.
PER_SENTENCE, NEGATIVES = 24, 1500
#: What the class of no licence is fitted and calibrated on: paragraphs of about so many documents, drawn by hash, so many at most, and so many characters of each.
FIT_ROWS, FIT_PARAGRAPHS, FIT_CHARS = 600, 20_000, 1000
#: Words of a notice that may name a family, at most.
NOTICE = 15
#: How a line ends that ends a paragraph.
ENDS = r"[.!?:;][)\]\"']?[ \t\r]*$"
BLANK = r"^[ \t\r\x0b\x0c]*$"
# Stems of which one marks a paragraph that may be a notice, so that it is no example of other text.
MARKS = ("licen", "copyright", "spdx", "redistribut", "permi", "creativecommons", "cc by", "cc0", "rights reserved", "public domain", "warrant", "copies", "source code", "mozilla", "waive")

# Sentences of the licences themselves and of the usual notices.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "Released under the GPL version 2.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "agpl": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.",
    ),
    "isc": (
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "https://creativecommons.org/licenses/by/4.0/",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "https://creativecommons.org/licenses/by-sa/4.0/",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "https://creativecommons.org/licenses/by-nc/4.0/",
    ),
    "cc0": (
        "Released into the public domain under CC0 1.0 Universal.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    "reserved": (
        "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.",
        "Copyright 2020 Example Inc. All rights reserved.",
    ),
}
# Words too common to be evidence alone, and text that is near to licences in words only.
STOP = frozenset("a an and any are as at be by for from if in is it its may must no not of on one or other shall should such that the this to under use used using was were will with without you your all can have has http https www org com".split())
NEAR = (
    "He lost his driving license and needed permission from the court to travel.",
    "The warranty covers parts and labour for two years from the date of purchase.",
    "Please keep a copy of the receipt; the software update will be distributed next week.",
    "Students may modify the experiment as long as the conditions are met.",
    "The commons was open to the public and the general manager gave notice of the meeting.",
    "The foundation is free of charge for any person under the age of twelve.",
    "The source of the river and its terms of access are described in the second version of the map.",
    "Her work on attribution in international law won a creative prize.",
    "Rights of way must be retained by the holder of the land.",
    "A binary star system in which material is provided by the larger star.",
    "The company published the list of contributors without prior written consent.",
    "We obtained the files and associated documentation from the library.",
)
_PLAIN = "time year people way day thing man world life hand part child eye woman place work week case point company number group problem fact water river music garden table window city bread summer winter teacher doctor train road market house paper letter story question answer".split()
TOKEN = "[^a-z0-9.]+"


def tokens(text: str) -> list[str]:
    """Lower-case words of letters, digits and dots, without dots at either end; the same as ``token_sql``."""
    return [w for t in re.split(TOKEN, text.lower()) if (w := t.strip("."))]


def token_sql(c: str) -> str:
    return f"filter(transform(split(lower({c}), '{TOKEN}'), w -> trim(both '.' from w)), w -> w != '')"


def grams(words: list[str]) -> set[str]:
    return {w for w in words if w not in STOP} | {f"{a} {b}" for a, b in zip(words, words[1:], strict=False) if a not in STOP or b not in STOP}


def paragraphs(text: str) -> list[tuple[int, int, str]]:
    """(first line, last line, text) of a text's paragraphs with a word, lines from 0; the same as ``paragraph_sql``."""
    lines = text.split("\n")
    blank = [re.search(BLANK, x) is not None for x in lines]
    starts = [p for p in range(len(lines)) if p == 0 or blank[p] or blank[p - 1] or re.search(ENDS, lines[p - 1])]
    return [(p, q - 1, " ".join(lines[p:q])) for p, q in zip(starts, [*starts[1:], len(lines)], strict=True) if not blank[p]]


def paragraph_sql(lines: str) -> str:
    """SQL for an array of struct(first, last, text): the paragraphs of an array of lines."""
    ends, blank = (x.replace("\\", "\\\\").replace("'", "\\'") for x in (ENDS, BLANK))
    starts = f"filter(sequence(0, size({lines}) - 1), p -> p = 0 or {lines}[p] rlike '{blank}' or {lines}[p - 1] rlike '{blank}' or {lines}[p - 1] rlike '{ends}')"
    last = f"coalesce(get(z, k + 1), size({lines})) - 1"
    return f"transform(array({starts}), z -> transform(z, (s, k) -> named_struct('first', s, 'last', {last}, 'text', array_join(slice({lines}, s + 1, {last} - s + 1), ' '))))[0]"


def plain_paragraphs(texts: list[str]) -> list[str]:
    """Paragraphs of texts without a mark of licences, as examples of other text."""
    return [t for x in texts for _, _, t in paragraphs(x) if not any(m in t.lower() for m in MARKS)]


def examples(seed: int, corpus: tuple[str, ...] = ()) -> list[tuple[str, str]]:
    """(family, text) pairs: sentences with words dropped, cut or set among others, years changed; and text of no family. corpus: paragraphs of no family, in which sentences are set, too."""
    r = random.Random(seed)
    noise = lambda k: " ".join(r.choice(_PLAIN) for _ in range(k))

    def prose(most: int) -> str:
        ws = r.choice(corpus).split() if corpus else []
        at = r.randrange(max(1, len(ws) - most))
        return " ".join(ws[at : at + r.randrange(most + 1)]) if ws else noise(r.randrange(most + 1))

    out = []
    for family, sentences in TEMPLATES.items():
        for s in sentences:
            words = s.split()
            for i in range(PER_SENTENCE):
                w = [x for x in words if i == 0 or r.random() > 0.08 or len(words) < 6]
                if i % 4 == 3 and len(w) > 12:
                    at = r.randrange(len(w) - 10)
                    w = w[at : at + r.randrange(10, len(w) - at + 1)]
                text = " ".join(w).replace("2020", str(r.randrange(1990, 2030)))
                if i % 3 == 1:
                    text = f"{noise(r.randrange(6))} {text} {noise(r.randrange(8))}"
                elif i % 3 == 2:
                    text = f"{prose(60)} {text} {prose(30)}"
                out.append((family, text))
    for i in range(NEGATIVES):
        near = r.choice(NEAR).split()
        kind = i % 3
        text = noise(r.randrange(3, 30)) if kind == 0 else " ".join(x for x in near if r.random() > 0.15) if kind == 1 else f"{' '.join(near[: r.randrange(1, len(near))])} {noise(r.randrange(10))}"
        out.append((NONE, text))
    return out + [(NONE, t) for t in corpus]


@lru_cache(maxsize=4)
def model(seed: int = 1, corpus: tuple[str, ...] = ()) -> tuple[tuple[str, ...], dict[str, list[float]], list[float]]:
    """(families, weights by n-gram, biases), scaled by the temperature; fitted by gradient descent on examples.

    Of corpus (texts of documents) every other one's paragraphs serve the fit, the rest the temperature.
    """
    families = (*TEMPLATES, NONE)
    train, held = (examples(seed + i, tuple(plain_paragraphs(list(corpus[i::2])))) for i in (0, 1))
    vocabulary = sorted({g for sentences in (*TEMPLATES.values(), NEAR) for s in sentences for g in grams(tokens(s))})
    column = {g: i for i, g in enumerate(vocabulary)}

    k = len(families)

    def design(rows):
        """(row, column) of the n-grams there are, and the class of each row: few of many, so nothing is as large as rows times columns."""
        at = [[column[g] for g in grams(tokens(text)) if g in column] for _, text in rows]
        return np.repeat(np.arange(len(rows)), [len(a) for a in at]), np.array([c for a in at for c in a], np.int64), np.array([families.index(f) for f, _ in rows])

    def scores(r, c, n, w, b):
        return np.stack([np.bincount(r, w[c, i], n) for i in range(k)], axis=1) + b

    r, c, y = design(train)
    onehot = np.eye(k)[y]
    share = (len(y) / k / onehot.sum(axis=0)[y])[:, None]
    w, b = np.zeros((len(column), k)), np.zeros(k)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    b[-1] = 1
    for _ in range(200):
        z = scores(r, c, len(y), w, b)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        g = (p - onehot) * share / len(y)
        vw = 0.9 * vw + np.stack([np.bincount(c, g[r, i], len(column)) for i in range(k)], axis=1) + 1e-4 * w
        vb = 0.9 * vb + g.sum(axis=0)
        w, b = w - 2 * vw, b - 2 * vb
    rh, ch, yh = design(held)
    z = scores(rh, ch, len(yh), w, b)

    def loss(t):
        s = z / t
        return float(np.mean(np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1)) + s.max(axis=1) - s[np.arange(len(yh)), yh]))

    t = min((0.25 * 1.15**k for k in range(25)), key=loss)
    keep = np.abs(w).max(axis=1) > 1e-3
    weights = {g: [round(float(v) / t, 5) for v in w[i]] for g, i in column.items() if keep[i]}
    return families, weights, [round(float(v) / t, 5) for v in b]


def _scores(text: str, seed: int, corpus: tuple[str, ...]) -> np.ndarray:
    _, weights, bias = model(seed, corpus)
    return np.array(bias) + sum((np.array(weights[g]) for g in grams(tokens(text)) if g in weights), np.zeros(len(bias)))


def predict(text: str, seed: int = 1, corpus: tuple[str, ...] = ()) -> tuple[str, float]:
    """The likeliest of the families and none, and its probability, of one text, on the driver; the same law as ``score``."""
    s = _scores(text, seed, corpus)
    p = np.exp(s - s.max())
    return model(seed, corpus)[0][int(p.argmax())], float(p.max() / p.sum())


def pairs(words: list[str]) -> list[str]:
    """The distinct bigrams of words, in order."""
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


@lru_cache(maxsize=1)
def telling() -> dict[str, list[str]]:
    """The n-grams of each family's notices that no other family's sentences have, nor text that is near to licences: those of two sentences or more, or all if there are none."""
    every = {f: {g for s in ss for g in grams(tokens(s))} for f, ss in TEMPLATES.items()}
    near = {g for s in NEAR for g in grams(tokens(s))}
    out = {}
    for f, ss in TEMPLATES.items():
        short = {g for s in ss if len(tokens(s)) <= NOTICE for g in grams(tokens(s)) if not re.search(r"\d{4}", g)}
        own = short - near - set().union(*(g for o, g in every.items() if o != f))
        twice = {g for g in own if sum(g in grams(tokens(s)) for s in ss) > 1}
        out[f] = sorted(twice or own)
    return out


def templates(family: str) -> list[tuple[list[str], bool]]:
    """(bigrams, whether it has a telling n-gram) of a family's sentences."""
    return [(pairs(tokens(s)), bool({*tokens(s), *pairs(tokens(s))} & set(telling()[family]))) for s in TEMPLATES[family]]


def evidence(text: str, family: str) -> tuple[float, ...]:
    """(telling n-grams, share of a template, share of the paragraph, common bigrams, whether the likest template tells its family and the text doesn't) of a text for a family, each from 0 to 1; the same as ``evidence_sql``."""
    words = tokens(text)
    own = set(pairs(words))
    common = [(len(own & set(t)), len(t), tells) for t, tells in templates(family)]
    told = len({*words, *own} & set(telling()[family]))
    most = max(n for n, _, _ in common)
    absent = not told and next(tells for n, _, tells in common if n == most)
    return min(told, 2) / 2, max(n / max(1, m) for n, m, _ in common), most / max(1, len(own)), min(most, 2 * PART) / (2 * PART), float(absent)


def evidence_sql() -> str:
    """SQL for an array of the five figures, from words, _own (bigrams), told (the family's telling n-grams), t (bigrams of its templates) and tells (which of them have one)."""
    told = "size(array_intersect(concat(words, _own), told))"
    common = "transform(t, x -> size(array_intersect(_own, x)))"
    figures = f"array(least(s.told, 2) / 2d, array_max(zip_with(s.c, t, (n, x) -> n / greatest(1, size(x)))), array_max(s.c) / greatest(1, size(_own)), least(array_max(s.c), {2 * PART}) / {2 * PART}d, if(s.told = 0 and element_at(tells, cast(array_position(s.c, array_max(s.c)) as int)), 1d, 0d))"
    return f"transform(array(named_struct('told', {told}, 'c', {common})), s -> {figures})[0]"


@lru_cache(maxsize=4)
def knowledge(seed: int = 1, corpus: tuple[str, ...] = ()) -> list[float]:
    """Weights of the five figures, and a bias, for the odds that a paragraph is of the family it looks most like and not of one that is not known.

    Examples of families as they are are known. Unknown: the same without their class, so that another is named; and with
    their telling words replaced by names that no family has.
    """
    families = model(seed, corpus)[0]
    r = random.Random(seed + 7)
    name = lambda: "".join(r.choice("bdfgklmnprstvz") + r.choice("aeiou") for _ in range(r.randrange(1, 4)))
    words = {f: {w for g in told for w in g.split()} - STOP - {x for o, ss in TEMPLATES.items() if o != f for s in ss for x in tokens(s)} for f, told in telling().items()}
    rows: list[tuple[tuple, bool]] = []

    def best(text: str, but: str | None) -> str:
        s = _scores(text, seed, corpus)
        return max((f for f in families if f not in (NONE, but)), key=lambda f: s[families.index(f)])

    for family, text in examples(seed + 5):
        if family == NONE:
            continue
        rows.append((evidence(text, family), True))
        rows.append((evidence(text, best(text, family)), False))
        renamed = re.sub("[A-Za-z]+", lambda m: name() if m[0].lower() in words[family] else m[0], text)
        if renamed != text and len(tokens(text)) <= 2 * NOTICE:
            rows += [(evidence(renamed, best(renamed, None)), False)] * 2
    x = np.array([(*f, 1.0) for f, _ in rows])
    y = np.array([k for _, k in rows], float)
    w, each = np.zeros(6), np.where(y > 0, (y < 1).sum() / y.sum(), 1.0)  # known and unknown weigh the same
    for _ in range(30):  # Newton's method with a little shrinkage
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (each * q * (1 - q))[:, None]).T @ x + 0.05 * np.eye(6)
        w -= np.linalg.solve(h, x.T @ (each * (q - y)) + 0.05 * w)
    return [round(float(v), 5) for v in w]


def identify(text: str, seed: int = 1, corpus: tuple[str, ...] = ()) -> tuple[str, float, bool]:
    """(family, unknown or none, its probability, whether it is confirmed) of one text, on the driver; the same law as ``scan``."""
    family, p = predict(text, seed, corpus)
    if family == NONE or p < THRESHOLD:
        return NONE, p, False
    *w, b = knowledge(seed, corpus)
    told, template, own, common, _ = figures = evidence(text, family)
    q = 1 / (1 + np.exp(-(sum(a * c for a, c in zip(w, figures, strict=True)) + b)))
    sure = q >= 0.5 and (template >= 1 or (template >= CONFIRM and (told > 0 or common >= 0.5)) or (common >= 0.5 and own >= OWN))
    return (family, p * q, bool(sure)) if q >= 0.5 else (UNKNOWN, p * (1 - q), False)


def _table(df: DataFrame, rows: list, schema: str) -> DataFrame:
    """A small table from a literal."""
    return df.sparkSession.range(1).select(F.explode(F.from_json(F.lit(json.dumps(rows)), schema)).alias("x")).select("x.*")


def sample(docs: DataFrame, text: str = "text", fit_rows: int = FIT_ROWS, fit_paragraphs: int = FIT_PARAGRAPHS) -> tuple[str, ...]:
    """Paragraphs, in order, of about fit_rows rows of docs, fit_paragraphs and FIT_CHARS of each at most: rows and paragraphs are drawn by their hash, so all of docs has the same share. Null texts have no part."""
    rows = docs.select(F.col(text).alias("_t"), F.xxhash64(*docs.columns).alias("_h"))
    share = min(1.0, fit_rows / max(1, docs.count()))
    some = rows.filter(F.col("_t").isNotNull() & ((F.col("_h").bitwiseAND(2**31 - 1)) < int(share * 2**31)))
    parts = some.select(F.split("_t", "\n").alias("_lines")).select(F.explode(F.expr(paragraph_sql("_lines"))).alias("x")).select(F.substring("x.text", 1, FIT_CHARS).alias("_p"))
    return tuple(sorted(r[0] for r in parts.orderBy(F.xxhash64("_p"), "_p").limit(fit_paragraphs).collect()))


def score(docs: DataFrame, text: str = "text", seed: int = 1, fit_rows: int = FIT_ROWS, corpus: tuple[str, ...] | None = None) -> DataFrame:
    """_id (of the row), doc_id, first_line, last_line (int, from 0), words, family, probability for each paragraph with an n-gram of the model.

    A paragraph without any of the model's single words has none of its n-grams either, and belongs to no family. Null and
    empty texts have no paragraphs; repeated rows have theirs each; a null doc_id stays null. Other columns of docs are
    passed over, whatever they are called.
    """
    rows, at = set_aside(docs, "doc_id", text)
    families, weights, bias = model(seed, sample(rows, at[text], fit_rows) if corpus is None else corpus)
    single = sorted({w for g in weights for w in g.split(" ") if w not in STOP})
    listed = ", ".join("'" + w.replace("'", "''") + "'" for w in single)
    stop = ", ".join(f"'{w}'" for w in sorted(STOP))
    held = f"filter(transform({paragraph_sql('_lines')}, x -> named_struct('first_line', x.first, 'last_line', x.last, 'words', {token_sql('x.text')})), x -> exists(x.words, w -> w in ({listed})))"
    # The id is given to rows before they are taken apart, so it names a document.
    rows = rows.select(F.monotonically_increasing_id().alias("_id"), F.col(at["doc_id"]).alias("doc_id"), F.split(at[text], "\n").alias("_lines")).filter("_lines IS NOT NULL")
    found = rows.select("_id", "doc_id", F.explode(F.expr(held)).alias("x")).select("_id", "doc_id", "x.*")
    gram = f"array_distinct(concat(filter(words, w -> w not in ({stop})), transform(filter(sequence(1, greatest(1, size(words) - 1)), i -> size(words) > 1 and not (words[i - 1] in ({stop}) and words[i] in ({stop}))), i -> concat(words[i - 1], ' ', words[i]))))"
    each = found.select("_id", "doc_id", "first_line", "last_line", "words", F.explode(F.expr(gram)).alias("g"))
    w = F.broadcast(_table(docs, [{"g": g, "w": v} for g, v in weights.items()], "array<struct<g: string, w: array<double>>>"))
    sums = [F.sum(F.col("w")[i]).alias(f"_{i}") for i in range(len(families))]
    summed = each.join(w, "g").groupBy("_id", "first_line").agg(F.first("doc_id").alias("doc_id"), F.first("last_line").alias("last_line"), F.first("words").alias("words"), *sums)
    z = F.array(*[F.struct((F.col(f"_{i}") + bias[i]).alias("z"), F.lit(f).alias("family")) for i, f in enumerate(families)])
    best = summed.withColumn("_z", z).withColumn("_m", F.array_max("_z"))
    share = F.expr("1 / aggregate(_z, 0d, (s, x) -> s + exp(x.z - _m.z))")
    return best.select("_id", "doc_id", "first_line", "last_line", "words", F.col("_m.family").alias("family"), F.round(share, 6).alias("probability"))


def scan(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD, confirm: float = CONFIRM, seed: int = 1, fit_rows: int = FIT_ROWS) -> DataFrame:
    """The licence notices of docs: doc_id, first_line, last_line (int, from 0), family, probability, overlap, confirmed.

    A paragraph counts if its family is not none at threshold or more. family is unknown for one that looks like a licence
    but is none of those that are known; probability is that of what is named. overlap: the largest share of a template's
    bigrams, of the family it looks most like, that the paragraph holds. confirmed: of a known family, with a
    whole template, or with confirm of one or more and a telling n-gram or PART bigrams in common, or a part of a template of so many bigrams that is
    nearly all of the paragraph. Neighbouring paragraphs of a family are one span, with the largest figures. Null and empty
    texts have no notice; repeated rows give repeated spans. About fit_rows rows of docs are read to fit the model; all rows
    are scanned.
    """
    rows, at = set_aside(docs, "doc_id", text)
    corpus = sample(rows, at[text], fit_rows)
    hit = score(docs, text, seed, fit_rows, corpus).filter((F.col("family") != NONE) & (F.col("probability") >= threshold))
    table = [{"family": f, "told": telling()[f], "t": [p for p, _ in templates(f)], "tells": [x for _, x in templates(f)]} for f in TEMPLATES]
    t = F.broadcast(_table(docs, table, "array<struct<family: string, told: array<string>, t: array<array<string>>, tells: array<boolean>>>"))
    own = F.expr("if(size(words) > 1, array_distinct(transform(sequence(1, size(words) - 1), i -> concat(words[i - 1], ' ', words[i]))), cast(array() as array<string>))")
    hit = hit.withColumn("_own", own).join(t, "family").withColumn("_e", F.expr(evidence_sql()))
    *w, b = knowledge(seed, corpus)
    odds = sum((F.col("_e")[i] * v for i, v in enumerate(w)), F.lit(b))
    hit = hit.withColumn("_q", 1 / (1 + F.exp(-odds)))
    known, told, common = F.col("_q") >= 0.5, F.col("_e")[0] > 0, F.col("_e")[3] >= 0.5
    sure = known & ((F.col("_e")[1] >= 1) | ((F.col("_e")[1] >= confirm) & (told | common)) | (common & (F.col("_e")[2] >= OWN)))
    hit = hit.select("_id", "doc_id", "first_line", "last_line", F.when(known, F.col("family")).otherwise(UNKNOWN).alias("family"), F.round(F.col("probability") * F.when(known, F.col("_q")).otherwise(1 - F.col("_q")), 6).alias("probability"), F.round(F.col("_e")[1], 6).alias("overlap"), sure.alias("sure"))
    order = Window.partitionBy("_id").orderBy("first_line")
    new = F.when((F.lag("last_line").over(order) == F.col("first_line") - 1) & (F.lag("family").over(order) == F.col("family")), 0).otherwise(1)
    spans = hit.withColumn("_new", new).withColumn("_span", F.sum("_new").over(order)).groupBy("_id", "_span")
    out = spans.agg(F.first("doc_id").alias("doc_id"), F.min("first_line").alias("first_line"), F.max("last_line").alias("last_line"), F.first("family").alias("family"), F.max("probability").alias("probability"), F.max("overlap").alias("overlap"), F.max("sure").alias("confirmed"))
    return out.drop("_id", "_span")


def op10_license_scan(spark, sf_dir):
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


QUERIES = {"op10_license_scan": op10_license_scan}
SQL = {}
