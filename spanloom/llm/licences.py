"""Licence scans with DataFrame functions only.

A paragraph is a line of a text or, with ``rejoin``, a run of lines that one notice was wrapped over: a line of ``WRAPPED``
characters or more that ends in no punctuation goes on in the next one, whose comment marks are dropped; a blank line
ends a paragraph. A logistic regression over sparse word one- and two-grams tells licence families from each other and
from ordinary text. It is trained on the driver from the notices below, variants of them with words left out, and
ordinary paragraphs: the sentences below and, where given, a bounded sample of paragraphs (``sample_others``). Its
temperature is set by four models that each have not seen a quarter of the notices and paragraphs, with all their
variants, so that a probability of 0.5 separates known from unknown on unseen phrases. A prediction stands only if a
template of its family confirms it: at least ``CONFIRM`` of the template's two-grams are in the paragraph, or of the
paragraph's in the template. Else the family is ``unknown``.

Every paragraph that holds a feature with a positive weight for a family is scored and has a row, be it ``unknown``. One
without has no row and is ``unknown`` by the model: the weights of a feature sum to zero, so none of its features
speaks against ``unknown``, whose bias is the largest. Scoring is a projection without shuffle, so hot sources and
repeated lines cost no more than others. Null and empty texts have no paragraphs; an empty table gives an empty result.
Texts and paragraphs of any length are read whole. Repeated rows are reported for each; of two families that score alike
the first as listed wins. Other columns pass by name where asked for (``keep``), as long as no two of the output share a name.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONFIRM = 0.5
UNKNOWN = "unknown"
FEATURES = 1000
#: A line of this length that ends in no punctuation was wrapped.
WRAPPED = 40
#: Documents, and characters of each, that ordinary paragraphs are sampled from; paragraphs that are used.
SAMPLE_DOCUMENTS, SAMPLE_CHARS, SAMPLE = 400, 20_000, 1000

# Customary notices of licence families, as published by their stewards.
TEMPLATES = {
    "apache": (
        "licensed under the apache license version 2.0",
        "licensed under the apache license version 2.0 the license you may not use this file except in compliance with the license",
        "you may obtain a copy of the license at http www.apache.org licenses license-2.0",
        "spdx-license-identifier apache-2.0",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    "mit": (
        "released under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "this project is licensed under the mit license",
        "spdx-license-identifier mit",
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits",
        "released under the isc license",
        "spdx-license-identifier isc",
    ),
    "gpl": (
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",
        "you should have received a copy of the gnu general public license along with this program",
        "spdx-license-identifier gpl-3.0-or-later",
        "as published by the free software foundation either version 3 of the license or at your option any later version",
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details",
    ),
    "lgpl": (
        "licensed under the gnu lesser general public license version 2.1",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license",
        "spdx-license-identifier lgpl-2.1-only",
        "you should have received a copy of the gnu lesser general public license along with this library",
        "see the gnu lesser general public license for more details",
    ),
    "agpl": (
        "licensed under the gnu affero general public license version 3",
        "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation",
        "you should have received a copy of the gnu affero general public license along with this program",
        "spdx-license-identifier agpl-3.0-only",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted",
        "licensed under the bsd 3-clause license",
        "use of this source code is governed by a bsd-style license",
        "spdx-license-identifier bsd-3-clause",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed",
    ),
    "mpl": (
        "this source code form is subject to the terms of the mozilla public license v. 2.0",
        "licensed under the mozilla public license version 2.0",
        "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla.org mpl 2.0",
        "spdx-license-identifier mpl-2.0",
    ),
    "creative-commons": (
        "licensed under cc by-nc 4.0",
        "licensed under cc by 4.0",
        "licensed under cc by-sa 4.0",
        "this work is licensed under a creative commons attribution 4.0 international license",
        "except where otherwise noted this work is under a creative commons license",
    ),
    "public-domain": (
        "this is free and unencumbered software released into the public domain",
        "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non-commercial and by any means",
        "this work is dedicated to the public domain under cc0 1.0",
        "spdx-license-identifier unlicense",
    ),
    "proprietary": (
        "all rights reserved no part of this work may be reproduced without permission",
        "copyright all rights reserved",
        "confidential and proprietary unauthorized copying of this file is strictly prohibited",
    ),
}
# Sentences with licence words that grant nothing.
OTHERS = (
    "he lost his driving license on the way to the office",
    "the warranty of the car runs for two years from the date of sale",
    "she asked permission to leave the room early",
    "the copyright debate went on in parliament for years",
    "a license to sell wine was refused by the council",
    "the software was released last week under heavy rain",
    "you can use this copy of the book at home",
    "the version of events that the public heard was false",
    "the general public may visit the work on sundays",
    "the company licensed the patent to a rival",
    "free admission without charge to any person under twelve",
    "students at mit study physics and the apache tribe lives in the south",
)


def _grams(words: list[str]) -> set[str]:
    return set(words) | {f"{a} {b}" for a, b in zip(words, words[1:])}


def _words(text: str) -> list[str]:
    return re.findall(r"[a-z0-9.+-]*[a-z0-9+]", text.lower())


def _train(x: np.ndarray, y: np.ndarray, size: int, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of a multinomial logistic regression, by gradient steps."""
    w, b, hot = np.zeros((x.shape[1], size), np.float32), np.zeros(size, np.float32), np.eye(size, dtype=np.float32)[y]
    share = (weight / weight.sum())[:, None].astype(np.float32)
    for _ in range(200):
        z = x @ w + b
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - hot) * share
        w -= 4.0 * (x.T @ g + np.float32(1e-4) * w)
        b -= 4.0 * g.sum(axis=0)
    return w.astype(float), b.astype(float)


#: Figures of the last calibration: temperature, log loss and share of known phrases below 0.5 on unseen phrases.
CALIBRATION: dict[str, float] = {}


@lru_cache(maxsize=4)
def model(others: tuple[str, ...] = ()) -> tuple[list[str], list[str], np.ndarray, np.ndarray]:
    """(families with unknown last, features, weights, biases), divided by the temperature; ``others`` are more ordinary paragraphs."""
    rng = np.random.Generator(np.random.PCG64(11))
    names = [*TEMPLATES, UNKNOWN]
    rows: list[tuple[set[str], int, int]] = []
    phrase_no = 0
    for k, name in enumerate(names):
        for phrase in TEMPLATES.get(name, OTHERS):
            words = _words(phrase)
            for turn in range(12):
                kept = [w for w in words if turn == 0 or rng.random() < 0.85]
                rows.append((_grams(kept), k, phrase_no))
            phrase_no += 1
    rows += [(set(), len(names) - 1, phrase_no + i % 4) for i in range(24)]
    own: dict[str, int] = {}
    for g, k, _ in rows:
        for x in g:
            own[x] = own.get(x, 0) + 1
    rows += [(_grams(_words(t)), len(names) - 1, phrase_no + i) for i, t in enumerate(others)]
    features = sorted(sorted(own), key=lambda x: -own[x])[:FEATURES]
    place = {x: i for i, x in enumerate(features)}
    x = np.zeros((len(rows), len(features)), np.float32)
    for i, (g, _, _) in enumerate(rows):
        for f in g:
            if f in place:
                x[i, place[f]] = 1
    y, fold = np.array([k for _, k, _ in rows]), np.array([p % 4 for _, _, p in rows])
    weight = np.where(np.arange(len(rows)) < len(rows) - len(others), 1.0, 0.25)
    unseen = np.zeros((len(rows), len(names)))
    for part in range(4):
        w, b = _train(x[fold != part], y[fold != part], len(names), weight[fold != part])
        unseen[fold == part] = x[fold == part] @ w + b

    def loss(t: float) -> float:
        z = unseen / t
        z = z - z.max(axis=1, keepdims=True)
        return float(np.average(-(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))[np.arange(len(z)), y], weights=weight))

    heat = min((0.5, 0.7, 1.0, 1.4, 2.0, 3.0), key=loss)
    z = unseen / heat
    top = 1 / np.exp(z - z.max(axis=1, keepdims=True)).sum(axis=1)
    known = y < len(names) - 1
    taken = (z.argmax(axis=1) < len(names) - 1) & (top >= 0.5)
    CALIBRATION.update(temperature=heat, log_loss=loss(heat), known_called_unknown=float((~taken)[known].mean()), unknown_called_known=float(taken[~known].mean()))
    w, b = _train(x, y, len(names), weight)
    w -= w.mean(axis=1, keepdims=True)  # the weights of a feature sum to zero
    return names, features, w / heat, b / heat


def _array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _numbers(values, kind: str) -> Column:
    """A constant array of many numbers, sent as one text, which the optimizer turns into an array once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _adder(column: Column):
    return lambda total, i: total + F.element_at(column, i)


def speaking(others: tuple[str, ...] = ()) -> list[int]:
    """Positions, from 1, of the features with a positive weight for a family."""
    names, _, weights, _ = model(others)
    return [i + 1 for i, row in enumerate(weights.round(6)) if (row[: len(names) - 1] > 0).any()]


def _slots(features: list[str]) -> tuple[list[int], int]:
    """A table of the features' positions by hash, and its size, the least tried under which no two features meet."""
    at = np.array([xxhash.xxh64_intdigest(f.encode(), seed=42) for f in features], np.uint64).view(np.int64)  # as xxhash64 of Spark
    size = 64 * len(features)
    while len(np.unique(at % size)) < len(features):
        size += 1
    table = np.zeros(size, np.int64)
    table[at % size] = np.arange(1, len(features) + 1)
    return table.tolist(), size


def paragraphs(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), rejoin: bool = False) -> DataFrame:
    """The paragraphs that hold a word: the columns ``keep``, paragraph (0 for the first), content."""
    text = F.col(text_col).cast("string")
    if rejoin:
        # The line feed comes first, so that the look back is taken at ends of lines only.
        wrapped = rf"\n(?<=[^\n]{{{WRAPPED - 1}}}[^\n.!?:;|\s]\n)[ \t]*(?:(?:#+|//+|\*+|--+|;+|>+)[ \t]*)?(?=[^\s#/*>-])"
        text = F.regexp_replace(F.regexp_replace(text, r"[ \t\r]+\n", "\n"), wrapped, " ")
    return docs.select(*keep, F.posexplode(F.split(text, "\n")).alias("paragraph", "content")).where(F.col("content").rlike("(?i)[a-z0-9+]"))


def sample_others(docs: DataFrame, text_col: str = "text", rejoin: bool = False) -> tuple[str, ...]:
    """Ordinary paragraphs of at most SAMPLE_DOCUMENTS documents chosen by a hash of the text: those with few two-grams of any template."""
    short = docs.select(F.col(text_col).cast("string").alias("text")).where(F.length("text").between(1, SAMPLE_CHARS))
    n = short.count()
    dice = F.pmod(F.xxhash64("text", F.lit(3)), F.lit(1_000_003)) / 1_000_003
    some = short.where(dice < min(1.0, 1.5 * SAMPLE_DOCUMENTS / max(1, n))).distinct().orderBy(F.xxhash64("text", F.lit(3)), "text").limit(SAMPLE_DOCUMENTS)
    own = [set(zip(w, w[1:])) for t in TEMPLATES.values() for w in map(_words, t)]
    out = []
    for r in sorted(paragraphs(some, "text", (), rejoin).select("content").distinct().collect(), key=lambda r: (zlib.crc32(r[0].encode()), r[0])):
        w = _words(r[0])
        two = set(zip(w, w[1:]))
        if two and max(len(two & t) / min(len(t), len(two)) for t in own if t) < 0.2:
            out.append(r[0])
    return tuple(out[:SAMPLE])


def scan_licences(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), rejoin: bool = False, others: tuple[str, ...] = ()) -> DataFrame:
    """One row a paragraph that holds a feature of a family: the columns ``keep``, paragraph, content, family, probability, overlap."""
    names, features, weights, bias = model(others)
    slots, size = _slots(features)
    found = paragraphs(docs, text_col, keep, rejoin)
    words = F.regexp_extract_all(F.lower("content"), F.lit(r"([a-z0-9.+-]*[a-z0-9+])"), F.lit(1))
    # Exploding arrays of one element keeps the optimizer from pasting the words into each of their uses.
    rows = found.select("*", F.explode(F.array(words)).alias("words")).where(F.size("words") > 0)
    two = F.expr("if(size(words) > 1, transform(sequence(1, size(words) - 1), i -> concat_ws(' ', get(words, i - 1), get(words, i))), cast(array() as array<string>))")
    rows = rows.select("*", F.explode(F.array(two)).alias("two"))
    grams = F.array_distinct(F.filter(F.concat("words", "two"), lambda g: g.isin(features)))
    table = _numbers(slots, "int")
    at = F.transform(grams, lambda g: F.element_at(table, (F.pmod(F.xxhash64(g), F.lit(size)) + 1).cast("int")).cast("int"))
    rows = rows.select("*", F.explode(F.array(at)).alias("at")).where(F.exists("at", lambda i: i.isin(speaking(others))))
    for k, name in enumerate(names):
        column = _numbers([float(round(v, 6)) for v in weights[:, k]], "double")
        rows = rows.withColumn(f"z{k}", F.aggregate("at", F.lit(float(bias[k])), _adder(column)))
    z = F.array(*[F.col(f"z{k}") for k in range(len(names))])
    rows = rows.withColumn("z", z).withColumn("top", F.array_max("z"))
    rows = rows.withColumn("best", F.array_position("z", F.col("top")).cast("int"))
    rows = rows.withColumn("probability", 1 / F.aggregate("z", F.lit(0.0), lambda s, v: s + F.exp(v - F.col("top"))))
    share = lambda part, whole: F.size(F.array_intersect(part, whole)) / F.greatest(F.size(part), F.lit(1))
    rows = rows.withColumn("two", F.when(F.col("best") < len(names), F.array_distinct("two")))
    overlap = F.lit(0.0)
    for k, name in enumerate(names[:-1]):
        each = []
        for phrase in TEMPLATES[name]:
            own = _words(phrase)
            template = _array(sorted({f"{a} {b}" for a, b in zip(own, own[1:])} or set(own)))
            each.append(F.greatest(share(template, F.col("two")), F.when(F.size("words") >= 3, share(F.col("two"), template)).otherwise(0.0)))
        overlap = F.when(F.col("best") == k + 1, F.greatest(*each)).otherwise(overlap)
    rows = rows.withColumn("overlap", overlap)
    known = (F.col("best") < len(names)) & (F.col("probability") >= 0.5) & (F.col("overlap") >= CONFIRM)
    family = F.when(known, F.element_at(_array(names), F.col("best"))).otherwise(UNKNOWN)
    return rows.select(*keep, "paragraph", "content", family.alias("family"), F.round("probability", 6).alias("probability"), F.round("overlap", 6).alias("overlap"))
