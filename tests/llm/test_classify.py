import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import language, licences, toxicity
from spanloom.llm.licences import scan_licences
from spanloom.llm.queries import op4_language, op6_toxicity

SF = "/root/testdata/sf0.01"


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.col("doc_id").alias("id"), "lang")
    got = op4_language(spark, SF).join(docs, F.col("id") == F.col("doc_id")).collect()
    held = [r for r in got if r["held_out"]]
    assert held and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edge_cases(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, "le chat et le chien", "fr"), (4, "el gato y el perro", "es"), (5, None, "en"), (6, "123 !!", None), (None, "the end", "en"), (1, "the cat and the dog", "en"), (8, "и да", None)] * 2
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    model = language.train(df.select("doc_id", "text", "lang"))
    got = language.identify(df, model, keep=tuple(df.columns), out=("p", "s")).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] in (5, 6):
            assert (r["p"], r["s"]) == ("und", 0.0)
        elif r["lang"]:
            assert r["p"] == r["lang"]
    assert language.train(df.limit(0).select("doc_id", "text", "lang")) is None
    assert language.identify(df, None).first()["lang_pred"] == "und"
    only = language.train(df.where("lang = 'en'").select("doc_id", "text", "lang"))
    assert {r["lang_pred"] for r in language.identify(df.where("doc_id = 2"), only).collect()} == {"en"}


def test_toxicity_on_held_out_rows(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select(F.col("doc_id").alias("id"), "toxic")
    got = op6_toxicity(spark, "/root/testdata/sf0.1").join(labels, F.col("id") == F.col("doc_id")).where("held_out").collect()
    hit = [r["predicted"] == r["toxic"] for r in got]
    assert sum(hit) / len(hit) > 0.97
    found = [r["predicted"] for r in got if r["toxic"] == 1]
    assert sum(found) / len(found) > 0.85  # some labelled rows hold no toxic word at all
    clean = [r["predicted"] for r in got if r["toxic"] == 0]
    assert sum(clean) / len(clean) < 0.02


def test_toxic_spans_are_code_points(spark):
    import random

    rng = random.Random(1)
    some = lambda: " ".join(rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(rng.randint(5, 40)))
    bad = [f"é {some()}. {some()} foozle {some()}! {some()}" for _ in range(120)]
    good = [f"é {some()}. {some()} friend {some()}! {some()}" for _ in range(120)]
    model = toxicity.fit(bad + good, [True] * 120 + [False] * 120)
    df = spark.createDataFrame([(1, "Ünd so: a foozle, foozle! Bye"), (2, "nothing here"), (3, None), (None, ""), (1, "Ünd so: a foozle, foozle! Bye")], "doc_id long, text string")
    got = toxicity.score_documents(df, model).collect()
    assert len(got) == 5
    first = [r for r in got if r["doc_id"] == 1]
    text = "Ünd so: a foozle, foozle! Bye"
    assert all("foozle" in text[s["start"] : s["end"]] for r in first for s in r["spans"]) and first[0]["spans"] and first[0]["score"] > 0.5
    assert all(r["score"] < 0.5 and not r["spans"] for r in got if r["doc_id"] != 1)


def test_marginals_equal_enumeration():
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    score, move = rng.normal(size=6), rng.normal(size=(2, 2))
    total, each = 0.0, np.zeros(6)
    for y in itertools.product((0, 1), repeat=6):
        w = np.exp(sum(score[i] * y[i] for i in range(6)) + sum(move[y[i], y[i + 1]] for i in range(5)))
        total, each = total + w, each + w * np.array(y)
    got = toxicity.marginals(score, np.array([0]), np.array([6]), move)
    assert got == pytest.approx(each / total)
    two = toxicity.marginals(np.concatenate([score, score[:2]]), np.array([0, 6]), np.array([6, 2]), move)
    assert two[:6] == pytest.approx(each / total)


def test_expectations_equal_enumeration():
    import itertools

    rng = np.random.default_rng(5)
    score, move, length = rng.normal(size=7), rng.normal(size=(2, 2)), np.array([4, 3])
    begin = np.array([0, 4])
    p, joint, none = toxicity.expected(score, begin, length, move)
    weights = {}
    for y in itertools.product((0, 1), repeat=7):
        weights[y] = np.exp(sum(score[i] * y[i] for i in range(7)) + sum(move[y[i], y[i + 1]] for i in (0, 1, 2, 4, 5)))
    total = sum(weights.values())
    assert np.exp(none.sum()) == pytest.approx(weights[(0,) * 7] / total)
    for i in (1, 2, 3, 5, 6):
        for a in (0, 1):
            for b in (0, 1):
                assert joint[i, 2 * a + b] == pytest.approx(sum(w for y, w in weights.items() if (y[i - 1], y[i]) == (a, b)) / total)
    assert not joint[0].any() and not joint[4].any()
    some = 1 - weights[(0,) * 7] / total  # given that some word is toxic, the marginal is divided by this
    for i in range(7):
        assert p[i] / some == pytest.approx(sum(w for y, w in weights.items() if any(y) and y[i]) / sum(w for y, w in weights.items() if any(y)))


def test_toxic_words_are_learnt_from_document_labels():
    import random

    rng = random.Random(7)
    names = [f"{a}{b}" for a in "bcdfghjk" for b in ("ander", "olim", "usta", "ippen", "arro", "entis")]
    some = lambda: " ".join(rng.choice(names) for _ in range(rng.randint(20, 60)))
    bad = [f"{some()}. {some()} zorg{rng.choice('abcdefgh')}x {some()}! {some()}" for _ in range(300)]
    good = [f"{some()}. {some()} {some()}! {some()}" for _ in range(900)]
    model = toxicity.fit(bad[:200] + good[:800] + good[850:860], [True] * 200 + [False] * 800 + [True] * 10)
    hits = total = right = 0
    for text, label in [(t, True) for t in bad[200:]] + [(t, False) for t in good[860:]]:
        data = np.frombuffer(text.encode(), np.uint8)
        c = toxicity.Chains(data, np.array([0, len(data)]))
        p = model.tag(data, c)
        words = [text[a:b] for a, b in zip(c.start, c.end)]
        hits += sum(x >= 0.5 and w.startswith("zorg") for x, w in zip(p, words))
        total += sum(x >= 0.5 for x in p)
        right += (model.score(*toxicity._summary(p, c.per_text))[0] >= 0.5) == label
    assert right == 140 and hits >= 95 and hits == total


def test_toxicity_edge_cases(spark):
    model = toxicity.fit(["a foozle b c"] * 3 + [f"w{i} foozle v{i} foozle" for i in range(60)], [False] * 3 + [True] * 60)
    long = "x " * 200_000 + "foozle"
    df = spark.createDataFrame([(1, long, 1, "s"), (1, long, 1, "s"), (None, "foozle", 2, "t"), (2, None, 3, "u")], "doc_id long, text string, _text int, toxic string")
    got = toxicity.score_documents(df, model, keep=("doc_id", "toxic")).collect()
    assert len(got) == 4 and [r["score"] for r in got if r["doc_id"] == 1][0] == [r["score"] for r in got if r["doc_id"] == 1][1]
    assert toxicity.score_documents(df.limit(0), model).count() == 0
    both = spark.createDataFrame([(1, "y " * 20_000, 1), (2, "a b", 0), (3, "c d", 0), (4, "e", 1)], "doc_id long, text string, toxic int")
    assert toxicity.train(both).share == 0.5  # long texts teach no words, but count for the share


def test_toxicity_without_both_classes(spark):
    df = spark.createDataFrame([(1, "a", 0)], "doc_id long, text string, toxic int")
    assert {r["score"] for r in toxicity.score_documents(df, toxicity.train(df)).collect()} == {0.0}
    assert toxicity.score_documents(df.limit(0), toxicity.train(df.limit(0))).count() == 0


def test_licences(spark):
    texts = ["Intro.\nLicensed under the Apache License, Version 2.0.\nEnd", "Released under the MIT License.", "He lost his driving license on the way home", None, "", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "This work is licensed under the GNU General Public License, version 3."]
    df = spark.createDataFrame([(i, t, "z", 1.0) for i, t in enumerate(texts)] + [(1, texts[1], "z", 1.0), (None, texts[1], "z", 1.0)], "doc_id long, text string, words string, probability double")
    got = scan_licences(df).collect()
    assert sorted((str(r["doc_id"]), r["paragraph"], r["family"]) for r in got) == sorted([("0", 1, "apache"), ("1", 0, "mit"), ("1", 0, "mit"), ("None", 0, "mit"), ("2", 0, "unknown"), ("5", 0, "mit"), ("6", 0, "gpl")])
    assert scan_licences(df.limit(0)).count() == 0


def plain_family(line):
    """The family by the model alone, without any filter of lines."""
    names, features, w, b = licences.model()
    words = licences._words(line)
    two = {f"{x} {y}" for x, y in zip(words, words[1:])}
    z = b + sum((w[features.index(g)] for g in two | set(words) if g in features), np.zeros(len(names)))
    k = int(z.argmax())
    if k == len(names) - 1 or 1 / np.exp(z - z.max()).sum() < 0.5:
        return "unknown"
    best = 0.0
    for own in map(licences._words, licences.TEMPLATES[names[k]]):
        t = {f"{x} {y}" for x, y in zip(own, own[1:])}
        best = max(best, len(t & two) / len(t), len(t & two) / max(1, len(two)) if len(words) >= 3 else 0)
    return names[k] if best >= licences.CONFIRM else "unknown"


def test_licences_without_licence_words(spark):
    lines = ["Unauthorized copying of this file, via any medium, is strictly prohibited.", "use of this source code is governed by a bsd-style notice", "under the terms of the Mozilla Public", "Distributed under the terms of the GNU GPL v3.", "you may obtain a copy", "Copyright", "MIT", "zebra", "qq zz ww", "", " \t", "...", "the cat sat on the mat", "ß é 漢字"]
    lines += [" ".join(t.split()[a : a + n]) for ts in licences.TEMPLATES.values() for t in ts for n in (1, 4, 9) for a in range(0, len(t.split()), 3)]
    df = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    got = {r["paragraph"]: r["family"] for r in scan_licences(df).collect()}
    want = [plain_family(x) for x in lines]
    assert want[0] == "proprietary" and [got.get(i, "unknown") for i in range(len(lines))] == want
    assert {3, 4, 5, 6, 12} <= set(got) and not {7, 8, 9, 10, 11, 13} & set(got)


ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS."""
APACHE = """# Unless required by applicable law or agreed to in writing, software
# distributed under the License is distributed on an "AS IS" BASIS,
# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
# See the License for the specific language governing permissions and
# limitations under the License."""
GPL = """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version."""


def test_wrapped_notices_are_one_paragraph(spark):
    others = licences.sample_others(spark.read.parquet(f"{SF}/documents.parquet"), rejoin=True)
    assert 100 < len(others) <= licences.SAMPLE
    plain = "He read the book in the garden, and the general public may\nvisit the free software museum. The licence of the car was lost."
    long = "word and more words " * 60_000 + "\n" + APACHE
    df = spark.createDataFrame([(1, ISC), (2, APACHE), (3, GPL), (4, plain), (5, long), (5, long), (6, None), (7, "")], "doc_id long, text string")
    got = licences.scan_licences(df, rejoin=True, others=others).collect()
    family = lambda i: sorted((r["paragraph"], r["family"]) for r in got if r["doc_id"] == i)
    assert family(1) == [(0, "isc"), (2, "isc")] and family(2) == [(0, "apache"), (1, "apache")] and family(3) == [(0, "gpl")]
    assert {f for _, f in family(4)} == {"unknown"} and [f for _, f in family(5) if f != "unknown"] == ["apache"] * 4
    assert licences.CALIBRATION["unknown_called_known"] < 0.05 and licences.CALIBRATION["log_loss"] < 3
    assert licences.scan_licences(df.limit(0), rejoin=True).count() == 0 and licences.sample_others(df.limit(0)) == ()


def test_features_are_looked_up_by_hash(spark):
    names, features, _, _ = licences.model()
    slots, size = licences._slots(features)
    df = spark.createDataFrame([(f,) for f in features], "g string")
    at = {r[0]: r[1] for r in df.select("g", F.pmod(F.xxhash64("g"), F.lit(size))).collect()}
    assert [slots[at[f]] for f in features] == list(range(1, len(features) + 1))


def test_language_ties_and_bounds(spark, monkeypatch):
    rows = [(1, "aa bb", "en"), (2, "aa bb", "de"), (3, "aa bb", None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df)
    got = {r["lang_pred"] for r in language.identify(df, model).collect()}
    assert len(got) == 1 and got < {"de", "en"}  # equal texts are predicted alike
    many = spark.createDataFrame([(i, f"word{i} more{i}", f"l{i % 30}") for i in range(300)], "doc_id long, text string, lang string")
    assert len(language.train(many, most=60).names) == 30  # no language is left out
    monkeypatch.setattr(language, "MOST_LANGUAGES", 29)
    with pytest.raises(ValueError):
        language.train(many)
