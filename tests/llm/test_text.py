import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spanloom.llm import decontaminate as D
from spanloom.llm import pii
from spanloom.llm.urls import judge

FORMATS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 if i % 2 else 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, fmt) in enumerate(FORMATS.items()):
        for m in re.finditer(fmt, text):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")), "card": lambda: 12 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}
            if good[kind]():
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_plain_formats():
    rng = random.Random(8)
    bits = ["a", "b.c", "@", "@x.y", "x@y.z", ".", "-", "+", "1", "12", "255", "256", "1.2.3.4", "4111 1111 1111 1111", "+1 (555) 555-1234", " ", " ", "é", "_", "(", ")", "\n", "4111-1111-1111-1112", "0", "%"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))
        assert pii.base_spans(text) == plain_spans(text), text
    assert pii.base_spans("a" * 300_000 + "1" * 300_000 + "@" * 1000) == []


def test_base_spans_on_the_driver_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: [tuple(s) for s in r["base"]] for r in pii.find_private(docs).collect()}
    assert got == {r["doc_id"]: plain_spans(r["text"]) for r in docs.collect()}


def test_patterns_find_unseen_identifiers(spark):
    rows = [(i, f"w{i} my phone: +1 (555) 555-{1000 + i} ok", "c") for i in range(20)] + [(50, "hi my phone: 555-0199-22 bye 777-0199-22", "c"), (51, None, "c"), (None, "", "c"), (50, "hi my phone: 555-0199-22 bye 777-0199-22", "c")]
    got = pii.find_private(spark.createDataFrame(rows, "doc_id long, text string, ctx string")).collect()
    assert len(got) == len(rows)
    found = [r for r in got if r["doc_id"] == 50]
    assert [[tuple(s) for s in r["spans"]] for r in found] == [[(13, 3, 24)]] * 2 and found[0]["base"] == [] and found[0]["n_added"] == 1 and found[0]["n_phone"] == 0
    assert all(r["n_phone"] == 1 and r["base"] == r["spans"] for r in got if r["doc_id"] is not None and r["doc_id"] < 50)
    assert pii.find_private(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def plain_patterns(rows, support=5, confident=0.6, prior=2.0):
    """The good (kind, context) pairs by plain loops."""
    occurs, trust = defaultdict(int), {}
    for text in rows:
        base = pii.base_spans(text)
        found = [(k, c, text[s:e], True) for s, k, e in base for c in pii.contexts(text, s, e)]
        found += [(k, c, v, False) for _, _, cs, v, sh in pii._others(text, base) for c in cs for k in range(4) if sh >> k & 1]
        for k, c, v, seed in found:
            occurs[k, c, v] += 1
            trust[k, c, v] = max(trust.get((k, c, v), 0.0), float(seed))
    good = {}
    while True:
        by = defaultdict(list)
        for (k, c, v), n in occurs.items():
            by[k, c].append((n, trust[k, c, v]))
        new = {p: sum(n * t for n, t in e) / (sum(n for n, _ in e) + prior) for p, e in by.items() if sum(t >= confident for _, t in e) >= support}
        new = {p: r for p, r in new.items() if r >= confident}
        if len(new) == len(good):
            return new
        good, reach = new, defaultdict(float)
        for k, c, v in occurs:
            reach[k, v] = max(reach[k, v], new.get((k, c), 0.0))
        trust = {(k, c, v): max(t, reach[k, v]) for (k, c, v), t in trust.items()}


def test_found_identifiers_induce_further_patterns(spark):
    rng = random.Random(4)
    some = lambda: " ".join(rng.choice("abcdefgh") + str(rng.randrange(50)) for _ in range(rng.randint(3, 9)))
    local = [f"555-{1000 + i}" for i in range(12)]
    rows = [f"{some()} call me: +1 (555) 555-{1000 + i} {some()}" for i in range(30)]
    rows += [f"{some()} call me: {x} {some()}" for x in local] + [f"{some()} desk line {x} {some()}" for x in local]  # the pattern "desk line" has no seed
    rows += [f"{some()} desk line 020 7946 0018 {some()}", "call me: " + "9" * 70, "x" * 500 + " desk line 777-1234", "year 1999-2000 in all", "", None]
    df = spark.createDataFrame([(i, t, "p") for i, t in enumerate(rows)], "doc_id long, text string, row string")
    got = {r["doc_id"]: r for r in pii.find_private(df).collect()}
    good = plain_patterns([t or "" for t in rows])
    assert (3, "call me: _") in good and (3, "desk line _") in good
    for i, t in enumerate(rows):
        t = t or ""
        base = pii.base_spans(t)
        want = []
        for a, b, cs, _, sh in pii._others(t, base):
            kinds = [(good[k, c], -k) for c in cs for k in range(4) if sh >> k & 1 and (k, c) in good]
            if kinds:
                want.append((a, -max(kinds)[1], b))
        assert [tuple(s) for s in got[i]["spans"]] == sorted(base + want) and got[i]["n_added"] == len(want)
    last = rows[54]
    assert [last[s["start"] : s["end"]] for s in got[54]["spans"]] == ["020 7946 0018"]
    assert [rows[56][s["start"] : s["end"]] for s in got[56]["spans"]] == ["777-1234"] and not got[57]["spans"]


def plain_overlaps(docs, items, least=13, percent=80):
    tok = lambda t: [w.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for w in re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", t or "")]
    found = set()
    for d, t in docs:
        w = tok(t)
        for i, q in items:
            q = tok(q)
            for shift in range(-len(q), len(w)):
                same = [0 <= shift + k < len(w) and w[shift + k] == q[k] for k in range(len(q))]
                for a in range(len(q)):
                    for b in range(a + least, len(q) + 1):
                        if 0 <= shift + a and shift + b <= len(w) and 100 * sum(same[a:b]) >= percent * (b - a):
                            found.add((d, i))
    return found


def test_overlaps_equal_brute_force(spark):
    rng, words = random.Random(12), [f"t{i}" for i in range(150)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(15, 30)))) for i in range(6)] + [(20, "too short"), (21, None), (22, "")]
    docs = []
    for d in range(40):
        own = [rng.choice(words) for _ in range(rng.randint(0, 40))]
        q = items[rng.randrange(6)][1].split()
        a = rng.randrange(len(q) - 5)
        part = q[a : a + rng.randint(5, 25)]
        for _ in range(rng.randint(0, 3)):
            part[rng.randrange(len(part))] = "zz"
        at = rng.randint(0, len(own))
        docs.append((d, ", ".join(own[:at] + part + own[at:])))
    docs += [(90, None), (91, ""), (92, items[0][1].upper() + "!"), (92, items[0][1])]
    df = spark.createDataFrame([(*r, "g") for r in docs], "doc_id long, text string, _gone string")
    it = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in D.overlaps(df, it).collect()}
    assert got == plain_overlaps(docs, items)
    kept = D.decontaminate(df, it)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in got}
    assert D.contaminated(df.limit(0), it).count() == 0 and D.contaminated(df, it.limit(0)).count() == 0


def test_short_items_need_the_whole_run(spark):
    it = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota")], "item_id long, text string")
    df = spark.createDataFrame([(1, "so alpha beta gamma delta epsilon zeta eta theta iota ends"), (2, "so alpha beta gamma delta epsilon zeta eta theta jota ends")], "doc_id long, text string")
    assert [r["doc_id"] for r in D.overlaps(df, it).collect()] == [1]


def test_items_of_a_few_words_are_found_whole(spark):
    items = [(1, "Solo!"), (2, "zip zap"), (3, "one two three four five six seven"), (4, "..."), (5, "zip zap"), (6, None)]
    texts = ["a solo b SOLO", "zip, Zap", "zip", "zap zip", "one two three four five six seven", "one two three four five six zap", "so one two three four five six", "seven", "zip x zap", "soloist", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    it = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["doc_from"], r["doc_to"]) for r in D.overlaps(df, it).collect())
    assert got == [(0, 1, 1, 2), (0, 1, 3, 4), (1, 2, 0, 2), (1, 5, 0, 2), (4, 3, 0, 7)]


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = sorted(map(str, D.overlaps(docs, items).collect()))
    monkeypatch.setattr(D, "BLOCK_BYTES", 1500)
    assert want and sorted(map(str, D.overlaps(docs, items).collect())) == want


def test_decontaminate_tells_rows_by_id_and_text(spark):
    leak = " ".join(f"bench{i}" for i in range(15))
    rows = [(1, f"so {leak} ends", "k"), (1, "a clean text", "k"), (None, leak, "k"), (None, "another clean one", "k"), (None, None, "k"), (2, "", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _sha string")
    got = D.decontaminate(df, spark.createDataFrame([(1, leak)], "item_id long, text string"))
    assert got.columns == df.columns and sorted(str(r["text"]) for r in got.collect()) == ["", "None", "a clean text", "another clean one"]


def test_hot_seeds_and_very_long_texts_both_ways(spark, monkeypatch):
    rng, words = random.Random(2), [f"t{i}" for i in range(300)]
    stem = [rng.choice(words) for _ in range(9)]
    items = [(i, " ".join(stem + [rng.choice(words) for _ in range(8)])) for i in range(150)]
    long = [rng.choice(words) for _ in range(40_000)]
    long[20_000:20_017] = items[77][1].split()
    docs = [(0, " ".join(long)), (1, " ".join(stem * 30)), (2, "x " + items[5][1]), (3, items[6][1].replace(" ", ",  ") + " y"), (None, items[7][1]), (2, "x " + items[5][1]), (4, None), (5, "")]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(D, "SPREAD", 100)
    want = sorted({str(r) for r in D.overlaps(df, it).collect()})
    assert {(r["doc_id"], r["item_id"]) for r in D.overlaps(df, it).collect()} >= {(0, 77), (2, 5), (3, 6), (None, 7)}
    monkeypatch.setattr(D, "BLOCK_BYTES", 10)
    assert sorted({str(r) for r in D.overlaps(df, it).collect()}) == want
    assert D.overlaps(df.limit(0), it).count() == 0 and D.contaminated(df, it.limit(0)).count() == 0


def test_masks_hit_every_stretch_they_promise():
    import itertools

    places = lambda n: [{i + o for o, c in enumerate(m) if c == "1"} for m in D.MASKS for i in range(n - len(m) + 1)]
    for n, wrong in ((10, 1), (13, 2)):
        assert all(any(not p & set(x) for p in places(n)) for x in itertools.combinations(range(n), wrong))


def test_masks_hit_every_stretch_of_the_rule(spark):
    import itertools

    import numpy as np

    for n in range(D.LEAST, 2 * D.LEAST):  # a longer stretch has a half that the rule admits
        wrong = np.array([sum(1 << i for i in x) for x in itertools.combinations(range(n), n * (100 - D.PERCENT) // 100)])
        for m in D.MASKS:
            for i in range(n - len(m) + 1):
                wrong = wrong[wrong & (sum(1 << o for o, c in enumerate(m) if c == "1") << i) != 0]
        assert not len(wrong)
    item = [f"w{i}" for i in range(15)]
    leak = [w if i not in (2, 5, 7) else "zz" for i, w in enumerate(item)]
    docs = spark.createDataFrame([(1, "so " + " ".join(leak) + " ends"), (2, " ".join(["zz", *leak[1:]]))], "doc_id long, text string")
    it = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert [(r["doc_id"], r["same_words"]) for r in D.overlaps(docs, it).collect()] == [(1, 12)]


def test_url_rules_equal_brute_force(spark):
    rng = random.Random(5)
    rules = [(rng.choice(["block", "allow"]), h, p) for h in ("com", "a.com", "b.a.com", "org") for p in rng.sample(["/", "/en/", "/en", "/en/7", "/e", "/en/7/x"], 3)]
    urls = [f"http{rng.choice(['', 's'])}://{h}{p}" for h in ("com", "A.com", "x.b.a.com", "ba.com", "org", "x.org:80", "net") for p in ("", "/", "/en", "/en/", "/en/70?x=/", "/en/7/xy#a", "?q", "//en/")]
    urls += [None, "", "no scheme", "://", "mailto:x"]
    df = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(0, urls[0], "h")], "page_id long, url string, host string")
    got = judge(df, rules).collect()
    assert len(got) == len(urls) + 1

    def parts(u):
        u = u or ""
        if "://" not in u:
            return "", ""
        rest = re.split(r"[?#]", u.split("://", 1)[1])[0]
        host, slash, path = rest.partition("/")
        return host.lower(), slash + path

    for r in got:
        h, p = parts(urls[r["page_id"]])
        fits = [(len(a + b), len(a), v == "block", v, a + b) for v, a, b in rules if (h == a or h.endswith("." + a)) and p.startswith(b)]
        best = max(fits, default=None)
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (h, p, best and best[4], best[3] if best else "allow")
    long = spark.createDataFrame([(1, "http://A.com/en/" + "7/" * 50_000)], "page_id long, url string")
    assert judge(long, [("block", "a.com", "/en/" + "7/" * 49_999)]).first()["verdict"] == "block"
    assert judge(df.limit(0), rules).count() == 0 and judge(df, []).where("verdict <> 'allow'").count() == 0


def test_private_data_edge_cases(spark):
    from spanloom.llm import pii

    long = "w " * 100_000 + "mail a.b@c.de now " + "9" * 100_000
    df = spark.createDataFrame([(1, long, 5, "x"), (1, long, 5, "x"), (None, "1.2.3.4", 6, "y"), (2, None, 7, None)], "doc_id long, text string, n_email long, spans string")
    got = pii.find_private(df)
    assert got.count() == 4 and pii.find_private(df.limit(0)).count() == 0
    assert got.where("doc_id is null").count() == 1
