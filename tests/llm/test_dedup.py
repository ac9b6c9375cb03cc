import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from spanloom.llm import common, minhash
from spanloom.llm.exact import drop_duplicates, exact_groups
from spanloom.llm.minhash import components, near_duplicates

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, bucket string, _gone long, _sha string, kept int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "b", 1, "s", 0) for i, t in rows], SCHEMA)


def sets(rows, k):
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        out[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def brute_components(rows, k, percent=80):
    s, up = sets(rows, k), {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    shared, have = defaultdict(int), defaultdict(list)
    for i, g in s.items():
        for x in g:
            have[x].append(i)
    for ids in have.values():
        for a, b in combinations(sorted(ids), 2):
            shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(s[a]) + len(s[b]) - n):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: root(i) for i in up}, {i: len(g) for i, g in s.items()}


def corpus(seed=1):
    """Families of copies with few to many edits, a passage that many share, and edge cases."""
    rng, rows, words = random.Random(seed), [], [f"w{i}" for i in range(900)]
    passage = [rng.choice(words) for _ in range(40)]
    for _ in range(6):
        base = [rng.choice(words) for _ in range(rng.randint(30, 120))]
        for _ in range(25):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 8])):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append(" ".join(own))
    rows += [" ".join(passage + [rng.choice(words) for _ in range(30)]) for _ in range(60)]
    rows += ["", None, "  \n ", "one two", "One  TWO", "one", "x " * 3000, "x " * 3001, "Ä b c d e", "ä b c d e", "one two three four"]
    return list(enumerate(rows))


@pytest.mark.parametrize("k", [4, 5])
def test_components_equal_brute_force(spark, k):
    rows = corpus()
    want, size = brute_components(rows, k)
    got = near_duplicates(frame(spark, rows), shingle=k).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["component_id"], r["n_shingles"], r["kept"]) == (want[r["doc_id"]], size[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])


def test_driver_table_equals_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want, _ = brute_components([(r["doc_id"], r["text"]) for r in docs.collect()], 4)
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(docs, shingle=4).collect()} == want


def test_near_duplicates_edge_cases(spark):
    t = "a b c d e f g h"
    got = near_duplicates(frame(spark, [(None, t), (5, t), (5, t), (7, t), (9, None)])).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None) == [(5, 5, True), (5, 5, True), (7, 5, False), (9, 9, True)]
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]
    assert near_duplicates(frame(spark, [])).count() == 0


def test_repeated_id_with_unlike_texts_connects_nothing(spark):
    a, b = "a b c d e f g h", "q r s t u v w x"
    got = near_duplicates(frame(spark, [(5, a), (5, b), (6, a), (7, b), (8, b)])).collect()
    comp = {r["doc_id"]: r["component_id"] for r in got}
    assert len(got) == 5 and comp[5] == 5 and sorted((comp[6] == 5, comp[7] == 5)) == [False, True]
    assert comp[7] == comp[8] and {r["kept"] for r in got if r["doc_id"] == 5} == {True}


def test_long_lists_in_small_blocks_equal_brute_force(spark, monkeypatch):
    rows = corpus(4)
    want, _ = brute_components(rows, 4)
    for name, value in (("MEMBERS_A_BLOCK", 4), ("CENTRES_A_BLOCK", 3), ("PAIRS", 5), ("CENTRES", (2,))):
        monkeypatch.setattr(minhash, name, value)
    assert {r["doc_id"]: r["component_id"] for r in near_duplicates(frame(spark, rows), shingle=4).collect()} == want


def test_parity_sketches_never_overstate_a_difference():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**64, n, dtype=np.uint64)) for n in (1, 3, 127, 129, 400, 1000)]
    sets += [np.unique(np.concatenate([s[: len(s) * 9 // 10], rng.integers(0, 2**64, 20, dtype=np.uint64)])) for s in sets]
    words, at, size = minhash._words_of(pa.array([minhash.parity_sketch(s) for s in sets], pa.binary()))
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets))]
    got = minhash._apart(words, at, size, np.array([i for i, _ in pairs]), np.array([j for _, j in pairs]))
    real = [len(np.setxor1d(sets[i], sets[j])) for i, j in pairs]
    assert all(g <= r and (r > 0 or g == 0) and (r - g) % 2 == 0 for g, r in zip(got, real))


def test_joins_with_hot_and_null_keys_spread_their_rows(spark, monkeypatch):
    rows = spark.range(60_000).select(F.when(F.col("id") % 5 < 2, None).when(F.col("id") % 2 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"), "id")
    groups = rows.where("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("m"))
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        got = common.with_group(rows, groups, "k", "n", 60_000)
        sizes = sorted(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect())
        assert sizes[-1] < 3 * sizes[len(sizes) // 2]
        want = {r["k"]: r["m"] for r in groups.collect()}
        assert all(r["m"] == want.get(r["k"]) for r in got.collect())
        plain = common.lookup(rows, "k", groups.withColumn("m", F.col("m").cast("string")), "k", "m", "v").select("id", "v").collect()
        monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
        same = common.lookup(rows, "k", groups.withColumn("m", F.col("m").cast("string")), "k", "m", "v")
        sizes = sorted(r["count"] for r in same.groupBy(F.spark_partition_id()).count().collect())
        assert sizes[-1] < 3 * sizes[len(sizes) // 2] and sorted(map(str, same.select("id", "v").collect())) == sorted(map(str, plain))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_connected_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(5, 5)]
    up = {}
    for a, b in edges:
        up.setdefault(a, a), up.setdefault(b, b)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in edges:
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {i: root(i) for i in linked}


def test_exact_groups_equal_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(["x", "X", "x", "", None, "long " * 5000, "long " * 5000, "long " * 4999 + "lonG ", "é", "é", "x", " x"])] + [(None, "x"), (3, "")]
    got = exact_groups(frame(spark, rows), also={"t": F.coalesce("text", F.lit(""))}).collect()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    for r in got:
        own = groups[r["t"]]
        keep = max((i for i in own if i is not None), default=None)
        assert (r["keep_id"], r["group_size"], r["kept"]) == (keep, len(own), r["doc_id"] == keep)


def test_drop_duplicates_keeps_one_of_each_text(spark):
    rows = [(1, "a"), (2, "a"), (1, "b"), (3, "c"), (3, "c"), (4, None), (5, ""), (None, "d"), (None, "a")]
    got = drop_duplicates(frame(spark, rows))
    assert got.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == [("1", "b"), ("2", "a"), ("3", "c"), ("5", ""), ("None", "d")]
    assert drop_duplicates(frame(spark, [])).count() == 0


def test_texts_of_one_length_equal_brute_force(spark):
    rng = random.Random(6)
    rows = [(i, "".join(rng.choice("abcd") for _ in range(5))) for i in range(3000)] + [(4000 + i, "same start " * 9 + str(i % 40).zfill(2)) for i in range(90)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    got = exact_groups(frame(spark, rows), also={"t": F.col("text")}).collect()
    assert len(got) == len(rows) and all((r["keep_id"], r["group_size"]) == (max(groups[r["t"]]), len(groups[r["t"]])) for r in got)
    assert sorted(r["doc_id"] for r in drop_duplicates(frame(spark, rows)).collect()) == sorted(max(v) for v in groups.values())
