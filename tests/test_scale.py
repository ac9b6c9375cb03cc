"""Operators that deal a group over tasks, against plain versions: ties, nulls, sparse axes, hot blocks, empty tables."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.functions import arrays
from spanloom.operators import intervals as iv
from spanloom.operators import stats
from spanloom.operators import windows as win


def values(seed=1):
    rng = random.Random(seed)
    pick = [0.0, -1.5, 2.0**40, 1e-300, 7.0, 7.0, -3.25]
    return [(i, rng.choice(["a", "b", None]), rng.choice([None, rng.choice(pick), rng.gauss(0, 5), 1000 + rng.random()])) for i in range(500)] + [(900, "c", None), (901, "d", 4.0)]


def groups(rows):
    out = {}
    for i, g, v in rows:
        out.setdefault(g, []).append((i, v))
    return out


def test_slots_grow_with_the_value(spark):
    rng = random.Random(2)
    xs = sorted({s * 2.0 ** rng.uniform(-1000, 1000) for _ in range(2000) for s in (-1, 1)} | {0.0, 1.0, 2.0, 4.0, 0.5, -8.0, float("inf"), float("-inf"), 5e-324} | {2.0**k for k in range(-60, 60)})
    got = spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, x double").select("i", stats._slot(F.col("x")).alias("s")).orderBy("i").collect()
    assert all(a["s"] <= b["s"] for a, b in zip(got, got[1:])) and len({r["s"] for r in got}) > 2000


def test_ranks_medians_and_false_discovery_equal_plain_ones(spark):
    rows = values()
    df = spark.createDataFrame(rows, "i int, g string, v double")
    tail = {r["i"]: r["tail_share"] for r in stats.tail_share(df, "v", ["g"]).collect()}
    rank = {r["i"]: r["r"] for r in stats.average_rank(df, "v", ["g"], "r").collect()}
    z = {r["i"]: r["z"] for r in stats.robust_z(df, "v", ["g"]).collect()}
    plain_z = {r["i"]: r["z"] for r in stats.zscore(df, "v", ["g"]).collect()}
    assert len(tail) == len(rank) == len(z) == len(rows)
    for g, own in groups(rows).items():
        xs = [v for _, v in own if v is not None]
        m = statistics.median(xs) if xs else None
        mad = statistics.median([abs(v - m) for v in xs]) if xs else None
        for i, v in own:
            if v is None:
                assert tail[i] is None and rank[i] is None and z[i] is None and plain_z[i] is None
                continue
            assert tail[i] == pytest.approx((sum(x >= v for x in xs) + 1) / (len(xs) + 1))
            assert rank[i] == pytest.approx(sum(x < v for x in xs) + (sum(x == v for x in xs) + 1) / 2)
            if len(xs) >= 2:
                assert z[i] == pytest.approx((v - m) / (mad / 0.6745)) and plain_z[i] == pytest.approx((v - statistics.mean(xs)) / statistics.stdev(xs))
            else:
                assert z[i] is None and plain_z[i] == 0
    p = [(i, None if v is None else min(1.0, abs(v) / 1000)) for i, _, v in rows]
    q = {r["i"]: r["q"] for r in stats.bh(spark.createDataFrame(p, "i int, p double"), "p").collect()}
    ps = sorted(v for _, v in p if v is not None)
    for i, v in p:
        want = None if v is None else min(1.0, min(x * len(ps) / sum(y <= x for y in ps) for x in set(ps) if x >= v))
        assert q[i] == (want if want is None else pytest.approx(want))
    assert stats.robust_z(df.limit(0), "v", ["g"]).count() == 0 and stats.bh(df.limit(0), "v").count() == 0


def test_a_group_s_values_are_swept_in_many_slots(spark):
    df = spark.range(20_000).select(F.col("id"), F.randn(3).alias("v"), F.lit("g").alias("g"))
    c, _ = stats._counts(df, ["g"], "v")
    sizes = [r["count"] for r in c.groupBy(stats._slot(F.col("v"))).count().collect()]
    assert len(sizes) > 500 and max(sizes) < 200


@pytest.mark.parametrize("gap", [0, 30])
def test_islands_equal_a_plain_sweep(spark, gap):
    rng = random.Random(gap)
    rows = [("a", s, s + rng.randint(1, 40)) for s in (rng.randrange(3000) for _ in range(150))]
    rows += [("b", s, s + rng.choice([1, 10, 400_000])) for s in (rng.randrange(10**7) for _ in range(200))] + [("c", 5, 5), ("c", 5, 9), (None, 1, 5), (None, 3, 8), ("d", -50, -20), ("d", -30, 10)]
    df = spark.createDataFrame(rows, "chrom string, start long, end long")
    want = []
    for c in {r[0] for r in rows}:
        done = None
        for _, s, e in sorted((r for r in rows if r[0] == c), key=lambda r: r[1:]):
            apart = done is None or (s > done[2] + gap if gap else s >= done[2])
            if apart:
                want.append(done) if done else None
                done = [c, s, e, 1]
            else:
                done[2], done[3] = max(done[2], e), done[3] + 1
        want.append(done)
    for size in (64, 1 << 14):
        got = iv.islands(df, ["chrom"], gap=gap, bin_size=size).collect()
        assert sorted(str((r["chrom"], r["start"], r["end"], r["n_members"])) for r in got) == sorted(str(tuple(w)) for w in want)
    assert iv.islands(df.limit(0), ["chrom"]).count() == 0


def test_matched_controls_equal_brute_force(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice(["b1", "b1", "b1", "b2", f"c{i}"]), rng.choice(["s", "t"]), rng.choice([None, 1.0, rng.gauss(0, 1), rng.gauss(50, 1)]), rng.choice([2.0, rng.random()]), 7.0) for i in range(300)]
    rows += [(900, "z", "lone", 1.0, 1.0, 7.0), (901, "z", None, 1.0, 1.0, 7.0), (902, "far", "s", 1e6, 0.5, 7.0)]
    df = spark.createDataFrame(rows, "k int, b string, s string, x double, y double, flat double")
    sd = [np.std([r[i] for r in rows if r[i] is not None], ddof=1) for i in (3, 4)]
    far = lambda r, t: round(sum(abs(r[i] / d - t[i] / d) for i, d in zip((3, 4), sd) if r[i] is not None and t[i] is not None), 9)
    for rings in ((1, 3), ()):
        got = stats.matched_controls(df, "k", "b", ["s"], ["x", "y", "flat"], 4, a_cell=4, rings=rings).collect()
        found = {}
        for r in got:
            found.setdefault(r["k"], {})[r["rank"]] = (r["distance"], r["control"])
        for r in rows:
            want = sorted((far(r, t), t[0]) for t in rows if t[2] == r[2] and r[2] is not None and t[1] != r[1])[:4]
            mine = [found.get(r[0], {}).get(i + 1) for i in range(len(want))]
            assert len(found.get(r[0], {})) == len(want) and [m[0] for m in mine] == pytest.approx([w[0] for w in want], abs=1e-8)


def test_parents_by_place_equal_the_join(spark):
    axes = spark.createDataFrame([("a", 10_000), ("b", 1234), ("c", 700), ("d", 99), ("e", 2500)], "chrom string, size long")
    tiles = win.tile(axes, [100, 350, 1000, 2000], 0.3, parents=True)
    want = {r["region_id"]: r["parent_id"] for r in win.parents(tiles.drop("parent_id")).collect()}
    assert {r["region_id"]: r["parent_id"] for r in tiles.collect()} == want
    kids = {r["parent_id"]: (r["n_children"], set(r["child_ids"].split(","))) for r in win.children(tiles).collect()}
    assert sum(n for n, _ in kids.values()) == sum(v is not None for v in want.values()) and all(want[c] == p for p, (_, cs) in kids.items() for c in cs)


def test_base_stats_equal_plain_counts(spark):
    rng = random.Random(3)
    seqs = ["".join(rng.choice("ACGTN") * rng.choice([1, 1, 1, 6]) for _ in range(n)) for n in (400, 30, 3, 0)] + ["N" * 50, None]
    df = spark.createDataFrame([(f"a{i}", s) for i, s in enumerate(seqs)], "chrom string, seq string")
    tiles = {(r["chrom"], r["start"], r["window_size"]): r["end"] for r in win.tile(df.withColumn("size", F.length("seq")), [40, 100]).collect()}
    for letters in (1 << 24, 50):
        got = win.base_stats(df, [40, 100], letters=letters).collect()
        assert {(r["chrom"], r["start"], r["window_size"]): r["end"] for r in got} == tiles
        for r in got:
            s = seqs[int(r["chrom"][1:])]
            low = [False] * len(s)
            i = 0
            while i < len(s):
                j = i
                while j < len(s) and s[j] == s[i]:
                    j += 1
                low[i:j] = [j - i >= 5] * (j - i)
                i = j
            part, n = s[r["start"] : r["end"]], r["end"] - r["start"]
            real = n - part.count("N")
            assert r["gc"] == (pytest.approx((part.count("G") + part.count("C")) / real) if real else None)
            assert r["n_fraction"] == pytest.approx(part.count("N") / n) and r["low_complexity"] == pytest.approx(sum(low[r["start"] : r["end"]]) / n)


def test_linear_fit_without_own_group(spark):
    rng = np.random.default_rng(2)
    x, z, g = rng.normal(size=200), rng.normal(size=200), rng.integers(0, 4, 200)
    y = 3 + 2 * x - z + rng.normal(size=200) / 10
    rows = [(int(a), float(b), float(c), float(d), "k") for a, b, c, d in zip(g, x, z, y)]
    df = spark.createDataFrame(rows + [(1, None, 1.0, 1.0, "k"), (1, 1.0, 1.0, 1.0, "flat"), (2, 1.0, 1.0, 2.0, "flat")], "g int, x double, z double, y double, by string")
    got = {(r["by"], r["g"]): r for r in stats.leave_group_out_linear(df, ["by"], "g", ["x", "z"], "y").collect()}
    for own in range(4):
        a = np.stack([np.ones(200), x, z], axis=1)[g != own]
        want = np.linalg.lstsq(a, y[g != own], rcond=None)[0]
        assert [got["k", own]["intercept"], *got["k", own]["slopes"]] == pytest.approx(want.tolist()) and got["k", own]["n"] == len(a)
    assert got["flat", 1]["slopes"] is None


def test_row_figures_and_schema(spark):
    df = spark.createDataFrame([(1, None, float("nan")), (2, float("inf"), 3.0), (3, 1.0, 5.0)], "k int, a double, b double")
    a, b = F.col("a"), F.col("b")
    got = df.select(stats.first_finite(a, b), stats.finite_mean(a, b), stats.finite_max(a, b)).collect()
    assert [tuple(r) for r in got] == [(None, None, None), (3.0, 3.0, 3.0), (1.0, 3.0, 5.0)]
    out = win.with_schema(df, spark.createDataFrame([], "z string, k long").schema)
    assert out.dtypes == [("z", "string"), ("k", "bigint")] and [tuple(r) for r in out.collect()] == [(None, 1), (None, 2), (None, 3)]


def test_surrogates_keep_what_they_promise():
    rng = random.Random(9)
    pairs = lambda s: sorted(zip(s, s[1:]))
    for _ in range(200):
        s = "".join(rng.choice("ACGTN"[: rng.randint(1, 5)]) for _ in range(rng.randint(0, 60)))
        for name in arrays.SURROGATES:
            assert len(arrays.surrogate(name, s, 5)) == len(s)
        assert pairs(arrays.pair_shuffle(s, 1)) == pairs(s) and arrays.pair_shuffle(s, 1)[:1] == s[:1]
        assert all(sorted(arrays.local_shuffle(s, 2, 7)[i : i + 7]) == sorted(s[i : i + 7]) and pairs(arrays.local_shuffle(s, 2, 7, True)[i : i + 7]) == pairs(s[i : i + 7]) for i in range(0, len(s), 7))
        assert sorted(arrays.equal_composition(s, 3)) == sorted(s) and not {a + b for a, b in zip(arrays.markov(s, 4), arrays.markov(s, 4)[1:])} - {a + b for a, b in zip(s, s[1:])} - {s[-1:] + c for c in s}
    assert len({arrays.pair_shuffle("ACGTACCATGACGGTA", k) for k in range(100)}) > 50
    with pytest.raises(ValueError):
        arrays.surrogate("none", "A", 1)


def test_tandem_repeats_and_spectra():
    import re

    rng = random.Random(4)
    for _ in range(300):
        s = "".join(rng.choice("ACGTN"[: rng.randint(1, 5)]) for _ in range(rng.randint(1, 60)))
        covered = set()
        for p in range(1, 7):
            for m in re.finditer(rf"([ACGT]{{{p}}})\1{{2,}}", s):
                covered |= set(range(*m.span()))
        assert arrays.tandem_coverage(s) == pytest.approx(len(covered) / len(s))
    noise = "".join(rng.choice("ACGT") for _ in range(20_000))
    slope, low, bits = arrays.spectrum_shape(noise)
    assert abs(arrays.hurst_dfa(noise) - 0.5) < 0.1 and arrays.multifractal_width(noise) < 0.15 and abs(slope) < 0.1 and abs(low - 0.1) < 0.02 and bits > 0.9
    waves = "".join("AC"[int(np.sin(i / 300) > rng.uniform(-1, 1))] for i in range(20_000))
    assert arrays.hurst_dfa(waves) > 0.6 and arrays.spectrum_shape(waves)[1] > 0.5
    assert arrays.log_scales(31) == [] and arrays.log_scales(400)[0] == 8 and arrays.log_scales(400)[-1] == 100
    assert arrays.lz78_rate("AACAB") == 3 / 5 and arrays.compression_distance("ACGT" * 50, "ACGT" * 50) < 0.2 and arrays.compression_distance("", "A") is None


def test_bootstrap_of_blocks(spark):
    rng = random.Random(1)
    rows = [("g", i % 12, rng.gauss(3, 1)) for i in range(240)] + [("one", 1, 2.0)]
    got = {r["g"]: r for r in stats.block_bootstrap(spark.createDataFrame(rows, "g string, b int, v double"), ["g"], "b", "v").collect()}
    means = [statistics.mean(v for _, b, v in rows[:240] if b == k) for k in range(12)]
    assert got["g"]["mean"] == pytest.approx(statistics.mean(means)) and min(means) <= got["g"]["low"] < got["g"]["mean"] < got["g"]["high"] <= max(means)
    assert got["one"]["n_blocks"] == 1 and got["one"]["mean"] == 2.0 and not got["one"]["low"] == got["one"]["low"] or got["one"]["low"] is None


def test_matched_controls_look_a_point_up_once(spark):
    base = [(i, f"b{i % 3}", "s", float(i % 5), float(i % 2)) for i in range(30)]
    rows = [(100 * c + i, b, s, x, y) for c in range(8) for i, b, s, x, y in base]
    df = spark.createDataFrame(rows, "k int, b string, s string, x double, y double")
    sd = [np.std([r[i] for r in rows], ddof=1) for i in (3, 4)]
    got = stats.matched_controls(df, "k", "b", ["s"], ["x", "y"], 4)
    assert "_place" in got._jdf.queryExecution().optimizedPlan().toString()  # else each copy would meet all copies
    found = {}
    for r in got.collect():
        found.setdefault(r["k"], []).append((r["rank"], r["control"]))
    for r in rows:
        want = sorted((round(sum(abs(r[i] / d - t[i] / d) for i, d in zip((3, 4), sd)), 9), t[0]) for t in rows if t[1] != r[1])[:4]
        assert [c for _, c in sorted(found[r[0]])] == [c for _, c in want]
