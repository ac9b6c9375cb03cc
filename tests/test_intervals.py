import random

import pytest
from pyspark.sql import functions as F

from spanloom.operators import intervals as iv
from spanloom.operators import stats
from spanloom.operators import windows as win


def frame(spark, rows, name="id"):
    return spark.createDataFrame(rows, f"{name} long, chrom string, start long, end long")


def some(seed, n, most=500):
    rng = random.Random(seed)
    return [(i, rng.choice("ab"), s, s + rng.randint(0, 90)) for i in range(n) for s in [rng.randint(0, most)]]


def brute(a, b):
    return sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] < y[3] and x[3] > y[2] and x[2] < x[3] and y[2] < y[3])


@pytest.mark.parametrize("size", [7, 64, 10_000])
def test_range_join_equals_brute_force(spark, size):
    a, b = some(1, 80), some(2, 80)
    got = iv.range_join(frame(spark, a), frame(spark, b), bin_size=size).select("l.id", F.col("r.id").alias("o")).collect()
    assert sorted(map(tuple, got)) == brute(a, b)


def test_book_ended_intervals_do_not_overlap(spark):
    a, b = frame(spark, [(1, "a", 0, 10)]), frame(spark, [(2, "a", 10, 20)])
    assert iv.range_join(a, b).count() == 0


def test_coverage_counts_overlaps_twice_and_caps_the_fraction(spark):
    a = frame(spark, [(1, "a", 100, 200), (2, "a", 900, 950)])
    b = frame(spark, [(1, "a", 90, 120), (2, "a", 150, 230), (3, "a", 100, 200)])
    got = {r["id"]: r for r in iv.coverage(a, b, "id").collect()}
    assert (got[1]["n_overlaps"], got[1]["overlap_bp"], got[1]["fraction"]) == (3, 170, 1.0)
    assert (got[2]["n_overlaps"], got[2]["overlap_bp"], got[2]["fraction"]) == (0, 0, 0.0)


@pytest.mark.parametrize("size", [16, 10_000])
def test_islands_do_not_depend_on_bins(spark, size):
    rows = some(3, 120, 2000)
    got = sorted((r["chrom"], r["start"], r["end"], r["n_members"]) for r in iv.islands(frame(spark, rows), ["chrom"], bin_size=size).collect())
    want = []
    for c in "ab":
        end, own = None, None
        for _, _, s, e in sorted((r for r in rows if r[1] == c), key=lambda r: (r[2], r[3])):
            if own is None or s >= end:
                own = [c, s, e, 1]
                want.append(own)
                end = e
            else:
                end = max(end, e)
                own[2], own[3] = end, own[3] + 1
    assert got == sorted(map(tuple, want))


def test_islands_with_a_gap(spark):
    rows = [(1, "a", 0, 10), (2, "a", 12, 20), (3, "a", 25, 30)]
    got = iv.islands(frame(spark, rows), ["chrom"], gap=2).orderBy("start").collect()
    assert [(r["start"], r["end"]) for r in got] == [(0, 20), (25, 30)]


def test_subtract(spark):
    a = frame(spark, [(1, "a", 0, 100), (2, "a", 40, 45), (3, "b", 5, 9)])
    b = frame(spark, [(1, "a", 10, 20), (2, "a", 15, 50), (3, "a", 90, 200)])
    got = sorted((r["id"], r["start"], r["end"]) for r in iv.subtract(a, b, "id", bin_size=8).collect())
    assert got == [(1, 0, 10), (1, 50, 90), (3, 5, 9)]


@pytest.mark.parametrize("size", [5, 50, 10_000])
def test_nearest_equals_brute_force(spark, size):
    rng = random.Random(4)
    pts = [(i, rng.choice("ab"), rng.randint(0, 400)) for i in range(25)]
    qs = [(i, rng.choice("abc"), rng.randint(0, 400)) for i in range(60)]
    p, q = spark.createDataFrame(pts, "n long, chrom string, at long"), spark.createDataFrame(qs, "id long, chrom string, c long")
    got = {r["id"]: (r["nearest"], r["distance"]) for r in iv.nearest(q, p, "id", "c", "at", "n", bin_size=size).collect()}
    for i, c, x in qs:
        own = sorted((abs(a - x), a, n) for n, ch, a in pts if ch == c)
        assert got[i] == ((own[0][2], own[0][0]) if own else (None, None))


def test_windows_and_parents(spark):
    axes = spark.createDataFrame([("a", 2300), ("s", 500), ("z", 0)], "chrom string, size long")
    rows = win.parents(win.tile(axes, [1000, 2000])).collect()
    assert len({r["region_id"] for r in rows}) == len(rows)
    small = sorted((r["start"], r["end"]) for r in rows if r["chrom"] == "a" and r["window_size"] == 1000)
    assert small == [(0, 1000), (500, 1500), (1000, 2000), (1300, 2300)]
    assert [(r["start"], r["end"]) for r in rows if r["chrom"] == "s"] == [(0, 500)] * 2
    parent = {r["region_id"]: r["parent_id"] for r in rows}
    assert parent["a:500-1500:1000"] == "a:300-2300:2000" and parent["a:0-1000:1000"] == "a:0-2000:2000"
    assert parent["a:0-2000:2000"] is None


def test_robust_z_without_spread_is_null(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 2.0), ("b", 9.0), ("c", 3.0), ("b", float("nan"))], "g string, x double")
    got = stats.robust_z(df, "x", ["g"]).collect()
    assert all(r["z"] is None for r in got if r["g"] in "ac")
    assert sorted(round(r["z"], 4) for r in got if r["g"] == "b" and r["z"] is not None) == [-0.6745, 0.0, 4.7215]


def test_bh_is_monotone_and_bounded(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.02, 0.03, 0.5, 0.5, None])], "i long, p double")
    got = {r["i"]: r["q"] for r in stats.bh(df, "p").collect()}
    assert got[5] is None and got[0] == pytest.approx(0.05) and got[2] == pytest.approx(0.05) and got[3] == got[4] == pytest.approx(0.5)


def test_leave_group_out_equals_a_refit(spark):
    rng = random.Random(6)
    rows = [("t", g, x, 3 * x + 1 + rng.random()) for g in "abc" for x in [rng.random() * 10 for _ in range(9)]]
    df = spark.createDataFrame(rows, "by string, g string, x double, y double")
    got = {r["g"]: r for r in stats.leave_group_out_line(df, ["by"], "g", "x", "y").collect()}
    for g in "abc":
        want = df.where(F.col("g") != g).agg(F.regr_slope("y", "x").alias("s"), F.regr_intercept("y", "x").alias("i")).first()
        assert got[g]["slope"] == pytest.approx(want["s"]) and got[g]["intercept"] == pytest.approx(want["i"])


def test_empty_tables(spark):
    e, one = frame(spark, []), frame(spark, [(1, "a", 0, 5)])
    assert iv.range_join(e, one).count() == 0 and iv.islands(e, ["chrom"]).count() == 0
    assert iv.with_overlap(one, e, "id").first()["overlaps"] is False
    assert stats.robust_z(spark.createDataFrame([], "x double"), "x").count() == 0
