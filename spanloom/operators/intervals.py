"""Joins and sweeps over half-open intervals [start, end) on named axes.

Every operator deals rows by (axis, bin of coordinates), never by axis alone, so one long or popular axis spreads over
many tasks; what has to be carried from bin to bin is first reduced to a row a bin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 1 << 14


def length(start: str = "start", end: str = "end") -> Column:
    return F.col(end) - F.col(start)


def overlap_length(a: str, b: str) -> Column:
    """Shared length of the intervals of two aliased sides, 0 if they do not meet."""
    return F.greatest(F.lit(0), F.least(f"{a}.end", f"{b}.end") - F.greatest(f"{a}.start", f"{b}.start"))


def _binned(df: DataFrame, size: int, name: str) -> DataFrame:
    first = F.expr(f"start div {size}")
    last = F.expr(f"greatest(start, end - 1) div {size}")
    return df.withColumn(f"{name}_first", first).withColumn("bin", F.explode(F.sequence(first, last)))


def range_join(left: DataFrame, right: DataFrame, axis: str = "chrom", bin_size: int = BIN) -> DataFrame:
    """Pairs that overlap, as two structs ``l`` and ``r``.

    An equi-join on (axis, bin); of the bins that both intervals cover only the first counts, so no pair comes twice.
    Empty intervals overlap with nothing.
    """
    a = _binned(left.where("start < end").select(F.struct("*").alias("l"), axis, "start", "end"), bin_size, "l")
    b = _binned(right.where("start < end").select(F.struct("*").alias("r"), axis, "start", "end"), bin_size, "r")
    a, b = a.alias("a"), b.alias("b")
    meet = (F.col(f"a.{axis}") == F.col(f"b.{axis}")) & (F.col("a.bin") == F.col("b.bin"))
    over = (F.col("a.start") < F.col("b.end")) & (F.col("a.end") > F.col("b.start"))
    once = F.col("a.bin") == F.greatest("a.l_first", "b.r_first")
    return a.join(b.hint("merge"), meet & over & once).select("l", "r")  # exploded sides are larger than their estimate


def with_overlap(left: DataFrame, right: DataFrame, key: str, axis: str = "chrom", bin_size: int = BIN) -> DataFrame:
    """``left`` with ``overlaps``: whether any interval of ``right`` overlaps."""
    hit = range_join(left.select(key, axis, "start", "end"), right.select(axis, "start", "end"), axis, bin_size)
    hit = hit.select(F.col(f"l.{key}").alias("_k")).distinct()
    return left.join(hit, F.col(key) == F.col("_k"), "left").withColumn("overlaps", F.col("_k").isNotNull()).drop("_k")


def keep_overlapping(left: DataFrame, right: DataFrame, key: str, axis: str = "chrom", bin_size: int = BIN, anti: bool = False) -> DataFrame:
    """Semi-join by overlap, or anti-join."""
    hit = range_join(left.select(key, axis, "start", "end"), right.select(axis, "start", "end"), axis, bin_size)
    hit = hit.select(F.col(f"l.{key}").alias("_k")).distinct()
    return left.join(hit, F.col(key) == F.col("_k"), "left_anti" if anti else "left_semi")


def coverage(left: DataFrame, right: DataFrame, key: str, axis: str = "chrom", value: str | None = None, bin_size: int = BIN, present: bool = False) -> DataFrame:
    """Per left interval: n_overlaps, overlap_bp (a sum, not a union), fraction (at most 1), and with ``value`` its
    overlap-weighted mean over the whole interval (null where nothing overlaps; a null value weighs as 0), or with
    ``present`` over the overlaps that have a finite value."""
    cols = [axis, "start", "end"] + ([value] if value else [])
    pairs = range_join(left.select(key, axis, "start", "end"), right.select(*cols), axis, bin_size)
    bp = overlap_length("l", "r")
    aggs = [F.count(F.lit(1)).alias("n_overlaps"), F.sum(bp).alias("overlap_bp")]
    if value:
        v = F.col(f"r.{value}").cast("double")
        good = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
        aggs.append(F.sum(F.when(good, bp * v) if present else bp * F.coalesce(F.col(f"r.{value}"), F.lit(0))).alias("_weighted"))
        aggs.append(F.sum(F.when(good, bp)).alias("_present"))
    got = pairs.groupBy(F.col(f"l.{key}").alias("_k")).agg(*aggs)
    out = left.join(got, F.col(key) == F.col("_k"), "left").drop("_k")
    zero = F.lit(0).cast("long")
    out = out.withColumns({"n_overlaps": F.coalesce("n_overlaps", zero), "overlap_bp": F.coalesce("overlap_bp", zero)})
    out = out.withColumn("fraction", F.least(F.lit(1.0), F.try_divide(F.col("overlap_bp"), length())))
    if value:
        out = out.withColumn("mean_value", F.try_divide(F.col("_weighted"), F.col("_present") if present else length())).drop("_weighted", "_present")
    return out


def collect_values(left: DataFrame, right: DataFrame, key: str, value: str, order: str, most: int = 5, axis: str = "chrom", bin_size: int = BIN) -> DataFrame:
    """Per left interval the first ``most`` distinct values of overlapping intervals by (start, end, ``order``), joined by ``;``."""
    pairs = range_join(left.select(key, axis, "start", "end"), right.select(axis, "start", "end", value, order), axis, bin_size)
    first = pairs.groupBy(F.col(f"l.{key}").alias("_k"), F.col(f"r.{value}").alias("v")).agg(F.min(F.struct("r.start", "r.end", F.col(f"r.{order}").alias("o"))).alias("at"))
    got = first.groupBy("_k").agg(F.array_sort(F.collect_list(F.struct("at", "v"))).alias("vs"))
    got = got.select("_k", F.array_join(F.transform(F.slice("vs", 1, most), lambda x: x["v"].cast("string")), ";").alias("values"))
    return left.join(got, F.col(key) == F.col("_k"), "left").drop("_k")


def islands(df: DataFrame, by: list[str], gap: int = 0, bin_size: int = BIN, keep: list[Column] | None = None, combine: list[Column] | None = None) -> DataFrame:
    """Merges intervals of each ``by`` group that overlap (or lie at most ``gap`` apart, if over 0): start, end, n_members.

    Bins of starts are swept one by one. What reaches over a bin's edge is the furthest end so far and the island that is
    open there; both come from a row a bin, and bins are so wide that they hold some 1000 rows of the group on average or
    more. So no task sorts a whole axis. ``keep`` are aggregates over rows and ``combine`` those that put them together, under the same names.
    """

    def same(pairs: list[tuple[str, str]]) -> Column:
        out = F.lit(True)
        for a, b in pairs:
            out = out & F.col(a).eqNullSafe(F.col(b))
        return out

    names = [(c, f"_g{i}") for i, c in enumerate(by)]
    wide = df.groupBy(*[F.col(c).alias(n) for c, n in names]).agg(F.greatest(F.lit(bin_size), F.expr("cast((max(start) - min(start)) * 1024.0 / count(1) as bigint)")).alias("_wide"))
    rows = df.join(wide, same(names), "left").withColumn("_bin", F.expr("floor(start / _wide)")).drop("_wide", *[n for _, n in names])
    bins = rows.groupBy(*[F.col(c).alias(n) for c, n in names], F.col("_bin").alias("_b")).agg(F.max("end").alias("_most"))
    along = Window.partitionBy(*[n for _, n in names]).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(*[n for _, n in names], "_b", F.max("_most").over(along).alias("_carry"))
    rows = rows.join(bins, same([*names, ("_bin", "_b")]), "left").drop("_b", *[n for _, n in names])
    w = Window.partitionBy(*by, "_bin").orderBy("start", "end")
    before = F.greatest(F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)), "_carry")
    apart = F.col("start") > before + gap if gap else F.col("start") >= before
    rows = rows.withColumn("_new", F.coalesce(apart, F.lit(True)).cast("int")).drop("_carry")
    rows = rows.withColumn("_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))  # 0: goes on from a bin before
    part = rows.groupBy(*by, "_bin", "_no").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n_members"), *(keep or []))
    open_ = rows.groupBy(*[F.col(c).alias(n) for c, n in names], F.col("_bin").alias("_b")).agg(F.max("_no").alias("_top"))
    latest = F.last(F.when(F.col("_top") > 0, F.struct(F.col("_b").alias("b"), F.col("_top").alias("n"))), ignorenulls=True).over(along)
    open_ = open_.select(*[n for _, n in names], "_b", latest.alias("_from"))
    part = part.join(open_, same([*names, ("_bin", "_b")]), "left")
    part = part.withColumn("_island", F.when(F.col("_no") > 0, F.struct(F.col("_bin").alias("b"), F.col("_no").alias("n"))).otherwise(F.col("_from")))
    merged = part.groupBy(*by, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n_members").alias("n_members"), *(combine or []))
    return merged.drop("_island")


def subtract(left: DataFrame, right: DataFrame, key: str, axis: str = "chrom", bin_size: int = BIN) -> DataFrame:
    """The pieces of each left interval that no right interval covers: key, axis, start, end."""
    merged = islands(right.select(axis, "start", "end").where("start < end"), [axis], bin_size=bin_size)
    hit = range_join(left.select(key, axis, "start", "end"), merged.select(axis, "start", "end"), axis, bin_size)
    holes = hit.groupBy(F.col(f"l.{key}").alias("_k")).agg(F.array_sort(F.collect_list(F.struct("r.start", "r.end"))).alias("h"))
    rows = left.select(key, axis, "start", "end").join(holes, F.col(key) == F.col("_k"), "left")
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)")
    rows = rows.withColumn("h", F.coalesce("h", none))
    starts = F.concat(F.array("start"), F.transform("h", lambda x: x["end"]))
    ends = F.concat(F.transform("h", lambda x: x["start"]), F.array("end"))
    pieces = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = rows.select(key, axis, F.explode(pieces).alias("p")).where("p.a < p.b")
    return rows.select(key, axis, F.col("p.a").alias("start"), F.col("p.b").alias("end"))


def nearest(queries: DataFrame, points: DataFrame, key: str, at: str, point: str, name: str, axis: str = "chrom", bin_size: int = BIN, side: str = "both") -> DataFrame:
    """``queries`` with the nearest point's ``name`` and its distance; of two as near, the one on the left; of several at
    one place, the least name. Null where the axis has no such point. ``side``: left takes points at or before the
    query, right those at or after it.

    Points and queries are swept within (axis, bin); a query without a point on one side of its bin takes it from a
    table with the last and first point of each bin, carried over empty bins.
    """
    pt = points.groupBy(axis, F.col(point).cast("long").alias("pos")).agg(F.min(name).alias("name"))
    q = queries.select(F.col(key).alias("key"), axis, F.col(at).cast("long").alias("pos"))
    some = F.struct("pos", "name")
    both = pt.select(axis, "pos", F.lit(0).alias("is_q"), F.lit(None).cast(q.schema["key"].dataType).alias("key"), some.alias("pt")).unionByName(
        q.select(axis, "pos", F.lit(1).alias("is_q"), "key", F.lit(None).cast(pt.select(some.alias("s")).schema["s"].dataType).alias("pt"))
    )
    both = both.withColumn("bin", F.expr(f"pos div {bin_size}"))
    w = Window.partitionBy(axis, "bin").orderBy("pos", "is_q")
    both = both.withColumn("left", F.last("pt", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    u = Window.partitionBy(axis, "bin").orderBy("pos", F.desc("is_q"))
    both = both.withColumn("right", F.first("pt", ignorenulls=True).over(u.rowsBetween(0, Window.unboundedFollowing)))
    ends = both.groupBy(axis, "bin").agg(F.max("pt").alias("last"), F.min("pt").alias("first"))
    v = Window.partitionBy(axis).orderBy("bin")
    ends = ends.select(
        F.col(axis).alias("_axis"),
        F.col("bin").alias("_bin"),
        F.last("last", ignorenulls=True).over(v.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first("first", ignorenulls=True).over(v.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    )
    got = both.where("is_q = 1").join(ends, (F.col(axis) == F.col("_axis")) & (F.col("bin") == F.col("_bin")), "left")
    a, b = F.coalesce("left", "before"), F.coalesce("right", "after")
    got = got.withColumn("a", a).withColumn("b", b)
    if side != "both":
        got = got.withColumn("b" if side == "left" else "a", F.lit(None).cast(got.schema["a"].dataType))
    da, db = F.col("pos") - F.col("a.pos"), F.col("b.pos") - F.col("pos")
    use_left = F.col("b").isNull() | (F.col("a").isNotNull() & (da <= db))
    got = got.select(F.col("key").alias("_k"), F.when(use_left, F.col("a.name")).otherwise(F.col("b.name")).alias("nearest"), F.when(use_left, da).otherwise(db).alias("distance"))
    return queries.join(got, F.col(key) == F.col("_k"), "left").drop("_k")


def spacing(df: DataFrame, anchors: DataFrame, key: str, axis: str = "chrom", bin_size: int = BIN) -> DataFrame:
    """Distance to the nearest anchor that ends at or before the interval's start, and to the nearest that starts at or
    after its end: key, left_distance, right_distance."""
    ends = anchors.select(axis, F.col("end").alias("p"), F.lit(0).alias("n"))
    starts = anchors.select(axis, F.col("start").alias("p"), F.lit(0).alias("n"))
    a = nearest(df.select(key, axis, "start"), ends, key, "start", "p", "n", axis, bin_size, "left").select(key, F.col("distance").alias("left_distance"))
    b = nearest(df.select(key, axis, "end"), starts, key, "end", "p", "n", axis, bin_size, "right").select(F.col(key).alias("_k2"), F.col("distance").alias("right_distance"))
    return a.join(b, F.col(key) == F.col("_k2"), "left").drop("_k2")


def nearest_interval(df: DataFrame, others: DataFrame, key: str, axis: str = "chrom", bin_size: int = BIN) -> DataFrame:
    """key and distance: 0 where an interval of ``others`` overlaps, else from the middle to the nearest start or end of any; null without any."""
    edges = others.where("start < end").select(axis, F.explode(F.array("start", "end")).alias("p"), F.lit(0).alias("n"))
    middle = df.select(key, axis, F.expr("(start + end) div 2").alias("m"))
    near = nearest(middle, edges, key, "m", "p", "n", axis, bin_size).select(F.col(key).alias("_k2"), F.col("distance").alias("_d"))
    hit = with_overlap(df.select(key, axis, "start", "end"), others, key, axis, bin_size)
    return hit.join(near, F.col(key) == F.col("_k2"), "left").select(key, F.when(F.col("overlaps"), F.lit(0).cast("long")).otherwise(F.col("_d")).alias("distance"))


# Parts of the names of sequences that are not placed on a chromosome.
UNPLACED = ("unplaced", "unlocalized", "random", "un_", "chrunknown", "scaffold", "contig")


def unplaced(name: Column) -> Column:
    """Whether the name of an axis holds one of the words for sequences without a place."""
    low = F.lower(name)
    found = F.lit(False)
    for word in UNPLACED:
        found = found | low.contains(word)
    return found


# Names of feature types, in lower case.
FEATURES = {"gene": ("gene", "pseudogene", "lnc_rna_gene"), "exon": ("exon", "cds")}


def of_type(df: DataFrame, kind: str, feature: str = "feature") -> DataFrame:
    """The rows of a feature table that are genes, exons, or (``utr``) untranslated regions, whatever the case."""
    low = F.lower(feature)
    return df.where(low.contains("utr") if kind == "utr" else low.isin(*FEATURES[kind]))


def edge_distance(size: Column, start: str = "start", end: str = "end") -> Column:
    """Distance to the nearer end of the axis, 0 at least."""
    return F.greatest(F.lit(0), F.least(F.col(start), size - F.col(end)))


def upstream(df: DataFrame, bp: int) -> DataFrame:
    """The ``bp`` before each feature in its direction: tss, promoter_start, promoter_end; cut at 0."""
    minus = F.col("strand") == "-"
    return df.withColumns({
        "tss": F.when(minus, F.col("end")).otherwise(F.col("start")),
        "promoter_start": F.when(minus, F.col("end")).otherwise(F.greatest(F.lit(0), F.col("start") - bp)),
        "promoter_end": F.when(minus, F.col("end") + bp).otherwise(F.col("start")),
    })


def block_id(size: int, axis: str = "chrom", start: str = "start") -> Column:
    return F.concat_ws(":", F.col(axis), F.expr(f"cast({start} div {size} as string)"))
