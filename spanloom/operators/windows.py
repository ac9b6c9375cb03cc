"""Sliding windows over named axes, at one or several sizes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def tile(axes: DataFrame, sizes: list[int], step_fraction: float = 0.5, axis: str = "chrom", size: str = "size", parents: bool = False) -> DataFrame:
    """Windows of each size over each axis: region_id, axis, start, end, window_size, scale_level, and with ``parents`` parent_id.

    Starts are a step apart; a last window is aligned to the axis's end where the steps do not reach it. An axis
    shorter than a window has one window, cut at its end. The parent is, of the least larger size that has one, the last
    window that holds this one whole. On a grid it is known from the place alone: the last window that starts no later,
    which is the grid's or the one at the axis's end; no join is needed.
    """
    levels = [(int(s), max(1, int(s * step_fraction))) for s in sorted(set(sizes))]
    grid = F.array(*[F.struct(F.lit(w).cast("long").alias("w"), F.lit(step).cast("long").alias("step"), F.lit(i).alias("level")) for i, (w, step) in enumerate(levels)])
    rows = axes.where(F.col(size) > 0).select(F.col(axis), F.col(size).cast("long").alias("_size"), F.explode(grid).alias("g"))
    last = F.greatest(F.col("_size") - F.col("g.w"), F.lit(0).cast("long"))
    starts = F.sequence(F.lit(0).cast("long"), last, F.col("g.step"))
    starts = F.when(last % F.col("g.step") != 0, F.concat(starts, F.array(last))).otherwise(starts)
    rows = rows.select(axis, "_size", "g", F.explode(starts).alias("start"))
    end = F.least(F.col("_size"), F.col("start") + F.col("g.w"))
    name = lambda a, e, w: F.format_string("%s:%d-%d:%d", F.col(axis), a, e, w)
    found = []
    for i, (w, step) in enumerate(levels):
        w, at_end = F.lit(w).cast("long"), F.greatest(F.col("_size") - w, F.lit(0).cast("long"))
        a = F.when(at_end <= F.col("start"), at_end).otherwise(F.expr(f"start div {step}") * step)
        e = F.least(F.col("_size"), a + w)
        found.append(F.when((F.col("g.level") < i) & (e >= end), name(a, e, w)))
    return rows.select(
        name(F.col("start"), end, F.col("g.w")).alias("region_id"),
        axis,
        "start",
        end.alias("end"),
        F.col("g.w").alias("window_size"),
        F.col("g.level").alias("scale_level"),
        *([F.coalesce(*found).alias("parent_id")] if parents else []),
    )


def parents(windows: DataFrame, axis: str = "chrom") -> DataFrame:
    """``windows`` of any origin with parent_id: of the least larger size that has one, the last window that holds it whole.

    For windows that ``tile`` makes, its ``parents`` does the same without a join.

    Each window is offered to the grid cells (a step wide) of its span; a child looks in the cell of its own start at
    every higher level. An equi-join on (axis, level, cell); no sweep over an axis.
    """
    step = windows.groupBy(F.col("scale_level").alias("_level")).agg(F.coalesce(F.min(F.when(F.col("start") > 0, F.col("start"))), F.max("window_size")).alias("_step"))
    step = F.broadcast(step)  # a row for each window size
    larger = windows.select(F.col(axis).alias("_axis"), F.col("scale_level").alias("_level"), F.col("start").alias("_start"), F.col("end").alias("_end"), F.col("region_id").alias("_id"))
    larger = larger.join(step, "_level").withColumn("_cell", F.explode(F.expr("sequence(_start div _step, greatest(_start, _end - 1) div _step)")))
    own = windows.select("region_id", axis, "start", "end", "scale_level").join(step, F.col("_level") > F.col("scale_level"))
    own = own.withColumn("_cell", F.expr("start div _step")).withColumnRenamed("_level", "_want").drop("_step")
    same = (F.col(axis) == F.col("_axis")) & (F.col("_want") == F.col("_level")) & own["_cell"].eqNullSafe(larger["_cell"])
    hit = own.join(larger.hint("merge"), same & (F.col("_start") <= F.col("start")) & (F.col("_end") >= F.col("end")))
    best = hit.groupBy(F.col("region_id").alias("_rid")).agg(F.max_by("_id", F.struct(-F.col("_level"), "_start")).alias("parent_id"))
    return windows.join(best, F.col("region_id") == F.col("_rid"), "left").drop("_rid")


def with_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of ``schema`` in its order and types; those that are missing are null, others are dropped."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def children(windows: DataFrame) -> DataFrame:
    """parent_id, n_children and child_ids (joined by ``,`` in order of their starts) of windows with ``parent_id``.

    A parent has as many children as smaller windows fit in it, which the sizes bound.
    """
    each = windows.where(F.col("parent_id").isNotNull()).groupBy("parent_id")
    got = each.agg(F.array_sort(F.collect_list(F.struct("scale_level", "start", "region_id"))).alias("c"))
    return got.select("parent_id", F.size("c").alias("n_children"), F.array_join(F.transform("c", lambda x: x["region_id"]), ",").alias("child_ids"))


def base_stats(axes: DataFrame, sizes: list[int], step_fraction: float = 0.5, axis: str = "chrom", seq: str = "seq", run: int = 5, letters: int = 1 << 24) -> DataFrame:
    """For each window that ``tile`` makes: axis, start, end, window_size, gc (of A, C, G and T; null without any), n_fraction,
    and low_complexity, the share of letters in runs of one letter of at least ``run`` on the axis.

    Each string is read once; prefix sums over at most some ``letters`` letters at a time answer every window inside.
    """
    levels = [(int(s), max(1, int(s * step_fraction))) for s in sorted(set(sizes))]
    src = axes.select(F.col(axis).cast("string").alias("axis"), F.col(seq).alias("seq"))
    names = ["axis", "start", "end", "window_size", "gc", "n_fraction", "low_complexity"]

    def run_over(batches):
        for batch in batches:
            for name, text in zip(batch.column("axis"), batch.column("seq")):
                if not text.is_valid or not len(text.as_buffer()):
                    continue
                x = np.frombuffer(text.as_buffer(), np.uint8)
                edge = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1], [True])))
                masks = (np.isin(x, np.frombuffer(b"GC", np.uint8)), x == ord("N"), np.repeat(np.diff(edge) >= run, np.diff(edge)))
                for w, step in levels:
                    last = max(len(x) - w, 0)
                    starts = np.arange(0, last + 1, step)
                    starts = np.append(starts, last) if last % step else starts
                    some = max(1, letters // step)
                    for at in range(0, len(starts), some):
                        a = starts[at : at + some]
                        b = np.minimum(a + w, len(x))
                        sums = []
                        for m in masks:
                            c = np.concatenate(([0], np.cumsum(m[a[0] : b[-1]], dtype=np.int64)))
                            sums.append(c[b - a[0]] - c[a - a[0]])
                        n = b - a
                        gc = pa.array(sums[0] / np.maximum(n - sums[1], 1), mask=n == sums[1])
                        columns = [pa.array([name.as_py()] * len(a), pa.string()), a, b, np.full(len(a), w), gc, sums[1] / n, sums[2] / n]
                        yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    return src.mapInArrow(run_over, "axis string, start long, end long, window_size long, gc double, n_fraction double, low_complexity double").withColumnRenamed("axis", axis)


def running(df: DataFrame, by: list[str], order: list[str]) -> Window:
    """A window from the group's first row up to the current one."""
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
