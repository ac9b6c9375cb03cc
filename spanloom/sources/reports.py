"""Reports of a run: plots and pages of bounded size, folders of intervals in view, and where the inputs came from.

Whatever reaches the driver is bounded by a parameter: rows of a table shown, bins of a plot."""

from __future__ import annotations

import html
import json
import platform

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import intervals as iv
from spanloom.operators import stats


def put_text(spark: SparkSession, path: str, text: str) -> None:
    """One file with this text on any file system that Spark writes."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.hadoop.fs.Path(path)
    stream = where.getFileSystem(conf).create(where, True)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def bins(df: DataFrame, column: str, most: int = 30) -> list[tuple[float, float, int]]:
    """(low, high, rows) of up to ``most`` equal bins over the finite values, counted in Spark; no bin without such a
    value, one bin where all are equal."""
    good = df.select(stats.finite(F.col(column).cast("double")).alias("v")).where("v is not null")
    low, high, n = good.agg(F.min("v"), F.max("v"), F.count(F.lit(1))).first()
    if not n:
        return []
    if low == high:
        return [(low, high, n)]
    count = min(most, n)
    at = F.least(F.lit(count - 1), F.floor((F.col("v") / 2 - low / 2) / (high / 2 - low / 2) * count)).cast("int")
    got = {r["b"]: r["count"] for r in good.groupBy(at.alias("b")).count().collect()}
    edge = [low + (high / count - low / count) * i for i in range(count)] + [high]
    return [(edge[i], edge[i + 1], got.get(i, 0)) for i in range(count)]


def histogram_svg(found: list[tuple[float, float, int]], title: str, width: int = 480, height: int = 240) -> str:
    """A bar for each bin; a note where there is none."""
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" role="img"><title>{html.escape(title)}</title>'
    if not found:
        return head + f'<text x="10" y="{height // 2}">no finite values</text></svg>'
    top, each, room = max(n for *_, n in found), width / len(found), height - 40
    bars = "".join(
        f'<rect x="{i * each:.1f}" y="{height - 20 - room * n / top:.1f}" width="{max(1.0, each - 1):.1f}" height="{room * n / top:.1f}" fill="#4a6fa5"><title>{a:.4g} to {b:.4g}: {n}</title></rect>'
        for i, (a, b, n) in enumerate(found)
    )
    ends = f'<text x="0" y="{height - 5}" font-size="11">{found[0][0]:.4g}</text><text x="{width}" y="{height - 5}" font-size="11" text-anchor="end">{found[-1][1]:.4g}</text>'
    return head + f'<text x="0" y="14" font-size="13">{html.escape(title)}</text>' + bars + ends + "</svg>"


def table_html(df: DataFrame, rows: int = 20) -> str:
    """The first ``rows`` rows as a table, null as an empty cell; give ``df`` an order to have its top."""
    cells = lambda tag, values: "<tr>" + "".join(f"<{tag}>{'' if v is None else html.escape(str(v))}</{tag}>" for v in values) + "</tr>"
    return "<table>" + cells("th", df.columns) + "".join(cells("td", r) for r in df.limit(rows).collect()) + "</table>"


def write_html(spark: SparkSession, path: str, title: str, tables: dict[str, DataFrame], plots: dict[str, tuple[DataFrame, str]] | None = None, rows: int = 20) -> None:
    """A page with the first ``rows`` rows of each table and a histogram of each (frame, column) of ``plots``."""
    parts = [f"<h2>{html.escape(name)}</h2>{table_html(df, rows)}" for name, df in tables.items()]
    parts += [f"<h2>{html.escape(name)}</h2>{histogram_svg(bins(df, column), name)}" for name, (df, column) in (plots or {}).items()]
    put_text(spark, path, f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{"".join(parts)}</body></html>')


def in_view(focus: DataFrame, others: DataFrame, key: str, sizes: DataFrame | None = None, least: int = 5000, times: int = 4) -> DataFrame:
    """key, view_start, view_end and the columns of ``others`` for every interval that meets a focus's view: the focus
    and the larger of ``least`` and ``times`` its length on both sides, cut at 0 and at the axis's size where one is given."""
    flank = F.greatest(F.lit(least), times * (F.col("end") - F.col("start")))
    views = focus.select(key, "chrom", F.greatest(F.lit(0), F.col("start") - flank).alias("start"), (F.col("end") + flank).alias("end"))
    if sizes is not None:
        own = sizes.select(F.col("chrom").alias("_c"), F.col("size").alias("_n"))
        views = views.join(own, F.col("chrom") == F.col("_c"), "left").withColumn("end", F.least("end", F.coalesce("_n", "end"))).drop("_c", "_n")
    pairs = iv.range_join(views, others)
    return pairs.select(F.col(f"l.{key}").alias(key), F.col("l.start").alias("view_start"), F.col("l.end").alias("view_end"), "r.*")


def write_cards(focus: DataFrame, others: DataFrame, key: str, path: str, name: str = "name", **view) -> None:
    """A folder ``<key>=...`` for each focus, with a BED file of the focus and of the intervals in its view."""
    line = lambda label: F.concat_ws("\t", "chrom", F.col("start").cast("string"), F.col("end").cast("string"), label).alias("value")
    own = focus.select(key, line(F.lit("focus")))
    seen = in_view(focus, others, key, **view).select(key, line(F.coalesce(F.col(name).cast("string"), F.lit("."))))
    rows = own.union(seen)
    rows.repartition(key).sortWithinPartitions(key, "value").write.mode("overwrite").partitionBy(key).text(path)


def inputs(spark: SparkSession, paths: list[str], most: int = 1 << 30) -> DataFrame:
    """path, length, modified, sha256 of every file under the paths, hashed by the executors; a file over ``most`` bytes,
    which would be one value in memory, is told by length and time and has a null hash."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    told = ["path", "length", F.col("modificationTime").alias("modified")]
    small = files.where(F.col("length") <= most).select(*told, F.sha2("content", 256).alias("sha256"))
    return small.union(files.where(F.col("length") > most).select(*told, F.lit(None).cast("string").alias("sha256")))


def write_provenance(spark: SparkSession, out: str, paths: list[str], settings: str, command: str) -> None:
    """``inputs`` (JSON lines), ``settings.json``, ``versions.json`` and ``commands``, to which each run adds a line."""
    if paths:
        inputs(spark, paths).write.mode("overwrite").json(f"{out}/inputs")
    put_text(spark, f"{out}/settings.json", settings)
    put_text(spark, f"{out}/versions.json", json.dumps({"python": platform.python_version(), "pyspark": pyspark.__version__, "spark": spark.version}))
    spark.range(1).select(F.concat_ws("\t", F.current_timestamp().cast("string"), F.lit(command)).alias("value")).write.mode("append").text(f"{out}/commands")
