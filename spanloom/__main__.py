"""Commands: ``python -m spanloom COMMAND --help``. Formats are told by suffix; results are written, never gathered."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom import config
from spanloom.operators import intervals as iv
from spanloom.operators import windows as win
from spanloom.plans import catalogue
from spanloom.sources import readers, reports, synthetic


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end and whatever else the format has; ``row``, a digest of them all, is the same for equal rows only."""
    name = path.lower().rstrip("/")
    if name.endswith((".gff", ".gff3", ".gtf")):
        df = readers.read_gff(spark, path).drop("attrs")
    elif name.endswith((".bedgraph", ".bg", ".bw", ".bigwig")):
        df = readers.read_signal(spark, path)
    elif name.endswith(".vcf"):
        df = readers.read_vcf_copy_numbers(spark, path)
    elif name.endswith(".bed"):
        df = readers.read_bed(spark, path)
    else:
        df = readers.read_table(spark, path)
    df = df.withColumns({"start": F.col("start").cast("long"), "end": F.col("end").cast("long")})
    return df.withColumn("row", F.sha2(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}), 256))


def write(df: DataFrame, path: str) -> None:
    name = path.lower().rstrip("/")
    df = df.drop("row")
    if name.endswith(".bed"):
        extra = [c for c in ("name", "score", "strand") if c in df.columns]
        readers.write_bed(df, path, ["chrom", "start", "end", *extra])
    elif name.endswith((".bedgraph", ".bg")):
        readers.write_bedgraph(df, path, "value")
    elif name.endswith((".json", ".jsonl")):
        readers.write_json(df, path)
    else:
        readers.write_table(df, path, "tsv" if name.endswith(".tsv") else "csv" if name.endswith(".csv") else "parquet")


def _queries(spark, a, s):
    for name in sorted(catalogue.QUERIES):
        print(name)


def _run(spark, a, s):
    if a.name not in catalogue.QUERIES:
        raise SystemExit(f"no query {a.name!r}")
    write(catalogue.QUERIES[a.name](spark, a.data), a.out or f"{s.out}/{a.name}.parquet")


def _convert(spark, a, s):
    write(read_intervals(spark, a.input), a.out)


def _tile(spark, a, s):
    axes = readers.genome_sizes(spark, a.genome or s.genome, a.sizes or s.sizes)
    write(win.tile(axes, list(a.window or s.window_sizes), s.step_fraction if a.step is None else a.step, parents=True), a.out)


def _base_stats(spark, a, s):
    write(win.base_stats(readers.read_fasta(spark, a.genome), list(a.window or s.window_sizes)), a.out)


def _overlap(spark, a, s):
    left, right = read_intervals(spark, a.left), read_intervals(spark, a.right)
    write(iv.keep_overlapping(left, right, "row", anti=a.invert), a.out)


def _coverage(spark, a, s):
    left, right = read_intervals(spark, a.left), read_intervals(spark, a.right)
    own = left.dropDuplicates(["row"])
    figures = iv.coverage(own.select("row", "chrom", "start", "end"), right, "row").select(F.col("row").alias("_k"), "n_overlaps", "overlap_bp", "fraction")
    write(left.join(figures, F.col("row") == F.col("_k")).drop("_k"), a.out)


def _merge(spark, a, s):
    write(iv.islands(read_intervals(spark, a.input), ["chrom"], gap=a.gap), a.out)


def _subtract(spark, a, s):
    left, right = read_intervals(spark, a.left), read_intervals(spark, a.right)
    pieces = iv.subtract(left.dropDuplicates(["row"]).select("row", "chrom", "start", "end"), right, "row")
    pieces = pieces.select(F.col("row").alias("_k"), "start", "end")
    write(left.drop("start", "end").join(pieces, F.col("row") == F.col("_k")).drop("_k"), a.out)


def _synthetic(spark, a, s):
    synthetic.write(spark, a.out, a.lengths, s.seed if a.seed is None else a.seed)


def _report(spark, a, s):
    df = readers.read_table(spark, a.input)
    plots = {c: (df, c) for c in a.plot or ()}
    reports.write_html(spark, a.out, a.title, {"rows": df}, plots, a.rows)


def _cards(spark, a, s):
    focus, others = read_intervals(spark, a.focus).dropDuplicates(["row"]), read_intervals(spark, a.others)
    at = F.concat_ws("_", "chrom", F.col("start").cast("string"), F.col("end").cast("string"))
    reports.write_cards(focus.withColumn("card", at), others if "name" in others.columns else others.withColumn("name", F.lit(None).cast("string")), "card", a.out)


def _provenance(spark, a, s):
    reports.write_provenance(spark, a.out, a.inputs, config.snapshot(s), " ".join(a.command_line))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="spanloom", description="intervals and sequences on Spark")
    top.add_argument("--config", help="a YAML or JSON file of settings")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name, run, text, *options):
        sub = commands.add_parser(name, help=text)
        for flags, extra in options:
            sub.add_argument(*flags, **extra)
        sub.set_defaults(run=run)

    out, window = (("--out",), {"required": True}), (("--window",), {"type": int, "action": "append"})
    one, two = ((("input",), {}),), ((("left",), {}), (("right",), {}))
    add("queries", _queries, "list the registered queries")
    add("run", _run, "run a registered query over a folder of tables", (("name",), {}), (("--data",), {"required": True}), (("--out",), {}))
    add("convert", _convert, "read one format and write another", *one, out)
    add("tile", _tile, "windows of several sizes with their parents", (("--genome",), {}), (("--sizes",), {}), window, (("--step",), {"type": float}), out)
    add("base-stats", _base_stats, "GC, N and low complexity of windows", (("--genome",), {"required": True}), window, out)
    add("overlap", _overlap, "intervals that meet others", *two, (("--invert",), {"action": "store_true"}), out)
    add("coverage", _coverage, "how much of each interval others cover", *two, out)
    add("merge", _merge, "islands of intervals", *one, (("--gap",), {"type": int, "default": 0}), out)
    add("subtract", _subtract, "what others leave of each interval", *two, out)
    add("synthetic", _synthetic, "a synthetic genome with genes and a signal", (("--lengths",), {"type": int, "nargs": "+", "default": [60_000, 40_000]}), (("--seed",), {"type": int}), out)
    add("report", _report, "a page with a table's first rows and histograms", *one, (("--plot",), {"action": "append"}), (("--rows",), {"type": int, "default": 20}), (("--title",), {"default": "Report"}), out)
    add("cards", _cards, "a folder of intervals in view for each focus", (("focus",), {}), (("others",), {}), out)
    add("provenance", _provenance, "hashes of the inputs, settings, versions and the command", (("inputs",), {"nargs": "*"}), out)
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    argv = sys.argv[1:] if argv is None else argv
    a = parser().parse_args(argv)
    a.command_line = argv
    settings = config.load(a.config)
    own = spark is None
    spark = spark or SparkSession.builder.appName("spanloom").getOrCreate()
    try:
        a.run(spark, a, settings)
    finally:
        if own:
            spark.stop()


if __name__ == "__main__":
    main()
