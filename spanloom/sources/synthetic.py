"""Synthetic genomes with genes and a signal: every row is a function of its place and a seed, so any size is made in parallel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.sources import readers

CHUNK = 2000


def _uniform(*parts: Column) -> Column:
    """A number from 0 to 1, excluding 1, that depends on the parts alone."""
    return F.pmod(F.xxhash64(*parts), F.lit(1_000_003)) / 1_000_003


def sizes(spark: SparkSession, lengths: list[int]) -> DataFrame:
    """chrom (s1, s2, ...), size."""
    return spark.createDataFrame([(f"s{i + 1}", n) for i, n in enumerate(lengths)], "chrom string, size long")


def genome(spark: SparkSession, lengths: list[int], seed: int = 4099) -> DataFrame:
    """chrom, start, seq: tiles of up to ``CHUNK`` letters; the share of G and C drifts from tile to tile, and one tile in
    eleven is a tandem repeat of four letters."""
    tiles = sizes(spark, lengths).where("size > 0").select("chrom", "size", F.explode(F.expr(f"sequence(0L, size - 1, {CHUNK}L)")).alias("start"))
    at = F.sequence(F.lit(0), (F.least(F.lit(CHUNK), F.col("size") - F.col("start")) - 1).cast("int"))
    gc = 0.3 + 0.4 * _uniform(F.lit(seed), F.lit("gc"), "chrom", "start")

    def letter(i: Column) -> Column:
        u, v = _uniform(F.lit(seed), F.col("chrom"), F.col("start"), i), _uniform(F.lit(seed + 1), F.col("chrom"), F.col("start"), i)
        return F.when(u < gc, F.when(v < 0.5, "G").otherwise("C")).otherwise(F.when(v < 0.5, "A").otherwise("T"))

    repeat = F.pmod(F.col("start") / CHUNK, F.lit(11)) == 7
    body = F.transform(at, lambda i: F.when(repeat, letter(F.pmod(i, F.lit(4)))).otherwise(letter(i)))
    return tiles.select("chrom", "start", F.array_join(body, "").alias("seq"))


def whole(tiles: DataFrame) -> DataFrame:
    """chrom, seq of tiles: a sequence is one value, as FASTA has it."""
    parts = tiles.groupBy("chrom").agg(F.array_sort(F.collect_list(F.struct("start", "seq"))).alias("p"))
    return parts.select("chrom", F.array_join(F.transform("p", lambda x: x["seq"]), "").alias("seq"))


def genes(spark: SparkSession, lengths: list[int], seed: int = 4099, every: int = 5000) -> DataFrame:
    """chrom, start, end, name, score, strand: a gene in the first half of each whole ``every`` places."""
    slots = sizes(spark, lengths).where(F.col("size") >= every).select("chrom", F.explode(F.expr(f"sequence(0L, size - {every}, {every}L)")).alias("slot"))
    u = lambda name: _uniform(F.lit(seed), F.lit(name), "chrom", "slot")
    start = F.col("slot") + F.floor(u("start") * (every // 4))
    got = slots.withColumn("start", start).withColumn("end", F.col("start") + every // 20 + F.floor(u("length") * (every // 5)))
    name = F.concat(F.lit("gene_"), F.col("chrom"), F.lit("_"), (F.col("slot") / every).cast("long").cast("string"))
    return got.select("chrom", "start", "end", name.alias("name"), F.lit("0").alias("score"), F.when(u("strand") < 0.5, "+").otherwise("-").alias("strand"))


def signal(spark: SparkSession, lengths: list[int], seed: int = 4099, every: int = 500) -> DataFrame:
    """chrom, start, end, value: a value from 0 to 1 for every ``every`` places, the last of a sequence cut at its end."""
    slots = sizes(spark, lengths).where("size > 0").select("chrom", "size", F.explode(F.expr(f"sequence(0L, size - 1, {every}L)")).alias("start"))
    return slots.select("chrom", "start", F.least("size", F.col("start") + every).alias("end"), _uniform(F.lit(seed), F.lit("signal"), "chrom", "start").alias("value"))


def write(spark: SparkSession, out: str, lengths: list[int], seed: int = 4099) -> None:
    """genome.fa, sizes.tsv, genes.bed and signal.bedgraph under ``out``."""
    readers.write_fasta(whole(genome(spark, lengths, seed)), f"{out}/genome.fa")
    readers.write_sizes(sizes(spark, lengths), f"{out}/sizes.tsv")
    readers.write_bed(genes(spark, lengths, seed), f"{out}/genes.bed", ["chrom", "start", "end", "name", "score", "strand"])
    readers.write_bedgraph(signal(spark, lengths, seed), f"{out}/signal.bedgraph", "value")
