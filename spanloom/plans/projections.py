"""The driver's tables seen as sequences and intervals, the same in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FROM = "abcdefghijklmnopqrstuvwxyz"
TO = ("ACGT" * 7)[:26]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, chrom (the source), q: the letters of a text mapped to A, C, G and T."""
    q = F.translate(F.regexp_replace(F.lower("text"), "[^a-z]", ""), FROM, TO)
    return table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("chrom"), q.alias("q"))


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, chrom (the user), start, end, event_type, value: seconds since 2024, longer for larger values."""
    start = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz)) div 1000000")
    ev = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("chrom"), start.alias("start"), "event_type", "value")
    return ev.select("event_id", "chrom", "start", (F.col("start") + 60 + F.floor("value") * 10).alias("end"), "event_type", "value")


SEQS = f"seqs AS (SELECT doc_id, source AS chrom, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), '{FROM}', '{TO}') AS q FROM documents)"
IV = """ev AS (SELECT event_id, 'u' || user_id AS chrom, (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000000 AS s, event_type, value FROM events),
iv AS (SELECT event_id, chrom, s, s + 60 + CAST(floor(value) AS BIGINT) * 10 AS e, event_type, value FROM ev)"""
