"""Exact duplicates by progressive refinement: length, then a prefix hash, then the full hash of the rows that are left.

1. One pass counts texts by length in bytes. Lengths with one row end there.
2. A second pass hashes the first characters of the texts of other lengths, and counts (length, prefix hash) pairs.
   Counts are combined before the shuffle, so a length or a prefix that many rows have costs one row a task.
3. A third pass takes the SHA-256 of a text only where its pair has several rows. Rows with the same SHA-256 are one
   group; the largest id stays.

Each pass tells the next which texts survive by a broadcast bitmap of hashes, with eight bits or more a survivor and
``MOST_BITS`` at most, so the broadcast has a bound whatever the input. A bit set by chance costs a hash, no more; beyond
some 2 ** 23 survivors the bitmap fills and more texts are hashed than need be, with the same result.

A null text counts as empty. A null id loses to any other; in a group of null ids all stay. Rows that repeat an id and
its text are equal texts: all of them have kept = true if theirs is the largest id, and ``drop_duplicates`` keeps one.
An empty table gives an empty result. Texts of any length are hashed whole; other columns pass unread, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded, durable, fresh, with_group

PREFIX = 64
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26


def _bitmap(keys: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(_w, _bits): the 64-bit words of a bitmap in which the bit of each ``key`` is set, and its size."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * keys.count()).bit_length()))
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    word = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int")))
    return keys.groupBy((at / 64).cast("int").alias("_w")).agg(word.alias("_bits")), bits


def _with_bit(rows: DataFrame, key: Column, bitmap: tuple[DataFrame, int], out: str) -> DataFrame:
    """``rows`` with ``out``: whether the key's bit is set."""
    words, bits = bitmap
    at = F.pmod(F.xxhash64(key), F.lit(bits))
    got = rows.join(F.broadcast(words), (at / 64).cast("int") == F.col("_w"), "left")
    return got.withColumn(out, F.coalesce(F.call_function("getbit", F.col("_bits"), (at % 64).cast("int")) == 1, F.lit(False))).drop("_w", "_bits")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", also: dict[str, Column] | None = None) -> DataFrame:
    """One row a row of ``docs``: doc_id, keep_id, group_size, kept, text_hash (null where not read in full), and ``also``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    length, head = F.octet_length("_text"), F.xxhash64(F.octet_length("_text"), F.substring("_text", 1, PREFIX))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("_text"), *[c.alias(k) for k, c in (also or {}).items()])

    several = lambda df, key: durable(df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "several")
    lengths = _bitmap(several(rows, length), "key")
    heads = _bitmap(several(_with_bit(rows.select("_text"), length, lengths, "_several").where("_several"), head), "key")
    rows = _with_bit(rows, head, heads, "_several")
    rows = durable(rows.select("doc_id", F.when(F.col("_several"), F.sha2("_text", 256)).alias("text_hash"), *(also or {})), "hashes")
    groups = rows.where("text_hash is not null").groupBy("text_hash").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = durable(groups.where("group_size > 1"), "groups")
    out = with_group(rows, groups, "text_hash", "group_size", rows.count())
    keep = F.coalesce("keep_id", "doc_id")
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_hash",
        *(also or {}),
    )


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each text, all columns as they were. Only texts with the id of a row to drop are hashed again."""
    found = durable(exact_groups(docs, id_col, text_col), "exact")
    own_id, own_sha = fresh(docs.columns, "_id"), fresh(docs.columns, "_sha")
    gone = found.where("not kept").select(F.col("doc_id").alias(own_id), F.col("text_hash").alias(own_sha)).distinct()
    sha = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    # Null ids join under an id of their own; the hash is compared after the ids, so it is no key of the join.
    same = F.col(id_col).cast("long").eqNullSafe(F.col(own_id)) & F.when(F.concat(sha, F.lit("")) == F.col(own_sha), True).otherwise(False)
    out = docs.join(bounded(gone), same, "left_anti")
    again = found.where("kept and text_hash is not null").groupBy("text_hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = durable(again.select(F.col("text_hash").alias(own_sha)), "again")
    if again.isEmpty():
        return out
    once = out.join(bounded(again), sha == F.col(own_sha), "left_semi").withColumn(own_sha, sha).dropDuplicates([own_sha]).drop(own_sha)
    return out.join(bounded(again), sha == F.col(own_sha), "left_anti").unionByName(once)
