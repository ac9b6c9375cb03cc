"""A training-data pipeline over ``documents``: language, exact and near duplicates, benchmark leaks, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. All but the last return the columns of ``documents``. No stage drops a clean document: the language
stage drops texts that are null or hold no letter.

All stages tell rows by id and text, so rows with a null or repeated id are judged by themselves, and other columns pass
unread, whatever their names. Empty tables and very long texts pass like others; of ties the operators say which stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.bpe import encode_texts, load_ranks
from spanloom.llm.common import bounded, durable, fresh
from spanloom.llm.decontaminate import decontaminate
from spanloom.llm.exact import drop_duplicates
from spanloom.llm.language import UNKNOWN, identify, train, trusted
from spanloom.llm.minhash import near_duplicates

TOKENIZER = "byte_bpe_50k.tiktoken"
#: Pre-tokens that a worker remembers: fewer than by default, as the stages before leave executors less memory.
REMEMBERED = 300_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are null or hold no letter, which the classifier rejects; its choice among languages drops nothing."""
    model = train(docs.where(trusted(F.col("doc_id"))).select("doc_id", "text", "lang"))
    own_id, own_sha, letter = fresh(docs.columns, "_id"), fresh(docs.columns, "_sha"), fresh(docs.columns, "_letter")
    sha = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    has = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    found = identify(docs.select(F.col("doc_id").alias(own_id), sha.alias(own_sha), has.alias(letter), "text"), model, keep=(own_id, own_sha, letter))
    # Texts with letters are ``und`` too where no model could be fitted, or where that is a label.
    gone = durable(found.where((F.col("lang_pred") == UNKNOWN) & ~F.col(letter)).select(own_id, own_sha).distinct(), "rejected")
    # The hash is compared after the ids, so it is taken of texts with such an id only.
    same = F.col("doc_id").eqNullSafe(F.col(own_id)) & F.when(F.concat(sha, F.lit("")) == F.col(own_sha), True).otherwise(False)
    return docs.join(bounded(gone), same, "left_anti")


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest id stays."""
    return drop_duplicates(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five words, Jaccard 0.8) the smallest id stays.

    Rows whose id is null or repeats are documents of their own: they go by a negative number, the hash of their id and
    text, so equal rows stay or go together.
    """
    own_key, own_id, own_gone = fresh(docs.columns, "_key"), fresh(docs.columns, "_again"), fresh(docs.columns, "_gone")
    again = docs.groupBy(F.col("doc_id").alias(own_id)).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(own_id)
    again = bounded(durable(again, "again"))
    other = F.col("doc_id").isNull() | F.col(own_id).isNotNull()
    key = F.when(other, -1 - F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 62))).otherwise(F.col("doc_id").cast("long"))
    keyed = docs.join(again, F.col("doc_id") == F.col(own_id), "left").withColumn(own_key, key)
    found = near_duplicates(keyed.select(own_key, "text"), id_col=own_key)
    gone = durable(found.where("not kept").select(F.col("doc_id").alias(own_gone)).distinct(), "near")
    return keyed.join(bounded(gone), F.col(own_key) == F.col(own_gone), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows that hold a stretch of a test item, told by id and text."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (array of integers), and whether decoding gives the text back."""
    import public_tokenizers

    vocabulary, pattern = load_ranks(public_tokenizers.path(TOKENIZER)), public_tokenizers.PATTERN
    src = docs.select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("_sha"))
    coded = encode_texts(src, vocabulary, pattern, decoded_col="decoded", packed=False, remembered=REMEMBERED)
    same = (F.sha2("decoded", 256) == F.col("_sha")).alias("round_trip")
    # Written here, so that texts go to Python in small batches whatever the caller does with the result.
    return durable(coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same), "tokens")


STAGES = [
    ("language", language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_leaks", benchmark_leaks),
    ("tokens", tokens),
]

#: Language models, MinHash and BPE are beyond SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
