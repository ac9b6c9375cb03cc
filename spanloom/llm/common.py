"""Shared plumbing of the training-data operators: durable tables, bounded broadcasts, hot keys."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import threading
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key list of at most this many rows (about 16 bytes each) is broadcast; above it the join shuffles.
BROADCAST_ROWS = 500_000
#: A Python worker handles at most this many rows and bytes of an Arrow batch at a time (a longer row by itself).
BATCH_ROWS = 500
BATCH_BYTES = 4 << 20
#: A key with more than 1/HOT_SHARE of all rows is hot; by counting there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000
#: The C library; malloc_trim is glibc's.
_C = ctypes.CDLL(None)
_kept: dict = {}
_ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: By session, how many writes hold the bound on Arrow batches just now, and the setting before them.
_bounds: dict[str, list] = {}
_lock = threading.Lock()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where unset, a local one, on a local master only."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


@contextmanager
def small_batches(spark: SparkSession):
    """Within it Spark cuts Arrow batches at BATCH_BYTES (a longer row by itself), or at the session's bound where that is less.

    Executors hold some four copies of a batch beside their heap, and keep that memory. Once nothing is within it, the
    setting is as it was; threads that share a session may overlap.
    """
    session = spark._jsparkSession.sessionUUID()
    with _lock:
        if session not in _bounds:
            now = int(spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch())
            _bounds[session] = [0, spark.conf.get(_ARROW_BYTES) if spark._jsparkSession.conf().contains(_ARROW_BYTES) else None]
            if not 0 < now <= BATCH_BYTES:
                spark.conf.set(_ARROW_BYTES, str(BATCH_BYTES))
        _bounds[session][0] += 1
    try:
        yield
    finally:
        with _lock:
            _bounds[session][0] -= 1
            if not _bounds[session][0]:
                before = _bounds.pop(session)[1]
                spark.conf.unset(_ARROW_BYTES) if before is None else spark.conf.set(_ARROW_BYTES, before)


def _write(df: DataFrame, path: str) -> None:
    with small_batches(df.sparkSession):
        df.write.parquet(path)


def durable(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again, which cuts its lineage.

    The files outlive any executor, so a lost one costs a re-read only.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    _write(df, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces(batch):
    """Slices of an Arrow batch with at most BATCH_ROWS rows, and BATCH_BYTES bytes where they have several rows."""
    if batch.num_rows > BATCH_ROWS:
        for at in range(0, batch.num_rows, BATCH_ROWS):
            yield from pieces(batch.slice(at, BATCH_ROWS))
    elif batch.num_rows > 1 and batch.nbytes > BATCH_BYTES:
        half = batch.num_rows // 2
        yield from pieces(batch.slice(0, half))
        yield from pieces(batch.slice(half))
    else:
        yield batch


def give_back() -> None:
    """Returns the memory that Arrow and the C library have free to the system; a worker that lives on would keep it."""
    pa.default_memory_pool().release_unused()
    if hasattr(_C, "malloc_trim"):
        _C.malloc_trim(0)


def kept(key: tuple, make):
    """``make()`` of the first call with ``key`` in this Python worker, held for the tasks of the same ``map_arrow``."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def _begin(work: str) -> None:
    if _kept.get("work") != work:
        _kept.clear()
        _kept["work"] = work
        gc.collect()  # what was held may be in cycles


def map_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``mapInArrow`` over small pieces of Spark's batches, as texts are long and a worker holds several copies of a piece.

    Workers outlive their tasks, beside the executor's heap, so each gives its free memory back after a task, and what
    ``kept`` holds when a task of other work comes.
    """
    work = uuid.uuid4().hex

    def each(batches):
        for batch in batches:
            yield from pieces(batch)
            del batch  # else it would stay while the next one is read

    def cut(batches):
        _begin(work)
        yield from run(each(batches))
        give_back()

    return df.mapInArrow(cut, schema)


class Scratch:
    """Durable tables of one job, which it removes once its result no longer reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        _write(df, path)
        self.paths.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        for path in self.paths:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)
        self.paths.clear()


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is (the join then shuffles)."""
    few = df.limit(rows + 1).count() <= rows if rows else False
    return F.broadcast(df) if few else df


def _spread(rows: DataFrame, key: str, hot: DataFrame, hot_key: str, table: DataFrame, table_key: str) -> DataFrame:
    """Left join of ``rows`` to ``hot`` by broadcast, and of its other rows to ``table`` by a shuffle.

    Rows with a hot or null key are dealt over the shuffle by their own number, under which the table has nothing.
    """
    out = rows.join(F.broadcast(hot), F.col(key) == F.col(hot_key), "left")
    own = F.when(F.col(hot_key).isNotNull() | F.col(key).isNull(), 1 + F.pmod(F.monotonically_increasing_id(), F.lit(9973))).otherwise(0)
    table = table.withColumn("_cold", F.lit(0).cast("long"))
    return out.withColumn("_deal", own.cast("long")).join(table, (F.col(key) == F.col(table_key)) & (F.col("_deal") == F.col("_cold")), "left")


def with_group(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of ``rows`` to ``groups`` (one row a key) that neither a hot nor a null key skews.

    Keys with over ``total / HOT_SHARE`` rows, fewer than HOT_SHARE by counting, are looked up by broadcast; the others
    go through a shuffle, in which no key has more rows than that. Rows whose key is hot or null are spread over it.
    """
    limit = max(1, total // HOT_SHARE)
    cols = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size) > limit).select(F.col(key).alias("_hk"), F.struct(*cols).alias("_hv"))
    cold = groups.where(F.col(size) <= limit).select(F.col(key).alias("_ck"), F.struct(*cols).alias("_cv"))
    got = F.coalesce(F.col("_hv"), F.col("_cv"))
    return _spread(rows, key, hot, "_hk", cold, "_ck").select(*rows.columns, *[got[c].alias(c) for c in cols])


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Inner join of ``rows`` to ``groups`` (one row a key, no null) that a hot key does not skew.

    The keys with over ``total / HOT_SHARE`` rows, fewer than HOT_SHARE by counting, are told by value and joined by
    broadcast; the rows of the others go through a shuffle.
    """
    own = groups.withColumnRenamed(key, "_gk")
    hot = [r[0] for r in own.where(F.col(size) > max(1, total // HOT_SHARE)).select("_gk").collect()]
    join = lambda left, right: left.join(right, F.col(key) == F.col("_gk")).drop("_gk")
    if not hot:
        return join(rows, own)
    cold = join(rows.where(~F.col(key).isin(hot)), own.where(~F.col("_gk").isin(hot)))
    return cold.unionByName(join(rows.where(F.col(key).isin(hot)), F.broadcast(own.where(F.col("_gk").isin(hot)))))


def lookup(rows: DataFrame, key: str, table: DataFrame, table_key: str, value: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the value of the table's row (one a key) with the same key, or the key itself without one.

    A table of bounded size is broadcast; else hot keys of ``rows`` are counted and only their values broadcast.
    """
    table = table.select(F.col(table_key).alias("_lk"), F.col(value).alias("_lv"))
    if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        got = rows.join(F.broadcast(table), F.col(key) == F.col("_lk"), "left").withColumn("_v", F.col("_lv"))
    else:
        limit = max(1, rows.count() // HOT_SHARE)
        many = rows.groupBy(F.col(key).alias("_hk")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit).select("_hk")
        hot = table.join(F.broadcast(many), F.col("_lk") == F.col("_hk")).select("_hk", F.col("_lv").alias("_hv"))
        got = _spread(rows, key, hot, "_hk", table, "_lk").withColumn("_v", F.coalesce("_hv", "_lv"))
    names = [c for c in rows.columns if c != out]
    return got.select(*names, F.coalesce("_v", key).alias(out))


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until it is none of ``columns`` in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(folds)
