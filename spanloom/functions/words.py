"""Counts of the words of strings by key, in Arrow batches: no row a word, no hash table that grows with the keys.

Each piece of a batch is counted at once, its rows with one key together. One row a key and piece goes through the shuffle,
is sorted by key, and the rows of a key are added up as they stream by, so a task holds one key's words at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A worker handles at most this many rows and bytes of a batch at a time (a longer row by itself).
ROWS, BYTES = 500, 1 << 20
#: Partial counts of one key are added up once there are this many.
PARTS = 64
#: Rows of an output batch.
OUT = 10_000

Words = tuple[np.ndarray, np.ndarray]  # a row of letters a word, and its count


def pieces(batch: pa.RecordBatch, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most ``rows`` rows, and ``size`` bytes where they have several rows."""
    if batch.num_rows > rows:
        for at in range(0, batch.num_rows, rows):
            yield from pieces(batch.slice(at, rows), rows, size)
    elif batch.num_rows > 1 and batch.nbytes > size:
        half = batch.num_rows // 2
        yield from pieces(batch.slice(0, half), rows, size)
        yield from pieces(batch.slice(half), rows, size)
    else:
        yield batch


def letters_of(s: str) -> np.ndarray:
    """The letters as numbers: bytes of an ASCII string, else code points."""
    return np.frombuffer(s.encode(), np.uint8) if s.isascii() else np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def text_of(x: np.ndarray) -> str:
    return x.tobytes().decode("ascii") if x.dtype == np.uint8 else x.tobytes().decode("utf-32-le", "surrogatepass")


def ranks(*tables: np.ndarray) -> list[np.ndarray]:
    """A number for each row of the tables, equal for equal rows and in their order."""
    both = np.concatenate(tables)
    if both.dtype == np.uint8 and both.shape[1] <= 7:
        rank = both.astype(np.int64) @ (256 ** np.arange(both.shape[1] - 1, -1, -1, dtype=np.int64))
    else:
        rank = np.unique(both, axis=0, return_inverse=True)[1].ravel()
    return np.split(rank, np.cumsum([len(t) for t in tables])[:-1])


def count_words(texts: list[str], groups: np.ndarray, offsets: tuple[int, ...], without: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, word, count), in order, of the letters ``offsets`` on from every place, less those with a letter of ``without``."""
    width, span = len(offsets), max(offsets) + 1
    x = letters_of("".join(texts))
    sizes = np.array([len(s) for s in texts], np.int64)
    alphabet = np.flatnonzero(np.bincount(x, minlength=256)) if x.dtype == np.uint8 else np.unique(x)
    base, rows = max(1, len(alphabet)), int(groups.max()) + 1 if len(groups) else 0
    n = max(0, len(x) - span + 1)
    whole = np.ones(len(x), bool)  # places whose word ends in their own text
    ends = np.cumsum(sizes)
    for back in range(1, span):
        at = ends - back
        whole[at[at >= ends - sizes]] = False
    good = whole[:n]
    group = np.repeat(groups, sizes)[:n]
    if without:
        bad = np.isin(x, [ord(c) for c in without])
        if bad.any():
            for o in offsets:
                good = good & ~bad[o : o + n]
    own = np.searchsorted(alphabet, x)
    if base**width * max(1, rows) >= 1 << 62:  # too many words to number
        table = np.stack([group, *[own[o : o + n] for o in offsets]], axis=1)[good]
        found, count = np.unique(table, axis=0, return_counts=True)
        return found[:, 0], alphabet[found[:, 1:]].astype(x.dtype), count
    code = group.astype(np.int64)
    for o in offsets:
        code = code * base + own[o : o + n]
    code = code[good] if not good.all() else code
    if base**width * rows <= 4 * len(x) + 4096:
        count = np.bincount(code, minlength=0)
        found = np.flatnonzero(count)
        count = count[found]
    else:
        found, count = np.unique(code, return_counts=True)
    digits = np.empty((len(found), width), np.int64)
    rest = found
    for j in range(width - 1, -1, -1):
        rest, digits[:, j] = np.divmod(rest, base)
    return rest, alphabet[digits].astype(x.dtype), count


def _partial(offsets: tuple[int, ...], without: str, parts: int):
    """(key, _part, _words, _n) of each piece of (key, text, ...): the words joined, the counts as 32-bit numbers."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                key = piece.column(0)
                coded = key.dictionary_encode(null_encoding="encode")
                codes = coded.indices.to_numpy(zero_copy_only=False)
                for part in range(parts):
                    texts = piece.column(1 + part).to_pylist()
                    use = [i for i, s in enumerate(texts) if s]
                    group, words, count = count_words([texts[i] for i in use], codes[use], offsets, without)
                    if not len(group):
                        continue
                    cut = np.flatnonzero(np.diff(group)) + 1
                    starts, stops = np.concatenate([[0], cut]), np.concatenate([cut, [len(group)]])
                    small = count.astype("<u4")
                    out = [(text_of(words[a:b]), small[a:b].tobytes()) for a, b in zip(starts.tolist(), stops.tolist())]
                    keys = coded.dictionary.take(pa.array(group[starts]))
                    yield pa.RecordBatch.from_arrays(
                        [keys, pa.array([part] * len(out), pa.int32()), pa.array([w for w, _ in out], pa.string()), pa.array([c for _, c in out], pa.binary())],
                        names=["key", "part", "words", "n"],
                    )

    return run


def _added(found: list[Words], width: int) -> Words:
    """Partial counts as one; words in order."""
    if len(found) == 1:
        return found[0]
    if not found:
        return np.zeros((0, width), np.uint8), np.zeros(0, np.int64)
    wide = np.uint8 if all(w.dtype == np.uint8 for w, _ in found) else np.uint32
    words, at = np.unique(np.concatenate([w.astype(wide) for w, _ in found]), axis=0, return_inverse=True)
    n = np.zeros(len(words), np.int64)
    np.add.at(n, at.ravel(), np.concatenate([c for _, c in found]))
    return words, n


def _by_key(batches, width: int, parts: int):
    """(key, type of the keys, words of each part) of rows sorted by key."""
    key, kind, held = None, None, None
    for batch in batches:
        kind = batch.column(0).type
        for k, part, words, n in zip(*(c.to_pylist() for c in batch.columns)):
            if held is None or not (k == key or (k is not None and k != k and key != key)):
                if held is not None:
                    yield key, kind, [_added(h, width) for h in held]
                key, held = k, [[] for _ in range(parts)]
            held[part].append((letters_of(words).reshape(-1, width), np.frombuffer(n, "<u4").astype(np.int64)))
            if len(held[part]) >= PARTS:
                held[part] = [_added(held[part], width)]
    if held is not None:
        yield key, kind, [_added(h, width) for h in held]


def _shuffled(df: DataFrame, key: str, seqs: list[str], offsets: tuple[int, ...], without: str) -> DataFrame:
    shape = T.StructType([T.StructField("key", df.schema[key].dataType), T.StructField("part", T.IntegerType()), T.StructField("words", T.StringType()), T.StructField("n", T.BinaryType())])
    rows = df.select(F.col(key).alias("key"), *[F.col(s).alias(f"_{i}") for i, s in enumerate(seqs)])
    return rows.mapInArrow(_partial(offsets, without, len(seqs)), shape).repartition("key").sortWithinPartitions("key")


def figures(df: DataFrame, key: str, seqs: list[str], offsets: tuple[int, ...], figure: Callable[..., tuple | None], out: list[T.StructField], without: str = "") -> DataFrame:
    """``figure`` of the words of each key, one (words, counts) a column of ``seqs``; keys without words, or for which it is None, have no row."""
    shape = T.StructType([T.StructField(key, df.schema[key].dataType), *out])
    types = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.float64() for f in out]
    width, parts = len(offsets), len(seqs)

    def run(batches):
        keys, rows, kind = [], [], None

        def table():
            return pa.RecordBatch.from_arrays([pa.array(keys, kind), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]], names=shape.names)

        for k, kind, words in _by_key(batches, width, parts):
            found = figure(*words)
            if found is not None:
                keys.append(k)
                rows.append(found)
            if len(keys) >= OUT:
                yield table()
                keys.clear()
                rows.clear()
        if keys:
            yield table()

    return _shuffled(df, key, seqs, offsets, without).mapInArrow(run, shape)


def counts(df: DataFrame, key: str, seq: str, offsets: tuple[int, ...], without: str = "") -> DataFrame:
    """(key, kmer, n) of the words of each key."""
    shape = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("kmer", T.StringType()), T.StructField("n", T.LongType())])
    width = len(offsets)

    def run(batches):
        for k, kind, ((words, n),) in _by_key(batches, width, 1):
            for at in range(0, len(words), OUT):
                part = words[at : at + OUT]
                text = text_of(part)
                names = [text[i : i + width] for i in range(0, len(text), width)]
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(part), kind), pa.array(names, pa.string()), pa.array(n[at : at + OUT])], names=shape.names)

    return _shuffled(df, key, [seq], offsets, without).mapInArrow(run, shape)
