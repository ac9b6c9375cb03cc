"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a linked list of tokens. Each adjacent pair with a merge rank puts its left position in the bucket of
that rank, and a three-level bitmap marks the ranks whose buckets are not empty, so the next rank is a find-first-set
on three 64-bit words. A bucket gives its positions from left to right; entries whose pair has changed meanwhile are
skipped. Work is about linear in the pre-token's length, so one of a million bytes is no trouble.

A null text counts as empty and gives no tokens. Special tokens are never made; their strings are ordinary text. Texts of
any length are encoded whole. Each row is coded by itself: repeated rows alike, null ids like others; an empty table gives
an empty result. There are no ties: of equal ranks the leftmost pair merges first. A column of the input that has the
name of a new one, in whatever case, is replaced; all others pass unread.
"""

from __future__ import annotations

import base64
import struct
from heapq import heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import kept, map_arrow

#: Distinct pre-tokens whose ids a Python worker remembers, about 200 bytes each; beyond it the memory starts anew.
REMEMBERED = 1_000_000
REMEMBERED_CHARS = 32
BLOCK_BYTES = 1 << 20


def load_ranks(path: str) -> bytes:
    """The vocabulary file's content: a base64 token and its rank a line."""
    with open(path, "rb") as f:
        return f.read()


class Memory(dict):
    """Pre-token to packed ids; fills itself."""

    def __init__(self, bpe: "ByteBPE", most: int):
        self.bpe, self.most = bpe, most

    def __missing__(self, word: str) -> bytes:
        ids = self.bpe.merge(word.encode("utf-8"))
        ids = struct.pack(f"<{len(ids)}I", *ids)
        if len(word) <= REMEMBERED_CHARS:
            if len(self) >= self.most:
                self.clear()
            self[word] = ids
        return ids


class ByteBPE:
    """Ranks are ids. ``pairs`` maps two ids, as ``left << 20 | right``, to the id of their join."""

    def __init__(self, vocabulary: bytes, pattern: str, remembered: int = REMEMBERED):
        lines = (line.split() for line in vocabulary.splitlines() if line.strip())
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in lines}
        self.tokens: dict[int, bytes] = {rank: token for token, rank in self.ranks.items()}
        self.single = [self.ranks[bytes([b])] for b in range(256)]
        self.pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 20 | right] = rank
        n = max(self.tokens) + 1
        self.buckets: list[list[int] | None] = [None] * n
        self.low, self.mid = [0] * ((n >> 6) + 1), [0] * ((n >> 12) + 1)
        self.pattern = regex.compile(pattern)
        self.memory = Memory(self, remembered)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token.

        The queue is empty before and after: ``buckets`` by rank, and the bitmap ``top`` of words of ``mid``, which is
        one of words of ``low``, which has a bit for each rank whose bucket is not empty.
        """
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        single, get, buckets, low, mid, top = self.single, self.pairs.get, self.buckets, self.low, self.mid, 0
        ids = [single[b] for b in piece]
        n = len(ids)
        pair = [get(a << 20 | b, -1) for a, b in zip(ids, ids[1:])]
        pair.append(-1)
        for i, r in enumerate(pair):
            if r >= 0:
                bucket = buckets[r]
                if bucket is None:
                    buckets[r] = [i]
                    w, m = r >> 6, r >> 12
                    low[w] |= 1 << (r & 63)
                    mid[m] |= 1 << (w & 63)
                    top |= 1 << m
                else:
                    bucket.append(i)
        if not top:
            return ids
        right, left = list(range(1, n + 1)), list(range(-1, n - 1))
        while top:
            m = (top & -top).bit_length() - 1
            x = mid[m]
            w = (m << 6) + (x & -x).bit_length() - 1
            y = low[w]
            rank = (w << 6) + (y & -y).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                at = heappop(bucket)
            else:
                at = bucket[0]
                buckets[rank] = None
                low[w] = y = y & (y - 1)
                if not y:
                    mid[m] = x = x & (x - 1)
                    if not x:
                        top &= top - 1
            if pair[at] != rank:
                continue
            gone = right[at]
            ids[at] = rank
            pair[gone] = ids[gone] = -1
            after = right[at] = right[gone]
            pair[at] = -1
            if after < n:
                left[after] = at
                r = get(rank << 20 | ids[after])
                if r is not None:
                    pair[at] = r
                    bucket = buckets[r]
                    if bucket is None:
                        buckets[r] = [at]
                        w, m = r >> 6, r >> 12
                        low[w] |= 1 << (r & 63)
                        mid[m] |= 1 << (w & 63)
                        top |= 1 << m
                    else:
                        heappush(bucket, at)
            before = left[at]
            if before >= 0:
                r = get(ids[before] << 20 | rank, -1)
                pair[before] = r
                if r >= 0:
                    bucket = buckets[r]
                    if bucket is None:
                        buckets[r] = [before]
                        w, m = r >> 6, r >> 12
                        low[w] |= 1 << (r & 63)
                        mid[m] |= 1 << (w & 63)
                        top |= 1 << m
                    else:
                        heappush(bucket, before)
        return [i for i in ids if i >= 0]

    def encode(self, text: str) -> bytes:
        """The text's ids as little-endian unsigned 32-bit integers."""
        look = self.memory.__getitem__
        if len(text) <= BLOCK_BYTES:
            return b"".join(map(look, self.pattern.findall(text)))
        found, out = (m.group() for m in self.pattern.finditer(text)), []
        while block := list(islice(found, 1 << 16)):
            out.append(b"".join(map(look, block)))
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        look = self.tokens.__getitem__
        step = 1 << 20
        return b"".join(b"".join(map(look, np.frombuffer(ids[i : i + step], "<u4").tolist())) for i in range(0, len(ids), step))


def _codec(vocabulary: bytes, pattern: str, remembered: int = REMEMBERED) -> ByteBPE:
    """One for each Python worker and ``map_arrow``."""
    return kept(("codec", hash(vocabulary), pattern, remembered), lambda: ByteBPE(vocabulary, pattern, remembered))


def _blocks(batch: pa.RecordBatch, column: str):
    """(first row, rows) of runs of at least a row and about BLOCK_BYTES."""
    at, size = 0, 0
    for i, x in enumerate(batch.column(column)):
        size += len(x.as_buffer()) if x.is_valid else 0
        if size >= BLOCK_BYTES:
            yield at, i + 1 - at
            at, size = i + 1, 0
    if at < batch.num_rows:
        yield at, batch.num_rows - at


def _packed(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def _unpacked(values: list[bytes]) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in values], dtype=np.int64)))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(values), "<i4")))


def _schema(docs: DataFrame, without: str | None, **more: str) -> str:
    rest = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != without]
    return ", ".join([*rest, *(f"`{name}` {kind}" for name, kind in more.items())])


def encode_texts(docs: DataFrame, vocabulary: bytes, pattern: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None, packed: bool = True, remembered: int = REMEMBERED) -> DataFrame:
    """``docs`` with the text replaced by its ids: packed as little-endian unsigned 32-bit integers, or an array.

    With ``decoded_col`` the ids are decoded again in the same pass, and the bytes returned beside them.
    The vocabulary (about a megabyte) is broadcast, so executors need no file. Other columns pass as they are; one
    that has a new name is replaced. ``remembered`` trades a worker's memory for time.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    more = {ids_col: "binary" if packed else "array<int>"} | ({decoded_col: "binary"} if decoded_col else {})
    docs = docs.drop(*(c for c in more if c.lower() != text_col.lower()))

    def run(batches):
        bpe = _codec(shared.value, pattern, remembered)
        for whole in batches:
            for at, n in _blocks(whole, text_col):
                batch = whole.slice(at, n)
                ids = [bpe.encode(x) if x else b"" for x in batch.column(text_col).to_pylist()]
                columns = [batch.column(c) for c in batch.schema.names if c != text_col] + [_packed(ids) if packed else _unpacked(ids)]
                if decoded_col:
                    columns.append(_packed([bpe.decode(x) for x in ids]))
                yield pa.RecordBatch.from_arrays(columns, [*(c for c in batch.schema.names if c != text_col), *more])

    return map_arrow(docs, run, _schema(docs, text_col, **more))


def decode_ids(docs: DataFrame, vocabulary: bytes, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``docs`` with the bytes that the packed ids stand for (none for a null), beside them or, under their name, in their place."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    gone = ids_col if out_col.lower() == ids_col.lower() else None
    docs = docs if gone else docs.drop(out_col)

    def run(batches):
        bpe = _codec(shared.value, pattern)
        for whole in batches:
            for at, n in _blocks(whole, ids_col):
                batch = whole.slice(at, n)
                decoded = _packed([bpe.decode(x or b"") for x in batch.column(ids_col).to_pylist()])
                names = [c for c in batch.schema.names if c != gone]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), decoded], [*names, out_col])

    return map_arrow(docs, run, _schema(docs, gone, **{out_col: "binary"}))
