"""Benchmark decontamination by spaced-seed hashing.

Words are runs of letters and digits, A-Z lower-cased. A seed is a fixed mask over a run of words: only the positions
marked are hashed, so a hit survives substitutions at the others. Test hashes of all masks are looked up for every
position of every text. Each hit names an item and an alignment; along it the words are compared one by one, and the
longest stretch in which at least ``percent`` of the words agree is an overlap if it has ``least`` words (or all of an
item that is shorter). Together the masks hit every stretch of 13 to 25 words of which 80 % are equal, and of 10 with
one substitution (checked in the tests); a longer stretch of 80 % has a half of 13 words or more of 80 %.

Test items of up to ``BLOCK_BYTES`` are broadcast as one index, and one scan of the texts finds and checks all. More
items are joined: a bitmap of bounded size over their hashes goes to that same scan, which keeps the word hashes of the
texts that have a hit; the hits join the items' hashes in a shuffle, and only pairs of a text and an item that share
one are compared. Both ways give the same rows.

Null and empty texts and items overlap with nothing; an empty table of either gives an empty result. Texts are read whole
at any length. Repeated rows are reported once or more, a null id as null; ``decontaminate`` tells rows by id and text,
so a clean row stays beside a leaking one of the same id, and a leaking row without an id goes. Other columns pass unread,
whatever their names. Items with fewer words than ``LEAST`` are matched only as exact whole runs of words; those with
fewer than ``SHORTEST``, which no mask fits, by a hash of the whole item. So an item of one word matches every text that
holds the word. An item without a word matches nothing. Repeated items are reported for each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernels as K
from .common import bounded, durable, fresh, map_arrow

#: Positions read by each seed.
MASKS = ("11101011", "110110011", "1100101101", "1110001011", "101001111")
LEAST = 13
PERCENT = 80
SHORTEST = 8
#: Bytes of test texts that are broadcast at most; more are joined.
BLOCK_BYTES = 8 << 20
#: Bits of the bitmap of the items' hashes, at most; beyond some 2 ** 25 hashes more texts are looked at than need be.
MOST_BITS = 1 << 28
#: Hits that a worker spreads out at a time.
SPREAD = 1 << 20


def _seed_hashes(h: np.ndarray, mask: str, salt: int) -> np.ndarray:
    offs = [i for i, c in enumerate(mask) if c == "1"]
    n = len(h) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    s = np.full(n, np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % 2**64), np.uint64)
    for j, o in enumerate(offs):
        s += h[o : o + n] * K._MULT[j]
    return K.mix(s)


def whole_masks(masks) -> list[tuple[int, str]]:
    """(salt, mask): the masks, and for each size of items that none fits one over the whole item."""
    return [*enumerate(masks), *((len(masks) + n, "1" * n) for n in range(1, SHORTEST))]


def _item_seeds(words: np.ndarray, masks) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes, places) of an item's words, for each mask that applies."""
    use = [(s, m) for s, m in whole_masks(masks) if (len(words) == len(m) if s >= len(masks) else len(words) >= SHORTEST)]
    found = [_seed_hashes(words, m, s) for s, m in use]
    return [(h, np.arange(len(h))) for h in found]


class Index:
    """Seed hashes of the items that are broadcast."""

    def __init__(self, ids: list[int], texts: list[str], masks=MASKS):
        self.ids, self.words, rows = ids, [], []
        for _, n, data, offsets in K.chunks(pa.array(texts, pa.string())):
            h, _, per = K.words(data, offsets, K.ALNUM)
            self.words += [h[per[i] : per[i + 1]] for i in range(n)]
        sizes = {len(w) for w in self.words}
        self.masks = [(s, m) for s, m in whole_masks(masks) if s < len(masks) or len(m) in sizes]
        for i, w in enumerate(self.words):
            rows += [np.stack([s, np.full(len(s), i, np.uint64), at.astype(np.uint64)]) for s, at in _item_seeds(w, masks)]
        table = np.concatenate(rows, axis=1) if rows else np.zeros((3, 0), np.uint64)
        table = table[:, np.argsort(table[0], kind="stable")]
        self.keys, self.item, self.at = table[0], table[1].astype(np.int64), table[2].astype(np.int64)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys >> np.uint64(44)] = True

    def hits(self, h: np.ndarray) -> np.ndarray:
        """(item, alignment) pairs of one text's words or of many texts' words in a row."""
        out = [np.zeros((0, 2), np.int64)]
        for salt, mask in self.masks:
            s = _seed_hashes(h, mask, salt)
            at = np.flatnonzero(self.maybe[s >> np.uint64(44)])
            lo = np.searchsorted(self.keys, s[at], "left")
            hi = np.searchsorted(self.keys, s[at], "right")
            real = hi > lo
            at, lo, n = at[real], lo[real], (hi - lo)[real]
            total = np.concatenate(([0], np.cumsum(n)))
            a = 0
            while a < len(at):
                b = max(a + 1, int(np.searchsorted(total, total[a] + SPREAD, "right")) - 1)
                k = np.repeat(lo[a:b] - (total[a:b] - total[a]), n[a:b]) + np.arange(total[b] - total[a])
                out.append(np.unique(np.stack([self.item[k], np.repeat(at[a:b], n[a:b]) - self.at[k]], axis=1), axis=0))
                a = b
        return np.unique(np.concatenate(out), axis=0)


def stretch(same: np.ndarray, percent: int) -> tuple[int, int]:
    """The longest run [from, to) of ``same`` of which at least ``percent`` is true; the first of several."""
    score = np.concatenate(([0], np.cumsum(np.where(same, 100 - percent, -percent))))
    low = np.minimum.accumulate(score)
    frm = np.searchsorted(-low, -score, "left")
    size = np.arange(len(score)) - frm
    to = int(size.argmax())
    return (int(frm[to]), to) if size[to] > 0 else (0, 0)


def _overlap(text: np.ndarray, item: np.ndarray, shift: int, least: int, percent: int) -> tuple[int, int, int, int] | None:
    """(from, to, from in the item, equal words) of the overlap along one alignment, or None."""
    lo, hi = max(0, shift), min(len(text), shift + len(item))
    if hi <= lo:
        return None
    same = text[lo:hi] == item[lo - shift : hi - shift]
    frm, to = stretch(same, percent)
    equal = int(same[frm:to].sum())
    if to - frm < min(least, len(item)) or (len(item) < least and equal < len(item)):
        return None
    return lo + frm, lo + to, lo - shift + frm, equal


FOUND = "doc_id long, text_sha256 string, item_id long, doc_from long, doc_to long, item_from long, same_words long"
_FOUND_T = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string()), *((c, pa.int64()) for c in ("item_id", "doc_from", "doc_to", "item_from", "same_words"))])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _find(index, least: int, percent: int):
    def run(batches):
        ix = index.value
        for batch in batches:
            rows = []
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            for first, n, data, offsets in K.chunks(texts):
                h, _, per = K.words(data, offsets, K.ALNUM)
                for item, shift in ix.hits(h).tolist():
                    w = ix.words[item]
                    for doc in range(int(np.searchsorted(per, max(shift, 0), "right")) - 1, n):  # an alignment may reach over several short texts
                        if per[doc] >= shift + len(w):
                            break
                        if got := _overlap(h[per[doc] : per[doc + 1]], w, shift - int(per[doc]), least, percent):
                            rows.append((first + doc, ix.ids[item], *map(int, got)))
            sha = {r[0]: hashlib.sha256((texts[r[0]].as_py() or "").encode()).hexdigest() for r in rows}
            yield _rows(sorted({(ids[r[0]], sha[r[0]], *r[1:]) for r in rows}, key=str), _FOUND_T)

    return run


_SEED_T = pa.schema([("seed", pa.int64()), ("item", pa.int64()), ("at", pa.int64())])


def _seed_rows(masks):
    def run(batches):
        for batch in batches:
            keys = batch.column("item").to_pylist()
            out = [(np.zeros(0, np.uint64), 0, np.zeros(0, np.int64))]
            for first, n, data, offsets in K.chunks(batch.column("text")):
                h, _, per = K.words(data, offsets, K.ALNUM)
                out += [(s, keys[first + i], at) for i in range(n) for s, at in _item_seeds(h[per[i] : per[i + 1]], masks)]
            seeds = np.concatenate([s for s, _, _ in out]).view(np.int64)
            item = np.concatenate([np.full(len(s), k, np.int64) for s, k, _ in out])
            yield pa.RecordBatch.from_arrays([pa.array(seeds), pa.array(item), pa.array(np.concatenate([a for _, _, a in out]))], schema=_SEED_T)

    return run


SUSPECTS = "doc_id long, text_sha256 string, words array<long>, hits array<struct<seed:long,at:long>>"
_HIT = pa.struct([("seed", pa.int64()), ("at", pa.int64())])


def _suspect_rows(bitmap, bits: int, masks):
    """The word hashes and hits of the texts that have a hit in the bitmap."""

    def run(batches):
        maybe = bitmap.value
        for batch in batches:
            ids, texts, rows = batch.column("doc_id").to_pylist(), batch.column("text"), []
            for first, n, data, offsets in K.chunks(texts):
                h, _, per = K.words(data, offsets, K.ALNUM)
                hits = []
                for salt, mask in whole_masks(masks):
                    s = _seed_hashes(h, mask, salt)
                    place = s & np.uint64(bits - 1)
                    at = np.flatnonzero(maybe[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1))
                    hits.append(np.stack([s[at].view(np.int64), at], axis=1))
                hits = np.concatenate(hits)
                hits = hits[np.argsort(hits[:, 1], kind="stable")]
                cut = np.searchsorted(hits[:, 1], per)
                for i in np.flatnonzero(np.diff(cut)):
                    own = hits[cut[i] : cut[i + 1]]
                    sha = hashlib.sha256((texts[int(first + i)].as_py() or "").encode()).hexdigest()
                    seeds = [{"seed": int(s), "at": int(a - per[i])} for s, a in own]
                    rows.append((ids[first + i], sha, h[per[i] : per[i + 1]].view(np.int64), seeds))
            types = (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(_HIT))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["doc_id", "text_sha256", "words", "hits"])

    return run


def _item_words(batches):
    for batch in batches:
        out = []
        for _, n, data, offsets in K.chunks(batch.column("text")):
            h, _, per = K.words(data, offsets, K.ALNUM)
            out += [h[per[i] : per[i + 1]].view(np.int64) for i in range(n)]
        yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("item_id"), pa.array(out, pa.list_(pa.int64()))], ["item", "item_id", "item_words"])


def _verify(least: int, percent: int):
    def run(batches):
        for batch in batches:
            rows = set()
            for r in batch.to_pylist():
                text, item = np.array(r["words"], np.int64), np.array(r["item_words"], np.int64)
                for shift in r["shifts"]:
                    if got := _overlap(text, item, shift, least, percent):
                        rows.add((r["doc_id"], r["text_sha256"], r["item_id"], *map(int, got)))
            yield _rows(sorted(rows, key=str), _FOUND_T)

    return run


def _joined(src: DataFrame, items: DataFrame, least: int, percent: int, masks) -> DataFrame:
    """The overlaps by a join of test and training hashes, for any number of items."""
    spark = src.sparkSession
    items = durable(items.withColumn("item", F.monotonically_increasing_id()), "items")
    seeds = durable(map_arrow(items.select("item", "text"), _seed_rows(masks), "seed long, item long, at long"), "seeds")
    bits = min(MOST_BITS, max(1 << 20, 1 << (8 * seeds.count()).bit_length()))
    place = F.col("seed").bitwiseAND(F.lit(bits - 1))
    words = seeds.groupBy((place / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))).alias("b"))
    maybe = np.zeros(bits // 64, np.uint64)
    set_ = words.toArrow()  # at most MOST_BITS / 64 rows
    maybe[set_["w"].to_numpy()] = set_["b"].to_numpy().view(np.uint64)
    suspects = map_arrow(src, _suspect_rows(spark.sparkContext.broadcast(maybe), bits, masks), SUSPECTS)
    suspects = durable(suspects.withColumn("row", F.monotonically_increasing_id()), "suspects")
    hits = suspects.select("row", F.explode("hits").alias("h")).select("row", F.col("h.seed").alias("_seed"), F.col("h.at").alias("_at"))
    pairs = hits.join(seeds, F.col("_seed") == F.col("seed")).select("row", "item", (F.col("_at") - F.col("at")).alias("shift")).distinct()
    pairs = pairs.groupBy(F.col("row").alias("_row"), F.col("item").alias("_item")).agg(F.collect_list("shift").alias("shifts"))
    own = map_arrow(items.select("item", "item_id", "text"), _item_words, "item long, item_id long, item_words array<long>")
    pairs = pairs.join(own, F.col("_item") == F.col("item")).join(suspects.drop("hits"), F.col("_row") == F.col("row"))
    pairs = pairs.select("doc_id", "text_sha256", "words", "item_id", "item_words", "shifts")
    return map_arrow(pairs, _verify(least, percent), FOUND).distinct()


def _found(docs: DataFrame, items: DataFrame, least: int = LEAST, percent: int = PERCENT, masks=MASKS) -> DataFrame:
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null")
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text") + 16), F.lit(0))).first()[0]
    if size > BLOCK_BYTES:
        return _joined(src, items, least, percent, masks)
    part = items.orderBy("item_id", "text").collect()  # at most BLOCK_BYTES
    index = docs.sparkSession.sparkContext.broadcast(Index([r[0] for r in part], [r[1] for r in part], masks))
    return map_arrow(src, _find(index, least, percent), FOUND)


def overlaps(docs: DataFrame, items: DataFrame, least: int = LEAST, percent: int = PERCENT, masks=MASKS) -> DataFrame:
    """One row an overlap of a text of ``docs`` (doc_id, text) with a test item (item_id, text): word positions in both."""
    return _found(docs, items, least, percent, masks).drop("text_sha256")


def contaminated(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """One row a document that overlaps with a test item: doc_id, item_ids, overlaps (item, places), longest in words."""
    found = overlaps(docs, items, **how)
    spans = F.struct("item_id", "doc_from", "doc_to", "item_from", "same_words")
    return found.groupBy("doc_id").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"),
        F.array_sort(F.collect_set(spans)).alias("overlaps"),
        F.max(F.col("doc_to") - F.col("doc_from")).alias("longest"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """``docs`` without the rows that overlap with a test item, told by id and text."""
    own_id, own_sha = fresh(docs.columns, "_id"), fresh(docs.columns, "_sha")
    gone = _found(docs, items, **how).select(F.col("doc_id").alias(own_id), F.col("text_sha256").alias(own_sha)).distinct()
    gone = durable(gone, "leaks")
    # The hash is compared after the ids, so it is taken of texts with such an id only.
    sha = F.concat(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256), F.lit(""))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(own_id)) & F.when(sha == F.col(own_sha), True).otherwise(False)
    return docs.join(bounded(gone), same, "left_anti")
