"""Near-duplicate documents by one-permutation MinHash.

1. One pass hashes each text's word shingles. Texts with the same set form a class; its smallest id stands for it.
2. One-permutation hashing: the top bits of a shingle's hash name its bin, the least hash of a bin is its value. An
   empty bin takes the value of the first filled bin in its own fixed random order (optimal densification).
3. Bands of bins make bucket keys. The least id of a bucket is the centre of a star: it meets every other member, so a
   bucket of n meets n - 1 times.
4. Where a centre meets a member, an exact bound comes first: a parity sketch holds one bit a hash bucket, and two sets
   differ in at least as many shingles as their sketches in bits. The pairs that the bound lets through are edges, and
   are confirmed on the full sets; connected components contract.
5. A star misses links between two members that are both unlike the centre. Documents of buckets that still hold
   several components are therefore dealt anew by an exact prefix filter over their rarest shingles. Stars go on in
   those lists: first with a few centres of other components than the list's largest, at last with all of them. So each
   pair that shares a bucket has met, was ruled out by an exact bound, or is connected; nothing is capped. The members
   of a long list, and its centres, are dealt over blocks of bounded size.

Rows with a null id are in no class of others. Null, empty and blank texts have an empty set and link to nothing; an
empty table gives an empty result. Texts of any length are hashed whole. Rows that repeat an id count as one document
with the class of least (n_shingles, hashes) among them, so two unlike texts under one id connect nothing. Repeated
rows, and ties, which the least id settles, are all reported. Other columns pass unread, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernels as K
from .common import Scratch, bounded, durable, join_groups, lookup, map_arrow, with_group

BANDS = 32
ROWS = 4
#: Centres that a list has in its next rounds, about; in those after them all members outside its largest component.
CENTRES = (16, 256)
#: Members and centres of a list that meet in one block.
MEMBERS_A_BLOCK = 1024
CENTRES_A_BLOCK = 1024
#: Pairs that a worker holds at a time.
PAIRS = 1 << 16
SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>"
MET = "a long, b long, ca long, cb long"


_SET_A = np.uint64(0x5851F42D4C957F2D)


def _orders(bins: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(77))
    return np.array([rng.permutation(bins) for _ in range(bins)])


def sketch(u: np.ndarray, bins: int, orders: np.ndarray) -> np.ndarray:
    """The densified one-permutation sketch of a sorted set of uniform 64-bit hashes."""
    shift = np.uint64(64 - (bins.bit_length() - 1))
    edges = np.arange(bins, dtype=np.uint64) << shift
    at = np.searchsorted(u, edges)
    value = u[np.minimum(at, len(u) - 1)]
    full = (at < len(u)) & (value >> shift == np.arange(bins, dtype=np.uint64))
    if not full.all():
        donor = orders[np.arange(bins), full[orders].argmax(axis=1)]
        value = np.where(full, value, value[donor])
    return value


def _sign(id_col: str, text_col: str, k: int, bands: int, rows: int):
    def run(batches):
        bins = bands * rows
        orders, mult = _orders(bins), K._MULT[:rows]
        salt = K.mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for batch in batches:
            n, a, b, keys, lens = [], [], [], [], []
            for u in K.shingle_sets(batch.column(text_col), k):
                n.append(len(u))
                a.append(K.mix(u ^ _SET_A).sum(dtype=np.uint64))
                b.append(K.mix(u ^ np.uint64(0x14057B7EF767814F)).sum(dtype=np.uint64))
                if len(u):
                    s = K.mix(sketch(u, bins, orders)).reshape(bands, rows)
                    keys.append(K.mix((s * mult).sum(axis=1, dtype=np.uint64) + salt))
                lens.append(bands if len(u) else 0)
            values = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_col).cast(pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array(np.array(a, np.uint64).view(np.int64)),
                    pa.array(np.array(b, np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lens))), pa.int32()), pa.array(values.view(np.int64))),
                ],
                ["doc_id", "n_shingles", "set_a", "set_b", "bands"],
            )

    return run


def parity_sketch(u: np.ndarray) -> bytes:
    """One bit for each of 256 or more hash buckets (a power of two, at least twice the set): whether an odd number of the set falls in."""
    bits = max(256, 1 << int(2 * len(u) - 1).bit_length()) if len(u) else 256
    odd = np.bincount((K.mix(u ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def _sets(k: int):
    def run(batches):
        for batch in batches:
            sets = list(K.shingle_sets(batch.column("text"), k))
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            lens = np.array([len(s) for s in sets], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.array([K.mix(u ^ _SET_A).sum(dtype=np.uint64) for u in sets], np.uint64).view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(lens))), pa.int32()), pa.array(flat.view(np.int64))),
                    pa.array([parity_sketch(u) for u in sets], pa.binary()),
                ],
                ["id", "set_a", "set", "sketch"],
            )

    return run


def components(edges: DataFrame, keep=durable) -> DataFrame:
    """(node, component): the least node reachable, for each node of the undirected edges (a, b).

    Every round points each node at its least neighbour, follows the pointers twice and contracts the edges.
    ``keep`` writes a table.
    """
    maps = None
    edges = keep(edges.where("a <> b").select("a", "b").distinct(), "components")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a")).toDF("node", "other")
        up = keep(both.groupBy("node").agg(F.least("node", F.min("other")).alias("parent")), "components")
        # Only parents that point on themselves move their children; roots point at themselves.
        up = keep(lookup(up, "parent", up.where("parent <> node").withColumnRenamed("parent", "grand"), "node", "grand", "parent"), "components")
        maps = up if maps is None else keep(lookup(maps, "parent", up, "node", "parent", "parent"), "components")
        edges = lookup(lookup(edges, "a", up, "node", "parent", "a"), "b", up, "node", "parent", "b")
        edges = keep(edges.where("a <> b").distinct(), "components")
    if maps is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return maps.toDF("node", "component")


def _words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The 64-bit words of binary values, where each value begins among them, and how many it has."""
    _, offs, data = column.buffers()
    at = np.frombuffer(offs, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]].view(np.uint64), (at[:-1] - at[0]) // 8, np.diff(at) // 8


def _apart(words: np.ndarray, at: np.ndarray, size: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which the sketches of rows ``x`` and ``y`` differ, the longer one folded to the shorter's size."""
    out = np.zeros(len(x), np.int64)
    kind = size[x] << 32 | size[y]
    for k in np.unique(kind).tolist():
        sx, sy = k >> 32, k & 0xFFFFFFFF
        own, w, step = np.flatnonzero(kind == k), min(sx, sy), max(1, (1 << 20) // max(sx, sy))
        for lo in range(0, len(own), step):
            part = own[lo : lo + step]
            both = []
            for rows, s in ((x[part], sx), (y[part], sy)):
                v = words[at[rows][:, None] + np.arange(s)]
                both.append(np.bitwise_xor.reduce(v.reshape(len(part), s // w, w), axis=1) if s > w else v)
            out[part] = np.bitwise_count(both[0] ^ both[1]).sum(axis=1, dtype=np.int64)
    return out


def _meet(percent: int):
    """Rows (list, block, centre, id, comp, n, pos, sketch), sorted so that a block's centres come first, to the pairs that may be alike.

    Two sets of ``percent`` or more share at least ``percent / (100 + percent)`` of their summed sizes. A shingle at
    place ``pos`` that is the first one shared leaves ``n - pos``; pairs that share an earlier one meet in its list.
    """

    def run(batches):
        kept = None
        for batch in batches:
            if not batch.num_rows:
                continue
            old = kept.num_rows if kept is not None else 0
            if old:
                batch = pa.Table.from_batches([kept, batch]).combine_chunks().to_batches()[0]
            col = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("list", "block", "centre", "id", "comp", "n", "pos")}
            rows, centre = batch.num_rows, col["centre"].astype(bool)
            new = np.ones(rows, bool)
            new[1:] = (col["list"][1:] != col["list"][:-1]) | (col["block"][1:] != col["block"][:-1])
            begin = np.flatnonzero(new)[np.cumsum(new) - 1]
            heads = np.concatenate(([0], np.cumsum(centre)))
            ends = np.append(np.flatnonzero(new)[1:], rows)[np.cumsum(new) - 1]
            last = np.minimum(np.arange(rows), begin + heads[ends] - heads[begin])  # a centre meets those before it
            many = np.where(np.arange(rows) < old, 0, last - begin)
            words, at, size = _words_of(batch.column("sketch"))
            total = np.concatenate(([0], np.cumsum(many)))
            lo = 0
            while lo < rows:
                hi = max(lo + 1, int(np.searchsorted(total, total[lo] + PAIRS, "right")) - 1)
                m = many[lo:hi]
                x = np.repeat(np.arange(lo, hi), m)
                y = np.arange(len(x)) - np.repeat(total[lo:hi] - total[lo], m) + np.repeat(begin[lo:hi], m)
                both = (col["n"][x] + col["n"][y]) * percent
                most = np.minimum(col["n"][x] - col["pos"][x], col["n"][y] - col["pos"][y])
                may = np.flatnonzero((col["comp"][x] != col["comp"][y]) & (most * (100 + percent) >= both))
                x, y = x[may], y[may]
                near = _apart(words, at, size, x, y) * (100 + percent) <= (100 - percent) * (col["n"][x] + col["n"][y])
                x, y = x[near], y[near]
                a, b = col["id"][x], col["id"][y]
                flip = a > b
                found = [np.where(flip, b, a), np.where(flip, a, b), col["comp"][x], col["comp"][y]]
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in found], ["a", "b", "ca", "cb"])
                lo = hi
            stay = np.flatnonzero(centre & (begin == begin[-1]))
            kept = batch.take(pa.array(stay)) if len(stay) else None

    return run


def _edges(keep, rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The confirmed links (a, b, ca, cb) between centres and members of ``rows`` (list, block, centre, id, comp, n, pos).

    Blocks are sorted side by side, so a worker holds the centres of one block and a piece of its members.
    """
    own = sets.select(F.col("id").alias("_i"), "sketch")
    rows = rows.join(own, F.col("id") == F.col("_i")).drop("_i")
    rows = rows.repartition("list", "block").sortWithinPartitions("list", "block", F.desc("centre"), "id")
    rows = rows.select("list", "block", "centre", "id", "comp", "n", "pos", "sketch")
    pairs = keep(rows.mapInArrow(_meet(percent), MET).dropDuplicates(["a", "b"]), "pairs")
    left, right = sets.select(F.col("id").alias("_ia"), F.col("set").alias("_sa")), sets.select(F.col("id").alias("_ib"), F.col("set").alias("_sb"))
    both = pairs.join(left, F.col("a") == F.col("_ia")).join(right, F.col("b") == F.col("_ib"))
    shared = F.size(F.array_intersect("_sa", "_sb"))
    return keep(both.where(100 * shared >= percent * (F.size("_sa") + F.size("_sb") - shared)).select(pairs.columns), "links")


def _blocks(rows: DataFrame, size: str) -> DataFrame:
    """``rows`` (list, centre, id, ...) dealt over blocks: each centre is in one row of blocks, each member in one column."""
    down = F.expr(f"cast(ceil({size} / {MEMBERS_A_BLOCK}) as long)")
    across = F.expr(f"cast(ceil(centres / {CENTRES_A_BLOCK}) as long)")
    place = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), n)
    fixed = lambda n: F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: i)
    as_centre = F.transform(fixed(down), lambda i: F.struct((place(across, 1) * down + i).alias("block"), F.lit(True).alias("centre")))
    as_member = F.transform(fixed(across), lambda i: F.struct((i * down + place(down, 2)).alias("block"), F.lit(False).alias("centre")))
    # With several rows of blocks a centre is a member too, so that it meets the centres of the other rows.
    each = F.when(F.col("centre") & (across > 1), F.concat(as_centre, as_member)).when(F.col("centre"), as_centre).otherwise(as_member)
    return rows.select("list", "id", "comp", "n", "pos", F.explode(each).alias("_e")).select("list", "_e.block", "_e.centre", "id", "comp", "n", "pos")


def _buckets(keep, members: DataFrame, total: int) -> DataFrame:
    """The ``total`` members (list, id, n) of buckets with several classes, the least id of each as its centre."""
    heads = members.groupBy("list").agg(F.min("id").alias("_head"), F.count(F.lit(1)).alias("_size")).where("_size > 1")
    return join_groups(members, keep(heads, "heads"), "list", "_size", total).select(
        "list", "id", F.col("id").alias("comp"), "n", F.lit(0).alias("pos"), (F.col("id") == F.col("_head")).alias("centre"), F.col("_size").alias("size"), F.lit(1).alias("centres")
    )


def _prefixes(keep, members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The documents of ``members`` (list, id, comp, n) whose list has several components, dealt anew by their rarest shingles.

    Two sets of that similarity share one of the first ``n - ceil(percent * n / 100) + 1`` of each in any common order.
    In order of rarity, a text with more shingles of its own than that is out, so lists stay short or of one component.
    """
    still = members.groupBy("list").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select(F.col("list").alias("_l"))
    open_ = members.join(bounded(keep(still, "still")), F.col("list") == F.col("_l"), "left_semi").groupBy("id").agg(F.first("comp").alias("comp"), F.first("n").alias("n"))
    own = keep(open_.join(sets.select(F.col("id").alias("_i"), "set"), F.col("id") == F.col("_i")).drop("_i"), "rest")
    each, total = own.select("id", F.explode("set").alias("h")), own.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = keep(each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "often")
    common = join_groups(each, often, "h", "df", total).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("k"))
    rows = own.drop("set").join(common.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"))
    take = F.expr(f"n - cast(ceil({percent} * n / 100) as int) + 1 - (n - size(k))")
    rows = rows.where(take > 0).select("id", "comp", "n", F.expr("n - size(k)").alias("alone"), F.posexplode(F.slice("k", F.lit(1), take)["h"]).alias("at", "list"))
    return keep(rows.select("list", "id", "comp", "n", (F.col("at") + F.col("alone")).alias("pos")), "prefixes")


def _next_centres(keep, rows: DataFrame, turn: int) -> DataFrame:
    """The rows of lists with several components; centres are members outside the list's largest component: about
    ``CENTRES[turn]`` of them, or all."""
    each = rows.groupBy("list", "comp").agg(F.count(F.lit(1)).alias("m"))
    lists = each.groupBy("list").agg(F.sum("m").alias("size"), F.count(F.lit(1)).alias("c"), F.max(F.struct("m", "comp")).alias("top")).where("c > 1")
    lists = keep(lists.select("list", "size", F.col("top.comp").alias("_top"), (F.col("size") - F.col("top.m")).alias("rest")), "open")
    rows = join_groups(rows, lists, "list", "size", rows.count())
    outside = F.col("comp") != F.col("_top")
    if turn < len(CENTRES):
        some = F.pmod(F.xxhash64("id", F.lit(turn)), F.greatest("rest", F.lit(1))) < CENTRES[turn]
        return keep(rows.withColumn("centre", outside & some).withColumn("centres", F.least("rest", F.lit(CENTRES[turn]))), "lists")
    return keep(rows.withColumn("centre", outside).withColumn("centres", F.col("rest")), "lists")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (least id reachable by links of Jaccard ``percent`` or more), kept.

    ``bands * rows`` must be a power of two. With 32 bands of 4 a pair at Jaccard 0.8 shares no bucket with
    probability (1 - 0.8 ** 4) ** 32, about 5e-8.
    """
    if bands * rows & (bands * rows - 1):
        raise ValueError("bands * rows must be a power of two")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keep = Scratch(docs.sparkSession)
    same = ["n_shingles", "set_a", "set_b"]
    signed = durable(map_arrow(src, _sign("doc_id", "text", shingle, bands, rows), SIGNED), "signed")
    total = signed.count()
    has = signed.where("n_shingles > 0 and doc_id is not null").withColumn("class", F.struct(*same))
    unlike = has.groupBy(F.col("doc_id").alias("_d")).agg(F.min("class").alias("_first"), F.max("class").alias("_last")).where("_first <> _last")
    unlike = durable(unlike.select("_d", "_first"), "unlike")
    several = not unlike.isEmpty()
    if several:
        has = has.join(bounded(unlike), F.col("doc_id") == F.col("_d"), "left").where("_first is null or _first = class")
    classes = has.groupBy("class").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.min_by("bands", "doc_id").alias("bands"))
    classes = keep(classes, "classes")

    members = classes.select(F.explode("bands").alias("list"), F.col("rep").alias("id"), F.col("class.n_shingles").cast("int").alias("n"))
    members = keep(_buckets(keep, members, bands * classes.count()), "buckets")
    ids = keep(members.select(F.col("id").alias("_id")).distinct(), "ids")
    sets = map_arrow(src.join(bounded(ids), F.col("doc_id") == F.col("_id"), "left_semi"), _sets(shingle), "id long, set_a long, set array<long>, sketch binary")
    sets = keep(sets, "sets")
    if total > signed.select("doc_id").distinct().count():  # of rows that share an id, one of its class
        of = classes.select(F.col("rep").alias("_r"), F.col("class.set_a").alias("_a"))
        sets = keep(sets.join(of, (F.col("id") == F.col("_r")) & (F.col("set_a") == F.col("_a")), "left_semi").dropDuplicates(["id"]), "sets")

    found, turn = None, -1
    lists = members
    while True:
        links = _edges(keep, _blocks(lists, "size"), sets, percent)
        met_all = turn >= len(CENTRES)
        lists = lists.where(~F.col("centre")) if turn >= 0 else lists
        if not links.isEmpty():
            comp = components(links.select(F.col("ca").alias("a"), F.col("cb").alias("b")), keep)
            lists = lookup(lists, "comp", comp, "node", "component", "comp")
            if found is None:
                found = comp
            else:
                moved = lookup(found, "component", comp, "node", "component", "component").select("node", "component")
                found = keep(moved.union(comp.join(found.select(F.col("node").alias("_k")), F.col("node") == F.col("_k"), "left_anti")), "found")
        if met_all:
            break
        if turn < 0:
            lists = _prefixes(keep, lists.select("list", "id", "comp", "n"), sets, percent)
        else:
            lists = lists.where("rest > centres").select("list", "id", "comp", "n", "pos")  # in the others all have met
        turn += 1
        lists = _next_centres(keep, lists, turn)
        if lists.isEmpty():
            break
    groups = classes.select("class", "rep", "size").withColumn("component_id", F.col("rep"))
    if found is not None:
        groups = groups.drop("component_id").join(found, F.col("rep") == F.col("node"), "left").withColumn("component_id", F.coalesce("component", "rep"))
    groups = durable(groups.where("size > 1 or component_id <> rep").select("class", "component_id", "size"), "groups")
    keep.clear()
    own = F.when(F.expr("n_shingles > 0 and doc_id is not null"), F.struct(*same))
    out = signed.select("doc_id", "n_shingles", own.alias("class"))
    if several:
        out = out.join(bounded(unlike), F.col("doc_id") == F.col("_d"), "left").withColumn("class", F.when(F.col("class").isNotNull(), F.coalesce("_first", "class"))).drop("_d", "_first")
    out = with_group(out, groups, "class", "size", total)
    own = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", own.alias("component_id"), own.eqNullSafe(F.col("doc_id")).alias("kept"))
