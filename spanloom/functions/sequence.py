"""Column functions over nucleotide strings, all built-in expressions, and figures of their words (``words``)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words


def clean(seq: Column) -> Column:
    """Upper case; every letter but A, C, G and T becomes N."""
    return F.regexp_replace(F.upper(seq), "[^ACGT]", "N")


def count_base(seq: Column, base: str) -> Column:
    return F.length(seq) - F.length(F.replace(seq, F.lit(base), F.lit("")))


def usable(seq: Column) -> Column:
    """Letters that are no N."""
    return F.length(seq) - count_base(seq, "N")


def gc_content(seq: Column) -> Column:
    return F.try_divide(count_base(seq, "G") + count_base(seq, "C"), usable(seq))


def n_fraction(seq: Column) -> Column:
    return F.when(F.length(seq) > 0, count_base(seq, "N") / F.length(seq)).otherwise(1.0)


def cpg_density(seq: Column) -> Column:
    return F.try_divide(F.regexp_count(seq, F.lit("CG")), F.length(seq) - 1)


def cpg_observed_expected(seq: Column) -> Column:
    both = count_base(seq, "C") * count_base(seq, "G")
    return F.when(both > 0, F.regexp_count(seq, F.lit("CG")) * usable(seq) / both).otherwise(0.0)


def skew(seq: Column, a: str, b: str) -> Column:
    """(a - b) / (a + b), null if neither occurs."""
    x, y = count_base(seq, a), count_base(seq, b)
    return F.try_divide(x - y, x + y)


def shannon_entropy(seq: Column) -> Column:
    """Bits over A, C, G and T; null without any."""
    n = usable(seq)
    total = F.lit(0.0)
    for base in "ACGT":
        c = count_base(seq, base)
        total = total + F.when(c > 0, -(c / n) * F.log2(c / n)).otherwise(0.0)
    return F.when(n > 0, total)


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTN", "TGCAN"))


def runs(seq: Column, base: str, least: int) -> Column:
    """Letters in runs of ``base`` of at least ``least``."""
    found = F.regexp_extract_all(seq, F.lit(f"({base}{{{least},}})"), F.lit(1))
    return F.aggregate(found, F.lit(0), lambda s, x: s + F.length(x))


def homopolymer_fraction(seq: Column, least: int = 5) -> Column:
    """Share of letters in runs of one letter of at least ``least``."""
    pattern = "|".join(f"{b}{{{least},}}" for b in "ACGTN")
    found = F.regexp_extract_all(seq, F.lit(f"({pattern})"), F.lit(1))
    return F.try_divide(F.aggregate(found, F.lit(0), lambda s, x: s + F.length(x)), F.length(seq))


def longest_run(seq: Column) -> Column:
    """Length of the longest run of one letter, 0 for an empty string."""
    found = F.regexp_extract_all(seq, F.lit("((.)\\2*)"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(found, F.length)), F.lit(0))


def run_lengths(seq: Column) -> Column:
    """Lengths of the maximal runs of one letter, in order."""
    return F.transform(F.regexp_extract_all(seq, F.lit("((.)\\2*)"), F.lit(1)), F.length)


def run_summary(df: DataFrame, key: str, seq: str, share: float = 0.95) -> DataFrame:
    """Per key: longest run, mean run and the interpolated percentile ``share`` of the runs; null for an empty string."""
    rows = df.where(F.length(seq) > 0).select(key, F.explode(F.array(F.sort_array(run_lengths(F.col(seq))))).alias("r")).withColumn("_at", (F.size("r") - 1) * F.lit(share))
    low, high = F.get("r", F.floor("_at").cast("int")), F.get("r", F.ceil("_at").cast("int"))
    mean = F.aggregate("r", F.lit(0).cast("long"), lambda t, x: t + x) / F.size("r")
    return rows.select(key, F.array_max("r").alias("longest"), mean.alias("mean"), (low + (high - low) * (F.col("_at") - F.floor("_at"))).alias("high"))


def block_entropies(seq: Column, size: int) -> Column:
    """Entropy in bits of each consecutive block of ``size`` letters (the last may be shorter), over all letters that occur, N too."""
    blocks = F.regexp_extract_all(seq, F.lit(f"(.{{1,{size}}})"), F.lit(1))

    def bits(b: Column) -> Column:
        n, total = F.length(b), F.lit(0.0)
        for base in "ACGTN":
            c = count_base(b, base)
            total = total + F.when(c > 0, -(c / n) * F.log2(c / n)).otherwise(0.0)
        return total

    return F.transform(blocks, bits)


def block_profile(df: DataFrame, key: str, seq: str, size: int = 50) -> DataFrame:
    """Per key: number of blocks, mean block entropy, and the largest step from a block to the next (null with one block)."""
    rows = df.where(F.length(seq) > 0).select(key, F.explode(F.array(block_entropies(F.col(seq), size))).alias("b"))
    mean = F.aggregate("b", F.lit(0.0), lambda t, x: t + x) / F.size("b")
    steps = F.transform(F.slice("b", F.lit(2), F.size("b")), lambda x, i: F.abs(x - F.get("b", i)))
    return rows.select(key, F.size("b").alias("n_blocks"), mean.alias("mean_entropy"), F.array_max(steps).alias("largest_step"))


def composition_step(df: DataFrame, key: str, seq: str, size: int = 50) -> DataFrame:
    """Per key: the largest Euclidean distance between the shares of A, C, G and T of a whole block of ``size`` letters
    and of the next, and the first place where it stands (nulls with one block; a string shorter than a block has no row)."""
    blocks = F.regexp_extract_all(F.col(seq), F.lit(f"(.{{{size}}})"), F.lit(1))
    rows = df.where(F.length(seq) >= size).select(key, F.explode(F.array(F.transform(blocks, lambda b: F.array(*[count_base(b, x) / size for x in "ACGT"])))).alias("b"))

    def step(x: Column, i: Column) -> Column:
        before = F.get("b", i)  # the slice starts at the second block
        return F.round(F.sqrt(sum((F.get(x, j) - F.get(before, j)) ** 2 for j in range(4))), 9)

    rows = rows.withColumn("_s", F.transform(F.slice("b", F.lit(2), F.size("b")), step)).withColumn("step", F.array_max("_s"))
    return rows.select(key, "step", (F.array_position("_s", F.col("step")) * size).alias("at"))


def _long(name: str) -> T.StructField:
    return T.StructField(name, T.LongType())


def _double(name: str) -> T.StructField:
    return T.StructField(name, T.DoubleType())


def _entropy(n: np.ndarray) -> float:
    """Bits of the shares of counts."""
    return float(np.log2(n.sum()) - (n * np.log2(n)).sum() / n.sum())


def kmer_graph(df: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """The graph of k-mers that follow each other, per key: nodes, edges, and the entropy in bits of the edges' counts."""

    def figure(edges):
        w, n = edges
        return len(np.unique(np.concatenate(words.ranks(w[:, :k], w[:, 1:])))), len(n), _entropy(n)

    return words.figures(df, key, [seq], tuple(range(k + 1)), figure, [_long("nodes"), _long("edges"), _double("entropy")], "N")


def kmer_absence(df: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """Share of the k-mers that could occur (all of them, or as many as there are places) that do not; null without a place."""
    seen = words.figures(df, key, [seq], tuple(range(k)), lambda found: (len(found[1]),), [_long("seen")], "N").withColumnRenamed(key, "_k")
    could = F.least(F.lit(4**k), F.length(seq) - k + 1)
    got = df.select(key, could.alias("could")).join(seen, F.col(key) == F.col("_k"), "left")
    return got.select(key, F.when(F.col("could") > 0, (F.col("could") - F.coalesce("seen", F.lit(0))) / F.col("could")).alias("absent"))


def walk_spread(df: DataFrame, key: str, seq: str, plus: str, minus: str) -> DataFrame:
    """Population standard deviation of the cumulative walk over its places."""
    zero = F.struct(*[F.lit(0).cast("long").alias(n) for n in ("v", "s", "q")])

    def move(t: Column, c: Column) -> Column:
        v = t["v"] + F.when(c.isin(*plus), 1).when(c.isin(*minus), -1).otherwise(0)
        return F.struct(v.alias("v"), (t["s"] + v).alias("s"), (t["q"] + v * v).alias("q"))

    rows = df.where(F.length(seq) > 0).withColumn("_e", F.aggregate(F.split(seq, ""), zero, move)).withColumn("_n", F.length(seq))
    mean = F.col("_e.s") / F.col("_n")
    return rows.select(key, F.sqrt(F.greatest(F.lit(0.0), F.col("_e.q") / F.col("_n") - mean * mean)).alias("spread"))


def extract(seq: Column, start: Column, end: Column) -> Column:
    """The half-open interval, cut at the string's ends."""
    a = F.greatest(start, F.lit(0))
    return F.substring(seq, (a + 1).cast("int"), F.greatest(end - a, F.lit(0)).cast("int"))


def kmer_counts(df: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """(key, kmer, n) of every overlapping k-mer without N."""
    return words.counts(df, key, seq, tuple(range(k)), "N")


def kmer_profile(df: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """Per key: total and distinct k-mers, their entropy in bits, and the share of all possible k-mers that occur."""

    def figure(found):
        n = found[1]
        return int(n.sum()), len(n), _entropy(n), len(n) / 4.0**k

    return words.figures(df, key, [seq], tuple(range(k)), figure, [_long("total"), _long("distinct_kmers"), _double("entropy"), _double("occupancy")], "N")


def walk(df: DataFrame, key: str, seq: str, plus: str, minus: str) -> DataFrame:
    """Final value and range of the cumulative walk: +1 at letters of ``plus``, -1 at those of ``minus``."""
    zero = F.struct(F.lit(0).alias("v"), F.lit(None).cast("int").alias("lo"), F.lit(None).cast("int").alias("hi"))

    def move(s: Column, c: Column) -> Column:
        v = s["v"] + F.when(c.isin(*plus), 1).when(c.isin(*minus), -1).otherwise(0)
        return F.struct(v.alias("v"), F.least(s["lo"], v).alias("lo"), F.greatest(s["hi"], v).alias("hi"))

    end = F.aggregate(F.split(seq, ""), zero, move)
    return df.where(F.length(seq) > 0).withColumn("_e", end).select(key, F.col("_e.v").alias("final"), (F.col("_e.hi") - F.col("_e.lo")).alias("range"))


def conditional_entropy(df: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """Bits of the next letter given the k before: entropy over (k + 1)-mers less that of their first k letters."""

    def figure(found):
        w, n = found
        heads = np.unique(words.ranks(w[:, :k])[0], return_inverse=True)[1]
        m = np.bincount(heads, n)
        return (float(((m * np.log2(m)).sum() - (n * np.log2(n)).sum()) / m.sum()),)

    return words.figures(df, key, [seq], tuple(range(k + 1)), figure, [_double("bits")], "N")


def dinucleotide_odds(df: DataFrame, key: str, seq: str) -> DataFrame:
    """f(xy) / (f(x) f(y)) of every pair that occurs, by first and second letters of the pairs."""
    c = kmer_counts(df, key, seq, 2).withColumns({"x": F.substring("kmer", 1, 1), "y": F.substring("kmer", 2, 1)})
    own = c.groupBy(key).agg(F.sum("n").alias("t"))
    xs, ys = c.groupBy(key, "x").agg(F.sum("n").alias("nx")), c.groupBy(key, "y").agg(F.sum("n").alias("ny"))
    c = c.join(own, key).join(xs, [key, "x"]).join(ys, [key, "y"])
    return c.select(key, "kmer", (F.col("n") * F.col("t") / (F.col("nx") * F.col("ny"))).alias("odds"))


def half_distance(df: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """Total variation distance of the k-mer shares of the left and right half."""
    halves = df.select(key, F.expr(f"substring({seq}, 1, length({seq}) div 2)").alias("_l"), F.expr(f"substring({seq}, length({seq}) div 2 + 1)").alias("_r"))

    def figure(left, right):
        wide = np.uint8 if left[0].dtype == right[0].dtype == np.uint8 else np.uint32
        rank = words.ranks(left[0].astype(wide), right[0].astype(wide))
        at = np.unique(np.concatenate(rank), return_inverse=True)[1]
        share = np.concatenate([left[1] / max(1, left[1].sum()), -right[1] / max(1, right[1].sum())])
        return (float(np.abs(np.bincount(at, share)).sum() / 2),)

    return words.figures(halves, key, ["_l", "_r"], tuple(range(k)), figure, [_double("distance")], "N")


def strand_asymmetry(df: DataFrame, key: str, seq: str, k: int) -> DataFrame:
    """Mean of |c - r| / (c + r) over k-mers up to reverse complement, c and r the counts of both strands; palindromes left out."""
    facing = np.arange(256)
    facing[[ord(c) for c in "ACGT"]] = [ord(c) for c in "TGCA"]

    def figure(found):
        w, n = found
        turned = w[:, ::-1].copy()
        low = turned < 256
        turned[low] = facing[turned[low]]
        own, other = words.ranks(w, turned)
        use = own != other
        if not use.any():
            return None
        at = np.unique(np.minimum(own, other)[use], return_inverse=True)[1]
        off = np.bincount(at, np.where(own < other, n, -n)[use])
        return (float((np.abs(off) / np.bincount(at, n[use])).mean()),)

    return words.figures(df, key, [seq], tuple(range(k)), figure, [_double("asymmetry")], "N")


def mutual_information(df: DataFrame, key: str, seq: str, lag: int) -> DataFrame:
    """Bits that a letter tells of the one ``lag`` later, from the pairs of both."""

    def figure(found):
        w, n = found
        t, x, y = n.sum(), np.unique(w[:, 0], return_inverse=True)[1], np.unique(w[:, 1], return_inverse=True)[1]
        return (float((n / t * np.log2(n * t / (np.bincount(x, n)[x] * np.bincount(y, n)[y]))).sum()),)

    return words.figures(df, key, [seq], (0, lag), figure, [_double("bits")])
