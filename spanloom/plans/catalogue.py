"""All registered queries of the interval and sequence operators, with the SQL that checks each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spanloom.functions import arrays
from spanloom.functions import sequence as seq
from spanloom.operators import intervals as iv
from spanloom.operators import stats
from spanloom.operators import windows as win
from spanloom.streaming import sliding

from .projections import IV, SEQS, intervals, sequences, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
SIZES = (200, 1000, 4000)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(c, digits: int = 6):
    """Rounded as the SQL rounds: the product with the power of ten to a whole number, halves away from zero. ``F.round`` goes
    by the decimal digits, so 41/640 = 0.0640625, whose product is under a half, would differ."""
    ten = F.lit(10.0**digits)
    return F.round((F.col(c) if isinstance(c, str) else c) * ten, 0) / ten


def _b(base: str) -> str:
    return f"(length(q) - length(replace(q, '{base}', '')))"


# Sequences


@query(f"""WITH {SEQS}, c AS (SELECT doc_id, length(q) AS n, {_b('A')} AS a, {_b('C')} AS c, {_b('G')} AS g, {_b('T')} AS t, {_b('CG')} / 2 AS cg FROM seqs)
SELECT doc_id, round((g + c) / nullif(a + c + g + t, 0), 6) AS gc, round(CASE WHEN n > 0 THEN 0.0e0 ELSE 1.0e0 END, 6) AS n_fraction,
round(cg / nullif(n - 1, 0), 6) AS cpg_density, round(CASE WHEN c * g > 0 THEN cg * (a + c + g + t) / (c * g) ELSE 0.0e0 END, 6) AS cpg_oe,
round((g - c) / nullif(g + c, 0), 6) AS gc_skew, round((a - t) / nullif(a + t, 0), 6) AS at_skew FROM c""")
def seq_composition(spark, sf_dir):
    q = F.col("q")
    return sequences(spark, sf_dir).select(
        "doc_id", _r(seq.gc_content(q)).alias("gc"), _r(seq.n_fraction(q)).alias("n_fraction"), _r(seq.cpg_density(q)).alias("cpg_density"),
        _r(seq.cpg_observed_expected(q)).alias("cpg_oe"), _r(seq.skew(q, "G", "C")).alias("gc_skew"), _r(seq.skew(q, "A", "T")).alias("at_skew"),
    )


def _h(base: str) -> str:
    return f"CASE WHEN {_b(base)} > 0 THEN -({_b(base)} / length(q)) * log2({_b(base)} / length(q)) ELSE 0 END"


@query(f"WITH {SEQS} SELECT doc_id, CASE WHEN length(q) > 0 THEN round({' + '.join(_h(b) for b in 'ACGT')}, 6) END AS entropy FROM seqs")
def seq_shannon_entropy(spark, sf_dir):
    return sequences(spark, sf_dir).select("doc_id", _r(seq.shannon_entropy(F.col("q"))).alias("entropy"))


@query(f"""WITH {SEQS} SELECT doc_id,
round(coalesce(list_sum(list_transform(regexp_extract_all(q, 'A{{5,}}|C{{5,}}|G{{5,}}|T{{5,}}'), lambda x: length(x))), 0) / nullif(length(q), 0), 6) AS run_fraction,
CAST(coalesce(list_sum(list_transform(regexp_extract_all(q, 'G{{3,}}'), lambda x: length(x))), 0) AS BIGINT) AS g_in_runs FROM seqs""")
def seq_runs(spark, sf_dir):
    q = F.col("q")
    return sequences(spark, sf_dir).select("doc_id", _r(seq.homopolymer_fraction(q)).alias("run_fraction"), seq.runs(q, "G", 3).cast("long").alias("g_in_runs"))


@query(f"WITH {SEQS} SELECT doc_id, md5(reverse(translate(q, 'ACGTN', 'TGCAN'))) AS rc_md5 FROM seqs")
def reverse_complement(spark, sf_dir):
    return sequences(spark, sf_dir).select("doc_id", F.md5(seq.reverse_complement(F.col("q")).cast("binary")).alias("rc_md5"))


@query(f"""WITH {SEQS}, k AS (SELECT chrom, substr(q, i, 3) AS kmer FROM (SELECT chrom, q, unnest(range(1, length(q) - 1)) AS i FROM seqs))
SELECT chrom, kmer, count(*) AS n FROM k GROUP BY ALL""")
def kmer_counts_k3(spark, sf_dir):
    return seq.kmer_counts(sequences(spark, sf_dir), "chrom", "q", 3)


@query(f"""WITH {SEQS}, k AS (SELECT doc_id, substr(q, i, 4) AS kmer FROM (SELECT doc_id, q, unnest(range(1, length(q) - 2)) AS i FROM seqs)),
c AS (SELECT doc_id, kmer, count(*) AS n FROM k GROUP BY ALL)
SELECT doc_id, CAST(sum(n) AS BIGINT) AS total, count(*) AS distinct_kmers, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy,
round(count(*) / 256.0e0, 6) AS occupancy FROM c GROUP BY doc_id""")
def kmer_profile_k4(spark, sf_dir):
    p = seq.kmer_profile(sequences(spark, sf_dir), "doc_id", "q", 4)
    return p.select("doc_id", "total", "distinct_kmers", _r("entropy").alias("entropy"), _r("occupancy").alias("occupancy"))


@query(f"""WITH {SEQS}, p AS (SELECT doc_id, q, unnest(range(1, length(q) + 1)) AS i FROM seqs),
w AS (SELECT doc_id, i, sum(CASE WHEN substr(q, i, 1) IN ('A', 'G') THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM p)
SELECT doc_id, CAST(arg_max(v, i) AS INTEGER) AS final, CAST(max(v) - min(v) AS INTEGER) AS range FROM w GROUP BY doc_id""")
def purine_walk(spark, sf_dir):
    return seq.walk(sequences(spark, sf_dir), "doc_id", "q", "AG", "CT")


@query()
def seq_measures(spark, sf_dir):
    """LZ78, compression, palindromes, autocorrelation, spectrum and DFA of each whole sequence."""
    return sequences(spark, sf_dir).select("doc_id", arrays.measures("q").alias("m")).select("doc_id", "m.*")


@query(f"""WITH {SEQS}, p AS (SELECT doc_id, q, unnest(range(1, length(q) - 2)) AS i FROM seqs), w AS (SELECT *, unnest(range(4, 13)) AS w FROM p),
h AS (SELECT doc_id, substr(q, i, w) AS x FROM w WHERE i + w - 1 <= length(q)), d AS (
SELECT doc_id, sum(CASE WHEN x = reverse(translate(x, 'ACGT', 'TGCA')) THEN 1 ELSE 0 END) / count(*) AS d FROM h GROUP BY 1)
SELECT seqs.doc_id, round(d, 6) AS palindrome_density FROM seqs LEFT JOIN d ON seqs.doc_id = d.doc_id""")
def palindromes(spark, sf_dir):
    return sequences(spark, sf_dir).select("doc_id", _r(arrays.palindromes("q")).alias("palindrome_density"))


@query(f"""WITH {SEQS}, p AS (SELECT doc_id, i, CASE WHEN substr(q, i, 1) IN ('G', 'C') THEN 1 ELSE -1 END AS x FROM (SELECT doc_id, q, unnest(range(1, length(q) + 1)) AS i FROM seqs WHERE length(q) >= 12)),
c AS (SELECT doc_id, i, x - avg(x) OVER (PARTITION BY doc_id) AS a FROM p), l AS (SELECT doc_id, a, lead(a, 10) OVER (PARTITION BY doc_id ORDER BY i) AS b FROM c),
r AS (SELECT doc_id, sum(a * b) AS ab, sum(a * a) AS aa, sum(b * b) AS bb FROM l WHERE b IS NOT NULL GROUP BY 1)
SELECT seqs.doc_id, CASE WHEN aa * bb > 1e-12 THEN round(ab / sqrt(aa * bb), 6) END AS acf_10 FROM seqs LEFT JOIN r ON seqs.doc_id = r.doc_id""")
def autocorrelation_lag10(spark, sf_dir):
    return sequences(spark, sf_dir).select("doc_id", _r(arrays.correlation_lag(10)("q")).alias("acf_10"))


@query()
def seq_surrogates(spark, sf_dir):
    """Composition of each sequence and of its shuffled and Markov surrogates."""
    s = arrays.surrogate_rows(sequences(spark, sf_dir).select("doc_id", "q"), "q", 2)
    return s.select("doc_id", "kind", "replicate", F.length("sequence").alias("length"), _r(seq.gc_content(F.col("sequence"))).alias("gc"), _r(seq.cpg_density(F.col("sequence"))).alias("cpg_density"))


_K3 = "k AS (SELECT doc_id, substr(q, i, 3) AS kmer FROM (SELECT doc_id, q, unnest(range(1, length(q) - 1)) AS i FROM seqs)), c AS (SELECT doc_id, kmer, count(*) AS n FROM k GROUP BY ALL)"


@query(f"""WITH {SEQS}, {_K3}, h AS (SELECT doc_id, substr(kmer, 1, 2) AS h, sum(n) AS m, sum(n * log2(n)) AS s FROM c GROUP BY ALL)
SELECT doc_id, round((sum(m * log2(m)) - sum(s)) / sum(m), 6) AS bits FROM h GROUP BY doc_id""")
def conditional_entropy_k2(spark, sf_dir):
    return seq.conditional_entropy(sequences(spark, sf_dir), "doc_id", "q", 2).select("doc_id", _r("bits").alias("bits"))


@query(f"""WITH {SEQS}, k AS (SELECT chrom, substr(q, i, 2) AS kmer FROM (SELECT chrom, q, unnest(range(1, length(q))) AS i FROM seqs)), c AS (SELECT chrom, kmer, count(*) AS n FROM k GROUP BY ALL)
SELECT chrom, kmer, round(n * sum(n) OVER (PARTITION BY chrom) / (sum(n) OVER (PARTITION BY chrom, substr(kmer, 1, 1)) * sum(n) OVER (PARTITION BY chrom, substr(kmer, 2, 1))), 6) AS odds FROM c""")
def dinucleotide_odds(spark, sf_dir):
    return seq.dinucleotide_odds(sequences(spark, sf_dir), "chrom", "q").select("chrom", "kmer", _r("odds").alias("odds"))


_HALF = "SELECT doc_id, substr(h, i, 3) AS kmer, count(*) AS n FROM (SELECT doc_id, h, unnest(range(1, length(h) - 1)) AS i FROM (SELECT doc_id, {} AS h FROM seqs)) GROUP BY ALL"


@query(f"""WITH {SEQS}, l AS ({_HALF.format("substr(q, 1, length(q) // 2)")}), r AS ({_HALF.format("substr(q, length(q) // 2 + 1)")}),
a AS (SELECT doc_id, kmer, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM l), b AS (SELECT doc_id, kmer, n / sum(n) OVER (PARTITION BY doc_id) AS p FROM r)
SELECT doc_id, round(sum(abs(coalesce(a.p, 0) - coalesce(b.p, 0))) / 2 + 1e-9, 6) AS distance FROM a FULL JOIN b USING (doc_id, kmer) GROUP BY doc_id""")
def half_distance_k3(spark, sf_dir):
    return seq.half_distance(sequences(spark, sf_dir), "doc_id", "q", 3).select("doc_id", _r(F.col("distance") + 1e-9).alias("distance"))


@query(f"""WITH {SEQS}, {_K3}, s AS (SELECT *, reverse(translate(kmer, 'ACGT', 'TGCA')) AS rc FROM c), p AS (
SELECT doc_id, least(kmer, rc) AS canon, abs(sum(CASE WHEN kmer <= rc THEN n ELSE -n END)) / sum(n) AS bias FROM s WHERE kmer <> rc GROUP BY ALL)
SELECT doc_id, round(avg(bias), 6) AS asymmetry FROM p GROUP BY doc_id""")
def strand_asymmetry_k3(spark, sf_dir):
    return seq.strand_asymmetry(sequences(spark, sf_dir), "doc_id", "q", 3).select("doc_id", _r("asymmetry").alias("asymmetry"))


@query(f"""WITH {SEQS}, p AS (SELECT doc_id, substr(q, i, 1) AS x, substr(q, i + 7, 1) AS y FROM (SELECT doc_id, q, unnest(range(1, length(q) - 6)) AS i FROM seqs)),
c AS (SELECT doc_id, x, y, count(*) AS n FROM p GROUP BY ALL), m AS (SELECT *, sum(n) OVER (PARTITION BY doc_id) AS t, sum(n) OVER (PARTITION BY doc_id, x) AS nx, sum(n) OVER (PARTITION BY doc_id, y) AS ny FROM c)
SELECT doc_id, round(sum(n / t * log2(n * t / (nx * ny))), 6) AS bits FROM m GROUP BY doc_id""")
def mutual_information_lag7(spark, sf_dir):
    return seq.mutual_information(sequences(spark, sf_dir), "doc_id", "q", 7).select("doc_id", _r("bits").alias("bits"))


_RUNS = "list_transform(regexp_extract_all(q, 'A+|C+|G+|T+'), lambda x: length(x))"


@query(f"""WITH {SEQS}, r AS (SELECT doc_id, {_RUNS} AS r FROM seqs WHERE length(q) > 0)
SELECT doc_id, CAST(list_max(r) AS INTEGER) AS longest, round(list_sum(r) / len(r), 6) AS mean, round(list_aggregate(r, 'quantile_cont', 0.95), 6) AS high FROM r""")
def seq_run_lengths(spark, sf_dir):
    return seq.run_summary(sequences(spark, sf_dir), "doc_id", "q").select("doc_id", "longest", _r("mean").alias("mean"), _r("high").alias("high"))


@query(f"""WITH {SEQS}, b AS (SELECT doc_id, i, substr(q, i * 50 + 1, 50) AS q FROM (SELECT doc_id, q, unnest(range(0, (length(q) + 49) // 50)) AS i FROM seqs)),
e AS (SELECT doc_id, i, {' + '.join(_h(b) for b in 'ACGT')} AS h FROM b), d AS (SELECT *, abs(h - lag(h) OVER (PARTITION BY doc_id ORDER BY i)) AS step FROM e)
SELECT doc_id, CAST(count(*) AS INTEGER) AS n_blocks, round(avg(h), 6) AS mean_entropy, round(max(step), 6) AS largest_step FROM d GROUP BY doc_id""")
def block_entropy_profile(spark, sf_dir):
    p = seq.block_profile(sequences(spark, sf_dir), "doc_id", "q")
    return p.select("doc_id", "n_blocks", _r("mean_entropy").alias("mean_entropy"), _r("largest_step").alias("largest_step"))


_SHARES = ", ".join(f"{_b(b)} / length(q) AS {b.lower()}" for b in "ACGT")
_STEP = " + ".join(f"power({b} - lag({b}) OVER (PARTITION BY doc_id ORDER BY i), 2)" for b in "acgt")


@query(f"""WITH {SEQS}, b AS (SELECT doc_id, i, substr(q, i * 50 + 1, 50) AS q FROM (SELECT doc_id, q, unnest(range(0, length(q) // 50)) AS i FROM seqs)),
e AS (SELECT doc_id, i, {_SHARES} FROM b), d AS (SELECT doc_id, i, round(sqrt({_STEP}), 9) AS step FROM e)
SELECT doc_id, round(max(step), 6) AS step, min(CASE WHEN step = m THEN i END) * 50 AS "at" FROM (SELECT *, max(step) OVER (PARTITION BY doc_id) AS m FROM d) GROUP BY doc_id""")
def composition_step(spark, sf_dir):
    return seq.composition_step(sequences(spark, sf_dir), "doc_id", "q", 50).select("doc_id", _r("step").alias("step"), "at")


@query()
def seq_compression_z(spark, sf_dir):
    """How far each sequence compresses below its own surrogates, by codec."""
    return sequences(spark, sf_dir).select("doc_id", arrays.compression_z()("q").alias("c")).select("doc_id", "c.*")


@query(f"""WITH {SEQS}, k AS (SELECT doc_id, substr(q, i, 4) AS e FROM (SELECT doc_id, q, unnest(range(1, length(q) - 2)) AS i FROM seqs)),
c AS (SELECT doc_id, e, count(*) AS n FROM k GROUP BY ALL),
v AS (SELECT doc_id, count(DISTINCT x) AS nodes FROM (SELECT doc_id, substr(e, 1, 3) AS x FROM c UNION ALL SELECT doc_id, substr(e, 2, 3) FROM c) GROUP BY doc_id)
SELECT c.doc_id, any_value(nodes) AS nodes, count(*) AS edges, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM c JOIN v ON c.doc_id = v.doc_id GROUP BY c.doc_id""")
def kmer_graph_k3(spark, sf_dir):
    return seq.kmer_graph(sequences(spark, sf_dir), "doc_id", "q", 3).select("doc_id", "nodes", "edges", _r("entropy").alias("entropy"))


@query(f"""WITH {SEQS}, k AS (SELECT doc_id, count(DISTINCT substr(q, i, 4)) AS seen FROM (SELECT doc_id, q, unnest(range(1, length(q) - 2)) AS i FROM seqs) GROUP BY 1),
n AS (SELECT doc_id, least(256, length(q) - 3) AS could FROM seqs)
SELECT n.doc_id, CASE WHEN could > 0 THEN round((could - coalesce(seen, 0)) / could, 6) END AS absent FROM n LEFT JOIN k ON n.doc_id = k.doc_id""")
def kmer_absence_k4(spark, sf_dir):
    return seq.kmer_absence(sequences(spark, sf_dir), "doc_id", "q", 4).select("doc_id", _r("absent").alias("absent"))


@query(f"""WITH {SEQS}, p AS (SELECT doc_id, q, unnest(range(1, length(q) + 1)) AS i FROM seqs),
w AS (SELECT doc_id, sum(CASE WHEN substr(q, i, 1) IN ('G', 'C') THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id ORDER BY i) AS v FROM p)
SELECT doc_id, round(stddev_pop(v), 4) AS spread FROM w GROUP BY doc_id""")
def gc_walk_spread(spark, sf_dir):
    return seq.walk_spread(sequences(spark, sf_dir), "doc_id", "q", "GC", "AT").select("doc_id", _r("spread", 4).alias("spread"))


@query(f"""WITH {SEQS}, p AS (SELECT doc_id, string_split(q, '') AS l, length(q) AS n FROM seqs WHERE length(q) > 1),
s AS (SELECT doc_id, d, list_sum(list_transform(range(1, n - d + 1), lambda i: CASE WHEN l[i] = l[i + d] THEN 1 ELSE 0 END)) / (n - d) AS share
FROM (SELECT *, unnest(range(1, least(20, n - 1) + 1)) AS d FROM p)), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY share DESC, d) AS k FROM s)
SELECT doc_id, CAST(d AS INTEGER) AS lag, round(share, 6) AS share FROM r WHERE k = 1""")
def lag_periodicity(spark, sf_dir):
    s = sequences(spark, sf_dir).where(F.length("q") > 1).select("doc_id", arrays.lag_match("q").alias("m"))
    return s.select("doc_id", "m.lag", _r("m.share").alias("share"))


_KINDS = ("shuffle", "blocks3", "pairs", "local", "local_pairs", "composition", "reverse", "reverse_complement")


@query(f"""WITH {SEQS}, k(kind) AS (VALUES {', '.join(f"('{k}')" for k in _KINDS)}), r(replicate) AS (VALUES (0), (1))
SELECT doc_id, kind, CAST(replicate AS INTEGER) AS replicate, length(q) AS length, CASE WHEN length(q) > 0 THEN round(({_b('G')} + {_b('C')}) / length(q), 6) END AS gc,
CASE WHEN kind = 'pairs' AND length(q) > 1 THEN round({_b('CG')} / 2 / (length(q) - 1), 6) END AS cpg_density FROM seqs, k, r""")
def surrogate_invariants(spark, sf_dir):
    """What surrogates keep: length and composition, and the pair shuffle also the counts of pairs."""
    s = arrays.surrogate_rows(sequences(spark, sf_dir).select("doc_id", "q"), "q", 2, kinds=_KINDS)
    q = F.col("sequence")
    return s.select("doc_id", "kind", "replicate", F.length(q).alias("length"), _r(seq.gc_content(q)).alias("gc"), F.when((F.col("kind") == "pairs") & (F.length(q) > 1), _r(seq.cpg_density(q))).alias("cpg_density"))


@query()
def compression_distance(spark, sf_dir):
    """Normalised compression distance of each sequence to the next one of its source by id."""
    s = sequences(spark, sf_dir)
    ids = s.select("chrom", "doc_id").withColumn("next_id", F.lead("doc_id").over(Window.partitionBy("chrom").orderBy("doc_id"))).where("next_id is not null")
    other = s.select(F.col("doc_id").alias("next_id"), F.col("q").alias("other"))
    both = ids.select("doc_id", "next_id").join(s.select("doc_id", "q"), "doc_id").join(other, "next_id")
    return both.select("doc_id", "next_id", _r(arrays.distances("q", "other")).alias("distance"))


# Windows

_SIZE_ROWS = ", ".join(f"({w}, {max(1, w // 2)}, {i})" for i, w in enumerate(SIZES))
WINDOWS = f"""sizes(w, step, lvl) AS (VALUES {_SIZE_ROWS}),
axes AS (SELECT 'd' || doc_id AS chrom, length(q) AS size FROM seqs WHERE length(q) > 0),
grid AS (SELECT chrom, size, w, lvl, unnest(range(0, greatest(size - w, 0) + 1, step)) AS s FROM axes, sizes
         UNION ALL SELECT chrom, size, w, lvl, size - w FROM axes, sizes WHERE size > w AND (size - w) % step <> 0),
win AS (SELECT chrom || ':' || s || '-' || least(size, s + w) || ':' || w AS region_id, chrom, s, least(size, s + w) AS e, w, lvl FROM grid)"""


def _windows(spark, sf_dir):
    axes = sequences(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chrom"), F.length("q").alias("size"), "q")
    return axes, win.tile(axes, list(SIZES))


@query(f'WITH {SEQS}, {WINDOWS} SELECT region_id, chrom, s AS start, e AS "end", CAST(w AS BIGINT) AS window_size, CAST(lvl AS INTEGER) AS scale_level FROM win')
def windows_multiscale(spark, sf_dir):
    return _windows(spark, sf_dir)[1]


@query(f"""WITH {SEQS}, {WINDOWS}, m AS (
SELECT a.region_id, b.region_id AS parent_id, row_number() OVER (PARTITION BY a.region_id ORDER BY b.lvl, b.s DESC) AS n
FROM win a JOIN win b ON a.chrom = b.chrom AND b.lvl > a.lvl AND b.s <= a.s AND b.e >= a.e)
SELECT w.region_id, m.parent_id FROM win w LEFT JOIN m ON w.region_id = m.region_id AND m.n = 1""")
def window_parents(spark, sf_dir):
    return win.tile(_windows(spark, sf_dir)[0], list(SIZES), parents=True).select("region_id", "parent_id")


@query(f"""WITH {SEQS}, {WINDOWS}, m AS (
SELECT a.region_id, a.lvl, a.s, b.region_id AS parent_id, row_number() OVER (PARTITION BY a.region_id ORDER BY b.lvl, b.s DESC) AS n
FROM win a JOIN win b ON a.chrom = b.chrom AND b.lvl > a.lvl AND b.s <= a.s AND b.e >= a.e)
SELECT parent_id, CAST(count(*) AS INTEGER) AS n_children, string_agg(region_id, ',' ORDER BY lvl, s, region_id) AS child_ids FROM m WHERE n = 1 GROUP BY parent_id""")
def window_children(spark, sf_dir):
    return win.children(win.tile(_windows(spark, sf_dir)[0], list(SIZES), parents=True))


@query(f"""WITH {SEQS}, {WINDOWS}, p AS (SELECT doc_id, i, substr(q, i, 1) AS c FROM (SELECT doc_id, q, unnest(range(1, length(q) + 1)) AS i FROM seqs)),
g AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, c ORDER BY i) AS k FROM p), r AS (SELECT *, count(*) OVER (PARTITION BY doc_id, c, k) AS run FROM g),
f AS (SELECT doc_id, i, sum(CASE WHEN c IN ('G', 'C') THEN 1 ELSE 0 END) OVER w AS gc, sum(CASE WHEN run >= 5 THEN 1 ELSE 0 END) OVER w AS low FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY i))
SELECT chrom, s AS start, e AS "end", CAST(w AS BIGINT) AS window_size, round((b.gc - coalesce(a.gc, 0)) / (e - s), 6) AS gc, 0.0e0 AS n_fraction,
round((b.low - coalesce(a.low, 0)) / (e - s), 6) AS low_complexity FROM win JOIN f b ON chrom = 'd' || b.doc_id AND b.i = e LEFT JOIN f a ON chrom = 'd' || a.doc_id AND a.i = s""")
def window_base_stats(spark, sf_dir):
    axes = sequences(spark, sf_dir).select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("chrom"), "q")
    w = win.base_stats(axes, list(SIZES), seq="q")
    return w.select("chrom", "start", "end", "window_size", *[_r(c).alias(c) for c in ("gc", "n_fraction", "low_complexity")])


@query(f"""WITH {SEQS}, {WINDOWS}, x AS (SELECT region_id, substr(q, s + 1, e - s) AS q FROM win JOIN seqs ON win.chrom = 'd' || doc_id)
SELECT region_id, round(({_b('G')} + {_b('C')}) / nullif(length(q), 0), 6) AS gc FROM x""")
def window_gc(spark, sf_dir):
    axes, tiles = _windows(spark, sf_dir)
    x = tiles.join(axes.select("chrom", "q").hint("merge"), "chrom")
    return x.select("region_id", _r(seq.gc_content(seq.extract(F.col("q"), F.col("start"), F.col("end")))).alias("gc"))


# Interval joins and sweeps


def _kind(df, kind):
    return df.where(F.col("event_type") == kind)


def _sides(spark, sf_dir):
    all_ = intervals(spark, sf_dir)
    return _kind(all_, "view"), _kind(all_, "purchase")


_PAIR = "a.chrom = b.chrom AND a.s < b.e AND a.e > b.s"
_AB = f"{IV}, a AS (SELECT * FROM iv WHERE event_type = 'view'), b AS (SELECT * FROM iv WHERE event_type = 'purchase')"


@query(f"WITH {_AB} SELECT event_id, EXISTS (SELECT 1 FROM b WHERE {_PAIR}) AS overlaps FROM a")
def overlap_exists(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return iv.with_overlap(left, right, "event_id").select("event_id", "overlaps")


@query(f"WITH {_AB} SELECT event_id FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE {_PAIR})")
def overlap_anti(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return iv.keep_overlapping(left, right, "event_id", anti=True).select("event_id")


@query(f"""WITH {_AB}, p AS (SELECT a.event_id, least(a.e, b.e) - greatest(a.s, b.s) AS bp, b.value FROM a JOIN b ON {_PAIR}),
g AS (SELECT event_id, count(*) AS n, CAST(sum(bp) AS BIGINT) AS bp, sum(bp * value) AS w FROM p GROUP BY event_id)
SELECT a.event_id, coalesce(n, 0) AS n_overlaps, coalesce(bp, 0) AS overlap_bp, round(least(1.0e0, coalesce(bp, 0) / (e - s)), 6) AS fraction,
round(w / (e - s), 6) AS mean_value FROM a LEFT JOIN g ON a.event_id = g.event_id""")
def overlap_coverage(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    c = iv.coverage(left.drop("value"), right, "event_id", value="value")
    return c.select("event_id", "n_overlaps", "overlap_bp", _r("fraction").alias("fraction"), _r("mean_value").alias("mean_value"))


@query(f"""WITH {_AB}, p AS (SELECT a.event_id, least(a.e, b.e) - greatest(a.s, b.s) AS bp, CASE WHEN b.event_id % 3 > 0 THEN b.value END AS v FROM a JOIN b ON {_PAIR}),
g AS (SELECT event_id, sum(bp * v) / nullif(sum(CASE WHEN v IS NOT NULL THEN bp END), 0) AS m FROM p GROUP BY event_id)
SELECT a.event_id, round(m, 6) AS mean_value FROM a LEFT JOIN g ON a.event_id = g.event_id""")
def overlap_mean_present(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    right = right.withColumn("value", F.when(F.col("event_id") % 3 > 0, F.col("value")))
    return iv.coverage(left.drop("value"), right, "event_id", value="value", present=True).select("event_id", _r("mean_value").alias("mean_value"))


@query(f"""WITH {_AB}, n AS (SELECT a.event_id, min(least(abs((a.s + a.e) // 2 - b.s), abs((a.s + a.e) // 2 - b.e))) AS d FROM a JOIN b ON a.chrom = b.chrom GROUP BY 1)
SELECT a.event_id, CASE WHEN EXISTS (SELECT 1 FROM b WHERE {_PAIR}) THEN 0 ELSE d END AS distance FROM a LEFT JOIN n ON a.event_id = n.event_id""")
def nearest_interval(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return iv.nearest_interval(left, right, "event_id")


@query(f"""WITH {IV}, a AS (SELECT * FROM iv WHERE event_type = 'view'), p AS (
SELECT a.event_id, b.event_type AS v, min((b.s, b.e, b.event_id)) AS o FROM a JOIN iv b ON {_PAIR} GROUP BY 1, 2),
r AS (SELECT event_id, v, o, row_number() OVER (PARTITION BY event_id ORDER BY o, v) AS n FROM p)
SELECT event_id, string_agg(v, ';' ORDER BY o, v) AS values FROM r WHERE n <= 5 GROUP BY event_id""")
def overlap_values(spark, sf_dir):
    all_ = intervals(spark, sf_dir)
    return iv.collect_values(_kind(all_, "view"), all_, "event_id", "event_type", "event_id").select("event_id", "values")


@query(f"""WITH {IV}, a AS (SELECT event_id, chrom, (s + e) // 2 AS c FROM iv WHERE event_type = 'view'), b AS (SELECT * FROM iv WHERE event_type = 'click'),
r AS (SELECT a.event_id, b.event_id AS near, abs(b.s - c) AS d, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(b.s - c), b.s, b.event_id) AS n
FROM a JOIN b ON a.chrom = b.chrom) SELECT a.event_id, r.near AS nearest, r.d AS distance FROM a LEFT JOIN r ON a.event_id = r.event_id AND n = 1""")
def nearest_point(spark, sf_dir):
    all_ = intervals(spark, sf_dir)
    q = _kind(all_, "view").withColumn("centre", F.expr("(start + end) div 2"))
    return iv.nearest(q, _kind(all_, "click"), "event_id", "centre", "start", "event_id").select("event_id", "nearest", "distance")


@query(f"""WITH {_AB} SELECT a.event_id, a.s - (SELECT max(b.e) FROM b WHERE b.chrom = a.chrom AND b.e <= a.s) AS left_distance,
(SELECT min(b.s) FROM b WHERE b.chrom = a.chrom AND b.s >= a.e) - a.e AS right_distance FROM a""")
def anchor_spacing(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return iv.spacing(left, right, "event_id")


@query(f"""WITH {IV}, t AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN '-' ELSE '+' END AS strand, max(e) OVER (PARTITION BY chrom) AS size FROM iv)
SELECT event_id, CASE WHEN strand = '-' THEN e ELSE s END AS tss, CASE WHEN strand = '-' THEN e ELSE greatest(0, s - 1000) END AS promoter_start,
CASE WHEN strand = '-' THEN e + 1000 ELSE s END AS promoter_end, greatest(0, least(s, size - e)) AS edge, chrom || ':' || (s // 100000) AS block FROM t""")
def promoters_edges_blocks(spark, sf_dir):
    all_ = intervals(spark, sf_dir).withColumn("strand", F.when(F.col("event_id") % 2 == 0, "-").otherwise("+"))
    sizes = all_.groupBy("chrom").agg(F.max("end").alias("size"))
    x = iv.upstream(all_.join(sizes, "chrom"), 1000)
    return x.select("event_id", "tss", "promoter_start", "promoter_end", iv.edge_distance(F.col("size")).alias("edge"), iv.block_id(100000).alias("block"))


_ISLANDS = """o AS (SELECT *, max(e) OVER (PARTITION BY chrom, event_type ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {src}),
f AS (SELECT *, sum(CASE WHEN before IS NULL OR s >= before THEN 1 ELSE 0 END) OVER (PARTITION BY chrom, event_type ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM o)"""


@query(f'WITH {IV}, {_ISLANDS.format(src="iv")} SELECT chrom, event_type, min(s) AS start, max(e) AS "end", count(*) AS n_members FROM f GROUP BY chrom, event_type, k')
def merge_islands(spark, sf_dir):
    return iv.islands(intervals(spark, sf_dir), ["chrom", "event_type"]).select("chrom", "event_type", "start", "end", "n_members")


@query(f"""WITH {IV}, m AS (SELECT chrom, s, e, max(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM iv WHERE event_type = 'purchase'),
k AS (SELECT *, sum(CASE WHEN before IS NULL OR s >= before THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m),
h AS (SELECT chrom, min(s) AS s, max(e) AS e FROM k GROUP BY chrom, k), a AS (SELECT * FROM iv WHERE event_type = 'view'),
b AS (SELECT a.event_id, a.chrom, a.s AS lo, a.e AS hi, h.s, h.e FROM a JOIN h ON a.chrom = h.chrom AND a.s < h.e AND a.e > h.s),
pieces AS (SELECT event_id, chrom, lo AS s, coalesce(min(s), hi) AS e FROM (SELECT * FROM b UNION ALL SELECT event_id, chrom, s, e, NULL, NULL FROM a) GROUP BY event_id, chrom, lo, hi
UNION ALL SELECT event_id, chrom, e, least(hi, coalesce(lead(s) OVER (PARTITION BY event_id ORDER BY s), hi)) FROM b)
SELECT event_id, chrom, s AS start, e AS "end" FROM pieces WHERE s < e""")
def interval_subtract(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return iv.subtract(left, right, "event_id")


@query(f"""WITH {IV}, t AS (SELECT *, (count(*) OVER (PARTITION BY event_type ORDER BY value DESC RANGE UNBOUNDED PRECEDING) + 1) / (count(*) OVER (PARTITION BY event_type) + 1) AS share FROM iv),
{_ISLANDS.format(src="t")}, l AS (SELECT chrom, event_type, min(s) AS s, max(e) AS e, count(*) AS n, least(1.0e0, min(share) * count(*)) AS p FROM f GROUP BY chrom, event_type, k),
r AS (SELECT *, p * count(*) OVER (PARTITION BY event_type) / count(*) OVER (PARTITION BY event_type ORDER BY p RANGE UNBOUNDED PRECEDING) AS raw FROM l)
SELECT chrom, event_type, s AS start, e AS "end", n AS n_members, round(p, 6) AS p,
round(least(1.0e0, min(raw) OVER (PARTITION BY event_type ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 6) AS q FROM r""")
def island_fdr(spark, sf_dir):
    """Flagship: islands of intervals, their least tail share times members, and the false-discovery rate by type."""
    rows = stats.tail_share(intervals(spark, sf_dir), "value", ["event_type"])
    isl = iv.islands(rows, ["chrom", "event_type"], keep=[F.min("tail_share").alias("share")], combine=[F.min("share").alias("share")])
    isl = isl.withColumn("p", F.least(F.lit(1.0), F.col("share") * F.col("n_members")))
    out = stats.bh(isl, "p", ["event_type"])
    return out.select("chrom", "event_type", "start", "end", "n_members", _r("p").alias("p"), _r("q").alias("q"))


# Statistics


@query("""WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1),
d AS (SELECT e.event_type, median(abs(value - m)) AS mad FROM events e JOIN m USING (event_type) GROUP BY 1)
SELECT event_id, round((value - m) / (mad / 0.6745e0), 6) AS z FROM events JOIN m USING (event_type) JOIN d USING (event_type)""")
def robust_zscore(spark, sf_dir):
    z = stats.robust_z(table(spark, sf_dir, "events"), "value", ["event_type"])
    return z.select("event_id", _r("z").alias("z"))


@query("""SELECT event_id, round((count(*) OVER (PARTITION BY event_type ORDER BY value DESC RANGE UNBOUNDED PRECEDING) + 1) / (count(*) OVER (PARTITION BY event_type) + 1), 6) AS tail_share FROM events""")
def empirical_tail(spark, sf_dir):
    t = stats.tail_share(table(spark, sf_dir, "events"), "value", ["event_type"])
    return t.select("event_id", _r("tail_share").alias("tail_share"))


@query("""WITH p AS (SELECT event_id, (count(*) OVER (PARTITION BY event_type ORDER BY value DESC RANGE UNBOUNDED PRECEDING) + 1) / (count(*) OVER (PARTITION BY event_type) + 1) AS p FROM events),
r AS (SELECT *, p * count(*) OVER () / count(*) OVER (ORDER BY p RANGE UNBOUNDED PRECEDING) AS raw FROM p)
SELECT event_id, round(least(1.0e0, min(raw) OVER (ORDER BY p DESC RANGE UNBOUNDED PRECEDING)), 6) AS q FROM r""")
def bh_qvalues(spark, sf_dir):
    t = stats.tail_share(table(spark, sf_dir, "events"), "value", ["event_type"])
    return stats.bh(t, "tail_share").select("event_id", _r("q").alias("q"))


@query("""WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2 AS x,
rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2 AS y FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(corr(x, y), 6) AS rho FROM r GROUP BY 1""")
def spearman_by_group(spark, sf_dir):
    s = stats.spearman(table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return s.select("l_returnflag", "n", _r("rho").alias("rho"))


@query("""SELECT user_id, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY abs(value - 200) DESC, event_id) AS n FROM events) WHERE n = 1""")
def strongest_per_group(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("off", F.col("value") - 200)
    return stats.strongest(e, ["user_id"], "off", "event_id", ["event_id", "value"])


@query("""SELECT user_id, event_id, value, n AS rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS INTEGER) AS n FROM events) WHERE n <= 5""")
def top_k_per_group(spark, sf_dir):
    t = stats.top_k(table(spark, sf_dir, "events"), ["user_id"], [F.desc("value"), F.asc("event_id")], 5)
    return t.select("user_id", "event_id", "value", "rank")


@query("""WITH g AS (SELECT DISTINCT l_returnflag, l_linenumber FROM lineitem)
SELECT g.l_returnflag, g.l_linenumber, count(*) AS n, round(regr_slope(CAST(l_extendedprice AS DOUBLE), CAST(l_quantity AS DOUBLE)), 4) AS slope,
round(regr_intercept(CAST(l_extendedprice AS DOUBLE), CAST(l_quantity AS DOUBLE)), 2) AS intercept
FROM g JOIN lineitem l ON g.l_returnflag = l.l_returnflag AND g.l_linenumber <> l.l_linenumber GROUP BY 1, 2""")
def leave_group_out_line(spark, sf_dir):
    r = stats.leave_group_out_line(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linenumber", "l_quantity", "l_extendedprice")
    return r.select("l_returnflag", "l_linenumber", "n", _r("slope", 4).alias("slope"), _r("intercept", 2).alias("intercept"))


_S = "CAST(l_quantity AS DOUBLE) AS x, CAST(l_discount AS DOUBLE) AS z, CAST(l_extendedprice AS DOUBLE) AS y"


@query(f"""WITH l AS (SELECT l_returnflag, l_linenumber, {_S} FROM lineitem), g AS (SELECT DISTINCT l_returnflag, l_linenumber FROM l),
c AS (SELECT g.l_returnflag, g.l_linenumber, count(*) AS n, var_pop(x) AS xx, var_pop(z) AS zz, covar_pop(x, z) AS xz, covar_pop(x, y) AS xy, covar_pop(z, y) AS zy, avg(x) AS mx, avg(z) AS mz, avg(y) AS my
FROM g JOIN l ON g.l_returnflag = l.l_returnflag AND g.l_linenumber <> l.l_linenumber GROUP BY 1, 2),
b AS (SELECT *, (xy * zz - zy * xz) / (xx * zz - xz * xz) AS bx, (zy * xx - xy * xz) / (xx * zz - xz * xz) AS bz FROM c)
SELECT l_returnflag, l_linenumber, n, round(my - bx * mx - bz * mz, 1) AS intercept, round(bx, 3) AS slope_quantity, round(bz, 0) AS slope_discount FROM b""")
def leave_group_out_plane(spark, sf_dir):
    r = stats.leave_group_out_linear(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_linenumber", ["l_quantity", "l_discount"], "l_extendedprice")
    return r.select("l_returnflag", "l_linenumber", "n", _r("intercept", 1).alias("intercept"), _r(F.get("slopes", 0), 3).alias("slope_quantity"), _r(F.get("slopes", 1), 0).alias("slope_discount"))


@query("SELECT event_id, round((value - avg(value) OVER w) / stddev_samp(value) OVER w, 6) AS z FROM events WINDOW w AS (PARTITION BY event_type)")
def zscore_by_group(spark, sf_dir):
    return stats.zscore(table(spark, sf_dir, "events"), "value", ["event_type"]).select("event_id", _r("z").alias("z"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN CAST(l_discount AS DOUBLE) END AS a, CASE WHEN l_quantity < 40 THEN CAST(l_tax AS DOUBLE) END AS b FROM lineitem)
SELECT l_orderkey, l_linenumber, coalesce(a, b) AS first, round((coalesce(a, 0) + coalesce(b, 0)) / ((a IS NOT NULL)::INT + (b IS NOT NULL)::INT), 6) AS mean, greatest(a, b) AS most FROM l""")
def finite_row_summary(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    a, b = F.when(F.col("l_quantity") > 25, F.col("l_discount").cast("double")).otherwise(float("nan")), F.when(F.col("l_quantity") < 40, F.col("l_tax").cast("double"))
    return li.select("l_orderkey", "l_linenumber", stats.first_finite(a, b).alias("first"), _r(stats.finite_mean(a, b)).alias("mean"), stats.finite_max(a, b).alias("most"))


@query("SELECT event_type, round(avg(CASE WHEN value > 250 THEN 1.0e0 ELSE 0.0e0 END), 6) AS share, count(value) AS n FROM events GROUP BY 1")
def share_above(spark, sf_dir):
    s = stats.share_above(table(spark, sf_dir, "events"), ["event_type"], "value", 250)
    return s.select("event_type", _r("share").alias("share"), "n")


@query("SELECT user_id, count(value) AS n, round(avg(value), 6) AS mean, round(var_samp(value), 4) AS variance, round(sqrt(var_samp(value)) / avg(value), 6) AS cv FROM events GROUP BY 1")
def dispersion(spark, sf_dir):
    d = stats.dispersion(table(spark, sf_dir, "events"), ["user_id"], "value")
    return d.select("user_id", "n", _r("mean").alias("mean"), _r("variance", 4).alias("variance"), _r("cv").alias("cv"))


@query("SELECT l_suppkey, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean FROM lineitem GROUP BY 1")
def weighted_mean(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumns({"d": F.col("l_discount").cast("double"), "q": F.col("l_quantity").cast("double")})
    return stats.weighted_mean(li, ["l_suppkey"], "d", "q").select("l_suppkey", _r("mean").alias("mean"))


@query("""SELECT user_id, round(avg(value) FILTER (event_type = 'purchase'), 6) AS case_mean, round(avg(value) FILTER (event_type <> 'purchase'), 6) AS other_mean,
round((avg(value) FILTER (event_type = 'purchase') - avg(value) FILTER (event_type <> 'purchase')) / stddev_samp(value), 6) AS shift FROM events GROUP BY 1""")
def pooled_shift(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("hit", F.col("event_type") == "purchase")
    s = stats.pooled_shift(e, ["user_id"], "value", "hit")
    return s.select("user_id", *[_r(c).alias(c) for c in ("case_mean", "other_mean", "shift")])


_SD = "(SELECT stddev_samp(p_size) AS a, stddev_samp(CAST(p_retailprice AS DOUBLE)) AS b FROM part)"


@query(f"""WITH d AS (SELECT x.p_partkey, y.p_partkey AS control,
round(abs(x.p_size - y.p_size) / a + abs(CAST(x.p_retailprice AS DOUBLE) - CAST(y.p_retailprice AS DOUBLE)) / b, 9) AS distance
FROM part x JOIN part y ON x.p_type = y.p_type AND x.p_brand <> y.p_brand, {_SD} s),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY distance, control) AS INTEGER) AS rank FROM d)
SELECT p_partkey, control, round(distance, 6) AS distance, rank FROM r WHERE rank <= 5""")
def matched_controls(spark, sf_dir):
    p = table(spark, sf_dir, "part").withColumn("price", F.col("p_retailprice").cast("double"))
    c = stats.matched_controls(p, "p_partkey", "p_brand", ["p_type"], ["p_size", "price"], 5)
    return c.select("p_partkey", "control", _r("distance").alias("distance"), "rank")


@query("""SELECT l_orderkey, l_linenumber, name, value FROM (SELECT l_orderkey, l_linenumber, CAST(l_discount AS DOUBLE) AS discount, CAST(l_tax AS DOUBLE) AS tax FROM lineitem)
UNPIVOT (value FOR name IN (discount, tax))""")
def wide_to_long(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").cast("double").alias("discount"), F.col("l_tax").cast("double").alias("tax"))
    return li.unpivot(["l_orderkey", "l_linenumber"], ["discount", "tax"], "name", "value")


@query("""WITH w AS (SELECT event_type, value, unnest([time_bucket(INTERVAL 30 MINUTES, ts), time_bucket(INTERVAL 30 MINUTES, ts) - INTERVAL 30 MINUTES]) AS s FROM events)
SELECT epoch_us(s) // 1000000 AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY 1, 2""")
def sliding_counts(spark, sf_dir):
    """An extension beyond the interval operators: windows on the time axis; the same code runs on a stream."""
    s = sliding.sliding_counts(table(spark, sf_dir, "events"))
    return s.select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "n", _r("total", 4).alias("total"))


@query("""WITH r AS (SELECT event_type, abs(value - 200) AS a, row_number() OVER (PARTITION BY event_type ORDER BY abs(value - 200)) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, round(max(a) FILTER (k = least(n, CAST(ceil((n + 1) * 0.95e0) AS BIGINT))), 6) AS half_width, max(n) AS n FROM r GROUP BY 1""")
def conformal_width(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("off", F.col("value") - 200)
    return stats.split_conformal(e, "off", ["event_type"]).select("event_type", _r("half_width").alias("half_width"), "n")


@query("""SELECT CAST(least(19, floor((value - 0) / 25.0e0)) AS INTEGER) AS bin, count(*) AS n FROM events WHERE value BETWEEN 0 AND 500 GROUP BY 1""")
def value_histogram(spark, sf_dir):
    return stats.histogram(table(spark, sf_dir, "events"), "value", 0.0, 500.0, 20)


@query()
def block_bootstrap(spark, sf_dir):
    """Mean of user means by event type with a bootstrap interval over users."""
    return stats.block_bootstrap(table(spark, sf_dir, "events"), ["event_type"], "user_id", "value")
