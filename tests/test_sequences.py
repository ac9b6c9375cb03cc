import math
import random
import zlib
from collections import Counter

import duckdb
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spanloom.functions import arrays
from spanloom.functions import sequence as seq
from spanloom.plans import catalogue


@pytest.fixture(scope="module")
def one(spark):
    rows = [(1, "ACGTACGTNN"), (2, ""), (3, "GGGGGAATTC"), (4, None)]
    return spark.createDataFrame(rows, "id long, s string").cache()


def value(df, c):
    return {r["id"]: r["v"] for r in df.select("id", c.alias("v")).collect()}


def test_composition(one):
    s = F.col("s")
    assert value(one, seq.gc_content(s)) == {1: 0.5, 2: None, 3: 0.6, 4: None}
    assert value(one, seq.n_fraction(s))[1] == 0.2 and value(one, seq.n_fraction(s))[2] == 1.0
    assert value(one, seq.shannon_entropy(s))[1] == pytest.approx(2.0)
    assert value(one, seq.reverse_complement(s))[1] == "NNACGTACGT"
    assert value(one, seq.longest_run(s))[3] == 5 and value(one, seq.longest_run(s))[2] == 0
    assert value(one, seq.homopolymer_fraction(s))[3] == 0.5
    assert value(one, seq.extract(s, F.lit(-2), F.lit(3)))[1] == "ACG"


@pytest.mark.parametrize("k", [1, 2, 3, 5])
def test_kmers_equal_a_loop(spark, k):
    text = "ACGTNACCGTTGACAACGT"
    df = spark.createDataFrame([(1, text), (2, "A")], "id long, s string")
    got = {(r["id"], r["kmer"]): r["n"] for r in seq.kmer_counts(df, "id", "s", k).collect()}
    want = {}
    for i, t in ((1, text), (2, "A")):
        for j in range(len(t) - k + 1):
            if "N" not in t[j : j + k]:
                want[i, t[j : j + k]] = want.get((i, t[j : j + k]), 0) + 1
    assert got == want


def test_measures(spark):
    df = spark.createDataFrame([(1, "ACGT" * 60), (2, ""), (3, None)], "id long, s string")
    got = {r["id"]: r["m"] for r in df.select("id", arrays.measures("s").alias("m")).collect()}
    assert got[1]["acf_lag"] is not None and abs(got[1]["acf"]) > 0.9 and got[2]["lz78_phrases"] == 0
    assert arrays.lz78_phrases("AAAA") == 3 and arrays.palindrome_density("ACGT", (4,)) == 1.0


def test_surrogates_keep_length_and_composition():
    s = "ACGGTTTA" * 9
    assert sorted(arrays.shuffled(s, 1)) == sorted(s) and len(arrays.markov(s, 1)) == len(s)
    assert arrays.shuffled(s, 5, 3) == arrays.shuffled(s, 5, 3)


def test_composition_step_equals_a_loop(spark):
    rows = [(1, "A" * 10 + "C" * 10 + "CCCCCGGGGG"), (2, "ACGT" * 3), (3, "ACG"), (4, None), (5, ""), (6, "ACGTN" * 20 + "G" * 33)]
    got = {r["id"]: (r["step"], r["at"]) for r in seq.composition_step(spark.createDataFrame(rows, "id long, s string"), "id", "s", 10).collect()}
    want = {}
    for i, s in rows:
        parts = [s[j : j + 10] for j in range(0, len(s) - 9, 10)] if s else []
        steps = [sum(((a.count(b) - c.count(b)) / 10) ** 2 for b in "ACGT") ** 0.5 for a, c in zip(parts, parts[1:])]
        if parts:
            want[i] = (pytest.approx(max(steps)), 10 * (1 + steps.index(max(steps)))) if steps else (None, None)
    assert got == want


def test_compression_z(spark):
    plain, mixed = "ACGTTGCA" * 60, arrays.markov("ACGTTGCAATTGCCGA" * 30, 5)
    rows = [(1, plain), (2, mixed), (3, "ACGT"), (4, None), (5, ""), (6, "A" * 40)]
    df = spark.createDataFrame(rows, "id long, s string").select("id", arrays.compression_z()("s").alias("c")).select("id", "c.*")
    got = {r["id"]: r for r in df.collect()}
    assert got[1]["gzip_pairs_z"] > 3 and got[1]["agree"] and abs(got[2]["gzip_pairs_z"]) < got[1]["gzip_pairs_z"]
    assert got[1]["gzip_pairs_z"] == pytest.approx(arrays.ratio_z(plain, "gzip", "pairs"))
    assert all(v is None for i in (3, 4, 5, 6) for n, v in got[i].asDict().items() if n != "id")


#: Texts with a share whose rounding is a half, an empty and a null sequence, and sequences shorter than words.
ODD = [(1, "bc" * 41 + "a" * 559), (2, None), (3, "123"), (4, "b"), (5, "bc"), (6, "bca"), (7, "abcd" * 30), (8, "c" * 3), (9, "Żółw bc bc")]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(i, t, "s") for i, t in ODD], "doc_id long, text string, source string").write.parquet(f"{at}/documents.parquet")
    return at


def same_as_sql(spark, at, name):
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{at}/documents.parquet/*.parquet')")
    want = c.execute(catalogue.ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    rows = lambda found: sorted((tuple(r) for r in found), key=repr)
    assert rows(catalogue.QUERIES[name](spark, at).select(*columns).collect()) == rows(want.fetchall())


@pytest.mark.parametrize("name", ["surrogate_invariants", "seq_composition"])
def test_odd_texts_equal_sql(spark, odd, name):
    same_as_sql(spark, odd, name)


class _Frame:
    """A DataFrame that hands the batches to what ``mapInArrow`` is given."""

    columns, schema = ["id", "s"], T.StructType([T.StructField("id", T.LongType()), T.StructField("s", T.StringType())])

    def select(self, *_):
        return self

    def mapInArrow(self, run, shape):
        return run


def test_surrogates_come_in_small_batches():
    texts = ["ACGT" * 25_000, None, *["GATTACA" * 3000] * 40]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "s": texts})
    found = list(arrays.surrogate_rows(_Frame(), "s", 2, kinds=("shuffle", "reverse"))([batch]))
    assert max(b.nbytes for b in found) < 6 << 20 and sum(b.num_rows for b in found) == 4 * len(texts)
    rows = [r for b in found for r in b.to_pylist()]
    assert [r["sequence"] for r in rows if r["id"] == 1] == [None] * 4
    own = zlib.crc32(texts[5].encode()) + 4099
    assert [(r["kind"], r["replicate"], r["sequence"]) for r in rows if r["id"] == 5][1] == ("shuffle", 1, arrays.shuffled(texts[5], own + 1013))


def test_words_equal_a_loop(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, None, 4]), "".join(rng.choice(a) for _ in range(rng.choice([0, 2, 3, 40])))) for a in ("ACGT", "ACGTN", "ACxé", "AżÓ" + "😀") for _ in range(100)] + [(9, None), (8, "AC"), (7, "NNNNN")]
    df = spark.createDataFrame(rows, "id long, s string").repartition(3)
    for k in (1, 3, 9):
        want = Counter((i, s[j : j + k]) for i, s in rows if s for j in range(len(s) - k + 1) if "N" not in s[j : j + k])
        assert {(r["id"], r["kmer"]): r["n"] for r in seq.kmer_counts(df, "id", "s", k).collect()} == want
    pairs = Counter((i, s[j], s[j + 2]) for i, s in rows if s for j in range(len(s) - 2))
    got = {r["id"]: r["bits"] for r in seq.mutual_information(df, "id", "s", 2).collect()}
    for i in {i for i, _, _ in pairs}:
        own = {(x, y): n for (j, x, y), n in pairs.items() if j == i}
        t, nx, ny = sum(own.values()), Counter(), Counter()
        for (x, y), n in own.items():
            nx[x], ny[y] = nx[x] + n, ny[y] + n
        assert got.pop(i) == pytest.approx(sum(n / t * math.log2(n * t / (nx[x] * ny[y])) for (x, y), n in own.items()))
    assert not got


PER_TEXT = ["kmer_graph_k3", "mutual_information_lag7", "conditional_entropy_k2", "strand_asymmetry_k3", "kmer_profile_k4", "half_distance_k3"]


@pytest.mark.parametrize("name", PER_TEXT)
def test_words_of_a_text_are_no_rows(spark, odd, name):
    """No hash table and no shuffle has a row a word of a text."""
    plan = catalogue.QUERIES[name](spark, odd)._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" not in plan and "Generate" not in plan
    same_as_sql(spark, odd, name)


def test_measures_equal_loops(monkeypatch):
    """Scales are gone through once, not once a moment, and the figures are those of plain loops."""
    scales, plain = [], arrays.fluctuations
    monkeypatch.setattr(arrays, "fluctuations", lambda y, n: (scales.append(n), plain(y, n))[1])
    rng = random.Random(4)
    texts = ["ACGTN" * 9, "A" * 40, "AT" * 30 + "G", "ACG"] + ["".join(rng.choice(a) for _ in range(n)) for a in ("ACGT", "AATN", "ACé") for n in (30, 600)]
    got = arrays.measures.func(pd.Series(texts))
    assert max(Counter(scales).values()) <= len(texts) and len(scales) <= 10 * len(texts)
    for s, m in zip(texts, got.to_dict("records")):
        turned = s.translate(str.maketrans("ACGTN", "TGCAN"))
        words = [(i, w) for w in range(4, 13) for i in range(len(s) - w + 1)]
        want = sum(s[i : i + w] == turned[i : i + w][::-1] for i, w in words) / len(words) if words else None
        assert (m["palindrome_density"] == pytest.approx(want)) if words else m["palindrome_density"] != m["palindrome_density"]
        x = [1 if c in "GC" else -1 if c in "AT" else 0 for c in s]
        x = [v - sum(x) / len(x) for v in x]
        best = None
        for lag in range(1, min(200, len(x) - 2) + 1):
            a, b = x[:-lag], x[lag:]
            norm = (sum(v * v for v in a) * sum(v * v for v in b)) ** 0.5
            r = sum(v * w for v, w in zip(a, b)) / norm if norm > 1e-6 else None
            if r is not None and (best is None or abs(r) > abs(best[1]) + 1e-12):
                best = (lag, r)
        assert best is None and m["acf"] != m["acf"] or (m["acf_lag"], m["acf"]) == (best[0], pytest.approx(best[1]))
        phrase, seen, n = "", set(), 0
        for c in s:
            phrase += c
            if phrase not in seen:
                seen.add(phrase)
                phrase, n = "", n + 1
        assert (m["lz78_rate"], m["lz78_phrases"]) == (n / len(s), n + bool(phrase))


def test_a_surrogate_is_made_once_for_all_codecs(monkeypatch):
    made, plain = [], arrays._path
    monkeypatch.setattr(arrays, "_path", lambda *a: (made.append(1), plain(*a))[1])
    s = arrays.markov("ACGTTGCAATTGCCGA" * 5, 5)
    got = arrays.compression_z().func(pd.Series([s, None]))
    assert len(made) == 4  # replicates, of kind "pairs"
    assert got["bz2_blocks3_z"][0] == pytest.approx(arrays.ratio_z(s, "bz2", "blocks3")) and got["agree"].isna()[1]
