import random

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as C
from spanloom.llm import queries
from spanloom.llm.common import BATCH_BYTES, durable, map_arrow, small_batches

from .test_dedup import brute_components
from .test_text import plain_overlaps

SF = "/root/testdata/sf0.001"


def plain_pipeline(docs, items):
    rows = [r for r in docs if r[1] and any(c.isalpha() for c in r[1])]
    keep = {}
    for i, t in rows:
        keep[t] = max(i, keep.get(t, i))
    rows = [(i, t) for i, t in rows if keep[t] == i]
    comp, _ = brute_components(rows, 5)
    rows = [(i, t) for i, t in rows if comp[i] == i]
    words = [(i, t) for i, t in items]
    leaks = {d for d, _ in plain_overlaps([(i, t) for i, t in rows if len(t) < 1200], words)}
    return rows, leaks


def test_pipeline_equals_brute_force(spark):
    import base64

    import public_tokenizers as P
    import tiktoken

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()
    rows, leaks = plain_pipeline([tuple(r) for r in docs], [tuple(r) for r in items][:8])
    got = {r["doc_id"]: r for r in C.run(spark, SF).collect()}
    assert set(got) <= {i for i, _ in rows} and not set(got) & leaks
    lower = [t.lower().replace("\n", " ") for _, t in items]
    whole = {i for i, t in rows if any(q in t.lower().replace("\n", " ") for q in lower)}
    assert whole and not set(got) & whole
    assert {i for i, _ in rows} - set(got) == whole | ({i for i, _ in rows} - set(got)) and len(got) >= len(rows) - len(whole) - 3
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(C.TOKENIZER), "rb"))}
    want = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for i, t in rows:
        if i in got:
            assert list(got[i]["ids"]) == want.encode_ordinary(t) and got[i]["n_tokens"] == len(got[i]["ids"]) and got[i]["round_trip"]


def test_pipeline_keeps_exactly_what_brute_force_keeps(spark, tmp_path):
    rng, words = random.Random(8), [f"t{i}" for i in range(400)]
    some = lambda n: [rng.choice(words) for _ in range(n)]
    items = [(i, some(18)) for i in range(6)]
    texts = [some(n) for n in (1, 3, 12, 30, 60, 90, 350) for _ in range(3)]
    for i, q in items:
        wrong = lambda part, at: ["zz" if k in at else w for k, w in enumerate(part)]
        leaks = [q, q[i : i + 12], q[:13], wrong(q[:15], (2, 5, 7)), wrong(q[:15], (1, 5, 7, 11)), wrong(q, rng.sample(range(18), 3))]
        texts += [some(rng.choice((4, 40))) + part + some(rng.choice((4, 40))) for part in leaks]
        texts += [some(330) + wrong(q[3:], (2, 5, 7)) + some(40), some(330) + q[:12] + some(40)]
    texts += [wrong(t, (40,)) for t in texts if len(t) > 80] + rng.sample(texts, 6)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, "12 !")]
    spark.createDataFrame([(*r, "en", "s", len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    items = [(i, " ".join(q)) for i, q in items]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left, _ = plain_pipeline(rows, [])
    leaks = {d for d, _ in plain_overlaps(left, items)}
    assert 10 < len(leaks) < len(left) - 10 and len(left) < len(rows) - 10
    assert sorted(r["doc_id"] for r in C.run(spark, str(tmp_path)).select("doc_id").collect()) == sorted({i for i, _ in left} - leaks)


@pytest.mark.parametrize("k", range(4))
def test_stage_edge_cases(spark, tmp_path, k):
    item = " ".join(f"bench{i}" for i in range(20))
    for sub in ("full", "none"):
        spark.createDataFrame([(1, item)] if sub == "full" else [], "item_id long, text string").write.parquet(str(tmp_path / sub / "benchmark.parquet"))
    schema = "doc_id long, text string, lang string, source string, n_chars long, _gone int, _id string, _sha int, lang_pred string, score int, text_hash int"
    base = [(1, "the cat sat on the mat and slept", "en"), (2, None, None), (3, "", "en"), (4, "12 34 !", None), (None, "null id text here in words", "en"), (7, "y " * 60_000, "en"), (8, f"x {item} y", "en"), (9, "le chat dort", "fr"), (9, "le chat dort", "fr")]
    docs = spark.createDataFrame([(*r, None, None, 1, "i", 2, "p", 3, 4) for r in base], schema)
    name, stage = C.STAGES[k]
    out = stage(spark, docs, str(tmp_path / "full"))
    assert out.columns == docs.columns
    ids = sorted(str(r["doc_id"]) for r in out.collect())
    want = {
        "language": ["1", "7", "8", "9", "9", "None"],
        "exact_dedup": ["1", "3", "4", "7", "8", "9", "None"],
        "near_dedup": ["1", "2", "3", "4", "7", "8", "9", "9", "None"],
        "benchmark_leaks": ["1", "2", "3", "4", "7", "9", "9", "None"],
    }[name]
    assert ids == want
    assert stage(spark, docs.limit(0), str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("label", [None, "und"])
def test_language_stage_keeps_texts_without_a_model(spark, label):
    rows = [(1, "the cat sat on the mat", label), (2, None, label), (3, "", label), (4, "12 !", label), (None, "le chat dort", label), (5, "x", label), (5, "漢字", label)]
    out = C.language(spark, spark.createDataFrame(rows, "doc_id long, text string, lang string"), "").collect()
    assert sorted(r["text"] for r in out) == sorted(r[1] for r in rows if r[0] not in (2, 3, 4))


def test_token_stage_edge_cases(spark):
    docs = spark.createDataFrame([(1, "a b", 1), (None, None, 2), (3, "", 3)], "doc_id long, text string, ids int")
    got = {r["doc_id"]: r for r in C.tokens(spark, docs, "").collect()}
    assert got[1]["n_tokens"] == 2 and got[None]["n_tokens"] == 0 and got[3]["ids"] == [] and all(r["round_trip"] for r in got.values())
    assert C.tokens(spark, docs.limit(0), "").count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), c.execute(queries.ORACLE_SQL[name]).df()
    plain = lambda d: sorted(map(str, d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).values.tolist()))
    assert sorted(got.columns) == sorted(want.columns) and plain(got) == plain(want)


def test_stages_tell_rows_by_id_and_text(spark, tmp_path):
    rng = random.Random(3)
    some = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    base, item = some(80), " ".join(f"bench{i}" for i in range(20))
    near = [base, base.replace(base.split()[40], "zz"), base + " end"]
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(3, near[0]), (5, near[1]), (5, "a clean text of its own"), (None, near[2]), (None, "another text without an id"), (7, f"so {item} ends"), (7, "clean beside a leak"), (None, f"null {item} {some(30)}")]
    docs = spark.createDataFrame([(*r, "en", 1) for r in rows], "doc_id long, text string, lang string, _key int")
    kept = C.near_dedup(spark, docs, str(tmp_path))
    texts = [r["text"] for r in kept.collect()]
    assert kept.columns == docs.columns and sum(t in near for t in texts) == 1 and len(texts) == len(rows) - 2
    clean = [r["text"] for r in C.benchmark_leaks(spark, docs, str(tmp_path)).collect()]
    assert sorted(clean) == sorted(t for _, t in rows if "bench1" not in t)


ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_pipeline_sends_texts_to_python_in_small_batches(spark):
    """On 0.51 GB whole partitions went as one batch, which executors held several times beside their heap."""
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64()), pa.array([b.num_rows], pa.int64())], ["size", "n"])

    docs = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("a"), 1 << 20).alias("text"))
    state = lambda: (spark.conf.get(ARROW_BYTES), spark._jsparkSession.conf().contains(ARROW_BYTES))
    before = state()
    got = durable(docs.mapInArrow(sizes, "size long, n long"), "sizes").collect()
    assert sum(r["n"] for r in got) == 40 and max(r["size"] for r in got) <= BATCH_BYTES + (2 << 20)
    assert state() == before
    for own, most in (("1000000", 3 << 20), ("99999999", BATCH_BYTES + (2 << 20))):
        spark.conf.set(ARROW_BYTES, own)
        try:
            with small_batches(spark):
                got = durable(docs.mapInArrow(sizes, "size long, n long"), "sizes").collect()
            assert max(r["size"] for r in got) <= most and sum(r["n"] for r in got) == 40 and spark.conf.get(ARROW_BYTES) == own
        finally:
            spark.conf.unset(ARROW_BYTES)
    with pytest.raises(Exception):
        durable(docs.select(F.raise_error(F.lit("no")).alias("x")), "fails")
    assert state() == before


def test_workers_let_go_of_the_vocabulary_once_other_work_comes(spark):
    """The tokens' codec, some 100 MB, stayed in the workers while later stages ran."""
    import public_tokenizers as P
    import pyarrow as pa

    from spanloom.llm.bpe import encode_texts, load_ranks

    def alive(batches):
        import gc

        for b in batches:
            n = sum(type(o).__name__ == "ByteBPE" for o in gc.get_objects())
            yield pa.RecordBatch.from_arrays([pa.array([n] * b.num_rows, pa.int64())], ["n"])

    docs = spark.range(0, 64, 1, 8).select(F.lit("some text").alias("text"))
    coded = encode_texts(docs, load_ranks(P.path(C.TOKENIZER)), P.PATTERN)
    assert len(coded.collect()) == 64
    assert {r["n"] for r in map_arrow(docs, alive, "n long").collect()} == {0}
