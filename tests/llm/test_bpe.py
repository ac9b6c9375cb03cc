import base64
import time

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanloom.llm.bpe import ByteBPE, decode_ids, encode_texts, load_ranks

VOCABULARY = load_ranks(P.path("byte_bpe_50k.tiktoken"))
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, VOCABULARY.splitlines())}
WANT = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
BPE = ByteBPE(VOCABULARY, P.PATTERN)


def ids(text):
    packed = BPE.encode(text)
    return [int.from_bytes(packed[i : i + 4], "little") for i in range(0, len(packed), 4)]


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="aab th er\n", max_size=200))
def test_equals_the_library_and_round_trips(text):
    assert ids(text) == WANT.encode_ordinary(text)
    assert BPE.decode(BPE.encode(text)) == text.encode("utf-8")


def test_long_pre_tokens():
    for text in ("a" * 5000, "thethe" * 3000, "x<|endoftext|>y", "é" * 4000, " " * 3000 + "a"):
        assert ids(text) == WANT.encode_ordinary(text)
    began = time.time()
    text = "".join(chr(97 + i * i % 26) for i in range(300_000))
    assert BPE.decode(BPE.encode(text)) == text.encode()
    assert time.time() - began < 30


def test_frames(spark):
    rows = [(1, "hello  world", 3), (2, None, 4), (3, "", None), (1, "hello  world", 3), (None, "ß\n\n!!", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded_ long")
    coded = decode_ids(encode_texts(df, VOCABULARY, P.PATTERN), VOCABULARY, P.PATTERN)
    assert coded.columns == ["doc_id", "decoded_", "ids", "decoded"]
    got = coded.withColumn("t", F.col("decoded").cast("string")).collect()
    assert sorted((r["t"], str(r["doc_id"])) for r in got) == sorted((t or "", str(i)) for i, t, _ in rows)
    both = encode_texts(df, VOCABULARY, P.PATTERN, decoded_col="decoded", packed=False).withColumn("t", F.col("decoded").cast("string")).collect()
    assert len(both) == len(rows) and all(list(r["ids"]) == WANT.encode_ordinary(r["t"]) for r in both)
    assert encode_texts(df.limit(0), VOCABULARY, P.PATTERN, packed=False).count() == 0


def test_frames_with_long_texts_clashing_names_and_nothing(spark):
    long = "word " * 40_000 + "é" * 30_000 + "a" * 30_000
    df = spark.createDataFrame([(1, long, "old", 7), (1, long, "old", 7), (2, None, None, None)], "doc_id long, text string, IDS string, decoded int")
    coded = encode_texts(df, VOCABULARY, P.PATTERN)
    assert coded.columns == ["doc_id", "decoded", "ids"]
    got = decode_ids(coded, VOCABULARY, P.PATTERN)
    assert got.columns == ["doc_id", "ids", "decoded"]
    assert sorted(bytes(r["decoded"]).decode() for r in got.collect()) == sorted([long, long, ""])
    place = decode_ids(coded.select("doc_id", F.when(F.col("doc_id") == 1, F.col("ids")).alias("ids")), VOCABULARY, P.PATTERN, out_col="ids")
    assert place.columns == ["doc_id", "ids"] and sorted(len(r["ids"]) for r in place.collect()) == sorted([0] + [len(long.encode())] * 2)
    for packed in (True, False):
        none = encode_texts(df.limit(0), VOCABULARY, P.PATTERN, decoded_col="decoded", packed=packed)
        assert none.columns == ["doc_id", "ids", "decoded"] and none.count() == 0


def test_query_equals_tiktoken(spark):
    import base64
    import hashlib

    import public_tokenizers as P
    import tiktoken

    from spanloom.llm.queries import op9_byte_bpe

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op9_byte_bpe(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = plain.encode_ordinary(texts[r["doc_id"]])
        packed = b"".join(i.to_bytes(4, "little") for i in ids)
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(packed).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()
