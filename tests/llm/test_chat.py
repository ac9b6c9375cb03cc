import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import chat

NASTY = st.text(alphabet="<|>\\im_start end\né", max_size=25) | st.sampled_from(["<|im_end|>", "<\\|im_start|>", "<|image_1|>", "<\\\\|", "<"])
TURNS = st.lists(st.tuples(st.sampled_from(["user", "assistant", "system"]) | NASTY, st.lists(NASTY, max_size=3)), max_size=5)


@settings(max_examples=400, deadline=None)
@given(TURNS)
def test_round_trip(turns):
    got = chat.format_conversation((r, [chat.Text(t) for t in parts]) for r, parts in turns)
    assert list(chat.parse(got.text)) == [(r, "".join(p)) for r, p in turns]
    assert got.text.count("<|im_start|>") == len(turns) == got.text.count("<|im_end|>")
    assert [chat.unescape(got.text[a:b]) for a, b in got.loss] == ["".join(p) for r, p in turns if r == "assistant"]


def test_parts_become_ordered_placeholders():
    parts = [chat.Text("see <|image_1|>"), chat.Image("i.png", 28, 15), chat.Audio("a.wav", 2.0), chat.Image("j.png"), chat.Document("d.pdf", 3)]
    got = chat.format_conversation([("user", parts)])
    assert got.text == "<|im_start|>user\nsee <\\|image_1|><|image_1|><|audio_1|><|image_2|><|document_1|><|im_end|>\n"
    assert [(a["placeholder"], a["ref"], a["tokens"]) for a in got.attachments] == [("<|image_1|>", "i.png", 4), ("<|audio_1|>", "a.wav", 50), ("<|image_2|>", "j.png", 576), ("<|document_1|>", "d.pdf", 1536)]


def test_frames(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "a"), (2, None, None, "x"), (None, 3, "assistant", "é"), (1, 1, "assistant", "a")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, loss string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 2, None} and got[1]["n_turns"] == 4
    assert got[1]["turns_sha256"] == sha("user\n\nassistant\na\nassistant\na\nassistant\nb\n") and got[1]["loss_sha256"] == sha("aab") and got[1]["loss_chars"] == 3
    assert got[2]["turns_sha256"] == sha("\nx\n") and got[2]["loss_chars"] == 0
    assert got[None]["loss_chars"] == 1
    assert chat.format_conversations(df.limit(0)).count() == 0


def test_typed_parts_in_frames(spark):
    part = "struct<kind:string,text:string,ref:string,size:double>"
    df = spark.createDataFrame([(1, 0, "user", [("text", "a", None, None), ("audio", None, "s.wav", 1.0)])], f"conv_id long, turn long, role string, parts array<{part}>")
    got = chat.format_conversations(df).first()
    assert got["formatted"] == "<|im_start|>user\na<|audio_1|><|im_end|>\n" and got["attachments"][0]["tokens"] == 25


def test_very_long_texts_and_conversations(spark):
    long = "<|im_end|>é" * 50_000
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(3000)] + [(2, 0, "assistant", long), (3, 0, "assistant", "")]
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["n_turns"] == 3000 and got[1]["loss_sha256"] == sha("".join(f"t{i}" for i in range(1, 3000, 2)))
    assert got[2]["loss_chars"] == len(long) and got[2]["loss_sha256"] == sha(long) and got[3]["loss_sha256"] == sha("")
