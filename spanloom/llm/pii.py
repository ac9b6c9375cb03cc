"""Personal data by bootstrapped contextual extraction.

1. One scan finds the base entities of four kinds by their formats, and every other candidate: a token that looks like
   an identifier (five characters or more, with a digit or an at sign), or a run of digit groups that together have the
   shape of a kind. Each has four lexical patterns: the two words before, the one before, the one before with the one
   after, and the two after.
2. Base entities are seeds. Spark scores the graph of patterns and instances (texts of candidates) by turns: a pattern is
   as reliable as the share of its occurrences that are trusted, smoothed by ``PRIOR`` that are not; it is good from
   ``SUPPORT`` distinct trusted instances and reliability ``CONFIDENT`` on. An instance of a good pattern is trusted by
   that reliability, in all its patterns, so what was found induces further patterns. Turns end when no pattern is new.
3. Good patterns mark the other candidates in their context as new entities, if their shape is one that the kind could have.

Patterns with fewer than ``SUPPORT`` distinct instances can never be good and leave the graph first. Occurrences are
counted before a shuffle, and good patterns and what they reach are broadcast where few, so frequent contexts cost a row
a task. Spans are code points, end exclusive. Base matches are leftmost and do not overlap within a kind; a match that
fails its check is dropped. Added spans never overlap base ones and never remove one; of several kinds the most reliable
wins, then the first as listed. A null text counts as empty; an empty table gives an empty result. Texts, words and
candidates of any length are read whole. Each input row gives a row, also where ids are null or repeat; other columns
pass unread, whatever their names.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, durable, map_arrow

KINDS = ("email", "ip", "card", "phone")
SUPPORT = 5
CONFIDENT = 0.6
PRIOR = 2.0
#: Characters to either side that are looked at first; more where they hold too few words.
NEARBY = 80

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A number that fails from its first digit fails from any other, so only first digits are tried.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"\S+")
_REST = re.compile(r"\S*")
_DIGIT = re.compile(r"[0-9]")
_MAYBE = re.compile(r"[0-9@]")
_GROUPS = re.compile(r"[(+]?[0-9][0-9()+./-]*(?:\x20[(]?[0-9][0-9()+./-]*)*")
_EDGE = "\"'()[]{}<>,;:!?.`*"


def _emails(text: str):
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            done = m.end()
            yield start, done
        at = text.find("@", m.end() if m else at + 1)


def _luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (doubled + sum(int(c) for c in digits[::-2])) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of the kind, end) of every base entity, in order."""
    out = [(s, 0, e) for s, e in _emails(text)]
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() <= 37 and 12 <= len(d := _digits(m[0])) <= 19 and _luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _before(text: str, at: int) -> list[str]:
    """The two words before, ``^`` in place of those that the text's start cuts off."""
    span = NEARBY
    while True:
        part = text[max(0, at - span) : at].split()
        if len(part) > 2 or span >= at:  # the first of three may be a part of a word
            return (["^", "^"] + part)[-2:]
        span *= 4


def _after(text: str, at: int) -> list[str]:
    """The two words after, ``$`` beyond the text's end; what is left of the token itself is passed over."""
    m = _REST.match(text, at)
    at, span = m.end(), NEARBY
    while True:
        part = text[at : at + span].split()
        if len(part) > 2 or at + span >= len(text):
            return (part + ["$", "$"])[:2]
        span *= 4


def contexts(text: str, start: int, end: int) -> list[str]:
    """The four lexical patterns of a place, lower-cased, digits as 0."""
    (a, b), (c, d) = _before(text, start), _after(text, end)
    return [_DIGIT.sub("0", x.lower()) for x in (f"{a} {b} _", f"{b} _", f"{b} _ {c}", f"_ {c} {d}")]


def _could_be(value: str) -> int:
    """Bits of the kinds whose shape the token could have."""
    d = len(_digits(value))
    plain = all(c in "0123456789 ().-+/" for c in value)
    return ("@" in value) | (plain and value.count(".") == 3 and d <= 12) << 1 | (plain and 12 <= d <= 19) << 2 | (plain and 7 <= d <= 15) << 3


SCANNED = (
    "row long, doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
    "base array<struct<start:long,kind:int,end:long>>, "
    "seeds array<struct<kind:int,ctx:array<string>,value:string>>, "
    "others array<struct<start:long,end:long,ctx:array<string>,value:string,shapes:int>>"
)
_BASE_T = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_SEED_T = pa.list_(pa.struct([("kind", pa.int32()), ("ctx", pa.list_(pa.string())), ("value", pa.string())]))
_OTHER_T = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("ctx", pa.list_(pa.string())), ("value", pa.string()), ("shapes", pa.int32())]))


def _others(text: str, base: list[tuple[int, int, int]]):
    """(start, end, contexts, value, shapes) of the candidates that no base span overlaps."""
    taken = iter(base)
    span, done = next(taken, None), 0
    for m in _MAYBE.finditer(text):
        at = m.start()
        if at < done:
            continue
        start = at
        while start > done and not text[start - 1].isspace():
            start -= 1
        done = _TOKEN.match(text, at).end()
        value = text[start:done]
        a = start + len(value) - len(value.lstrip(_EDGE))
        b = start + len(value.rstrip(_EDGE))
        run = _GROUPS.match(text, max(start, a - 1) if text[max(start, a - 1) : a] == "(" else a)
        if run and run.end() > done and _could_be(text[run.start() : run.end()]):
            a, b = run.start(), run.start() + len(run[0].rstrip(".,/+-("))
            done = max(done, b)
        while span is not None and span[2] <= a:
            span = next(taken, None)
        if b - a < 5 or (span is not None and span[0] < b):
            continue
        shapes = _could_be(text[a:b])
        if shapes:
            yield a, b, contexts(text, a, b), text[a:b], int(shapes)


def _scan(batches):
    row = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 33
    for batch in batches:
        ids, counts, bases, seeds, others = [], [], [], [], []
        for text in batch.column("text"):
            text = text.as_py() or ""
            base = base_spans(text)
            counts.append([sum(k == i for _, k, _ in base) for i in range(4)])
            bases.append([{"start": s, "kind": k, "end": e} for s, k, e in base])
            seeds.append([{"kind": k, "ctx": contexts(text, s, e), "value": text[s:e]} for s, k, e in base])
            others.append([dict(zip(("start", "end", "ctx", "value", "shapes"), o)) for o in _others(text, base)])
            ids.append(row)
            row += 1
        columns = [pa.array(ids, pa.int64()), batch.column("doc_id"), *(pa.array([c[i] for c in counts], pa.int64()) for i in range(4))]
        columns += [pa.array(bases, _BASE_T), pa.array(seeds, _SEED_T), pa.array(others, _OTHER_T)]
        yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", "seeds", "others"])


def patterns(seeds: DataFrame, others: DataFrame, support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """(kind, ctx, reliability) of the good patterns of seeds (kind, ctx, value) and other candidates (ctx, value, shapes)."""
    kinds = F.filter(F.array(*[F.lit(k) for k in range(len(KINDS))]), lambda k: F.call_function("getbit", F.col("shapes").cast("int"), k) == 1)
    both = seeds.select("kind", F.explode("ctx").alias("ctx"), "value", F.lit(1.0).alias("trust")).unionByName(
        others.select(F.explode(kinds).alias("kind"), "ctx", "value").select("kind", F.explode("ctx").alias("ctx"), "value", F.lit(0.0).alias("trust"))
    )
    edges = durable(both.groupBy("kind", "ctx", "value").agg(F.count(F.lit(1)).alias("n"), F.max("trust").alias("trust")), "edges")
    wide = edges.groupBy(F.col("kind").alias("_k"), F.col("ctx").alias("_c")).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= support).drop("m")
    edges = durable(edges.join(bounded(durable(wide, "wide")), (F.col("kind") == F.col("_k")) & (F.col("ctx") == F.col("_c"))).drop("_k", "_c"), "edges")
    known = 0
    while True:
        best = edges.groupBy("kind", "ctx").agg(
            F.count(F.when(F.col("trust") >= confident, 1)).alias("support"), (F.sum(F.col("n") * F.col("trust")) / (F.sum("n") + PRIOR)).alias("reliability")
        )
        good = durable(best.where((F.col("support") >= support) & (F.col("reliability") >= confident)).select("kind", "ctx", "reliability"), "patterns")
        now = good.count()
        if now == known:  # trust only grows, so no good pattern is lost
            return good
        known, of = now, good.select(F.col("kind").alias("_k"), F.col("ctx").alias("_c"), "reliability")
        reach = edges.join(bounded(of), (F.col("kind") == F.col("_k")) & (F.col("ctx") == F.col("_c"))).groupBy("kind", "value").agg(F.max("reliability").alias("_t"))
        reach = durable(reach.toDF("_k", "_v", "_t"), "reach")
        edges = edges.join(bounded(reach), (F.col("kind") == F.col("_k")) & (F.col("value") == F.col("_v")), "left")
        edges = durable(edges.select("kind", "ctx", "value", "n", F.greatest("trust", "_t").alias("trust")), "edges")


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """A row for each row: doc_id, base counts by kind, base and all spans as arrays of (start, kind, end), n_added."""
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    scanned = durable(map_arrow(src, _scan, SCANNED), "scanned")
    seeds = scanned.select(F.explode("seeds").alias("s")).select("s.*")
    others = scanned.select("row", F.explode("others").alias("o")).select("row", "o.*")
    good = patterns(seeds, others, support, confident).withColumnRenamed("ctx", "_ctx")
    hits = others.select("row", "start", "end", "shapes", F.explode("ctx").alias("ctx"))
    hits = hits.join(bounded(good), (F.col("ctx") == F.col("_ctx")) & (F.call_function("getbit", F.col("shapes"), F.col("kind")) == 1))
    hits = hits.groupBy("row", "start", "end").agg(F.max_by("kind", F.struct("reliability", -F.col("kind"))).alias("kind"))
    more = hits.groupBy(F.col("row").alias("_row")).agg(F.collect_list(F.struct("start", F.col("kind").cast("int").alias("kind"), "end")).alias("added"))
    out = scanned.drop("seeds", "others").join(more, F.col("row") == F.col("_row"), "left")
    added = F.coalesce("added", F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)"))
    spans = F.array_sort(F.concat("base", added))
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base", spans.alias("spans"), F.size(added).cast("long").alias("n_added"))


def span_text(spans: str):
    """``kind:start:end`` joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
