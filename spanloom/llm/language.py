"""Language identification in two steps: the family first, then one-versus-one linear SVMs inside it.

Features are hashed byte pairs and triples of the lower-cased text, with everything that is no letter as a space; their
counts are square-rooted and brought to unit length. Linear SVMs (squared hinge loss, dual coordinate descent) separate
each family from the others; the languages of the family that wins are told apart by one SVM for each pair, by votes
and then by summed margins.

The classifier is fitted on a bounded sample: at most ``SAMPLE_PER_LANGUAGE`` whole texts a language and ``SAMPLE``
in all (but at least ``LEAST_SAMPLE`` a language), chosen by a hash of the id; more than ``MOST_LANGUAGES`` labels are
refused, none is left out. Prediction reads every whole text. Null texts and texts without a letter are
``und`` with score 0; so is every text if nothing can be learned. With one language learned, that is the answer, score 1.
Rows that repeat are predicted alike; null ids are predicted like others; ties go to the first language in order. An empty
table gives an empty result. Other columns pass by name where asked for, as long as no two of the output share a name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernels as K
from .common import fresh, map_arrow

SAMPLE_PER_LANGUAGE = 400
SAMPLE = 4000
LEAST_SAMPLE = 4
MOST_LANGUAGES = 2000
SIZE = 2048
UNKNOWN = "und"

# Families of ISO 639-1 languages. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("fr", "es", "pt", "it", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk"),
}

_FOLD = K.LOWER.copy()
_FOLD[~K.ALNUM] = 32
_FOLD[48:58] = 32


def family(language: str) -> str:
    return next((name for name, members in FAMILIES.items() if language in members), language)


def features(column: pa.Array):
    """Blocks of (first row, unit vectors of 2 * SIZE hashed counts); an empty text has a zero vector."""
    for first, n, data, offsets in K.chunks(pc.utf8_lower(column)):
        b = _FOLD[data].astype(np.uint32)
        for at in range(0, n, 256):
            to = min(n, at + 256)
            lo, hi = offsets[at], offsets[to]
            x = b[lo:hi]
            row = np.repeat(np.arange(to - at), np.diff(offsets[at : to + 1]))
            counts = np.zeros((to - at) * 2 * SIZE, np.float32)
            for k, side in ((2, 0), (3, SIZE)):
                if len(x) >= k:
                    code = x[: len(x) - k + 1].copy()
                    for j in range(1, k):
                        code = code * np.uint32(256) + x[j : len(x) - k + 1 + j]
                    code = ((code * np.uint32(2654435761)) >> np.uint32(21)).astype(np.int64) + side
                    own = row[: len(code)] == row[k - 1 :]
                    counts += np.bincount((row[: len(code)] * (2 * SIZE) + code)[own], minlength=len(counts))
            v = np.sqrt(counts.reshape(to - at, 2 * SIZE))
            yield first + at, v / np.maximum(np.sqrt((v * v).sum(axis=1, keepdims=True)), 1e-9)


def fit_svm(x: np.ndarray, y: np.ndarray, cost: float = 10.0, turns: int = 15) -> tuple[np.ndarray, float]:
    """Weights and bias of a linear SVM with squared hinge loss, by dual coordinate descent; ``y`` is +1 or -1.

    Sides of unequal size weigh alike.
    """
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)]).astype(np.float64)
    own = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * cost
    w, a = np.zeros(x.shape[1]), np.zeros(len(x))
    norm = (x * x).sum(axis=1) + 1 / (2 * own)
    rng = np.random.Generator(np.random.PCG64(5))
    for _ in range(turns):
        for i in rng.permutation(len(x)):
            g = y[i] * (w @ x[i]) - 1 + a[i] / (2 * own[i])
            new = max(a[i] - g / norm[i], 0.0)
            if new != a[i]:
                w += (new - a[i]) * y[i] * x[i]
                a[i] = new
    return w[:-1], float(w[-1])


class Model:
    """Families and, within each, pairs of languages."""

    def __init__(self, x: np.ndarray, languages: list[str]):
        lang = np.array(languages, object)
        self.names = sorted(set(languages))
        own = {n: family(n) for n in self.names}
        self.families = sorted(set(own.values()))
        self.members = {f: [n for n in self.names if own[n] == f] for f in self.families}
        of = np.array([own[n] for n in languages], object)
        pick = lambda mask: np.where(mask, 1.0, -1.0)
        self.outer = [fit_svm(x, pick(of == f)) for f in self.families] if len(self.families) > 1 else []
        self.inner = {}
        for f, members in self.members.items():
            for i, a in enumerate(members):
                for b in members[i + 1 :]:
                    both = (lang == a) | (lang == b)
                    self.inner[a, b] = fit_svm(x[both], pick(lang[both] == a))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        n = len(x)
        squash = lambda m: 1 / (1 + np.exp(-np.clip(3 * m, -30, 30)))
        if self.outer:
            margins = np.stack([x @ w + b for w, b in self.outer], axis=1)
            best = margins.argmax(axis=1)
            score = squash(margins[np.arange(n), best])
        else:
            best, score = np.zeros(n, np.int64), np.ones(n)
        names = np.empty(n, object)
        for k, f in enumerate(self.families):
            rows = np.flatnonzero(best == k)
            members = self.members[f]
            votes, total = np.zeros((len(rows), len(members))), np.zeros((len(rows), len(members)))
            for i, a in enumerate(members):
                for j in range(i + 1, len(members)):
                    w, b = self.inner[a, members[j]]
                    m = x[rows] @ w + b
                    votes[:, i] += m >= 0
                    votes[:, j] += m < 0
                    total[:, i] += m
                    total[:, j] -= m
            rank = votes + np.tanh(total) / 4 if len(members) > 1 else votes
            top = rank.argmax(axis=1)
            names[rows] = np.array(members, object)[top]
            if len(members) > 1:
                score[rows] *= squash(total[np.arange(len(rows)), top] / (len(members) - 1))
        return names.tolist(), score


def sample(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, most: int = SAMPLE) -> DataFrame:
    """At most ``per_language`` rows (doc_id, text, lang) of each language and about ``most`` in all, by a hash of the id.

    A share is taken by the hash first, so no language is sorted whole.
    """
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    counts = sorted(counts, key=lambda r: r["lang"])
    each = max(LEAST_SAMPLE, min(per_language, most // max(1, len(counts))))
    if not counts:
        return labelled.limit(0)
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, 2.0 * each / r["n"]))])[F.col("lang")]
    dice = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_003)) / 1_000_003
    some = labelled.where(dice < share)
    rank = F.expr("row_number() over (partition by lang order by xxhash64(doc_id, 9), text)")
    return some.withColumn("_rank", rank).where(F.col("_rank") <= each).drop("_rank")


def train(labelled: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE, most: int = SAMPLE) -> Model | None:
    """A model from (doc_id, text, lang), or None where no labelled text has a letter."""

    def run(batches):
        for batch in batches:
            for first, x in features(batch.column("text")):
                keep = x.astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(first, len(x)), pa.array([r.tobytes() for r in keep], pa.binary())], ["lang", "x"])

    good = labelled.where(F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    rows = map_arrow(sample(good, per_language, most).select("lang", "text"), run, "lang string, x binary").toArrow()
    if not rows.num_rows:
        return None
    lang = rows["lang"].to_pylist()
    raw = rows["x"].to_pylist()
    order = sorted(range(len(lang)), key=lambda i: (lang[i], raw[i]))
    x = np.stack([np.frombuffer(raw[i], np.float32) for i in order]).astype(np.float64)
    return Model(x, [lang[i] for i in order])


def identify(docs: DataFrame, model: Model | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The columns ``keep`` of every row, and the language and score under the names ``out``.

    ``keep`` may hold the text and any other columns; ``out`` must not be among them.
    """
    text_in = next((c for c in keep if c == text_col), None) or fresh(list(keep), "_text")
    src = docs.select(*[F.col(f"`{c}`") for c in keep], *([] if text_in in keep else [F.col(text_col).alias(text_in)]))
    src = src.withColumn(text_in, F.col(text_in).cast("string"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name in keep), f"`{out[0]}` string", f"`{out[1]}` double"])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = shared.value
        for batch in batches:
            text = batch.column(text_in)
            letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if known is not None:
                for first, x in features(text):
                    got, s = known.predict(x)
                    names[first : first + len(x)] = got
                    scores[first : first + len(x)] = s
            names = [n if ok else UNKNOWN for n, ok in zip(names, letters)]
            scores = np.where(letters, scores, 0.0)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, *out])

    return map_arrow(src, run, schema)


def trusted(doc_id: Column) -> Column:
    """Rows that may be learned from: crc32 of the id as text is not 2 modulo 4."""
    from .common import fold

    return F.coalesce(fold(doc_id, 4) != 2, F.lit(True))
