"""Toxic spans by a linear-chain conditional random field, and document scores from its marginals.

Only documents are labelled, so the token labels are latent: a toxic document has at least one toxic token (but for a
share ``NOISE`` of the labels), another has none. Training (on the driver, over a bounded sample of labelled documents
chosen by a hash of the id: at most ``SAMPLE`` of each class, none above ``SAMPLE_CHARS`` characters) climbs the
likelihood of the labels under a two-state CRF: forward-backward gives the marginals of the tokens as they are and given
the document's label, and weights follow the difference. The weights are for the word, its neighbours, its first three
and six and its last three bytes, and the transitions. They start from the association of each feature with the labels,
less three standard errors, over documents that are no copies of each other. A logistic calibration then maps a
document's largest marginal and expected number of toxic tokens to its probability, on documents of the sample that the
CRF has not been fitted to.

A chain is a sentence (up to ``. ! ?`` or a line feed), or a run of ``CHAIN`` words of a longer one. Inference reads whole
texts of any length, chains of all texts of a block side by side. Offending offsets are code points of words whose
marginal is 0.5 or more; adjoining words make one span. Null and empty texts score like a document without toxic words;
an empty table gives an empty result. Without labels of both classes every score is the share of label 1 (0 if there are
none). Each row is scored by itself: null ids like others, repeated rows alike. Ties in the sample's order go by the text.
Other columns pass by name where asked for (``keep``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textkernels as K
from .common import bounded, map_arrow

SAMPLE = 2000
SAMPLE_CHARS = 20_000
CHAIN = 128
BUCKETS = 1 << 18
#: Share of documents without a toxic token that are labelled toxic all the same.
NOISE = 0.02
EPOCHS = 8
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 63]] = True


class Chains:
    """Words of a block of texts, cut into chains."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.hash, self.start, self.per_text = K.words(data, offsets, K.ALNUM)
        n = len(self.hash)
        part = np.cumsum(_STOP[data], dtype=np.int32)[self.start] if n else np.zeros(0, np.int32)
        text = np.repeat(np.arange(len(offsets) - 1), np.diff(self.per_text))
        first = np.ones(n, bool)
        first[1:] = (part[1:] != part[:-1]) | (text[1:] != text[:-1])
        at = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else np.zeros(0, np.int64)
        first |= at % CHAIN == 0
        self.first = first
        self.begin = np.flatnonzero(first)
        self.length = np.diff(np.append(self.begin, n))
        self.text = text
        gap = ~K.ALNUM[data]
        ends = np.flatnonzero(gap)
        self.end = np.append(ends, len(data))[np.searchsorted(ends, self.start)] if n else self.start
        if n:  # a word also ends where its text does
            self.end = np.minimum(self.end, offsets[1:][text])

    def features(self, data: np.ndarray) -> np.ndarray:
        """Bucket of each word's six features, a row a word; bucket 0 holds what is absent."""
        h, n = self.hash, len(self.hash)
        low = K.LOWER[data].astype(np.uint64)
        take = lambda p: low[np.clip(p, 0, max(len(low) - 1, 0))] if n else np.zeros(0, np.uint64)
        head = take(self.start) << np.uint64(16) | take(np.minimum(self.start + 1, self.end - 1)) << np.uint64(8) | take(np.minimum(self.start + 2, self.end - 1))
        tail = take(self.end - 1) << np.uint64(16) | take(np.maximum(self.end - 2, self.start)) << np.uint64(8) | take(np.maximum(self.end - 3, self.start))
        six = np.zeros_like(h)
        for j in range(6):
            own = self.start + j
            six = six << np.uint64(8) | np.where(own < self.end, take(own), np.uint64(0))
        before, after = np.zeros_like(h), np.zeros_like(h)
        before[1:], after[:-1] = h[:-1], h[1:]
        out = np.stack([h, before, after, head, tail, six], axis=1)
        out = (K.mix(out + np.arange(1, 7, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(BUCKETS - 1)).astype(np.int64) + 1
        last = np.append(self.first[1:], True) if n else self.first
        out[self.first, 1] = 0
        out[last, 2] = 0
        return out


def messages(score: np.ndarray, begin: np.ndarray, length: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(odds, ahead, back) of each word: its own odds of state 1, and those that forward and backward messages give.

    ``score`` is the log odds of state 1, ``move`` a 2 x 2 log weight. Chains run side by side: step t handles the t-th
    word of all chains that have one.
    """
    t00, t01, t10, t11 = np.exp(move.reshape(-1))
    odds = np.exp(np.clip(score, -30, 30))
    ahead, back = np.empty_like(odds), np.ones_like(odds)
    order = np.argsort(-length, kind="stable")
    begin, length = begin[order], length[order]
    for t in range(int(length[0]) if len(length) else 0):
        k = np.searchsorted(-length, -t, "left")
        at = begin[:k] + t
        if t:
            r = ahead[at - 1]
            ahead[at] = np.clip(odds[at] * (t01 + t11 * r) / (t00 + t10 * r), 1e-30, 1e30)
        else:
            ahead[at] = odds[at]
    for t in range(1, int(length[0]) if len(length) else 0):
        k = np.searchsorted(-length, -t, "left")
        at = begin[:k] + length[:k] - 1 - t
        r = back[at + 1] * odds[at + 1]
        back[at] = np.clip((t10 + t11 * r) / (t00 + t01 * r), 1e-30, 1e30)
    return odds, ahead, back


def marginals(score: np.ndarray, begin: np.ndarray, length: np.ndarray, move: np.ndarray) -> np.ndarray:
    """P(state 1) of each word by forward-backward."""
    _, ahead, back = messages(score, begin, length, move)
    r = np.clip(ahead * back, 1e-30, 1e30)
    return r / (1 + r)


def expected(score: np.ndarray, begin: np.ndarray, length: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of the words, of their pairs of states with the word before (zeros for first words), and the log
    probability that all words of the chain are in state 0, for each word of it its own factor."""
    odds, ahead, back = messages(score, begin, length, move)
    r = np.clip(ahead * back, 1e-30, 1e30)
    p = r / (1 + r)
    m = np.exp(move)
    first = np.zeros(len(p), bool)
    first[begin] = True
    q = np.clip(back * odds, 1e-30, 1e30)
    before = np.concatenate(([1.0], ahead[:-1])) if len(p) else ahead
    joint = np.stack([np.full(len(p), m[0, 0]), m[0, 1] * q, before * m[1, 0], before * m[1, 1] * q], axis=1)
    joint /= joint.sum(axis=1, keepdims=True) if len(p) else 1
    joint[first] = 0
    none = np.where(first, np.log1p(-np.minimum(p, 1 - 1e-12)), -np.log1p(m[0, 1] * q / m[0, 0]))
    return p, joint, none


class Model:
    def __init__(self, share: float):
        self.share, self.weights, self.move, self.curve = share, None, np.zeros((2, 2)), None

    def tag(self, data: np.ndarray, chains: Chains) -> np.ndarray:
        x = chains.features(data)
        return marginals(self.weights[x].sum(axis=1) + self.weights[0] * (1 - (x == 0).sum(axis=1)), chains.begin, chains.length, self.move)

    def score(self, most: np.ndarray, total: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * most + c * np.log1p(total), -30, 30)))


def _summary(p: np.ndarray, per_text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(per_text) - 1
    text = np.repeat(np.arange(n), np.diff(per_text))
    most, total = np.zeros(n), np.bincount(text, p, n) if len(p) else np.zeros(n)
    np.maximum.at(most, text, p)
    return most, total


def _once(words: list[np.ndarray]) -> np.ndarray:
    """Which texts share less than four of their eight least hashes of word triples with those before them."""
    seen, out = set(), np.ones(len(words), bool)
    for i, w in enumerate(words):
        if len(w) >= 3:
            least = np.unique(K.mix(w[:-2] * K._MULT[0] + w[1:-1] * K._MULT[1] + w[2:] * K._MULT[2]))[:8].tolist()
            out[i] = sum(x in seen for x in least) < 4
            seen.update(least)
    return out


def _start(feats: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """First weights: the log odds ratio of a feature between toxic and other documents less three standard errors, 0 at least and 3 at most."""
    have = [np.unique(x[:, [0, 3, 4, 5]]) for x in feats]  # not of the neighbours
    flat, label = (np.concatenate(have) if have else np.zeros(0, np.int64)), np.repeat(toxic, [len(x) for x in have])
    bad = np.bincount(flat[label], minlength=BUCKETS) + 0.5
    good = np.bincount(flat[~label], minlength=BUCKETS) + 0.5
    odds = np.log(bad / good) - np.log((toxic.sum() + 1) / ((~toxic).sum() + 1))
    w = np.clip(odds - 3 * np.sqrt(1 / bad + 1 / good), 0, 3)
    w[0] = 0
    return w


def fit(texts: list[str], toxic: list[bool], share: float | None = None, epochs: int = EPOCHS, seed: int = 3) -> Model:
    """A model of the given documents; ``share`` is that of label 1 among all documents, if the sample has another."""
    label = np.array(toxic, bool)
    model = Model(share if share is not None else float(label.mean()) if len(label) else 0.0)
    if not label.any() or label.all():
        return model
    parts, words, feats, lens, rng = [], [], [], [], np.random.Generator(np.random.PCG64(seed))
    for first, n, data, offsets in K.chunks(pa.array(texts, pa.large_string())):
        c = Chains(data, offsets)
        parts.append((first, n, data, c))
        x = c.features(data)
        cut = np.searchsorted(c.begin, c.per_text)
        for i in range(n):
            words.append(c.hash[c.per_text[i] : c.per_text[i + 1]])
            feats.append(x[c.per_text[i] : c.per_text[i + 1]])
            lens.append(c.length[cut[i] : cut[i + 1]])
    fitted = rng.random(len(label)) < 0.7
    use = np.flatnonzero(fitted & np.array([len(x) > 0 for x in feats]))
    use = use[_once([words[i] for i in use])]
    w, move = _start([feats[i] for i in use], label[use]), np.zeros((2, 2))
    w[0] = -6.0
    sum_w, sum_move, seen, block = np.zeros(BUCKETS), np.zeros((2, 2)), 0, 64
    for epoch in range(epochs):
        order = rng.permutation(use)
        rate = 0.5 / (1 + epoch)
        for at in range(0, len(order), block):
            own = order[at : at + block]
            x = np.concatenate([feats[i] for i in own])
            length = np.concatenate([lens[i] for i in own])
            begin = np.concatenate(([0], np.cumsum(length)[:-1]))
            doc = np.repeat(np.arange(len(own)), [len(feats[i]) for i in own])
            p, joint, none = expected(w[x].sum(axis=1) + w[0] * (1 - (x == 0).sum(axis=1)), begin, length, move)
            none = np.exp(np.bincount(doc, none, len(own)))  # that no word of the document is toxic
            some = np.maximum(1 - none, 1e-9)
            holds = np.where(label[own], some / (some + NOISE * none), 0.0)  # that one is, given the label
            g = p * (holds / some)[doc] - p
            step = np.bincount(x.reshape(-1), np.repeat(g, x.shape[1]), BUCKETS)
            step[0] = g.sum() / block
            w += rate * step
            inner = joint.sum(axis=1) > 0
            change = joint * ((holds / some)[doc] - 1)[:, None]
            change[:, 0] += np.where(inner, ((1 - holds) - holds / some * none)[doc], 0)
            move += rate * change.sum(axis=0).reshape(2, 2) / block - 1e-4 * move
            w[1:] *= 0.999
        if epoch >= epochs // 2:
            sum_w, sum_move, seen = sum_w + w, sum_move + move, seen + 1
    model.weights, model.move = (sum_w / seen).astype(np.float32), sum_move / seen
    most, total = np.zeros(len(label)), np.zeros(len(label))
    for first, n, data, c in parts:
        m, t = _summary(model.tag(data, c), c.per_text)
        most[first : first + n], total[first : first + n] = m, t
    rest = ~fitted if label[~fitted].any() and not label[~fitted].all() else np.ones(len(label), bool)
    weight = np.where(label[rest], model.share / label[rest].mean(), (1 - model.share) / (1 - label[rest].mean()))
    model.curve = _calibrate(most[rest], total[rest], label[rest], weight)
    return model


def _calibrate(most: np.ndarray, total: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float, float]:
    x = np.stack([np.ones_like(most), most, np.log1p(total)], axis=1)
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(3)
        w += np.linalg.solve(hess, x.T @ (weight * (label - p)) - 0.1 * w)
    return tuple(float(v) for v in w)


def train(docs: DataFrame, labels: DataFrame | None = None, per_class: int = SAMPLE, most_chars: int = SAMPLE_CHARS) -> Model:
    """A model from (doc_id, text) and labels (doc_id, toxic), or from (doc_id, text, toxic); rows with a null label or text teach nothing.

    The sample is drawn from the labels, and only its ids meet the texts, by a broadcast of at most some
    ``1.5 * per_class`` rows a class; the counts need no text.
    """
    dice = F.pmod(F.xxhash64("doc_id", F.lit(4)), F.lit(1_000_003)) / 1_000_003
    short = F.col("_chars") <= most_chars
    sized = docs.where("text is not null").withColumn("_chars", F.length("text"))
    if labels is None:
        labels, every = docs.select("doc_id", "toxic"), sized.select("toxic", "_chars")
    else:
        every = sized.select(F.col("doc_id").alias("_id"), "_chars").join(labels, F.col("_id") == F.col("doc_id")).select("toxic", "_chars")
    label = (F.col("toxic") > 0).cast("int")
    found = every.where("toxic is not null").groupBy(label.alias("toxic")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(short, 1)).alias("short")).collect()
    counts, rows = {r["toxic"]: r["n"] for r in found}, []  # two classes at most
    for value, n in sorted((r["toxic"], r["short"]) for r in found):
        some = labels.where((label == value) & (dice < min(1.0, 1.5 * per_class / max(1, n)))).select(F.col("doc_id").alias("_id")).distinct()
        some = sized.join(bounded(some), F.col("doc_id").eqNullSafe(F.col("_id"))).where(short)
        some = some if "toxic" not in docs.columns else some.where(label == value)
        rows += [(r["text"], bool(value)) for r in some.orderBy(F.xxhash64("doc_id", F.lit(4)), "text").limit(per_class).select("text").collect()]
    total = sum(counts.values())
    return fit([t for t, _ in rows], [v for _, v in rows], counts.get(1, 0) / total if total else 0.0)


def score_documents(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row, score, spans (start, end, marginal) in code points."""
    src = docs.select(*keep, F.col(text_col).cast("string").alias("_text"))
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields if f.name != "_text"]
    schema = ", ".join([*own, "score double", "spans array<struct<start:long,end:long,marginal:double>>"])
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())]))

    def run(batches):
        known = shared.value
        for batch in batches:
            scores, spans = np.full(batch.num_rows, known.share), [[] for _ in range(batch.num_rows)]
            if known.weights is not None:
                for first, n, data, offsets in K.chunks(batch.column("_text")):
                    c = Chains(data, offsets)
                    p = known.tag(data, c)
                    scores[first : first + n] = known.score(*_summary(p, c.per_text))
                    hit = np.flatnonzero(p >= 0.5)
                    if len(hit):
                        points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                        base = points[offsets[:-1]]
                        for i in hit:
                            t = c.text[i]
                            a, b = int(points[c.start[i]] - base[t]), int(points[c.end[i]] - base[t])
                            mine = spans[first + t]
                            if mine and i and mine[-1]["word"] == i - 1 and not c.first[i]:
                                mine[-1] |= {"end": b, "word": i, "marginal": max(mine[-1]["marginal"], float(p[i]))}
                            else:
                                mine.append({"start": a, "end": b, "marginal": float(p[i]), "word": i})
            spans = [[{k: s[k] for k in ("start", "end", "marginal")} for s in own] for own in spans]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(scores, pa.float64()), pa.array(spans, kind)], [*keep, "score", "spans"])

    return map_arrow(src, run, schema)


def trusted(doc_id: Column) -> Column:
    """Rows whose labels may be learned: crc32 of the id as text is not 0 modulo 5."""
    from .common import fold

    return F.coalesce(fold(doc_id, 5) != 0, F.lit(True))
