"""Toxicity by cumulative-link ordinal regression on sparse text features.

Grades are ordered: 0 clean, 1 toxic, 2 toxic in a document of low quality. One weight a
word is shared by the thresholds t1 < t2: P(grade >= k) = sigmoid(w . x - t_k), where x says
which words occur. The expected severity is the sum of these. Weights are fitted with an L1
penalty by accelerated proximal steps in numpy (over the words that the penalty lets in), on
a sample of labelled documents of at most ``SAMPLE`` rows (taken by a hash of the id, so
that reruns agree); a fifth of it is held out to set the severity above which a document counts as toxic. Scoring reads every
whole text.

Defined cases: null or empty text has no words and gets the severity of the thresholds
alone; labels with a null toxic flag are left out, a null quality counts as good; without
both clean and toxic labelled documents nothing is rejected; rows that repeat are scored
each; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import reserved, settle, tune

SAMPLE = 12_000
LEAST_DOCS = 3
L1 = 4e-4
STEPS = 150
STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
KNOWN_WORDS = 100_000


def word_hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.strip(STRIP).encode()) - (1 << 63)


def words_of(text: str | None) -> set[str]:
    return set((text or "").lower().split())


def _word_hashes(texts: pa.Array) -> pa.Array:
    return pa.array([np.array(sorted({word_hash(w) for w in words_of(t)}), np.int64).tobytes() for t in texts.to_pylist()], pa.binary())


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) of labelled documents; the greatest grade if an id repeats."""
    low = F.coalesce(F.col("quality") == 0, F.lit(False)).cast("int")
    rows = labels.filter("doc_id is not null and toxic is not null").select("doc_id", F.when(F.col("toxic") == 0, 0).otherwise(1 + low).alias("grade"))
    return rows.groupBy("doc_id").agg(F.max("grade").alias("grade"))


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> DataFrame:
    """(doc_id, grade, hashes: int64s as bytes) of at most ``most`` labelled documents."""
    chosen = grades(labels).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``most`` ids
    return joined.select("doc_id", "grade", F.arrow_udf(_word_hashes, "binary")(F.col("text")).alias("hashes"))


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class OrdinalModel:
    def __init__(self, words: dict[int, float], t1: float, t2: float, cut: float):
        self.words, self.t1, self.t2, self.cut = words, t1, t2, cut

    def severity(self, score: float) -> tuple[float, float]:
        """P(grade >= 1) and the expected grade."""
        p = [1 / (1 + math.exp(min(700.0, t - score))) for t in (self.t1, self.t2)]
        return p[0], p[0] + p[1]


def _slopes(score: np.ndarray, grade: np.ndarray, t1: float, t2: float):
    """P of each row's grade, and the slopes of its logarithm by the score and by the second threshold alone."""
    a, b = _sigmoid(score - t1), _sigmoid(score - t2)
    prob = np.where(grade == 0, 1 - a, np.where(grade == 1, a - b, b)).clip(1e-12)
    da, db = a * (1 - a), b * (1 - b)
    return prob, np.where(grade == 0, -a, np.where(grade == 1, (da - db) / prob, 1 - b)), np.where(grade == 1, db / prob, np.where(grade == 2, -(1 - b), 0.0))


def _gap(log_gap: float) -> float:
    return math.exp(min(log_gap, 5.0))


def _fit(rows: np.ndarray, cols: np.ndarray, n: int, v: int, grade: np.ndarray, l1: float, steps: int, par: np.ndarray) -> np.ndarray:
    """rows, cols: positions of ones; par: v weights, t1 and log(t2 - t1) to start from."""
    look, t, step = par.copy(), 1.0, 1.0

    def value_of(p):
        prob, by_score, by_t2 = _slopes(np.bincount(rows, p[:v][cols], n), grade, p[v], p[v] + _gap(p[v + 1]))
        return -np.log(prob).mean(), by_score, by_t2

    for _ in range(steps):
        value, by_score, by_t2 = value_of(look)
        g = np.empty_like(look)
        g[:v] = -np.bincount(cols, by_score[rows], v) / n
        g[v] = by_score.mean()
        g[v + 1] = -by_t2.mean() * _gap(look[v + 1])
        while True:
            new = look - step * g
            new[:v] = np.sign(new[:v]) * np.maximum(np.abs(new[:v]) - step * l1, 0)
            d = new - look
            if value_of(new)[0] <= value + g @ d + (d @ d) / (2 * step) + 1e-12:
                break
            step /= 2
        nt = (1 + math.sqrt(1 + 4 * t * t)) / 2
        look, par, t = new + (t - 1) / nt * (new - par), new, nt
        step *= 1.3
    return par


def _fit_active(rows: np.ndarray, cols: np.ndarray, n: int, v: int, grade: np.ndarray, l1: float, steps: int):
    """Weights, t1 and t2. Only words whose slope exceeds the penalty are fitted, until no other word's does."""
    share = np.clip([np.mean(grade >= k) for k in (1, 2)], 1e-3, 1 - 1e-3)
    base = np.log((1 - share) / share)
    w, t1, gap = np.zeros(v), base[0], math.log(max(base[1] - base[0], 0.1))
    active = np.zeros(v, bool)
    for _ in range(20):
        slope = np.bincount(cols, _slopes(np.bincount(rows, w[cols], n), grade, t1, t1 + _gap(gap))[1][rows], v) / n
        new = ~active & (np.abs(slope) > 1.02 * l1)
        if not new.any():
            break
        active |= new
        own, k = active[cols], int(active.sum())
        par = _fit(rows[own], (np.cumsum(active) - 1)[cols[own]], n, k, grade, l1, steps, np.concatenate([w[active], [t1, gap]]))
        w[active], t1, gap = par[:k], par[k], par[k + 1]
    return w, t1, t1 + _gap(gap)


def fit(sample: list[tuple[int, int, bytes]], l1: float = L1, steps: int = STEPS, least_docs: int = LEAST_DOCS) -> OrdinalModel:
    """sample: (doc_id, grade, word hashes as bytes), bounded by the caller."""
    sample = sorted(sample, key=lambda r: (r[0], r[1], r[2]))
    grade = np.array([r[1] for r in sample], np.int64)
    if not (grade > 0).any() or not (grade == 0).any():
        return OrdinalModel({}, math.inf, math.inf, math.inf)
    sizes = np.array([len(r[2]) // 8 for r in sample])
    hashes = np.frombuffer(b"".join([r[2] for r in sample]), np.int64)
    rows = np.repeat(np.arange(len(sample), dtype=np.int32), sizes)
    words, n_docs = np.unique(hashes, return_counts=True)
    words = words[n_docs >= least_docs]
    cols = np.searchsorted(words, hashes).astype(np.int32)
    keep = cols < len(words)
    keep[keep] = words[cols[keep]] == hashes[keep]
    rows, cols = rows[keep], cols[keep]
    v, n = len(words), len(sample)
    held = np.arange(n) % 5 == 4
    train = ~held[rows]
    place = np.cumsum(~held) - 1
    w, t1, t2 = _fit_active(place[rows[train]], cols[train], int((~held).sum()), v, grade[~held], l1, steps)
    model = OrdinalModel({}, t1, t2, math.inf)
    score = np.bincount(rows, w[cols], n)
    sev = np.array([model.severity(s)[1] for s in score])
    model.cut = _threshold(sev[held], grade[held] > 0) if held.any() and (grade[held] > 0).any() else 0.5
    model.words = {int(h): float(x) for h, x in zip(words, w, strict=True) if x}
    return model


def _threshold(severity: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the widest gap among cuts with the best accuracy, clean documents counted double."""
    order = np.argsort(-severity, kind="stable")
    sev, tox = severity[order], toxic[order]
    gain = np.concatenate([[0], np.cumsum(np.where(tox, 1, -2))])
    edges = np.concatenate([[2.0], sev, [0.0]])
    gap = np.where(gain == gain.max(), edges[:-1] - edges[1:], -1.0)
    at = int(np.argmax(gap))
    return float((edges[at] + edges[at + 1]) / 2)


class _Scorer:
    def __init__(self, model: OrdinalModel):
        self.model = model
        self.known: set[str] = set()
        self.hot: set[str] = set()
        self.weight: dict[str, float] = {}

    def __call__(self, text: str | None) -> tuple[float, float, int, bool]:
        words = words_of(text)
        if len(self.known) > KNOWN_WORDS:
            self.known.clear(), self.hot.clear(), self.weight.clear()
        new = words.difference(self.known)
        for w in new:
            if x := self.model.words.get(word_hash(w)):
                self.hot.add(w)
                self.weight[w] = x
        self.known |= new
        # one weight a word, whatever clings to it; fsum doesn't depend on the order
        own = {word_hash(w): self.weight[w] for w in words.intersection(self.hot)}
        p, severity = self.model.severity(math.fsum(own.values()))
        return severity, p, int(severity + 0.5), severity > self.model.cut


_SCORER: list[_Scorer] = []
SCORE = "struct<expected_severity: double, p_toxic: double, grade: int, toxic: boolean>"


def train(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> OrdinalModel:
    tune(docs.sparkSession)
    rows = labelled_sample(docs, labels, most).collect()  # at most ``most`` rows of word hashes
    return fit([(r.doc_id, r.grade, r.hashes) for r in rows])


def score_texts(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """docs with the struct column ``__toxicity``."""
    reserved(docs, "__toxicity")
    tune(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: pa.Array) -> pa.Array:
        if not _SCORER or _SCORER[0].model is not shipped.value:
            _SCORER[:] = [_Scorer(shipped.value)]  # a worker keeps the words of one model
        rows = [_SCORER[0](t) for t in texts.to_pylist()]
        settle()
        cols = zip(*rows, strict=True) if rows else [[]] * 4
        kinds = (pa.float64(), pa.float64(), pa.int32(), pa.bool_())
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["expected_severity", "p_toxic", "grade", "toxic"])

    return docs.withColumn("__toxicity", F.arrow_udf(run, SCORE)(F.col("text")))
