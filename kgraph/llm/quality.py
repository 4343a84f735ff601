"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Units are a word's letters, its shape with the marks around it, and a mark that it repeats the word before. Every unit has a sparse random index vector drawn from its hash; its
context vector is the sum of the index vectors around its occurrences in the training rows. A document is the
mean of its words' context vectors, by kind of unit; a tanh layer and a logistic unit, trained with Adam, score it,
and a temperature calibrates the score on labelled rows that neither vectors nor network have seen.

Fitted in one executor task on at most PER_CLASS labelled documents of each class (of up to LONGEST characters), whose
crc32 mod 5 is not 0; words are held as numbers there. Scoring reads whole texts of any length.

Defined results: null and wordless texts pool to the zero vector and get its score; without labels of both classes every
score is 1 (nothing is known against a document); repeated rows score alike; an empty table gives an
empty result; other columns are not read by `score_quality` and pass through `filter_quality` as they are.
"""

from __future__ import annotations

import pickle
import re
import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgraph.llm.common import crc_mod5, fitted, kept_rows, labelled_sample, table, with_columns

PER_CLASS, LONGEST = 1500, 60_000
DIM, NONZERO, AROUND, HIDDEN, EPOCHS, SEED = 64, 4, 2, 24, 300, 7
LEAST_COUNT, CACHED_WORDS = 3, 200_000
THRESHOLD = 0.3
AGAIN = "="
_SPLIT = re.compile(r"^(\W*)(.*?)(\W*)$", re.S)


def units(word: str) -> tuple[str, str]:
    """(letters, shape): 'Thinking***' is ('thinking', 'Xx|***')."""
    before, core, after = _SPLIT.match(word).groups()
    if not core:
        return "w:", f"s:|{before[:6]}"
    kind = "9" if core.isdigit() else "X" if core.isupper() and len(core) > 1 else "Xx" if core[:1].isupper() else "x"
    return "w:" + core.lower()[:24], f"s:{before[:3]}{kind}|{after[:4]}"


def index_vector(unit: str) -> np.ndarray:
    r = np.random.default_rng(zlib.crc32(unit.encode("utf-8", "replace")))
    v = np.zeros(DIM, np.float32)
    at = r.choice(DIM, NONZERO, replace=False)
    v[at] = r.choice(np.array([-1, 1], np.float32), NONZERO)
    return v


def pooled(pairs: np.ndarray, again: int, matrix: np.ndarray) -> np.ndarray:
    """Mean context vectors of letters, shapes and marks; pairs are rows of the matrix, 0 for units not in the vocabulary."""
    n = len(pairs)
    if not n:
        return np.zeros(3 * DIM, np.float32)
    out = []
    for k in (0, 1):
        c = np.bincount(pairs[:, k])
        c[0] = 0
        at = np.nonzero(c)[0]
        out.append(c[at] @ matrix[at] / n)
    out.append(again / n * matrix[-1])
    return np.concatenate(out).astype(np.float32)


class Vectors:
    """Context vectors; row 0 is the zero vector, the last is that of the mark AGAIN."""

    def __init__(self, vocabulary: list[str], matrix: np.ndarray):
        self.row = {u: i + 1 for i, u in enumerate(vocabulary)}
        self.matrix = matrix
        self.cache: dict[str, tuple[int, int]] = {}

    def __getstate__(self):
        return {"row": self.row, "matrix": self.matrix, "cache": {}}

    def _rows(self, word: str) -> tuple[int, int]:
        core, shape = units(word)
        got = self.row.get(core, 0), self.row.get(shape, 0)
        if len(word) <= 40:
            if len(self.cache) >= CACHED_WORDS:
                self.cache.clear()
            self.cache[word] = got
        return got

    def pool(self, text: str | None) -> np.ndarray:
        words = (text or "").split()
        get = self.cache.get
        rows = [get(w) or self._rows(w) for w in words]
        again = sum(map(str.__eq__, words[1:], words))
        return pooled(np.array(rows, np.int64).reshape(-1, 2), again, self.matrix)


def numbered(texts) -> tuple[list[str], list[np.ndarray], list[int]]:
    """(unit names, per text its words as pairs of unit numbers, per text the words that repeat the one before)."""
    number: dict[str, int] = {}
    known: dict[str, tuple[int, int]] = {}
    pairs, again = [], []
    for t in texts:
        words = t.split()
        for w in words:
            if w not in known:
                known[w] = tuple(number.setdefault(u, len(number)) for u in units(w))
        pairs.append(np.array([known[w] for w in words], np.int32).reshape(-1, 2))
        again.append(sum(map(str.__eq__, words[1:], words)))
    return list(number), pairs, again


def random_index(names: list[str], pairs: list[np.ndarray], again: list[int]) -> tuple[Vectors, np.ndarray]:
    """Vectors of the units found at least LEAST_COUNT times, and the row of each unit number."""
    counts = np.zeros(len(names), np.int64)
    for p in pairs:
        counts += np.bincount(p.ravel(), minlength=len(names))
    vocabulary = sorted(names[i] for i in np.nonzero(counts >= LEAST_COUNT)[0])
    row = {u: i + 1 for i, u in enumerate(vocabulary)}
    rows = np.array([row.get(u, 0) for u in names], np.int64)
    index = np.vstack([np.zeros((1, DIM), np.float32), *(index_vector(u)[None] for u in (*vocabulary, AGAIN))])
    context = np.zeros(index.shape, np.float64)
    for p, times in zip(pairs, again):
        n = len(p)
        if not n:
            continue
        at = rows[p]
        vec = index[at[:, 0]] + index[at[:, 1]]
        sums = np.zeros((n + 1, DIM))
        sums[1:] = np.cumsum(vec, 0)
        i = np.arange(n)
        around = sums[np.minimum(i + AROUND + 1, n)] - sums[np.maximum(i - AROUND, 0)] - vec
        for k in (0, 1):
            np.add.at(context, at[:, k], around + 0.5 * index[at[:, k]])
        context[-1] += times * index[-1]
    context[0] = 0.0
    context /= np.linalg.norm(context, axis=1, keepdims=True) + 1e-9
    return Vectors(vocabulary, context.astype(np.float32)), rows


def _train(x: np.ndarray, y: np.ndarray):
    r = np.random.default_rng(SEED)
    w1, b1 = r.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN)
    w2, b2 = r.normal(0, 0.3, HIDDEN), np.zeros(1)
    params, m, v = [w1, b1, w2, b2], None, None
    weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    for step in range(1, EPOCHS + 1):
        h = np.tanh(x @ params[0] + params[1])
        p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -30, 30)))
        d = weight * (p - y) / len(y)
        dh = np.outer(d, params[2]) * (1 - h * h)
        grads = [x.T @ dh + 1e-4 * params[0], dh.sum(0), h.T @ d + 1e-4 * params[2], np.array([d.sum()])]
        m = [0.1 * g if m is None else 0.9 * a + 0.1 * g for a, g in zip(m or grads, grads)]
        v = [0.001 * g * g if v is None else 0.999 * a + 0.001 * g * g for a, g in zip(v or grads, grads)]
        for q, a, b in zip(params, m, v):
            q -= 0.02 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    return params


def _logit(params, x):
    return np.tanh(x @ params[0] + params[1]) @ params[2] + params[3]


def fit(sample: list[tuple[str, int]]) -> dict | None:
    if len({y for _, y in sample}) < 2:
        return None
    y = np.array([y for _, y in sample], float)
    apart = np.arange(len(y)) % 5 == 0  # rows for the temperature
    if len(set(y[~apart])) < 2:
        apart[:] = False
    names, pairs, again = numbered(t for t, _ in sample)
    vectors, rows = random_index(names, [p for p, a in zip(pairs, apart) if not a], [n for n, a in zip(again, apart) if not a])
    x = np.array([pooled(rows[p], n, vectors.matrix) for p, n in zip(pairs, again)], float)
    mean, scale = x[~apart].mean(0), x[~apart].std(0) + 1e-3
    x = np.clip((x - mean) / scale, -8, 8)
    params = _train(x[~apart], y[~apart])
    z, yz = (_logit(params, x[apart]), y[apart]) if apart.any() else (_logit(params, x), y)
    losses = {t: float(np.mean(np.logaddexp(0, -np.where(yz == 1, z, -z) / t))) for t in np.geomspace(0.25, 8, 41)}
    return {"vectors": vectors, "mean": mean, "scale": scale, "params": params, "temperature": min(losses, key=losses.get)}


def scores(model: dict | None, texts) -> np.ndarray:
    if model is None:
        return np.ones(len(texts))
    x = np.array([model["vectors"].pool(t) for t in texts], float).reshape(len(texts), 3 * DIM)
    z = _logit(model["params"], np.clip((x - model["mean"]) / model["scale"], -8, 8)) / model["temperature"]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score_quality(docs: DataFrame, model: bytes | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted; model is pickled, as `trained` gives it."""
    bound = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary of the bounded sample

    def compute():
        m = pickle.loads(bound.value) if bound.value else None

        def run(texts):
            s = scores(m, texts)
            return s, (s >= threshold).astype(np.int32)

        return run

    rows = docs.select("doc_id", F.coalesce(crc_mod5() == 0, F.lit(False)).alias("held_out"), "text")
    return with_columns(rows, "text", "score double, predicted int", compute)


def filter_quality(docs: DataFrame, model: bytes | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs without those that score below threshold."""
    bound = docs.sparkSession.sparkContext.broadcast(model)

    def verdicts():
        m = pickle.loads(bound.value) if bound.value else None
        return lambda texts: scores(m, texts) >= threshold

    return kept_rows(docs, "text", verdicts)


def trained(docs: DataFrame, labels: DataFrame) -> bytes | None:
    return fitted(labelled_sample(docs, labels, "quality", PER_CLASS, LONGEST), fit)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_quality(docs, trained(docs, table(spark, sf_dir, "labels")))
