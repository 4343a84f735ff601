"""Toxicity by compression distance.

Two zstandard dictionaries are trained apart: one on windows of ordinary documents, one on the toxic text of labelled toxic
documents, i.e. the words that stand in many contexts there and hardly any in ordinary ones (trained on all text of toxic
documents, which is ordinary but for a word here and there, the method hardly beats chance; README has figures). Each
window of a text is compressed with the ordinary dictionary, and with the toxic one before it, so that only toxic
matches differ; the bytes saved are the window's evidence. Two thresholds are calibrated on the windows of ordinary
documents. Evidence per document (largest savings, how unlikely they are among as many ordinary windows, windows beyond
the thresholds) is turned into a probability by a logistic calibration. For it, and for the choice among CONTRASTS, each half of the sample is seen
through dictionaries of the other; no choice looks at rows outside the sample.

Fitted in one executor task on at most PER_CLASS labelled documents of each class (of up to LONGEST characters), whose
crc32 mod 5 is not 0; scoring reads whole texts of any length.

Defined results: null and wordless texts have no evidence and get the calibration's score for none; without labels of
both classes every score is 0; repeated rows score alike; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

import pickle
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgraph.llm.common import crc_mod5, fitted, labelled_sample, table, with_columns

PER_CLASS, LONGEST = 1600, 60_000
WINDOW, LEVEL, GRAM = 8, 12, 6
ORDINARY_BYTES, TOXIC_BYTES = 16_384, 4_096
#: shares of ordinary windows whose savings may go beyond the two thresholds
EXCEED, FEATURES = (5e-3, 5e-4), 9
#: how many times as often as in ordinary text a gram of toxic words must occur; cross-validation chooses
CONTRASTS = (4, 6, 8)
_WORD = re.compile(r"\w+")


def windows(text: str | None) -> list[bytes]:
    words = _WORD.findall((text or "").lower())
    return [f" {' '.join(words[i : i + WINDOW])} ".encode("utf-8", "replace") for i in range(0, len(words), WINDOW)]


def contexts(texts: list[str]) -> dict[str, int]:
    """Character grams of words with the number of different (word before, word, word after) that hold them: copies count once."""
    seen = defaultdict(set)
    for t in texts:
        words = _WORD.findall(t.lower())
        for i, w in enumerate(words):
            k = hash((words[i - 1] if i else "", w, words[i + 1] if i + 1 < len(words) else ""))
            x = f" {w} "
            for j in range(max(1, len(x) - GRAM + 1)):
                seen[x[j : j + GRAM]].add(k)
    return {g: len(v) for g, v in seen.items()}


def _train(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; of samples too few to train on, their end."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, k=48, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class Meter:
    """Bytes that the toxic dictionary saves, per window."""

    def __init__(self, ordinary: bytes, toxic: bytes, tail=(1.0,)):
        import zstandard as z

        def compressor(content: bytes):
            d = z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            return z.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress

        self.plain, self.toxic, self.tail = compressor(ordinary), compressor(toxic + ordinary), np.array(tail)
        self.thresholds = [int(np.argmax(np.r_[self.tail <= e, True])) for e in EXCEED]

    def saved(self, text: str | None) -> np.ndarray:
        plain, toxic = self.plain, self.toxic
        return np.array([len(plain(w)) - len(toxic(w)) for w in windows(text)], float)

    def calibrate(self, texts: list[str]) -> "Meter":
        """tail[v]: the share of ordinary windows that save v bytes or more; the thresholds are where it falls to EXCEED."""
        every = np.concatenate([np.zeros(0), *map(self.saved, texts)])
        self.tail = np.array([((every >= v).sum() + 1) / (len(every) + 1) for v in range(int(every.max(initial=0)) + 2)])
        self.thresholds = [int(np.argmax(np.r_[self.tail <= e, True])) for e in EXCEED]
        return self

    def evidence(self, text: str | None) -> np.ndarray:
        """The three largest savings; how unlikely as many windows of ordinary text reach them; windows at or beyond the thresholds, also against what ordinary text has."""
        saved = self.saved(text)
        n = len(saved)
        if not n:
            return np.zeros(FEATURES)
        top = np.sort(np.r_[saved, 0, 0])[::-1][:3]
        chance = self.tail[np.clip(top, 0, len(self.tail) - 1).astype(int)] * n
        out = [top[0], top[1], top[2], *(np.maximum(0.0, -np.log(chance[i] / (i + 1))) for i in (0, 1, 2))]
        hits = [int((saved >= t).sum()) for t in self.thresholds]
        out += [min(hits[1], 5), *((h - n * e) / np.sqrt(n * e + 1) for h, e in zip(hits, EXCEED))]
        return np.array(out)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxic_text(toxic: list[str], ordinary: list[str], ct: dict[str, int], co: dict[str, int], contrast: float) -> list[bytes]:
    """Windows of the toxic text: the words with a gram that stands `contrast` times as often in toxic documents; ct and co are the texts' contexts."""
    ratio = max(1.0, len(toxic) / len(ordinary))
    least = max(3, 0.02 * len(toxic))
    marks = {g for g, n in ct.items() if n >= least and n > contrast * ratio * co.get(g, 0)}
    words = [w for t in toxic for w in _WORD.findall(t.lower()) if not marks.isdisjoint(f" {w} "[i : i + GRAM] for i in range(max(1, len(w) + 3 - GRAM)))]
    return [f" {' '.join(words[i : i + WINDOW])} ".encode("utf-8", "replace") for i in range(0, len(words), WINDOW)] or [b" "]


def _loss(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    z = x @ w
    return float(np.mean(np.logaddexp(0, np.where(y == 1, -z, z))))


def fit(sample: list[tuple[str, int]]) -> dict | None:
    """Dictionaries of the whole sample; contrast and calibration come from each half seen through the dictionaries of the other."""
    toxic, ordinary = [t for t, y in sample if y], [t for t, y in sample if not y]
    if not toxic or not ordinary:
        return None
    if min(len(toxic), len(ordinary)) < 2:
        toxic, ordinary = toxic * 2, ordinary * 2
    halves = [(toxic[i::2], ordinary[i::2]) for i in (0, 1)]
    seen = [(contexts(t), contexts(o)) for t, o in halves]
    plain = [_train([w for t in o for w in windows(t)], ORDINARY_BYTES) for _, o in halves]
    tried = []
    for contrast in CONTRASTS:
        x, y = [], []
        for (t, o), (ct, co), p, (other_t, other_o) in zip(halves, seen, plain, halves[::-1]):
            meter = Meter(p, _train(toxic_text(t, o, ct, co, contrast), TOXIC_BYTES)).calibrate(other_o)
            x += [meter.evidence(d) for d in (*other_t, *other_o)]
            y += [1.0] * len(other_t) + [0.0] * len(other_o)
        x, y = np.array(x), np.array(y)
        mean, scale = x.mean(0), x.std(0) + 1e-6
        x = np.c_[(x - mean) / scale, np.ones(len(x))]
        w = _logistic(x, y)
        tried.append((_loss(x, y, w), contrast, mean, scale, w))
    _, contrast, mean, scale, w = min(tried, key=lambda r: r[:2])
    both = [{g: a.get(g, 0) + b.get(g, 0) for g in a.keys() | b.keys()} for a, b in zip(*seen)]
    harsh = _train(toxic_text(toxic, ordinary, *both, contrast), TOXIC_BYTES)
    whole = _train([w for t in ordinary for w in windows(t)], ORDINARY_BYTES)
    tail = Meter(whole, harsh).calibrate(ordinary).tail
    return {"ordinary": whole, "toxic": harsh, "tail": tail, "contrast": contrast, "mean": mean, "scale": scale, "weights": w}


def scores(model: dict | None, texts, meter: Meter | None = None) -> np.ndarray:
    if model is None:
        return np.zeros(len(texts))
    meter = meter or Meter(model["ordinary"], model["toxic"], model["tail"])
    x = np.array([meter.evidence(t) for t in texts]).reshape(len(texts), FEATURES)
    z = np.c_[(x - model["mean"]) / model["scale"], np.ones(len(x))] @ model["weights"]
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def score_toxicity(docs: DataFrame, model: bytes | None) -> DataFrame:
    """doc_id, held_out, score, predicted; model is pickled, as `trained` gives it (some 20 KB)."""

    def compute():
        m = pickle.loads(model) if model else None
        meter = Meter(m["ordinary"], m["toxic"], m["tail"]) if m else None

        def run(texts):
            s = scores(m, texts, meter)
            return s, (s >= 0.5).astype(np.int32)

        return run

    rows = docs.select("doc_id", F.coalesce(crc_mod5() == 0, F.lit(False)).alias("held_out"), "text")
    return with_columns(rows, "text", "score double, predicted int", compute)


def trained(docs: DataFrame, labels: DataFrame) -> bytes | None:
    return fitted(labelled_sample(docs, labels, "toxic", PER_CLASS, LONGEST), fit)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, trained(docs, table(spark, sf_dir, "labels")))
