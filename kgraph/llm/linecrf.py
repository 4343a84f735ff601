"""Quality rules: a linear-chain conditional random field over lines, decoded with Viterbi.

Lines carry shape features (length, symbols, capitals, digits, table bars, repeats, ends of sentences). The
field has two states, content and boilerplate. It is trained by gradient ascent on the likelihood of labelled documents'
lines: those of low-quality documents count as boilerplate, those of others as content. As a document has one label, chains
that join a good and a bad document teach the steps between the states. A document is kept if
no base rule fails and the lines decoded as content hold at least KEEP of its word characters.

Fitted in one executor task on at most PER_CLASS labelled documents of each class (of up to LONGEST characters and LINES lines), whose crc32
mod 5 is not 0; counting and decoding read whole texts of any length.

Defined results: a null text has no words and fails the base rule; lines without words are skipped; without labels of both
classes only the base rules decide; repeated rows give repeated results; an empty table gives an empty result;
other columns are not read by `line_rules` and pass through `filter_lines` as they are.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from kgraph.llm.common import fitted, kept_rows, labelled_sample, table, with_columns

PER_CLASS, LONGEST, LINES = 600, 60_000, 80
KEEP, MIN_WORDS, MAX_REPEAT = 0.5, 10, 20
STEPS, RATE, RIDGE = 80, 0.1, 1e-3
BLANKS, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
N_FEATURES = 16


def line_features(line: str, words: list[str], repeated: bool) -> list[float]:
    n, chars = len(words), len(line)
    symbols = sum(map(line.count, SYMBOLS))
    letters = sum(map(str.isalpha, words))
    upper = sum(map(str.isupper, words))
    same = sum(map(str.__eq__, words[1:], words))
    last = words[-1][-1]
    return [1.0, n < 3, n < 8, n >= 20, symbols > 0.02 * chars, symbols > 0.08 * chars, line.count("|") > 2, upper > 0.5 * n, line.count("!") > 0.3 * n, same > 0.15 * n, same > 0.5 * n, letters < 0.4 * n, last in ".!?", repeated, sum(map(str.isdigit, words)) > 0.2 * n, "http" in line or "©" in line or "@" in line]


def split_words(text: str) -> list[str]:
    for b in BLANKS[1:]:
        text = text.replace(b, " ")
    return [w for w in text.split(" ") if w]


def featurise(text: str):
    """(matrix, word characters) of the lines that hold a word."""
    rows, weights, seen = [], [], set()
    for line in text.split("\n"):
        words = split_words(line)
        if words:
            rows.append(line_features(line, words, line in seen))
            weights.append(sum(map(len, words)))
            seen.add(line)
    return np.array(rows, float).reshape(-1, N_FEATURES), np.array(weights, float)


def chains(sample: list[tuple[str, int]]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(features, states) of training chains: each document's lines, and lines of a good and of a bad document one after the other."""
    one = [(x, np.full(len(x), 0 if y else 1)) for t, y in sample if 0 < len(x := featurise(t)[0]) <= LINES]
    good, bad = [c for c in one if c[1][0] == 0], [c for c in one if c[1][0] == 1]
    if not good or not bad:
        return []
    both = []
    for i in range(max(len(good), len(bad))):
        pair = [good[i % len(good)], bad[i % len(bad)]]
        both.append(tuple(np.concatenate(part) for part in zip(*(pair if i % 2 else pair[::-1]))))
    return one + both


def fit(sample: list[tuple[str, int]]) -> dict | None:
    """Weights of (features -> boilerplate) and transitions; label 1 is content."""
    docs = chains(sample)
    if not docs:
        return None
    width = max(len(x) for x, _ in docs)
    x = np.zeros((len(docs), width, N_FEATURES))
    mask, y = np.zeros((len(docs), width)), np.zeros((len(docs), width))
    for i, (m, states) in enumerate(docs):
        x[i, : len(m)], mask[i, : len(m)], y[i, : len(m)] = m, 1, states
    share = np.array([states.mean() for _, states in docs])  # of boilerplate lines
    weight = np.where(share == 1, 0.5 / max((share == 1).mean(), 1e-9), np.where(share == 0, 0.5 / max((share == 0).mean(), 1e-9), 0.5)) / mask.sum(1)
    step_to = [[(mask[:, 1:] * (y[:, :-1] == a) * (y[:, 1:] == b)).sum(1) for b in (0, 1)] for a in (0, 1)]
    w, trans = np.zeros(N_FEATURES), np.zeros((2, 2))
    mw, vw, mt, vt = np.zeros_like(w), np.zeros_like(w), np.zeros_like(trans), np.zeros_like(trans)
    for step in range(1, STEPS + 1):
        e = np.zeros((len(docs), width, 2))
        e[..., 1] = x @ w
        forward, backward = np.zeros_like(e), np.zeros_like(e)
        forward[:, 0] = e[:, 0]
        for t in range(1, width):
            a = np.logaddexp(forward[:, t - 1, 0, None] + trans[0], forward[:, t - 1, 1, None] + trans[1]) + e[:, t]
            forward[:, t] = np.where(mask[:, t, None] > 0, a, forward[:, t - 1])
        z = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        for t in range(width - 2, -1, -1):
            b = np.logaddexp(trans[:, 0] + e[:, t + 1, 0, None] + backward[:, t + 1, 0, None], trans[:, 1] + e[:, t + 1, 1, None] + backward[:, t + 1, 1, None])
            backward[:, t] = np.where(mask[:, t + 1, None] > 0, b, 0.0)
        p = np.exp(np.clip(forward + backward - z[:, None, None], -50, 0)) * mask[..., None]
        gw = np.einsum("i,it,itf->f", weight, (y - p[..., 1]) * mask, x) / len(docs) - RIDGE * w
        gt = -RIDGE * trans
        for a in (0, 1):
            for b in (0, 1):
                pair = np.exp(np.clip(forward[:, :-1, a] + trans[a, b] + e[:, 1:, b] + backward[:, 1:, b] - z[:, None], -50, 0)) * mask[:, 1:]
                gt[a, b] += (weight * (step_to[a][b] - pair.sum(1))).sum() / len(docs)
        for q, g, m, v in ((w, gw, mw, vw), (trans, gt, mt, vt)):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            q += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return {"w": w, "trans": trans}


def viterbi(scores: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """States (0 content, 1 boilerplate) of the best path; scores are of state 1 against state 0."""
    n = len(scores)
    (t00, t01), (t10, t11) = trans.tolist()
    c, b = 0.0, float(scores[0])
    from_b_to_c, from_b_to_b = [False] * n, [False] * n
    for i, s in enumerate(scores[1:].tolist(), 1):
        cc, bc, cb, bb = c + t00, b + t10, c + t01, b + t11
        from_b_to_c[i], from_b_to_b[i] = bc > cc, bb > cb
        c, b = max(cc, bc), max(cb, bb) + s
    out = np.zeros(n, int)
    state = b > c
    for i in range(n - 1, -1, -1):
        out[i] = state
        state = from_b_to_b[i] if state else from_b_to_c[i]
    return out


def content_share(text: str, model: dict | None) -> float:
    x, chars = featurise(text)
    if model is None or not len(x):
        return 1.0
    return float(chars[viterbi(x @ model["w"], model["trans"]) == 0].sum() / chars.sum())


def repeat_words(words: list[str]) -> int:
    """Words in 5-word windows found twice or more."""
    n = len(words)
    if n < 6:
        return 0
    h = np.fromiter(map(hash, words), np.int64, n).view(np.uint64)
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        g = h[: n - 4].copy()
        for k in range(1, 5):
            g = g * np.uint64(0xD6E8FEB86659FD93) + h[k : n - 4 + k]
    order = np.argsort(g, kind="stable")
    s = g[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(n - 4, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + 1, int)
    edge[: n - 4] += twice
    edge[5 : n + 1] -= twice
    return int((np.cumsum(edge)[:n] > 0).sum())


def base_counts(text: str):
    words = split_words(text)
    seen, dup = set(), 0
    if "\n" in text:
        for line in text.split("\n"):
            if line.strip(BLANKS):
                if line in seen:
                    dup += 1
                else:
                    seen.add(line)
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeat_words(words)


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def judge(text, model: dict | None):
    """The five counts, base_failed, kept and the content share."""
    text = text if isinstance(text, str) else ""
    counts = base_counts(text)
    failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT * counts[0]
    share = content_share(text, model)
    return (*counts, failed, not failed and share >= KEEP, share)


def line_rules(docs: DataFrame, model: bytes | None) -> DataFrame:
    """doc_id, the five counts, base_failed, kept and content_share; model is pickled, as `trained` gives it."""

    def compute():
        m = pickle.loads(model) if model else None
        return lambda texts: list(zip(*(judge(t, m) for t in texts))) or [[]] * 8

    return with_columns(docs.select("doc_id", "text"), "text", f"{COUNTS}, base_failed boolean, kept boolean, content_share double", compute)


def filter_lines(docs: DataFrame, model: bytes | None) -> DataFrame:
    """docs without those rejected."""

    def verdicts():
        m = pickle.loads(model) if model else None
        return lambda texts: [judge(t, m)[6] for t in texts]

    return kept_rows(docs, "text", verdicts)


def trained(docs: DataFrame, labels: DataFrame) -> bytes | None:
    return fitted(labelled_sample(docs, labels, "quality", PER_CLASS, LONGEST), fit)


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return line_rules(docs, trained(docs, table(spark, sf_dir, "labels")))
