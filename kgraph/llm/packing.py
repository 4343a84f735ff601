"""Packing by cutting-stock column generation.

A document of L ids is cut into full sequences, a part that is a multiple of `grid`, and a tail shorter than
`grid`; so piece lengths take at most seq_len / grid + grid values, whatever the corpus holds. Their histogram
(bounded, on the driver) is the demand of a linear program over patterns, i.e. multisets of lengths that fit one
sequence. Revised simplex solves it; a knapsack dynamic program over exact sums prices columns. A pattern costs
what its sequence takes when padded: seq_len, or its own sum where that is a power of two. Multiplicities
are rounded down, what is left goes first-fit into further patterns, and pieces, ranked within their length,
take the slots of the patterns in order.

Defined results: null or empty text is one id (the end mark); repeated rows are separate documents; an empty
table gives no pieces; texts of any length are cut.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgraph.llm.common import buckets_for, materialise, ranked, slices, table

SEQ_LEN, GRID, END_ID = 2048, 16, 1
CACHED_WORDS, LONGEST_CACHED = 300_000, 40
#: marks that may follow a letter without changing how it is read
_MARKS = ",.!?;:#*$%&"
#: capitals whose small form depends on the place, or is longer
_SPECIAL_CASE = re.compile("[\u03a3\u0130]|<[|]")
#: letters below this are alphabets whose words the tests hold against the tokenizer, letter by letter
_PROVEN = "\u0530"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of whole texts as little-endian uint32 bytes.

    A vocabulary that lowers case, drops white space and never merges across it, nor across the border between a letter
    and a mark, gives a text the ids of its words. Words are looked up in a bounded cache. Of a word whose letters are
    small, composed and proven, the letters go straight to the merge model, in its byte alphabet, and the marks after
    them are looked up apart; all other words are encoded as they stand, and with other vocabularies whole texts are.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok, self.cache, self.recent = Tokenizer.from_file(path), {}, []
        made = json.loads(self.tok.to_str())
        steps = [x["type"] for x in (made.get("normalizer") or {}).get("normalizers", [])]
        self.by_word = steps == ["NFC", "Replace", "Lowercase"] and made["model"].get("end_of_word_suffix") == "</w>"
        self.merge = self.tok.model.tokenize
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # the public byte alphabet: these bytes stand for themselves
        rest = [b for b in range(256) if b not in set(shown)]
        self.byte = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}

    def _plain(self, w: str) -> bool:
        return w.isalpha() and (w.isascii() or max(w) < _PROVEN and unicodedata.is_normalized("NFC", w)) and w.lower() == w

    def _word(self, w: str) -> bytes:
        if self._plain(w):
            units = w if w.isascii() else "".join(map(self.byte.__getitem__, w.encode()))
            return array("I", [t.id for t in self.merge(units)]).tobytes()
        letters = w.rstrip(_MARKS)
        if letters and letters is not w and self._plain(letters):
            return self._known(letters) + self._known(w[len(letters) :])
        return array("I", self.tok.encode(w, add_special_tokens=False).ids).tobytes()

    def _known(self, w: str) -> bytes:
        got = self.cache.get(w)
        if got is None:
            got = self._word(w)
            if len(w) <= LONGEST_CACHED:
                self.cache[w] = got
        return got

    def __call__(self, text: str | None) -> bytes:
        text = text or ""
        if not self.by_word:
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if not _SPECIAL_CASE.search(text):
            text = text.lower()
        for blank in "\t\n\v\f\r":
            text = text.replace(blank, " ")
        words = text.split(" ")
        distinct = set(words)
        distinct.discard("")
        if len(self.cache) > CACHED_WORDS:  # keep what the last texts used
            self.cache = {w: self.cache[w] for used in self.recent for w in used if w in self.cache}
        self.recent = [*self.recent[-40:], distinct]
        ids = {w: self._known(w) for w in distinct}
        ids[""] = b""
        return b"".join(map(ids.__getitem__, words))


def cuts(total: int, seq_len: int = SEQ_LEN, grid: int = GRID) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces."""
    full, rest = divmod(total, seq_len)
    out = [(k * seq_len, seq_len) for k in range(full)]
    at, even = full * seq_len, rest // grid * grid
    if even:
        out.append((at, even))
    if rest - even:
        out.append((at + even, rest - even))
    return out


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str, seq_len: int = SEQ_LEN, grid: int = GRID, with_ids: bool = False) -> DataFrame:
    """Tokenise whole texts and cut them; one row per piece, with its ids if asked for."""
    end = np.array([END_ID], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *(["ids"] if with_ids else [])]

    def run(batches):
        ids_of = WordIds(path)
        for piece in slices(batches):
            at, rows = [], []
            for i, text in enumerate(piece.column(1).to_pylist()):
                ids = ids_of(text) + end
                n = len(ids) // 4
                for start, length in cuts(n, seq_len, grid):
                    part = ids[4 * start : 4 * (start + length)]
                    at.append(i)
                    rows.append((start, length, zlib.crc32(part), n, *([part] if with_ids else [])))
            columns = [pa.array(c, pa.binary() if k == 4 else pa.int64()) for k, c in enumerate(zip(*rows))]
            yield pa.RecordBatch.from_arrays([piece.column(0).take(pa.array(at, pa.int64())), *columns], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE + (", ids binary" if with_ids else ""))


def padded(total: int, seq_len: int = SEQ_LEN) -> int:
    return total if total & (total - 1) == 0 else seq_len


def _price(lens: np.ndarray, duals: np.ndarray, costs: np.ndarray):
    """Unbounded knapsack over exact sums: the pattern with the largest value less cost."""
    cap = len(costs) - 1
    value, choice = np.full(cap + 1, -np.inf), np.full(cap + 1, -1, int)
    value[0] = 0.0
    for s in range(1, cap + 1):
        upto = np.searchsorted(lens, s, side="right")
        if upto:
            cand = value[s - lens[:upto]] + duals[:upto]
            j = int(cand.argmax())
            value[s], choice[s] = cand[j], j
    gain = value - costs
    gain[0] = -np.inf
    s = int(gain.argmax())
    best, column = float(gain[s]), np.zeros(len(lens))
    ratio = float((value[1:] / costs[1:]).max())
    while s > 0:
        column[choice[s]] += 1
        s -= lens[choice[s]]
    return best, column, ratio


def solve_patterns(hist: dict[int, int], seq_len: int = SEQ_LEN, max_iter: int = 4000, gap: float = 2e-4) -> list[tuple[dict[int, int], int]]:
    """(pattern, how often): patterns map length to count; together they hold hist exactly.

    Stops when the dual bound is within `gap` of the program's value, or after max_iter pivots.
    """
    lens = np.array(sorted(k for k, v in hist.items() if v), int)
    if not len(lens):
        return []
    need = np.array([hist[int(k)] for k in lens], float)
    costs = np.array([0.0] + [padded(s, seq_len) for s in range(1, seq_len + 1)])
    fit = seq_len // lens
    columns = np.diag(fit.astype(float))
    cost = np.array([costs[f * k] for f, k in zip(fit, lens)])
    inverse, x = np.diag(1.0 / fit), need / fit
    for step in range(max_iter):
        duals = cost @ inverse
        best, column, ratio = _price(lens, duals, costs)
        total = float(cost @ x)
        if best <= 1e-7 or total - float(duals @ need) / max(ratio, 1.0) <= gap * total:
            break
        d = inverse @ column
        up = d > 1e-9
        if not up.any():
            break
        ratios = np.where(up, x / np.where(up, d, 1.0), np.inf)
        i = int(ratios.argmin())
        theta = ratios[i]
        x -= theta * d
        x[i] = theta
        np.maximum(x, 0.0, out=x)
        columns[:, i], cost[i] = column, costs[int(column @ lens)]
        row = inverse[i] / d[i]
        inverse -= np.outer(d, row)
        inverse[i] = row
        if step % 300 == 299:
            inverse = np.linalg.inv(columns)
            x = np.maximum(inverse @ need, 0.0)
    left = {int(k): int(hist[int(k)]) for k in lens}
    out = []
    for i in np.argsort(-x):
        pattern = {int(lens[j]): int(columns[j, i]) for j in np.nonzero(columns[:, i])[0]}
        n = min([int(x[i] + 1e-6), *(left[k] // a for k, a in pattern.items())])
        if n > 0:
            out.append((pattern, n))
            for k, a in pattern.items():
                left[k] -= a * n
    while any(left.values()):  # what rounding left over: longest first, the same pattern as often as it lasts
        space, pattern = seq_len, {}
        for k in sorted(left, reverse=True):
            if a := min(left[k], space // k):
                pattern[k] = a
                space -= a * k
        n = min(left[k] // a for k, a in pattern.items())
        out.append((pattern, n))
        for k, a in pattern.items():
            left[k] -= a * n
    return out


def slots(patterns: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """Per length, rows of (first rank, slots per sequence, first sequence, offset of the first slot)."""
    rows: dict[int, list] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for pattern, n in patterns:
        at = 0
        for k in sorted(pattern, reverse=True):
            a = pattern[k]
            rows.setdefault(k, []).append((taken.get(k, 0), a, sequence, at))
            taken[k] = taken.get(k, 0) + a * n
            at += a * k
        sequence += n
    return {k: np.array(v, np.int64) for k, v in rows.items()}


def pack(cut: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """cut (columns of PIECE, materialised) with sequence_id and offset.

    Full pieces are sequences of their own and need no rank: they are numbered after the patterns' sequences, by task.
    """
    hist = {int(r["length"]): int(r["n"]) for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # seq_len rows at most
    hist.pop(seq_len, None)
    patterns = solve_patterns(hist, seq_len)
    place, sequences = slots(patterns), sum(n for _, n in patterns)
    full = cut.where(F.col("length") == seq_len).withColumns({"sequence_id": F.monotonically_increasing_id() + F.lit(sequences), "offset": F.lit(0).cast("long")})
    by_rank = ranked(cut.where(F.col("length") != seq_len), ["length"], "doc_id", ["doc_id", "start", "doc_tokens", "ids_crc32"], buckets_for(max(hist.values(), default=0)))
    kept = len(cut.columns)

    def run(batches):
        for batch in batches:
            length, rank = (batch.column(i).to_numpy(zero_copy_only=False) for i in (cut_length, kept))
            rank = rank - 1
            seq, off = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for k in np.unique(length):
                at, s = np.nonzero(length == k)[0], place[int(k)]
                row = s[np.searchsorted(s[:, 0], rank[at], side="right") - 1]
                t = rank[at] - row[:, 0]
                seq[at], off[at] = row[:, 2] + t // row[:, 1], row[:, 3] + t % row[:, 1] * k
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(kept)), pa.array(seq), pa.array(off)], names=names)

    cut_length, names = cut.columns.index("length"), [*cut.columns, "sequence_id", "offset"]
    schema = T.StructType([*cut.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    return by_rank.select(*cut.columns, "_rank").mapInArrow(run, schema).unionByName(full)


def pack_documents(docs: DataFrame, path: str | None = None, seq_len: int = SEQ_LEN, grid: int = GRID, with_ids: bool = False) -> DataFrame:
    cut = materialise(pieces(docs, path or tokenizer_path(), seq_len, grid, with_ids), "pieces")
    return pack(cut, seq_len)


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
