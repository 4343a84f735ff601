"""Column functions on text, time labels and arrays."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE_END = r"[.!?।]+"


def bind(value: Column, body) -> Column:
    """body(value) with value computed once per row, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def time_label(seconds: Column) -> Column:
    """M:SS; minutes are unbounded."""
    s = F.floor(seconds).cast("long")
    return F.concat(F.floor(s / 60).cast("string"), F.lit(":"), F.lpad((s % 60).cast("string"), 2, "0"))


def label_seconds(label: Column, otherwise: int = 0) -> Column:
    """Seconds of an M:SS label; `otherwise` for anything else."""
    parts = F.split(label, ":")
    value = F.when(F.size(parts) == 2, parts[0].try_cast("int") * 60 + parts[1].try_cast("int"))
    return F.coalesce(value, F.lit(otherwise))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, SENTENCE_END), lambda s: F.trim(s)), lambda s: s != "")


def conjuncts(fragment: Column) -> Column:
    """Parts of a fragment between aur, and, or, ya, evam."""
    return F.transform(F.split(F.lower(F.trim(fragment)), r"\s+(?:aur|and|or|ya|evam)\s+"), lambda x: F.trim(x))


def title_case(name: Column) -> Column:
    """Capital after every non-letter: b-tree is B-Tree, o(n) is O(N)."""
    parts = F.regexp_extract_all(F.replace(name, F.lit("_"), F.lit(" ")), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30)))), "")


def ordered_text(order: Column, text: Column, sep: str = " ") -> Column:
    """Aggregate: the texts of a group joined in order."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), text.alias("t")))), lambda x: x["t"]), sep)


def round_half(x: Column, digits: int) -> Column:
    """Rounding of the exact binary value, as Python's round does it: 2.675 is 2.67 at two digits. For exports only."""
    return F.pandas_udf(lambda s: pd.Series([None if pd.isna(v) else round(v, digits) for v in s], dtype="float64"), "double")(x)


def chunk_text(text: str | None, size: int, overlap: float) -> list[str]:
    """Overlapping chunks; a chunk that would cut a word ends at its last space beyond the middle."""
    text = text or ""
    out, start, step_back = [], 0, int(size * overlap)
    while start < len(text):
        end = min(start + size, len(text))
        if end < len(text):
            space = text.rfind(" ", start, end)
            if space > start + size // 2:
                end = space
        out.append(text[start:end])
        if end >= len(text):
            break
        start = max(end - step_back, start + 1)
    return out


def chunks(text: Column, size: int = 25_000, overlap: float = 0.2) -> Column:
    return F.pandas_udf(lambda s: pd.Series([chunk_text(t, size, overlap) for t in s]), "array<string>")(text)


def _braces(raw: str) -> str | None:
    """The first balanced {...} span, strings respected."""
    start = raw.find("{")
    depth, quoted, escaped = 0, False, False
    for i in range(start, len(raw)) if start >= 0 else ():
        c = raw[i]
        if quoted:
            quoted = escaped or c != '"'
            escaped = c == "\\" and not escaped
        elif c == '"':
            quoted = True
        elif c in "{}":
            depth += 1 if c == "{" else -1
            if depth == 0:
                return raw[start : i + 1]
    return None


_FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.S)


def repair_json(raw: str | None) -> str:
    """The JSON object in a reply: as it is, from a fenced block, from a balanced brace span, or '{}'."""
    raw = raw or ""
    fence = _FENCE.search(raw)
    for candidate in (raw, fence[1] if fence else None, _braces(raw)):
        try:
            if candidate and isinstance(json.loads(candidate), dict):
                return candidate.strip()
        except ValueError:
            pass
    return "{}"


def repaired(raw: Column) -> Column:
    """repair_json; replies that parse as they are never leave the JVM's answer."""
    whole = F.when(F.get_json_object(raw, "$").startswith("{"), F.trim(raw))
    slow = F.pandas_udf(lambda s: pd.Series([repair_json(x) for x in s]), "string")
    return F.coalesce(whole, slow(raw))
