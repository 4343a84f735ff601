"""Segments, lexicon normalisation and the cue scan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgraph.functions.dims import SCAN_CUES, escape, gate
from kgraph.functions.romanise import romanise
from kgraph.functions.scalars import bind, ordered_text, time_label

EDGE_MARKS = ".,!?;:()[]{}\"'"


def segments_from_text(texts: DataFrame, seconds: int = 10) -> DataFrame:
    """video_id, text -> segments: sentences at full stops, ten synthetic seconds each."""
    parts = F.filter(F.transform(F.split(F.replace(F.col("text"), F.lit("\n"), F.lit(" ")), r"\."), lambda x: F.trim(x)), lambda x: x != "")
    seg = texts.select("video_id", F.posexplode(parts).alias("seg_id", "text"))
    start = (F.col("seg_id") * seconds).cast("double")
    return seg.select("video_id", "seg_id", start.alias("start"), (start + seconds).alias("end"), "text", time_label(start).alias("timestamp_label"))


def segments_from_turns(turns: DataFrame, seconds: int = 10) -> DataFrame:
    """conv_id, turn, text -> segments, one per turn."""
    start = (F.col("turn") * seconds).cast("double")
    return turns.select(F.col("conv_id").alias("video_id"), F.col("turn").cast("int").alias("seg_id"), start.alias("start"), (start + seconds).alias("end"), "text", time_label(start).alias("timestamp_label"))


def full_texts(segments: DataFrame) -> DataFrame:
    return segments.groupBy("video_id").agg(ordered_text(F.col("seg_id"), F.col("text")).alias("full_text"))


def merge_lexicon_table(lexicon: DataFrame) -> DataFrame:
    """src, tgt by precedence: the last Hinglish entry, else the first Telugu one."""
    best = F.when(F.col("lang") == "hinglish", F.struct(F.lit(0).alias("p"), (-F.col("ord")).alias("o"))).otherwise(F.struct(F.lit(1).alias("p"), F.col("ord").alias("o")))
    return lexicon.groupBy("src").agg(F.min_by("tgt", best).alias("tgt"))


def phrase_replace(text: Column, lexicon: dict[str, str]) -> Column:
    """Phrases of several words with a target, longest first, each over the whole running text."""
    phrases = sorted(((k, v) for k, v in lexicon.items() if " " in k and v), key=lambda kv: (-len(kv[0]), kv[0]))
    if not phrases:
        return text
    rules = F.array(*[F.struct(F.lit(rf"(?iU)\b{escape(k)}\b").alias("pattern"), F.lit(v.replace("\\", "\\\\").replace("$", "\\$")).alias("target")) for k, v in phrases])
    return F.aggregate(rules, text, lambda acc, r: F.regexp_replace(acc, r["pattern"], r["target"]))


def word_replace(text: Column, lexicon: dict[str, str]) -> Column:
    """Words by the lexicon, marks around them kept; a word whose target is empty stays."""
    known = {k: v for k, v in lexicon.items() if v}
    if not known:
        return text
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv])
    marks = "".join("\\" + c for c in EDGE_MARKS)
    core = lambda w: F.regexp_replace(w, f"^[{marks}]+|[{marks}]+$", "")

    def word(w):
        target = F.element_at(table, F.lower(core(w)))
        around = F.concat(F.regexp_extract(w, r"^[^\p{L}\p{N}]*", 0), target, F.regexp_extract(w, r"[^\p{L}\p{N}]*$", 0))
        return F.when(target.isNotNull(), around).otherwise(w)

    return F.array_join(F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != ""), word), " ")


def normalise_text(text: Column, lexicon: dict[str, str]) -> Column:
    """Romanise, then phrases, then words; blank text stays as it is."""
    return F.when(F.trim(text) == "", text).otherwise(bind(phrase_replace(romanise(text), lexicon), lambda t: word_replace(t, lexicon)))


def normalise_segments(segments: DataFrame, lexicon: dict[str, str]) -> DataFrame:
    """Adds original_text. Where a segment came with one (two-pass transcripts) its text stays and the original is romanised."""
    has = "original_text" in segments.columns
    original = F.col("original_text") if has else F.lit(None).cast("string")
    dual = original.isNotNull()
    return segments.withColumns({"text": F.when(dual, F.col("text")).otherwise(normalise_text(F.col("text"), lexicon)), "original_text": F.when(dual, romanise(original)).otherwise(F.col("text")), "normalised": F.lit(True)})


def scan_cues(texts: DataFrame, cues=SCAN_CUES) -> DataFrame:
    """video_id, text -> every match of the scan cues, with offsets: matched_text, groups, template, start_pos, end_pos.

    A cue runs only on texts that hold its gate.
    """
    found = [F.when(F.col("text").rlike(f"(?iU){gate(p)}"), _cue_rows(p, template)) for p, template in cues]
    hits = texts.where(F.col("text").isNotNull()).select("video_id", F.explode(F.flatten(F.filter(F.array(*found), lambda x: x.isNotNull()))).alias("m"))
    return hits.select("video_id", "m.*")


def _cue_rows(pattern: str, template: str) -> Column:
    p, groups = F.lit(f"(?iU){pattern}"), re.compile(pattern).groups
    parts = [F.regexp_extract_all("text", p, F.lit(k)).alias(f"g{k}") for k in range(groups + 1)]
    gaps = F.call_function("split", F.col("text"), p, F.lit(-1)).alias("gaps")  # what stands before each match
    width = lambda x: F.aggregate(x, F.lit(0), lambda a, y: a + F.length(y))

    def rows(h: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            start = width(F.slice(h["gaps"], F.lit(1), i + 1)) + width(F.slice(h["g0"], F.lit(1), i))
            inside = F.array(*[F.get(h[f"g{k}"], i) for k in range(1, groups + 1)])
            return F.struct(m.alias("matched_text"), inside.alias("groups"), F.lit(template).alias("template"), start.alias("start_pos"), (start + F.length(m)).alias("end_pos"))

        return F.transform(h["g0"], one)

    return bind(F.struct(*parts, gaps), rows)
