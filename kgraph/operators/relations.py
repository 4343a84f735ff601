"""Prerequisite edges: cue patterns, temporal order, co-occurrence and their merge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgraph.functions.dims import ODD_CASES, anchored, needed, pieces
from kgraph.functions.scalars import conjuncts, sentences

#: fixed values: what edges without a sentence give as evidence
TEMPORAL_EVIDENCE = "temporal order: %s mentioned at %ds, %s at %ds"
COOCCURRENCE_EVIDENCE = "co-occurrence: both '%s' and '%s' appear in same segment"
EDGE = ["video_id", "src", "dst", "relation", "confidence", "evidence", "timestamp", "detection_method"]


def sentence_table(segments: DataFrame) -> DataFrame:
    """video_id, seg_id, variant (0 normalised, 1 original), sent_idx, sentence, timestamp_label."""
    variants = [F.struct(F.lit(0).alias("variant"), F.col("text").alias("t"))]
    if "original_text" in segments.columns:
        variants.append(F.struct(F.lit(1).alias("variant"), F.when(F.col("original_text") != F.col("text"), F.col("original_text")).alias("t")))
    v = segments.select("video_id", "seg_id", "timestamp_label", F.explode(F.array(*variants)).alias("v")).where("v.t IS NOT NULL")
    return v.select("video_id", "seg_id", "timestamp_label", F.col("v.variant").alias("variant"), F.posexplode(sentences(F.col("v.t"))).alias("sent_idx", "sentence"))


def cue_matches(sents: DataFrame, cues: list[tuple[str, str, float]]) -> DataFrame:
    """One row per match of a cue in a sentence: pat_idx, direction, confidence, match_idx, first, second.

    Patterns are literals, so each is compiled once per task; they run in one pass over the sentences, and only where
    all pieces of the cue are found, first by plain search of what the pieces need.
    """
    found = []
    either = lambda tests: reduce(Column.__or__, tests)
    rows = sents.withColumns({"_low": F.lower("sentence"), "_odd": either([F.contains("sentence", F.lit(c)) for c in ODD_CASES])})
    for i, (pattern, direction, confidence) in enumerate(cues):
        p = F.lit(f"(?iU){anchored(pattern)}")
        both = F.zip_with(F.regexp_extract_all("sentence", p, F.lit(1)), F.regexp_extract_all("sentence", p, F.lit(2)), lambda x, y: F.struct(x.alias("first"), y.alias("second")))
        plain = [F.col("_odd") | either([F.contains("_low", F.lit(t)) for t in texts]) for x in pieces(pattern) if (texts := needed(x))]
        gates = [*plain, *(F.col("sentence").rlike(f"(?iU){x}") for x in pieces(pattern))]
        hits = F.when(reduce(Column.__and__, gates, F.lit(True)), both)
        found.append(F.struct(F.lit(i).alias("pat_idx"), F.lit(direction).alias("direction"), F.lit(float(confidence)).alias("confidence"), hits.alias("hits")))
    rows = rows.select(*sents.columns, F.explode(F.filter(F.array(*found), lambda f: F.size(f["hits"]) > 0)).alias("f"))
    rows = rows.select(*sents.columns, "f.pat_idx", "f.direction", "f.confidence", F.posexplode("f.hits").alias("match_idx", "h"))
    return rows.select(*sents.columns, "pat_idx", "direction", "confidence", "match_idx", "h.first", "h.second")


def fragment_concepts(fragments: DataFrame, concepts: DataFrame) -> DataFrame:
    """frag_id, video_id, fragment -> frag_id, part, name: per conjunct the equal concept, else the longest it holds, else the earlier ranked.

    A fragment none of whose conjuncts matches is tried as a whole.
    """
    whole = F.lower(F.trim(F.col("fragment")))
    parts = fragments.select("frag_id", "video_id", F.explode(F.concat(F.transform(conjuncts(F.col("fragment")), lambda p, i: F.struct(i.alias("part"), p.alias("p"))), F.array(F.struct(F.lit(1_000_000).alias("part"), whole.alias("p"))))).alias("x")).select("frag_id", "video_id", "x.part", "x.p")
    hit = parts.join(concepts.select("video_id", "name", "concept_rank"), "video_id").where(F.contains("p", F.col("name")))
    best = hit.groupBy("frag_id", "part").agg(F.max_by("name", F.struct((F.col("p") == F.col("name")).alias("e"), F.length("name").alias("l"), (-F.col("concept_rank")).alias("r"))).alias("name"))
    fallback = F.col("part") == 1_000_000
    any_part = F.max(F.when(~fallback, 1).otherwise(0)).over(Window.partitionBy("frag_id"))
    best = best.withColumn("_any", any_part).where(~fallback | (F.col("_any") == 0))
    return best.groupBy("frag_id", "name").agg(F.min("part").alias("part"))


def pattern_edges(segments: DataFrame, concepts: DataFrame, cues) -> DataFrame:
    """Edges of cue matches; per pair the first match in (segment, variant, sentence, cue, match) order."""
    m = cue_matches(sentence_table(segments), cues).withColumn("match_id", F.struct("video_id", "seg_id", "variant", "sent_idx", "pat_idx", "match_idx"))
    side = lambda c: m.select(F.struct("match_id", F.lit(c).alias("side")).alias("frag_id"), "video_id", F.col(c).alias("fragment"))
    named = fragment_concepts(side("first").unionByName(side("second")), concepts)
    a = named.where("frag_id.side = 'first'").select(F.col("frag_id.match_id").alias("match_id"), F.col("name").alias("a"), F.col("part").alias("pa"))
    b = named.where("frag_id.side = 'second'").select(F.col("frag_id.match_id").alias("match_id"), F.col("name").alias("b"), F.col("part").alias("pb"))
    pairs = m.join(a, "match_id").join(b, "match_id").where("a <> b")
    forward = F.col("direction") == "forward"
    pairs = pairs.withColumns({"src": F.when(forward, F.col("a")).otherwise(F.col("b")), "dst": F.when(forward, F.col("b")).otherwise(F.col("a"))})
    order = F.struct("seg_id", "variant", "sent_idx", "pat_idx", "match_idx", "pa", "pb")
    best = pairs.groupBy("video_id", "src", "dst").agg(F.min_by(F.struct("confidence", "sentence", "timestamp_label"), order).alias("m"))
    return best.select("video_id", "src", "dst", F.lit("prerequisite").alias("relation"), "m.confidence", F.col("m.sentence").alias("evidence"), F.col("m.timestamp_label").alias("timestamp"), F.lit("pattern_matching").alias("detection_method"))


def temporal_edges(firsts: DataFrame, successors: int = 3, gap: int = 30) -> DataFrame:
    """video_id, name, first_sec, first_mention -> edges to the next `successors` concepts that start at least `gap` seconds later."""
    w = Window.partitionBy("video_id").orderBy("first_sec", "name")
    seen = firsts.where("first_sec IS NOT NULL")
    nexts = F.array(*[F.lead(F.struct("name", "first_sec", "first_mention"), k).over(w) for k in range(1, successors + 1)])
    e = seen.withColumn("n", nexts).select("video_id", F.col("name").alias("src"), "first_sec", F.explode("n").alias("n")).where("n IS NOT NULL")
    diff = F.col("n.first_sec") - F.col("first_sec")
    conf = F.round(F.least(F.lit(0.55), F.lit(0.35) + diff / F.lit(600) * F.lit(0.2)), 4)
    evidence = F.format_string(TEMPORAL_EVIDENCE, "src", "first_sec", F.col("n.name"), F.col("n.first_sec"))
    return e.where(diff >= gap).select("video_id", "src", F.col("n.name").alias("dst"), F.lit("prerequisite").alias("relation"), conf.alias("confidence"), evidence.alias("evidence"), F.lit("").alias("timestamp"), F.lit("temporal_order").alias("detection_method"))


def cooccurrence_edges(found: DataFrame, firsts: DataFrame, confidence: float = 0.45) -> DataFrame:
    """Pairs mentioned in one segment, from the earlier first mention to the later; the first segment is the evidence."""
    m = found.select("video_id", "seg_id", "timestamp_label", "name").join(firsts.where("first_sec IS NOT NULL").select("video_id", "name", "first_sec"), ["video_id", "name"])
    b = m.select("video_id", "seg_id", F.col("name").alias("dst"), F.col("first_sec").alias("sec_b"))
    pairs = m.withColumnRenamed("name", "src").join(b, ["video_id", "seg_id"]).where("first_sec < sec_b")
    best = pairs.groupBy("video_id", "src", "dst").agg(F.min_by("timestamp_label", "seg_id").alias("timestamp"))
    return best.select("video_id", "src", "dst", F.lit("prerequisite").alias("relation"), F.lit(confidence).alias("confidence"), F.format_string(COOCCURRENCE_EVIDENCE, "src", "dst").alias("evidence"), "timestamp", F.lit("cooccurrence").alias("detection_method"))


def priority_merge(frames: list[DataFrame]) -> DataFrame:
    """Union in which an earlier frame's pair hides a later one's."""
    out = None
    for i, f in enumerate(frames):
        f = f.select(*EDGE).withColumn("_prio", F.lit(i))
        out = f if out is None else out.unionByName(f)
    best = out.groupBy("video_id", "src", "dst").agg(F.min_by(F.struct("relation", "confidence", "evidence", "timestamp", "detection_method"), "_prio").alias("e"))
    return best.select("video_id", "src", "dst", "e.*")


def keep_confident(edges: DataFrame, least: float = 0.4) -> DataFrame:
    """Applied after the merge, so that a weak temporal edge still hides a co-occurrence; judged at four digits."""
    return edges.where(F.floor(F.col("confidence") * 10_000 + 0.5) / 10_000 >= least)


def detect_relations(segments: DataFrame, concepts: DataFrame, found: DataFrame, cues, cfg) -> DataFrame:
    firsts = concepts.select("video_id", "name", "first_sec", "first_mention")
    merged = priority_merge([pattern_edges(segments, concepts, cues), temporal_edges(firsts, cfg.temporal_successors, cfg.temporal_gap), cooccurrence_edges(found, firsts, cfg.cooccurrence_confidence)])
    return keep_confident(merged, cfg.min_confidence)
