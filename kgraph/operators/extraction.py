"""Model-backed extraction: two passes over chunks with an injected client, JSON repair, matching and merging.

`client(prompt, json_mode)` returns the reply's text. A ValueError whose message names tokens or length is retried with the first
`retry_chars` characters, then without JSON mode; a chunk that still fails is skipped.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgraph.functions.romanise import romanise
from kgraph.functions.scalars import chunk_text, repaired
from kgraph.operators.concepts import mention_times, mentions
from kgraph.schemas import CONCEPT_REPLY, RELATION_REPLY

CONCEPT_PROMPT = "List the teaching concepts of this lecture transcript, 10 to 30 of them, as JSON with the keys domain and concepts (name, normalized_name, importance_score, difficulty, description).\n\nTranscript:\n{text}"
RELATION_PROMPT = "Given these concepts: {names}\nList which is a prerequisite of which in the transcript, as JSON with the key relationships (from, to, confidence, evidence).\n\nTranscript:\n{text}"
#: fixed values: abbreviations tried when no name matches
ABBREVIATIONS = {"bst": "binary search tree", "avl": "avl tree", "dsa": "data structure"}
Client = Callable[[str, bool], str]


def name_key(name: Column) -> Column:
    return F.replace(F.trim(F.lower(name)), F.lit("_"), F.lit(" "))


def ask(client: Client, template: str, text: str, retry_chars: int, **more) -> str | None:
    for part, json_mode in ((text, True), (text[:retry_chars], True), (text[:retry_chars], False)):
        try:
            return client(template.format(text=part, **more), json_mode)
        except ValueError as e:
            if not any(w in str(e).lower() for w in ("token", "length", "too large", "json")):
                return None
    return None


def chunk_table(texts: DataFrame, size: int = 25_000, overlap: float = 0.2) -> DataFrame:
    """video_id, chunk, text: romanised and cut into overlapping chunks."""

    def run(batches):
        for pdf in batches:
            rows = [(v, i, c) for v, t in zip(pdf["video_id"], pdf["text"]) for i, c in enumerate(chunk_text(t, size, overlap))]
            yield pd.DataFrame(rows, columns=["video_id", "chunk", "text"])

    return texts.select("video_id", romanise(F.col("full_text")).alias("text")).mapInPandas(run, "video_id string, chunk int, text string")


def _call(df: DataFrame, client: Client, template: str, retry_chars: int, extra: list[str]) -> DataFrame:
    def run(batches):
        for pdf in batches:
            out = [ask(client, template, t, retry_chars, **{k: pdf[k].iloc[i] for k in extra}) for i, t in enumerate(pdf["text"])]
            yield pdf[["video_id", "chunk", "text"]].assign(raw=out)

    return df.mapInPandas(run, "video_id string, chunk int, text string, raw string").where("raw IS NOT NULL")


def first_pass(parts: DataFrame, client: Client, retry_chars: int = 15_000) -> DataFrame:
    """video_id, chunk, text, domain, concepts; chunks without concepts are dropped."""
    raw = _call(parts, client, CONCEPT_PROMPT, retry_chars, [])
    parsed = raw.withColumn("r", F.from_json(repaired(F.col("raw")), CONCEPT_REPLY))
    return parsed.select("video_id", "chunk", "text", F.coalesce("r.domain", F.lit("Unknown")).alias("domain"), F.col("r.concepts").alias("concepts")).where(F.size("concepts") > 0)


def second_pass(first: DataFrame, client: Client, retry_chars: int = 15_000) -> DataFrame:
    """video_id, chunk, relationships, given the first pass's names."""
    named = first.select("video_id", "chunk", "text", F.array_join(F.transform("concepts", lambda c: c["name"]), ", ").alias("names"))
    raw = _call(named, client, RELATION_PROMPT, retry_chars, ["names"])
    return raw.select("video_id", "chunk", F.from_json(repaired(F.col("raw")), RELATION_REPLY)["relationships"].alias("relationships"))


def match_names(ends: DataFrame, names: DataFrame) -> DataFrame:
    """end_id, video_id, end -> end_id, name: equal, else containing or contained (shortest, then first), else by abbreviation."""
    key = name_key(F.col("end"))
    short = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    e = ends.withColumn("k", key).where("k <> ''").withColumn("long", F.element_at(short, F.col("k")))
    j = e.join(names.select("video_id", F.col("name").alias("cand")), "video_id")
    tier = F.when(F.col("k") == F.col("cand"), 0).when(F.contains("cand", F.col("k")) | F.contains("k", F.col("cand")), 1).when(F.contains("cand", F.col("long")), 2)
    hit = j.withColumn("tier", tier).where("tier IS NOT NULL")
    return hit.groupBy("end_id").agg(F.min_by("cand", F.struct("tier", F.length("cand").alias("l"), "cand")).alias("name"))


def merge_chunks(first: DataFrame, second: DataFrame, least: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(concepts, edges, domains) of a video over its chunks: first mention of a name wins, of a pair too; the last known domain."""
    c = first.select("video_id", "chunk", F.posexplode("concepts").alias("pos", "c"))
    c = c.select("video_id", "chunk", "pos", name_key(F.coalesce("c.normalized_name", "c.name")).alias("name"), F.coalesce("c.importance_score", F.lit(0.5)).alias("importance_score"), F.coalesce("c.difficulty", F.lit("unknown")).alias("difficulty"), F.coalesce("c.description", F.lit("")).alias("description")).where("name <> ''")
    body = F.struct("importance_score", "difficulty", "description")
    concepts = c.groupBy("video_id", "name").agg(F.min_by(body, F.struct("chunk", "pos")).alias("b"), F.count(F.lit(1)).alias("times"), F.min(F.struct("chunk", "pos")).alias("o"))
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("b.importance_score"), "o", "name"))
    concepts = concepts.select("video_id", "name", "b.*", "times", rank.alias("concept_rank"))
    r = second.select("video_id", "chunk", F.posexplode("relationships").alias("pos", "r")).withColumn("id", F.struct("video_id", "chunk", "pos"))
    ends = r.select("video_id", F.explode(F.array(F.struct(F.struct("id", F.lit("s").alias("side")).alias("end_id"), F.col("r.from").alias("end")), F.struct(F.struct("id", F.lit("d").alias("side")).alias("end_id"), F.col("r.to").alias("end")))).alias("e")).select("video_id", "e.*")
    named = match_names(ends, concepts)
    side = lambda s, out: named.where(F.col("end_id.side") == s).select(F.col("end_id.id").alias("id"), F.col("name").alias(out))
    e = r.join(side("s", "src"), "id").join(side("d", "dst"), "id").where("src <> dst").withColumn("confidence", F.coalesce("r.confidence", F.lit(0.7))).where(F.col("confidence") >= least)
    edges = e.groupBy("video_id", "src", "dst").agg(F.min_by(F.struct("confidence", F.coalesce("r.evidence", F.lit("LLM-inferred")).alias("evidence")), F.struct("chunk", "pos")).alias("b"))
    edges = edges.select("video_id", "src", "dst", F.lit("prerequisite").alias("relation"), "b.confidence", "b.evidence", F.lit("").alias("timestamp"), F.lit("llm").alias("detection_method"))
    domains = first.where("domain <> 'Unknown'").groupBy("video_id").agg(F.max_by("domain", "chunk").alias("domain"))
    return concepts, edges, domains


def extract_with_model(texts: DataFrame, segments: DataFrame, client: Client, cfg) -> tuple[DataFrame, DataFrame, DataFrame]:
    """texts (video_id, full_text) and segments -> (concepts with mentions, edges, domains)."""
    parts = chunk_table(texts, cfg.chunk_chars, cfg.chunk_overlap)
    first = first_pass(parts, client, cfg.retry_chars)
    concepts, edges, domains = merge_chunks(first, second_pass(first, client, cfg.retry_chars), cfg.min_llm_confidence)
    found = mentions(segments, concepts.select("video_id", "name"))
    counts = found.groupBy("video_id", "name").agg(F.count(F.lit(1)).alias("n"))
    out = concepts.join(mention_times(found), ["video_id", "name"], "left").join(counts, ["video_id", "name"], "left")
    return out.withColumn("frequency", F.greatest(F.coalesce("n", F.lit(0)), F.lit(1))).drop("n"), edges, domains
