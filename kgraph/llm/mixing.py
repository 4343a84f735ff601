"""Mixing sources to target weights by systematic sampling.

Each source gets a target number of words: its weight's share of all words, at most `max_ratio` times what it
has, the excess reshared by weight (water filling). Every document of a source then expects target / size
copies. Documents stand in a fixed order (size class, md5 place, doc_id); the prefix sums of their expected
copies, shifted by one offset per source drawn from the seed, cross an integer as often as the document is emitted.

Defined results: null or blank text has size 0 and counts as a document; a null source is a source of its own,
last in code-point order; a source of size 0 has target 0 and no copies; repeated rows are separate documents;
an empty table gives an empty result; other columns pass through `mix_sources` unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgraph.llm.common import WORD, buckets_for, materialise, ranked, table

WEIGHTS, MAX_RATIO, SEED = (1, 2, 3), 3, 20
BLANKS = r"[\x20\x09-\x0D]*"


def size_of(text: Column) -> Column:
    """Words of a text. Each is replaced, with the blanks before it, by one character: a list of them (regexp_count) takes 70 bytes of heap a word.

    The word put after the text takes up trailing blanks.
    """
    marks = F.regexp_replace(F.concat(text, F.lit(" x")), BLANKS + WORD, "x")
    return F.coalesce(F.length(marks) - 1, F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, max_ratio=MAX_RATIO, seed=SEED) -> DataFrame:
    """One row per source: _key, source_size, target, _rate (expected copies), _shift (its random offset)."""
    per = sized.groupBy("_key").agg(F.sum("_size").alias("source_size"))
    everything = Window.partitionBy(F.lit(0))
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(everything.orderBy("_key")) - 1) % len(weights) + 1)
    per = per.withColumn("_w", w.cast("double")).withColumn("_cap", (max_ratio * F.col("source_size")).cast("double"))
    per = per.withColumn("_at", F.col("_cap") / F.col("_w"))  # the level at which the source is full
    before = everything.orderBy("_at", "_key").rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))
    open_w = F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    per = per.withColumn("_level", left / open_w)
    level = F.max(F.when(F.col("_at") > F.col("_level"), F.col("_level"))).over(everything)
    per = per.withColumn("target", F.least("_cap", F.coalesce(level, F.lit(float("inf"))) * F.col("_w")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    shift = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "_key")), 1, 8), 16, 10).cast("double") / 4294967296.0
    return per.select("_key", "source_size", "target", rate.alias("_rate"), shift.alias("_shift"))


def mix_plan(docs: DataFrame, size: str, weights=WEIGHTS, max_ratio=MAX_RATIO, seed=SEED) -> DataFrame:
    """docs with source_size, target, copies and taken; `size` names the column that holds each document's words."""
    key = F.when(F.col("source").isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), "source"))
    sized = docs.withColumn("_key", key).withColumn("_size", F.col(size)).withColumn("_class", F.length(F.bin("_size")))
    targets = source_targets(sized, weights, max_ratio, seed)
    # the rank runs through (class, place, doc_id): the class is part of the key, and the sums of classes are added
    by_class = sized.groupBy("_key", "_class").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_key").orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    by_class = by_class.select("_key", "_class", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_below"))
    small = by_class.join(targets, "_key")
    out = ranked(sized, ["_key", "_class"], "doc_id", ["doc_id", "_size"], buckets_for(docs.count()), attach=small)
    k = (F.col("_below") + F.col("_rank")).cast("double")
    crossed = F.floor(k * F.col("_rate") + F.col("_shift")) - F.floor((k - 1) * F.col("_rate") + F.col("_shift"))
    out = out.withColumn("copies", crossed.cast("long")).withColumn("taken", F.col("copies") * F.col("_size"))
    return out.drop("_key", "_size", "_class", "_below", "_rank", "_rate", "_shift")


def mix_sources(docs: DataFrame, weights=WEIGHTS, max_ratio=MAX_RATIO, seed=SEED) -> DataFrame:
    """The mix itself: every column of docs, each document as often as it is taken."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), "doc_id", "source", size_of(F.col("text")).alias("_words"))
    plan = mix_plan(rows, "_words", weights, max_ratio, seed).where("copies > 0")
    return plan.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    slim = materialise(docs.select("doc_id", "source", size_of(F.col("text")).alias("size")), "mix")
    plan = mix_plan(slim, "size").select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
    return plan.coalesce(buckets_for(slim.count()))  # of narrow rows: no files of a few rows each


ORACLE = f"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS k,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
b AS (
  SELECT *, length(bin(size)) AS cls, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 4))::INT AS bkt FROM sized),
per AS (
  SELECT k, sum(size)::BIGINT AS source_size FROM sized GROUP BY k),
w AS (
  SELECT *, ((row_number() OVER (ORDER BY k) - 1) % 3 + 1)::DOUBLE AS w, ({MAX_RATIO} * source_size)::DOUBLE AS cap FROM per),
l AS (
  SELECT *, cap / w AS full_at,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM w),
t AS (
  SELECT k, source_size, least(cap, coalesce(max(CASE WHEN full_at > level THEN level END) OVER (), 'inf'::DOUBLE) * w) AS target,
         ('0x' || substr(md5('{SEED}:' || k), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS shift FROM l),
r AS (
  SELECT b.*, (row_number() OVER (PARTITION BY k ORDER BY cls, bkt, doc_id NULLS FIRST, size))::DOUBLE AS pos FROM b),
c AS (
  SELECT doc_id, size, source_size, target, source,
         (floor(pos * CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END + shift)
          - floor((pos - 1) * CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END + shift))::BIGINT AS copies
  FROM r JOIN t USING (k))
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM c
"""
