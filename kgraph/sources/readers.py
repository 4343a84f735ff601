"""Transcripts in: JSON documents, raw text, turns, and media through an injected transcriber."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgraph.functions.scalars import time_label
from kgraph.operators.normalise import full_texts, segments_from_text
from kgraph.schemas import TRANSCRIPT

MEDIA = ("mp4", "mkv", "webm", "avi", "mov", "flv", "wav", "mp3")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcript JSON files, one document per file; missing ids become 'unknown'."""
    df = spark.read.schema(TRANSCRIPT).option("multiLine", True).json(path)
    return df.withColumn("video_id", F.coalesce("video_id", F.lit("unknown")))


def parse_transcripts(raw: DataFrame, column: str = "value") -> DataFrame:
    """Uploaded transcripts: one JSON document per row."""
    return raw.select(F.from_json(column, TRANSCRIPT).alias("t")).select("t.*").withColumn("video_id", F.coalesce("video_id", F.lit("uploaded_video")))


def segments_of(transcripts: DataFrame) -> DataFrame:
    s = transcripts.select("video_id", F.explode("segments").alias("s"))
    label = F.coalesce("s.timestamp_label", time_label(F.col("s.start")))
    return s.select("video_id", F.col("s.id").alias("seg_id"), F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.coalesce("s.text", F.lit("")).alias("text"), F.col("s.original_text").alias("original_text"), label.alias("timestamp_label"))


def text_transcripts(texts: DataFrame, language: str = "unknown") -> DataFrame:
    """video_id, text -> transcripts with synthetic segments."""
    seg = segments_from_text(texts)
    item = F.struct(F.col("seg_id").alias("id"), "start", "end", "text", F.lit(None).cast("string").alias("original_text"), "timestamp_label")
    lists = seg.groupBy("video_id").agg(F.array_sort(F.collect_list(item)).alias("segments"))
    out = texts.join(lists, "video_id", "left").join(full_texts(seg), "video_id", "left")
    meta = F.struct(F.lit("text").alias("source_file"), F.lit(language).alias("language_detected"), F.lit(None).cast("string").alias("model_used"), F.lit(None).cast("string").alias("processed_at"))
    return out.select("video_id", meta.alias("metadata"), F.coalesce("full_text", F.lit("")).alias("full_text"), F.lit(None).cast("string").alias("original_full_text"), F.coalesce("segments", F.array().cast(lists.schema["segments"].dataType)).alias("segments"))


def transcribe(spark: SparkSession, path: str, transcriber: Callable[[bytes, str], Iterable[tuple[float, float, str]]]) -> DataFrame:
    """Media files through transcriber(content, file name) -> (start, end, text); one segment row each.

    The transcriber is loaded once per worker by the caller's own caching; times are rounded to two digits.
    """
    pattern = "*.{" + ",".join(MEDIA) + "}"

    def run(batches):
        for pdf in batches:
            for name, content in zip(pdf["path"], pdf["content"]):
                rows = [(name.rsplit("/", 1)[-1].rsplit(".", 1)[0], i, round(a, 2), round(b, 2), t.strip()) for i, (a, b, t) in enumerate(transcriber(content, name))]
                yield pd.DataFrame(rows, columns=["video_id", "seg_id", "start", "end", "text"])

    seg = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return seg.mapInPandas(run, "video_id string, seg_id int, start double, `end` double, text string").withColumn("timestamp_label", time_label(F.col("start")))
