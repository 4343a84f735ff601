"""Documents out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_documents(documents: DataFrame, path: str, per_video: bool = False) -> None:
    """JSON lines, or one folder per video (for few videos: every folder is a file system entry)."""
    if per_video:
        documents.select("video_id", F.col("document").alias("value")).repartition("video_id").write.mode("overwrite").partitionBy("video_id").text(path)
    else:
        documents.select(F.col("document").alias("value")).write.mode("overwrite").text(path)


def write_transcripts(transcripts: DataFrame, path: str) -> None:
    transcripts.write.mode("overwrite").json(path)
