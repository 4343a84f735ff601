"""Segments as a stream: new transcript files are appended, and each micro-batch reworks only the videos it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kgraph.schemas import SEGMENT


def segment_stream(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of segments with a video_id."""
    return spark.readStream.schema(f"video_id string, {SEGMENT.replace('id int', 'seg_id int', 1)}").json(path)


def windowed_mentions(segments: DataFrame, word_pattern: str, minutes: int = 5, arrived: str | None = None, delay: str = "1 day") -> DataFrame:
    """Mentions per video and window of lecture time.

    Offsets of different lectures have no common clock, so there is no watermark over them: a lecture may begin long after
    another has ended. With `arrived` (the name of a column of arrival times) state of windows is dropped `delay` after the
    latest arrival; without, it is kept.
    """
    n = F.regexp_count(F.lower("text"), F.lit(word_pattern))
    start = F.floor(F.col("start") / (60 * minutes)) * (60 * minutes)
    hits = segments.withColumns({"n": n, "window_start": start.cast("long"), "window_end": (start + 60 * minutes).cast("long")})
    keys = ["video_id", "window_start", "window_end"]
    if arrived:
        hits, keys = hits.withWatermark(arrived, delay), [*keys, F.window(arrived, delay).alias("arrived")]
    return hits.groupBy(*keys).agg(F.sum("n").alias("mentions"))


def rework(stream: DataFrame, store: str, checkpoint: str, run: Callable[[DataFrame], DataFrame], out: str, buckets: int = 64) -> StreamingQuery:
    """Append segments to `store`; run(all segments of the batch's videos) overwrites those videos' buckets in `out`.

    Both are partitioned by a hash of video_id, so a batch reads only the buckets that it touches, and rewrites them.
    """
    bucket = F.pmod(F.xxhash64("video_id"), F.lit(buckets)).cast("int")

    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        new, path = f"{store}/segments", f"{store}/segments/epoch={epoch}"
        df.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(path)  # a replayed batch replaces itself
        touched = [r["bucket"] for r in spark.read.parquet(path).select("bucket").distinct().collect()]  # at most `buckets`
        if not touched:
            return
        every = spark.read.option("basePath", new).parquet(new).where(F.col("bucket").isin(touched)).drop("epoch", "bucket")
        done = run(every).withColumn("bucket", bucket)
        done.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(out)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
