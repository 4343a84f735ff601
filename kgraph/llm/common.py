"""Shared helpers: word pattern, bucketed ranking, labelled samples and their models, Arrow in and out (ids stay 64-bit integers)."""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgraph.operators.iterate import materialise, new_path  # noqa: F401

#: A word is a run of anything but space, tab, LF, VT, FF and CR.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PLACES, BUCKET_ROWS = 65_536, 200_000


def place_of(col):
    """A place 0..65535 from md5, which other SQL engines have as well."""
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit(""))), 1, 4), 16, 10).cast("int")


def buckets_for(rows: int) -> int:
    """How many tasks share the rows of one key, if it holds them all."""
    return min(PLACES, max(16, -(-rows // BUCKET_ROWS)))


def ranked(df: DataFrame, keys: list[str], salt: str, order: list, buckets: int, rank: str = "_rank", attach: DataFrame | None = None) -> DataFrame:
    """row_number() within keys, from 1, ordered by place_of(salt) and then by order, without one task per key.

    Buckets are ranges of places, so their number does not change the ranks. Counts per (keys, bucket) are pre-aggregated
    before their shuffle; their running sum is the offset of each bucket, so a key with a third of all rows is ranked
    by `buckets` tasks. Null keys must be coded before. `attach` (one row per keys) joins the offsets, not the rows; and as
    the merge join deals rows out just as the window needs them, wide rows are shuffled once.
    """
    df = df.withColumn("_place", place_of(F.col(salt))).withColumn("_bucket", F.floor(F.col("_place") * F.lit(buckets).cast("long") / PLACES).cast("int"))
    counts = df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    if attach is not None:
        offsets = offsets.join(attach, keys)
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_place", *order)
    return df.join(offsets.hint("merge"), [*keys, "_bucket"]).withColumn(rank, F.col("_offset") + F.row_number().over(inside)).drop("_bucket", "_place", "_offset")


def crc_mod5(col="doc_id"):
    return F.pmod(F.crc32(F.col(col).cast("string").cast("binary")), F.lit(5))


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, per_class: int, longest: int) -> DataFrame:
    """(text, label): at most per_class texts of each label, of rows whose crc32(doc_id as text) mod 5 is not 0, by label and then by hash.

    Texts of over `longest` characters are no training rows.
    """
    marked = labels.where(F.col(target).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(target).cast("int").alias("_label")).where(crc_mod5() != 0)
    picked = None
    for label in (0, 1):
        part = marked.where(F.col("_label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * per_class)
        picked = part if picked is None else picked.unionByName(part)
    texts = docs.where(F.col("text").isNotNull() & (F.length("text") <= longest)).select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    texts = texts.select("doc_id", "text", "_label", F.xxhash64("doc_id").alias("_h"), F.xxhash64("text").alias("_t"))
    place = F.row_number().over(Window.partitionBy("_label").orderBy("_h", "doc_id", "_t"))  # of 2 * per_class rows, but for repeated ids
    return texts.withColumn("_n", place).where(F.col("_n") <= per_class).select("text", F.col("_label").alias("label"), "_n")


PIECE = 1 << 20


def fitted(sample: DataFrame, fit) -> bytes | None:
    """fit(rows (text, label), by label and place) of a bounded sample, run in one executor task; the pickled model, null for none.

    The model reaches the driver in pieces, as one large row takes several times its size there. The driver's socket ends
    without an error if the driver runs out of memory, so a model that is not whole is an error here.
    """

    def run(batches):
        rows = []
        for batch in batches:
            rows += zip(*(batch.column(i).to_pylist() for i in range(3)))
        rows.sort(key=lambda r: (r[1], r[2]))
        model = fit([(text, label) for text, label, _ in rows])
        data = b"" if model is None else pickle.dumps(model)
        for at in range(0, max(1, len(data)), PIECE):
            yield pa.RecordBatch.from_arrays([pa.array([len(data)], pa.int64()), pa.array([at], pa.int64()), pa.array([data[at : at + PIECE]], pa.binary())], names=["size", "at", "piece"])

    got = sample.repartition(1).mapInArrow(run, "size long, at long, piece binary").collect()
    data = b"".join(bytes(r["piece"]) for r in sorted(got, key=lambda r: r["at"]))
    if len(data) != got[0]["size"] if got else not sample.isEmpty():
        raise RuntimeError(f"of a model's {got[0]['size'] if got else 'unknown number of'} bytes {len(data)} reached the driver")
    return data or None


def slices(batches, rows: int = 200):
    """Arrow batches in pieces, so that few Python strings live at a time."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def kept_rows(df: DataFrame, column: str, verdicts) -> DataFrame:
    """df without the rows that verdicts(values of the column) rejects; all other columns pass through as they are."""
    at = df.columns.index(column)

    def run(batches):
        judge = verdicts()
        for piece in slices(batches):
            yield piece.filter(pa.array(np.asarray(judge(piece.column(at).to_pylist()), bool)))

    return df.mapInArrow(run, df.schema)


def with_columns(df: DataFrame, column: str, added: str, compute) -> DataFrame:
    """df without `column`, and the columns of the schema text `added`: one list each from compute()(values of the column)."""
    kept = [c for c in df.columns if c != column]
    rest = df.select(*[df[c] for c in kept], df[column])
    schema = T.StructType([*rest.schema.fields[:-1], *T.StructType.fromDDL(added).fields])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        f = compute()
        kinds = [to_arrow_type(x.dataType) for x in schema.fields[len(kept) :]]
        for piece in slices(batches):
            new = [pa.array(v, k) for v, k in zip(f(piece.column(len(kept)).to_pylist()), kinds)]
            yield pa.RecordBatch.from_arrays([*(piece.column(i) for i in range(len(kept))), *new], names=schema.names)

    return rest.mapInArrow(run, schema)
