"""Written intermediate tables, and connected components on top of them."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or one below the warehouse where it is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir") + "/_work"
        if root.startswith(("file:", "/")) and not spark.sparkContext.master.startswith("local"):
            raise ValueError("the warehouse is a machine-local folder: name one that all executors share in spark.checkpoint.dir")
    return root.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended: the folder's own retention removes it
        pass


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_root(spark)}/kgraph-{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as Parquet to the shared folder and read it back: lineage is cut, and a lost executor costs nothing. Also gives the path, for remove()."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, name: str) -> DataFrame:
    return written(df, name)[0]


class Superseded:
    """Tables of an iteration: each new one removes the one before, once it is written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.path = spark, None

    def __call__(self, df: DataFrame, name: str) -> DataFrame:
        out, path = written(df, name)
        if self.path:
            remove(self.spark, self.path)
        self.path = path
        return out


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    # edges have a < b: every b keeps its smaller neighbours
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    linked = edges.join(least, "b").where("a <> m").select(F.col("m").alias("x"), F.col("a").alias("y"))
    out = linked.unionByName(least.select(F.col("m").alias("x"), F.col("b").alias("y")))
    return out.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node of its component.

    Alternating large-star and small-star steps, until nothing changes: each is a pre-aggregated minimum per node and a
    join, hubs are split by adaptive execution, and a written table, which replaces the one before, cuts the lineage
    after each round.
    """
    keep = Superseded(edges.sparkSession)
    state = lambda e: e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64("b", "a"))).first()
    edges = keep(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    before, now = None, state(edges)
    while now[0] and now != before:
        edges = keep(_small_star(_large_star(edges)).distinct(), "edges")
        before, now = now, state(edges)
    roots = edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots)
