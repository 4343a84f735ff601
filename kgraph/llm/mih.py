"""Approximate nearest neighbours by multi-index hashing.

Vectors are coded in bits by rotations learned on a bounded sample (iterative quantisation from several starts; vectors
of unequal norms get one more coordinate, so that the angle orders inner products). Codes are split into 16-bit
substrings, each indexed by its value. With r = m * a + b, a code within Hamming radius r of a query differs from it in at
most a bits in one of the first b + 1 of m substrings or in at most a - 1 in one of the others, so probing these
buckets retrieves every code within r; they are checked against r and reranked by inner product in double precision. The radius is the Hamming distance that RECALL of the
sample's nearest neighbours lie within. If a block of the index holds fewer than k such codes, the radius grows
there until it does.

Queries and index rows are dealt to blocks of bounded size; every block of queries meets every block of the index.

Defined results: vectors that are null, zero, of another dimension than most of the sample's, or hold null or non-finite
components, and rows without vec_id, take no part; rows that repeat a vec_id count once (the
smallest vector); fewer than k candidates are all returned; ties go to the smaller vec_id; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgraph.llm.common import materialise, table

K, BITS, SUB, SAMPLE, RECALL, SEED = 20, 128, 16, 4096, 0.975, 11
INDEX_ROWS, QUERY_ROWS, ITERATIONS = 32_768, 4096, 25
_POP = np.array([bin(i).count("1") for i in range(1 << SUB)], np.uint8)
WITHIN = [np.nonzero(_POP <= d)[0] for d in range(SUB + 1)]


class Coder:
    """Learned rotations: rows of doubles to rows of BITS / 16 substrings."""

    def __init__(self, sample: np.ndarray, norm: float):
        self.norm, self.dim = norm, sample.shape[1]
        x = self._lift(sample, index=True)
        self.mean = x.mean(0)
        x = x - self.mean
        rng = np.random.default_rng(SEED)
        _, _, axes = np.linalg.svd(x, full_matrices=False)
        v = x @ axes.T
        parts = []
        for _ in range(-(-BITS // v.shape[1])):
            r = np.linalg.qr(rng.normal(size=(v.shape[1], v.shape[1])))[0]
            for _ in range(ITERATIONS):
                u, _, w = np.linalg.svd(np.sign(v @ r).T @ v)
                r = (u @ w).T
            parts.append(axes.T @ r)
        self.rotation = np.hstack(parts)[:, :BITS]

    def _lift(self, x: np.ndarray, index: bool) -> np.ndarray:
        x = x / (self.norm if index else np.linalg.norm(x, axis=1, keepdims=True))
        last = np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(1))) if index else np.zeros(len(x))
        return np.c_[x, np.where(last < 1e-3, 0.0, last)]

    def codes(self, x: np.ndarray, index: bool) -> np.ndarray:
        bits = (self._lift(x, index) - self.mean) @ self.rotation > 0
        return np.packbits(bits, axis=1).view(">u2").astype(np.uint16)

    def calibrate(self, sample: np.ndarray, near: int) -> int:
        q = sample[:: max(1, len(sample) // 256)]
        dot = q @ sample.T
        dot[np.arange(len(q)), np.arange(0, len(sample), max(1, len(sample) // 256))[: len(q)]] = -np.inf
        near = min(near, len(sample) - 1)
        if near < 1:
            return BITS
        top = np.argpartition(-dot, near - 1, axis=1)[:, :near]
        cq, cs = self.codes(q, False), self.codes(sample, True)
        d = _POP[cq[:, None, :] ^ cs[top]].sum(-1, dtype=int)
        return int(np.quantile(d, RECALL, method="higher"))


class Buckets:
    """The rows of a block by the values of each substring."""

    def __init__(self, codes: np.ndarray):
        self.rows, self.values, self.start, self.at = [], [], [], []
        for j in range(codes.shape[1]):
            order = np.argsort(codes[:, j], kind="stable").astype(np.int32)
            values, start = np.unique(codes[order, j], return_index=True)
            at = np.full(1 << SUB, -1, np.int32)
            at[values] = np.arange(len(values))
            self.rows.append(order)
            self.values.append(values)
            self.start.append(np.r_[start, len(order)].astype(np.int32))
            self.at.append(at)

    def probe(self, j: int, value: int, near: int) -> np.ndarray:
        """Rows whose substring j is within `near` bits of value: by all such values, or by the values that there are, whichever are fewer."""
        if len(WITHIN[near]) < len(self.values[j]):
            b = self.at[j][WITHIN[near] ^ value]
            b = b[b >= 0]
        else:
            b = np.nonzero(_POP[self.values[j] ^ np.uint16(value)] <= near)[0]
        lo = self.start[j][b]
        n = self.start[j][b + 1] - lo
        upto = np.cumsum(n)
        return self.rows[j][np.repeat(lo - upto + n, n) + np.arange(upto[-1] if len(n) else 0)]


def search(index_ids, index, index_codes, query_ids, queries, query_codes, radius: int, k: int):
    """Rows (query_id, vec_id, score): each query's k best of this block."""
    m, n = index_codes.shape[1], len(index)
    buckets = Buckets(index_codes)
    words = np.ascontiguousarray(index_codes).view(np.uint64)
    qwords = np.ascontiguousarray(query_codes).view(np.uint64)
    least, more = divmod(radius, m)  # pigeonhole: one of the first more + 1 substrings is within least, or one of the others within least - 1
    out = []
    for i in range(len(queries)):
        hit = np.zeros(n, bool)
        for j in range(m):
            near = least if j <= more else least - 1
            if near >= 0:
                hit[buckets.probe(j, int(query_codes[i, j]), min(near, SUB))] = True
        at = np.nonzero(hit)[0]
        dist = np.bitwise_count(words[at] ^ qwords[i]).sum(1)
        at = at[dist <= radius]
        at = at[index_ids[at] != query_ids[i]]
        if len(at) < k:  # grow the radius until k codes are in reach
            dist = np.bitwise_count(words ^ qwords[i]).sum(1).astype(int)
            dist[index_ids == query_ids[i]] = 1 << 20
            reach = dist.max() if n <= k else np.partition(dist, k - 1)[k - 1]
            at = np.nonzero((dist <= reach) & (dist < 1 << 20))[0]
        score = index[at] @ queries[i]
        if len(at) > 4 * k:  # as sums in another order differ in the last bits, some more are kept
            floor = np.partition(score, len(score) - k)[len(score) - k]
            slack = 1e-12 * np.sqrt((queries[i] ** 2).sum()) * np.sqrt((index[at] ** 2).sum(1))
            at = at[score >= floor - slack - 1e-12 * abs(floor)]
        score = (index[at] * queries[i]).sum(1)  # in one order of summation, so that equal vectors tie
        best = np.lexsort((index_ids[at], -score))[:k]
        out.append(pd.DataFrame({"query_id": query_ids[i], "vec_id": index_ids[at[best]], "score": score[best]}))
    return out


def _doubles(col: pd.Series, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(col), "<f8").reshape(-1, dim)


def nearest(vectors: DataFrame, k: int = K, queries_where: str = "vec_id % 20 = 0") -> DataFrame:
    """query_id, rank, vec_id, score; queries are the rows that satisfy queries_where."""
    spark = vectors.sparkSession
    v = F.col("embedding")
    usable = vectors.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).select(F.col("vec_id").cast("long"), F.transform(v, lambda x: x.cast("double")).alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    usable = usable.where(F.forall("v", finite) & F.exists("v", lambda x: x != 0.0))
    schema = "query_id long, rank int, vec_id long, score double"
    picked = usable.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).collect()  # bounded sample
    if not picked:
        return spark.createDataFrame([], schema)
    sizes = [len(r["v"]) for r in picked]
    dim = max(set(sizes), key=lambda s: (sizes.count(s), -s))
    sample = np.array([r["v"] for r in picked if len(r["v"]) == dim])
    usable = usable.where(F.size("v") == dim)
    usable = usable.groupBy("vec_id").agg(F.min("v").alias("v"))  # repeated ids
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    total, largest = usable.agg(F.count(F.lit(1)), F.max(squares)).first()
    coder = Coder(sample, float(np.sqrt(largest)))
    radius = coder.calibrate(sample, -(-k * len(sample) // total))

    def encode(batches):
        for pdf in batches:
            x = np.array(pdf["v"].tolist(), float).reshape(-1, dim)
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "vec": [r.astype("<f8").tobytes() for r in x], "code": [c.tobytes() for c in coder.codes(x, True)], "query": pdf["query"], "query_code": [c.tobytes() for c in coder.codes(x, False)]})

    coded = usable.withColumn("query", F.expr(queries_where)).mapInPandas(encode, "vec_id long, vec binary, code binary, query boolean, query_code binary")
    coded = materialise(coded, "codes")
    n_queries = coded.where("query").count()
    blocks, groups = -(-total // INDEX_ROWS), max(1, -(-n_queries // QUERY_ROWS))
    blocks = max(blocks, min(spark.sparkContext.defaultParallelism, -(-total // 2048)))
    side = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    index = coded.select("vec_id", "vec", "code", F.lit(False).alias("query"), side(blocks, 1).alias("b"), each(groups).alias("g"))
    asked = coded.where("query").select("vec_id", "vec", F.col("query_code").alias("code"), F.lit(True).alias("query"), each(blocks).alias("b"), side(groups, 2).alias("g"))

    def run(key, pdf):
        q = pdf["query"].to_numpy(bool)
        if not q.any() or q.all():
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        part = lambda mask: (pdf["vec_id"].to_numpy()[mask], _doubles(pdf["vec"][mask], dim), np.frombuffer(b"".join(pdf["code"][mask]), np.uint16).reshape(mask.sum(), -1))
        return pd.concat(search(*part(~q), *part(q), radius, k), ignore_index=True)

    found = index.unionByName(asked).groupBy("b", "g").applyInPandas(run, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
