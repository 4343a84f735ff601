"""Concept graphs: de-duplication, build, metrics, communities, reachability and graph queries.

Corpus-wide steps are joins and aggregates keyed by video. Per-video kernels (betweenness, HITS, cycle breaking,
communities) run in grouped Arrow functions, as one lecture's graph is small by nature; PageRank, depth and reachability
also come in DataFrame form for graphs that are not.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kgraph.functions.dims import METHOD_WEIGHTS, OTHER_METHOD_WEIGHT
from kgraph.operators.iterate import Superseded, components, materialise

METRICS = "video_id {key}, name string, pagerank double, betweenness double, in_degree_centrality double, out_degree_centrality double, hub_score double, authority_score double, depth int, community int"


# --- de-duplication -------------------------------------------------------------------------------------------------
def _units(vectors: DataFrame) -> DataFrame:
    """Vectors of length 1; zero vectors stay."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return vectors.withColumn("_n", norm).withColumn("v", F.transform("v", lambda x: x / F.when(F.col("_n") == 0, 1.0).otherwise(F.col("_n"))))


def similar_pairs(vectors: DataFrame, threshold: float, key: str = "video_id") -> DataFrame:
    """key, id, v (array<double>) -> pairs a < b of one key with cosine of at least threshold.

    All pairs of one key meet, as a key is one lecture's concept list; zero vectors have cosine 0 with all.
    """
    unit = _units(vectors)
    a = unit.select(key, F.col("id").alias("a"), F.col("v").alias("va"))
    b = unit.select(key, F.col("id").alias("b"), F.col("v").alias("vb"))
    cosine = F.aggregate(F.zip_with("va", "vb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return a.join(b, key).where("a < b").withColumn("cosine", cosine).where(F.col("cosine") >= threshold).select(key, "a", "b", "cosine")


LINK_BLOCK, LINK_TILE = 4096, 512  # vectors that meet in one task, and rows of them in one product
NEAR = 1e-9  # far above the rounding of a product of unit vectors


def similar_links(vectors: DataFrame, threshold: float, key: str = "video_id") -> DataFrame:
    """a, b (ids) that join just those rows that the pairs of `similar_pairs` join, with fewer rows than pairs.

    All rows of a key meet, in blocks: per two blocks one matrix product tells the linked rows, and every row is joined
    with the smallest id it reaches there. A cosine within NEAR of the threshold is summed again in the order of `similar_pairs`.
    """
    kind = vectors.schema["id"].dataType.simpleString()
    unit = _units(vectors).where(f"{key} IS NOT NULL AND id IS NOT NULL AND v IS NOT NULL AND NOT exists(v, x -> x IS NULL)")
    unit = unit.select(F.col(key).alias("_k"), F.size("v").alias("_d"), "id", "v")
    blocks = unit.groupBy("_k", "_d").agg(F.ceil(F.count(F.lit(1)) / F.lit(LINK_BLOCK)).cast("int").alias("_blocks"))
    at = F.pmod(F.xxhash64("id", "v"), F.col("_blocks")).cast("int")
    dealt = unit.join(blocks, ["_k", "_d"]).withColumn("_at", at)
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")
    met = dealt.select("_k", "_d", "id", "v", "_at", other).select("_k", "_d", F.least("_at", "_other").alias("_p"), F.greatest("_at", "_other").alias("_q"), "_at", "id", "v")

    def run(rows: pa.Table) -> pa.Table:
        first, second, n, width = rows.column("_p")[0].as_py(), rows.column("_q")[0].as_py(), rows.num_rows, rows.column("_d")[0].as_py()
        flat = pa.concat_arrays([c.flatten() for c in rows.column("v").chunks])
        v, ids, at = flat.to_numpy(zero_copy_only=False).reshape(n, width), rows.column("id").to_pylist(), rows.column("_at").to_numpy()
        links = _reached(v, ids, np.nonzero(at == first)[0], np.nonzero(at == second)[0], threshold)
        return pa.Table.from_arrays([pa.array([ids[x] for x in side], rows.schema.field("id").type) for side in zip(*links)] or [pa.array([], rows.schema.field("id").type)] * 2, names=["a", "b"])

    return met.groupBy("_k", "_d", "_p", "_q").applyInArrow(run, f"a {kind}, b {kind}")


def _reached(v: np.ndarray, ids: list, left: np.ndarray, right: np.ndarray, threshold: float) -> list[tuple[int, int]]:
    """(row of the smallest id, row) per linked row: components of the rows left and right, where only unequal ids of the two sides link."""
    number = {x: i for i, x in enumerate(sorted(set(ids)))}
    rank = np.array([number[x] for x in ids])
    linked = np.zeros((len(left), len(right)), bool)
    for lo in range(0, len(left), LINK_TILE):
        rows = left[lo : lo + LINK_TILE]
        cosine = v[rows] @ v[right].T
        hit = ~(cosine < threshold - NEAR)  # NaN counts as large, as in SQL
        hit &= rank[rows][:, None] != rank[right][None, :]
        i, j = np.nonzero(hit & (cosine <= threshold + NEAR))
        for k in range(0, len(i), 4096):
            x, y = i[k : k + 4096], j[k : k + 4096]
            exact = np.cumsum(v[rows[x]] * v[right[y]], axis=1)[:, -1]
            hit[x, y] = exact >= threshold
        linked[lo : lo + LINK_TILE] = hit
    out, fresh, open_rows, reached = [], linked.any(1), np.ones(len(left), bool), np.zeros(len(right), bool)
    for start in np.nonzero(fresh)[0]:
        if not open_rows[start]:
            continue
        wave, mine, theirs = np.array([start]), [], []
        while len(wave):
            open_rows[wave] = False
            mine.append(left[wave])
            new = np.nonzero(linked[wave].any(0) & ~reached)[0]
            reached[new] = True
            theirs.append(right[new])
            wave = np.nonzero(linked[:, new].any(1) & open_rows)[0]
        members = np.concatenate(mine + theirs)
        least = members[np.argmin(rank[members])]
        out += [(least, m) for m in np.unique(members) if rank[m] != rank[least]]
    return out


def similar_names(concepts: DataFrame, threshold: float) -> DataFrame:
    """The fallback without embeddings: pairs a < b (names) of one video whose sequence-matching ratio reaches threshold."""

    kind = concepts.schema["video_id"].dataType.simpleString()

    def run(pdf):
        names = sorted(pdf["name"])
        rows = [(pdf["video_id"].iloc[0], a, b, r) for i, a in enumerate(names) for b in names[i + 1 :] if (r := SequenceMatcher(None, a, b).ratio()) >= threshold]
        return pd.DataFrame(rows, columns=["video_id", "a", "b", "ratio"])

    return concepts.select("video_id", "name").groupBy("video_id").applyInPandas(run, f"video_id {kind}, a string, b string, ratio double")


def canonical_map(concepts: DataFrame, pairs: DataFrame) -> DataFrame:
    """video_id, name -> canonical: the most important member of its similarity component (earlier rank on ties)."""
    tagged = pairs.select(F.struct("video_id", F.col("a").alias("n")).alias("a"), F.struct("video_id", F.col("b").alias("n")).alias("b"))
    roots = components(tagged).select(F.col("node.video_id").alias("video_id"), F.col("node.n").alias("name"), F.col("root.n").alias("root"))
    c = concepts.select("video_id", "name", "importance_score", "concept_rank").join(roots, ["video_id", "name"], "left").withColumn("root", F.coalesce("root", "name"))
    best = c.groupBy("video_id", "root").agg(F.max_by("name", F.struct("importance_score", (-F.col("concept_rank")).alias("r"))).alias("canonical"))
    return c.join(best, ["video_id", "root"]).select("video_id", "name", "canonical")


def merge_concepts(concepts: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row per canonical: its own values, summed frequency, time labels of all members without repeats.

    first_mention stays the canonical's own, even where a merged member came earlier.
    """
    c = concepts.join(mapping, ["video_id", "name"])
    own = F.struct(*[F.col(x) for x in concepts.columns if x not in ("video_id", "frequency", "timestamps")])
    labels = F.array_sort(F.collect_list(F.struct((F.col("name") != F.col("canonical")).alias("o"), "concept_rank", "timestamps")))
    g = c.groupBy("video_id", "canonical").agg(F.max_by(own, F.struct((F.col("name") == F.col("canonical")).alias("k"))).alias("own"), F.sum("frequency").alias("frequency"), labels.alias("l"))
    return g.select("video_id", "own.*", "frequency", F.array_distinct(F.flatten(F.transform("l", lambda x: x["timestamps"]))).alias("timestamps")).select(*concepts.columns)


def remap_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Endpoints to canonicals, self-loops dropped, the most confident edge of a pair kept (then: by its old names)."""
    m = lambda old, new: mapping.select("video_id", F.col("name").alias(old), F.col("canonical").alias(new))
    e = edges.join(m("src", "_s"), ["video_id", "src"], "left").join(m("dst", "_d"), ["video_id", "dst"], "left")
    e = e.withColumn("_os", F.col("src")).withColumn("_od", F.col("dst")).withColumn("src", F.coalesce("_s", "src")).withColumn("dst", F.coalesce("_d", "dst")).where("src <> dst")
    first = F.row_number().over(Window.partitionBy("video_id", "src", "dst").orderBy(F.desc("confidence"), "_os", "_od"))
    return e.withColumn("_r", first).where("_r = 1").select(*edges.columns)


def with_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    for side in ("src", "dst"):
        edges = edges.join(nodes.select("video_id", F.col("name").alias(side)).distinct(), ["video_id", side], "left_semi")
    return edges


def merge_sources(edges: DataFrame) -> DataFrame:
    """Edges of one pair from several sources: weighted mean confidence + 0.05 per further source, at most 1.

    Needs an `ord` column; methods are joined in order, evidence is the first, the time label is dropped.
    """
    weights = F.create_map(*[F.lit(x) for kv in METHOD_WEIGHTS.items() for x in kv])
    w = F.coalesce(F.element_at(weights, F.col("detection_method")), F.lit(OTHER_METHOD_WEIGHT))
    rows = F.array_sort(F.collect_list(F.struct("ord", "detection_method", "evidence", "relation", "timestamp")))
    g = edges.withColumn("w", w).groupBy("video_id", "src", "dst").agg(F.sum(F.col("confidence") * F.col("w")).alias("cw"), F.sum("w").alias("sw"), F.count(F.lit(1)).alias("k"), rows.alias("r"))
    confidence = F.least(F.lit(1.0), F.least(F.lit(1.0), F.col("cw") / F.col("sw")) + 0.05 * (F.col("k") - 1))
    methods = F.array_join(F.array_distinct(F.transform("r", lambda x: x["detection_method"])), "+")
    return g.select("video_id", "src", "dst", F.col("r")[0]["relation"].alias("relation"), confidence.alias("confidence"), F.col("r")[0]["evidence"].alias("evidence"), F.when(F.col("k") == 1, F.col("r")[0]["timestamp"]).otherwise("").alias("timestamp"), methods.alias("detection_method"))


# --- DataFrame metrics ----------------------------------------------------------------------------------------------
def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.select("video_id", "name", F.count(F.lit(1)).over(Window.partitionBy("video_id")).alias("n"))
    deg = lambda side, out: edges.groupBy("video_id", F.col(side).alias("name")).agg(F.count(F.lit(1)).alias(out))
    d = n.join(deg("dst", "din"), ["video_id", "name"], "left").join(deg("src", "dout"), ["video_id", "name"], "left").na.fill(0, ["din", "dout"])
    share = lambda c: F.when(F.col("n") <= 1, 1.0).otherwise(F.col(c) / (F.col("n") - 1))
    return d.select("video_id", "name", share("din").alias("in_degree_centrality"), share("dout").alias("out_degree_centrality"))


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    m = edges.groupBy("video_id").agg(F.count(F.lit(1)).alias("m"))
    d = n.join(m, "video_id", "left").na.fill(0, ["m"])
    return d.select("video_id", "n", "m", F.when(F.col("n") > 1, F.col("m") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("density"))


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 20, damping: float = 0.85, cut_every: int = 5) -> DataFrame:
    """Of the reversed graph (rank flows from dependents to prerequisites), unweighted, per video; DataFrame form.

    One join and one pre-aggregated sum per iteration, both keyed alike; dangling mass is spread evenly.
    """
    edges = materialise(edges.select("video_id", "src", "dst"), "edges")
    size = Window.partitionBy("video_id")
    base = nodes.select("video_id", "name").withColumn("n", F.count(F.lit(1)).over(size))
    out = edges.groupBy("video_id", F.col("dst").alias("name")).agg(F.count(F.lit(1)).alias("deg"))
    base = materialise(base.join(out, ["video_id", "name"], "left"), "ranks")
    ranks = base.withColumn("r", F.lit(1.0) / F.col("n"))
    for i in range(iterations):
        flow = ranks.where("deg IS NOT NULL").select("video_id", F.col("name").alias("dst"), (F.col("r") / F.col("deg")).alias("f"))
        got = edges.join(flow, ["video_id", "dst"]).groupBy("video_id", F.col("src").alias("name")).agg(F.sum("f").alias("f"))
        loose = ranks.where("deg IS NULL").groupBy("video_id").agg(F.sum("r").alias("loose"))
        ranks = base.join(got, ["video_id", "name"], "left").join(loose, "video_id", "left").withColumn("r", (1 - damping) / F.col("n") + damping * (F.coalesce("f", F.lit(0.0)) + F.coalesce("loose", F.lit(0.0)) / F.col("n"))).select("video_id", "name", "n", "deg", "r")
        if i % cut_every == cut_every - 1:
            ranks = materialise(ranks, "ranks")
    return ranks.select("video_id", "name", F.col("r").alias("pagerank"))


def hits(nodes: DataFrame, edges: DataFrame, iterations: int = 8) -> DataFrame:
    """Hubs and authorities after a fixed number of rounds, each scaled to sum 1; DataFrame form."""
    edges = materialise(edges.select("video_id", "src", "dst"), "edges")
    nodes = materialise(nodes.select("video_id", "name"), "nodes")
    h = nodes.withColumn("hub", F.lit(1.0))
    per = Window.partitionBy("video_id")
    scaled = lambda df, c: df.withColumn(c, F.col(c) / F.sum(c).over(per))
    a = None
    for i in range(iterations):
        a = scaled(edges.join(h.withColumnRenamed("name", "src"), ["video_id", "src"]).groupBy("video_id", F.col("dst").alias("name")).agg(F.sum("hub").alias("auth")), "auth")
        h = scaled(edges.join(a.withColumnRenamed("name", "dst"), ["video_id", "dst"]).groupBy("video_id", F.col("src").alias("name")).agg(F.sum("auth").alias("hub")), "hub")
        if i % 4 == 3:
            h, a = materialise(h, "hub"), materialise(a, "auth")
    return nodes.select("video_id", "name").join(h, ["video_id", "name"], "left").join(a, ["video_id", "name"], "left").na.fill(0.0, ["hub", "auth"]).select("video_id", "name", F.col("hub").alias("hub_score"), F.col("auth").alias("authority_score"))


def depth(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Longest path from a root in an acyclic graph; only nodes whose depth rose are relaxed again.

    A node deeper than its video has nodes stands on a cycle; that, not a number of rounds, ends the work with an error.
    """
    edges = materialise(edges.select("video_id", "src", "dst"), "edges")
    keep = Superseded(nodes.sparkSession)
    best = keep(nodes.select("video_id", "name", F.lit(0).alias("depth"), F.lit(True).alias("up"), F.count(F.lit(1)).over(Window.partitionBy("video_id")).alias("n")), "depth")
    while True:
        front = best.where("up").select("video_id", F.col("name").alias("src"), "depth")
        step = edges.join(front, ["video_id", "src"]).groupBy("video_id", F.col("dst").alias("name")).agg((F.max("depth") + 1).alias("d"))
        d = F.coalesce("d", F.lit(0))
        best = keep(best.drop("up").join(step, ["video_id", "name"], "left").select("video_id", "name", F.greatest("depth", d).alias("depth"), (d > F.col("depth")).alias("up"), "n"), "depth")
        state = best.agg(F.max("up"), F.max(F.col("depth") >= F.col("n"))).first()
        if state[1]:
            raise ValueError("the graph has a cycle; break cycles first")
        if not state[0]:
            return best.select("video_id", "name", "depth")


def closure(edges: DataFrame, seeds: DataFrame, forward: bool) -> DataFrame:
    """video_id, name (seed), reached: all ancestors (forward=False) or descendants of the seeds, without themselves."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    step = materialise(edges.select(F.col("video_id").alias("v"), F.col(a).alias("at"), F.col(b).alias("next")).distinct(), "steps")
    keep = Superseded(edges.sparkSession)
    seen = keep(seeds.select("video_id", "name", F.col("name").alias("reached"), F.lit(0).alias("hop")).distinct(), "seen")
    hop = 0
    while True:  # until no round finds anything new
        front = seen.where(F.col("hop") == hop)
        new = front.join(step, (F.col("video_id") == F.col("v")) & (F.col("reached") == F.col("at"))).select("video_id", "name", F.col("next").alias("reached")).distinct()
        new = new.join(seen, ["video_id", "name", "reached"], "left_anti").withColumn("hop", F.lit(hop + 1))
        seen, hop = keep(seen.unionByName(new), "seen"), hop + 1
        if seen.where(F.col("hop") == hop).isEmpty():
            return seen.where("name <> reached").drop("hop")


def ancestors(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return closure(edges, seeds, forward=False)


def descendants(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    return closure(edges, seeds, forward=True)


def learning_path(metrics: DataFrame) -> DataFrame:
    """Order of study: depth, then out-degree and PageRank falling, first mention, importance falling, name.

    On the graph that depth was computed on this is a topological order, as depth rises along every edge.
    """
    w = Window.partitionBy("video_id").orderBy("depth", F.desc("out_degree"), F.desc("pagerank"), F.coalesce("first_sec", F.lit(9999)), F.desc("importance_score"), "name")
    return metrics.select("video_id", F.row_number().over(w).alias("step"), "name")


# --- per-video kernels ----------------------------------------------------------------------------------------------
class Graph:
    """One video's graph for the kernels."""

    def __init__(self, names: list[str], edges: list[tuple[str, str, float]]):
        self.names = names
        at = {n: i for i, n in enumerate(names)}
        self.edges = {(at[s], at[d]): c for s, d, c in edges if s in at and d in at}
        self.n = len(names)
        self.out, self.into = defaultdict(list), defaultdict(list)
        for s, d in self.edges:
            self.out[s].append(d)
            self.into[d].append(s)

    def pagerank(self, damping=0.85, rounds=100, tol=1e-6):
        n = self.n
        r = np.full(n, 1.0 / n)
        deg = np.array([len(self.into[i]) for i in range(n)], float)
        s, d = np.array([e[0] for e in self.edges], int), np.array([e[1] for e in self.edges], int)
        for _ in range(rounds):
            new = np.full(n, (1 - damping) / n + damping * r[deg == 0].sum() / n)
            if len(s):
                np.add.at(new, s, damping * r[d] / deg[d])
            if np.abs(new - r).sum() < n * tol:
                return new
            r = new
        return np.full(n, 1.0 / n)

    def betweenness(self):
        n, score = self.n, np.zeros(self.n)
        for s in range(n):
            dist, paths, before, order = {s: 0}, defaultdict(float, {s: 1.0}), defaultdict(list), [s]
            for v in order:
                for w in self.out[v]:
                    if w not in dist:
                        dist[w] = dist[v] + 1
                        order.append(w)
                    if dist[w] == dist[v] + 1:
                        paths[w] += paths[v]
                        before[w].append(v)
            delta = defaultdict(float)
            for w in reversed(order):
                for v in before[w]:
                    delta[v] += paths[v] / paths[w] * (1 + delta[w])
                if w != s:
                    score[w] += delta[w]
        return score / ((n - 1) * (n - 2)) if n > 2 else score

    def hits(self, rounds=100, tol=1e-8):
        m = np.zeros((self.n, self.n))
        for s, d in self.edges:
            m[s, d] = 1
        h = np.full(self.n, 1.0 / self.n)
        if not self.edges:
            return np.zeros(self.n), np.zeros(self.n)
        for _ in range(rounds):
            a = m.T @ h
            new = m @ a
            new /= new.sum()
            if np.abs(new - h).sum() < tol:
                h = new
                break
            h = new
        a = m.T @ h
        return h, a / a.sum()

    def acyclic(self) -> set[tuple[int, int]]:
        """Edges left after removing, again and again, the weakest edge that lies on a cycle (ties by names)."""
        left = set(self.edges)
        while True:
            comp = self._strong(left)
            inside = [e for e in left if comp[e[0]] == comp[e[1]]]
            if not inside:
                return left
            left.remove(min(inside, key=lambda e: (self.edges[e], self.names[e[0]], self.names[e[1]])))

    def _strong(self, edges):
        out = defaultdict(list)
        for s, d in edges:
            out[s].append(d)
        index, low, comp, stack, count = {}, {}, {}, [], [0]
        for root in range(self.n):
            if root in index:
                continue
            work = [(root, iter(out[root]))]
            index[root] = low[root] = count[0]
            count[0] += 1
            stack.append(root)
            while work:
                v, it = work[-1]
                for w in it:
                    if w not in index:
                        index[w] = low[w] = count[0]
                        count[0] += 1
                        stack.append(w)
                        work.append((w, iter(out[w])))
                        break
                    if w not in comp:
                        low[v] = min(low[v], index[w])
                else:
                    work.pop()
                    if work:
                        low[work[-1][0]] = min(low[work[-1][0]], low[v])
                    if low[v] == index[v]:
                        while True:
                            w = stack.pop()
                            comp[w] = v
                            if w == v:
                                break
        return comp

    def depths(self, dag):
        into, out, level = defaultdict(int), defaultdict(list), [0] * self.n
        for s, d in dag:
            into[d] += 1
            out[s].append(d)
        ready = [i for i in range(self.n) if not into[i]]
        for v in ready:
            for w in out[v]:
                level[w] = max(level[w], level[v] + 1)
                into[w] -= 1
                if not into[w]:
                    ready.append(w)
        return level

    def communities(self):
        """Modularity communities (local moves and merging, in name order); numbered by size, then smallest member."""
        order = sorted(range(self.n), key=self.names.__getitem__)
        weight = defaultdict(float)
        for s, d in self.edges:
            if s != d:
                weight[(s, d) if s < d else (d, s)] = 1.0
        member = {i: i for i in range(self.n)}
        total = sum(weight.values())
        if total:
            groups, links = {i: [i] for i in order}, dict(weight)
            while True:
                near, degree = defaultdict(lambda: defaultdict(float)), defaultdict(float)
                for (a, b), w in links.items():
                    degree[a] += w
                    degree[b] += w
                    if a != b:
                        near[a][b] += w
                        near[b][a] += w
                own = {g: g for g in groups}
                mass = {g: degree[g] for g in groups}
                moved = True
                while moved:
                    moved = False
                    for g in groups:
                        to = defaultdict(float)
                        for h, w in near[g].items():
                            to[own[h]] += w
                        mass[own[g]] -= degree[g]
                        gain = lambda c: to[c] - mass[c] * degree[g] / (2 * total)  # noqa: B023, E731
                        best = max([own[g], *to], key=lambda c: (round(gain(c), 12), c == own[g]))
                        moved |= best != own[g]
                        own[g] = best
                        mass[best] += degree[g]
                merged = defaultdict(list)
                for g, nodes in groups.items():
                    merged[own[g]] += nodes
                if len(merged) == len(groups):
                    break
                new = defaultdict(float)
                for (a, b), w in links.items():
                    x, y = sorted((own[a], own[b]))
                    new[x, y] += w
                groups, links = dict(merged), dict(new)
            member = {i: g for g, nodes in groups.items() for i in nodes}
        found = defaultdict(list)
        for i in range(self.n):
            found[member[i]].append(self.names[i])
        ranked = sorted(found, key=lambda g: (-len(found[g]), min(found[g])))
        return [ranked.index(member[i]) for i in range(self.n)]


def graph_metrics(nodes: DataFrame, edges: DataFrame, damping: float = 0.85) -> DataFrame:
    """All node metrics of every video in one grouped pass; see METRICS."""

    def run(key, n, e):
        names = sorted(n["name"].unique())
        if not names:
            return pd.DataFrame(columns=[c.split()[0] for c in METRICS.split(", ")])
        g = Graph(names, list(e[["src", "dst", "confidence"]].itertuples(index=False, name=None)))
        hub, authority = g.hits()
        share = 1 / (g.n - 1) if g.n > 1 else None
        deg = lambda d: [1.0 if share is None else len(d[i]) * share for i in range(g.n)]
        community = g.communities() if g.n > 1 else [0]
        return pd.DataFrame({"video_id": key[0], "name": names, "pagerank": g.pagerank(damping), "betweenness": g.betweenness(), "in_degree_centrality": deg(g.into), "out_degree_centrality": deg(g.out), "hub_score": hub, "authority_score": authority, "depth": g.depths(g.acyclic()), "community": community})

    return nodes.select("video_id", "name").groupBy("video_id").cogroup(edges.select("video_id", "src", "dst", "confidence").groupBy("video_id")).applyInPandas(run, METRICS.format(key=nodes.schema["video_id"].dataType.simpleString()))


def break_cycles(edges: DataFrame) -> DataFrame:
    """Edges of the acyclic graph that depth and learning path are computed on."""

    def run(key, e):
        names = sorted({*e["src"], *e["dst"]})
        left = Graph(names, list(e[["src", "dst", "confidence"]].itertuples(index=False, name=None))).acyclic()
        keep = {(names[s], names[d]) for s, d in left}
        return e[[(s, d) in keep for s, d in zip(e["src"], e["dst"])]]

    return edges.groupBy("video_id").applyInPandas(run, edges.schema)


def kahn(names: list[str], edges: list[tuple[str, str]], key) -> list[str]:
    """Topological order that takes the smallest key among the ready; the yardstick of learning_path in tests."""
    into = {n: 0 for n in names}
    for _, d in edges:
        into[d] += 1
    heap = [(key(n), n) for n in names if not into[n]]
    heapq.heapify(heap)
    out = []
    while heap:
        _, v = heapq.heappop(heap)
        out.append(v)
        for s, d in edges:
            if s == v:
                into[d] -= 1
                if not into[d]:
                    heapq.heappush(heap, (key(d), d))
    return out


# --- graph queries --------------------------------------------------------------------------------------------------
def neighbourhood(edges: DataFrame, video_id: str, name: str, hops: int = 2) -> DataFrame:
    """name, hop of the nodes within `hops` undirected steps."""
    e = edges.where(F.col("video_id") == video_id)
    both = e.select(F.col("src").alias("at"), F.col("dst").alias("next")).unionByName(e.select(F.col("dst").alias("at"), F.col("src").alias("next"))).distinct()
    seen = both.sparkSession.createDataFrame([(name, 0)], "name string, hop int")
    for h in range(1, hops + 1):
        new = seen.where(F.col("hop") == h - 1).join(both, F.col("name") == F.col("at")).select(F.col("next").alias("name"), F.lit(h).alias("hop"))
        seen = seen.unionByName(new).groupBy("name").agg(F.min("hop").alias("hop"))
    return seen


def select_nodes(nodes: DataFrame, names: list[str]) -> DataFrame:
    return nodes.where(F.col("name").isin(names))


def nodes_with(nodes: DataFrame, prop: str, values: list) -> DataFrame:
    """Nodes whose property, as text, is one of values; empty, zero and false values never match."""
    c = F.col(prop).cast("string")
    return nodes.where(c.isin([str(v) for v in values]) & ~c.isin("", "0", "0.0", "false"))


def ends_of_edges_with(edges: DataFrame, prop: str, values: list) -> DataFrame:
    c = F.col(prop).cast("string")
    e = edges.where(c.isin([str(v) for v in values]) & ~c.isin("", "0", "0.0", "false"))
    return e.select("video_id", F.explode(F.array("src", "dst")).alias("name")).distinct()
