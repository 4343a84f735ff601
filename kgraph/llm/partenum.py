"""N-gram Jaccard join by PartEnum signatures, and the groups its links form.

A document is the set of its word 5-grams (hashes of 64 bits). Documents with equal sets are one node; nodes are what is
joined. Sizes are cut into bands whose ends differ by the factor 1 / 0.8, so linked sets lie in one band or in
neighbours, and the symmetric difference of two linked sets up to size r has at most k = 2r/9 members. For its own band and
the next, the domain is cut by hash into n1 parts, a few more than (k + 1) / (SPREAD + 1), and each part into PARTS smaller
ones. Of two linked sets some part differs in SPREAD members at most, so that PARTS - SPREAD of its smaller parts agree:
a signature is a part, a subset of that many smaller parts, and the hash of the members in them. Subsets without members
are signed only where a set has too few filled parts for that argument to hold without them.

Nodes that share a signature are candidates. A bucket of signatures is gathered by one task, but what a task has of one
signature beyond SMALL + 1 nodes goes elsewhere, dealt by chunk, so no task gathers a frequent signature. Groups of up to SMALL
nodes give their pairs. A larger group (once per distinct group) is dealt to blocks of about BLOCK nodes; a block offers
for each node its nearest partner there and its nearest among some PIVOTS nodes that visit every block of the group.
Where a group then still falls into several components, all nodes outside its largest one meet all nodes of the group, in
pairs of blocks, and every pair across components is offered: no link between different components is lost, and
no group is expanded into all of its pairs unless its nodes are not linked. What is offered has passed a sound filter (the
parity sketches of two sets differ in no more bits than the sets in members) and is verified on whole sets.

Defined results: null, empty and blank texts have no shingles, are linked with nothing and are their own component; texts
of fewer than five words are one shingle; rows that repeat a doc_id are separate documents that share the id; a
component of null ids only has a null id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import itertools
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgraph.llm.common import materialise, slices, table, with_columns
from kgraph.operators.iterate import components

SHINGLE, SMALL, BLOCK, PIVOTS = 5, 8, 512, 64
SPREAD, PARTS = 1, 3
FLUSH, BUCKET_SIGNATURES, BIN_MEMBERS, BROADCAST_ROWS = 1_000_000, 1_000_000, 4_000, 500_000
CHUNK = 4096
U = np.uint64
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_BASE, _STEP = 0x2545F4914F6CDD1D, 0xD6E8FEB86659FD93
LEAST = [1]  # smallest size of each band; the largest is 5/4 of it
while LEAST[-1] < 1 << 40:
    LEAST.append(LEAST[-1] * 5 // 4 + 1)
MOST = np.array([x * 5 // 4 for x in LEAST])
LEAST = np.array(LEAST)
SUBSETS = list(itertools.combinations(range(PARTS), PARTS - SPREAD))
_MULTIPLIERS = [pow(0xA24BAED4963EE407, k + 1, 1 << 64) for k in range(PARTS)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    """Powers of the base and of its inverse modulo 2**64."""

    up = down = np.ones(1, U)

    @classmethod
    def of(cls, n: int):
        while len(cls.up) < n:
            m = len(cls.up)
            cls.up = np.concatenate([cls.up, cls.up * U(pow(_BASE, m, 1 << 64))])
            cls.down = np.concatenate([cls.down, cls.down * U(pow(_BASE, -m, 1 << 64))])
        return cls.up[:n], cls.down[:n]


def word_hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
    solid = np.zeros(len(raw) + 2, np.int8)
    solid[1:-1] = ~_BLANK[raw]
    edge = np.diff(solid)
    start, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    if not len(start):
        return np.zeros(0, U)
    up, down = _Powers.of(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, U)
    np.cumsum(raw * up[: len(raw)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(U) * U(0x9E3779B97F4A7C15))


def shingles(text) -> np.ndarray:
    """Sorted distinct hashes of a text's 5-word shingles."""
    if not isinstance(text, str):
        return np.zeros(0, U)
    with np.errstate(over="ignore"):
        h = word_hashes(text)
        n = len(h)
        if n == 0:
            return h
        width = min(SHINGLE, n)
        g = h[: n - width + 1].copy()
        for k in range(1, width):
            g = g * U(_STEP) + h[k : n - width + 1 + k]
        return np.unique(mix(g + U(width)))


def node_of(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes(), seed=len(s)) - (1 << 63)


def sketch(s: np.ndarray) -> bytes:
    """Parities of the members' counts in at least twice as many cells as members."""
    cells = max(256, 1 << (2 * len(s) - 1).bit_length())
    c = np.bincount((mix(s ^ U(0x5BD1E995)) & U(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(c.astype(np.uint8)).tobytes()


def fold(words: np.ndarray, n: int) -> np.ndarray:
    while len(words) > n:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


_BASES: dict[int, np.ndarray] = {}


def _base(level: int, n1: int) -> np.ndarray:
    """What tells the signatures of a band apart before their members do: the part and the subset."""
    if level not in _BASES:
        _BASES[level] = mix(np.arange(n1 * len(SUBSETS), dtype=U) * U(0xD1342543DE82EF95) + U(level) * U(0x9E3779B97F4A7C15)).reshape(n1, -1)
    return _BASES[level]


def signatures(s: np.ndarray) -> np.ndarray:
    """Signatures of a set (sorted) for its own band and the next; sets of a band that only equal sets can link with have none."""
    m = len(s)
    band = int(np.searchsorted(LEAST, m, side="right")) - 1
    out = [np.zeros(0, U)]
    weight = (s >> U(11)).astype(float)
    with np.errstate(over="ignore"):
        for level in (band, band + 1):
            most = int(MOST[level])
            if most < 5:  # sizes up to 4 leave no room for a difference
                continue
            n1 = int(1.08 * (2 * most // 9 + 1)) // (SPREAD + 1) + 2
            differ = (m + min(most, 5 * m // 4)) // 9
            cell = ((s * U(2 * level + 1) * U(_STEP)) >> U(33)) % U(n1 * PARTS)
            # equal members, in equal order, give equal sums; a smaller part counts as filled if its sum is not 0
            sums = np.bincount(cell.astype(np.int64), weight, n1 * PARTS)
            filled = (sums > 0).reshape(n1, PARTS)
            robust = np.count_nonzero(filled.sum(1) > SPREAD)  # whichever smaller parts differ, one with members agrees
            held = mix(sums.view(U) + U(level)).reshape(n1, PARTS)
            x, some = _base(level, n1), np.zeros((n1, len(SUBSETS)), bool)
            for k, which in enumerate(zip(*SUBSETS)):
                which = list(which)
                x = x + held[:, which] * U(_MULTIPLIERS[k])
                some |= filled[:, which]
            x = mix(x)
            out.append(x.ravel() if robust <= differ // (SPREAD + 1) else x[some])
    return np.concatenate(out)


def _similar(n_a, n_b, common) -> bool:
    return 100 * common >= 80 * (n_a + n_b - common)


def _numbers(column) -> np.ndarray:
    return column.combine_chunks().to_numpy(zero_copy_only=False) if isinstance(column, pa.ChunkedArray) else column.to_numpy(zero_copy_only=False)


def _pairs(found: list[np.ndarray]) -> pa.Table:
    pairs = np.unique(np.concatenate([np.zeros((0, 2), np.int64), *found]), axis=0)
    return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})


def describe(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node (null without shingles) and sketch, materialised."""

    def compute():
        def run(texts):
            sets = [shingles(t) for t in texts]
            return [len(s) for s in sets], [node_of(s) if len(s) else None for s in sets], [sketch(s) if len(s) else None for s in sets]

        return run

    return materialise(with_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text", "n_shingles long, node long, sketch binary", compute), "sets")


def _key(sig, buckets: int) -> int:
    """What names the group of a signature: its bucket and 32 bits of the rest."""
    return ((int(sig) // buckets) & 0xFFFFFFFF) << 30 | int(sig) % buckets


def _light(sig: np.ndarray, node: np.ndarray, buckets: int, salt: int):
    """Rows (bucket, key, sigs, at, nodes) of one flush: signatures by bucket, and chunks of the nodes of frequent ones, dealt anywhere."""
    order = np.argsort(sig, kind="stable")
    sig, node = sig[order], node[order]
    new = np.r_[True, sig[1:] != sig[:-1]]
    start = np.nonzero(new)[0]
    place = np.arange(len(sig)) - np.repeat(start, np.diff(np.r_[start, len(sig)]))
    rest = place > SMALL
    rows = []
    if rest.any():
        hs, hn = sig[rest], node[rest]
        cut = np.nonzero(np.r_[True, hs[1:] != hs[:-1]])[0]
        for lo, hi in zip(cut, np.r_[cut[1:], len(hs)]):
            for at in range(lo, hi, CHUNK):
                to = buckets + (int(hs[lo]) ^ (salt + at)) % buckets
                rows.append((to, _key(hs[lo], buckets), b"", b"", hn[at : min(hi, at + CHUNK)].tobytes()))
    sig, node = sig[~rest], node[~rest]
    b = (sig % U(buckets)).astype(np.int64)
    order = np.argsort(b, kind="stable")
    sig, node, b = sig[order], node[order], b[order]
    cut = np.searchsorted(b, np.arange(buckets + 1))
    for i in np.nonzero(np.diff(cut))[0]:
        own, at = np.unique(node[cut[i] : cut[i + 1]], return_inverse=True)
        rows.append((int(i), None, (sig[cut[i] : cut[i + 1]] // U(buckets)).astype(np.uint32).tobytes(), at.astype(np.uint16 if len(own) <= 1 << 16 else np.uint32).tobytes(), own.tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "key", "sigs", "at", "nodes"])


def _gathered(t: pa.Table) -> pa.Table:
    """Rows (a, b) of small groups, and (key, members) of parts of large ones, of one bucket."""
    keys, big = [], []
    sigs, nodes = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
    bucket = t.column("bucket")[0].as_py()
    for key, s, at, n in zip(*(t.column(c).to_pylist() for c in ("key", "sigs", "at", "nodes"))):
        if key is not None:
            keys.append(key)
            big.append(np.frombuffer(n, np.int64))
            continue
        s = np.frombuffer(s, np.uint32)
        sigs.append(s)
        nodes.append(np.frombuffer(n, np.int64)[np.frombuffer(at, np.uint16 if len(at) == 2 * len(s) else np.uint32)])
    sig, node = np.concatenate(sigs), np.concatenate(nodes)
    order = np.argsort(sig, kind="stable")
    sig, node = sig[order], node[order]
    same = sig[1:] == sig[:-1]
    shared = np.zeros(len(sig), bool)
    shared[1:] |= same
    shared[:-1] |= same
    sig, node = sig[shared], node[shared]
    order = np.lexsort((node, sig))
    sig, node = sig[order], node[order]
    many = np.unique(sig[SMALL:][sig[SMALL:] == sig[:-SMALL]]) if len(sig) > SMALL else sig[:0]  # more than SMALL records, also of one node
    first = np.ones(len(sig), bool)
    first[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
    sig, node = sig[first], node[first]
    start = np.nonzero(np.r_[True, sig[1:] != sig[:-1]])[0] if len(sig) else np.zeros(0, int)
    count = np.diff(np.r_[start, len(sig)])
    large = np.isin(sig[start], many)
    pairs = [np.zeros((0, 2), np.int64)]
    for size in range(2, SMALL + 1):
        at = start[(count == size) & ~large]
        for x in range(size):
            for y in range(x + 1, size):
                pairs.append(np.stack([node[at + x], node[at + y]], 1))
    pairs = np.unique(np.concatenate(pairs), axis=0)
    for i, n in zip(start[large], count[large]):
        for lo in range(i, i + n, CHUNK):
            keys.append(int(sig[i]) << 30 | bucket)
            big.append(node[lo : min(i + n, lo + CHUNK)])
    rows = len(pairs)
    return pa.table(
        {
            "a": pa.concat_arrays([pa.array(pairs[:, 0]), pa.nulls(len(big), pa.int64())]),
            "b": pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(len(big), pa.int64())]),
            "key": pa.concat_arrays([pa.nulls(rows, pa.int64()), pa.array(keys, pa.int64())]),
            "members": pa.concat_arrays([pa.nulls(rows, pa.list_(pa.int64())), pa.array(big, pa.list_(pa.int64()))]),
        }
    )


def candidates(docs: DataFrame, buckets: int) -> DataFrame:
    """Rows (a, b) of small groups and (key, members) of parts of large ones, materialised."""

    def emit(batches):
        held_s, held_n, size, seen, flushes = [], [], 0, set(), 0
        for piece in slices(batches):
            for t in piece.column(0).to_pylist():
                s = shingles(t)
                if not len(s) or (node := node_of(s)) in seen:  # copies sign once per task
                    continue
                if len(seen) < 500_000:  # beyond, a copy signs again, and the gathering task drops it
                    seen.add(node)
                g = signatures(s)
                held_s.append(g)
                held_n.append(np.full(len(g), node, np.int64))
                size += len(g)
                if size >= FLUSH:
                    yield _light(np.concatenate(held_s), np.concatenate(held_n), buckets, flushes)
                    held_s, held_n, size, flushes = [], [], 0, flushes + 1
        if size:
            yield _light(np.concatenate(held_s), np.concatenate(held_n), buckets, flushes)

    signed = docs.select("text").mapInArrow(emit, "bucket int, key long, sigs binary, at binary, nodes binary")
    return materialise(signed.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_gathered, "a long, b long, key long, members array<long>"), "candidates")


def _fits(n_a, n_b) -> np.ndarray:
    return 5 * np.minimum(n_a, n_b) >= 4 * np.maximum(n_a, n_b)


def plausible_pairs(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches allow a link."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))

    def run(batches):
        for piece in slices(batches, 5000):
            a, b, n_a, s_a, n_b, s_b = (piece.column(i) for i in range(6))
            ok = _fits(_numbers(n_a), _numbers(n_b))
            n = _numbers(n_a) + _numbers(n_b)
            for i in np.nonzero(ok)[0]:
                x, y = np.frombuffer(s_a[i].as_buffer(), U), np.frombuffer(s_b[i].as_buffer(), U)
                w = min(len(x), len(y))
                ok[i] = 9 * int(np.bitwise_count(fold(x, w) ^ fold(y, w)).sum()) <= n[i]
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(ok))

    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.select("a", "b", "n_a", "s_a", "n_b", "s_b").mapInArrow(run, "a long, b long")


def large_groups(found: DataFrame) -> DataFrame:
    """key, size, node: the large groups, each distinct one once, materialised."""
    each = materialise(found.where("key IS NOT NULL").select("key", F.explode("members").alias("node")).distinct(), "members")
    whole = each.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"))
    once = whole.where("size > 1").groupBy("size", "x", "y").agg(F.min("key").alias("key")).select("key", "size")
    return materialise(each.join(once, "key").select("key", "size", "node"), "groups")


def _deal(n, *salt):
    return F.pmod(F.xxhash64(*salt), n).cast("int")


def _in_bins(rows: DataFrame, nodes: DataFrame, run, total: int) -> DataFrame:
    """run over tables of the rows, joined with size and sketch, whose (key, i, j) fall into one bin of about BIN_MEMBERS rows."""
    bins = max(1, -(-total // BIN_MEMBERS))
    full = rows.join(nodes.select("node", "n_shingles", "sketch"), "node").withColumn("bin", _deal(F.lit(bins), "key", "i", "j"))
    return full.groupBy("bin").applyInArrow(run, "a long, b long").distinct()


def _parts(t: pa.Table):
    """(nodes, sizes, sketches, other columns) of each (key, i, j) of a bin."""
    key = np.stack([_numbers(t.column(c)) for c in ("key", "i", "j")])
    order = np.lexsort(key)
    key = key[:, order]
    cut = np.nonzero(np.r_[True, (key[:, 1:] != key[:, :-1]).any(0)])[0] if len(order) else []
    sketches = t.column("sketch").combine_chunks()
    columns = {c: _numbers(t.column(c)) for c in t.column_names if c != "sketch"}
    for lo, hi in zip(cut, [*cut[1:], len(order)]):
        at = order[lo:hi]
        words = [np.frombuffer(sketches[int(i)].as_buffer(), U) for i in at]
        width = min(map(len, words))
        yield np.stack([fold(w, width) for w in words]), {c: v[at] for c, v in columns.items()}


def _near(sk, n, x, among) -> tuple[np.ndarray, np.ndarray]:
    """Those among the rows that the filters allow to be linked with x, and the distances of their sketches."""
    at = among[_fits(n[among], n[x])]
    dist = np.bitwise_count(sk[at] ^ sk[x]).sum(1).astype(np.int64) if len(at) else np.zeros(0, np.int64)
    near = 9 * dist <= n[at] + n[x]
    return at[near], dist[near]


def _nearest(t: pa.Table) -> pa.Table:
    """For each resident of a block its nearest smaller resident and its nearest pivot."""
    found = []
    for sk, c in _parts(t):
        node, n, pivot = c["node"], c["n_shingles"], c["visits"] > 0
        residents, pivots = np.nonzero(~pivot)[0], np.nonzero(pivot)[0]
        for x in residents:
            for among in (residents[node[residents] < node[x]], pivots[node[pivots] != node[x]]):
                at, dist = _near(sk, n, x, among)
                if len(at):
                    y = at[np.lexsort((node[at], dist))[0]]
                    found.append(np.array([[min(node[x], node[y]), max(node[x], node[y])]]))
    return _pairs(found)


def _across(t: pa.Table) -> pa.Table:
    """Pairs of a visitor (a node outside the group's largest component) and a resident of another component."""
    found = []
    for sk, c in _parts(t):
        node, n, root, visits = c["node"], c["n_shingles"], c["root"], c["visits"] > 0
        residents = np.nonzero(~visits)[0]
        for x in np.nonzero(visits)[0]:
            at, _ = _near(sk, n, x, residents[root[residents] != root[x]])
            if len(at):
                found.append(np.stack([np.minimum(node[at], node[x]), np.maximum(node[at], node[x])], 1))
    return _pairs(found)


def offer_nearest(groups: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """Pairs (a, b) within blocks of large groups, and with their pivots."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = groups.select("key", "node", F.lit(0).alias("i"), _deal(blocks, "node", "key").alias("j"), F.lit(0).alias("visits"))
    pivot = groups.where((F.col("size") > BLOCK) & (_deal(blocks * max(1, BLOCK // PIVOTS), "node", "key", F.lit(1)) == 0))
    visits = pivot.select("key", "node", F.lit(0).alias("i"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("j"), F.lit(1).alias("visits"))
    return _in_bins(own.unionByName(visits), nodes, _nearest, int(1.2 * total))


def offer_across(groups: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame | None:
    """Pairs (a, b) of different components in groups that hold several; None if no group does."""
    named = groups.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    each = named.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
    split = each.groupBy("key").agg(F.count(F.lit(1)).alias("roots"), F.max_by("root", F.struct("n", "root")).alias("major"), (F.sum("n") - F.max("n")).alias("minors"))
    named = materialise(named.join(split.where("roots > 1").drop("roots"), "key"), "split")
    blocks, sides = F.ceil(F.col("size") / BLOCK).cast("int"), F.ceil(F.col("minors") / BLOCK).cast("int")
    total = named.agg(F.sum(sides + F.when(F.col("root") != F.col("major"), blocks).otherwise(0))).first()[0]
    if not total:
        return None
    each_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    stay = named.select("key", "node", "root", each_of(sides).alias("i"), _deal(blocks, "node", "key").alias("j"), F.lit(0).alias("visits"))
    visit = named.where("root <> major").select("key", "node", "root", _deal(sides, "node", "key", F.lit(2)).alias("i"), each_of(blocks).alias("j"), F.lit(1).alias("visits"))
    return _in_bins(stay.unionByName(visit), nodes, _across, int(total))


def verify(pairs: DataFrame, docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (materialised) that are links, by their whole sets, materialised."""
    needed = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    holders = materialise(nodes.join(needed, "node", "left_semi").select(F.col("least").alias("holder")).distinct(), "holders")
    small = holders.count() <= BROADCAST_ROWS  # 8 bytes a row

    def load(batches):
        for piece in slices(batches):
            sets = [s for t in piece.column(0).to_pylist() if len(s := shingles(t))]
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "members"])

    texts = docs.select(F.col("doc_id").cast("long").alias("_holds"), "text")
    texts = texts.join(F.broadcast(holders) if small else holders, F.col("_holds").eqNullSafe(F.col("holder")), "left_semi")
    sets = texts.select("text").mapInArrow(load, "node long, members binary").groupBy("node").agg(F.first("members").alias("members"))
    sets = materialise(sets, "members")

    def run(batches):
        for piece in slices(batches, 1000):
            ok = np.zeros(len(piece), bool)
            for i in range(len(piece)):
                x, y = (np.frombuffer(piece.column(k)[i].as_buffer(), U) for k in (2, 3))
                ok[i] = _similar(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)))
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1)], names=["a", "b"]).filter(pa.array(ok))

    side = lambda c: sets.select(F.col("node").alias(c), F.col("members").alias(f"m_{c}"))
    return materialise(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "m_a", "m_b").mapInArrow(run, "a long, b long"), "links")


def grouped(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node, component_id, keeper: whether the node holds its component's smallest doc_id."""
    spark = docs.sparkSession
    base = describe(docs)
    nodes = base.where("node IS NOT NULL").groupBy("node").agg(F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("least"))
    nodes = materialise(nodes, "nodes")
    total = nodes.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    buckets = max(2 * spark.sparkContext.defaultParallelism, -(-int(0.9 * total) // BUCKET_SIGNATURES))
    found = candidates(docs, buckets)
    groups = large_groups(found)
    n_members = groups.count()
    first = plausible_pairs(found.where("a IS NOT NULL").select("a", "b").distinct(), nodes)
    if n_members:
        first = first.unionByName(offer_nearest(groups, nodes, n_members)).distinct()
    first = materialise(first, "pairs")
    links = verify(first, docs, nodes)
    roots = components(links)
    if n_members:
        second = offer_across(groups, nodes, roots)
        if second is not None:
            second = materialise(second.join(first, ["a", "b"], "left_anti"), "pairs")
            if not second.isEmpty():
                links = links.unionByName(verify(second, docs, nodes))
                roots = components(links)
    named = nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = named.groupBy("root").agg(F.min(F.struct(F.col("least").isNull(), "least", "node")).alias("best"))
    named = named.join(best, "root").select("node", F.col("best.least").alias("component_id"), (F.col("node") == F.col("best.node")).alias("keeper"))
    out = base.select("doc_id", "n_shingles", "node").join(named, "node", "left")
    return out.select("doc_id", "n_shingles", "node", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("keeper", F.lit(True)).alias("keeper"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id."""
    return grouped(docs).select("doc_id", "n_shingles", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group: that with the smallest doc_id. Documents without words are kept.

    Ids all of whose rows go, or stay, are settled by id; only rows of ids that do both, or that repeat a row that
    stays, are told apart by their sets.
    """
    stays = F.col("node").isNull() | (F.col("keeper") & F.col("doc_id").eqNullSafe(F.col("component_id")))
    rows = materialise(grouped(docs).select("doc_id", "node", stays.alias("stays")), "grouped")
    stay, twice = F.sum(F.col("stays").cast("int")), F.sum((F.col("stays") & F.col("node").isNotNull()).cast("int"))
    ids = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), stay.alias("stay"), twice.alias("twice")).where("stay < n OR twice > 1")
    ids = materialise(ids.select(F.col("doc_id").alias("id"), ((F.col("stay") > 0) | (F.col("twice") > 1)).alias("mixed")), "gone")
    unique = uuid.uuid4().hex  # names that no column of docs has
    id_, node = f"_id_{unique}", f"_node_{unique}"
    small = F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids  # 9 bytes a row
    doc_id = docs["doc_id"].cast("long")
    out = docs.join(small.select(F.col("id").alias(id_)), doc_id.eqNullSafe(F.col(id_)), "left_anti")
    mixed = ids.where("mixed")
    if mixed.isEmpty():
        return out
    told = docs.join(mixed.select(F.col("id").alias(id_)), doc_id.eqNullSafe(F.col(id_)), "left_semi").withColumn(id_, doc_id)

    def compute():
        return lambda texts: ([node_of(s) if len(s := shingles(t)) else None for t in texts],)

    told = told.withColumn(f"_text_{unique}", F.col("text"))
    told = with_columns(told, f"_text_{unique}", f"{node} long", compute)
    gone = rows.where("NOT stays").select(F.col("doc_id").alias("_gone_id"), F.col("node").alias("_gone_node")).distinct()
    told = told.join(gone, F.col(id_).eqNullSafe(F.col("_gone_id")) & (F.col(node) == F.col("_gone_node")), "left_anti")
    words = told.where(F.col(node).isNotNull()).dropDuplicates([id_, node])
    return out.unionByName(words.unionByName(told.where(F.col(node).isNull())).drop(id_, node))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
