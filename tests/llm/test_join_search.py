import itertools
import re
from collections import Counter, defaultdict

import numpy as np

from kgraph.llm import mih, partenum
from tests.llm.fixtures import documents, empty, sentence, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def shingle_set(text):
    w = WORD.findall((text or "").translate(FOLD))
    return set(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs):
    sets = [shingle_set(t) for _, t in docs]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    common = Counter(p for h in holders.values() for p in itertools.combinations(h, 2))
    for (a, b), n in common.items():
        if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
            parent[find(a)] = find(b)
    least = {}
    for i, (doc_id, _) in enumerate(docs):
        if doc_id is not None:
            r = find(i)
            least[r] = min(least.get(r, doc_id), doc_id)
    return Counter((doc_id, len(s), least.get(find(i))) for i, ((doc_id, _), s) in enumerate(zip(docs, sets)))


def check(spark, docs):
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in partenum.near_duplicates(df).collect())
    want = brute(docs)
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])


def test_join_on_edge_rows(spark):
    docs = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    check(spark, docs)
    assert partenum.near_duplicates(empty(spark)).count() == 0


def test_join_is_brute_force_on_graded_copies(spark):
    import random

    rng = random.Random(5)
    docs = []
    for size in (3, 5, 6, 8, 12, 20, 40, 90, 200):
        base = sentence(rng, size).split()
        for edits in range(0, 14):
            w = list(base)
            for _ in range(edits):
                k = rng.randrange(3)
                i = rng.randrange(len(w))
                if k == 0:
                    w[i] = rng.choice("abcdefg") * 3
                elif k == 1 and len(w) > 2:
                    del w[i]
                else:
                    w.insert(i, rng.choice("hijklm") * 2)
            docs.append((len(docs) * 3 + 1, " ".join(w)))
    check(spark, docs)


def test_join_with_one_large_group(spark, monkeypatch):
    """More members than SMALL and than BLOCK, borderline pairs among them."""
    import random

    monkeypatch.setattr(partenum, "BLOCK", 16)
    rng = random.Random(9)
    base = sentence(rng, 70).split()
    docs = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(40)}"
        docs.append((1000 - i, " ".join(w)))
    check(spark, docs)


def test_join_on_documents(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    check(spark, docs)


def test_signatures_meet():
    """Sets at exactly 0.8 share a signature, and sketches never refute a link."""
    rng = np.random.default_rng(1)
    for n in [1, 4, 5, 9, 10, 25, 45, 90, 300, 1200]:
        for _ in range(20):
            common = rng.integers(0, 1 << 63, size=n, dtype=np.uint64)
            room = n // 4
            k = int(rng.integers(0, room + 1))
            a = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, size=k, dtype=np.uint64)]))
            b = np.unique(np.concatenate([common, rng.integers(0, 1 << 63, size=room - k, dtype=np.uint64)]))
            assert partenum._similar(len(a), len(b), n)
            assert np.array_equal(a, b) or np.intersect1d(partenum.signatures(a), partenum.signatures(b)).size
            x, y = np.frombuffer(partenum.sketch(a), np.uint64), np.frombuffer(partenum.sketch(b), np.uint64)
            w = min(len(x), len(y))
            assert 9 * int(np.bitwise_count(partenum.fold(x, w) ^ partenum.fold(y, w)).sum()) <= len(a) + len(b)


def test_drop_near_duplicates(spark):
    docs = documents(spark)
    out = partenum.drop_near_duplicates(docs)
    assert out.columns == docs.columns
    left = Counter(r["doc_id"] for r in out.collect())
    groups = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    want = {doc_id for doc_id, n, c in groups if n == 0 or doc_id == c}
    assert set(left) == want and max(left.values()) == 1


def test_drop_with_repeated_and_large_ids_and_clashing_names(spark):
    big = (1 << 53) + 1
    text, other = "a b c d e f g h i j", "k l m n o p q r s t"
    rows = [(big, text, 1), (big + 1, text, None), (7, other, 2), (7, text, 3), (7, other, 2), (None, "x y z", 4), (None, None, 5), (9, " ", 6), (big, "", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _node long")
    out = sorted(map(tuple, partenum.drop_near_duplicates(docs).collect()), key=str)
    assert out == sorted([(7, other, 2), (7, text, 3), (None, "x y z", 4), (None, None, 5), (9, " ", 6), (big, "", 7)], key=str)
    got = {(r["doc_id"], r["component_id"]) for r in partenum.near_duplicates(docs.where("doc_id > 10")).collect()}
    assert got == {(big, big), (big + 1, big)}


def test_frequent_signatures_leave_their_bucket():
    """What a task has of a frequent signature beyond a few nodes is dealt elsewhere, and no node is lost."""
    sig = np.array([7] * 5000 + [8] * 3 + [7], np.uint64)
    node = np.arange(len(sig), dtype=np.int64) + (1 << 60)
    t = partenum._light(sig, node, 4, 0).to_pylist()
    assert max(len(r["nodes"]) // 8 for r in t if r["key"] is None) <= partenum.SMALL + 1 + 3
    chunks = [r for r in t if r["key"] is not None]
    assert len(chunks) > 1 and all(r["bucket"] >= 4 and len(r["nodes"]) <= 8 * partenum.CHUNK for r in chunks)
    got = [partenum._gathered(partenum.pa.Table.from_pylist(list(rs), partenum._light(sig, node, 4, 0).schema)).to_pylist() for _, rs in itertools.groupby(sorted(t, key=lambda r: r["bucket"]), key=lambda r: r["bucket"])]
    members = [(r["key"], m) for rs in got for r in rs if r["key"] is not None for m in r["members"]]
    assert {m for _, m in members} == set(node[sig == 7].tolist()) and len({k for k, _ in members}) == 1
    assert sum(r["a"] is not None for rs in got for r in rs) == 3


def test_join_of_many_texts_that_share_a_passage(spark):
    """One group of unrelated texts around one passage, and links among a few of them."""
    import random

    rng = random.Random(4)
    passage = sentence(rng, 60)
    docs = []
    for i in range(60):
        own = sentence(rng, 25)
        docs += [(10 * i, f"{passage} {own}"), (10 * i + 1, f"{passage} {own} tail")][: 1 + (i % 4 == 0)]
    check(spark, docs)


def exact(rows, k):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], float)
    out = {}
    for i in np.nonzero(ids % 20 == 0)[0]:
        s = (x * x[i]).sum(1)
        order = np.lexsort((ids, -s))
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order if j != i][:k]
    return out


def test_recall_on_embeddings(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want = exact(rows, 20)
    got = defaultdict(list)
    for r in mih.nearest(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    recall = np.mean([len({a for a, _ in got[q]} & {a for a, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9, recall
    scores = {q: dict(v) for q, v in want.items()}
    for q, v in got.items():
        assert v == sorted(v, key=lambda t: (-t[1], t[0]))
        assert all(abs(s - scores[q][a]) < 1e-12 for a, s in v if a in scores[q])


def test_search_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 2.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0]), (40, []), (None, [1.0, 1.0]), (0, [1.0, 0.0]), (9, [-3.0, 4.0])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label string, rank int")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in mih.nearest(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 20, 0.0), (0, 4, 9, -3.0), (20, 1, 9, 8.0), (20, 2, 0, 0.0), (20, 3, 1, 0.0), (20, 4, 2, 0.0)]
    assert mih.nearest(df.limit(0)).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    df = spark.createDataFrame([(i, [0.6, 0.8, 0.0]) for i in range(200)] + [(1000, [0.8, 0.6, 0.0])], "vec_id long, embedding array<float>")
    got = [r["vec_id"] for r in mih.nearest(df).where("query_id = 100").orderBy("rank").collect()]
    assert got == list(range(20))
