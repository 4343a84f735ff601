import os
import random
import re
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgraph.llm import mixing, packing
from tests.llm.fixtures import documents, empty, texts
from tests.oracle import connect, rows

D = "/root/testdata/sf0.001"


def test_mix_against_sql(spark):
    got, want = mixing.op1_mix_sources(spark, D).toPandas(), connect(D).sql(mixing.ORACLE).df()
    assert rows(got) == rows(want)


def test_mix_writes_no_file_for_each_shuffle_partition(spark, tmp_path):
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        mixing.op1_mix_sources(spark, D).write.parquet(f"{tmp_path}/out")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(list((tmp_path / "out").glob("part-*"))) <= 16
    assert rows(spark.read.parquet(f"{tmp_path}/out").toPandas()) == rows(connect(D).sql(mixing.ORACLE).df())


def test_mix_shares(spark):
    rows_ = [(i, f"s{i % 4}", 1 + i % 50) for i in range(4000)] + [(9000 + i, None, 3) for i in range(10)] + [(9999, "zero", 0)]
    plan = mixing.mix_plan(spark.createDataFrame(rows_, "doc_id long, source string, size long"), "size").collect()
    per = defaultdict(lambda: [0, 0.0, 0])
    for r in plan:
        assert 0 <= r["taken"] <= 3 * r["size"]
        per[r["source"]][0] += r["taken"]
        per[r["source"]][1:] = [r["target"], r["source_size"]]
    total = sum(v[2] for v in per.values())
    assert abs(sum(v[1] for v in per.values()) - total) < 1e-6 * total
    for taken, target, size in per.values():
        assert target <= 3 * size + 1e-9 and abs(taken - target) <= max(150, 0.01 * target)
    again = mixing.mix_plan(spark.createDataFrame(rows_, "doc_id long, source string, size long").repartition(7), "size").collect()
    assert sorted(plan, key=str) == sorted(again, key=str)


def test_mix_edge_rows(spark):
    docs = documents(spark)
    out = mixing.mix_sources(docs)
    assert out.columns == docs.columns
    n = Counter(r["doc_id"] for r in out.collect())
    assert all(v <= 6 for v in n.values())  # the repeated row counts as two
    assert mixing.mix_sources(empty(spark)).count() == 0


def test_sizes_of_odd_texts(spark):
    rng = random.Random(5)
    letters = " \t\n\x0b\x0c\r  ab\x01\x1f\x00\x85\xa0\u00e9\u4e2d\U0001f600$\\"
    cases = [None, "", " ", "\n\t ", "x", " x", "x ", *("".join(rng.choice(letters) for _ in range(rng.randrange(14))) for _ in range(3000)), "a " * 100_000, " " * 100_000]
    got = spark.createDataFrame([(t,) for t in cases], "text string").select("text", mixing.size_of(F.col("text")).alias("n")).collect()
    assert len(got) == len(cases) and all(r["n"] == len(re.findall("[^\x20\x09-\x0d]+", r["text"] or "")) for r in got)


LONG_TEXT = """
from pyspark.sql import SparkSession, functions as F
from kgraph.llm.mixing import size_of
spark = SparkSession.builder.master("local[2]").config("spark.driver.memory", "512m").config("spark.ui.enabled", "false").getOrCreate()
print("SIZE", spark.range(1).select(size_of(F.repeat(F.lit("a "), (F.col("id") + 7_000_000).cast("int")))).first()[0])
"""


def test_size_of_a_long_text_holds_no_list_of_words():
    """A text of 14 MB in a heap of 512 MB, of which a list of its words takes all; in a session of its own, as the lack of memory would end it."""
    env = {k: v for k, v in os.environ.items() if not k.startswith(("SPARK_", "PYSPARK_"))}
    done = subprocess.run([sys.executable, "-c", LONG_TEXT], env=env, capture_output=True, text=True, timeout=300)
    assert "SIZE 7000000" in done.stdout, done.stderr[-2000:]


def ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path())
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")


@pytest.mark.parametrize("text", [t for t in texts() if t is None or len(t) < 5000] + ["<|ENDOFTEXT|> don't, X. É! ΣΑΣ. İI a,b ... 's", "aujourd'hui l'eau, 中文,x ǅ ß ² ①a"])
def test_word_ids_are_the_tokenizers(text):
    w = packing.WordIds(packing.tokenizer_path())
    assert w(text) == ids(text)[:-1].tobytes() == w(text)


def test_pack_holds_every_id_once(spark):
    docs = documents(spark)
    got = packing.pack_documents(docs).collect()
    want = Counter()
    for r in docs.collect():
        v = ids(r["text"])
        for start, length in packing.cuts(len(v)):
            want[(r["doc_id"], start, length, zlib.crc32(v[start : start + length].tobytes()), len(v))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    seqs = defaultdict(list)
    for r in got:
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in seqs.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.SEQ_LEN
    assert packing.pack_documents(empty(spark)).count() == 0


@pytest.mark.parametrize("seed,grid", [(0, 16), (1, 1), (2, 64)])
def test_patterns_hold_the_histogram_with_little_padding(seed, grid):
    rng = np.random.default_rng(seed)
    hist = Counter(n for x in rng.geometric(1 / 300, 3000 if grid > 1 else 60_000) for _, n in packing.cuts(int(min(x, 2047)), 2048, grid))
    if grid == 1:
        hist = Counter({k: v for k, v in hist.items() if k % 16 == 0} or hist)
    out = Counter()
    cost = 0
    for pattern, n in packing.solve_patterns(dict(hist)):
        assert n > 0 and sum(k * a for k, a in pattern.items()) <= 2048
        cost += packing.padded(sum(k * a for k, a in pattern.items())) * n
        for k, a in pattern.items():
            out[k] += a * n
    total = sum(k * v for k, v in hist.items())
    assert out == hist and cost / total < 1.02


def test_cuts():
    assert packing.cuts(0) == [] and packing.cuts(1) == [(0, 1)] and packing.cuts(4096) == [(0, 2048), (2048, 2048)]
    assert packing.cuts(2048 + 37) == [(0, 2048), (2048, 32), (2080, 5)]
    assert packing.solve_patterns({}) == []


def test_words_of_proven_letters_are_the_tokenizers():
    """Every letter of the proven alphabets, and some beyond, before, after and between others, with marks after them."""
    from tokenizers import Tokenizer

    w, t = packing.WordIds(packing.tokenizer_path()), Tokenizer.from_file(packing.tokenizer_path())
    assert w.by_word
    chars = [chr(c) for c in (*range(33, 0x560), *range(0x900, 0xA80, 3), 0x958, 0x95F, 0xA33, 0xA5E, 0xB5C, 0x130, 0x3A3, 0x1E9E, 0xFB01)]
    for c in chars:
        for text in (f"{c},", f"a{c};", f"{c}a!.", f"{c}{c}"):
            assert w(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_other_vocabularies_are_used_as_they_are():
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    w, t = packing.WordIds(path), Tokenizer.from_file(path)
    assert not w.by_word
    for text in ("Two  Words\n here", "", "\u00c9t\u00e9,"):
        assert w(text) == np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_ranks_do_not_depend_on_buckets(spark):
    from kgraph.llm.common import ranked

    df = spark.range(500).selectExpr("id", "id % 3 AS k")
    one, many = ({(r["id"], r["_rank"]) for r in ranked(df, ["k"], "id", ["id"], n).collect()} for n in (1, 300))
    assert one == many and {n for _, n in one} == set(range(1, 168))


def test_large_ids_and_full_sequences(spark):
    big = (1 << 53) + 1
    docs = spark.createDataFrame([(big, "word " * 5000), (None, None), (big, "word " * 5000)], "doc_id long, text string")
    got = packing.pack_documents(docs).collect()
    assert {r["doc_id"] for r in got} == {big, None}
    full = [r["sequence_id"] for r in got if r["length"] == packing.SEQ_LEN]
    assert len(full) == len(set(full)) == 4 and not set(full) & {r["sequence_id"] for r in got if r["length"] < packing.SEQ_LEN}
    mixed = mixing.mix_sources(spark.createDataFrame([(big, "a b", None), (None, "c", "s")], "doc_id long, text string, source string"))
    assert {r["doc_id"] for r in mixed.collect()} <= {big, None}
