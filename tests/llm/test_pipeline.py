"""The corpus pipeline end to end, each stage against a brute-force version of it on the same rows."""

import pickle
import zlib
from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from kgraph.llm import linecrf, mixing, packing, quality
from tests.llm.fixtures import documents, empty
from tests.llm.test_join_search import brute
from tests.llm.test_mixing_packing import ids

D = "/root/testdata/sf0.001"


def stages(spark, folder, docs, sf_dir):
    """What each stage leaves, written and read again as the next one's input."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def table(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_are_brute_forces(spark, tmp_path):
    docs, labels = spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")
    rules, classified, joined, mixed, packed = stages(spark, str(tmp_path), docs, D)
    for left in (rules, classified, joined, mixed):
        assert left.columns == docs.columns
    crf = linecrf.trained(docs, labels)
    crf = pickle.loads(crf) if crf else None
    assert table(rules) == Counter(tuple(r) for r in docs.collect() if linecrf.judge(r["text"], crf)[6])
    model = quality.trained(docs, labels)
    model = pickle.loads(model) if model else None
    assert table(classified) == Counter(tuple(r) for r in rules.collect() if quality.scores(model, [r["text"]])[0] >= quality.THRESHOLD)
    rows = classified.collect()
    stay = {doc_id for doc_id, n, c in brute([(r["doc_id"], r["text"]) for r in rows]) if n == 0 or doc_id == c}
    assert table(joined) == Counter(tuple(r) for r in rows if r["doc_id"] in stay)
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/ngram_join/*.parquet')")
    copies = dict(duck.sql(f"SELECT doc_id, copies FROM ({mixing.ORACLE})").fetchall())
    assert Counter(r["doc_id"] for r in mixed.collect()) == Counter({k: v for k, v in copies.items() if v})
    want = Counter()
    for r in mixed.collect():
        v = ids(r["text"])
        for start, length in packing.cuts(len(v)):
            want[(r["doc_id"], start, length, zlib.crc32(v[start : start + length].tobytes()))] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in packed.collect()) == want
    got = corpus_pipeline.run(spark, D)
    assert got.columns == packed.columns and got.count() == packed.count()


@pytest.mark.parametrize("rows", [empty, documents])
def test_empty_and_odd_tables(spark, tmp_path, rows):
    """No rows; nulls, repeats, long ids and extra columns whose names the operators use inside."""
    docs = rows(spark)
    docs.limit(0).selectExpr("doc_id", "1 AS quality", "0 AS toxic").write.parquet(str(tmp_path / "sf" / "labels.parquet"))
    docs.write.parquet(str(tmp_path / "sf" / "documents.parquet"))
    out = stages(spark, str(tmp_path / "out"), docs, str(tmp_path / "sf"))
    for left in out[:-1]:
        assert left.schema.simpleString() == docs.schema.simpleString()
    known = {r["doc_id"] for r in docs.collect()}
    assert {r["doc_id"] for r in out[-1].collect()} <= known and (not known or out[-1].count() > 0)
