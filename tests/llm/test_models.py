import pickle
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from kgraph.llm import common, linecrf, quality, toxicity
from tests.llm.fixtures import documents, empty, texts

D = "/root/testdata/sf0.1"


def labelled(spark, target):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    y = spark.read.parquet(f"{D}/labels.parquet").groupBy("doc_id").agg(F.max(target).alias("y"))
    return docs, spark.read.parquet(f"{D}/labels.parquet"), y


def auc(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(len(score))
    return (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())


def held_out(spark, scores, y):
    p = scores.where("held_out").join(y, "doc_id").toPandas()
    assert ((p["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5) == 0)).all()
    return p


def test_toxicity_held_out(spark):
    docs, labels, y = labelled(spark, "toxic")
    model = toxicity.trained(docs, labels)
    p = held_out(spark, toxicity.score_toxicity(docs.join(y, "doc_id", "left_semi").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0), model), y)
    assert auc(p["score"].to_numpy(), p["y"].to_numpy()) > 0.9 and (p["predicted"] == p["y"]).mean() > 0.94
    assert p["score"].between(0, 1).all()


def test_quality_held_out(spark):
    docs, labels, y = labelled(spark, "quality")
    model = quality.trained(docs, labels)
    p = held_out(spark, quality.score_quality(docs.join(y, "doc_id", "left_semi").where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0), model), y)
    assert auc(p["score"].to_numpy(), p["y"].to_numpy()) > 0.97
    assert p[p["y"] == 1]["predicted"].mean() > 0.97 and p[p["y"] == 0]["predicted"].mean() < 0.2


def test_scores_of_edge_rows(spark):
    sample = [("you stupid idiot go away now", 1), ("what a stupid stupid idiot", 1), ("idiot idiot stupid again", 1), ("a calm day at the lake", 0), ("the lake is calm and wide", 0), ("we walked along the shore", 0)] * 4
    for module, score in ((toxicity, toxicity.score_toxicity), (quality, quality.score_quality)):
        model = pickle.dumps(module.fit(sample))
        got = score(documents(spark), model).collect()
        assert len(got) == len(texts()) + 2 and all(0 <= r["score"] <= 1 for r in got)
        assert score(empty(spark), model).count() == 0
        assert module.fit([("only one class", 1)]) is None
        assert score(documents(spark), None).count() == len(texts()) + 2
    docs = documents(spark)
    assert quality.filter_quality(docs, None).collect() == docs.collect()


def brute_counts(text):
    text = text or ""
    blank = " \t\n\v\f\r"
    words, w = [], ""
    for c in text + " ":
        if c in blank:
            if w:
                words.append(w)
            w = ""
        else:
            w += c
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for g in windows:
        seen[g] = seen.get(g, 0) + 1
    covered = {i + k for i, g in enumerate(windows) if seen[g] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if x.strip(blank)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_line_counts_are_brute_forces(spark):
    sample = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(200).collect()  # a fixture
    for t in [*texts(), *(r["text"] for r in sample), "a b c d e f a b c d e", "a " * 9, "q\n q\nq\n\n\n"]:
        got = linecrf.judge(t, None)
        assert got[:5] == brute_counts(t)
        assert got[5] == (got[0] < 10 or 100 * got[4] > 20 * got[0]) and got[6] == (not got[5])


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(0)
    for _ in range(50):
        n = int(rng.integers(1, 8))
        s, t = rng.normal(size=n), rng.normal(size=(2, 2))
        value = lambda p: sum(s[i] for i in range(n) if p[i]) + sum(t[p[i - 1], p[i]] for i in range(1, n))  # noqa: B023, E731
        best = max(([(k >> i) & 1 for i in range(n)] for k in range(1 << n)), key=value)
        assert abs(value(linecrf.viterbi(s, t)) - value(best)) < 1e-9


def test_line_rules_keep_good_documents(spark):
    docs, labels, y = labelled(spark, "quality")
    model = linecrf.trained(docs, labels)
    p = linecrf.line_rules(docs, model).join(y, "doc_id").toPandas()
    p = p[p["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 5) == 0]  # rows that training has not seen
    good, bad = p[(p["y"] == 1) & ~p["base_failed"]], p[p["y"] == 0]
    assert good["kept"].mean() > 0.98 and bad["kept"].mean() < 0.1
    edge = documents(spark)
    kept = linecrf.filter_lines(edge, model)
    assert kept.columns == edge.columns and kept.count() <= edge.count()
    assert linecrf.line_rules(empty(spark), model).count() == 0


def test_lines_of_any_length_are_split_at_the_same_blanks():
    """A no-break space is part of a word, in a short line and in a long one."""
    for n in (3, 300):
        line = " ".join(["two\u00a0parts"] * n)
        x, chars = linecrf.featurise(line)
        assert chars.tolist() == [9 * n] and x.tolist() == [linecrf.line_features(line, ["two\u00a0parts"] * n, False)]


def test_chains_show_steps_between_states():
    sample = [("A calm line.\nAnother one.", 1), ("buy | buy | buy\n#### ||||", 0)]
    made = linecrf.chains(sample)
    assert any((y[1:] != y[:-1]).any() for _, y in made) and linecrf.chains(sample[:1]) == []
    trans = linecrf.fit(sample * 4)["trans"]
    assert trans[0, 0] > trans[0, 1] and trans[1, 1] > trans[1, 0]


def brute_pool(model, text):
    """Mean context vectors, word by word."""
    v, words = model["vectors"], (text or "").split()
    out = np.zeros((3, quality.DIM))
    for i, w in enumerate(words):
        for k, u in enumerate(quality.units(w)):
            if u in v.row:
                out[k] += v.matrix[v.row[u]]
        if i and w == words[i - 1]:
            out[2] += v.matrix[-1]
    return out.ravel() / max(1, len(words))


def test_pooled_vectors_and_scores_are_brute_forces():
    sample = [("the lake is calm and the shore is wide today", 1), ("we walked along the calm shore of the lake", 1), ("BUY BUY now!!! $$$ cheap cheap pills", 0), ("click here!!! cheap cheap offer $$$ now", 0)] * 4
    m = quality.fit(sample)
    for t in [None, "", "one", "the lake BUY BUY now!!!", "calm calm calm unseen-word the", *(t for t, _ in sample)]:
        x = brute_pool(m, t)
        assert np.allclose(m["vectors"].pool(t), x, atol=1e-5)
        z = np.clip((x - m["mean"]) / m["scale"], -8, 8)
        w1, b1, w2, b2 = m["params"]
        logit = (np.tanh(z @ w1 + b1) @ w2 + b2[0]) / m["temperature"]
        assert abs(quality.scores(m, [t])[0] - 1 / (1 + np.exp(-logit))) < 1e-4


def test_window_savings_are_brute_forces():
    import zstandard as z

    meter = toxicity.Meter(b"the calm lake and the wide shore " * 5, b"stupid idiot " * 5, (1.0, 0.5, 0.004, 0.0001))
    size = lambda content, w: len(z.ZstdCompressor(level=toxicity.LEVEL, dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT), write_checksum=False, write_content_size=False, write_dict_id=False).compress(w))
    plain, toxic = b"the calm lake and the wide shore " * 5, b"stupid idiot " * 5
    for t in ("the calm lake", "you stupid idiot by the calm lake, you stupid idiot", "x " * 40):
        assert meter.saved(t).tolist() == [size(plain, w) - size(toxic + plain, w) for w in toxicity.windows(t)]
    assert meter.saved("a stupid idiot").max() > meter.saved("a quiet morning").max()


def test_ids_beyond_doubles_stay_exact(spark):
    big = (1 << 53) + 1
    rows = [(big, "some words to look at here and now again and again ok", 1), (None, "other words", None), (big + 2, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra long")
    sample = [("bad bad", 0), ("good text here", 1)] * 6
    q, t = pickle.dumps(quality.fit(sample)), pickle.dumps(toxicity.fit(sample))
    for out in (quality.score_quality(docs, q), toxicity.score_toxicity(docs, t), linecrf.line_rules(docs, None)):
        assert {r["doc_id"] for r in out.collect()} == {big, None, big + 2}
    for out in (quality.filter_quality(docs, None), linecrf.filter_lines(docs, None)):
        assert out.schema == docs.schema and (big, 1) in {(r["doc_id"], r["extra"]) for r in out.collect()}


def test_a_model_reaches_the_driver_whole_or_not_at_all(spark, monkeypatch):
    """A model of several pieces is the same on the driver; one that got lost on the way is an error, not "no model"."""
    sample = spark.createDataFrame([("a", 0, 1), ("b", 1, 1)], "text string, label int, _n int")
    want = bytes(range(256)) * 10_000
    assert pickle.loads(common.fitted(sample, lambda rows: (rows, want))) == ([("a", 0), ("b", 1)], want)
    assert common.fitted(sample, lambda rows: None) is None
    assert common.fitted(sample.limit(0), lambda rows: None) is None
    collect = DataFrame.collect
    for left in (0, 1):
        monkeypatch.setattr(DataFrame, "collect", lambda self: collect(self)[:left])
        with pytest.raises(RuntimeError):
            common.fitted(sample, lambda rows: want)
