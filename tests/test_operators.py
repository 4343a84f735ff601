"""Hand-worked cases: one per rule that is easy to get wrong."""

import random

import pytest
from pyspark.sql import functions as F

from kgraph.config import Config, api_key, substitute
from kgraph.functions import scalars as S
from kgraph.functions.dims import CUES, DEFAULT_HINGLISH, DEFAULT_TELUGU, load_lexicons, merge_lexicons
from kgraph.functions.romanise import romanise
from kgraph.operators import concepts as C
from kgraph.operators import export, extraction, graph, relations
from kgraph.operators import normalise as N


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text,want", [("पहले", "pahale"), ("ముందు", "mundu"), ("stack", "stack"), ("ज़रूरी है।", "zarooree hai."), ("محمّد", "mhmmd"), ("", ""), (None, None), ("a पहले b", "a pahale b"), ("ఁ౿x", "nx")])
def test_romanise(spark, text, want):
    assert one(spark, text, romanise) == want


def test_lexicon_precedence():
    assert merge_lexicons({"_meta": {"q": "r"}, "a": {"X": "1"}, "b": {"x": ""}}, {"a": {"x": "2", "y": "3"}, "b": {"y": "4"}}) == {"x": "", "y": "3"}


@pytest.mark.parametrize("text,want", [("achha (Dekho)!", "achha (see)!"), ("stack ke baad queue", "stack after queue"), ("depend", "depends on"), ("  ", "  ")])
def test_normalise(spark, text, want):
    assert one(spark, text, lambda c: N.normalise_text(c, load_lexicons())) == want


def test_first_fixture(spark):
    t = spark.createDataFrame([("v", "Pehle arrays samjho phir linked list easy lagega.")], "video_id string, text string")
    seg = N.segments_from_text(t)
    r = seg.first()
    assert (r["seg_id"], r["start"], r["end"], r["timestamp_label"]) == (0, 0.0, 10.0, "0:00")
    n = N.normalise_segments(seg, load_lexicons()).first()
    assert n["text"] == "first arrays understand then linked list easy will seem"


def test_rule_pipeline(spark):
    from kgraph.plans.pipeline import Pipeline
    from kgraph.sources.readers import text_transcripts

    t = spark.createDataFrame([("v", "Pehle arrays samjho phir linked list easy lagega.")], "video_id string, text string")
    r = Pipeline(spark).run(text_transcripts(t))
    got = {x["name"]: x for x in r.concepts.collect()}
    assert set(got) == {"array", "linked list"}  # "list" is part of "linked list"
    assert got["linked list"]["timestamps"] == ["0:00"] and got["array"]["timestamps"] == [] and got["array"]["first_mention"] is None
    e = r.edges.collect()
    assert [(x["src"], x["dst"], x["confidence"]) for x in e] == [("array", "linked list", 0.8)]
    assert [x["name"] for x in r.path.orderBy("step").collect()] == ["array", "linked list"]
    assert '"learning_path":["array","linked list"]' in r.documents.first()["document"]


def test_time_labels(spark):
    df = spark.createDataFrame([(0.0, "0:00"), (75.9, "1:15"), (3605.0, "60:05")], "s double, l string")
    for r in df.select("l", S.time_label(F.col("s")).alias("a"), S.label_seconds(F.col("l")).alias("b"), F.floor("s").alias("s")).collect():
        assert r["a"] == r["l"] and r["b"] == r["s"]
    assert one(spark, "1:2:3", lambda c: S.label_seconds(c, 9999), "string") == 9999


def test_small_functions(spark):
    assert one(spark, "b-tree", S.title_case) == "B-Tree"
    assert one(spark, "o(n)", S.title_case) == "O(N)"
    assert one(spark, 2.675, lambda c: S.round_half(c, 2), "double") == 2.67
    assert one(spark, "Push aur pop or peek", S.conjuncts) == ["push", "pop", "peek"]
    assert S.chunk_text("aaaa bbbb cccc dddd", 10, 0.2) == ["aaaa bbbb", "bb cccc", "cc dddd"]
    assert S.chunk_text("", 10, 0.2) == [] and S.chunk_text("x" * 25, 10, 0.2) == ["x" * 10, "x" * 10, "x" * 9]
    raws = ['{"a": 1}', 'text ```json\n{"a": 1}\n``` more', 'Sure: {"a": "}"} done', "no json", None]
    assert [S.repair_json(r) for r in raws] == ['{"a": 1}', '{"a": 1}', '{"a": "}"}', "{}", "{}"]


def test_config(tmp_path):
    from kgraph.config import load, validate

    assert substitute({"a": ["${X:1}", "${Y}"]}, {"Y": "2"}) == {"a": ["1", "2"]}
    assert api_key("groq", {"groq": {"api_key": "k"}}, {}) == "k" and api_key("groq", {}, {"GROQ_API_KEY": "e"}) == "e"
    p = tmp_path / "c.yaml"
    p.write_text("extractor:\n  min_concept_score: 0.2\n  weights: {domain_match: 0.6, rake: 0.2, frequency: 0.2}\n")
    assert load(str(p)).domain_weight == 0.6 and load(str(p)).min_concept_score == 0.2
    p.write_text("extractor:\n  weights: {domain_match: 0.9}\n")
    assert validate(str(p)) and validate(str(tmp_path / "none.yaml"))


def test_terms_of_any_length_count(spark):
    long = ["one two three four five six seven", "time complexity of o(n log n)", " ".join(f"w{i}" for i in range(60)), "two"]
    text = f"{long[0]}. The {long[1]} is {long[2]}, then {long[2]}"
    terms = spark.createDataFrame([(t,) for t in long], "term string")
    texts = spark.createDataFrame([("v", text)], "video_id string, text string")
    got = {r["term"]: r["n"] for r in C.term_counts(texts, terms, ["video_id"]).collect()}
    assert got == dict(zip(long, (1, 1, 2, 1)))
    segments = spark.createDataFrame([("v", 0, 0.0, "00:00", text)], "video_id string, seg_id int, start double, timestamp_label string, text string")
    assert {r["name"] for r in C.mentions(segments, terms.withColumnRenamed("term", "name")).collect()} == set(long)
    assert C.term_counts(texts, terms.limit(0), ["video_id"]).count() == 0


def test_overlapping_terms_all_count(spark):
    t = spark.createDataFrame([("v", "Binary search tree, binary  search; o(n)x and arrays")], "video_id string, text string")
    terms = spark.createDataFrame([(x,) for x in ("binary search tree", "binary search", "tree", "array", "arrays", "o(n)")], "term string")
    got = {r["term"]: r["n"] for r in C.term_counts(t, terms, ["video_id"]).collect()}
    assert got == {"binary search tree": 1, "binary search": 1, "tree": 1, "arrays": 1, "o(n)": 1}


def test_ambiguity_promotion_and_sub_concepts(spark):
    t = spark.createDataFrame([("v", "the new operator calls free memory"), ("w", "a new day")], "video_id string, text string")
    c = spark.createDataFrame([("v", "new", 0.5), ("w", "new", 0.5), ("v", "oper", 0.4)], "video_id string, concept string, score double")
    got = {(r["video_id"], r["concept"]) for r in C.keep_unambiguous(c, t).collect()}
    assert got == {("v", "new operator"), ("v", "oper")}
    assert [r["concept"] for r in C.drop_sub_concepts(C.keep_unambiguous(c, t)).collect()] == ["new operator"]


def test_temporal_fixture(spark):
    f = spark.createDataFrame([("v", n, s, f"{s // 60}:{s % 60:02d}") for n, s in zip("ABCDE", (0, 40, 180, 600, 1200))], "video_id string, name string, first_sec int, first_mention string")
    e = {(r["src"] + r["dst"]): round(r["confidence"], 4) for r in relations.temporal_edges(f).collect()}
    assert e == {"AB": 0.3633, "AC": 0.41, "AD": 0.55, "BC": 0.3967, "BD": 0.5367, "BE": 0.55, "CD": 0.49, "CE": 0.55, "DE": 0.55}
    kept = {(r["src"] + r["dst"]) for r in relations.keep_confident(relations.temporal_edges(f)).collect()}
    assert kept == {"AC", "AD", "BD", "BE", "CD", "CE", "DE"}


def test_weak_temporal_edge_hides_cooccurrence(spark):
    f = spark.createDataFrame([("v", "A", 0, "0:00"), ("v", "B", 40, "0:40")], "video_id string, name string, first_sec int, first_mention string")
    m = spark.createDataFrame([("v", 9, "1:30", "A"), ("v", 9, "1:30", "B")], "video_id string, seg_id int, timestamp_label string, name string")
    merged = relations.priority_merge([relations.temporal_edges(f), relations.cooccurrence_edges(m, f)])
    assert [r["detection_method"] for r in merged.collect()] == ["temporal_order"] and relations.keep_confident(merged).count() == 0


CUE_CASES = [
    (0, "pehle array samjho phir stack aayega"), (1, "pehle array phir stack"), (2, "array ke baad stack aayega"), (3, "array stack pe depend karta hai"), (4, "array ka concept stack par depend karta hai"),
    (5, "array samjhne ke liye pehle stack samjho"), (6, "array ke liye stack zaruri hai"), (7, "array zaroori hai stack ke liye"), (8, "array ke bina stack mushkil"), (9, "array ka base stack hai"), (10, "array se stack banta hai"),
    (11, "before learning array, you should know stack"), (12, "array is a prerequisite for stack"), (13, "array depends on stack"), (14, "first learn array then stack"), (15, "after array comes stack"), (16, "array leads to stack"),
    (17, "you need array to understand stack"), (18, "without array, stack is not possible"), (19, "array mein stack use hota hai"), (20, "array stack istemal karta hai"), (21, "array stack se banaya karte hai"), (22, "array uses stack"),
    (23, "array is implemented using stack"), (24, "array works on stack"), (25, "array ke andar stack aata hai"),
]


def test_every_cue_has_a_match(spark):
    s = spark.createDataFrame([(i, t) for i, t in CUE_CASES] + [(99, "nothing of the kind here")], "case int, sentence string")
    hits = {(r["case"], r["pat_idx"]) for r in relations.cue_matches(s, CUES).collect()}
    assert {(i, i) for i, _ in CUE_CASES} <= hits and not any(c == 99 for c, _ in hits)


def test_pattern_edge_takes_first_hit_not_best(spark):
    seg = spark.createDataFrame([("v", 0, "0:00", "array uses stack", "array uses stack"), ("v", 1, "0:10", "array depends on stack", "array depends on stack")], "video_id string, seg_id int, timestamp_label string, text string, original_text string")
    c = spark.createDataFrame([("v", "array", 1), ("v", "stack", 2), ("v", "tack", 3)], "video_id string, name string, concept_rank int")
    e = relations.pattern_edges(seg, c, CUES).collect()
    assert [(r["src"], r["dst"], r["confidence"], r["timestamp"]) for r in e] == [("stack", "array", 0.7, "0:00")]


def test_multi_source_fixture(spark):
    rows = [("v", "a", "b", "p", 0.9, "x", "1:00", "llm", 0), ("v", "a", "b", "p", 0.8, "y", "", "pattern_matching", 1), ("w", "a", "b", "p", 0.9, "x", "", "llm", 0), ("w", "a", "b", "p", 0.8, "y", "", "pattern_matching", 1), ("w", "a", "b", "p", 0.45, "z", "", "cooccurrence", 2)]
    e = spark.createDataFrame(rows, "video_id string, src string, dst string, relation string, confidence double, evidence string, timestamp string, detection_method string, ord int")
    got = {r["video_id"]: (round(r["confidence"], 4), r["detection_method"], r["evidence"], r["timestamp"]) for r in graph.merge_sources(e).collect()}
    assert got["v"] == (0.9125, "llm+pattern_matching", "x", "") and got["w"] == (0.8974, "llm+pattern_matching+cooccurrence", "x", "")


def test_graph_fixture(spark):
    n = spark.createDataFrame([("v", x) for x in "abcd"], "video_id string, name string")
    e = spark.createDataFrame([("v", a, b, 0.5) for a, b in ("ab", "ac", "bd", "cd")], "video_id string, src string, dst string, confidence double")
    m = {r["name"]: r for r in graph.graph_metrics(n, e).collect()}
    assert [m[x]["depth"] for x in "abcd"] == [0, 1, 1, 2]
    assert [round(m[x]["betweenness"], 4) for x in "abcd"] == [0, 0.0833, 0.0833, 0]
    assert [round(m[x]["in_degree_centrality"], 4) for x in "abcd"] == [0, 0.3333, 0.3333, 0.6667]
    assert abs(sum(r["pagerank"] for r in m.values()) - 1) < 1e-6 and abs(sum(r["hub_score"] for r in m.values()) - 1) < 1e-6
    d = graph.density(n, e).first()
    assert round(d["density"], 4) == 0.3333
    up = {r["reached"] for r in graph.ancestors(e, n.where("name = 'd'")).collect()}
    assert up == {"a", "b", "c"}
    loose = {r["name"]: r["pagerank"] for r in graph.pagerank(n, e, 50).collect()}
    assert all(abs(loose[x] - m[x]["pagerank"]) < 1e-4 for x in "abcd")
    assert {r["name"]: r["hop"] for r in graph.neighbourhood(e, "v", "a").collect()} == {"a": 0, "b": 1, "c": 1, "d": 2}


def test_learning_path_is_kahn_on_random_dags(spark):
    rng = random.Random(3)
    for _ in range(20):
        names = [f"n{i}" for i in range(8)]
        edges = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if rng.random() < 0.3]
        g = graph.Graph(names, [(a, b, 0.5) for a, b in edges])
        depth = dict(zip(names, g.depths(g.acyclic())))
        out = {n: sum(a == n for a, _ in edges) for n in names}
        key = lambda n: (depth[n], -out[n], n)  # noqa: B023, E731
        assert graph.kahn(names, edges, key) == sorted(names, key=key)


def test_cycles_lose_their_weakest_edge():
    g = graph.Graph(list("abc"), [("a", "b", 0.9), ("b", "c", 0.8), ("c", "a", 0.4)])
    assert {(g.names[s], g.names[d]) for s, d in g.acyclic()} == {("a", "b"), ("b", "c")}


def test_communities_of_two_triangles():
    e = [(a, b, 0.5) for a, b in ("ab", "bc", "ac", "de", "ef", "df", "cd")]
    assert graph.Graph(list("abcdef"), e).communities() == [0, 0, 0, 1, 1, 1]


def test_merge_keeps_the_canonicals_first_mention(spark):
    c = spark.createDataFrame([("v", "linked list", 0.9, 2, "1:00", ["1:00"], 1), ("v", "linked lists", 0.5, 3, "0:10", ["0:10", "1:00"], 2)], "video_id string, name string, importance_score double, frequency long, first_mention string, timestamps array<string>, concept_rank int")
    m = graph.canonical_map(c, graph.similar_names(c, 0.82))
    r = graph.merge_concepts(c, m).collect()
    assert len(r) == 1 and (r[0]["name"], r[0]["frequency"], r[0]["first_mention"], r[0]["timestamps"]) == ("linked list", 5, "1:00", ["1:00", "0:10"])


def test_model_extraction(spark):
    def client(prompt, json_mode):
        if json_mode and "long" in prompt:
            raise ValueError("token limit")
        if prompt.startswith("List"):
            return 'Here: ```json\n{"domain": "CS", "concepts": [{"name": "Stack", "importance_score": 0.9}, {"name": "Binary_Search_Tree"}]}\n```'
        return '{"relationships": [{"from": "stack", "to": "BST", "confidence": 0.8}, {"from": "stack", "to": "queue"}, {"from": "stack", "to": "stack"}, {"from": "", "to": "stack"}]}'

    t = spark.createDataFrame([("v", "long talk about a stack")], "video_id string, full_text string")
    seg = N.segments_from_text(t.withColumnRenamed("full_text", "text"))
    c, e, d = extraction.extract_with_model(t, seg, client, Config())
    got = {r["name"]: (r["importance_score"], r["frequency"], r["timestamps"]) for r in c.collect()}
    assert got == {"stack": (0.9, 1, ["0:00"]), "binary search tree": (0.5, 1, None)}
    assert [(r["src"], r["dst"], r["confidence"], r["evidence"]) for r in e.collect()] == [("stack", "binary search tree", 0.8, "LLM-inferred")]
    assert d.first()["domain"] == "CS"


def test_scan_cues_are_every_patterns_matches(spark):
    """Every cue, without a gate, by Python's re; offsets included."""
    import re

    from kgraph.functions.dims import SCAN_CUES, gate

    cases = [
        "mundu stack tarvata queue", "pele array fir stack", "Pehle arrays samjho phir lists ab, pehle x phir y z", "heap ke baad tree aur graph ke baad path", "sorting par depend karta hai", "loop zaruri hai array ke liye", "map pe based hai, set par based hai",
        "heap ke bina sort nahi", "munduku a nerchukondi tarvata b c", "x pyna depend avtundi", "x avasaram y kosam", "x meeda based", "a lekunda b kaadu", "nothing here", "", None,
    ]
    t = spark.createDataFrame(list(enumerate(cases)), "video_id long, text string")
    got = {(r["video_id"], r["matched_text"], tuple(r["groups"]), r["template"], r["start_pos"], r["end_pos"]) for r in N.scan_cues(t).collect()}
    want = {(i, m[0], m.groups(), template, m.start(), m.end()) for i, c in enumerate(cases) for p, template in SCAN_CUES for m in re.finditer(p, c or "", re.I)}
    assert got == want and {x[3] for x in want} == {template for _, template in SCAN_CUES}
    own = [(r"(.+?)\s+beats\s+(\w+)", "{0} over {1}")]
    assert N.scan_cues(spark.createDataFrame([(1, "rock beats scissors")], "video_id long, text string"), own).first()["groups"] == ["rock", "scissors"]
    assert gate(SCAN_CUES[2][0]).startswith(r"ke\s+baad") and gate(r"mund(.+?)x") == r"mund(.+?)x"


def test_chains_deeper_than_any_round_count(spark):
    """Closure and depth end when nothing changes, not after a number of rounds."""
    n = 12
    e = spark.createDataFrame([("v", f"n{i:03}", f"n{i + 1:03}") for i in range(n)], "video_id string, src string, dst string")
    nodes = spark.createDataFrame([("v", f"n{i:03}") for i in range(n + 1)], "video_id string, name string")
    assert graph.descendants(e, nodes.where("name = 'n000'")).count() == n
    assert graph.depth(nodes, e).agg(F.max("depth")).first()[0] == n
    ring = e.unionByName(spark.createDataFrame([("v", f"n{n:03}", "n000")], e.schema))
    with pytest.raises(ValueError, match="cycle"):
        graph.depth(nodes, ring)


def test_doubling_marks_of_any_run(spark):
    from kgraph.functions.romanise import SHADDA, romanise

    one = spark.range(1).select(romanise(F.lit("ب")).alias("x")).first()["x"]
    for k in (0, 1, 4, 9):
        assert spark.range(1).select(romanise(F.lit("ب" + SHADDA * k)).alias("x")).first()["x"] == one * (k + 1)


def test_export_figures_and_fields(spark):
    import json

    c = spark.createDataFrame([("v", "linked_list", "Linked List", 0.123456, 3, "0:10", ["0:10"], "easy"), ("v", "array", "Array", 0.9, 1, None, None, None)], "video_id string, name string, title string, importance_score double, frequency long, first_mention string, timestamps array<string>, difficulty string")
    e = spark.createDataFrame([("v", "array", "linked_list", "prerequisite", 0.55555, "x", "", "temporal_order")], "video_id string, src string, dst string, relation string, confidence double, evidence string, timestamp string, detection_method string")
    m = graph.graph_metrics(c.select("video_id", "name"), e)
    path = spark.createDataFrame([("v", 1, "array"), ("v", 2, "linked_list")], "video_id string, step int, name string")
    meta = spark.createDataFrame([("v", "a.mp4", "hi")], "video_id string, source_file string, language_detected string")
    d = json.loads(export.documents(c, e, m, path, meta, F.lit("2024-01-01T00:00:00Z")).first()["document"])
    assert d["metadata"] == {"video_id": "v", "processed_at": "2024-01-01T00:00:00Z", "language": export.LANGUAGE, "source_file": "a.mp4", "language_detected": "hi"}
    a, b = d["concepts"]
    assert (a["id"], a["name"], a["difficulty"], a["teaching_style"], a["timestamps"], a["first_mention"]) == (1, "array", "unknown", [], [], "")
    assert (b["id"], b["normalized_name"], b["importance_score"], b["difficulty"]) == (2, "Linked List", 0.1235, "easy")
    assert d["relationships"][0]["confidence"] == round(0.55555, 4) and len(str(b["pagerank"]).split(".")[1]) <= 6
    assert "T" in json.loads(export.documents(c, e, m, path).first()["document"])["metadata"]["processed_at"]


def test_node_colours(spark):
    rows = [("v", str(i), r, 0) for i, r in enumerate((0.0, 0.25, 0.5, 1.0))]
    m = spark.createDataFrame(rows, "video_id string, name string, pagerank double, community int")
    got = {r["name"]: r["colour"] for r in export.node_style(m).collect()}
    assert got == {"0": "#4dd0e1", "1": "#37b3ea", "2": "#2196f3", "3": "#5c6bc0"}
    many = m.withColumn("community", F.col("name").cast("int"))
    assert {r["name"]: r["colour"] for r in export.node_style(many).collect()} == {str(i): export.PALETTE[i] for i in range(4)}


def test_log_lines(tmp_path, capsys):
    from kgraph.log import logger

    log = logger(f"kgraph.test.{tmp_path.name}", file=str(tmp_path / "reports" / "run.log"))
    log.info("read %d", 3)
    log.debug("detail")
    assert logger(log.name) is log and len(log.handlers) == 2
    for h in log.handlers:
        h.flush()
    text = (tmp_path / "reports" / "run.log").read_text()
    assert "] INFO     kgraph.test" in text and "read 3" in text and "detail" in text and "detail" not in capsys.readouterr().out


def test_sources_and_sinks(spark, tmp_path):
    from kgraph.sources import readers, writers

    t = spark.createDataFrame([("v", "One. Two."), ("w", "")], "video_id string, text string")
    tr = readers.text_transcripts(t)
    writers.write_transcripts(tr, str(tmp_path / "t"))
    back = readers.segments_of(readers.read_transcripts(spark, str(tmp_path / "t" / "*.json")))
    assert [r["text"] for r in back.orderBy("seg_id").collect()] == ["One", "Two"]
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "talk.wav").write_bytes(b"xx")
    seg = readers.transcribe(spark, str(tmp_path / "m"), lambda content, name: [(0.004, 1.239, " hi ")]).first()
    assert (seg["video_id"], seg["end"], seg["text"], seg["timestamp_label"]) == ("talk", 1.24, "hi", "0:00")
    page = export.graph_html('{"relationships": [{"from": "a<b", "to": "c", "confidence": 0.5}]}')
    assert "a&lt;b" in page and "</script>" in page


def _segments(spark, folder, rows):
    spark.createDataFrame(rows, "video_id string, seg_id int, start double, text string").coalesce(1).write.mode("append").json(folder)


def test_segment_stream(spark, tmp_path):
    """Two batches: a new video and more of an old one; the bucket of a third is not touched."""
    from kgraph.streaming.segments import rework, segment_stream

    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    run = lambda s: s.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    for batch, want in (([("v", 0, 0.0, "a stack"), ("w", 0, 0.0, "b")], {("v", 1), ("w", 1)}), ([("v", 1, 10.0, "c"), ("x", 0, 0.0, "d")], {("v", 2), ("w", 1), ("x", 1)})):
        _segments(spark, src, batch)
        rework(segment_stream(spark, src), str(tmp_path / "store"), str(tmp_path / "cp"), run, out).awaitTermination(120)
        assert {(r["video_id"], r["n"]) for r in spark.read.parquet(out).collect()} == want


def test_windowed_mentions_of_lectures_one_after_the_other(spark, tmp_path):
    """A lecture's first minute counts although another lecture has reached its second hour."""
    from kgraph.streaming.segments import segment_stream, windowed_mentions

    src = str(tmp_path / "in")
    for i, batch in enumerate(([("long", 0, 0.0, "a stack"), ("long", 1, 7200.0, "stack stack")], [("new", 0, 30.0, "my stack")])):
        _segments(spark, src, batch)
        q = windowed_mentions(segment_stream(spark, src), r"\bstack\b").writeStream.format("memory").queryName(f"mentions{i}").outputMode("complete")
        q.option("checkpointLocation", str(tmp_path / f"cp{i}")).trigger(availableNow=True).start().awaitTermination(120)
    got = {(r["video_id"], r["window_start"], r["mentions"]) for r in spark.table("mentions1").collect()}
    assert got == {("long", 0, 1), ("long", 7200, 2), ("new", 0, 1)}


def test_cue_matches_are_every_patterns_matches(spark):
    """Random lines, blanks and odd letters, against the patterns themselves: no gate, no anchor."""
    import re

    r = random.Random(5)
    bits = "stack queue tree ke baad liye bina zaruri hai nahi depends on leads to works with uses is required for se banta first then need without not possible pehle phir par depend karta use mein , KE BAAD uſes".split() + ["  ", "\n", "\n\n", " \n ", " "]
    texts = ["x " + " ".join(r.choices(bits, k=r.randrange(4, 60))) for _ in range(1500)]
    texts += ["a uses b uses c\nd uses e", "uses b", "a\nuses b", "a  uses b", "stack uſes queue", "a ke baad b, c ke baad d\r\ne ke baad f"]
    s = spark.createDataFrame(list(enumerate(texts)), "k long, sentence string")
    got = {(x["k"], x["pat_idx"], x["match_idx"], x["first"], x["second"]) for x in relations.cue_matches(s, CUES).collect()}
    dot = "[^\\n\\r\\u0085\\u2028\\u2029]"
    want = {(k, i, n, m[1], m[2]) for k, t in enumerate(texts) for i, (p, *_) in enumerate(CUES) for n, m in enumerate(re.finditer(p.replace(".+?", dot + "+?"), t, re.I))}
    assert got == want and len(want) > 1000


def test_long_sentences_take_linear_time(spark):
    """After the last match of a cue, the rest of a sentence was searched from each of its characters."""
    import time

    head = "a ke baad b, c uses d, e leads to f, g works with h, i depends on j, "
    s = spark.createDataFrame([(1, head + "lorem " * 25_000)], "k long, sentence string")
    start = time.time()
    got = {(x["pat_idx"], x["first"]) for x in relations.cue_matches(s, CUES).collect()}
    assert time.time() - start < 30
    assert {(2, "a"), (22, "a ke baad b, c"), (16, "a ke baad b, c uses d, e")} <= got


def test_links_join_what_pairs_join(spark, monkeypatch):
    """Several blocks, repeated ids and vectors, nulls, zeros, not-a-numbers, other lengths, cosines at the threshold."""
    import numpy as np

    from kgraph.operators.iterate import components

    r = np.random.default_rng(3)
    base = r.normal(size=(40, 6))
    rows = [(int(k % 3), int(k if k % 17 else k // 2), [float(x) for x in base[k % 40] + (k % 4 > 1) * r.normal(size=6)]) for k in range(300)]
    rows += [(0, 1000, [0.0] * 6), (1, 1001, None), (1, 1002, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2, 1003, [1.0, 2.0]), (2, 1004, [2.0, 4.0]), (None, 1005, [1.0, 2.0])]
    rows += [(5, 2000 + k, [float(np.cos(k)), float(np.sin(k))]) for k in range(8)] + [(6, 1, [1.0, 0.0]), (6, 2, [float("nan"), 0.0]), (6, 3, [0.0, 1.0])]
    v = spark.createDataFrame(rows, "label int, id long, v array<double>")
    monkeypatch.setattr(graph, "LINK_BLOCK", 16)
    for threshold in (0.9, float(np.cos(1.0)), 0.99999):
        got, want = ({tuple(x) for x in components(e.select("a", "b")).collect()} for e in (graph.similar_links(v, threshold, key="label"), graph.similar_pairs(v, threshold, key="label")))
        assert got == want and got


@pytest.mark.parametrize("query", ["dedup_components", "dedup_canonical_aggregate"])
def test_large_groups_of_copies_need_no_list_of_pairs(spark, tmp_path, query):
    """Three groups of 6,000 near copies under one label: 54 million pairs."""
    import time

    from kgraph.plans.queries import QUERIES

    axis = lambda k: F.array(*[F.when(k == i, 1.0).otherwise((F.col("vec_id") % 50) / 100_000).cast("float") for i in range(24)])
    spark.range(18_000).select(F.col("id").alias("vec_id"), F.lit(1).alias("label")).withColumn("embedding", axis(F.col("vec_id") % 3)).write.parquet(f"{tmp_path}/embeddings.parquet")
    start = time.time()
    got = {x["root"]: x[1] for x in (QUERIES[query](spark, str(tmp_path)) if query == "dedup_canonical_aggregate" else QUERIES[query](spark, str(tmp_path)).groupBy("root").count()).collect()}
    assert time.time() - start < 60
    assert got == {0: 6000, 1: 6000, 2: 6000}
