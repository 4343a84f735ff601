"""Export: timelines, summaries, chart and graph styling, knowledge-graph documents."""

from __future__ import annotations

import html as _html
import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgraph.functions.scalars import label_seconds, round_half, title_case

#: fixed value: the language every exported document states
LANGUAGE = "code-mixed (Hindi-English)"
#: fixed values: colours of up to ten communities
PALETTE = ["#4dd0e1", "#ff7043", "#66bb6a", "#ab47bc", "#ffa726", "#42a5f5", "#ef5350", "#26c6da", "#8d6e63", "#78909c"]
#: fixed values: red, green and blue of the least, the middling and the most important node
GRADIENT = [(77, 208, 225), (33, 150, 243), (92, 107, 192)]
#: fixed values: digits of exported figures
DIGITS = {"pagerank": 6, "betweenness": 4, "in_degree_centrality": 4, "out_degree_centrality": 4, "hub_score": 4, "authority_score": 4, "importance_score": 4, "confidence": 4}


def timeline(concepts: DataFrame) -> DataFrame:
    """video_id, pos, time, seconds, concept, importance; in order of time, then importance, then name."""
    rows = concepts.where((F.col("first_mention").isNotNull()) & (F.col("first_mention") != "")).withColumn("seconds", label_seconds(F.col("first_mention")))
    pos = F.row_number().over(Window.partitionBy("video_id").orderBy("seconds", F.desc("importance_score"), "name"))
    return rows.select("video_id", pos.alias("pos"), F.col("first_mention").alias("time"), "seconds", F.col("name").alias("concept"), F.col("importance_score").alias("importance"))


def analytics(concepts: DataFrame, edges: DataFrame) -> DataFrame:
    c = concepts.groupBy("video_id").agg(F.count(F.lit(1)).alias("total_concepts"))
    e = edges.groupBy("video_id").agg(F.count(F.lit(1)).alias("total_relationships"), F.avg("confidence").alias("avg_confidence"))
    return c.join(e, "video_id", "left").select("video_id", "total_concepts", F.coalesce("total_relationships", F.lit(0)).alias("total_relationships"), F.coalesce("avg_confidence", F.lit(0.0)).alias("avg_confidence"))


def top_frequent(concepts: DataFrame, k: int = 15) -> DataFrame:
    """The k most frequent concepts per video, rarest first."""
    r = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("frequency"), "name"))
    top = concepts.withColumn("_r", r).where(F.col("_r") <= k)
    return top.select("video_id", F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("_r"))).alias("bar"), "name", "frequency")


def top_lists(metrics: DataFrame, k: int = 5) -> DataFrame:
    """video_id, list, rank, name, value: top PageRank, gateways (betweenness), foundations (out-degree), most complex (in-degree)."""
    lists = {"pagerank": "pagerank", "gateway": "betweenness", "foundational": "out_degree_centrality", "complex": "in_degree_centrality"}
    each = metrics.select("video_id", "name", F.explode(F.array(*[F.struct(F.lit(n).alias("list"), F.col(c).alias("value")) for n, c in lists.items()])).alias("x")).select("video_id", "name", "x.list", "x.value")
    r = F.row_number().over(Window.partitionBy("video_id", "list").orderBy(F.desc("value"), "name"))
    return each.withColumn("rank", r).where(F.col("rank") <= k)


def shown_lists(tops: DataFrame) -> DataFrame:
    """Rows of top lists with a value; PageRank also as a share of the largest (0.0001 at least)."""
    top = F.greatest(F.max("value").over(Window.partitionBy("video_id", "list")), F.lit(0.0001))
    return tops.where((F.col("value") != 0) | (F.col("list") == "pagerank")).withColumn("bar", F.when(F.col("list") == "pagerank", F.col("value") / top))


def community_lists(metrics: DataFrame, members: int = 8) -> DataFrame:
    names = F.sort_array(F.collect_list("name"))
    return metrics.groupBy("video_id", "community").agg(F.count(F.lit(1)).alias("size"), F.transform(F.slice(names, 1, members), title_case).alias("members"))


def metrics_summary(metrics: DataFrame, edges: DataFrame) -> DataFrame:
    """density, max_depth (which is also the longest path), number of communities, per video."""
    n = metrics.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("max_depth"), F.countDistinct("community").alias("num_communities"))
    m = edges.groupBy("video_id").agg(F.count(F.lit(1)).alias("m"))
    d = n.join(m, "video_id", "left").na.fill(0, ["m"])
    return d.select("video_id", F.when(F.col("n") > 1, F.col("m") / (F.col("n") * (F.col("n") - 1))).otherwise(0.0).alias("density"), "max_depth", F.col("max_depth").alias("longest_path"), "num_communities")


def _hex(r: Column, g: Column, b: Column) -> Column:
    part = lambda x: F.lpad(F.lower(F.hex(F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(255)).cast("long"))), 2, "0")
    return F.concat(F.lit("#"), part(r), part(g), part(b))


def node_style(metrics: DataFrame) -> DataFrame:
    """size 20 + 30 * pagerank / largest; colour by community if there are several, else on a two-piece gradient of importance."""
    per = Window.partitionBy("video_id")
    rel = F.col("pagerank") / F.greatest(F.max("pagerank").over(per), F.lit(1e-12))
    many = F.max("community").over(per) > 0
    least, middle, most = GRADIENT
    mixed = lambda a, b, t: a + (b - a) * t
    gradient = _hex(*[F.when(rel < 0.5, mixed(least[k], middle[k], rel * 2)).otherwise(mixed(middle[k], most[k], (rel - 0.5) * 2)) for k in range(3)])
    palette = F.array(*map(F.lit, PALETTE))
    return metrics.select("video_id", "name", (20 + 30 * rel).alias("size"), F.when(many, F.element_at(palette, (F.col("community") % 10 + 1).cast("int"))).otherwise(gradient).alias("colour"))


def lighten(colour: Column, by: int = 40) -> Column:
    part = lambda i: F.conv(F.substring(colour, i, 2), 16, 10).cast("int") + by
    return _hex(part(2), part(4), part(6))


def edge_style(edges: DataFrame) -> DataFrame:
    return edges.select("video_id", "src", "dst", (1 + 2.5 * F.col("confidence")).alias("width"), (F.floor((0.20 + 0.50 * F.col("confidence")) * 100 + 0.5) / 100).alias("alpha"))


def tooltips(concepts: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge tooltip fields: the first six time labels; the first 100 characters of evidence."""
    return concepts.select("video_id", "name", F.slice("timestamps", 1, 6).alias("timestamps")), edges.select("video_id", "src", "dst", F.substring("evidence", 1, 100).alias("evidence"))


def markers(concepts: DataFrame) -> DataFrame:
    i = F.col("importance_score")
    return concepts.select("video_id", "name", (14 + 22 * i).alias("size"), (0.4 + 0.6 * i).alias("alpha"))


def cards(concepts: DataFrame) -> DataFrame:
    """Ranked concept cards with a score bar in percent of the best."""
    per = Window.partitionBy("video_id")
    bar = F.floor(F.col("importance_score") / F.max("importance_score").over(per) * 100 + 0.5).cast("int")
    return concepts.select("video_id", F.row_number().over(per.orderBy(F.desc("importance_score"), "name")).alias("card"), "name", "importance_score", "frequency", "first_mention", bar.alias("bar"))


def confidence_bucket(confidence: Column) -> Column:
    return F.when(confidence > 0.8, "high").when(confidence > 0.6, "medium").otherwise("low")


def segment_lines(segments: DataFrame) -> DataFrame:
    return segments.select("video_id", "seg_id", F.concat(F.lit("["), "timestamp_label", F.lit("] "), "text").alias("line"))


def rounded(df: DataFrame) -> DataFrame:
    """Figures at the digits that documents give."""
    return df.withColumns({c: round_half(F.col(c).cast("double"), n) for c, n in DIGITS.items() if c in df.columns})


def documents(concepts: DataFrame, edges: DataFrame, metrics: DataFrame, path: DataFrame, meta: DataFrame | None = None, processed_at: Column | None = None) -> DataFrame:
    """video_id, document: one JSON knowledge graph per video, learning path and density included.

    Concepts are numbered by name and stand by importance. meta: video_id, source_file, language_detected.
    processed_at: a time of processing, now unless given. difficulty and teaching_style come from concepts that have them.
    """
    concepts, edges, metrics = rounded(concepts), rounded(edges), rounded(metrics)
    given = lambda c, otherwise: F.coalesce(F.col(c), otherwise) if c in concepts.columns else otherwise
    number = F.row_number().over(Window.partitionBy("video_id").orderBy("name"))
    order = F.struct((-F.col("importance_score")).alias("o"), "name")
    item = F.struct(
        "id", F.col("title").alias("normalized_name"), "name", F.coalesce("importance_score", F.lit(0.0)).alias("importance_score"), F.coalesce("frequency", F.lit(0)).alias("frequency"),
        F.coalesce("first_mention", F.lit("")).alias("first_mention"), F.coalesce("timestamps", F.array().cast("array<string>")).alias("timestamps"),
        given("difficulty", F.lit("unknown")).alias("difficulty"), given("teaching_style", F.array().cast("array<string>")).alias("teaching_style"),
        "pagerank", "betweenness", "in_degree_centrality", "out_degree_centrality", "hub_score", "authority_score", "depth", "community",
    )
    sorted_items = lambda o, x: F.transform(F.array_sort(F.collect_list(F.struct(o.alias("o"), x.alias("x")))), lambda y: y["x"])
    c = concepts.withColumn("id", number).join(metrics, ["video_id", "name"]).groupBy("video_id").agg(sorted_items(order, item).alias("concepts"))
    rel = F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "relation", "confidence", "evidence", "timestamp", "detection_method")
    e = edges.groupBy("video_id").agg(sorted_items(F.struct((-F.col("confidence")).alias("c"), "src", "dst"), rel).alias("relationships"))
    t = timeline(concepts)
    t = t.groupBy("video_id").agg(sorted_items(F.col("pos"), F.struct("time", "concept", "importance")).alias("timeline"))
    p = path.groupBy("video_id").agg(sorted_items(F.col("step"), F.col("name")).alias("learning_path"))
    a = analytics(concepts, edges).withColumn("avg_confidence", round_half(F.col("avg_confidence"), 4)).join(metrics_summary(metrics, edges), "video_id")
    doc = c.join(e, "video_id", "left").join(t, "video_id", "left").join(p, "video_id", "left").join(a, "video_id")
    if meta is not None:
        doc = doc.join(meta.select("video_id", "source_file", "language_detected"), "video_id", "left")
    at = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'") if processed_at is None else processed_at
    told = [F.coalesce(F.col(x), F.lit("")).alias(x) for x in ("source_file", "language_detected")] if meta is not None else []
    figures = F.struct("total_concepts", "total_relationships", "avg_confidence", "density", "max_depth", "num_communities")
    metadata = F.struct("video_id", at.alias("processed_at"), F.lit(LANGUAGE).alias("language"), *told)
    body = F.struct("video_id", metadata.alias("metadata"), "concepts", F.coalesce("relationships", F.array().cast(e.schema["relationships"].dataType)).alias("relationships"), F.coalesce("timeline", F.array().cast(t.schema["timeline"].dataType)).alias("timeline"), "learning_path", figures.alias("analytics"))
    return doc.select("video_id", F.to_json(body).alias("document"))


def graph_html(document: str, title: str = "Concept graph") -> str:
    """A page that lists one document's concepts and edges; drawing is left to the page's own script."""
    d = json.loads(document)
    rows = "".join(f"<li>{_html.escape(r['from'])} &rarr; {_html.escape(r['to'])} ({r['confidence']:.2f})</li>" for r in d["relationships"])
    data = json.dumps(d).replace("<", "\\u003c")
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{_html.escape(title)}</title></head><body><h1>{_html.escape(title)}</h1><ul>{rows}</ul><script id='graph' type='application/json'>{data}</script></body></html>"
