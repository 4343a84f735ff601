"""The rule pipeline over a corpus: transcripts to graph, metrics, learning paths and documents."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgraph.config import Config
from kgraph.functions.dims import CUES, concept_tables, load_lexicons
from kgraph.operators import concepts as C
from kgraph.operators import export, graph, relations
from kgraph.operators.iterate import materialise
from kgraph.operators.normalise import full_texts, normalise_segments
from kgraph.sources.readers import segments_of


@dataclass
class Result:
    segments: DataFrame
    concepts: DataFrame
    edges: DataFrame
    metrics: DataFrame
    path: DataFrame
    documents: DataFrame


@dataclass
class Pipeline:
    spark: SparkSession
    cfg: Config = field(default_factory=Config)
    lexicon: dict[str, str] | None = None
    dictionary: dict | str | None = None

    def run(self, transcripts: DataFrame) -> Result:
        """Every intermediate is keyed by video_id; those used more than once are written to the shared folder."""
        lexicon = load_lexicons() if self.lexicon is None else self.lexicon
        terms, aliases = concept_tables(self.spark, self.dictionary)
        segments = materialise(normalise_segments(segments_of(transcripts), lexicon), "segments")
        texts = full_texts(segments).withColumnRenamed("full_text", "text")
        found = materialise(C.extract_concepts(texts, segments, terms, aliases, self.cfg), "concepts")
        seen = C.mentions(segments, found.select("video_id", "name"))
        edges = materialise(relations.detect_relations(segments, found, seen, CUES, self.cfg), "edges")
        return self.build(segments, found, edges)

    def build(self, segments: DataFrame, concepts: DataFrame, edges: DataFrame) -> Result:
        pairs = graph.similar_names(concepts, self.cfg.similarity)
        mapping = materialise(graph.canonical_map(concepts, pairs), "canonical")
        nodes = materialise(graph.merge_concepts(concepts, mapping), "nodes")
        kept = materialise(graph.with_nodes(graph.remap_edges(edges, mapping), nodes), "kept")
        metrics = materialise(graph.graph_metrics(nodes, kept, self.cfg.damping), "metrics")
        path = graph.learning_path(self.path_input(nodes, metrics, kept))
        return Result(segments, nodes, kept, metrics, path, export.documents(nodes, kept, metrics, path))

    @staticmethod
    def path_input(nodes: DataFrame, metrics: DataFrame, edges: DataFrame) -> DataFrame:
        out = graph.break_cycles(edges).groupBy("video_id", F.col("src").alias("name")).agg(F.count(F.lit(1)).alias("out_degree"))
        return metrics.join(nodes.select("video_id", "name", "first_sec", "importance_score"), ["video_id", "name"]).join(out, ["video_id", "name"], "left").na.fill(0, ["out_degree"])
