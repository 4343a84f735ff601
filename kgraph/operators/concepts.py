"""Concept scoring: dictionary matches, key phrases, frequency, filters and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgraph.functions.dims import AMBIGUOUS, PROMOTIONS, STOP_WORDS
from kgraph.functions.scalars import bind, title_case

BROADCAST_TERMS = 100_000
TOKEN = r"\w+| +|[^\w ]+"


def canonical(df: DataFrame, column: str, aliases: DataFrame, out: str = "concept") -> DataFrame:
    """Lower, trim, alias to canonical, else itself."""
    key = F.lower(F.trim(F.col(column)))
    small = aliases.select(F.lower("alias").alias("_alias"), F.col("canonical").alias("_canonical"))
    return df.withColumn("_key", key).join(small, F.col("_key") == F.col("_alias"), "left").withColumn(out, F.coalesce("_canonical", "_key")).drop("_key", "_alias", "_canonical")


def _hint(terms: DataFrame) -> DataFrame:
    """Dictionaries are dimensions; beyond a bound they are shuffled like anything else."""
    return F.broadcast(terms) if terms.limit(BROADCAST_TERMS + 1).count() <= BROADCAST_TERMS else terms


def term_counts(texts: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """keys, term, n: occurrences of each term at word borders; overlaps with other terms all count.

    Texts are cut into words, blanks and marks once. Only at tokens that some term begins with is the text after them
    kept (a hash lookup; a dictionary beyond BROADCAST_TERMS skips it), and an equi-join on that token finds the
    terms. No text is scanned per term. What is kept is as long as the longest term, counted in words, blanks and marks.
    """
    parts = F.regexp_extract_all(F.lower(F.col("term")), F.lit(f"(?U){TOKEN}"), F.lit(0))
    dim = terms.select("term").distinct().withColumn("parts", parts).where(F.size("parts") > 0).withColumn("head", F.element_at("parts", 1))
    rows = dim.limit(BROADCAST_TERMS + 1).collect()
    small = len(rows) <= BROADCAST_TERMS
    longest = max((len(r["parts"]) for r in rows), default=1) if small else dim.agg(F.max(F.size("parts"))).first()[0]
    heads = sorted({r["head"] for r in rows})
    if small:
        dim = F.broadcast(terms.sparkSession.createDataFrame(rows, dim.schema))
    starts = (lambda t: t.isin(heads)) if small else (lambda t: t.rlike(r"(?U)^\w"))
    toks = F.regexp_extract_all(F.lower(F.col("text")), F.lit(f"(?U){TOKEN}"), F.lit(0))
    spans = bind(toks, lambda ts: F.transform(ts, lambda t, i: F.when(starts(t) & t.rlike(r"(?U)^\w"), F.struct(t.alias("head"), F.slice(ts, i + 1, longest).alias("rest")))))
    at = texts.select(*keys, F.explode(F.filter(spans, lambda s: s.isNotNull())).alias("s")).select(*keys, F.col("s.head").alias("head"), F.col("s.rest").alias("rest"))
    hits = at.join(dim, "head").where(F.slice("rest", 1, F.size("parts")) == F.col("parts"))
    return hits.groupBy(*keys, "term").agg(F.count(F.lit(1)).alias("n"))


def canonical_counts(counts: DataFrame, aliases: DataFrame, keys: list[str]) -> DataFrame:
    return canonical(counts, "term", aliases).groupBy(*keys, "concept").agg(F.sum("n").alias("n"))


def damped(n: Column, per: list[str]) -> Column:
    """min(ln(1 + n) / ln(1 + max(3, largest n)), 1)."""
    return F.least(F.log(n + 1) / F.log(F.greatest(F.lit(3), F.max(n).over(Window.partitionBy(*per))) + 1), F.lit(1.0))


def key_phrases(texts: DataFrame, stop_words=STOP_WORDS, longest: int = 4, pattern: str = r"(?U)\w+|[^\w\s]+") -> DataFrame:
    """video_id, phrase, words, score: runs of 1..longest words between stop words and marks, scored by degree / frequency.

    Repeated phrases count once per text. Marks of one character break a run; longer ones are words.
    """
    stops = F.array(*[F.lit(w) for w in sorted(stop_words)])
    sents = F.split(F.lower(F.col("text")), r"(?<=[.!?])\s+")
    tok = texts.select("video_id", F.posexplode(sents).alias("sent", "s")).select("video_id", "sent", F.posexplode(F.regexp_extract_all("s", F.lit(pattern), F.lit(0))).alias("pos", "tok"))
    breaks = F.array_contains(stops, F.col("tok")) | ((F.length("tok") == 1) & F.col("tok").rlike(r"(?U)[^\w\s]"))
    tok = tok.withColumn("brk", breaks.cast("int"))
    run = F.sum("brk").over(Window.partitionBy("video_id", "sent").orderBy("pos"))
    tok = tok.withColumn("run", run).where("brk = 0")
    words = F.transform(F.array_sort(F.collect_list(F.struct("pos", "tok"))), lambda x: x["tok"])
    phrases = tok.groupBy("video_id", "sent", "run").agg(words.alias("words")).where(F.size("words") <= longest)
    phrases = phrases.withColumn("phrase", F.array_join("words", " ")).groupBy("video_id", "phrase").agg(F.first("words").alias("words"))
    each = phrases.select("video_id", F.explode("words").alias("w"), F.size("words").alias("len"))
    stats = each.groupBy("video_id", "w").agg((F.sum("len") / F.count(F.lit(1))).alias("ratio"))
    scored = phrases.select("video_id", "phrase", "words", F.explode("words").alias("w")).join(stats, ["video_id", "w"])
    return scored.groupBy("video_id", "phrase").agg(F.first("words").alias("words"), F.sum("ratio").alias("score"))


def phrase_concept_scores(phrases: DataFrame, concepts: DataFrame, aliases: DataFrame) -> DataFrame:
    """video_id, concept, rake: a phrase that is a concept gives score / top score; others give 0.8 of it to concepts whose words they hold."""
    top = F.max("score").over(Window.partitionBy("video_id"))
    ph = canonical(phrases.withColumn("rel", F.col("score") / top), "phrase", aliases)
    names = concepts.select("concept").distinct()
    exact = ph.join(_hint(names), "concept", "left_semi").select("video_id", "concept", "rel")
    rest = ph.join(_hint(names), "concept", "left_anti").drop("concept")
    need = names.withColumn("cw", F.array_distinct(F.split("concept", " "))).select("concept", F.size("cw").alias("need"), F.explode("cw").alias("w"))
    have = rest.select("video_id", "phrase", "rel", F.explode(F.array_distinct("words")).alias("w"))
    partial = have.join(_hint(need), "w").groupBy("video_id", "phrase", "concept").agg(F.count(F.lit(1)).alias("got"), F.first("need").alias("need"), F.first("rel").alias("rel"))
    partial = partial.where("got = need").select("video_id", "concept", (0.8 * F.col("rel")).alias("rel"))
    return exact.unionByName(partial).groupBy("video_id", "concept").agg(F.max("rel").alias("rake"))


def hybrid_scores(domain: DataFrame, rake: DataFrame, frequency: DataFrame, weights=(0.5, 0.3, 0.2)) -> DataFrame:
    """Full outer combination of domain and rake candidates; frequency only adds to them."""
    out = domain.join(rake, ["video_id", "concept"], "full_outer").join(frequency, ["video_id", "concept"], "left")
    parts = [F.coalesce(F.col(c), F.lit(0.0)) for c in ("domain_match", "rake", "frequency_score")]
    score = parts[0] * weights[0] + parts[1] * weights[1] + parts[2] * weights[2]
    return out.withColumns({"domain_match": parts[0], "rake": parts[1], "frequency_score": parts[2]}).withColumn("score", score)


def keep_scored(scores: DataFrame, least: float = 0.15) -> DataFrame:
    return scores.where(F.col("score") >= least)


def keep_unambiguous(concepts: DataFrame, texts: DataFrame, ambiguous: dict[str, list[str]] = AMBIGUOUS, promotions: dict[str, str] = PROMOTIONS) -> DataFrame:
    """Drops ambiguous concepts none of whose context words stands anywhere in the text (as characters); renames promoted ones."""
    spark = concepts.sparkSession
    dim = spark.createDataFrame([(k, v, promotions.get(k)) for k, v in ambiguous.items()], "concept string, context array<string>, promoted string")
    has = concepts.join(F.broadcast(dim), "concept", "left").join(texts.select("video_id", F.lower("text").alias("_low")), "video_id")
    ok = F.col("context").isNull() | F.exists("context", lambda w: F.contains(F.col("_low"), w))
    out = has.where(ok).withColumn("concept", F.coalesce("promoted", "concept")).drop("context", "promoted", "_low")
    # a promoted name that is there already takes its place
    rest = [c for c in out.columns if c not in ("video_id", "concept")]
    best = out.groupBy("video_id", "concept").agg(F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in ("score",) if c in rest] or [F.lit(0)])).alias("r"))
    return best.select("video_id", "concept", *[F.col(f"r.{c}").alias(c) for c in rest])


def drop_sub_concepts(concepts: DataFrame) -> DataFrame:
    """Drops one-word concepts that are characters of another concept of the same video; judged on the full set."""
    one = concepts.where(~F.contains("concept", F.lit(" ")))
    other = concepts.select(F.col("video_id").alias("_v"), F.col("concept").alias("_other"))
    sub = one.join(other, (F.col("video_id") == F.col("_v")) & F.contains(F.col("_other"), F.col("concept")) & (F.length("concept") < F.length("_other")), "left_semi")
    return concepts.join(sub.select("video_id", "concept").distinct(), ["video_id", "concept"], "left_anti")


def rank_concepts(concepts: DataFrame) -> DataFrame:
    return concepts.withColumn("concept_rank", F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("score"), "concept")))


def mentions(segments: DataFrame, names: DataFrame) -> DataFrame:
    """video_id, seg_id, name, start, timestamp_label: segments whose text (or original) holds the name at word borders."""
    text = F.concat_ws(" ", "text", "original_text") if "original_text" in segments.columns else F.col("text")
    keyed = segments.select("video_id", "seg_id", "start", "timestamp_label", text.alias("text"))
    hits = term_counts(keyed, names.select(F.col("name").alias("term")), ["video_id", "seg_id", "start", "timestamp_label"])
    found = hits.select("video_id", "seg_id", F.col("term").alias("name"), "start", "timestamp_label")
    if "video_id" in names.columns:
        found = found.join(names.select("video_id", "name").distinct(), ["video_id", "name"], "left_semi")
    return found


def mention_times(found: DataFrame) -> DataFrame:
    """video_id, name, timestamps (distinct labels in segment order), first_mention, first_sec."""
    labels = found.groupBy("video_id", "name", "timestamp_label").agg(F.min("seg_id").alias("seg_id"), F.min("start").alias("start"))
    ordered = F.array_sort(F.collect_list(F.struct("seg_id", "timestamp_label", "start")))
    out = labels.groupBy("video_id", "name").agg(ordered.alias("o"))
    return out.select("video_id", "name", F.transform("o", lambda x: x["timestamp_label"]).alias("timestamps"), F.col("o")[0]["timestamp_label"].alias("first_mention"), F.floor(F.col("o")[0]["start"]).cast("int").alias("first_sec"))


def describe_concepts(ranked: DataFrame, counts: DataFrame, times: DataFrame) -> DataFrame:
    """Concept rows for export: names, score, frequency, first mention, time labels, signals."""
    out = ranked.withColumnRenamed("concept", "name").join(counts.select("video_id", F.col("concept").alias("name"), "n"), ["video_id", "name"], "left")
    out = out.join(times, ["video_id", "name"], "left")
    signals = F.struct(F.col("domain_match"), F.col("rake"), F.col("frequency_score").alias("frequency"))
    return out.select(
        "video_id", "name", title_case(F.col("name")).alias("title"), F.col("score").alias("importance_score"), F.coalesce("n", F.lit(0)).alias("frequency"), "first_mention", "first_sec",
        F.coalesce("timestamps", F.array().cast("array<string>")).alias("timestamps"), signals.alias("signals"), "concept_rank",
    )


def extract_concepts(texts: DataFrame, segments: DataFrame, terms: DataFrame, aliases: DataFrame, cfg) -> DataFrame:
    """The whole rule-mode extraction: texts (video_id, text) and segments to ranked concept rows."""
    counts = canonical_counts(term_counts(texts, terms, ["video_id"]), aliases, ["video_id"])
    per = ["video_id"]
    domain = counts.select("video_id", "concept", damped(F.col("n"), per).alias("domain_match"))
    known = canonical(terms, "term", aliases).select("concept").distinct()
    rake = phrase_concept_scores(key_phrases(texts), known, aliases)
    frequency = counts.select("video_id", "concept", damped(F.col("n"), per).alias("frequency_score"))
    scores = keep_scored(hybrid_scores(domain, rake, frequency, (cfg.domain_weight, cfg.rake_weight, cfg.frequency_weight)), cfg.min_concept_score)
    mentioned = scores.join(counts.where("n > 0").select("video_id", "concept"), ["video_id", "concept"], "left_semi")
    ranked = rank_concepts(drop_sub_concepts(keep_unambiguous(mentioned, texts)))
    found = mentions(segments, ranked.select("video_id", F.col("concept").alias("name")))
    return describe_concepts(ranked, counts, mention_times(found))
