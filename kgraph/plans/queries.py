"""The engine's operators as queries over the driver's tables, each with its SQL where SQL can express it.

conversations stand for timed transcripts (a turn is a segment of ten seconds), documents for raw text, embeddings (grouped by label)
for concept vectors. The concept dictionary has the size of a shipped one: the most frequent plain words of at least four
letters and, so that terms of two words overlap with others, pairs of such words with one blank between them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgraph.functions.dims import CUES, METHOD_WEIGHTS, OTHER_METHOD_WEIGHT, STOP_WORDS, lexicon_table
from kgraph.functions.romanise import romanise
from kgraph.functions.scalars import bind, chunks, conjuncts, label_seconds, repaired, title_case
from kgraph.operators import concepts as C
from kgraph.operators import export, graph, relations
from kgraph.operators import normalise as N
from kgraph.operators.iterate import components

WORD = r"[\p{L}\p{N}_]+"
TOKEN = WORD + r"| +|[^\p{L}\p{N}_ ]+"
PLAIN = "[a-z]{4,}"
N_TERMS, N_PAIRS = 295, 95  # terms of the dictionary, and how many of them are pairs
LEXICON = {"the": "le", "and": "et", "that": "dass", "with": "mit", "for": "", "this": "dies"}
PHRASES = {"and the": "und die", "of the": "vom", "to the": "zum", "in the": "im"}
MERGE_H = {"a": {"good": "well", "base": "basis"}, "b": {"good": "", "easy": "light"}}
MERGE_T = {"a": {"easy": "simple", "before": "ahead"}, "b": {"before": "prior", "base": "floor"}}
STAND_INS = {"the": "depends on", "of": "ke baad", "to": "works with", "de": "leads to", "la": "se", "der": "uses", "and": "aur", "in": "is required for", "que": "mein", "die": "ke liye"}
SIMILAR = 0.40
RANK_ROUNDS, HITS_ROUNDS = 10, 4

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- shared frames --------------------------------------------------------------------------------------------------
def turns(spark, d):
    return N.segments_from_turns(read(spark, d, "conversations"))


def texts(spark, d):
    return read(spark, d, "documents").select(F.col("doc_id").alias("video_id"), "text")


def dictionary(frame: DataFrame) -> DataFrame:
    """term, n: N_TERMS rows."""
    toks = F.regexp_extract_all(F.lower("text"), F.lit(TOKEN), F.lit(0))
    plain = lambda t: t.rlike(f"^{PLAIN}$")
    second = lambda ts, i: F.when((F.get(ts, i + 1) == " ") & plain(F.get(ts, i + 2)), F.get(ts, i + 2))
    found = bind(toks, lambda ts: F.flatten(F.transform(ts, lambda t, i: F.when(plain(t), F.array(t, F.concat(t, F.lit(" "), second(ts, i)))).otherwise(F.array().cast("array<string>")))))
    terms = frame.select(F.explode(found).alias("term")).where("term IS NOT NULL").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    top = lambda pair, n: terms.where(F.contains("term", F.lit(" ")) == pair).orderBy(F.desc("n"), "term").limit(n)
    return frame.sparkSession.createDataFrame(top(False, N_TERMS - N_PAIRS).unionByName(top(True, N_PAIRS)).collect(), "term string, n long")


def counts(spark, d, words=None):
    t = texts(spark, d)
    words = dictionary(t) if words is None else words
    return C.term_counts(t, words.select("term"), ["video_id"])


def aliases(words):
    """The second half of the dictionary, by rank, stands for the terms half a dictionary before."""
    r = words.withColumn("r", F.row_number().over(Window.orderBy(F.desc("n"), "term")))
    half = N_TERMS // 2
    a, b = r.where(F.col("r") > half).select(F.col("term").alias("alias"), (F.col("r") - half).alias("k")), r.select(F.col("term").alias("canonical"), F.col("r").alias("k"))
    return a.join(b, "k").select("alias", "canonical")


def scored(spark, d):
    c = counts(spark, d)
    return c.select("video_id", F.col("term").alias("concept"), "n", C.damped(F.col("n"), ["video_id"]).alias("score"))


def found(spark, d):
    s = turns(spark, d)
    return C.mentions(s, dictionary(s).select(F.col("term").alias("name")))


def ranked_names(s: DataFrame) -> DataFrame:
    """video_id, name, concept_rank: the dictionary's terms that each video mentions, ranked as in the dictionary."""
    words = dictionary(s)
    ranks = words.select(F.col("term").alias("name"), F.row_number().over(Window.orderBy(F.desc("n"), "term")).alias("concept_rank"))
    names = C.mentions(s, words.select(F.col("term").alias("name"))).select("video_id", "name").distinct()
    return names.join(F.broadcast(ranks), "name")  # ranks: N_TERMS rows


def firsts(m: DataFrame) -> DataFrame:
    return C.mention_times(m).select("video_id", "name", "first_sec", "first_mention")


def cooc(spark, d):
    m = found(spark, d)
    return relations.cooccurrence_edges(m, firsts(m))


def nodes(spark, d):
    m = found(spark, d)
    t = C.mention_times(m)
    freq = m.groupBy("video_id", "name").agg(F.count(F.lit(1)).alias("frequency"))
    return t.join(freq, ["video_id", "name"]).withColumn("importance_score", F.col("frequency") / F.max("frequency").over(Window.partitionBy("video_id")))




def _tok_sql(columns, table):
    """Words of a table's texts, and pairs of plain words."""
    pair = f"CASE WHEN l[i + 1] = ' ' AND regexp_matches(l[i], '^{PLAIN}$') AND regexp_matches(l[i + 2], '^{PLAIN}$') THEN l[i] || ' ' || l[i + 2] END"
    lists = f"SELECT *, regexp_extract_all(lower(text), '{TOKEN}') AS l FROM {table}"
    each = f"list_concat(list_filter(l, lambda w: regexp_matches(w, '^{WORD}$')), list_filter(list_transform(range(1, len(l) - 1), lambda i: {pair}), lambda w: w IS NOT NULL))"
    return f"tok AS (SELECT {columns}, unnest({each}) AS w FROM ({lists}))"


DICT_SQL = f"""dict AS (SELECT term, n FROM (SELECT w AS term, count(*) AS n FROM tok WHERE regexp_matches(w, '^{PLAIN}( {PLAIN})?$') GROUP BY w)
 QUALIFY row_number() OVER (PARTITION BY contains(term, ' ') ORDER BY n DESC, term) <= CASE WHEN contains(term, ' ') THEN {N_PAIRS} ELSE {N_TERMS - N_PAIRS} END)"""
DOC_CTE = f"{_tok_sql('doc_id AS video_id', 'documents')}, {DICT_SQL}, cnt AS (SELECT video_id, w AS term, count(*) AS n FROM tok WHERE w IN (SELECT term FROM dict) GROUP BY ALL)"
SCORE_CTE = DOC_CTE + ", sc AS (SELECT video_id, term AS concept, n, least(ln(1 + n) / ln(1 + greatest(3, max(n) OVER (PARTITION BY video_id))), 1.0) AS score FROM cnt)"
CONV_TOK = _tok_sql("conv_id AS video_id, turn::INT AS seg_id", "conversations")
M_CTE = f"{CONV_TOK}, {DICT_SQL}, m AS (SELECT DISTINCT video_id, seg_id, w AS name FROM tok WHERE w IN (SELECT term FROM dict))"
LABEL = "(({x}) // 60)::VARCHAR || ':' || lpad((({x}) % 60)::VARCHAR, 2, '0')"
F_CTE = M_CTE + f", f AS (SELECT video_id, name, min(seg_id) * 10 AS first_sec, {LABEL.format(x='min(seg_id) * 10')} AS first_mention, count(*) AS frequency FROM m GROUP BY ALL)"
E_CTE = F_CTE + f""", e AS (
  SELECT a.video_id, a.name AS src, b.name AS dst, min(a.seg_id) AS seg
  FROM m a JOIN m b ON a.video_id = b.video_id AND a.seg_id = b.seg_id
  JOIN f fa ON fa.video_id = a.video_id AND fa.name = a.name JOIN f fb ON fb.video_id = b.video_id AND fb.name = b.name
  WHERE fa.first_sec < fb.first_sec GROUP BY ALL),
 co AS (SELECT video_id, src, dst, 'prerequisite' AS relation, 0.45::DOUBLE AS confidence, 'co-occurrence: both ''' || src || ''' and ''' || dst || ''' appear in same segment' AS evidence, {LABEL.format(x='seg * 10')} AS "timestamp", 'cooccurrence' AS detection_method FROM e)"""
TE_CTE = """, o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY first_sec, name) AS rn FROM f),
 te AS (SELECT a.video_id, a.name AS src, b.name AS dst, 'prerequisite' AS relation, round(least(0.55::DOUBLE, 0.35::DOUBLE + (b.first_sec - a.first_sec) / 600.0::DOUBLE * 0.2::DOUBLE), 4) AS confidence,
  'temporal order: ' || a.name || ' mentioned at ' || a.first_sec || 's, ' || b.name || ' at ' || b.first_sec || 's' AS evidence, '' AS "timestamp", 'temporal_order' AS detection_method
  FROM o a JOIN o b ON a.video_id = b.video_id AND b.rn BETWEEN a.rn + 1 AND a.rn + 3 WHERE b.first_sec - a.first_sec >= 30)"""
MERGED_CTE = ", u AS (SELECT *, 0 AS p FROM te UNION ALL SELECT *, 1 AS p FROM co), mg AS (SELECT * EXCLUDE (p) FROM u QUALIFY row_number() OVER (PARTITION BY video_id, src, dst ORDER BY p) = 1)"
STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


# --- sources and text -----------------------------------------------------------------------------------------------
@query(f"""WITH s AS (SELECT doc_id AS video_id, list_filter(list_transform(string_split(replace(text, chr(10), ' '), '.'), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
x AS (SELECT video_id, unnest(l) AS text, (generate_subscripts(l, 1) - 1)::INT AS seg_id FROM s)
SELECT video_id, seg_id, seg_id * 10.0::DOUBLE AS start, seg_id * 10.0::DOUBLE + 10 AS "end", text, {LABEL.format(x='seg_id * 10')} AS timestamp_label FROM x""")
def scan_segments_from_text(spark, d):
    return N.segments_from_text(texts(spark, d))


@query(f"""SELECT conv_id AS video_id, turn::INT AS seg_id, turn * 10.0::DOUBLE AS start, turn * 10.0::DOUBLE + 10 AS "end", text, {LABEL.format(x='turn * 10')} AS timestamp_label FROM conversations""")
def segments_from_conversations(spark, d):
    return turns(spark, d)


@query("SELECT conv_id AS video_id, string_agg(text, ' ' ORDER BY turn, text) AS full_text FROM conversations GROUP BY conv_id")
def rebuild_full_text(spark, d):
    return N.full_texts(turns(spark, d))


_CASES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LEXICON.items() if v)
_MARKS = "'.,!?;:()[]{}\"' || chr(39)"


_WORDS_SQL = f"""array_to_string(list_transform(list_filter(string_split_regex(trim(text), '\\s+'), lambda w: w <> ''),
 lambda w: CASE WHEN lower(trim(w, {_MARKS})) IN ({', '.join(repr(k) for k, v in LEXICON.items() if v)}) THEN regexp_extract(w, '^[^\\p{{L}}\\p{{N}}]*') || (CASE lower(trim(w, {_MARKS})) {_CASES} END) || regexp_extract(w, '[^\\p{{L}}\\p{{N}}]*$') ELSE w END), ' ')"""


@query(f"SELECT doc_id AS video_id, {_WORDS_SQL} AS text FROM documents")
def lexicon_word_replace(spark, d):
    return texts(spark, d).select("video_id", N.word_replace(F.col("text"), LEXICON).alias("text"))


def _phrase_sql():
    out = "text"
    for k, v in sorted(PHRASES.items(), key=lambda kv: (-len(kv[0]), kv[0])):
        out = f"regexp_replace({out}, '\\b{k}\\b', '{v}', 'gi')"
    return f"SELECT doc_id AS video_id, {out} AS text FROM documents"


@query(_phrase_sql())
def lexicon_phrase_replace(spark, d):
    return texts(spark, d).select("video_id", N.phrase_replace(F.col("text"), PHRASES).alias("text"))


_LEX_ROWS = ", ".join(f"('{lang}', {i}, '{k}', '{v}')" for i, (lang, k, v) in enumerate((lang, k, v) for lang, lx in (("hinglish", MERGE_H), ("telugu", MERGE_T)) for es in lx.values() for k, v in es.items()))


@query(f"""WITH l(lang, ord, src, tgt) AS (VALUES {_LEX_ROWS})
SELECT src, tgt FROM l QUALIFY row_number() OVER (PARTITION BY src ORDER BY CASE WHEN lang = 'hinglish' THEN 0 ELSE 1 END, CASE WHEN lang = 'hinglish' THEN -ord ELSE ord END) = 1""")
def lexicon_precedence_merge(spark, d):
    return N.merge_lexicon_table(lexicon_table(spark, MERGE_H, MERGE_T))


@query(f"""WITH p AS ({_phrase_sql()}) SELECT video_id, CASE WHEN trim(text) = '' THEN text ELSE {_WORDS_SQL} END AS text FROM p""")
def normalise_text(spark, d):
    return texts(spark, d).select("video_id", N.normalise_text(F.col("text"), LEXICON | PHRASES).alias("text"))


@query("""WITH RECURSIVE c AS (
  SELECT doc_id AS video_id, text AS whole, 0 AS chunk, 0 AS lo, length(text) AS n FROM documents WHERE length(text) > 0
  UNION ALL SELECT video_id, whole, chunk + 1, greatest(hi - 200, lo + 1), n FROM (SELECT *, CASE WHEN lo + 1000 >= n THEN n WHEN contains(substr(whole, lo + 1, 1000), ' ') AND
    length(regexp_extract(substr(whole, lo + 1, 1000), '(?s)^(.*) ', 1)) > 500 THEN lo + length(regexp_extract(substr(whole, lo + 1, 1000), '(?s)^(.*) ', 1)) ELSE lo + 1000 END AS hi FROM c) WHERE hi < n)
SELECT video_id, chunk, substr(whole, lo + 1, CASE WHEN lo + 1000 >= n THEN n - lo WHEN contains(substr(whole, lo + 1, 1000), ' ') AND
    length(regexp_extract(substr(whole, lo + 1, 1000), '(?s)^(.*) ', 1)) > 500 THEN length(regexp_extract(substr(whole, lo + 1, 1000), '(?s)^(.*) ', 1)) ELSE 1000 END) AS text FROM c""")
def chunk_overlap(spark, d):
    return texts(spark, d).select("video_id", F.posexplode(chunks(F.col("text"), 1000, 0.2)).alias("chunk", "text"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract_props(spark, d):
    return read(spark, d, "events").select("event_id", F.get_json_object(repaired(F.col("props")), "$.k").try_cast("long").alias("k"))


@query("""WITH s AS (SELECT doc_id AS video_id, unnest(list_filter(list_transform(string_split_regex(text, '[.!?।]+'), lambda x: trim(x)), lambda x: x <> '')) AS sentence FROM documents)
SELECT video_id, sentence, unnest(list_transform(string_split_regex(lower(trim(sentence)), '\\s+(?:aur|and|or|ya|evam)\\s+'), lambda x: trim(x))) AS part FROM s""")
def conjunction_split(spark, d):
    seg = texts(spark, d).select("video_id", F.lit(0).alias("seg_id"), F.lit("0:00").alias("timestamp_label"), "text")
    return relations.sentence_table(seg).select("video_id", "sentence", F.explode(conjuncts(F.col("sentence"))).alias("part"))


@query()
def scan_cue_matches(spark, d):
    return N.scan_cues(texts(spark, d).withColumn("text", with_cues(F.col("text"))))


@query()
def romanised_names(spark, d):
    """The sample words of the tests in three scripts, beside every document's first word."""
    words = F.array(*map(F.lit, ("पहले", "ముందు", "پہلے")))
    return texts(spark, d).select("video_id", F.transform(F.concat(words, F.slice(F.split("text", r"\s+"), 1, 1)), romanise).alias("latin"))


# --- concept scoring ------------------------------------------------------------------------------------------------
@query(f"WITH {SCORE_CTE} SELECT video_id, concept, n, round(score, 9) AS domain_match FROM sc")
def domain_match_score(spark, d):
    return scored(spark, d).select("video_id", "concept", "n", F.round("score", 9).alias("domain_match"))


_ALIAS_CTE = f", r AS (SELECT term, row_number() OVER (ORDER BY n DESC, term) AS r FROM dict), al AS (SELECT a.term AS alias, b.term AS canonical FROM r a JOIN r b ON a.r = b.r + {N_TERMS // 2})"


@query(f"WITH {DOC_CTE}{_ALIAS_CTE} SELECT video_id, coalesce(canonical, term) AS concept, sum(n)::BIGINT AS n FROM cnt LEFT JOIN al ON term = alias GROUP BY ALL")
def alias_canonicalise(spark, d):
    words = dictionary(texts(spark, d))
    return C.canonical_counts(counts(spark, d, words), aliases(words), ["video_id"])


@query(f"""WITH {DOC_CTE}{_ALIAS_CTE}, c AS (SELECT video_id, coalesce(canonical, term) AS concept, sum(n) AS n FROM cnt LEFT JOIN al ON term = alias GROUP BY ALL)
SELECT video_id, concept, round(least(ln(1 + n) / ln(1 + greatest(3, max(n) OVER (PARTITION BY video_id))), 1.0), 9) AS frequency_score FROM c""")
def frequency_score(spark, d):
    words = dictionary(texts(spark, d))
    c = C.canonical_counts(counts(spark, d, words), aliases(words), ["video_id"])
    return c.select("video_id", "concept", F.round(C.damped(F.col("n"), ["video_id"]), 9).alias("frequency_score"))


@query(f"WITH {SCORE_CTE} SELECT video_id, concept, round(score, 9) AS score FROM sc WHERE score >= 0.6")
def min_score_filter(spark, d):
    return C.keep_scored(scored(spark, d), 0.6).select("video_id", "concept", F.round("score", 9).alias("score"))


AMBIGUOUS = {"this": ["license", "zz"], "that": ["hethth"], "with": ["tion"]}
_AMB = ", ".join(f"('{k}', {v!r}, '{k} x')" for k, v in AMBIGUOUS.items())


@query(f"""WITH {SCORE_CTE}, a(concept, context, promoted) AS (VALUES {_AMB})
SELECT sc.video_id, coalesce(promoted, concept) AS concept, n FROM sc LEFT JOIN a USING (concept) JOIN documents ON doc_id = video_id
WHERE context IS NULL OR len(list_filter(context, lambda w: contains(lower(text), w))) > 0""")
def ambiguity_filter(spark, d):
    return C.keep_unambiguous(scored(spark, d), texts(spark, d), AMBIGUOUS, {k: f"{k} x" for k in AMBIGUOUS}).select("video_id", "concept", "n")


@query(f"""WITH {CONV_TOK}, c AS (SELECT DISTINCT video_id, w AS concept FROM tok WHERE length(w) BETWEEN 3 AND 8 AND regexp_matches(w, '^[a-z]+$'))
SELECT video_id, concept FROM c WHERE NOT EXISTS (SELECT 1 FROM c o WHERE o.video_id = c.video_id AND contains(o.concept, c.concept) AND length(c.concept) < length(o.concept))""")
def substring_subconcept_antijoin(spark, d):
    w = turns(spark, d).select("video_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("concept"))
    return C.drop_sub_concepts(w.where(F.col("concept").rlike("^[a-z]{3,8}$")).distinct())


@query(f"WITH {SCORE_CTE}, k AS (SELECT video_id, concept, row_number() OVER (PARTITION BY video_id ORDER BY score DESC, concept)::INT AS concept_rank FROM sc) SELECT * FROM k WHERE concept_rank <= 5")
def concept_rank_topk(spark, d):
    return C.rank_concepts(scored(spark, d)).where("concept_rank <= 5").select("video_id", "concept", "concept_rank")


_STOPS = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))
RAKE_CTE = f"""st AS (SELECT conv_id AS video_id, string_agg(text, ' ' ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id),
 sn AS (SELECT video_id, string_split(regexp_replace(lower(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS l FROM st),
 se AS (SELECT video_id, unnest(l) AS s, generate_subscripts(l, 1) AS sent FROM sn),
 tl AS (SELECT video_id, sent, regexp_extract_all(s, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]+') AS l FROM se),
 tk AS (SELECT video_id, sent, unnest(l) AS tok, generate_subscripts(l, 1) AS pos FROM tl),
 br AS (SELECT *, (tok IN ({_STOPS}) OR (length(tok) = 1 AND regexp_matches(tok, '[^\\p{{L}}\\p{{N}}_\\s]')))::INT AS brk FROM tk),
 rn AS (SELECT *, sum(brk) OVER (PARTITION BY video_id, sent ORDER BY pos) AS run FROM br),
 ph AS (SELECT DISTINCT video_id, words FROM (SELECT video_id, sent, run, list(tok ORDER BY pos) AS words FROM rn WHERE brk = 0 GROUP BY ALL) WHERE len(words) <= 4),
 ea AS (SELECT video_id, unnest(words) AS w, len(words) AS l FROM ph),
 ws AS (SELECT video_id, w, sum(l) / count(*) AS ratio FROM ea GROUP BY ALL),
 px AS (SELECT video_id, words, array_to_string(words, ' ') AS phrase, unnest(words) AS w FROM ph),
 rk AS (SELECT video_id, phrase, any_value(words) AS words, sum(ratio) AS score FROM px JOIN ws USING (video_id, w) GROUP BY video_id, phrase)"""
RAKE_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"


def phrases(spark, d):
    return C.key_phrases(N.full_texts(turns(spark, d)).withColumnRenamed("full_text", "text"), pattern=RAKE_PATTERN)


@query(f"WITH {RAKE_CTE} SELECT video_id, phrase, round(score, 6) AS score FROM rk")
def rake_phrase_scores(spark, d):
    return phrases(spark, d).select("video_id", "phrase", F.round("score", 6).alias("score"))


@query(f"""WITH {RAKE_CTE}, {M_CTE},
 rel AS (SELECT *, score / max(score) OVER (PARTITION BY video_id) AS rel FROM rk),
 ex AS (SELECT video_id, phrase AS concept, rel FROM rel WHERE phrase IN (SELECT term FROM dict)),
 pa AS (SELECT video_id, term AS concept, 0.8 * rel AS rel FROM rel JOIN dict ON list_has_all(words, string_split(term, ' ')) WHERE phrase NOT IN (SELECT term FROM dict))
SELECT video_id, concept, round(max(rel), 6) AS rake FROM (SELECT * FROM ex UNION ALL SELECT * FROM pa) GROUP BY ALL""")
def rake_concept_containment(spark, d):
    names = dictionary(turns(spark, d)).select(F.col("term").alias("concept"))
    none = spark.createDataFrame([], "alias string, canonical string")
    return C.phrase_concept_scores(phrases(spark, d), names, none).select("video_id", "concept", F.round("rake", 6).alias("rake"))


@query(f"""WITH {RAKE_CTE}, {M_CTE},
 rel AS (SELECT *, score / max(score) OVER (PARTITION BY video_id) AS rel FROM rk),
 rc AS (SELECT video_id, concept, max(rel) AS rake FROM (SELECT video_id, phrase AS concept, rel FROM rel WHERE phrase IN (SELECT term FROM dict)
   UNION ALL SELECT video_id, term, 0.8 * rel FROM rel JOIN dict ON list_has_all(words, string_split(term, ' ')) WHERE phrase NOT IN (SELECT term FROM dict)) GROUP BY ALL),
 cn AS (SELECT video_id, w AS concept, count(*) AS n FROM tok WHERE w IN (SELECT term FROM dict) GROUP BY ALL),
 fq AS (SELECT video_id, concept, least(ln(1 + n) / ln(1 + greatest(3, max(n) OVER (PARTITION BY video_id))), 1.0) AS fs FROM cn)
SELECT video_id, concept, round(coalesce(fs, 0) * 0.5 + coalesce(rake, 0) * 0.3 + coalesce(fs, 0) * 0.2, 6) AS score FROM fq FULL OUTER JOIN rc USING (video_id, concept)""")
def hybrid_score(spark, d):
    s = turns(spark, d)
    names = dictionary(s).select("term")
    t = N.full_texts(s).withColumnRenamed("full_text", "text")
    c = C.term_counts(t, names, ["video_id"])
    f = c.select("video_id", F.col("term").alias("concept"), C.damped(F.col("n"), ["video_id"]).alias("domain_match"))
    none = spark.createDataFrame([], "alias string, canonical string")
    rake = C.phrase_concept_scores(phrases(spark, d), names.select(F.col("term").alias("concept")), none)
    return C.hybrid_scores(f, rake, f.withColumnRenamed("domain_match", "frequency_score")).select("video_id", "concept", F.round("score", 6).alias("score"))


# --- mentions and relations -----------------------------------------------------------------------------------------
@query(f"WITH {M_CTE} SELECT video_id, name, list({LABEL.format(x='seg_id * 10')} ORDER BY seg_id) AS timestamps, {LABEL.format(x='min(seg_id) * 10')} AS first_mention, (min(seg_id) * 10)::INT AS first_sec FROM m GROUP BY video_id, name")
def mention_timestamps(spark, d):
    return C.mention_times(found(spark, d))


@query(f"WITH {F_CTE} SELECT video_id, name, first_sec::INT AS first_sec, first_mention FROM f")
def first_mention(spark, d):
    return firsts(found(spark, d))


def with_cues(text):
    """Texts of the driver hold no cues, so frequent words stand in for them."""
    for word, cue in STAND_INS.items():
        text = F.replace(text, F.lit(f" {word} "), F.lit(f" {cue} "))
    return text


def _with_cues_sql(text="text"):
    for word, cue in STAND_INS.items():
        text = f"replace({text}, ' {word} ', ' {cue} ')"
    return text


def _cue_sql(key, seg, frm):
    """CTEs s (sentences) and x (lists of matches) over a table."""
    parts = []
    for i, (p, direction, c) in enumerate(CUES):
        parts.append(f"SELECT video_id, seg_id, sent_idx, sentence, {i} AS pat_idx, '{direction}' AS direction, {c}::DOUBLE AS confidence, regexp_extract_all(sentence, '(?i){p}', 1) AS a, regexp_extract_all(sentence, '(?i){p}', 2) AS b FROM s")
    lists = f"SELECT {key} AS video_id, {seg} AS seg_id, list_filter(list_transform(string_split_regex({_with_cues_sql()}, '[.!?।]+'), lambda x: trim(x)), lambda x: x <> '') AS l FROM {frm}"
    return f"sl AS ({lists}), s AS (SELECT video_id, seg_id, unnest(l) AS sentence, (generate_subscripts(l, 1) - 1)::INT AS sent_idx FROM sl), x AS ({' UNION ALL '.join(parts)}), mt AS (SELECT video_id, seg_id, sent_idx, sentence, pat_idx, direction, confidence, (generate_subscripts(a, 1) - 1)::INT AS match_idx, unnest(a) AS first, unnest(b) AS second FROM x)"


@query(f"WITH {_cue_sql('doc_id', '0', 'documents')} SELECT video_id, sentence, pat_idx, direction, confidence, match_idx, first, second FROM mt")
def cue_match_generate(spark, d):
    t = read(spark, d, "documents").select(F.col("doc_id").alias("video_id"), F.lit(0).alias("seg_id"), F.lit("0:00").alias("timestamp_label"), with_cues(F.col("text")).alias("text"))
    return relations.cue_matches(relations.sentence_table(t), CUES).select("video_id", "sentence", "pat_idx", "direction", "confidence", "match_idx", "first", "second")


@query(f"""WITH {M_CTE}, {_cue_sql('conv_id', 'turn', 'conversations')}, dd AS (SELECT term, row_number() OVER (ORDER BY n DESC, term) AS rk FROM dict),
 k AS (SELECT DISTINCT video_id, name, rk FROM m JOIN dd ON term = name),
 fr AS (SELECT *, 'a' AS side, first AS frag FROM mt UNION ALL SELECT *, 'b', second FROM mt),
 pl AS (SELECT *, list_transform(string_split_regex(lower(trim(frag)), '\\s+(?:aur|and|or|ya|evam)\\s+'), lambda x: trim(x)) AS l FROM fr),
 pt AS (SELECT * EXCLUDE (l), unnest(l) AS p, generate_subscripts(l, 1) AS part FROM pl UNION ALL SELECT * EXCLUDE (l), lower(trim(frag)), 1000000 FROM pl),
 ht AS (SELECT pt.*, name FROM pt JOIN k ON k.video_id = pt.video_id AND contains(p, name)
   QUALIFY row_number() OVER (PARTITION BY pt.video_id, seg_id, sent_idx, pat_idx, match_idx, side, part ORDER BY (p = name)::INT DESC, length(name) DESC, rk) = 1),
 ok AS (SELECT * FROM ht QUALIFY part < 1000000 OR min(part) OVER (PARTITION BY video_id, seg_id, sent_idx, pat_idx, match_idx, side) = 1000000),
 nm AS (SELECT video_id, seg_id, sent_idx, pat_idx, match_idx, side, name, direction, confidence, sentence, min(part) AS part FROM ok GROUP BY ALL),
 pr AS (SELECT a.video_id, a.seg_id, a.sent_idx, a.pat_idx, a.match_idx, a.confidence, a.sentence, a.part AS pa, b.part AS pb,
   CASE WHEN a.direction = 'forward' THEN a.name ELSE b.name END AS src, CASE WHEN a.direction = 'forward' THEN b.name ELSE a.name END AS dst
   FROM nm a JOIN nm b USING (video_id, seg_id, sent_idx, pat_idx, match_idx) WHERE a.side = 'a' AND b.side = 'b' AND a.name <> b.name)
SELECT video_id, src, dst, 'prerequisite' AS relation, confidence, sentence AS evidence, {LABEL.format(x='seg_id * 10')} AS "timestamp", 'pattern_matching' AS detection_method FROM pr
QUALIFY row_number() OVER (PARTITION BY video_id, src, dst ORDER BY seg_id, sent_idx, pat_idx, match_idx, pa, pb) = 1""")
def pattern_edges(spark, d):
    """All cues over all segments; concepts of a video are the dictionary's terms that it mentions, ranked as in the dictionary."""
    s = turns(spark, d)
    return relations.pattern_edges(s.withColumn("text", with_cues(F.col("text"))), ranked_names(s), CUES)


@query(f"""WITH {M_CTE}, dd AS (SELECT term, row_number() OVER (ORDER BY n DESC, term) AS rk FROM dict), k AS (SELECT DISTINCT video_id, name, rk FROM m JOIN dd ON term = name),
 fr AS (SELECT conv_id AS video_id, turn AS seg_id, lower(trim(text)) AS p FROM conversations)
SELECT video_id, seg_id, name FROM fr JOIN k USING (video_id) WHERE contains(p, name) QUALIFY row_number() OVER (PARTITION BY video_id, seg_id ORDER BY (p = name)::INT DESC, length(name) DESC, rk) = 1""")
def longest_fragment_concept(spark, d):
    c = read(spark, d, "conversations")
    per = ranked_names(turns(spark, d))
    frag = c.select(F.struct("conv_id", "turn").alias("frag_id"), F.col("conv_id").alias("video_id"), F.col("text").alias("fragment"))
    whole = relations.fragment_concepts(frag.withColumn("fragment", F.regexp_replace(F.lower("fragment"), r"\s(?=(?:aur|and|or|ya|evam)\s)", "_")), per)
    return whole.select(F.col("frag_id.conv_id").alias("video_id"), F.col("frag_id.turn").alias("seg_id"), "name")


@query(f"WITH {F_CTE}{TE_CTE} SELECT * REPLACE (round(confidence, 9) AS confidence) FROM te")
def temporal_next3_edges(spark, d):
    return relations.temporal_edges(firsts(found(spark, d))).withColumn("confidence", F.round("confidence", 9))


@query(f"WITH {E_CTE} SELECT * FROM co")
def cooccurrence_edges(spark, d):
    return cooc(spark, d)


def merged(spark, d):
    m = found(spark, d)
    f = firsts(m)
    return relations.priority_merge([relations.temporal_edges(f), relations.cooccurrence_edges(m, f)])


@query(f"WITH {E_CTE}{TE_CTE}{MERGED_CTE} SELECT video_id, src, dst, detection_method, round(confidence, 9) AS confidence FROM mg")
def priority_merge_edges(spark, d):
    return merged(spark, d).select("video_id", "src", "dst", "detection_method", F.round("confidence", 9).alias("confidence"))


@query(f"WITH {E_CTE}{TE_CTE}{MERGED_CTE} SELECT video_id, src, dst, detection_method FROM mg WHERE floor(confidence * 10000 + 0.5) / 10000 >= 0.4")
def min_confidence_after_merge(spark, d):
    return relations.keep_confident(merged(spark, d)).select("video_id", "src", "dst", "detection_method")


_W = " ".join(f"WHEN '{k}' THEN {v}" for k, v in METHOD_WEIGHTS.items())


@query(f"""WITH {E_CTE}{TE_CTE}, u AS (SELECT *, 0 AS ord FROM te UNION ALL SELECT *, 1 AS ord FROM co),
 w AS (SELECT *, (CASE detection_method {_W} ELSE {OTHER_METHOD_WEIGHT} END)::DOUBLE AS w FROM u)
SELECT video_id, src, dst, round(least(1.0, least(1.0, sum(confidence * w) / sum(w)) + 0.05 * (count(*) - 1)), 6) AS confidence,
 array_to_string(list(detection_method ORDER BY ord), '+') AS detection_method, first(evidence ORDER BY ord) AS evidence FROM w GROUP BY video_id, src, dst""")
def multi_source_edge_merge(spark, d):
    m = found(spark, d)
    f = firsts(m)
    both = relations.temporal_edges(f).withColumn("ord", F.lit(0)).unionByName(relations.cooccurrence_edges(m, f).withColumn("ord", F.lit(1)))
    return graph.merge_sources(both).select("video_id", "src", "dst", F.round("confidence", 6).alias("confidence"), "detection_method", "evidence")


# --- de-duplication -------------------------------------------------------------------------------------------------
PAIR_SQL = f"""v AS (SELECT label, vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
 p AS (SELECT a.label, a.id AS a, b.id AS b, list_cosine_similarity(a.v, b.v) AS cosine FROM v a JOIN v b ON a.label = b.label AND a.id < b.id), pp AS (SELECT * FROM p WHERE cosine >= {SIMILAR})"""
COMP_SQL = "sy AS (SELECT a AS x, b AS y FROM pp UNION ALL SELECT b, a FROM pp), re AS (SELECT x AS node, x AS r FROM sy UNION SELECT re.node, sy.y FROM re JOIN sy ON re.r = sy.x), cm AS (SELECT node, min(r) AS root FROM re GROUP BY node)"


def vectors(spark, d):
    return read(spark, d, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))


def pairs(spark, d):
    return graph.similar_pairs(vectors(spark, d), SIMILAR, key="label")


@query(f"WITH {PAIR_SQL} SELECT label, a, b, round(cosine, 6) AS cosine FROM pp")
def cosine_similar_pairs(spark, d):
    return pairs(spark, d).withColumn("cosine", F.round("cosine", 6))


@query(f"WITH RECURSIVE {PAIR_SQL}, {COMP_SQL} SELECT node, root FROM cm")
def dedup_components(spark, d):
    return components(graph.similar_links(vectors(spark, d), SIMILAR, key="label"))


@query(f"""WITH RECURSIVE {PAIR_SQL}, {COMP_SQL}, x AS (SELECT v.id, coalesce(root, v.id) AS root FROM v LEFT JOIN cm ON node = v.id)
SELECT root, count(*) AS members, max(id) AS canonical, sum(id % 7)::BIGINT AS frequency FROM x GROUP BY root""")
def dedup_canonical_aggregate(spark, d):
    v = vectors(spark, d).select(F.col("id").alias("node"))
    x = v.join(components(graph.similar_links(vectors(spark, d), SIMILAR, key="label")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    return x.groupBy("root").agg(F.count(F.lit(1)).alias("members"), F.max_by("node", "node").alias("canonical"), F.sum(F.col("node") % 7).alias("frequency"))


@query(f"""WITH {E_CTE}, mp AS (SELECT *, CASE WHEN length(src) % 2 = 1 THEN left(src, 4) ELSE src END AS s, CASE WHEN length(dst) % 2 = 1 THEN left(dst, 4) ELSE dst END AS t FROM co)
SELECT video_id, s AS src, t AS dst, confidence, "timestamp" FROM mp WHERE s <> t QUALIFY row_number() OVER (PARTITION BY video_id, s, t ORDER BY confidence DESC, src, dst) = 1""")
def edge_endpoint_remap(spark, d):
    """Names of odd length stand for their first four letters."""
    e = cooc(spark, d)
    names = e.select("video_id", F.explode(F.array("src", "dst")).alias("name")).distinct()
    mapping = names.withColumn("canonical", F.when(F.length("name") % 2 == 1, F.substring("name", 1, 4)).otherwise(F.col("name")))
    return graph.remap_edges(e, mapping).select("video_id", "src", "dst", "confidence", "timestamp")


@query(f"WITH {E_CTE}, k AS (SELECT video_id, name FROM f WHERE frequency >= 2) SELECT co.* FROM co SEMI JOIN k ON co.video_id = k.video_id AND co.src = k.name SEMI JOIN k k2 ON co.video_id = k2.video_id AND co.dst = k2.name")
def edges_semi_nodes(spark, d):
    return graph.with_nodes(cooc(spark, d), nodes(spark, d).where("frequency >= 2")).select(*relations.EDGE)


# --- graph metrics --------------------------------------------------------------------------------------------------
N_CTE = E_CTE + ", n AS (SELECT video_id, name, count(*) OVER (PARTITION BY video_id) AS n FROM f), di AS (SELECT video_id, dst AS name, count(*) AS din FROM co GROUP BY ALL), dx AS (SELECT video_id, src AS name, count(*) AS dout FROM co GROUP BY ALL)"


@query(f"""WITH {N_CTE} SELECT video_id, name, round(CASE WHEN n <= 1 THEN 1 ELSE coalesce(din, 0) / (n - 1) END, 9) AS in_degree_centrality, round(CASE WHEN n <= 1 THEN 1 ELSE coalesce(dout, 0) / (n - 1) END, 9) AS out_degree_centrality
FROM n LEFT JOIN di USING (video_id, name) LEFT JOIN dx USING (video_id, name)""")
def degree_centrality(spark, d):
    c = graph.degree_centrality(nodes(spark, d), cooc(spark, d))
    return c.select("video_id", "name", *[F.round(x, 9).alias(x) for x in ("in_degree_centrality", "out_degree_centrality")])


@query(f"WITH {E_CTE}, a AS (SELECT video_id, count(*) AS n FROM f GROUP BY ALL), b AS (SELECT video_id, count(*) AS m FROM co GROUP BY ALL) SELECT video_id, n, coalesce(m, 0) AS m, round(CASE WHEN n > 1 THEN coalesce(m, 0) / (n * (n - 1)) ELSE 0 END, 9) AS density FROM a LEFT JOIN b USING (video_id)")
def graph_density(spark, d):
    return graph.density(nodes(spark, d), cooc(spark, d)).withColumn("density", F.round("density", 9))


def _rank_ctes():
    out = f"b AS (SELECT n.video_id, n.name, n.n, din AS deg FROM n LEFT JOIN di USING (video_id, name)), r0 AS (SELECT *, 1.0::DOUBLE / n AS r FROM b)"
    for i in range(RANK_ROUNDS):
        out += f""", g{i} AS (SELECT co.video_id, co.src AS name, sum(r / deg) AS f FROM co JOIN r{i} x ON x.video_id = co.video_id AND x.name = co.dst GROUP BY ALL),
 l{i} AS (SELECT video_id, sum(r) AS loose FROM r{i} WHERE deg IS NULL GROUP BY ALL),
 r{i + 1} AS (SELECT b.*, 0.15 / n + 0.85 * (coalesce(f, 0) + coalesce(loose, 0) / n) AS r FROM b LEFT JOIN g{i} USING (video_id, name) LEFT JOIN l{i} USING (video_id))"""
    return out + f", pg AS (SELECT video_id, name, round(r, 6) AS pagerank FROM r{RANK_ROUNDS})"


@query(f"WITH {N_CTE}, {_rank_ctes()} SELECT * FROM pg")
def pagerank_fixed_iters(spark, d):
    return graph.pagerank(nodes(spark, d), cooc(spark, d), RANK_ROUNDS).withColumn("pagerank", F.round("pagerank", 6))


def _hits_sql():
    out = f"WITH {E_CTE}, h0 AS (SELECT video_id, name, 1.0::DOUBLE AS hub FROM f)"
    for i in range(HITS_ROUNDS):
        out += f""", x{i} AS (SELECT co.video_id, dst AS name, sum(hub) AS s FROM co JOIN h{i} h ON h.video_id = co.video_id AND h.name = co.src GROUP BY ALL), a{i} AS (SELECT video_id, name, s / sum(s) OVER (PARTITION BY video_id) AS auth FROM x{i}),
 y{i} AS (SELECT co.video_id, src AS name, sum(auth) AS s FROM co JOIN a{i} a ON a.video_id = co.video_id AND a.name = co.dst GROUP BY ALL), h{i + 1} AS (SELECT video_id, name, s / sum(s) OVER (PARTITION BY video_id) AS hub FROM y{i})"""
    return out + f" SELECT video_id, name, round(coalesce(hub, 0), 6) AS hub_score, round(coalesce(auth, 0), 6) AS authority_score FROM f LEFT JOIN h{HITS_ROUNDS} USING (video_id, name) LEFT JOIN a{HITS_ROUNDS - 1} USING (video_id, name)"


@query(_hits_sql())
def hits_fixed_iters(spark, d):
    return graph.hits(nodes(spark, d), cooc(spark, d), HITS_ROUNDS).select("video_id", "name", F.round("hub_score", 6).alias("hub_score"), F.round("authority_score", 6).alias("authority_score"))


DEPTH_SQL = "dp AS (SELECT video_id, name, 0 AS depth FROM f UNION SELECT co.video_id, co.dst, depth + 1 FROM dp JOIN co ON co.video_id = dp.video_id AND co.src = dp.name), dm AS (SELECT video_id, name, max(depth)::INT AS depth FROM dp GROUP BY ALL)"


@query(f"WITH RECURSIVE {E_CTE}, {DEPTH_SQL} SELECT * FROM dm")
def longest_path_depth(spark, d):
    return graph.depth(nodes(spark, d), cooc(spark, d))


@query(f"WITH RECURSIVE {E_CTE}, an AS (SELECT video_id, dst AS name, src AS reached FROM co UNION SELECT an.video_id, an.name, co.src FROM an JOIN co ON co.video_id = an.video_id AND co.dst = an.reached) SELECT * FROM an")
def ancestors(spark, d):
    return graph.ancestors(cooc(spark, d), nodes(spark, d))


@query(f"WITH RECURSIVE {E_CTE}, an AS (SELECT video_id, src AS name, dst AS reached FROM co UNION SELECT an.video_id, an.name, co.dst FROM an JOIN co ON co.video_id = an.video_id AND co.src = an.reached) SELECT * FROM an")
def descendants(spark, d):
    return graph.descendants(cooc(spark, d), nodes(spark, d))


@query(f"""WITH RECURSIVE {N_CTE}, {_rank_ctes()}, {DEPTH_SQL}
SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY depth, coalesce(dout, 0) DESC, pagerank DESC, coalesce(first_sec, 9999), frequency DESC, name)::INT AS step, name
FROM dm JOIN f USING (video_id, name) JOIN pg USING (video_id, name) LEFT JOIN dx USING (video_id, name)""")
def learning_path_order(spark, d):
    e, n = cooc(spark, d), nodes(spark, d)
    out = e.groupBy("video_id", F.col("src").alias("name")).agg(F.count(F.lit(1)).alias("out_degree"))
    ranks = graph.pagerank(n, e, RANK_ROUNDS).withColumn("pagerank", F.round("pagerank", 6))
    m = graph.depth(n, e).join(n, ["video_id", "name"]).join(ranks, ["video_id", "name"]).join(out, ["video_id", "name"], "left").na.fill(0, ["out_degree"])
    return graph.learning_path(m)


def metrics(spark, d):
    return graph.graph_metrics(nodes(spark, d), cooc(spark, d))


@query()
def betweenness(spark, d):
    return metrics(spark, d).select("video_id", "name", "betweenness")


@query()
def communities(spark, d):
    return metrics(spark, d).select("video_id", "name", "community")


@query(f"""WITH {E_CTE}, sy AS (SELECT video_id, src AS x, dst AS y FROM co UNION ALL SELECT video_id, dst, src FROM co), v0 AS (SELECT min(video_id) AS v FROM co), s0 AS (SELECT min(src) AS s FROM co, v0 WHERE video_id = v),
 hp AS (SELECT s AS name, 0 AS hop FROM s0 UNION ALL SELECT y, 1 FROM sy, v0, s0 WHERE video_id = v AND x = s UNION ALL SELECT b.y, 2 FROM sy a JOIN sy b ON a.video_id = b.video_id AND a.y = b.x, v0, s0 WHERE a.video_id = v AND a.x = s)
SELECT name, min(hop)::INT AS hop FROM hp GROUP BY name""")
def k_hop_neighbourhood(spark, d):
    e = cooc(spark, d)
    first = e.orderBy("video_id", "src").select("video_id", "src").limit(1).first()  # the selected node
    return graph.neighbourhood(e, first["video_id"], first["src"]) if first else spark.createDataFrame([], "name string, hop int")


@query(f"WITH {F_CTE} SELECT video_id, name, frequency FROM f WHERE frequency IN (2, 3)")
def property_filter_nodes(spark, d):
    return graph.nodes_with(nodes(spark, d), "frequency", [2, 3, 0]).select("video_id", "name", "frequency")


@query(f"WITH {E_CTE}, k AS (SELECT * FROM co WHERE \"timestamp\" IN ('0:10', '0:20')) SELECT video_id, src AS name FROM k UNION SELECT video_id, dst FROM k")
def property_filter_edges(spark, d):
    return graph.ends_of_edges_with(cooc(spark, d), "timestamp", ["0:10", "0:20"])


# --- export ---------------------------------------------------------------------------------------------------------
C_CTE = ", c AS (SELECT *, frequency / max(frequency) OVER (PARTITION BY video_id) AS importance FROM f)"


@query(f"""WITH {F_CTE}{C_CTE} SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY first_sec, importance DESC, name)::INT AS pos, first_mention AS "time", first_sec::INT AS seconds, name AS concept, round(importance, 9) AS importance FROM c""")
def timeline(spark, d):
    return export.timeline(nodes(spark, d)).withColumn("importance", F.round("importance", 9))


@query(f"WITH {E_CTE}, a AS (SELECT video_id, count(*) AS total_concepts FROM f GROUP BY ALL), b AS (SELECT video_id, count(*) AS m, avg(confidence) AS c FROM co GROUP BY ALL) SELECT video_id, total_concepts, coalesce(m, 0) AS total_relationships, round(coalesce(c, 0), 4) AS avg_confidence FROM a LEFT JOIN b USING (video_id)")
def analytics_summary(spark, d):
    return export.analytics(nodes(spark, d), cooc(spark, d)).withColumn("avg_confidence", F.round("avg_confidence", 4))


@query(f"WITH {F_CTE}, t AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frequency DESC, name) AS r FROM f QUALIFY r <= 15) SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY r DESC)::INT AS bar, name, frequency FROM t")
def frequency_top15(spark, d):
    return export.top_frequent(nodes(spark, d))


@query(f"""WITH RECURSIVE {E_CTE}, {DEPTH_SQL}, a AS (SELECT video_id, count(*) AS n, max(depth)::INT AS max_depth FROM dm GROUP BY ALL), b AS (SELECT video_id, count(*) AS m FROM co GROUP BY ALL)
SELECT video_id, round(CASE WHEN n > 1 THEN coalesce(m, 0) / (n * (n - 1)) ELSE 0 END, 9) AS density, max_depth, max_depth AS longest_path FROM a LEFT JOIN b USING (video_id)""")
def metrics_summary(spark, d):
    s = export.metrics_summary(metrics(spark, d), cooc(spark, d))
    return s.select("video_id", F.round("density", 9).alias("density"), "max_depth", "longest_path")


@query(f"WITH {N_CTE}, {_rank_ctes()} SELECT video_id, name, round(20 + 30 * pagerank / greatest(max(pagerank) OVER (PARTITION BY video_id), 1e-12), 6) AS size FROM pg")
def viz_node_style(spark, d):
    m = graph.pagerank(nodes(spark, d), cooc(spark, d), RANK_ROUNDS).withColumns({"pagerank": F.round("pagerank", 6), "community": F.lit(0)})
    return export.node_style(m).select("video_id", "name", F.round("size", 6).alias("size"))


@query(f"WITH {F_CTE}{TE_CTE} SELECT video_id, src, dst, round(1 + 2.5 * confidence, 6) AS width, floor((0.20 + 0.50 * confidence) * 100 + 0.5) / 100 AS alpha FROM te")
def viz_edge_style(spark, d):
    e = relations.temporal_edges(firsts(found(spark, d)))
    return export.edge_style(e).withColumn("width", F.round("width", 6))


@query(f"WITH {SCORE_CTE} SELECT video_id, concept, CASE WHEN score > 0.8 THEN 'high' WHEN score > 0.6 THEN 'medium' ELSE 'low' END AS bucket FROM sc")
def confidence_bucket(spark, d):
    return scored(spark, d).select("video_id", "concept", export.confidence_bucket(F.col("score")).alias("bucket"))


@query(f"WITH {F_CTE}{C_CTE} SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY importance DESC, name)::INT AS card, name, round(importance, 9) AS importance_score, frequency, first_mention, floor(importance / max(importance) OVER (PARTITION BY video_id) * 100 + 0.5)::INT AS bar FROM c")
def concept_cards(spark, d):
    return export.cards(nodes(spark, d)).withColumn("importance_score", F.round("importance_score", 9))


@query(f"SELECT conv_id AS video_id, turn::INT AS seg_id, '[' || {LABEL.format(x='turn * 10')} || '] ' || text AS line FROM conversations")
def segment_listing(spark, d):
    return export.segment_lines(turns(spark, d))


@query(f"WITH {F_CTE}{C_CTE} SELECT video_id, name, round(14 + 22 * importance, 6) AS size, round(0.4 + 0.6 * importance, 6) AS alpha FROM c")
def timeline_markers(spark, d):
    return export.markers(nodes(spark, d)).select("video_id", "name", F.round("size", 6).alias("size"), F.round("alpha", 6).alias("alpha"))


@query(f"WITH {F_CTE} SELECT video_id, name, first_sec::INT AS seconds FROM f")
def timestamp_parse(spark, d):
    return firsts(found(spark, d)).select("video_id", "name", label_seconds(F.col("first_mention")).alias("seconds"))


@query()
def top_metric_lists(spark, d):
    return export.shown_lists(export.top_lists(metrics(spark, d)))


@query()
def community_members(spark, d):
    return export.community_lists(metrics(spark, d))


@query()
def kg_json_document(spark, d):
    n = nodes(spark, d).withColumn("title", title_case(F.col("name")))
    e, m = cooc(spark, d), metrics(spark, d)
    out = e.groupBy("video_id", F.col("src").alias("name")).agg(F.count(F.lit(1)).alias("out_degree"))
    path = graph.learning_path(m.join(n.select("video_id", "name", "first_sec", "importance_score"), ["video_id", "name"]).join(out, ["video_id", "name"], "left").na.fill(0, ["out_degree"]))
    e2 = e.withColumn("video_id", F.col("video_id").cast("string"))
    n2, m2, p2 = (x.withColumn("video_id", F.col("video_id").cast("string")) for x in (n, m, path))
    return export.documents(n2, e2, m2, p2, processed_at=F.lit("2024-01-01T00:00:00Z"))
