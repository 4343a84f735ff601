"""Licence scan: ordered signature rules behind a keyword prefilter, in DataFrame functions only.

A few hundred rules are built from licence families and notice forms. A text is looked at only where a keyword
of a rule occurs: it is cut into chunks of 2000 characters with 600 more to look back and 300 ahead, so work per chunk
is bounded for texts of any length, and a match belongs to the chunk in which it starts. No match is longer than 300
characters, as runs of over 8 white-space characters or 16 digits are shortened first, which changes no match. A
detection is dropped if a detection of higher priority (then: longer, then: earlier rule) contains its interval; all that
could contain it lie in its chunk's reach. Only where matches of one rule overlap each other in an unbroken chain
of over 300 characters can a chunk count other links of the chain than a scan of the whole text.

Defined results: null text is empty text (no words, no labels, score 0); repeated rows give repeated results; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kgraph.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CHUNK, AHEAD, BACK = 2000, 300, 600

#: phrase -> label of the base detections
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: label, words of which every match of any form holds one, name pattern, SPDX pattern, URL pattern
FAMILIES = [
    ("gpl", "gpl general", r"(?:gnu )?(?:gpl|general public licen[sc]e)", r"gpl-[123]\.0", r"gnu\.org/licenses/(?:old-licenses/)?gpl"),
    ("gpl-2.0", "gpl general", r"(?:gnu )?(?:gpl|general public licen[sc]e),? ?(?:version |v\.? ?)?2(?:\.0)?(?!\.?\d)", r"gpl-2\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2"),
    ("gpl-3.0", "gpl general", r"(?:gnu )?(?:gpl|general public licen[sc]e),? ?(?:version |v\.? ?)?3(?:\.0)?(?!\.?\d)", r"gpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/gpl-3"),
    ("lgpl", "lgpl lesser library", r"(?:gnu )?(?:lgpl|(?:lesser|library) general public licen[sc]e)", r"lgpl-[23]\.[01](?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl"),
    ("lgpl-2.1", "lgpl lesser", r"(?:gnu )?(?:lgpl|lesser general public licen[sc]e),? ?(?:version |v\.? ?)?2\.1", r"lgpl-2\.1(?:-only|-or-later|\+)?", r"gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1"),
    ("lgpl-3.0", "lgpl lesser", r"(?:gnu )?(?:lgpl|lesser general public licen[sc]e),? ?(?:version |v\.? ?)?3(?:\.0)?(?!\.?\d)", r"lgpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/lgpl-3"),
    ("agpl-3.0", "agpl affero", r"(?:gnu )?(?:agpl|affero general public licen[sc]e)(?:,? ?(?:version |v\.? ?)?3(?:\.0)?)?", r"agpl-3\.0(?:-only|-or-later|\+)?", r"gnu\.org/licenses/agpl"),
    ("gfdl", "fdl documentation", r"(?:gnu )?(?:gfdl|free documentation licen[sc]e)(?:,? (?:version |v)?1\.[123])?", r"gfdl-1\.[123](?:-only|-or-later)?", r"gnu\.org/licenses/fdl"),
    ("apache", "apache", r"apache(?: software)?(?: licen[sc]e)?", r"apache-[12]\.[01]", r"apache\.org/licenses"),
    ("apache-1.1", "apache", r"apache(?: software)? licen[sc]e,? ?(?:version |v\.? ?)?1\.1", r"apache-1\.1", r"apache\.org/licenses/license-1\.1"),
    ("apache-2.0", "apache", r"apache(?: software)?(?: licen[sc]e)?,? ?(?:version |v\.? ?)?2(?:\.0)?(?!\.?\d)", r"apache-2\.0", r"apache\.org/licenses/license-2\.0"),
    ("mit", "mit expat", r"(?:mit|expat)", r"mit", r"opensource\.org/licenses?/mit"),
    ("bsd", "bsd", r"bsd", r"bsd", r"opensource\.org/licenses?/bsd"),
    ("bsd-2-clause", "bsd", r"(?:simplified bsd|freebsd|(?:2|two)[- ]clause bsd|bsd[- ](?:2|two)[- ]clause)", r"bsd-2-clause", r"opensource\.org/licenses?/bsd-2-clause"),
    ("bsd-3-clause", "bsd", r"(?:(?:new|modified) bsd|(?:3|three)[- ]clause bsd|bsd[- ](?:3|three)[- ]clause)", r"bsd-3-clause", r"opensource\.org/licenses?/bsd-3-clause"),
    ("isc", "isc", r"isc", r"isc", r"opensource\.org/licenses?/isc"),
    ("mpl-1.1", "mpl mozilla", r"(?:mpl|mozilla public licen[sc]e),? ?(?:version |v\.? ?)?1\.1", r"mpl-1\.1", r"mozilla\.org/mpl/1\.1"),
    ("mpl-2.0", "mpl mozilla", r"(?:mpl|mozilla public licen[sc]e),? ?(?:version |v\.? ?)?2(?:\.0)?(?!\.?\d)", r"mpl-2\.0", r"mozilla\.org/(?:en-us/)?mpl/2\.0"),
    ("epl-1.0", "epl eclipse", r"(?:epl|eclipse public licen[sc]e),? ?-? ?(?:version |v\.? ?)?1\.0", r"epl-1\.0", r"eclipse\.org/legal/epl-v10"),
    ("epl-2.0", "epl eclipse", r"(?:epl|eclipse public licen[sc]e),? ?-? ?(?:version |v\.? ?)?2(?:\.0)?(?!\.?\d)", r"epl-2\.0", r"eclipse\.org/legal/epl-2\.0"),
    ("cddl", "cddl development", r"(?:cddl|common development and distribution licen[sc]e)(?:,? (?:version |v)?1\.[01])?", r"cddl-1\.[01]", r"opensource\.org/licenses?/cddl"),
    ("cc0", "cc0 zero", r"(?:cc0|creative commons zero)(?: ?1\.0)?(?: universal)?", r"cc0-1\.0", r"creativecommons\.org/publicdomain/zero"),
    ("cc-by", "cc creative", r"(?:cc[- ]by|creative commons attribution)", r"cc-by-[1-4]\.0", r"creativecommons\.org/licenses/by/"),
    ("cc-by-sa", "cc creative", r"(?:cc[- ]by[- ]sa)(?: ?[1-4]\.[05])?", r"cc-by-sa-[1-4]\.[05]", r"creativecommons\.org/licenses/by-sa/"),
    ("cc-by-nc", "cc creative", r"(?:cc[- ]by[- ]nc)(?: ?[1-4]\.[05])?(?![- ](?:sa|nd))", r"cc-by-nc-[1-4]\.[05]", r"creativecommons\.org/licenses/by-nc/"),
    ("cc-by-nd", "cc creative", r"(?:cc[- ]by[- ]nd)(?: ?[1-4]\.[05])?", r"cc-by-nd-[1-4]\.[05]", r"creativecommons\.org/licenses/by-nd/"),
    ("cc-by-nc-sa", "cc creative", r"(?:cc[- ]by[- ]nc[- ]sa)(?: ?[1-4]\.[05])?", r"cc-by-nc-sa-[1-4]\.[05]", r"creativecommons\.org/licenses/by-nc-sa/"),
    ("cc-by-nc-nd", "cc creative", r"(?:cc[- ]by[- ]nc[- ]nd)(?: ?[1-4]\.[05])?", r"cc-by-nc-nd-[1-4]\.[05]", r"creativecommons\.org/licenses/by-nc-nd/"),
    ("cc-by-4.0", "cc creative", r"(?:cc[- ]by|creative commons attribution) ?4\.0", r"cc-by-4\.0", r"creativecommons\.org/licenses/by/4\.0"),
    ("artistic-2.0", "artistic", r"artistic(?: licen[sc]e)?,? ?(?:version |v)?2\.0", r"artistic-2\.0", r"opensource\.org/licenses?/artistic-2\.0"),
    ("zlib", "zlib", r"zlib(?:/libpng)?", r"zlib", r"opensource\.org/licenses?/zlib"),
    ("boost-1.0", "boost bsl", r"(?:boost software licen[sc]e|bsl)[- ,]{0,3}(?:version |v)?1\.0", r"bsl-1\.0", r"boost\.org/license_1_0"),
    ("unlicense", "unlicense", r"unlicense", r"unlicense", r"unlicense\.org"),
    ("wtfpl", "wtfpl", r"wtfpl", r"wtfpl", r"wtfpl\.net"),
    ("ofl-1.1", "ofl font", r"(?:sil )?(?:ofl|open font licen[sc]e)(?:,? ?(?:version |v)?1\.1)?", r"ofl-1\.1", r"scripts\.sil\.org/ofl"),
    ("python-2.0", "psf python", r"(?:psf|python software foundation)(?: licen[sc]e)?(?:,? ?(?:version |v)?2)?", r"(?:psf|python)-2\.0", r"docs\.python\.org/\d(?:\.\d+)?/license"),
    ("odbl", "odbl database", r"(?:odbl|open database licen[sc]e)(?:,? ?(?:version |v)?1\.0)?", r"odbl-1\.0", r"opendatacommons\.org/licenses/odbl"),
    ("eupl", "eupl european", r"(?:eupl|european union public licen[sc]e)(?:,? ?(?:version |v)?1\.[12])?", r"eupl-1\.[12]", r"eupl\.eu"),
]

#: form, words of which every match holds one, pattern around the name (N), SPDX (S) or URL (U), priority
FORMS = [
    ("spdx", "spdx", r"spdx-license-identifier:\s*\(?S(?![a-z0-9.+-])", 95),
    ("url", "://", r"https?://(?:www\.)?U", 90),
    ("notice", "under", r"(?:licensed|released|distributed|published|available|provided|redistributed)\s+under\s+(?:the\s+)?(?:terms\s+(?:and\s+conditions\s+)?of\s+)?(?:the\s+|an?\s+)?N(?:\s+licen[sc]e)?(?![a-z0-9])", 85),
    ("under", "under", r"under\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+|an?\s+)?N\s+licen[sc]e(?![a-z0-9])", 80),
    ("field", "licen", r"licen[sc]e\s*[:=]\s*[\"']?(?:the\s+)?N(?![a-z0-9])", 75),
    ("subject", "subject covered governed", r"(?:subject\s+to|covered\s+by|governed\s+by)\s+(?:the\s+)?(?:terms\s+of\s+)?(?:the\s+)?N(?:\s+licen[sc]e)?(?![a-z0-9])", 70),
    ("copy", "copy", r"copy\s+of\s+the\s+N(?:\s+licen[sc]e)?(?![a-z0-9])", 65),
    ("title", "licen", r"(?<![a-z0-9])N\s+licen[sc]e(?![a-z0-9])", 50),
]

#: texts of notices that name no licence: label, keyword, pattern, priority
TEXTS = [
    ("mit", "permission", r"permission\s+is\s+hereby\s+granted,\s+free\s+of\s+charge", 60),
    ("isc", "permission", r"permission\s+to\s+use,\s+copy,\s+modify,\s+and(?:/or)?\s+distribute\s+this\s+software", 60),
    ("bsd", "redistribution", r"redistribution\s+and\s+use\s+in\s+source\s+and\s+binary\s+forms", 60),
    ("apache-2.0", "compliance", r"you\s+may\s+not\s+use\s+this\s+file\s+except\s+in\s+compliance\s+with\s+the\s+licen[sc]e", 60),
    ("gpl", "redistribute", r"this\s+program\s+is\s+free\s+software[:;,]\s+you\s+can\s+redistribute\s+it", 60),
    ("unlicense", "unencumbered", r"this\s+is\s+free\s+and\s+unencumbered\s+software\s+released\s+into\s+the\s+public\s+domain", 60),
    ("public-domain", "domain", r"(?:dedicated|released)\s+(?:in)?to\s+the\s+public\s+domain", 55),
    ("proprietary", "reserved", r"all\s+rights\s+reserved(?![a-z])", 30),
    ("proprietary", "confidential", r"proprietary\s+and\s+confidential", 40),
]

#: what a chunk must hold for any rule: the forms' words and the texts'; single words, as white space in a notice varies
GATE = sorted({w for f in FORMS for w in f[1].split(" ")} | {t[1] for t in TEXTS})


def _rules() -> list[tuple[str, str, str, str, int]]:
    """(label, words of the form, words of the family, pattern, priority), in order; a match holds one of each."""
    out = []
    for _, kw, form, priority in FORMS:
        for label, own, name, spdx, url in FAMILIES:
            pattern = form.replace("N", f"(?:{name})".replace(" ", r"\s+")).replace("S", f"(?:{spdx})").replace("U", url)
            out.append((label, kw, own, pattern, priority + (2 if any(c.isdigit() for c in label) else 0)))
    return out + [(label, kw, kw, pattern, priority) for label, kw, pattern, priority in TEXTS]


def rules() -> list[tuple[str, str, str, str, int]]:
    """(label, keyword, second keyword, pattern, priority), in order; a keyword is empty where a match may hold one of several."""
    one = lambda words: "" if " " in words else words
    return [(label, one(kw), one(own), pattern, priority) for label, kw, own, pattern, priority in _rules()]


def _bind(value: Column, body):
    """body(value) with value computed once."""
    return F.transform(F.array(value), body)[0]


def _length_sum(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda a, p: a + F.length(p))


def _matches(chunk: Column, r: Column) -> Column:
    def spans(x: Column) -> Column:
        start = lambda i: _length_sum(F.slice(x["gaps"], 1, i + 1)) + _length_sum(F.slice(x["hits"], 1, i))
        return F.transform(x["hits"], lambda m, i: F.struct(start(i).alias("at"), (start(i) + F.length(m)).alias("end"), r["label"].alias("label"), r["priority"].alias("priority"), r["no"].alias("no")))

    found = F.struct(F.regexp_extract_all(chunk, r["pattern"], F.lit(0)).alias("hits"), F.call_function("split", chunk, r["pattern"], F.lit(-1)).alias("gaps"))
    return _bind(found, spans)


def _surviving(dets: Column) -> Column:
    def beats(e: Column, d: Column) -> Column:
        within = (e["at"] <= d["at"]) & (e["end"] >= d["end"])
        longer = (e["end"] - e["at"]) - (d["end"] - d["at"])
        return within & ((e["priority"] > d["priority"]) | ((e["priority"] == d["priority"]) & ((longer > 0) | ((longer == 0) & (e["no"] < d["no"])))))

    return _bind(dets, lambda all_: F.filter(all_, lambda d: ~F.exists(all_, lambda e: beats(e, d))))


def _has(text: Column, words: Column) -> Column:
    return F.exists(words, lambda w: F.contains(text, w))


def _table() -> Column:
    """The rules under the words of their form: array<struct<kw, rules>>."""
    words = lambda ws: F.array(*map(F.lit, ws.split(" ")))
    forms: dict[str, list[Column]] = {}
    for i, (a, b, c, d, e) in enumerate(_rules()):
        forms.setdefault(b, []).append(F.struct(F.lit(a).alias("label"), words(c).alias("kw"), F.lit(d).alias("pattern"), F.lit(e).alias("priority"), F.lit(i).alias("no")))
    return F.array(*[F.struct(words(b).alias("kw"), F.array(*rs).alias("rules")) for b, rs in forms.items()])


def detections(low: Column) -> Column:
    """array<struct<label, priority>> of the surviving detections of a lower-cased text."""
    table_ = _table()
    gate = lambda c: F.exists(F.array(*map(F.lit, GATE)), lambda k: F.contains(c, k))
    short = F.regexp_replace(F.regexp_replace(low, r"\s{9,}", " " * 8), r"(\d{8})\d+(\d{8})", "$1$2")

    def chunk(own: Column, a: Column, i: Column) -> Column:
        back = F.coalesce(F.right(F.get(own, i - 1), F.lit(BACK)), F.lit(""))
        ahead = F.coalesce(F.left(F.get(own, i + 1), F.lit(AHEAD)), F.lit(""))
        return F.struct(F.concat(back, a, ahead).alias("text"), F.length(back).alias("start"), (F.length(back) + F.length(a)).alias("stop"))

    pieces = F.regexp_extract_all(short, F.lit(rf"(?s).{{1,{CHUNK}}}"), F.lit(0))
    chunks = _bind(pieces, lambda own: F.filter(F.transform(own, lambda a, i: chunk(own, a, i)), lambda c: gate(c["text"])))
    some = lambda x: F.flatten(F.transform(F.filter(table_, lambda f: _has(x, f["kw"])), lambda f: F.filter(f["rules"], lambda r: _has(x, r["kw"]))))
    of_chunk = lambda c: F.filter(_surviving(F.flatten(F.transform(some(c["text"]), lambda r: _matches(c["text"], r)))), lambda d: (d["at"] >= c["start"]) & (d["at"] < c["stop"]))
    return F.transform(F.flatten(F.transform(chunks, of_chunk)), lambda d: F.struct(d["label"].alias("label"), d["priority"].alias("priority")))


def _places(words: Column, phrase: str) -> Column:
    """Starts of the phrase among words."""
    parts = phrase.split(" ")
    zipped = F.transform(F.arrays_zip(*[F.slice(words, i + 1, F.greatest(F.size(words) - i, F.lit(0))) for i in range(len(parts))]), lambda z, i: F.when(_all(z[str(k)] == w for k, w in enumerate(parts)), i))
    return F.filter(zipped, lambda i: i.isNotNull())


def _all(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    low = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER)
    df = docs.select("doc_id", low.alias("_low")).withColumn("n_words", F.regexp_count("_low", F.lit(NON_WORD.replace("[", "[^", 1))).cast("long"))
    gate = F.lit(False)
    for k in GATE:
        gate = gate | F.contains(F.col("_low"), F.lit(k))
    df = df.withColumn("_dets", F.when(gate, detections(F.col("_low"))))
    base_gate = F.contains("_low", F.lit("license")) | F.col("_low").rlike("cc" + NON_WORD + "by")
    words = F.filter(F.split("_low", NON_WORD), lambda w: w != "")
    df = df.withColumn("_base", F.when(base_gate, _bind(words, lambda ws: F.struct(*[_places(ws, p).alias(f"p{i}") for i, p in enumerate(PHRASES)]))))
    none = F.array().cast("array<int>")
    places = [F.coalesce(F.col(f"_base.p{i}"), none) for i in range(len(PHRASES))]
    every = F.concat(*places)
    base = F.filter(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for p, label in zip(places, PHRASES.values())]), lambda x: x.isNotNull())
    dets = F.coalesce(F.col("_dets"), F.array().cast("array<struct<label:string,priority:int>>"))
    best = F.coalesce(F.array_max(F.transform(dets, lambda d: d["priority"])), F.lit(0)) / 100.0
    return df.select(
        "doc_id", "n_words", F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"), F.array_max(every).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(base, F.transform(dets, lambda d: d["label"])))), ",").alias("labels"),
        F.greatest(best, F.when(F.size(every) > 0, 0.5).otherwise(0.0)).alias("score"),
    )


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))
