import hashlib
import random
import re

from pyspark.sql import functions as F

from kgraph.llm import licenses, sitetree, warc
from tests.llm.fixtures import documents, empty, texts
from tests.oracle import connect, rows

D = "/root/testdata/sf0.001"
PAGE = "page_id long, url string, html string, text string, digest string"


def pages(spark):
    big = "<p>" + "long text " * 2000
    r = [(1, "http://a/x", None), (2, None, ""), (3, "u\r\nv%", "short"), (4, "h", "short"), (9, "h", big), (5, "h", big), (7, "h", big), (None, "h", big), (5, "h", big), (8, "h", "é" * 50), (10, "h", "é" * 50)]
    return spark.createDataFrame([(*x, "t", "d") for x in r], PAGE)


def test_warc_against_sql(spark):
    got, want = warc.op4_warc(spark, D).toPandas(), connect(D).sql(warc.ORACLE).df()
    assert rows(got) == rows(want)


def test_warc_round_trip(spark, tmp_path):
    p = pages(spark)
    warc.write_archive(p, str(tmp_path / "w"))
    got = warc.read_archive(spark, str(tmp_path / "w")).collect()
    assert len(got) == p.count() and all(r["record_type"] for r in got)
    html = {r["page_id"]: (r["html"] or "").encode() for r in p.collect()}
    for r in got:
        assert r["payload_digest"] == hashlib.sha256(html[r["page_id"]]).hexdigest() and r["payload_bytes"] == len(html[r["page_id"]])
        assert (r["payload"] is None) == (r["record_type"] == "revisit") and (r["payload"] is None or bytes(r["payload"]) == html[r["page_id"]])
    kinds = {(r["page_id"], r["record_type"], r["refers_to"]) for r in got}
    assert {(9, "revisit", 5), (7, "revisit", 5), (None, "revisit", 5), (5, "response", None), (10, "revisit", 8), (4, "response", None)} <= kinds
    assert {r["url"] for r in got if r["page_id"] in (2, 3)} == {None, "u\r\nv%"}
    warc.write_archive(p.limit(0), str(tmp_path / "e"))
    assert warc.read_archive(spark, str(tmp_path / "e")).count() == 0


def record(i, body):
    return warc.record_bytes(i, "http://x", body, hashlib.sha256(body).hexdigest(), None)


def read(data):
    found, gaps = [], []
    for at, r in warc.salvage(data):
        (gaps.append((at, *r)) if isinstance(r, tuple) else found.append(r["page_id"]))
    return found, gaps


def test_salvage_goes_on_after_damage():
    rng = random.Random(2)
    bodies = [bytes(rng.randrange(256) for _ in range(400)) for _ in range(6)]
    for packed in (True, False):
        parts = [warc.members(record(i, b))[0] if packed else record(i, b) for i, b in enumerate(bodies)]
        assert read(b"".join(parts)) == (list(range(6)), [])
        start = [sum(map(len, parts[:i])) for i in range(7)]
        flipped = bytearray(b"".join(parts))
        flipped[start[2] + len(parts[2]) // 2] ^= 0xFF
        found, gaps = read(bytes(flipped))
        assert found == [0, 1, 3, 4, 5] and [(a, b) for a, b, _ in gaps] == [(start[2], start[3])]
        junk = b"".join(parts[:2]) + b"junk WARC/1.1 junk \x1f\x8b\x08 junk" + b"".join(parts[2:])
        found, gaps = read(junk)
        assert found == list(range(6)) and sum(b - a for a, b, _ in gaps) == len(junk) - start[6]
        cut = b"".join(parts)[:-20]
        found, gaps = read(cut)
        assert found == list(range(5)) and gaps[0][:2] == (start[5], len(cut))
        dropped = b"".join(parts)[: start[1] + 30] + b"".join(parts)[start[3] :]
        found, gaps = read(dropped)
        assert found == [0, 3, 4, 5] and len(gaps) == 1
    assert read(b"") == ([], []) and read(b"nothing") == ([], [(0, 7, "cut off")])


def test_a_record_over_several_members(monkeypatch):
    monkeypatch.setattr(warc, "MEMBER_BYTES", 150)
    body = b"z" * 1000
    ms = warc.members(record(1, body))
    assert len(ms) > 3 and all(m[-1] == 0 for m in ms)
    assert read(b"".join(ms) + b"".join(warc.members(record(2, b"q")))) == ([1, 2], [])


def test_salvage_inside_a_member():
    """Records before and after a damaged one in the same member are kept, also where the member's end is damaged."""
    parts = [record(i, b"x" * 150 + bytes([65 + i])) for i in range(5)]
    whole = warc._gzip(b"".join([parts[0], parts[1], parts[2].replace(b"xxx", b"xyx", 1), parts[3], parts[4]]))
    assert read(whole) == ([0, 1, 3, 4], [(0, len(whole), "digest differs")])
    late = bytearray(warc._gzip(b"".join(parts)))
    late[-6] ^= 1
    found, gaps = read(bytes(late))
    assert found == [0, 1, 2, 3, 4] and [g[:2] for g in gaps] == [(0, len(late))]
    long_url = warc.record_bytes(7, "http://x/" + "y" * 3_000_000, b"body", hashlib.sha256(b"body").hexdigest(), None)
    assert read(b"".join(warc.members(long_url))) == ([7], [])


def test_salvage_is_linear():
    import os
    import time

    body = os.urandom(12_000).hex().encode()
    one = warc.members(record(1, body))[0]
    took = []
    for n in (400, 1600):
        start = time.process_time()
        assert sum(1 for _ in warc.salvage(one * n)) == n
        took.append(time.process_time() - start)
    assert took[1] < 10 * took[0]


def test_large_ids_survive_the_archive(spark, tmp_path):
    big = (1 << 53) + 1
    same = "<p>" + "text " * 100
    p = spark.createDataFrame([(big, "u", same), (big + 2, "v", same), (None, "w", "x")], "page_id long, url string, html string")
    warc.write_archive(p, str(tmp_path / "w"))
    got = {(r["page_id"], r["refers_to"]) for r in warc.read_archive(spark, str(tmp_path / "w")).collect()}
    assert got == {(big, None), (big + 2, big), (None, None)}


def brute_base(text):
    low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        places += hits
        if hits:
            labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def brute_labels(text):
    low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
    found = set()
    for no, (label, kw, kw2, pattern, priority) in enumerate(licenses.rules()):
        if kw in low and kw2 in low:
            found |= {(m.start(), m.end(), label, priority, no) for m in re.finditer(pattern, low, re.A)}

    def beaten(d):
        return any(e[0] <= d[0] and e[1] >= d[1] and (e[3] > d[3] or e[3] == d[3] and (e[1] - e[0] > d[1] - d[0] or e[1] - e[0] == d[1] - d[0] and e[4] < d[4])) for e in found)

    return {d[2] for d in found if not beaten(d)}


NOTICES = [
    "Licensed under the Apache License, Version 2.0.", "SPDX-License-Identifier: GPL-2.0-or-later", "https://www.gnu.org/licenses/gpl-3.0.html", "This work is licensed under the GNU General Public License, version 3.",
    "Released under the MIT License.", "Licensed under CC BY-NC 4.0.", "license: BSD-3-Clause", "Permission is hereby granted, free of charge, to any person", "All rights reserved.", "mit license mit license", "MIT--license; cc\tby",
    "subject to the terms of the Mozilla Public License, v. 2.0", "copy of the GNU Lesser General Public License version 2.1", "éMIT License mit éLicense", "nothing here", "under the 2-clause BSD license",
]


def test_licences_are_brute_forces(spark):
    more = [r["text"] for r in spark.read.parquet(f"{D}/documents.parquet").select("text").collect()]
    cases = [*texts(), *NOTICES, " ".join(NOTICES), *more]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(cases)], "doc_id long, text string, labels string")
    for r in licenses.scan_licenses(df).collect():
        t = cases[r["doc_id"]]
        n, places, first, last, base = brute_base(t)
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (n, places, first, last, base), t
        if len(t or "") <= licenses.CHUNK:
            assert set(filter(None, r["labels"].split(","))) == brute_labels(t) | set(filter(None, base.split(","))), t
        assert 0 <= r["score"] <= 1
    assert licenses.scan_licenses(empty(spark)).count() == 0
    assert len(licenses.rules()) > 250


def brute_detections(text):
    """Labels and best priority by every pattern over the whole text, without any keyword."""
    low = re.sub(r"[A-Z]", lambda m: m[0].lower(), text)
    found = [(m.start(), m.end(), label, priority, no) for no, (label, _, _, pattern, priority) in enumerate(licenses.rules()) for m in re.finditer(pattern, low, re.A)]
    beats = lambda e, d: e[0] <= d[0] and e[1] >= d[1] and (e[3], e[1] - e[0], -e[4]) > (d[3], d[1] - d[0], -d[4])
    left = [d for d in found if not any(beats(e, d) for e in found)]
    return {d[2] for d in left}, max((d[3] for d in left), default=0) / 100


def holds_brute_detections(spark, cases):
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, text string")
    for r in licenses.scan_licenses(df).collect():
        labels, score = brute_detections(cases[r["doc_id"]])
        base = set(filter(None, r["base_labels"].split(",")))
        assert set(filter(None, r["labels"].split(","))) == labels | base, cases[r["doc_id"]][:300]
        assert r["score"] == max(score, 0.5 if base else 0.0)


def test_licence_rules_run_without_their_usual_words(spark):
    cases = [
        "Released under the Expat License.", "the expat license", "Licensed under Creative Commons Attribution", "under a Creative Commons Zero license", "https://creativecommons.org/publicdomain/zero/1.0/",
        "distributed under the Common Development and Distribution License", "made available under the Open Database License", "http://www.eclipse.org/legal/epl-v10.html", "this file is covered by the MPL 2.0 here",
        "subject to the Expat", "governed by the terms of the General Public License", "https://scripts.sil.org/OFL", "https://www.gnu.org/licenses/fdl.html", "SPDX-License-Identifier: Python-2.0",
    ]
    assert all(brute_detections(c)[0] for c in cases)
    holds_brute_detections(spark, cases)


def test_wrapped_licence_notices(spark):
    plain = ["Released under the GPL version 3", "All rights reserved", "dedicated to the public domain", "a copy of the MPL 2.0", "subject to the MPL 2.0", "covered by the GPL", "governed by the GPL", "This program is free software; you can redistribute it"]
    cases = [t.replace(" ", blank) for t in plain for blank in ("\n", "  ", "\r\n\t")]
    assert all(brute_detections(c)[0] for c in cases)
    holds_brute_detections(spark, cases)


def test_no_licence_match_is_longer_than_a_chunk_looks_ahead():
    from re import _parser

    for *_, pattern, _ in licenses.rules():
        bounded = re.sub(r"\\s[+*]", r"\\s{1,8}", pattern.replace(r"[-\s+", "[-x")).replace(r"\d+", r"\d{1,16}")
        assert _parser.parse(bounded).getwidth()[1] <= licenses.AHEAD < licenses.BACK // 2 + 1, pattern


def test_licences_at_every_cut_offset(spark):
    notice = "submit license\nlicensed under the new bsd license and\n" + "released under" + " \n" * 400 + "the GPL version 3, All rights\nreserved"
    lead, tail = len("submit license licensed under the new bsd license "), " filler words" * 60
    cases = ["x " * ((licenses.CHUNK - k) // 2) + "y" * (k % 2) + " " + notice + tail for k in range(-4, lead + 40)]
    cases += ["word " * 398 + "z" * k + " licensed" + "\n" * 900 + "under the MIT license" + tail for k in range(10)]
    cases += ["word " * 390 + "z" * k + " https://docs.python.org/3." + "1" * 500 + "/license" + tail for k in range(0, 40, 4)]
    holds_brute_detections(spark, cases)
    clean = ["x" * (licenses.CHUNK - k - 1) + " submit license under review" + tail for k in range(-2, 12)]
    assert all(not brute_detections(c)[0] for c in clean)
    holds_brute_detections(spark, clean)


def test_licences_in_a_very_long_text(spark):
    t = "filler words " * 300 + "Licensed under the Apache License, Version 2.0. " + "more words " * 3000 + "MIT License"
    r = licenses.scan_licenses(spark.createDataFrame([(1, t)], "doc_id long, text string")).first()
    assert r["labels"] == "apache,apache-2.0,mit" and (r["n_base"], r["first_word"]) == (2, 603)


def test_main_text():
    html = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><!-- c --><nav><ul><li>Menu</ul></nav>
    <header>Top</header><div class="cookie-notice">We use cookies</div><article><h1>A &amp; B</h1><p>One <b>two<br>three<p>Four&nbsp;five <a href="x>y">six</a></article>
    <section id="comments"><p>First!</p></section><form><p>Mail</p></form><aside>Side</aside><footer>Foot</footer>"""
    assert sitetree.main_text(html) == "A & B\nOne two three\nFour five six"
    for broken in (None, "", "<", "a < b", "<p", "<!-- open", "<script>x", "<p>x</p></div></p>", "<div class='ad'><p>x</div>y"):
        assert isinstance(sitetree.main_text(broken), str)
    assert sitetree.main_text("a < b") == "a < b" and sitetree.main_text("<div class='ad'><p>x</div>y") == "y"


def test_tags_of_any_length_end_outside_their_quotes():
    for n in (10, 19_990, 30_000, 2_000_000):
        for value in ('"' + "<b>x" * (n // 4) + '"', "'" + '{"a": ">"} ' * (n // 11) + "'"):
            assert sitetree.main_text(f"<div data-x={value} id=a><p class='b' >Text</p></div>") == "Text"
    assert sitetree.main_text('<p title="never closed>one</p><p>two') == "one\ntwo"
    assert sitetree.main_text("<p>a</p>" + '<p x="1"y>b</p>' * 3 + "<p title=it's>c</p><p>it's</p>") == "a\nb\nb\nb\nc\nit's"


def test_branches_that_repeat_on_a_site_go(spark):
    rows_ = [(i, f"http://site/{i}", f"<body><div class='x{i}'><p>Welcome to our site</p></div><div class=body><p>Story {i} is about thing {i * i}</p></div></body>") for i in range(8)]
    rows_.append((99, "http://alone/", "<body><div><p>Welcome to our site</p></div></body>"))
    df = spark.createDataFrame([(*r, "t", 1) for r in rows_], "page_id long, url string, html string, text string, n_chars int")
    got = {r["page_id"]: r["text"] for r in sitetree.extract_main(df).collect()}
    assert got[3] == "Story 3 is about thing 9" and got[99] == "Welcome to our site"
    same = spark.createDataFrame([(i, "http://m/", "<article><p>mirrored</p></article>") for i in range(9)], "page_id long, url string, html string")
    assert {r["text"] for r in sitetree.extract_main(same).collect()} == {"mirrored"}
    edge = [(1, None, None), (2, "not a url", ""), (2, "not a url", ""), (3, "http://h", "<p>" + "w " * 50_000)]
    out = sitetree.extract_main(spark.createDataFrame(edge, "page_id long, url string, html string")).collect()
    assert len(out) == 4 and max(r["n_chars"] for r in out) == 99_999
    assert sitetree.extract_main(df.limit(0)).count() == 0


def site(i, rng):
    """A page whose classes say nothing: a menu of links, a notice, a story, an article class that holds words of the lists."""
    story = " ".join(rng.choice("oak elm ash fir yew bay fig nut".split()) + str(rng.randrange(1000)) for _ in range(30))
    menu = "".join(f"<li><a href=/{rng.randrange(99)}>Go {rng.randrange(9)}</a></li>" for _ in range(5))
    html = f"<body><div class=qa><ul>{menu}</ul></div><div class=qb>Please note our rules. They are the same on each page.</div><div class=qc><article class='promo side share'><h1>Head {i}</h1><p>{story}</p><p>Write to us any time you like.</p></article></div><div class=qd>Made by hand</div></body>"
    return html, f"Head {i}\n{story}"


def test_the_tree_decides_without_names(spark):
    rng = random.Random(3)
    made = [site(i, rng) for i in range(30)]
    df = spark.createDataFrame([(i, "http://site/x", h) for i, (h, _) in enumerate(made)], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in sitetree.extract_main(df).collect()}
    assert got == {i: t for i, (_, t) in enumerate(made)}
    alone = sitetree.main_text(made[0][0])
    assert "Made by hand" in alone and "Go " in alone and "Write to us" in alone  # what markup alone would keep


def test_importance_is_brute_forces(spark):
    import math
    from collections import Counter, defaultdict

    rng = random.Random(8)
    pages_ = [site(i // 2, rng)[0] for i in range(12)]
    seen = {x for h in pages_ for x in sitetree.sightings(h)}
    values = defaultdict(Counter)
    for path, kind, value, page in seen:
        values[path, kind][value] += 1
    entropy = lambda c: 1.0 if sum(c.values()) < 2 else -sum(n / sum(c.values()) * math.log(n / sum(c.values())) for n in c.values()) / math.log(sum(c.values()))
    want = {p: sitetree.PRESENTATION * entropy(values[p, 0]) + (1 - sitetree.PRESENTATION) * entropy(values[p, 1]) for p, kind in values if kind == 1}
    df = spark.createDataFrame([(i, "http://s/", h) for i, h in enumerate(pages_)], "page_id long, url string, html string")
    got = {r["path"]: r["importance"] for r in sitetree.style_tree(df).where("kind = 0").collect()}
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)


def test_markup_that_hides_or_holds_text():
    m = sitetree.main_text
    assert m("<article>\u0130 <SCRIPT>x</SCRIPT> tail</article>") == "\u0130 tail"
    assert m("<p>a</p><p hidden>b</p><p hidden=until-found>c</p><p data-hidden=1>d</p>") == "a\nd"
    assert m("<article><p>Sum <math><mi>x</mi><mo>+</mo><mn>1</mn></math> and <svg><title>t</title><text>label</text></svg></p></article>") == "Sum x+1 and label"
    assert m("<div class=sidebar-layout><main><p>Text</p></main><nav>Menu</nav></div>") == "Text"


def test_large_page_ids_stay_exact(spark):
    big = (1 << 53) + 1
    df = spark.createDataFrame([(big, "http://h/", "<p>a"), (None, None, None)], "page_id long, url string, html string")
    assert {(r["page_id"], r["text"]) for r in sitetree.extract_main(df).collect()} == {(big, "a"), (None, "")}
