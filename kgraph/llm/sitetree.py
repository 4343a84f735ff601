"""Main-text extraction with a site style tree.

The pages of a host are merged into one tree whose nodes are paths of elements (tag, classes and id, digits folded); every
branch that holds text takes part, below an article as well. Over the pages of a host a node has two
distributions: of the child sequences it shows (presentation) and of the texts it holds (content). Their entropies,
divided by the largest possible, give its importance, 1 where fewer than `min_pages` pages show the node. A text that a
node holds on n of its m pages has the importance 1 - log n / log m (its own entropy over pages). Pages with equal
html count once, below an article those with equal article text, so that mirrors do not make an article look repeated.

On a page a branch weighs its importance times a prior that its markup gives: NAMED for elements that name themselves menu,
header, footer, sidebar, notice, advert, form or comments, LINKED for lists of links outside articles, 0 for hidden ones, else
1. Branches under `low` go, as do repeated texts under `low` (below an article: texts of more than half of at least
MIN_ARTICLES articles). An `article` or `main` element itself, and whatever holds all of a page's, is never removed by its
name or importance. A page that would be left empty keeps a branch that only its class names speak against, if the tree
holds it important and most of the page's text stands there.

Defined results: null or empty html gives an empty text; broken markup is read as far as it goes (unclosed tags end with
their parents, an unclosed comment or script runs to the end); repeated rows give repeated results; a null or odd url
counts as host ''; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kgraph.llm.common import materialise, slices, table, with_columns

LOW, MIN_PAGES, MIN_ARTICLES, PRESENTATION = 0.3, 4, 8, 0.1
NAMED, LINKED, SURE = 0.25, 0.3, 0.8
BROADCAST_ROWS = 200_000

RAW = {"script", "style", "textarea", "noscript", "template", "iframe", "title", "desc", "metadata", "xmp", "noembed", "noframes", "object", "canvas", "select", "option"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var "
    "math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover semantics svg g text tspan path circle rect line polygon polyline ellipse defs use".split()
)
CLOSED_BY_SAME = {"p", "li", "dt", "dd", "tr", "td", "th", "option"}
NOISE_TAGS = {"nav", "footer", "aside", "form", "button", "fieldset", "dialog", "menu", "head"}
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar"}
NOISE_NAMES = set(
    "ad ads adv advert adverts advertisement advertising adsense adbox sponsor sponsored promo promotion banner sidebar side menu nav navbar navigation breadcrumb "
    "breadcrumbs footer masthead cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription social share sharing "
    "related recommended comment comments commentlist disqus reply replies respond discussion widget toolbar login signup pagination pager skip".split()
)
_ATTR = re.compile(r"""([a-zA-Z_:][^\s=/>"']*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_TAG = re.compile(r"""<(?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+|(?=>)))*+>""")
_CLOSE = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_DIGITS = re.compile(r"\d+")
_NAME = re.compile(r"[^\s/>]+")
HIDDEN, BY_TAG, BY_NAME = 1, 2, 4


def _tag_end(s: str, at: int) -> int:
    """Where the tag that starts at `at` ends ('>'), quoted values respected; the first '>' if a quote never closes; -1 if nowhere."""
    m = _TAG.match(s, at)
    return m.end() - 1 if m else s.find(">", at)


class Node:
    """An element: its path, what its markup says against it, whether it is or stands in an article or main element."""

    __slots__ = ("path", "against", "kept", "main", "parent", "children")

    def __init__(self, path: str, against: int, kept: bool, main: bool, parent: int):
        self.path, self.against, self.kept, self.main, self.parent, self.children = path, against, kept, main, parent, []


def parse(source: str | None) -> tuple[list[tuple[str, int, bool]], list[Node]]:
    """(blocks, nodes): blocks are (text, index of its node, whether all of it stands in links); nodes[0] is the page."""
    s = source or ""
    nodes = [Node("", 0, False, False, -1)]
    stack: list[tuple[str, int]] = [("", 0)]
    blocks: list[tuple[str, int, bool]] = []
    text: list[str] = []
    links = plain = 0

    def flush():
        nonlocal plain
        if text:
            t = " ".join(_html.unescape("".join(text)).split())
            text.clear()
            if t:
                blocks.append((t, stack[-1][1], not plain))
        plain = 0

    at, n = 0, len(s)
    while at < n:
        lt = s.find("<", at)
        piece = s[at:] if lt < 0 else s[at:lt]
        if piece:
            text.append(piece)
            if not links and not piece.isspace():
                plain = 1
        if lt < 0:
            break
        c = s[lt + 1 : lt + 2]
        if c == "!" or c == "?":
            if s.startswith("<!--", lt):
                end = s.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            else:
                end = s.find(">", lt)
                at = n if end < 0 else end + 1
            continue
        closing = c == "/"
        m = _NAME.match(s, lt + 1 + closing)
        if not m or not m[0][0].isalpha():
            text.append("<")
            at = lt + 1
            continue
        end = _tag_end(s, lt)
        if end < 0:  # a tag that never ends holds no text
            break
        tag = m[0].lower()
        at = end + 1
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            continue
        if tag in VOID:
            text.append(" ")
            if tag == "hr":
                flush()
            continue
        if tag in RAW:
            if not closing and not s.endswith("/", lt, end):
                stop = _CLOSE[tag].search(s, at)
                gt = s.find(">", stop.end()) if stop else -1
                at = n if gt < 0 else gt + 1
            text.append(" ")
            continue
        flush()
        links = 0
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            continue
        if stack[-1][0] == "p" or stack[-1][0] == tag and tag in CLOSED_BY_SAME:
            stack.pop()
        attrs = {k.lower(): a or b or d for k, a, b, d in _ATTR.findall(s, m.end(), end)} if end > m.end() else {}
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}"
        role = attrs.get("role", "").lower()
        above = nodes[stack[-1][1]]
        key = tag + _DIGITS.sub("N", "".join(f".{x}" for x in sorted(names.split())))
        main = tag in ("article", "main") or role in ("main", "article")
        words = set(re.split(r"[^a-z]+", names.lower())) if names.strip() else ()
        against = HIDDEN if "hidden" in attrs else 0
        if not main:
            head = not above.kept
            against |= BY_TAG if tag in NOISE_TAGS or role in NOISE_ROLES or tag == "header" and head else 0
            against |= BY_NAME if NOISE_NAMES.intersection(words) or "header" in words and head else 0
        nodes.append(Node(f"{above.path}/{key}", against, above.kept or main, main, stack[-1][1]))
        above.children.append(key)
        if not s.endswith("/", lt, end):
            stack.append((tag, len(nodes) - 1))
    flush()
    return blocks, nodes


def hash_(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "surrogatepass")) - (1 << 63)


_PATHS: dict[str, int] = {}


def path_hash(path: str) -> int:
    """hash_ of a path, kept for the paths that recur."""
    got = _PATHS.get(path)
    if got is None:
        if len(_PATHS) > 100_000:
            _PATHS.clear()
        got = _PATHS[path] = hash_(path)
    return got


def _texts(blocks, nodes) -> dict[int, list[str]]:
    """The texts in each element that holds any, nodes[0] left out."""
    inside: dict[int, list[str]] = {}
    for t, i, _ in blocks:
        while i > 0:
            inside.setdefault(i, []).append(t)
            i = nodes[i].parent
    return inside


def sightings(source: str | None) -> set[tuple[int, int, int, int]]:
    """(path, kind, value, page) of every element that holds text: kind 0 has the child sequences, kind 1 the texts, page is what counts once."""
    blocks, nodes = parse(source)
    inside = _texts(blocks, nodes)
    page = hash_(source or "")
    articles: dict[int, int] = {}
    styles: dict[tuple[str, int], list[str]] = {}
    out = set()
    for i in sorted(inside):  # parents come first
        node = nodes[i]
        articles[i] = hash_("\n".join(inside[i])) if node.main and not nodes[node.parent].kept else articles.get(node.parent, page)
        of = articles[i] if node.kept else page
        styles.setdefault((node.path, of), []).append("/".join(node.children))
        out.add((path_hash(node.path), 1, hash_("\n".join(inside[i])), of))
    for (path, of), seen in styles.items():
        out.add((path_hash(path), 0, hash_("|".join(seen)), of))
    return out


def main_text(source: str | None, importance=None, repeated=None, low: float = LOW) -> str:
    """importance: of the host's (hashed) paths, 1 for others; repeated: n, m and importance of texts, by (path, text) hashed."""
    blocks, nodes = parse(source)
    importance, repeated = importance or {}, repeated or {}
    weights: list[float] = []
    mains: list[int] = [0] * len(nodes)  # article and main elements in each element
    links, held = [[0, 0] for _ in nodes], [0] * len(nodes)
    for i in range(len(nodes) - 1, 0, -1):
        mains[i] += nodes[i].main
        mains[nodes[i].parent] += mains[i]
    for t, i, linked in blocks:
        while i > 0:
            links[i][linked] += 1
            held[i] += len(t)
            i = nodes[i].parent
    tree = lambda i: importance.get(path_hash(nodes[i].path), 1.0)
    for i, node in enumerate(nodes):
        if i == 0:
            weights.append(1.0)
            continue
        if node.against & HIDDEN:
            w = 0.0
        elif mains[i] and mains[i] == mains[0]:
            w = 1.0
        else:
            w = 1.0 if node.main else tree(i)
            if node.against:
                w *= NAMED
            elif not node.kept and links[i][1] > 2 and not links[i][0]:
                w *= LINKED
        weights.append(w)

    def again(node, t):
        x = repeated.get((path_hash(node.path), hash_(t)))
        return x is not None and (2 * x["n"] > x["m"] >= MIN_ARTICLES if node.kept else x["importance"] < low)

    def left(weights):
        gone = [False] * len(nodes)
        for i in range(1, len(nodes)):
            gone[i] = gone[nodes[i].parent] or weights[i] < low
        stay = [(t, i) for t, i, _ in blocks if not gone[i]]
        rest = [t for t, i in stay if not (repeated and again(nodes[i], t))]
        return rest or [t for t, _ in stay]

    out = left(weights)
    if not out and blocks:
        total = sum(len(t) for t, _, _ in blocks)
        for i, node in enumerate(nodes):
            if node.against == BY_NAME and 2 * held[i] > total and path_hash(node.path) in importance and tree(i) >= SURE:
                return "\n".join(left([1.0 if j == i else w for j, w in enumerate(weights)]))
    return "\n".join(out)


def host_of():
    return F.coalesce(F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def style_tree(pages: DataFrame) -> DataFrame:
    """host, path, kind, value, n, m, importance: per node (kind 0, value null) and per text found on several pages (kind 1); paths and texts are hashed."""

    def run(batches):
        for piece in slices(batches):
            rows = [(host, *x) for host, source in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()) for x in sightings(source)]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["host", "path", "kind", "value", "page"])

    seen = pages.select(host_of().alias("host"), "html").mapInArrow(run, "host string, path long, kind int, value long, page long").distinct()
    counts = materialise(seen.groupBy("host", "path", "kind", "value").agg(F.count(F.lit(1)).alias("n")), "tree")
    sums = counts.groupBy("host", "path", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s"))
    entropy = F.when(F.col("m") > 1, 1 - F.col("s") / (F.col("m") * F.log("m"))).otherwise(1.0)
    weighted = entropy * F.when(F.col("kind") == 0, PRESENTATION).otherwise(1 - PRESENTATION)
    shown = F.max(F.when(F.col("kind") == 0, F.col("m")))
    nodes = sums.withColumn("w", weighted).groupBy("host", "path").agg(shown.alias("m"), F.sum("w").alias("importance"))
    texts = counts.where(f"kind = 1 AND n >= {MIN_PAGES}").join(nodes.select("host", "path", "m"), ["host", "path"])
    own = 1 - F.log("n") / F.log(F.greatest("m", "n", F.lit(2)))
    texts = texts.select("host", "path", "kind", "value", "n", "m", own.alias("importance"))
    none = F.lit(None).cast("long")
    return nodes.select("host", "path", F.lit(0).alias("kind"), none.alias("value"), none.alias("n"), "m", "importance").unionByName(texts)


def extract_main(pages: DataFrame, low: float = LOW, min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars."""
    tree = style_tree(pages).where(F.col("m") >= min_pages)
    tree = materialise(tree.where(f"kind = 0 AND importance < 1 OR kind = 1 AND (importance < {low} OR 2 * n > m)"), "noise")
    node, text = F.struct("path", F.col("importance").cast("float").alias("importance")), F.struct("path", "value", "n", "m", "importance")
    per_host = tree.groupBy("host").agg(F.collect_list(F.when(F.col("kind") == 0, node)).alias("_nodes"), F.collect_list(F.when(F.col("kind") == 1, text)).alias("_texts"))  # of one site's templates
    if tree.count() <= BROADCAST_ROWS:
        per_host = F.broadcast(per_host)
    df = pages.select("page_id", "url", "html", host_of().alias("_host")).join(per_host.withColumnRenamed("host", "_host"), "_host", "left")
    df = df.select("page_id", "url", F.struct("html", "_host", "_nodes", "_texts").alias("_page"))

    def compute():
        hosts: dict[str, tuple] = {}

        def known(row):
            if row["_host"] not in hosts:
                if len(hosts) > 200:
                    hosts.clear()
                hosts[row["_host"]] = ({x["path"]: x["importance"] for x in row["_nodes"] or ()}, {(x["path"], x["value"]): x for x in row["_texts"] or ()})
            return hosts[row["_host"]]

        def run(rows):
            texts = [main_text(r["html"], *known(r), low) for r in rows]
            return texts, [len(t) for t in texts]

        return run

    return with_columns(df, "_page", "text string, n_chars long", compute)


def op8_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main(table(spark, sf_dir, "pages"))
