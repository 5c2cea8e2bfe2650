"""Main-text extraction with site style trees (operator 5).

Pages of a host are merged into one style tree, kept as rows and never in one task:
a node is a path of tags with class names, a style is the set of its children's
keys, and a feature is the text of a block.  Counts of styles and features over a
host's distinct pages give each node's importance: the entropy of its presentation
styles, and for content one less the entropy of its features (text that stands on
every page has importance 0).  A node's ancestors sum up what is below it.  What few
pages of a host say is filled up by the tree of all hosts, in the weight of PRIOR
pages, so small hosts need no rule of their own.

A page loses the branches whose importance is under their bar:

- neutral nodes, a share (LEAST) of the importance of the article or body around them:
  what repeats among text that doesn't.  Copies of an article lower both alike.
- nodes with words that may mark adverts, notices, shares or related pages: a
  high bar, lower where the word is only a part of a class or stands in an id.
- nodes (and loose text) outside of a page's article or main elements: the highest bar.
  Frames and adverts look alike on all pages, whatever they say, so they stay below it.
  Pages with and without such elements are trees of their own.

Elements and, outside of an article, words that by themselves say what isn't the
article go without asking (menus, headers, footers, asides, forms, reader comments,
scripts, styles).  Within an article such words only set a bar: the low one for words
that articles speak of (menu, search), the high one for all others.

Class words mark a node if a whole class is such a word or begins or ends with one,
unless it says what a page has (has-sidebar, no-banner).  Paragraphs, headings and
tables of an article are never gone without asking, nor do ids of headings count.
Words never mark html, body, main and article, nor a node that holds main; nodes that
hold an article only if the class is the word itself or names what has articles of its
own (comments, related).  A form that holds a page's parts (main, article, headings,
menus) isn't dropped.  Where words of a page's frame and forms would take all text but
noise, importance alone decides; what words call comments or notices never comes back,
so a page with nothing else has no text.

Controls within a paragraph (button, select, canvas) are left out and don't end its block.
A node knows its DEEP nearest ancestors and where they go on; sums over all that is below
a node take one step, and one more for each doubling of the depth beyond DEEP.  So a
page's outline takes time and memory in proportion to its length, at any depth.  A quote
that is never closed ends with its tag.

Null, empty and broken pages give what text they have, an empty string if none.
Pages without a host count as a host of their own name, ''.  Repeated pages count
once for importance, and each gets its row.  Only page_id, url and html are read.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_dir, table

LEAST, DECAY, PRIOR, UNKNOWN, DEEP = 0.3, 0.9, 8, 0.9, 32
#: Importance under which a node goes whose words may mark noise (1: a part of a class or an id, 2: a whole class), or that stands outside of the article (3).
BARS = {1: 0.6, 2: 0.97, 3: 0.99}
#: Elements by how they are treated.
DROPPED = set("aside button canvas datalist dialog embed footer head iframe input menu nav noscript object optgroup option script select style svg template textarea title".split())
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg"}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
SPACE_INLINE = {"br", "img", "wbr"}
CONTROLS = {"button", "canvas", "datalist", "select"}
MAIN = {"article", "main"}
NEVER, HEADINGS = {"html", "body", *MAIN}, {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that show that a form around them is a page's frame.
PARTS = {*MAIN, "header", "nav", "footer", "h1", "h2"}
CLOSED_BY_BLOCK = {"p"}
TEXT = set("p h1 h2 h3 h4 h5 h6 pre blockquote table figure dl ul ol".split())
#: Words in class, id and role that mark what isn't an article's text.
HINTS = set(
    "sidebar sidenav sidebars nav navbar navigation menu menubar breadcrumb breadcrumbs topbar"
    " cookie cookies consent gdpr newsletter subscribe subscription signup login search searchbox"
    " comment comments commentlist reply replies respond disqus pagination pager footer contentinfo complementary colophon hidden".split()
)
#: Those of HINTS that an article may well speak of.
TOPICS = set("menu navigation search login subscription consent complementary".split())
FRAMES = HINTS - TOPICS
#: Those of HINTS that mark reader comments and notices rather than a page's frame.
VOICES = set("cookie cookies consent gdpr newsletter subscribe subscription signup login comment comments commentlist reply replies respond disqus hidden".split())
#: Words that may mark adverts, and others that may mark what isn't an article's text.
ADVERTS = set("ad ads adsense advert adverts advertisement advertisements adbox adslot sponsor sponsored promo promoted promotion".split())
WEIGHED = ADVERTS | set("banner rail widget widgets notice notices notification alert popup modal overlay share sharing social follow related recommended recommendations trending skip toolbar disclaimer copyright".split())
#: Words that mark the frame of a page, but not of an article.
OUTER_HINTS = {"header", "masthead", "head", "top", "bottom", "side", "legal", "tags", "tag", "form"}
#: Words for what holds articles of its own, and words that tell what a page has or hasn't.
LISTS = set("comment comments commentlist reply replies respond disqus related recommended recommendations trending promoted sponsored".split())
STATES = set("has have no not non with without is show hide open opened closed enabled disabled off none js supports uses using".split())
ARTICLE = re.compile(r"<(?:article|main)[\s>]", re.I)
TAG, STOP = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?/])"), re.compile(r">|=\s*([\"'])")
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _strength(names: list[str], hints: set[str], lists: set[str] = LISTS) -> int:
    """Whether class words mark a node: 2 if one is a hint itself or begins or ends with one of ``lists``, 1 if with another hint."""
    found = 0
    for name in names:
        if name.lower() in hints:
            return 2
        if parts := [w.lower() for w in WORDS.findall(name)]:
            ends = {parts[0], parts[-1]} & hints
            if ends and not STATES & set(parts):
                found = max(found, 2 if len(parts) == 1 or ends & lists else 1)
    return found


def _traits(tag: str, rest: str, main: bool) -> tuple[str, bool, int, int, int, bool]:
    """A node's key; whether it is hidden; how its words say that it isn't content, anywhere and outside of an article; its bar; whether they are of comments and notices."""
    if "=" not in rest and "hidden" not in rest:
        return tag, False, 0, 0, -1 if tag in NEVER else 0, False
    found = {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(rest)}
    names, ids = found.get("class", "").split(), found.get("id", "").split()
    hidden = "hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    key = ".".join([tag, *(re.sub(r"[0-9]{3,}", "N", n) for n in (names + ids)[:2])])
    if tag in NEVER:
        return key, hidden and tag in MAIN, 0, 0, -1, False
    ids = [] if tag in HEADINGS else ids
    names += found.get("role", "").split()
    lists = set() if main and tag in TEXT else LISTS  # a paragraph, list or table of the article
    certain, by_id = _strength(names, HINTS, lists), _strength(ids, HINTS, set())
    voice = bool(_strength(names, VOICES, lists) or _strength(ids, VOICES, set()))
    bar = max(_strength(names, WEIGHED, lists | ADVERTS), _strength(ids, WEIGHED, set()))
    if main and (tag in TEXT or by_id < 2):  # no word is enough in such, nor in a slug
        bar, by_id = max(bar, by_id), 0
    if main:  # the tree decides; words that articles speak of set a low bar
        plain = tag not in TEXT and max(_strength(names, FRAMES, lists), 2 * (_strength(ids, FRAMES, set()) == 2))
        said = 2 if plain else certain if tag in TEXT else min(certain, 1)
        bar, certain, by_id = max(bar, said), 0, 0
    return f"{key}!{bar}" if bar else key, hidden, max(certain, by_id), _strength(names + ids, OUTER_HINTS), bar, voice


class _Mark:
    """A node that words (strength 1 or 2) or being a form (0) say isn't content, until what it holds says otherwise."""

    __slots__ = ("up", "strength", "style", "voice", "stands", "seen", "gone")

    def __init__(self, up: _Mark | None, strength: int, style: Style | None, voice: bool = False):
        self.up, self.strength, self.style, self.voice, self.stands, self.seen, self.gone = up, strength, style, voice, True, set(), None

    def holds(self, tag: str) -> None:
        mark = self
        while mark is not None and tag not in mark.seen:  # who saw it told all above
            mark.seen.add(tag)
            if tag == "main" or (tag == "article" and mark.strength < 2) or (mark.strength == 0 and tag in PARTS):
                mark.stands = False
                if mark.style is not None:
                    mark.style.bar = 0
            mark = mark.up


@dataclass
class Style:
    """What a page shows of one node: the nearest nodes above and itself, the node above these, the one that is its article or body, its bar and its children's keys."""

    ups: tuple[int, ...]
    more: int | None
    root: int
    bar: int
    keys: set[str] = field(default_factory=set)

    def child(self, node: int, root: int, bar: int) -> Style:
        full = len(self.ups) == DEEP
        return Style((*self.ups[full:], node), self.ups[0] if full else None, root, bar)

    @property
    def up(self) -> int | None:
        return self.ups[-2] if len(self.ups) > 1 else None


class _Open:
    __slots__ = ("tag", "node", "off", "mark", "main")

    def __init__(self, tag: str, node: int, off: bool, mark: _Mark | None, main: bool):
        self.tag, self.node, self.off, self.mark, self.main = tag, node, off, mark, main


def _child(node: int, key: str) -> int:
    return xxhash.xxh64_intdigest(key.encode("utf-8", "surrogatepass"), node & (1 << 64) - 1) - (1 << 63)


def _tag_end(html: str, at: int) -> int:
    """Where the tag ends whose attributes begin at ``at``."""
    while m := STOP.search(html, at):
        if not m[1]:
            return m.end()
        close = html.find(m[1], m.end())
        if close < 0:  # never closed
            close = html.find(">", m.end())
            return close + 1 if close >= 0 else len(html)
        at = close + 1
    return len(html)


def outline(html: str) -> tuple[list[tuple[int, int, bool, str]], dict[int, Style]]:
    """Blocks (node, dropped by 1: words of a frame or forms, 2: words of comments and notices, tag or hidden, within an article, text) in page order, and each node's style."""
    blocks: list[tuple[int, bool, _Mark | None, bool, str]] = []
    base = int(ARTICLE.search(html) is not None)
    styles: dict[int, Style] = {base: Style((), None, 0, -1)}
    stack, parts, at, n = [_Open("", base, False, None, False)], [], 0, len(html)
    places, solid = defaultdict(list), [0]  # where in the stack a tag is open, and where elements that aren't inline
    inside, unclosed = set(), set()

    def flush() -> None:
        if parts:
            text = "".join(parts)
            text = " ".join((unescape(text) if "&" in text else text).split())
            parts.clear()
            if text:
                top, node = stack[-1], stack[-1].node
                if base and not top.main:  # loose text beside an article is a node of its own
                    own, node = styles[node], _child(node, "#text")
                    if node not in styles:
                        styles[node] = own.child(node, own.root or node, max(own.bar, 0))
                blocks.append((node, top.off, top.mark, top.main, text))

    def shut(k: int) -> None:
        for x in stack[k:]:
            places[x.tag].pop()
        del stack[k:]
        while solid[-1] >= k:
            solid.pop()

    for m in iter(lambda: TAG.search(html, at), None):
        if m.start() > at:
            parts.append(html[at : m.start()])
        if m[1]:
            at = html.find("-->", m.end()) + 3
            at = at if at > 2 else n
            continue
        at = _tag_end(html, m.end()) if m[3] else html.find(">", m.end()) + 1 or n
        if m[3] is None:
            continue
        tag, rest = m[3].lower(), html[m.end() : at - 1]
        if not m[2]:
            if tag in INLINE and "=" not in rest:
                continue
            if tag in VOID:
                if tag in SPACE_INLINE:
                    parts.append(" ")
                elif tag == "hr":
                    flush()
                continue
            if tag in RAW:
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = end.end() if end else n
                continue
            if tag in CONTROLS and tag not in unclosed:
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                if end:
                    at = end.end()
                    continue
                unclosed.add(tag)
            inline, up = tag in INLINE, stack[-1]
            key, hidden, words, outer, bar, voice = _traits(tag, rest, up.main)
            if inline and not (hidden or words or bar):
                continue
            flush()
            if not inline:
                for same in ("p", tag if tag in ("li", "dt", "dd", "tr", "td", "th") else None):
                    if same and stack[solid[-1]].tag == same:
                        shut(solid[-1])
            up = stack[-1]
            off = up.off or hidden or tag in DROPPED or (tag == "header" and not up.main)
            if tag in PARTS and up.mark is not None:
                up.mark.holds(tag)
            main = up.main or (tag in MAIN and not off and not _marked(up.mark))
            own, node = styles[up.node], _child(up.node, key)
            own.keys.add(key)
            if node not in styles:
                styles[node] = own.child(node, node if not own.root or tag == "body" or (tag in MAIN and main) else own.root, bar)
            own = styles[node]
            if main:
                inside.add(node)
            words = max(words, 0 if up.main else outer)
            mark = _Mark(up.mark, words, None, voice) if words else _Mark(up.mark, 0, None) if tag == "form" else _Mark(up.mark, bar, own) if bar > 0 else up.mark
            if bar > 0 and not words and tag != "form":
                mark.stands = False  # the tree decides
            places[tag].append(len(stack))
            if not inline:
                solid.append(len(stack))
            stack.append(_Open(tag, node, off, mark, main))
            if rest.endswith("/"):
                shut(len(stack) - 1)
        elif places[tag] and (tag not in INLINE or places[tag][-1] > solid[-1]):
            flush()
            shut(places[tag][-1])
    if at < n:
        parts.append(html[at:])
    flush()
    del styles[base]
    if inside:
        kept: set[int] = set()
        for node in inside:
            while node is not None and node not in kept:
                kept.add(node)
                node = styles[node].up
        for node, style in styles.items():
            if node not in kept:
                style.bar = 3
    return [(node, 2 if off else _gone(mark), main, text) for node, off, mark, main, text in blocks], styles


def _marked(mark: _Mark | None) -> bool:
    """Whether words say of ``mark`` or one above it that it isn't content, or may not be."""
    while mark is not None:
        if mark.stands or (mark.style is not None and mark.style.bar > 0):
            return True
        mark = mark.up
    return False


def _gone(mark: _Mark | None) -> int:
    """Whether ``mark`` or one above it stands; 2 if that speaks of comments or notices."""
    chain = []
    while mark is not None and mark.gone is None:
        chain.append(mark)
        mark = mark.up
    found = mark.gone if mark is not None else 0
    for one in reversed(chain):
        found = one.gone = max(found, (1 + one.voice) * one.stands)
    return found


def main_text(html: str | None, noise: set[int] | None) -> str:
    """The text of a page without its noise nodes; None: nodes of which no site is known go by what the whole class says."""
    blocks, styles = outline(html or "")
    if noise is None:
        noise = {node for node, style in styles.items() if UNKNOWN < BARS.get(style.bar, 0.0)}
    noisy: set[int] = set()
    for node, style in styles.items():  # a node stands after those above it
        if node in noise or style.up in noisy:
            noisy.add(node)
    for most in (1, 2):
        if some := [b[3] for b in blocks if b[1] < most and b[0] not in noisy]:
            return "\n\n".join(some)
    return ""


def host(url: Column | str) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def _mark(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def observed(pages: DataFrame) -> DataFrame:
    """host, page (a digest of html), node, kind (0: style, 1: feature), mark, and for styles ups, more, root, bar: what each page shows of its site's style tree."""
    types = {"host": pa.string(), "page": pa.int64(), "node": pa.int64(), "kind": pa.int32(), "mark": pa.int64(), "ups": pa.list_(pa.int64()), "more": pa.int64(), "root": pa.int64(), "bar": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part, rows = batch.slice(low, 200), []
                for site, html in zip(part.column("host").to_pylist(), part.column("html"), strict=True):
                    text = html.as_py() or ""
                    page, (blocks, styles) = _mark(text), outline(text)
                    rows += [(site, page, node, 0, _mark(" ".join(sorted(style.keys))), style.ups, style.more, style.root, style.bar) for node, style in styles.items()]
                    rows += [(site, page, node, 1, mark, None, None, None, None) for node, mark in {(node, _mark(re.sub(r"[0-9]+", "0", words).lower())) for node, _, _, words in blocks if node in styles}]
                made = [list(x) for x in zip(*rows, strict=True)] or [[]] * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, types.values(), strict=True)], names=list(types))

    return pages.select(host("url").alias("host"), "html").mapInArrow(run, "host string, page long, node long, kind int, mark long, ups array<long>, more long, root long, bar int")


def _weighed(counts: DataFrame, by: list[str]) -> DataFrame:
    """``by``, node, pages, importance, root, bar from counts ``n`` of styles and features; one tree for each value of ``by``."""
    log = F.col("n") * F.log("n")
    nodes = counts.groupBy(*by, "node").agg(
        F.sum(F.when(F.col("kind") == 0, F.col("n"))).alias("pages"),
        F.coalesce(F.sum(F.when(F.col("kind") == 0, log)), F.lit(0.0)).alias("style_log"),
        F.coalesce(F.sum(F.when(F.col("kind") == 1, F.col("n"))), F.lit(0)).alias("features"),
        F.coalesce(F.sum(F.when(F.col("kind") == 1, log)), F.lit(0.0)).alias("feature_log"),
        F.max("ups").alias("ups"), F.max("more").alias("more"), F.max("root").alias("root"), F.min("bar").alias("bar"),
    )
    nodes = cut(nodes)  # used for nodes and for what is below them
    m = F.greatest(F.col("pages"), F.lit(1))
    shown = F.when(m > 1, 1 - F.col("style_log") / (m * F.log(m))).otherwise(1.0)
    repeated = F.when(m > 1, F.col("feature_log") / F.log(m)).otherwise(0.0)
    ups = F.transform("ups", lambda up, i: F.struct(up.alias("up"), (F.size("ups") - i).alias("levels")))
    # what each node shows of its own goes to itself and to its ancestors
    below = nodes.select(*by, "features", repeated.alias("repeated"), F.inline(ups)).groupBy(*by, "up").agg(F.sum("features").alias("all"), F.sum("repeated").alias("known"), F.max("levels").alias("height"))
    below = _deeper(below, nodes.filter("more is not null").select(*by, F.col("node").alias("up"), "more"), by)
    both = nodes.select(*by, F.col("node").alias("up"), "pages", shown.alias("shown"), "root", "bar").join(below, [*by, "up"])
    content = F.when(F.col("all") > 0, 1 - F.col("known") / F.col("all")).otherwise(1.0)
    weight = F.pow(F.lit(DECAY), F.col("height"))
    return both.select(*by, F.col("up").alias("node"), "pages", ((1 - weight) * F.col("shown") + weight * content).alias("importance"), "root", "bar")


def _deeper(below: DataFrame, jumps: DataFrame, by: list[str]) -> DataFrame:
    """``below`` (by, up, all, known, height of the DEEP levels from each node on) over all levels; ``jumps`` leads DEEP levels up.

    Each step doubles the levels that sums span and jumps pass, so there are as many as the
    depth has doublings beyond DEEP: none where no page is that deep.
    """
    levels, jumps = DEEP, cut(jumps)
    while not jumps.isEmpty():
        below = cut(below)
        found = below.join(jumps, [*by, "up"]).groupBy(*by, F.col("more").alias("up")).agg(F.sum("all").alias("all2"), F.sum("known").alias("known2"), (F.max("height") + levels).alias("height2"))
        zero = F.lit(0)
        below = below.join(found, [*by, "up"], "left").select(*by, "up", (F.col("all") + F.coalesce("all2", zero)).alias("all"), (F.col("known") + F.coalesce("known2", zero)).alias("known"), F.greatest("height", "height2").alias("height"))
        jumps = cut(jumps.join(jumps.select(*by, F.col("up").alias("more"), F.col("more").alias("most")), [*by, "more"]).select(*by, "up", F.col("most").alias("more")))
        levels *= 2
    return below


def importance(pages: DataFrame) -> DataFrame:
    """host, node, pages, importance, root, bar for every node of each host's style tree, filled up by that of all hosts."""
    seen = observed(pages).distinct()
    counts = cut(seen.groupBy("host", "node", "kind", "mark").agg(F.count("*").alias("n"), F.max("ups").alias("ups"), F.max("more").alias("more"), F.max("root").alias("root"), F.min("bar").alias("bar")))
    every = counts.groupBy("node", "kind", "mark").agg(F.sum("n").alias("n"), F.max("ups").alias("ups"), F.max("more").alias("more"), F.max("root").alias("root"), F.min("bar").alias("bar"))
    own = _weighed(counts, ["host"])
    known = _weighed(every, []).select("node", ((F.col("pages") * F.col("importance") + PRIOR * UNKNOWN) / (F.col("pages") + PRIOR)).alias("known"))
    filled = (F.col("pages") * F.col("importance") + PRIOR * F.col("known")) / (F.col("pages") + PRIOR)
    return own.join(known, "node").select("host", "node", "pages", filled.alias("importance"), "root", "bar")


def noise(pages: DataFrame, least: float = LEAST) -> DataFrame:
    """host, node for every node whose importance is under its bar."""
    found = cut(importance(pages))
    around = found.select("host", F.col("node").alias("root"), (least * F.col("importance")).alias("least"))
    bar = F.when(F.col("bar") == 0, F.when(F.col("node") != F.col("root"), F.col("least")))
    for kind, value in BARS.items():
        bar = bar.when(F.col("bar") == kind, value)
    return found.join(around, ["host", "root"]).filter(F.col("importance") < bar).select("host", "node")


def extract(pages: DataFrame, least: float = LEAST, tree: bool = True) -> DataFrame:
    """page_id, url, text, n_chars for every row of ``pages`` (page_id, url, html); without ``tree`` words and tags alone decide, to compare."""
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", "html", host("url").alias("host"))
    if tree:
        place = f"{shared_dir(spark)}/style-noise-{uuid.uuid4().hex}"
        noise(pages, least).groupBy("host").agg(F.array_sort(F.collect_set("node")).alias("noise")).write.parquet(place)
        rows = rows.join(spark.read.parquet(place), "host", "left")
    else:
        rows = rows.withColumn("noise", F.lit(None).cast("array<long>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                texts = [main_text(html.as_py(), set(nodes.as_py() or ())) for html, nodes in zip(part.column("html"), part.column("noise"), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return rows.drop("host").mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
