"""Main text of web pages by a site style tree.

The DOMs of a host's pages are merged into one tree. An element's style is its tag, classes and id (digits made alike),
and its place is the path of styles from the root; elements of every kind count, menus and footers as much as articles.
A place has, from all pages that hold it, their number m, its looks (sequences of child styles, text being a child) and
its texts (what a page has there outside of child elements). With logarithms to base m:

* presentation importance of a place is the entropy of its looks: a place that always looks the same has 0;
* content importance is one minus the mean, over its distinct texts, of the entropy of how a text spreads over pages
  (the logarithm of the pages it is on): texts of one page only give 1, a text that is on all pages gives 0;
* composite importance of a place E with l looks is (1 - g^l) * presentation(E) + g^l * (the mean over looks, weighted by
  their frequency, of the mean over a look's children of their composite importance; a text child has its content
  importance). g is GAMMA. A place of one page only has importance 1, since nothing is known about it.

A branch is noise if no place of it is important enough, and the blocks in it are removed. How much is enough depends on
where a block stands (THRESHOLDS): outside of the article of a page that has one, almost any repetition tells; in a page
without an article more is needed; within an article only what is nearly the same everywhere goes. If nothing else of a
page would remain, its noise stays. Importance counts at places that MIN_PAGES pages of a host hold; captures of a host
with the very same text count as one page.

What the tree leaves, a page's own declarations decide: elements that are no content by their tag, role or class names
(menus, headers, footers, sidebars, notices, adverts, forms, comments), and blocks outside of a page's ``article`` or
``main``. So hosts with few pages, on which a tree has nothing to say, and reader comments, which never repeat, are served
too. A class or id counts only as a whole (each of its words must be of that kind or neutral, so "with-sidebar" and
"entry-header" say nothing), never against an article or main that it is around, and within an article not against
sections and headings. If class names leave a page without any block (a container named after its sidebar, say), they
don't count on it. n_noise and n_declared say how many blocks went by the tree and by declarations alone.

Plan. One pass parses pages (a task holds a few) and writes their places, as hashes, to the shared folder; another keeps
blocks. Statistics are sums by host and place, pre-aggregated before the shuffle, so a host with a third of all pages is
no hot task, and a host's tree is never gathered: importance is a sum over descendants, weighted by the product of the
shares on the way down, and a place is sent to its ancestors, of which it has at most MAX_DEPTH. Only noise places return
to pages, by a join that adaptive execution can split.

Odd rows: a null or empty html has an empty text; a null url counts to a host without a name, whose pages are not
merged; pages are told apart by a hash of all they hold, so repeated ids keep their own texts and repeated rows stay;
malformed markup is read as a browser would nearly read it (open elements end where they must); elements deeper than
MAX_DEPTH belong to their ancestor at that depth, with all their text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftline.llm.shared import measured_broadcast, written

#: Blocks at places less important than this are noise: outside of a page's article, in a page without one, inside one.
THRESHOLDS = {"outside": 0.9, "alone": 0.5, "inside": 0.2}
GAMMA = 0.99
MIN_PAGES = 4
MAX_DEPTH = 200

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?][^>]*+>""", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
_ATTR = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
#: Elements that end an open one of the given tags when they start.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}), "option": ({"option"}, {"select"})}
#: No content by their tag, by their ARIA role, or by a word of their class or id.
NO_CONTENT = {"nav", "header", "footer", "aside", "form", "button", "select", "input", "label", "dialog", "menu", "search", "head", "svg", "canvas", "audio", "video", "object", "math", "datalist", "fieldset", *RAW}
NO_CONTENT_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "menu", "menubar", "form"}
NO_CONTENT_WORD = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside", "notice", "cookie", "cookies", "consent", "gdpr", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "login", "share", "sharing", "social", "comment", "comments", "disqus", "replies", "related", "recommended", "widget", "pagination", "pager", "toolbar", "copyright", "disclaimer", "hidden", "announcement", "discussion", "responses", "reply", "respond", "teaser", "teasers", "sponsors", "topbar"}
#: Words that change nothing about a class or id that else consists of words of NO_CONTENT_WORD.
NEUTRAL_WORD = {"area", "bar", "block", "body", "bottom", "box", "container", "inner", "item", "items", "left", "link", "links", "list", "right", "site", "slot", "top", "unit", "wrap", "wrapper"}
#: Within an article a class or id word says nothing about these: it may be their subject.
SUBJECT = {"section", "h1", "h2", "h3", "h4", "h5", "h6"}
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in RAW}


def _no_content(tag: str, attrs: dict[str, str], named_too: bool, in_article: bool) -> int:
    """2: no content by tag, role or attribute; 1: by the words of a whole class or id; 0: neither."""
    if tag in NO_CONTENT or attrs.get("role", "").lower() in NO_CONTENT_ROLE or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return 2
    if not named_too or tag in ("html", "body", "main") or (in_article and tag in SUBJECT):
        return 0
    for token in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = set(_WORDS.findall(_CAMEL.sub(" ", token).lower())) - NEUTRAL_WORD
        if words and words <= NO_CONTENT_WORD:
            return 1
    return 0


class Page:
    """What parsing gives: places by their path, blocks, and whether the page has an article.

    A place is [path, look, texts]: paths are tuples of styles, a look is the list of its child styles, equal neighbours
    once, with TEXT for text. A block is (path, text, said, inside): said is what the page declares about it (2: no content
    by tag, role or attribute, 1: by class names, 0: nothing), inside tells that it is in an article or main.
    """

    def __init__(self, html: str, named_too: bool):
        self.looks: dict[tuple, list[str]] = {}
        self.texts: dict[tuple, list[str]] = {}
        self.blocks: list[tuple[tuple, str, int, bool]] = []
        self.article = False
        _read(self, html, named_too)

    def undeclared(self) -> bool:
        return any(not said and (inside or not self.article) for _, _, said, inside in self.blocks)


TEXT = "#"


def parse(html: str) -> Page:
    """Places and blocks of a page; if class names leave nothing of it, then without regard to class names."""
    page = Page(html, True)
    return page if page.undeclared() or not html else Page(html, False)


def main_blocks(page: Page) -> list[str]:
    """The texts that a page's own declarations leave."""
    return [text for _, text, said, inside in page.blocks if not said and (inside or not page.article)]


def _read(page: Page, html: str, named_too: bool) -> None:
    # open elements: tag, path, said, in article, style of the last child, whether it is where a block of `aside` begins
    root = ["", (), 0, False, "", False]
    stack: list[list] = [root]
    texts: list[str] = []  # of the innermost open block element
    aside: list[str] = []  # within what is declared no content
    owner = aside_owner = root
    at, end = 0, len(html)
    looks, all_texts = page.looks, page.texts
    looks[()] = []

    def block(of: list, parts: list[str]) -> None:
        text = _SPACE.sub(" ", unescape("".join(parts))).strip()
        if text:
            page.blocks.append((of[1], text, of[2], of[3]))

    def flush() -> None:
        nonlocal texts, aside
        if aside:
            block(aside_owner, aside)
            aside = []
        if texts:
            block(owner, texts)
            texts = []

    def close(depth: int) -> None:
        nonlocal owner, aside, aside_owner
        for e in reversed(stack[depth:]):
            if e[0] in BLOCK:
                flush()
            elif e is aside_owner and aside:
                block(e, aside)
                aside = []
        del stack[depth:]
        owner = next(e for e in reversed(stack) if e[0] in BLOCK or not e[0])
        aside_owner = next((e for e in reversed(stack) if e[5]), root)

    def text_of(part: str) -> None:
        top = stack[-1]
        (aside if top[2] else texts).append(part)
        if not part.isspace():
            if top[4] != TEXT:
                top[4] = TEXT
                looks[top[1]].append(TEXT)
            all_texts.setdefault(top[1], []).append(part)

    while at < end:
        lt = html.find("<", at)
        if lt < 0:
            lt = end
        if lt > at:
            text_of(html[at:lt])
            at = lt
            continue
        m = _TAG.match(html, at) or _LOOSE.match(html, at)
        if not m:
            text_of("<")
            at += 1
            continue
        at = m.end()
        if not m.lastindex or not m.group(2):
            continue
        tag = m.group(2).lower()
        if m.group(1):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    close(i)
                    break
            continue
        if tag in BLOCK:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == "p":
                    close(i)
                    break
                if stack[i][0] in ("button", "table", "td", "th"):
                    break
        if tag in ENDS:
            same, within = ENDS[tag]
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in same:
                    close(i)
                    break
                if stack[i][0] in within:
                    break
        raw = m.group(3)
        up = stack[-1]
        if tag in VOID:
            if tag == "br":
                (aside if up[2] else texts).append(" ")
            elif tag == "hr":
                flush()
            if up[4] != tag:
                up[4] = tag
                looks[up[1]].append(tag)
            continue
        attrs = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(raw)} if "=" in raw else {}
        if "hidden" in raw.split():
            attrs["hidden"] = ""
        style = tag
        if attrs.get("class") or attrs.get("id"):
            style += _DIGITS.sub("N", "." + ".".join(sorted(attrs.get("class", "").split())) + "#" + attrs.get("id", ""))
        outermost = tag in ("article", "main") and not up[3]
        over = 0 if outermost and up[2] == 1 else up[2]  # names of what is around it don't count
        said = max(over, _no_content(tag, attrs, named_too, up[3]))
        path = up[1] if len(up[1]) >= MAX_DEPTH else (*up[1], style)
        e = [tag, path, said, up[3] or outermost, "", bool(said) and (tag in BLOCK or not up[2])]
        if path is not up[1]:
            if up[4] != style:
                up[4] = style
                looks[up[1]].append(style)
            looks.setdefault(path, [])
        if e[3] and not said:
            page.article = True
        if tag in BLOCK:
            flush()
            owner = e
        if tag in RAW:
            closes = _RAW_END[tag].search(html, at)
            at = closes.start() if closes else end
        stack.append(e)
        if e[5]:
            aside_owner = e
        if raw.endswith("/") and tag in ("svg", "path"):
            close(len(stack) - 1)
    close(1)
    flush()


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


_PLACE = "path:long,up:array<long>,look:long,kinds:int,share:double,words:long"
_BLOCK = "place:int,text:string,said:byte,inside:boolean"


def _rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    """row, page_id, url, html: equal rows have equal hashes, and nulls are no empty texts."""
    known = [F.col(id_col).isNull(), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(url_col).isNull(), F.coalesce(F.col(url_col), F.lit("")), F.col(html_col).isNull(), F.coalesce(F.col(html_col), F.lit(""))]
    return pages.select(F.xxhash64(*known).alias("row"), F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))


class _Hashes:
    """Path hashes of a worker: a path's is made of its parent's and its style; the most common ones are remembered."""

    def __init__(self):
        self.known: dict[tuple, tuple[int, ...]] = {(): ()}

    def chain(self, path: tuple) -> tuple[int, ...]:
        """The hashes of a path's ancestors from the top, its own last."""
        got = self.known.get(path)
        if got is None:
            if len(self.known) > 50_000:
                self.known = {(): ()}
            above = self.chain(path[:-1])
            got = self.known[path] = (*above, _hash(f"{above[-1] if above else 0}/{path[-1]}"))
        return got


def _hash(text: str) -> int:
    from xxhash import xxh3_64_intdigest

    return int.from_bytes(xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")).to_bytes(8, "little"), "little", signed=True)


def _places(page: Page, hashes: _Hashes) -> list[dict]:
    """Records of a page's places. Elements that can't have content (VOID) are part of a look, but no kind of child."""
    out = []
    for path, look in page.looks.items():
        if path:
            chain = hashes.chain(path)
            words = page.texts.get(path)
            out.append({"path": chain[-1], "up": chain[:-1], "look": _hash("|".join(look)), "kinds": len(set(look) - VOID), "share": 1 / len(set(page.looks[path[:-1]]) - VOID), "words": _hash("\n".join(words)) if words else None})
    return out


def site_places(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """row, site (a hash of the host; null without one), digest (of the page's text) and places of every page.

    A place has its path, the paths above it, its look, how many kinds of children it has, what share of its parent's
    kinds it is, and a hash of its own text (null: none).
    """
    place = pa.struct([("path", pa.int64()), ("up", pa.list_(pa.int64())), ("look", pa.int64()), ("kinds", pa.int32()), ("share", pa.float64()), ("words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                hosts = [host_of(u) for u in some.column(1).to_pylist()]
                done = [parse(h or "") for h in some.column(2).to_pylist()]
                digests = [_hash("\n".join(b[1] for b in d.blocks)) for d in done]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([_hash(h) if h else None for h in hosts], type=pa.int64()), pa.array(digests, type=pa.int64()), pa.array([_places(d, hashes) for d in done], type=pa.list_(place))], names=["row", "site", "digest", "places"])

    rows = _rows(pages, id_col, url_col, html_col).select("row", "url", "html")
    return rows.mapInArrow(run, f"row long, site long, digest long, places array<struct<{_PLACE}>>")


def page_blocks(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """row, page_id, url, article (the page has one) and blocks (index of the place as in site_places, text, said, inside).

    Parsing again costs less than keeping: the text of pages is never written but for the one shuffle that brings a page
    and its noise places together.
    """
    kind = pages.schema[id_col].dataType.simpleString()
    block = pa.struct([("place", pa.int32()), ("text", pa.string()), ("said", pa.int8()), ("inside", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                some = batch.slice(start, 256)
                articles, blocks = [], []
                for html in some.column(3).to_pylist():
                    page = parse(html or "")
                    index = {path: i for i, path in enumerate(p for p in page.looks if p)}
                    articles.append(page.article)
                    blocks.append([{"place": index.get(path, -1), "text": text, "said": said, "inside": inside} for path, text, said, inside in page.blocks])
                yield pa.RecordBatch.from_arrays([*some.columns[:3], pa.array(articles, type=pa.bool_()), pa.array(blocks, type=pa.list_(block))], names=["row", "page_id", "url", "article", "blocks"])

    return _rows(pages, id_col, url_col, html_col).mapInArrow(run, f"row long, page_id {kind}, url string, article boolean, blocks array<struct<{_BLOCK}>>")


def importance(site: DataFrame) -> DataFrame:
    """site, path, pages, presentation, content, importance (composite) and peak (the most important place of the branch).

    `site` is what site_places gives; pages without a host take no part.
    """
    once = site.where("site IS NOT NULL").groupBy("site", "digest").agg(F.first("places").alias("places"))
    spots = once.select("site", F.explode("places").alias("p")).select("site", "p.*")
    place = ["site", "path"]
    told = F.when(F.col("words").isNotNull(), 1 / F.col("kinds")).otherwise(0.0)
    looks = spots.groupBy(*place, "look").agg(F.count("*").alias("n"), F.sum("share").alias("share"), F.sum(told).alias("told"), F.first("up").alias("up"))
    looks = looks.groupBy(*place).agg(F.sum("n").alias("m"), F.count("*").alias("l"), F.sum(F.col("n") * F.ln("n")).alias("nlogn"), F.sum("share").alias("share"), F.sum("told").alias("told"), F.first("up").alias("up"))
    texts = spots.where("words IS NOT NULL").groupBy(*place, "words").agg(F.count("*").alias("n")).groupBy(*place).agg(F.avg(F.ln("n")).alias("spread"))
    many = F.col("m") > 1
    nodes = looks.join(texts, place, "left").select(
        *place, "up", "m", "share",
        F.when(many, 1 - F.col("nlogn") / (F.col("m") * F.ln("m"))).otherwise(1.0).alias("presentation"),
        F.when(many, 1 - F.col("spread") / F.ln("m")).when(F.col("spread").isNotNull(), 1.0).alias("content"),
        F.pow(F.lit(GAMMA), F.col("l")).alias("inner"),
        (F.col("told") / F.col("m")).alias("told"),
    )
    nodes = written(nodes, "nodes")
    own = F.when(F.col("m") > 1, (1 - F.col("inner")) * F.col("presentation") + F.col("inner") * F.col("told") * F.coalesce("content", F.lit(0.0))).otherwise(1.0)
    # What a child adds to its parent: the parent's inner weight times the mean share of the parent's children that it is.
    # A place of one page only is important as such, whatever is below it.
    step = F.when(F.col("m") > 1, F.col("inner") / F.col("m")).otherwise(0.0)
    parents = nodes.select("site", F.col("path").alias("above"), step.alias("step"), F.col("share").alias("up_share"))
    chain = nodes.select(*place, "share", own.alias("own"), F.posexplode_outer("up").alias("at", "above"))
    weights = chain.join(measured_broadcast(parents), ["site", "above"], "left")
    way = F.sort_array(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "above", "step", "up_share"))))
    ways = weights.groupBy(*place).agg(F.first("own").alias("own"), F.first("share").alias("share"), way.alias("way"))
    # What a place weighs for each ancestor, from its parent up: the steps and shares on the way multiplied.
    depth = F.size("way")
    below = F.expr("aggregate(reverse(way), struct(cast(array() as array<struct<above:bigint,weight:double>>) AS got, share AS w), (acc, x) -> struct(concat(acc.got, array(struct(x.above AS above, acc.w * x.step AS weight))) AS got, acc.w * x.step * x.up_share AS w)).got")
    reach = ways.select(*place, "own", F.when(depth > 0, below).otherwise(F.array().cast("array<struct<above:bigint,weight:double>>")).alias("reach"))
    sent = reach.select("site", "own", F.explode(F.concat(F.array(F.struct(F.col("path").alias("above"), F.lit(1.0).alias("weight"))), "reach")).alias("r"))
    composite = sent.groupBy("site", F.col("r.above").alias("path")).agg(F.sum(F.col("own") * F.col("r.weight")).alias("importance"))
    scored = written(nodes.join(composite, place).select(*place, "up", F.col("m").alias("pages"), "presentation", "content", "importance"), "importance")
    best = F.greatest("importance", F.coalesce("content", F.lit(0.0)))  # a text is a node of its own
    peaks = scored.select("site", F.explode(F.concat("up", F.array("path"))).alias("path"), best.alias("best")).groupBy(*place).agg(F.max("best").alias("peak"))
    return scored.drop("up").join(peaks, place)


def _judged(gone: Column) -> Column:
    """Each block's text, whether it is noise by the tree, and whether the page declares it no content."""

    def noise(b: Column) -> Column:
        least = F.when(b["inside"], THRESHOLDS["inside"]).when(F.col("article"), THRESHOLDS["outside"]).otherwise(THRESHOLDS["alone"])
        return F.exists(gone, lambda g: (g["place"] == b["place"]) & (g["peak"] < least))

    def declared(b: Column) -> Column:
        return (b["said"] > 0) | (F.col("article") & ~b["inside"])

    return F.transform("blocks", lambda b: F.struct(b["text"].alias("text"), noise(b).alias("noise"), declared(b).alias("declared")))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks, n_noise (removed by the tree), n_declared (by declarations alone) for every page."""
    site = written(site_places(pages, id_col, url_col, html_col), "places")
    low = importance(site).where((F.col("pages") >= min_pages) & (F.col("peak") < max(THRESHOLDS.values()))).select("site", "path", "peak")
    low = written(low, "noise")
    spots = site.where("site IS NOT NULL").select("row", "site", F.posexplode("places.path").alias("place", "path"))
    gone = spots.join(measured_broadcast(low), ["site", "path"]).groupBy("row").agg(F.collect_set(F.struct("place", "peak")).alias("gone"))
    whole = page_blocks(pages, id_col, url_col, html_col)
    joined = whole.join(gone, "row", "left").withColumn("judged", _judged(F.coalesce("gone", F.array().cast("array<struct<place:int,peak:double>>"))))
    left = F.filter("judged", lambda b: ~b["noise"] & ~b["declared"])
    undeclared = F.filter("judged", lambda b: ~b["declared"])
    none = F.size(left) == 0
    out = joined.select(
        "page_id", "url",
        F.array_join(F.transform(F.when(none, undeclared).otherwise(left), lambda b: b["text"]), "\n").alias("text"),
        F.size("judged").cast("long").alias("n_blocks"),
        F.size(F.filter("judged", lambda b: b["noise"] & (~none | b["declared"]))).cast("long").alias("n_noise"),
        F.size(F.filter("judged", lambda b: b["declared"] & ~b["noise"])).cast("long").alias("n_declared"),
    )
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), "n_blocks", "n_noise", "n_declared")
