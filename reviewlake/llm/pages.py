"""HTML extraction (6): a site style tree weighs the branches of all pages of a host.

1. Each page is cut into blocks with their element paths (tags with their classes).
   Known presentation elements (menus, footers, forms, scripts ...) are noise on any
   page.  Class and id words (advert, sidebar, comments ...) mark a block element as
   noise unless it holds an article, the main element or most of the text, as a
   wrapper does.
2. The pages of a host are merged path by path.  A leaf path is worth the entropy of
   its contents over the pages that have it: text that is the same on every page
   carries nothing.  An element path is worth the entropy of its presentations (the
   sequence of its children).  A branch's importance mixes both, mostly content.
   Pages, not hosts, are the rows that are added up, with map-side sums.
3. Branches of low importance on enough pages are removed from each page.

The main text is what is left of the page's articles (unless they are teasers, with less
than half of the text of the main element), else of its main element, else of its body.  A branch is never removed if that would leave nothing, or if it is a
heading or paragraph of an article: pages of a host may well share one article.

Low branches (one row per host that has any) are broadcast if their measured size
allows it, otherwise they are joined to the pages by host.

Defined cases: null and empty pages have empty text; a null url is a host of its
own; unclosed and misnested elements are closed as browsers do; a tag cut off by the
end of the page is dropped; repeated rows are pages of their own; further columns
are ignored.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake import store
from reviewlake.llm.common import same, table

#: Elements that start a block of their own.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is not markup.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg".split())
#: Elements that are noise wherever they stand.
NOISE = frozenset("nav footer aside form script style noscript template iframe svg button select textarea dialog menu head search object canvas".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
#: Words of class and id values that mark noise.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot sponsor sponsored sponsors promo promos promoted promotion banner cookie "
    "cookies consent gdpr notice notices notification notifications newsletter subscribe subscription signup popup modal overlay lightbox sidebar "
    "sidebars widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs pagination pager footer comment comments commentlist "
    "respond disqus reply replies share sharing social related recommended recommendations teaser teasers login toolbar alert alerts skip".split())
#: First words of class values that say what a layout has or lacks.
MODIFIERS = frozenset("has have no not with without is hide hides show shows".split())
#: Noise outside an article, part of the article inside one.
OUTER = frozenset(["header", "masthead"])
#: Words of an article that is none.
COMMENTS = frozenset("comment comments reply teaser related promo sponsored ad".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote".split())
#: An open element of the second kind ends where one of the first starts.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "tbody": {"tbody", "thead", "tr", "td", "th"}, "tfoot": {"tbody", "thead", "tr", "td", "th"}, "option": {"option"}}
#: Ends of inner elements do not close these.
WALLS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "tfoot": {"table"}, "option": set()}

PIECE = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z](?>"[^"]*"|'[^']*'|[^'">])*+>|</?[a-zA-Z][^>]*(?:>|\Z)|[^<]+|<""", re.S)
#: What ends a raw element; comments of a script may hold a whole inner script.
CLOSE = {tag: re.compile(rf"</{tag}(?=[\t\n\f\r />])", re.I) for tag in RAW}
SCRIPT = re.compile(r"<!--(?!-?>)|-->|</?script(?=[\t\n\f\r />])", re.I)
NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
ATTRIBUTE = re.compile(r"""\b(class|id|role|style|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?(?=[\s/>])""", re.I)

#: Share of presentation in the importance of a branch; importance of noise; pages that a verdict needs.
PRESENTATION, LOW, MIN_PAGES = 0.1, 0.3, 4
#: A low branch inside an article goes only if it alone holds less than this share of its text.
MINOR = 0.3
#: A marked element with more than this share of the page's text is a wrapper; articles with less than
#: this share of the text of a main element are teasers inside it.
MOST, TEASERS = 0.5, 0.5
LOW_BYTES = 16 << 20


class Block:
    __slots__ = ("path", "tag", "text", "zone", "mark")

    def __init__(self, path, tag, text, zone, mark):
        self.path, self.tag, self.text, self.zone, self.mark = path, tag, text, zone, mark


class Open:
    """An open element; ``block`` is the nearest block element around its text, itself included."""

    __slots__ = ("tag", "path", "noise", "zone", "mark", "block")

    def __init__(self, tag, path, noise, zone, mark, block):
        self.tag, self.path, self.noise, self.zone, self.mark, self.block = tag, path, noise, zone, mark, block or self


def key(text: str, path: int = 0) -> int:
    """Signed 64-bit name of a path's next step, or of a content."""
    return xxhash.xxh64_intdigest(text.encode(), path & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def marked(tag: str, attributes: dict[str, str], zone: int) -> bool:
    """Whether class and id of a block element speak for noise.

    Outside an article any word of a value does (``cookie-notice``, ``left_sidebar``);
    inside one all words of it must, and headings and paragraphs are never marked.
    """
    if tag not in BLOCKS or tag in ("html", "body", "main") or zone == 2 and tag in HEADINGS:
        return False
    for value in (attributes.get("class", "") + " " + attributes.get("id", "")).split():
        words = [w for w in re.split("[^a-z0-9]+", value) if w]
        if not words or len(words) > 1 and words[0] in MODIFIERS:
            continue
        if (all if zone == 2 else any)(w in MARKS for w in words) or zone < 2 and not OUTER.isdisjoint(words):
            return True
    return False


def raw_end(page: str, start: int, tag: str) -> int:
    """Where the content of a raw element that begins at ``start`` ends: its end tag or the end of the page."""
    comment = inner = False
    for m in (SCRIPT if tag == "script" else CLOSE[tag]).finditer(page, start):
        piece = m[0].lower()
        if piece == "<!--":
            comment = True
        elif piece == "-->":
            comment = inner = False
        elif piece[1] != "/":
            inner = comment
        elif inner:
            inner = False
        else:
            return m.start()
    return len(page)


def cut(page: str | None) -> tuple[list[Block], dict[int, list[str]], dict[int, int]]:
    """Blocks that are no known noise, in order, the children of each element path, and the parent of each path.

    Paths are rolling hashes and open tags are counted, so time and memory are linear in
    the page, however deep it is.
    """
    blocks: list[Block] = []
    children: dict[int, list[str]] = {}
    parents: dict[int, int] = {}
    marks: list[list] = [[-1, 0, False]]  # of each marked element: the one around it, text, holds an article or main
    stack = [Open("", 0, False, 0, 0, None)]  # zone: 2 article, 1 main, 0 other
    count: dict[str, int] = {}
    parts: list[str] = []
    page, pos = page or "", 0

    def flush():
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            at = stack[-1].block
            if text and not at.noise:
                blocks.append(Block(at.path, at.tag, text, at.zone, at.mark))
                marks[at.mark][1] += len(text)

    def close(upto):
        for x in stack[upto:]:
            count[x.tag] -= 1
        del stack[upto:]

    def innermost(tag):
        return next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag) if count.get(tag) else 0

    while m := PIECE.match(page, pos):
        piece, pos = m[0], m.end()
        if piece[0] != "<" or piece == "<":
            if not stack[-1].noise:
                parts.append(html.unescape(piece))
            continue
        name = NAME.match(piece)
        if not name or piece[-1] != ">":
            continue  # comment, declaration, or a tag that the page's end cuts off
        tag = name[1].lower()
        if piece[1] == "/":
            at = innermost(tag)
            if tag in BLOCKS:
                flush()
            if at and (tag in BLOCKS or stack[-1].block is stack[at].block):
                close(at)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in RAW:
            if piece[-2] != "/":
                pos = raw_end(page, pos, tag)
            continue
        if tag in BLOCKS or tag in ENDS:
            flush()
            if tag in BLOCKS and (at := innermost("p")):
                close(at)
            if tag in ENDS and any(count.get(t) for t in ENDS[tag]):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in WALLS[tag]:
                        break
                    if stack[i].tag in ENDS[tag]:
                        close(i)
        if tag in EMPTY:
            continue
        up = stack[-1]
        path, zone, mark = up.path, up.zone, up.mark
        attributes = {a.lower(): (x or y or z or "").lower() for a, x, y, z in ATTRIBUTE.findall(piece)} if " " in piece or "\n" in piece else {}
        if tag in BLOCKS:
            own = tag + "".join("." + c for c in sorted(attributes.get("class", "").split()))
            children.setdefault(path, []).append(own)
            path = key(own, up.path)
            parents[path] = up.path
        if tag in ("article", "main"):
            marks[mark][2] = True
        elif marked(tag, attributes, zone):
            marks.append([mark, 0, False])
            mark = len(marks) - 1
        noise = up.noise
        if tag == "article":  # a teaser or a reader's comment may be an article too
            noise = noise or not COMMENTS.isdisjoint(re.split("[^a-z0-9]+", attributes.get("class", "") + " " + attributes.get("id", "")))
        elif tag not in ("html", "body", "main"):
            noise = (noise or tag in NOISE or "hidden" in attributes or attributes.get("role") in ROLES
                     or "display:none" in attributes.get("style", "").replace(" ", "") or zone < 2 and tag == "header")
        zone = 2 if tag == "article" else max(zone, 1) if tag == "main" else zone
        stack.append(Open(tag, path, noise, zone, mark, None if tag in BLOCKS else up.block))
        count[tag] = count.get(tag, 0) + 1
    flush()
    for up, text, holds in reversed(marks[1:]):  # inner elements come later
        marks[up][1] += text
        marks[up][2] |= holds
    noisy = [False]
    for up, text, holds in marks[1:]:
        noisy.append(noisy[up] or not holds and text <= MOST * marks[0][1])
    kept = [b for b in blocks if not noisy[b.mark]]
    return kept or blocks, children, parents


def style_rows(pages: DataFrame) -> DataFrame:
    """host, path, parent, leaf, value: one row per page and path; value is the hash of content or presentation."""

    def run(batches):
        for batch in batches:
            rows = []
            for host, page in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist(), strict=True):
                blocks, children, parents = cut(page)
                content: dict[int, list[str]] = {}
                for b in blocks:
                    content.setdefault(b.path, []).append(b.text)
                rows += [(host, p, parents.get(p, 0), True, key("\n".join(t))) for p, t in content.items()]
                rows += [(host, p, 0, False, key(" ".join(c))) for p, c in children.items()]
            host, path, parent, leaf, value = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(path, pa.int64()), pa.array(parent, pa.int64()), pa.array(leaf, pa.bool_()),
                                              pa.array(value, pa.int64())], ["host", "path", "parent", "leaf", "value"])

    return pages.select("host", "html").mapInArrow(run, "host string, path bigint, parent bigint, leaf boolean, value bigint")


def importances(pages: DataFrame) -> DataFrame:
    """host, path, pages, importance (0 to 1) of every branch of every host."""
    counts = style_rows(pages).groupBy("host", "path", "leaf", "parent", "value").agg(F.count("*").alias("n"))
    tree = counts.groupBy("host", "path", "leaf", "parent").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    entropy = F.when(F.col("pages") > 1, (F.log("pages") - F.col("nlogn") / F.col("pages")) / F.log("pages")).otherwise(1.0)
    tree = store(tree.select("host", "path", "leaf", "parent", "pages", entropy.alias("entropy")), "tree")
    shape = tree.where(~F.col("leaf")).select("host", F.col("path").alias("parent"), F.col("entropy").alias("shape"))
    leaves = same(tree.where("leaf"), shape, ["host", "parent"])
    mixed = F.lit(PRESENTATION) * F.coalesce("shape", F.lit(1.0)) + F.lit(1 - PRESENTATION) * F.col("entropy")
    return leaves.select("host", "path", "pages", mixed.alias("importance"))


def main_text(page: str | None, low: set[int]) -> str:
    blocks, *_ = cut(page)
    size = lambda zone: sum(len(b.text) for b in blocks if b.zone >= zone)
    zone = 0 if not size(1) else 2 if size(2) >= TEASERS * size(1) and size(2) else 1
    blocks = [b for b in blocks if b.zone >= zone]
    if low:
        held, total = {}, sum(len(b.text) for b in blocks)
        for b in blocks:
            held[b.path] = held.get(b.path, 0) + len(b.text)
        goes = lambda b: b.path in low and (zone < 2 or b.tag not in HEADINGS and held[b.path] < total * MINOR)
        blocks = [b for b in blocks if not goes(b)] or blocks
    return "\n".join(b.text for b in blocks)


def extract(pages: DataFrame, threshold: float = LOW, min_pages: int = MIN_PAGES, low_bytes: int = LOW_BYTES) -> DataFrame:
    """One row per page: page_id, url, text."""
    pages = pages.select("page_id", "url", "html", F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][\w+.-]*:)?//([^/?#]*)", 1)).alias("host"))
    noise = importances(pages).where((F.col("pages") >= min_pages) & (F.col("importance") < threshold))
    low = store(noise.groupBy("host").agg(F.collect_set("path").alias("low")), "branches")
    size = low.agg(F.sum(F.size("low") * 8 + F.length(F.coalesce("host", F.lit(""))) + 64)).first()[0] or 0
    if size <= low_bytes:
        held = pages.sparkSession.sparkContext.broadcast({r.host: set(r.low) for r in low.toLocalIterator()})
        source, of = pages, lambda batch: [held.value.get(h, ()) for h in batch.column("host").to_pylist()]
    else:
        source = same(pages, low, ["host"]).select("page_id", "url", "html", "host", "low")
        of = lambda batch: [set(x or ()) for x in batch.column("low").to_pylist()]

    def run(batches):
        for batch in batches:
            out = [main_text(p, x) for p, x in zip(batch.column("html").to_pylist(), of(batch), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(out, pa.string())], ["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return source.mapInArrow(run, f"page_id {kind}, url string, text string")


def op6_html(spark, folder):
    return extract(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))
