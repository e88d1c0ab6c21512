"""Main text of web pages by site style trees.

The pages of one host are merged into a style tree: a node stands for an element at
a place (the chain of block elements above it, with their class or id). Pages of a host that
are equal but for noise count as one page. For each node, over the pages that have it:

* presentation importance: entropy, to the base of the number of pages, of the ways in
  which pages lay out the node's content (its number of text blocks, and how much of it
  is link text);
* content importance: 1 less the entropy of each text over the pages, log(c) / log(m) for
  a text that c of m pages share, averaged over the node's texts.

A branch's importance is the mean of its nodes', weighted by their blocks. Tags and names
are a weight in it: importance = w * prior + (1 - w) * mean, with w = (m / 2 + 1) / (m + 1)
falling from 3/4 at one page to 1/2 at many. An article or main element (``MAIN_*``) and what
is in it has the prior ``IN_MAIN``; what is beside it, on pages that have one, and what is in
it but has a word of ``NOISE_NAMES`` in a class or id, ``BESIDE``; the branches of pages without one ``THRESHOLD``, so there the mean decides alone. Branches below
``THRESHOLD`` are removed from each page; an element around a page's main element is no branch
of that page. A heading in a main element stands or falls with the element it heads.

Menus, headers, footers, sidebars, notices, adverts, forms, scripts, comments and the like
(``NOISE_*``) are removed by what they say about themselves and are no part of the tree: the
texts of adverts and forms differ from page to page, so statistics would keep them.

Pages are parsed once; the tree lives in tables keyed by (host, node), so a host with a
third of all pages is aggregated in parts before any shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rareflag.llm.scratch import written

THRESHOLD = 0.3
CONTENT_SHARE = 0.9
IN_MAIN = 0.5
BESIDE = 0.2
SALTS = 16
ROWS = 256

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "noembed", "xmp")
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "summary table tbody td tfoot th thead tr ul caption".split())
#: a start tag of the key ends an open element of the values, up to the nearest other block
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}}
NOISE_TAGS = frozenset("nav aside footer form button select menu dialog search fieldset head".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar "
                        "toolbar form note".split())
NOISE_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion nav navbar "
    "navigation menu breadcrumb breadcrumbs footer sidebar side widget widgets cookie cookies consent gdpr notice "
    "notices alert popup modal newsletter subscribe subscription signup login share sharing social comment comments "
    "respond reply replies disqus related recommended pagination pager toolbar masthead topbar skip".split())
MAIN_TAGS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_HEADER_NAMES = frozenset(("header",))

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_RAW_END = {t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.I) for t in RAW}
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class _Open:
    __slots__ = ("tag", "node", "mark", "block")

    def __init__(self, tag: str, node: int, mark: int, block: bool):
        self.tag, self.node, self.mark, self.block = tag, node, mark, block


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _attrs(raw: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw.strip() else {}


def _mark(tag: str, attrs: dict[str, str], above: int) -> int:
    """-1 noise, 1 main, 2 doubtful in main, 0 undecided; noise stays noise, main stays main but for noise in it.

    In a main element a word of a class or id makes an element doubtful, a whole class or id noise. The id of a
    heading says nothing, as it is made from the heading's text.
    """
    if above < 0:
        return -1
    said = [attrs.get(k, "") for k in ("class", "id") if k == "class" or above == 0 or tag not in HEADINGS]
    names = {w.lower() for x in said for w in _NAME.findall(x)}
    role = attrs.get("role", "").lower()
    if tag in NOISE_TAGS or role in NOISE_ROLES or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" \
            or _HIDDEN.search(attrs.get("style", "")):
        return -1
    if above == 0 and (tag == "header" or names & _HEADER_NAMES):
        return -1
    if tag in MAIN_TAGS or role == "main" or attrs.get("itemprop", "").lower() == "articlebody":
        return 1
    if tag not in ("html", "body") and names & NOISE_NAMES:
        return -1 if above == 0 or NOISE_NAMES.intersection(" ".join(said).lower().split()) else 2
    return above


def blocks(page: str) -> list[tuple[str, list[int], int, int]]:
    """(text, nodes from the outermost to its own, mark, characters of links) of each text block in page order.

    The last two bits of a node are its element's mark. A heading in a main element has the nodes above it and mark 4.
    """
    out: list[tuple[str, list[int], int, int]] = []
    stack = [_Open("", 0, 0, True)]
    buf: list[str] = []
    links = 0

    def flush() -> None:
        nonlocal links
        text = _SPACE.sub(" ", "".join(buf)).strip()
        if text:
            # the block's mark is that of the innermost open element when its text was read
            above = [o for o in stack[1:] if o.block]
            head = next((i for i, o in enumerate(above) if o.mark > 0 and o.tag in HEADINGS), None)
            out.append((text, [o.node for o in above[:head]], marks[0] if head is None or marks[0] < 0 else 4, links))
        buf.clear()
        links = 0
        marks.clear()

    marks: list[int] = []

    def push_text(raw: str) -> None:
        nonlocal links
        if stack[-1].mark < 0 and not stack[-1].block:
            return  # a noisy inline element inside a block
        text = html.unescape(raw) if "&" in raw else raw
        if not text.strip():
            if text:
                buf.append(" ")
            return
        if not marks:
            marks.append(stack[-1].mark)
        buf.append(text)
        if any(o.tag == "a" for o in stack[-4:]):
            links += len(text)

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            push_text(page[at:])
            break
        if m.start() > at:
            push_text(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br":
                buf.append(" ")
                continue
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if k:
                if any(o.block for o in stack[k:]):
                    flush()
                del stack[k:]
            continue
        if tag in RAW:
            e = _RAW_END[tag].search(page, at)
            at = e.end() if e else end
            buf.append(" ")
            continue
        if tag == "br":
            buf.append(" ")
            continue
        block = tag in BLOCK
        if block:
            flush()
            # a block start ends an open paragraph; some elements end their like
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].block), 0)
            if k and stack[k].tag == "p":
                del stack[k:]
            closes = ENDS.get(tag)
            if closes:
                k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].block), 0)
                while k and stack[k].tag in closes:
                    del stack[k:]
                    k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].block), 0)
        if tag in VOID or m[3].rstrip().endswith("/") and tag in VOID:
            continue
        attrs = _attrs(m[3])
        top = stack[-1]
        name = re.sub(r"\d+", "#", attrs.get("class") or attrs.get("id") or "")
        mark = _mark(tag, attrs, top.mark)
        node = _signed(xxhash.xxh3_64_intdigest(f"{top.node} {tag} {name}") & ~3 | mark & 3) if block else top.node
        stack.append(_Open(tag, node, mark, block))
    flush()
    return out


def layout(page: str) -> tuple[list[dict], list[dict], bool, int]:
    """Blocks (text, place), places (nodes, first node that may be removed, blocks, style, texts), main, hash.

    Noise is left out. Places are numbered from 0; headings of main elements have a place but no blocks or texts.
    """
    found = [b for b in blocks(page) if b[2] >= 0]
    main = any(mark > 0 for _, _, mark, _ in found)
    around = {n for _, up, mark, _ in found if mark > 0 for n in up if n & 3 == 0}
    at: dict[tuple[int, ...], int] = {}
    out, rows = [], []
    for text, up, mark, link in found:
        key = (*up, mark == 4)
        if key not in at:
            at[key] = len(rows)
            skip = next((i for i, n in enumerate(up) if n not in around), len(up))
            # a node around the main element is removable for the text right in it, unless that is a heading
            rows.append({"up": up, "skip": skip if mark == 4 else min(skip, max(len(up) - 1, 0)), "n": 0, "links": 0,
                         "texts": {}})
        out.append({"text": text, "place": at[key]})
        if mark < 4 and up:
            row = rows[at[key]]
            row["n"] += 1
            row["links"] += min(4, 4 * link // len(text))
            row["texts"][_signed(xxhash.xxh3_64_intdigest(text))] = None
    for row in rows:
        links = row.pop("links")
        row["style"] = f"{min(row['n'], 50)}/{int(links / row['n'] + 0.5)}" if row["n"] else ""
        row["texts"] = list(row["texts"])
    return out, rows, main, _signed(xxhash.xxh3_64_intdigest(repr(found).encode("utf-8", "surrogatepass")))


_BLOCKS = pa.list_(pa.struct([("text", pa.string()), ("place", pa.int32())]))
_PLACES = pa.list_(pa.struct([("up", pa.list_(pa.int64())), ("skip", pa.int32()), ("n", pa.int64()),
                              ("style", pa.string()), ("texts", pa.list_(pa.int64()))]))


def parsed(pages: DataFrame, markup: str) -> DataFrame:
    """rid, page_id, url, host, blocks, places, main, copy (hash of all but noise) of every page (see ``layout``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, ROWS):
                part = b.slice(i, ROWS)
                found = [layout(h or "") for h in part.column(4).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:4], pa.array([f[0] for f in found], _BLOCKS),
                     pa.array([f[1] for f in found], _PLACES), pa.array([f[2] for f in found], pa.bool_()),
                     pa.array([f[3] for f in found], pa.int64())],
                    names=["rid", "page_id", "url", "host", "blocks", "places", "main", "copy"])

    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    src = pages.select(F.monotonically_increasing_id().alias("rid"), F.col("page_id").cast("long").alias("page_id"),
                       F.col("url").cast("string").alias("url"), host.alias("host"), F.col(markup).alias("html"))
    return src.mapInArrow(run, "rid bigint, page_id bigint, url string, host string, "
                               "blocks array<struct<text:string, place:int>>, places array<struct<up:array<bigint>, "
                               "skip:int, n:bigint, style:string, texts:array<bigint>>>, main boolean, copy bigint")


def importance(pages: DataFrame) -> DataFrame:
    """(host, node, mean, pages) of every branch of the hosts' style trees."""
    on = pages.select("host", "copy", F.explode("places").alias("p")).where("p.n > 0").select(
        "host", "copy", F.element_at("p.up", -1).alias("leaf"), "p.n", "p.style", "p.up", "p.texts")
    # the copies of a page agree in all of these
    once = on.groupBy("host", "leaf", "copy").agg(F.first("n").alias("n"), F.first("style").alias("style"),
                                                  F.first("up").alias("up"))
    style = once.groupBy("host", "leaf", "style").agg(F.count("*").alias("c"), F.sum("n").alias("n"),
                                                      F.first("up").alias("up"))
    # entropy of a distribution of counts c with the sum m: log(m) - sum(c log c) / m
    tree = style.groupBy("host", "leaf").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.log("c")).alias("clc"),
                                             F.sum("n").alias("n"), F.first("up").alias("up"))
    shared = on.select("host", "leaf", "copy", F.explode("texts").alias("th")).distinct().groupBy(
        "host", "leaf", "th").agg(F.count("*").alias("c")).groupBy("host", "leaf").agg(
        F.sum("c").alias("t"), F.sum(F.col("c") * F.log("c")).alias("tlt"))
    m = F.col("m")
    base = F.log(m)
    present = F.when(m > 1, (base - F.col("clc") / m) / base).otherwise(F.lit(1.0))
    content = F.when(m > 1, 1 - F.col("tlt") / F.col("t") / base).otherwise(F.lit(1.0))
    own = tree.join(shared, ["host", "leaf"]).select(
        "host", "up", "n", "m", ((1 - CONTENT_SHARE) * present + CONTENT_SHARE * content).alias("imp"))
    return own.select("host", F.explode("up").alias("node"), "n", "m", "imp").groupBy("host", "node").agg(
        (F.sum(F.col("imp") * F.col("n")) / F.sum("n")).alias("mean"), F.max("m").alias("pages"))


def _low(prior: float | Column, threshold: float) -> Column:
    w = (F.col("pages") / 2 + 1) / (F.col("pages") + 1)
    return F.round(w * prior + (1 - w) * F.col("mean"), 9) < threshold


def main_text(pages: DataFrame, markup: str = "html", threshold: float = THRESHOLD) -> DataFrame:
    """page_id, url, host, text of every page row.

    A null or empty page, and one without main text, has an empty text. A page without a host
    (null or odd url) belongs to the host "". Repeated rows and copies get equal texts and count
    as one page of their host. Very long pages are parsed whole. An empty table gives an empty result.
    """
    base = written(parsed(pages, markup), "page-blocks")
    prior = F.when(F.col("node").bitwiseAND(3) == 1, F.lit(IN_MAIN)).otherwise(F.lit(BESIDE))
    low = importance(base).select("host", "node", _low(prior, threshold).alias("low"), (
        F.round("mean", 9) < threshold).alias("open")).where("low or open")
    low = low.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    judged = lambda p: F.slice(p["up"], p["skip"] + 1, F.size(p["up"]))
    nodes = base.select("host", "rid", "main", F.explode(F.array_distinct(F.flatten(F.transform(
        "places", judged)))).alias("node")).withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)))
    drop = nodes.join(low, ["host", "node", "salt"]).where(F.when(F.col("main"), F.col("low")).otherwise(
        F.col("open"))).groupBy("rid").agg(F.collect_set("node").alias("drop"))
    # written, so that Spark knows its size: the pages' texts are shuffled only when it is large
    out = base.join(written(drop, "page-drops"), "rid", "left").withColumn(
        "drop", F.coalesce("drop", F.array().cast("array<bigint>")))
    gone = F.transform("places", lambda p: F.arrays_overlap(judged(p), F.col("drop")))
    kept = F.filter("blocks", lambda b: ~F.get(F.col("gone"), b["place"]))
    return out.withColumn("gone", gone).select("page_id", "url", "host", F.array_join(F.transform(
        kept, lambda b: b["text"]), "\n").alias("text"))
