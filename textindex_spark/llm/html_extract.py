"""Main text of web pages by site style trees.

All pages of a host are merged into one style tree: an element node is the path of tags and classes that leads to it.
Two measures give a node's importance.

* Content importance: of the texts that stand at a path on m pages of a host, one that is on k of them has entropy
  log k / log m; the path's content importance is one minus the mean entropy of its distinct texts, so text of one page
  weighs as much as text of all.
* Presentation importance: a page shows a path in some style, the number of its blocks there. With l styles, used by
  shares p of the m pages, it is -sum p log p / log m, and the importance of the path is (1 - GAMMA^(l - 1)) of it and
  GAMMA^(l - 1) of its content importance, or its content importance if that is higher.

The evidence of a host of m pages counts m, that of the same path over all hosts MIN_PAGES, and over all M pages the
latter counts M against MIN_PAGES of a path that is important: nothing switches at some size. Pages with the same blocks
are one page of evidence, whatever their scripts.

Roles that tags, classes and ids declare (navigation, page headers and footers, adverts, comments and the like) are a
prior. Outside article and main they remove a branch. Below article or main, a branch goes only if it has such a role and
low importance too; no other text there is removed, however often it recurs.

Each page loses the branches of low importance; the blocks that are left, in page order, are its text.

Counts are aggregated by (host, path, text) and then by (host, path), with map-side combination, so a host with a third
of all pages meets in no task. What a page needs is its host's list of unimportant paths: one row for each host, which
is broadcast only up to BROADCAST_ROWS rows and joined by a shuffle beyond.

Defined results: null or empty html gives the empty text and length 0; a null or odd url is the host ""; pages of a
host with equal blocks count once in the entropy and come out as often as they went in; an empty table gives no
rows; extra columns are ignored. Tags that are never closed, cut off or misnested are closed where their parents end.
Known limit: tags begun after the last > of a page are each searched to its end.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, read_table

#: Paths whose importance is below this are removed.
LEAST_IMPORTANCE = 0.5
#: So many pages does the evidence of other hosts, and that of none, count.
MIN_PAGES = 20
#: How fast styles of a path make its presentation count.
GAMMA = 0.9
BROADCAST_ROWS = 20_000

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup.
RAW = "script|style|textarea|title|xmp|iframe|noembed|noframes|template|svg|canvas|select|annotation|annotation-xml"
#: Elements that stand for what a reader does not come for.
OUTSIDE = frozenset("head nav header footer aside form menu dialog button label fieldset option datalist video audio picture map noscript".split())
#: Elements that run inside a block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img label object math semantics mrow mi mn mo ms mtext mfrac msqrt mroot msup msub msubsup mover munder munderover mstyle mpadded mfenced".split())
#: Elements that end an open one of the same or a listed kind.
CLOSES = {
    "p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    **{t: ("p",) for t in "article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()},
}
#: Words in classes, ids and roles that declare such a part.
PARTS = frozenset(
    "ad ads advert adverts advertisement advertising banner promo sponsor sponsored sponsors cookie cookies consent gdpr notice notices alert modal popup overlay nav navbar navigation menu menus breadcrumb breadcrumbs "
    "sidebar aside widget widgets footer header masthead topbar toolbar comment comments commentlist disqus respond reply replies discussion share sharing social related recommended newsletter subscribe subscription signup login search pagination pager skip "
    "hidden copyright".split()
)

#: What follows a tag's name: only a quote after an equals sign opens a value that may hold a >.
_INSIDE = r"(?:=\s*(?:\"[^\"]*\"|'[^']*')|[^>])*+"
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<({RAW})\b{_INSIDE}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_INSIDE})>|<[!?][^>]*>|<[/!?a-zA-Z][^<>]*\Z", re.S | re.I)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)")
_WORDS = re.compile(r"[a-z0-9]+")


def _key(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _label(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """The node's label in the style tree, whether it declares a part outside the main text, and whether it is hidden."""
    outside = tag in OUTSIDE
    hidden = tag == "head"
    if "=" not in attributes:
        return tag, outside, hidden
    names = []
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id", "role"):
            words = [*dict.fromkeys(_WORDS.findall(value))]
            # a whole page or article may carry such a word as well ("has-sidebar"); only sections are parts
            outside = outside or (tag not in ("html", "body", "main", "article") and not PARTS.isdisjoint(words))
            if name == "class":
                names += words
        elif name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
            hidden = True
    return ".".join([tag, *names]), outside, hidden


#: Where a block stands: by no role outside the main text, or below article or main, by a role there or not.
FREE, CORE, DOUBTFUL = 0, 1, 2


def blocks(page: str) -> list[tuple[str, str]]:
    """(path, text) of every block of a page that its roles alone do not remove, in page order."""
    return [(path, text) for path, text, _ in placed_blocks(page)]


def placed_blocks(page: str) -> list[tuple[str, str, int]]:
    """(path, text, place) of every block of a page, in page order, without what stands outside by its role."""
    out: list[tuple[str, str, int]] = []
    stack: list[tuple[str, str, bool, int]] = []  # tag, path, outside, place
    text: list[str] = []

    def flush() -> None:
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                block, place = next(((p, place) for t, p, _, place in reversed(stack) if t not in INLINE), ("", FREE))
                out.append((block, joined, place))
            text.clear()

    def add(s: str) -> None:
        if s and not (stack and stack[-1][2]):
            text.append(s)

    at = 0
    for m in _TOKEN.finditer(page):
        add(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        elif tag == "br":
            add(" ")
        if m[2]:
            found = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), -1)
            if found >= 0:
                if any(t not in INLINE for t, *_ in stack[found:]):
                    flush()
                del stack[found:]
            continue
        for i in range(len(stack) - 1, -1, -1) if tag in CLOSES else ():
            if stack[i][0] in CLOSES[tag]:
                del stack[i:]
                break
            if stack[i][0] not in INLINE:
                break
        if tag not in VOID and not m[4].endswith("/"):
            label, outside, hidden = _label(tag, m[4])
            above = stack[-1] if stack else ("", "", False, FREE)
            place = above[3]
            if place == FREE and not outside and tag in ("article", "main"):
                place = CORE
            elif place == CORE and outside:
                place = DOUBTFUL
            # a part's role holds for all below it; below article and main it is only a doubt
            gone = hidden or above[2] or (outside and place == FREE)
            stack.append((tag, f"{above[1]}>{label}" if tag not in INLINE else above[1], gone, place))
    add(page[at:])
    flush()
    return out


def _node(path: str, place: int) -> int:
    """Key of a node of the style tree; doubtful branches are nodes of their own."""
    return _key(f"{path}?" if place == DOUBTFUL else path)


def _observed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, signature of all blocks, seen) of each page: the distinct texts and the style of every node that may go."""
    kind = pa.list_(pa.struct([("path", pa.int64()), ("styled", pa.bool_()), ("value", pa.int64())]))
    for batch in batches:
        hosts, signatures, seen = [], [], []
        for host, page in zip(*(c.to_pylist() for c in batch.columns)):
            found = placed_blocks(page or "")
            nodes = [(_node(p, place), t) for p, t, place in found if place != CORE]
            hosts.append(host)
            signatures.append(_key(repr(found)))
            texts = [{"path": n, "styled": False, "value": _key(t)} for n, t in dict.fromkeys(nodes)]
            seen.append(texts + [{"path": n, "styled": True, "value": k} for n, k in Counter(n for n, _ in nodes).items()])
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(signatures, pa.int64()), pa.array(seen, kind)], ["host", "signature", "seen"])


def _importance(counts: DataFrame, by: list[str], pages: DataFrame) -> DataFrame:
    """(by, path, pages, importance) from (by, path, styled, value, n): content and presentation importance in one."""
    m = F.greatest(F.col("pages"), F.lit(2)).cast("double")
    joined = counts.join(pages, by) if by else counts.crossJoin(F.broadcast(pages))
    entropy = F.log(F.least(F.col("n").cast("double"), m)) / F.log(m)
    share = F.least(F.col("n") / m, F.lit(1.0))
    nodes = joined.groupBy(*by, "path").agg(
        F.max("pages").alias("pages"), (1 - F.avg(F.when(~F.col("styled"), entropy))).alias("content"),
        F.sum(F.when(F.col("styled"), -share * F.log(share) / F.log(m))).alias("shown"), F.count_if("styled").alias("styles"),
    )
    weight = F.pow(F.lit(GAMMA), F.col("styles") - 1)
    return nodes.select(*by, "path", "pages", F.greatest("content", (1 - weight) * F.col("shown") + weight * F.col("content")).alias("importance"))


def style_tree(pages: DataFrame) -> DataFrame:
    """(host, unimportant): for each host the nodes, as keys, that are removed from its pages."""
    observed = pages.select("host", "html").mapInArrow(_observed, "host string, signature long, seen array<struct<path:long,styled:boolean,value:long>>")
    # pages with the same blocks are no evidence that their text repeats
    single = materialize(observed.dropDuplicates(["host", "signature"]), "style-pages")
    counts = single.select("host", F.explode("seen").alias("s")).groupBy("host", "s.path", "s.styled", "s.value").agg(F.count(F.lit(1)).alias("n"))
    seen = materialize(counts, "style-counts")
    sizes = single.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    whole = sizes.agg(F.coalesce(F.sum("pages"), F.lit(0)).alias("pages"))  # one row
    own = _importance(seen, ["host"], sizes)
    common = _importance(seen.groupBy("path", "styled", "value").agg(F.sum("n").alias("n")), [], whole)
    blend = lambda x, y: (F.col("pages") * F.col(x) + MIN_PAGES * y) / (F.col("pages") + MIN_PAGES)
    common = common.select("path", blend("importance", F.lit(1.0)).alias("elsewhere"))
    verdict = own.join(common, "path").where(blend("importance", F.col("elsewhere")) < LEAST_IMPORTANCE)
    return verdict.groupBy("host").agg(F.collect_set("path").alias("unimportant"))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, unimportant in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            gone = frozenset(unimportant or ())
            texts.append("\n\n".join(t for p, t, place in placed_blocks(page or "") if not gone or place == CORE or _node(p, place) not in gone))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, main text and its length in code points."""
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).withColumn("host", host)
    lists = materialize(style_tree(rows), "style-trees")
    lists = F.broadcast(lists) if lists.count() <= BROADCAST_ROWS else lists
    joined = rows.join(lists, "host", "left").select("page_id", "url", "html", "unimportant")
    return joined.mapInArrow(_extracted, "page_id long, url string, text string, n_chars long")


def op9_html(spark, sf_dir) -> DataFrame:
    return extract(read_table(spark, sf_dir, "pages"))
