"""Main text of web pages with a site style tree.

The DOMs of one host are merged by node path (tags with classes and ids).  For every path the tree keeps,
over the host's different pages, how often each presentation (sequence of child tags) and each content
(text of the block) occurs.  A node whose m pages have entropy H of presentations and of contents has
importance ``0.1 H_presentation / ln m + 0.9 H_content / ln m``: what a site repeats is near 0, what
differs from page to page near 1.  Extraction leaves out

* elements that are never main text (scripts, styles, forms, embedded objects, hidden elements);
* branches whose tag, role, class or id names a menu, header, footer, sidebar, notice, advert or comments,
  but for layout wrappers (see `wrappers`), which are judged by their importance like other branches;
* branches of importance below `MIN_IMPORTANCE` on at least `MIN_PAGES` pages, inside ``article`` and ``main`` too;
* inside these, branches whose name is only a hint (promotion, sharing, related, pop-up ...), unless at least
  `MIN_PAGES` pages show that they vary as much as main text does (importance of `VARIED` and more);

and, on pages with an ``article`` or ``main``, everything outside of it.  If all of an article is low, the host
serves the same article on most of its pages, which is no box, and it stays.

`MIN_PAGES` follows from a confidence: below that importance a path on so few pages holds one text on all of them.  If
main texts of two pages agree in a path with probability `COINCIDENCE`, m pages do with ``COINCIDENCE^(m - 1)``, and
a path is judged from the m on where that is at most ``1 - CONFIDENCE``.

Statistics are counts by (host, path, hash), so a host with a third of all pages is pre-aggregated; the rows of
its low branches are found by `join_groups`, and pages are joined with these by page, not by host.

Edge cases: null or empty html, or a page without main text, gives an empty text; a null URL belongs to the
host ''; cut tags at the end are dropped; rows of one page_id, also of a null one, share the branches of either;
copies of a page count once in the statistics; pages of any length are read whole; an empty table gives an empty
result; only id, url and html are read, whatever other columns there are.
"""

from __future__ import annotations

import hashlib
import html as entities
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlake.llm.url_filter import split_url
from sensorlake.operators.skew import join_groups
from sensorlake.scratch import stored

MIN_IMPORTANCE, COINCIDENCE, CONFIDENCE, VARIED = 0.3, 0.2, 0.95, 0.8
MIN_PAGES = 1 + math.ceil(math.log(1 - CONFIDENCE) / math.log(COINCIDENCE))

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:"[^"]*"|'[^']*'|[^>"']++)*+)(?:>|\Z)"""
    r"""|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.S)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template svg math iframe object canvas audio video select".split())
DROPPED = RAW | frozenset("head form button label fieldset dialog menu nav footer aside".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
CLOSED_BY = {"li": ("li", "ul ol"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"),
             "th": ("td th", "tr table"), "option": ("option", "select")}
MAIN = frozenset(("article", "main"))
#: Words of class, id and role that name what is not main text.
NOISE = frozenset(
    "ad ads adv advert advertisement adverts advertising adslot banner breadcrumb breadcrumbs comment comments commentlist consent "
    "cookie cookies copyright disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices "
    "notification notifications pager pagination popup promo promoted promotion related replies reply search share sharing sidebar "
    "sidebars signup social sponsor sponsored subscribe subscription toolbar topbar widget widgets alert complementary "
    "contentinfo responses".split())
#: Those of them that name what is never part of an article; inside one, the others are hints that the style tree may overrule.
SURE = frozenset(
    "ad ads adv advert advertisement adverts advertising adslot breadcrumb breadcrumbs comment comments commentlist cookie cookies disqus "
    "footer menu menubar nav navbar navigation notice notices replies reply responses sidebar sidebars contentinfo complementary".split())
#: Those of them that name lists of other people's or other pages' texts, often marked up as articles.
LISTS = frozenset("comment comments commentlist disqus related replies reply responses".split())


@dataclass
class Node:
    tag: str
    path: str
    main: bool
    noise: bool
    children: list[str]
    depth: int
    spared: tuple[int, ...] = ()
    named: Named | None = None
    dropped: bool = False
    hint: bool = False

    @property
    def key(self) -> int:
        """The path's number in the style tree; hinted branches are paths of their own."""
        return digest(self.path + "?" * self.hint)


@dataclass
class Named:
    """An element outside of article and main that its name removes; start and end are places in the page."""
    start: int
    end: int
    lists: bool
    article: bool = False
    main: bool = False


def attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(rest)} if rest.strip(" /\n\t") else {}


def hidden(found: dict[str, str]) -> bool:
    return "hidden" in found or found.get("aria-hidden") == "true" or bool(re.search(r"display\s*:\s*none", found.get("style", "")))


def noise_words(found: dict[str, str], inside: bool) -> frozenset[str]:
    """inside: within the main text a header holds the title, so its name does not count."""
    words = re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", f"{found.get('class', '')} {found.get('id', '')} {found.get('role', '')}").lower())
    return (NOISE - {"header"} if inside else NOISE).intersection(words)


def blocks(page: str) -> list[tuple[str, Node, tuple[str, ...]]]:
    """(text, its node, the tags that its node has had so far) of every block of text, in page order."""
    named: list[Named] = []
    found = list(_blocks(page, frozenset(), named))
    spared = wrappers(page, found, named)
    return list(_blocks(page, spared, [])) if spared else found


def wrappers(page: str, found: list[tuple[str, Node, tuple[str, ...]]], named: list[Named]) -> frozenset[int]:
    """Starts of the elements that a name must not remove.

    Those that hold a main, those that hold an article where none lies outside of such elements, and those
    that hold most of the text.  Lists (of comments, related pages) are only kept for a main, or if no text
    is left without them.
    """
    spared: frozenset[int] = frozenset()
    while True:
        kept = [(len(text), node) for text, node, _ in found if not node.noise]
        free, article = sum(n for n, _ in kept), any(node.main for _, node in kept)
        # Text is no longer than its source, so most small elements need no second look.
        tried = [e for e in named if e.main or (e.article and not article) or e.end - e.start > free]
        if not tried:
            return spared
        # All but the lists counts, so nested names do not hide what an element holds; they are judged in the next round.
        size, total = {e.start: 0 for e in tried}, 0
        for text, node, _ in _blocks(page, spared, [], all_but_lists=True):
            if not node.noise:
                total += len(text)
                for start in size.keys() & set(node.spared):
                    size[start] += len(text)
        new = {e.start for e in tried if e.main or (not e.lists and (e.article and not article or size[e.start] * 2 > total))}
        if not new and not free:
            new = {e.start for e in tried if not e.lists} or {e.start for e in tried}
        if not new:
            return spared
        spared |= new
        named = []
        found = list(_blocks(page, spared, named))


def _blocks(page: str, spared: frozenset[int], named: list[Named], all_but_lists: bool = False) -> Iterator[tuple[str, Node, tuple[str, ...]]]:
    """The same without the named elements that do not start at one of spared; they are added to named."""
    stack = [Node("", "", False, False, [], 0)]
    text: list[str] = []
    owner = stack[0]
    at = 0

    def flush():
        found = " ".join(entities.unescape("".join(text)).split())
        text.clear()
        return found

    for_closing = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSED_BY.items()}
    length = len(page)
    while at < length:
        m = _TAG.search(page, at)
        stop = m.start() if m else length
        if stop > at and not stack[-1].noise:
            if not text:
                owner = stack[-1]
            text.append(page[at:stop])
        if m is None:
            break
        at = max(m.end(), stop + 1)
        tag = (m["name"] or m["name2"] or "").lower()
        if not tag:
            continue
        closing = bool(m["end"] or m["end2"])
        if tag in BLOCK or tag in RAW:
            if text and (found := flush()):
                yield found, owner, tuple(owner.children)
            text.clear()
        elif tag in ("br", "wbr", "img") and text:
            text.append(" " if tag != "wbr" else "")
        if closing:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth:
                _cut(stack, depth, at)
            continue
        if tag in BLOCK:
            _close(stack, frozenset("p"), MAIN | {"div", "section", "body", "li", "td"}, m.start())
        if tag in for_closing:
            _close(stack, *for_closing[tag], m.start())
        rest = m["rest"] if m["name"] else m["rest2"]
        top = stack[-1]
        top.children.append(tag)
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else length
            continue
        if rest.endswith("/") and tag not in BLOCK:
            continue
        found = attributes(rest)
        name = tag + "".join("." + c for c in sorted(re.sub(r"\d+", "", found.get("class", "")).split())) + (
            "#" + re.sub(r"\d+", "", found["id"]) if found.get("id") else "")
        inside = top.main or tag in MAIN or found.get("role") in MAIN
        words = frozenset() if tag in ("html", "body") or (tag in MAIN and not top.main) else noise_words(found, top.main)
        hard = tag in DROPPED or (tag == "header" and not top.main) or (tag not in ("html", "body") and (tag not in MAIN or top.main) and hidden(found))
        element, keeps = top.named, top.spared
        if words and not hard and not top.noise and not top.main and tag in BLOCK:
            if m.start() in spared or (all_but_lists and LISTS.isdisjoint(words)):
                words, keeps = frozenset(), (*keeps, m.start())
            else:
                element = Named(m.start(), length, not LISTS.isdisjoint(words))
                named.append(element)
        hint = top.hint or (top.main and bool(words) and SURE.isdisjoint(words))
        words = words & SURE if top.main else words
        dropped = hard or top.dropped
        if inside and not top.main and element is not None and not dropped:
            element.main |= tag == "main" or found.get("role") == "main"
            element.article |= tag == "article" or found.get("role") == "article"
        noise = top.noise or hard or bool(words)
        stack.append(Node(tag, f"{top.path}>{name}" if tag in BLOCK else top.path, inside, noise, [], top.depth + 1, keeps, element, dropped, hint))
    if text and (found := flush()):
        yield found, owner, tuple(owner.children)


def _cut(stack: list[Node], depth: int, at: int) -> None:
    """Closes the elements from depth on at this place of the page."""
    if stack[-1].named is not None and stack[-1].named is not stack[depth - 1].named:
        stack[-1].named.end = at
    del stack[depth:]


def _close(stack: list[Node], tags: frozenset, limits: frozenset, at: int) -> None:
    """Closes the innermost open element among tags, unless one of limits is further in."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            _cut(stack, i, at)
            return
        if stack[i].tag in limits:
            return


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def nodes(pages: DataFrame) -> DataFrame:
    """(page_id, host, page, path, hint, kind, value): presentations (kind 0) and contents (1) of each page(page_id, host, html)."""
    names = ["id", "host", "page", "path", "hint", "kind", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, bool], int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, rows = batch.slice(at, 256), {}
                for page_id, host, page in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                    source = page.as_py() or ""
                    own = digest(source)
                    for text, node, children in blocks(source):
                        path = known.get((node.path, node.hint))
                        if path is None:
                            if len(known) > 100_000:
                                known.clear()
                            path = known[node.path, node.hint] = node.key
                        rows[page_id, host, own, path, node.hint, 0, digest(" ".join(children))] = None
                        rows[page_id, host, own, path, node.hint, 1, digest(text)] = None
                kinds = [part.schema.field(0).type, pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    kind = pages.schema["id"].dataType.simpleString()
    return pages.mapInArrow(run, f"id {kind}, host string, page long, path long, hint boolean, kind int, value long")


def style_tree(found: DataFrame) -> DataFrame:
    """(host, path, hint, pages, importance) of every node of every site."""
    values = found.select("host", "path", "hint", "kind", "value", "page").distinct().groupBy("host", "path", "hint", "kind", "value").count()
    totals = values.groupBy("host", "path", "hint", "kind").agg(F.sum("count").alias("m"), F.sum(F.col("count") * F.ln("count")).alias("s"))
    entropy = F.when(F.col("m") > 1, (F.ln("m") - F.col("s") / F.col("m")) / F.ln("m")).otherwise(1.0)
    weight = F.when(F.col("kind") == 0, 0.1).otherwise(0.9)
    return totals.groupBy("host", "path", "hint").agg(F.max("m").alias("pages"), F.sum(weight * entropy).alias("importance"))


def low_branches(tree: DataFrame, min_importance: float = MIN_IMPORTANCE, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, path, pages) of the branches that extraction leaves out."""
    seen = F.col("pages") >= min_pages
    return tree.where((seen & (F.col("importance") < min_importance)) | (F.col("hint") & ~(seen & (F.col("importance") >= VARIED)))).select("host", "path", "pages")


def main_text(page: str, low: frozenset[int]) -> str:
    every = [(text, node) for text, node, _ in blocks(page) if not node.noise]
    inside = [(text, node) for text, node in every if node.main]
    chosen = [text for text, node in inside or every if not low or node.key not in low]
    return "\n\n".join(chosen or [text for text, _ in inside])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
            min_importance: float = MIN_IMPORTANCE, min_pages: int = MIN_PAGES) -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    host, _ = split_url(F.col("__url"))
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("__url"), F.col(html_col).alias("html"))
    hosted = source.withColumn("host", host)
    found = stored(nodes(hosted.select("id", "host", "html")), "nodes")
    low = stored(low_branches(style_tree(found), min_importance, min_pages), "low-branches")
    own = join_groups(found.where("kind = 1").select("id", "host", "path"), low, ["host", "path"], "pages")
    own = own.groupBy("id").agg(F.collect_set("path").alias("low"))
    joined = source.join(own.withColumnRenamed("id", "__id"), F.col("id").eqNullSafe(F.col("__id")), "left").select("id", "__url", "html", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [main_text(h.as_py() or "", frozenset(paths.as_py() or ())) for h, paths in zip(part.column(2), part.column(3), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                    names=[id_col, url_col, "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(run, f"{id_col} {kind}, {url_col} string, text string, n_chars long")
