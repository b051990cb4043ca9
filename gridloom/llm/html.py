"""Main text of web pages: a tree of elements, templates counted per host, and blocks of what is left.

First pass: every page's tree is walked once, each element subtree is hashed (tag, class and id, text), and the pages of a host on
which a hash stands are counted in Spark. Pages with the same text count once, so copies of one page don't make its content a template,
nor is what holds a page's whole text ever one. Second pass: subtrees that recur on at least ``least_pages`` pages of their host,
however large, are deleted, together with elements that by kind or by name aren't content (navigation, footers, adverts, forms,
scripts, comments by readers and the like). Inside a marked article (article, main or role=main) paragraphs and the like
(PROSE) stay however often they recur; lists, tables and boxes there go if they recur and hold at most half of the article's text.

Up to MOST_BROADCAST templates are broadcast; of more, each page gets those that stand on it by an exchange.

Nulls: a null html is an empty page with an empty text; a null url is a host of its own. Ids are passed on. Repeated rows count as
one page and get equal results; an empty table gives an empty result; other columns are ignored. Markup that ends early
or never closes is read as browsers do: a block closes open paragraphs, an end tag closes what it contains. A very long page is one
batch; its tree is walked without recursion. Ties don't arise: a template either recurs often enough or doesn't.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from gridloom.llm.common import chunks, strings, written

# fixed values: HTML's element kinds
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: An element of the first kind ends an open one of the second, up to the nearest of the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}), "body": ({"head"}, {"html"}),
}
SCOPES = frozenset("table td th caption button object html body article section div main aside nav header footer form ul ol dl li".split())
#: Inside marked articles, these and what they hold are content; of lists and tables only the whole is judged.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dl dt dd thead tbody tfoot tr td th caption figcaption address summary".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are never content, and names (in class, id, role) of those that aren't.
DROPPED = frozenset("head script style noscript template iframe nav header footer aside form menu button select input textarea dialog svg canvas object embed audio video search title noembed noframes".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner menu nav navbar navigation breadcrumb breadcrumbs sidebar footer header masthead cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments commentlist disqus respond replies pagination pager widget toolbar search".split()
)
#: What may stand beside such a name in a class or id (site-header, comment_list) without making it another thing, as in section-header or share-price.
BESIDE = frozenset("site page main top bottom left right global primary secondary sub side skip link links list item items box bar block area container wrap wrapper inner button buttons form slot unit text post posts article articles entry user reader section content panel group row column col 1 2 3".split())
#: With these a header is that of an article or of a part of it.
OWN = frozenset("section article entry post content".split())
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())

MOST_BROADCAST = 300_000  # templates; more are joined to pages by an exchange

TOKEN = re.compile(r"<!--(?:-?>|.*?(?:--!?>|$))|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*(?:\"|$)|=\s*'[^']*(?:'|$)|[^>])*)>?", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


class Element:
    __slots__ = ("children", "names", "tag")

    def __init__(self, tag: str, names: dict[str, str]):
        self.tag, self.names, self.children = tag, names, []


def attributes(source: str) -> dict[str, str]:
    """Class, id, role, hidden and aria-hidden, lower-cased; others say nothing about what an element is for."""
    if not source or source.isspace():
        return {}
    out: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(source):
        name = m[1].lower()
        if name in ("class", "id", "role", "hidden", "aria-hidden"):
            out.setdefault(name, (m[2] or m[3] or m[4] or "").strip().lower())
    return out


def parsed(html: str) -> Element:
    """The tree of a page; children are elements and texts with their references decoded."""
    root = Element("#root", {})
    stack, at, n = [root], 0, len(html)
    is_open: Counter[str] = Counter()  # tags on the stack, so that it is only searched for what is there

    def close(i: int) -> None:
        is_open.subtract(x.tag for x in stack[i:])
        del stack[i:]

    while at < n:
        m = TOKEN.search(html, at)
        if not m:
            stack[-1].children.append(unescape(html[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(unescape(html[at : m.start()]))
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1) if is_open[tag] else ():
                if stack[i].tag == tag:
                    close(i)
                    break
                if stack[i].tag in SCOPES and tag not in BLOCKS:  # a stray end of an inline element
                    break
            continue
        if tag in BLOCKS and is_open["p"]:  # ends an open paragraph
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == "p":
                    close(i)
                    break
                if stack[i].tag in SCOPES:
                    break
        if tag in ENDS:
            ended, scope = ENDS[tag]
            for i in range(len(stack) - 1, 0, -1) if any(is_open[x] for x in ended) else ():
                if stack[i].tag in scope:
                    break
                if stack[i].tag in ended:
                    close(i)
                    if tag not in ("tr", "tbody", "tfoot"):
                        break
        element = Element(tag, attributes(m[3]))
        stack[-1].children.append(element)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|$)[^>]*>?", re.IGNORECASE).search(html, at)
            element.children.append(html[at : end.start() if end else n])
            at = end.end() if end else n
        elif tag not in VOID and not (tag in ("svg", "path", "use") and m[3].rstrip().endswith("/")):  # elsewhere HTML ignores the slash
            stack.append(element)
            is_open[tag] += 1
    return root


def is_boilerplate(e: Element) -> bool:
    if e.tag in DROPPED:
        return True
    names = e.names
    if not names:
        return False
    if "hidden" in names or names.get("aria-hidden") == "true" or names.get("role") in ROLES:
        return True
    if e.tag in ("article", "main", "body", "html", "h1"):
        return False
    for name in (x for k in ("class", "id") if k in names for x in names[k].split()):
        parts = [x for x in re.split("[_-]+", name) if x]
        known = {x for x in parts if x in NAMES}
        if known and all(x in NAMES or x in BESIDE for x in parts) and not (known == {"header"} and not OWN.isdisjoint(parts)):
            return True
    return False


def articles(e: Element) -> list[Element]:
    """The outermost marked articles outside boilerplate."""
    out, held = [], [e]
    while held:
        x = held.pop()
        if x.tag in ("article", "main") or x.names.get("role") in ("main", "article"):
            if not (x.names.get("role") in ROLES or any(re.search(r"comment|repl(?:y|ies)|related|promo|\bads?\b", x.names[k]) for k in ("class", "id") if k in x.names)):
                out.append(x)
            continue
        held += [c for c in reversed(x.children) if not isinstance(c, str) and not is_boilerplate(c)]
    return out


def subtree_hashes(root: Element) -> dict[int, int]:
    """By id() of each element that may be a template: the hash of its subtree, without boilerplate.

    Leaves without text can't be one, nor can what holds the whole text of its page or a marked article. Inside
    marked articles only block elements that hold at most half of the text are, unless they are prose or part of it.
    """
    marked = {id(x) for x in articles(root)}
    order: list[tuple[Element, Element | None, bool]] = []
    held: list[tuple[Element, Element | None, bool]] = [(root, None, False)]
    while held:  # parents before children, so that children are hashed first in reverse
        e, top, prose = held.pop()
        order.append((e, top, prose))
        top = e if id(e) in marked else top
        held += [(c, top, top is not None and (prose or c.tag in PROSE)) for c in e.children if not isinstance(c, str) and not is_boilerplate(c)]
    hashes: dict[int, int] = {}
    sizes: dict[int, int] = {}
    inside: dict[int, str] = {}
    holds = set(marked)
    for e, _, _ in reversed(order):
        parts = [" ".join(c.split()) if isinstance(c, str) else inside.pop(id(c), "") for c in e.children]
        body = "\x1f".join(p for p in parts if p)
        sizes[id(e)] = sum(len(p) if isinstance(c, str) else sizes.get(id(c), 0) for c, p in zip(e.children, parts, strict=True))
        if any(id(c) in holds for c in e.children if not isinstance(c, str)):
            holds.add(id(e))
        if body and e.tag != "#root":
            h = xxh3_64_intdigest(f"{e.tag}\x1e{e.names.get('class', '')}\x1e{e.names.get('id', '')}\x1e{body}".encode("utf-8", "surrogatepass"))
            hashes[id(e)] = h - (1 << 64) if h >> 63 else h
            inside[id(e)] = f"{h:016x}"
    free = lambda e, top, prose: sizes[id(e)] < sizes[id(root)] if top is None else e.tag in BLOCKS and not prose and 2 * sizes[id(e)] <= sizes[id(top)]
    return {id(e): hashes[id(e)] for e, top, prose in order if id(e) in hashes and id(e) not in holds and free(e, top, prose)}


def descendants(e: Element) -> Iterator[Element]:
    """In page order, without boilerplate and what headings hold."""
    held = list(reversed(e.children))
    while held:
        x = held.pop()
        if not isinstance(x, str) and not is_boilerplate(x):
            yield x
            if x.tag not in HEADINGS:
                held += reversed(x.children)


def main_text(html: str, templates: frozenset[int] | set[int] = frozenset()) -> str:
    """Blocks of the page's content in order, joined by an empty line."""
    return text_of(parsed(html), templates)


def text_of(root: Element, templates: frozenset[int] | set[int] = frozenset()) -> str:
    hashes = subtree_hashes(root) if templates else {}
    marked = articles(root)
    tops = marked or [root]
    top = {id(x) for x in tops}
    blocks, words = [], []

    def end_block() -> None:
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            blocks.append(text)

    held: list = list(reversed(tops))
    while held:
        x = held.pop()
        if x is None:
            end_block()
        elif isinstance(x, str):
            words.append(x)
        elif x.tag == "header" and marked and id(x) not in top:  # an article's own: its headings
            held += reversed([y for y in descendants(x) if y.tag in HEADINGS])
        elif (id(x) in top and x.tag not in DROPPED) or (not is_boilerplate(x) and hashes.get(id(x)) not in templates):
            if x.tag == "br":
                words.append(" ")
            elif x.tag in BLOCKS or id(x) in top or x.tag == "#root":
                end_block()
                held.append(None)
                held += reversed(x.children)
            else:
                held += reversed(x.children)
    end_block()
    return "\n\n".join(blocks)


def host(url: str = "url") -> Column:
    """The lower-case host of an address; null if it has none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def templates(pages: DataFrame, least_pages: int = 5) -> tuple[DataFrame, DataFrame]:
    """(host, hash) of the subtrees that stand on at least so many pages of different texts of their host, and (host, hash, html_hash) of every subtree."""
    source = pages.select(host().alias("host"), "html", F.xxhash64("html").alias("html_hash"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "html", 4 << 20):
            found: set[tuple] = set()
            for name, html, page in zip(batch.column("host").to_pylist(), strings(batch.column("html")), batch.column("html_hash").to_pylist(), strict=True):
                root = parsed(html)
                text = xxh3_64_intdigest(text_of(root).encode("utf-8", "surrogatepass"))  # copies have the same
                found.update((name, h, text - (1 << 64) if text >> 63 else text, page) for h in subtree_hashes(root).values())
            rows = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))], names=["host", "hash", "text", "html_hash"])

    subtrees = written(source.mapInArrow(task, "host string, hash bigint, text bigint, html_hash bigint"), "subtrees")
    counted = subtrees.select("host", "hash", "text").distinct().groupBy("host", "hash").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    return written(counted.select("host", "hash"), "templates"), subtrees.select("host", "hash", "html_hash")


def extract(pages: DataFrame, least_pages: int = 5) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""
    found, subtrees = templates(pages, least_pages)
    source = pages.select("page_id", "url", "html", host().alias("_host"))
    by_host: dict[str | None, set[int]] | None = None
    if found.count() <= MOST_BROADCAST:
        by_host = {}
        for r in found.collect():
            by_host.setdefault(r["host"], set()).add(r["hash"])
        source = source.withColumn("hashes", F.lit(None).cast("array<bigint>"))
    else:  # of each page, those templates that stand on it
        same = subtrees["host"].eqNullSafe(found["host"]) & (subtrees["hash"] == found["hash"])
        own = subtrees.distinct().join(found, same, "left_semi").groupBy(F.col("host").alias("of"), "html_hash").agg(F.collect_list("hash").alias("hashes"))
        source = source.join(own, F.col("_host").eqNullSafe(F.col("of")) & (F.xxhash64("html") == F.col("html_hash")), "left")
    source = source.select("page_id", "url", "html", "_host", "hashes")
    shared = pages.sparkSession.sparkContext.broadcast(by_host)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_host = shared.value
        for batch in chunks(batches, "html", 4 << 20):
            known = [by_host.get(x, ()) for x in batch.column("_host").to_pylist()] if by_host is not None else [frozenset(x or ()) for x in batch.column("hashes").to_pylist()]
            texts = [main_text(html, hashes) for html, hashes in zip(strings(batch.column("html")), known, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(task, "page_id bigint, url string, text string, n_chars bigint")
