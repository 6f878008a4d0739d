"""Main text of web pages: site templates are found across pages of a host and removed.

Two passes over the pages. The first parses each page, hashes every element subtree (tag, marks,
text and children) and, of elements whose class or id holds a name that boilerplate often has, the
shape (tag and marks alone); it emits each distinct hash once a page. Spark counts different pages
per (host, hash), copies of a page (equal but for references to other places) as one, first by page,
so a host with a third of all pages spreads by its subtrees and pages. What is on at least `share`
of its host's different pages, and on `at_least` of them or more, is a template; an article or main
element never is as a whole. The second pass parses again and deletes

* subtrees that are templates;
* elements that HTML defines as other than main text (menus, headers, footers, asides, forms,
  scripts, styles), by element name, ARIA role or being hidden;
* elements one of whose class or id words is, whole, a name of adverts, notices, sidebars, reader
  comments and the like, and those that only contain such a name if their shape is a template;
  never a wrapper of the article: what holds an article or main element, or (a whole word)
  OUTRIGHT of the page's text, (a part) HALF of it, stays;

and joins the blocks of the articles, of the main element, or else of the body.

Templates are few a host (each page holds at most its own elements, so a host has no more than
elements a page / share); their table is broadcast up to BROADCAST_TEMPLATES rows, and joined by a
shuffle beyond.

Defined results: null and empty html give an empty text; a page without a host has no template;
unclosed, misnested and unknown elements are read as browsers do for their text, in time that grows
with the page, not with its square; repeated rows and copies count as one page of their host, and
each gets its text; a very long page is parsed whole, in memory of some 50 times its bytes; other
columns are not read, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tidewater.llm.blocks import row_blocks, texts
from tidewater.llm.storage import bounded, checkpointed, few
from tidewater.llm.urls import host_and_path

BROADCAST_TEMPLATES = 200_000

_NAMED = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[\"'>]")
_MARK = re.compile(r"""\b(class|id|role|style|aria-hidden|hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.IGNORECASE)
_NAME = re.compile(r"[a-z]+")

# Element names and name parts of HTML (fixed values).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead"), "tfoot": ("tbody", "thead")}
SCOPE = frozenset("ul ol dl table select body html article section main div".split())
NEVER = frozenset(
    "head title script style noscript template nav header footer aside form button input select textarea iframe object embed svg canvas dialog menu audio video map noembed noframes".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo banner cookie cookies consent gdpr notice notices nav navbar navigation menu sidebar header footer masthead breadcrumb breadcrumbs comment comments disqus newsletter subscribe popup modal share sharing social related widget".split()
)


#: Class words of reader comments, which may be longer than what they comment on.
COMMENTS = frozenset("comment comments disqus".split())
#: Shares of the page's text from which an element with a boilerplate name is taken for a wrapper.
OUTRIGHT, HALF = 0.9, 0.5
#: Quoted values that a tag is read for; one with more ends at its first ">".
QUOTED = 256
#: Stands for the page itself among the hashes of its subtrees.
PAGE = 0


class Node:
    __slots__ = ("tag", "marks", "children", "hash", "shape", "size", "main")

    def __init__(self, tag: str, marks: str):
        self.tag, self.marks, self.children, self.hash, self.shape, self.size, self.main = tag, marks, [], 0, 0, 0, False


def _tag_end(html: str, at: int, first: int, last: dict[str, int]) -> int:
    """Where the tag whose name ends at `at` has its ">", outside quoted values if those end; `first`
    is the first ">", `last` where the page's last quotes are."""
    for _ in range(QUOTED):
        m = _STOP.search(html, at)
        if not m:
            return first
        if m[0] == ">":
            return m.start()
        if last[m[0]] <= m.start():
            return first
        at = html.find(m[0], m.end()) + 1
    return first


class _Stack:
    """Open elements, and where in the stack those of a tag, scopes and blocks are: all questions of
    the parser are answered by the last entries."""

    def __init__(self) -> None:
        self.nodes = [Node("#root", "")]
        self.where: dict[str, list[int]] = {}
        self.scopes, self.blocks = [0], [0]

    def push(self, node: Node) -> None:
        at = len(self.nodes)
        self.nodes.append(node)
        self.where.setdefault(node.tag, []).append(at)
        if node.tag in SCOPE:
            self.scopes.append(at)
        if node.tag not in INLINE:
            self.blocks.append(at)

    def cut(self, at: int) -> None:
        """Closes the element at a place, and all in it."""
        while len(self.nodes) > at:
            node = self.nodes.pop()
            self.where[node.tag].pop()
            if node.tag in SCOPE:
                self.scopes.pop()
            if node.tag not in INLINE:
                self.blocks.pop()

    def end(self, tag: str) -> None:
        """An inline element ends inside its scope only."""
        if (held := self.where.get(tag)) and not (tag in INLINE and self.scopes[-1] > held[-1]):
            self.cut(held[-1])

    def begin(self, tag: str) -> None:
        """What an element's beginning ends: a paragraph, or siblings in the same scope."""
        if tag in CLOSES_P and self.nodes[self.blocks[-1]].tag == "p":
            self.cut(self.blocks[-1])
        if tag in SIBLINGS:
            scope = self.scopes[-1]
            if tag == "tr":
                inside = [held[k] for t in SIBLINGS[tag] if (held := self.where.get(t)) and (k := bisect_right(held, scope)) < len(held)]
                if inside:
                    self.cut(min(inside))
            elif (last := max((held[-1] for t in SIBLINGS[tag] if (held := self.where.get(t))), default=0)) > scope:
                self.cut(last)


def parse(html: str) -> Node:
    """The page's elements; texts between tags stay as written, character references included."""
    stack, pos, end, first = _Stack(), 0, len(html), -1
    last = {c: html.rfind(c) for c in "\"'>"}
    while pos < end:
        at = html.find("<", pos)
        if at < 0 or at > last[">"]:  # no tag ends any more
            stop = html.find("<!--", pos)
            stack.nodes[-1].children.append(html[pos : stop if stop >= 0 else end])
            break
        if at > pos:
            stack.nodes[-1].children.append(html[pos:at])
        if html.startswith("<!--", at):
            stop = html.find("-->", at + 4)
            pos = stop + 3 if stop >= 0 else end
            continue
        if first < at:
            first = html.find(">", at)
        m = _NAMED.match(html, at, first + 1)
        if not m:
            if html[at + 1] in "!?":
                pos = first + 1
            else:
                stack.nodes[-1].children.append("<")
                pos = at + 1
            continue
        stop = _tag_end(html, m.end(), first, last)
        pos, tag, marks = stop + 1, m[1].lower(), html[m.end() : stop]
        if html[at + 1] == "/":
            stack.end(tag)
            continue
        stack.begin(tag)
        node = Node(tag, marks)
        stack.nodes[-1].children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}\b[^>]*>|\Z", re.IGNORECASE).search(html, pos)
            node.children.append(html[pos : close.start()])
            pos = close.end()
        elif tag not in VOID and (not marks.endswith("/") or tag in INLINE | CLOSES_P):
            stack.push(node)  # a closing slash means nothing on an HTML element
    return stack.nodes[0]


@lru_cache(4096)
def _marks(marks: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "").lower() for m in _MARK.finditer(marks)}


def marked(node: Node) -> dict[str, str]:
    return _marks(node.marks) if node.marks else {}


def _is_main(node: Node) -> bool:
    if node.tag in ("article", "main"):
        return not node.marks or COMMENTS.isdisjoint(_NAME.findall(marked(node).get("class", "")))
    return "main" in node.marks and marked(node).get("role") == "main"


def other(node: Node) -> bool:
    """By its name, role or being hidden, the element is not part of a page's main text."""
    if node.tag in NEVER:
        return True
    if not node.marks:
        return False
    m = marked(node)
    return "hidden" in m or m.get("aria-hidden") == "true" or m.get("role") in ROLES or "display:none" in m.get("style", "").replace(" ", "")


def _named(node: Node) -> tuple[bool, bool]:
    """Whether a class or id word is a boilerplate name, and whether one contains such a name."""
    if not node.marks or node.tag in ("html", "body", "main"):
        return False, False
    m = marked(node)
    names = COMMENTS if node.tag == "article" else NAMES
    listed = m.get("class", "") + " " + m.get("id", "")
    return not names.isdisjoint(listed.split()), not names.isdisjoint(_NAME.findall(listed))


def hashed(node: Node, into: set[int]) -> int:
    """Measures the subtree's elements, deepest first: hash, shape (0 without a boilerplate name),
    size of the text outside elements that are other than main text, and whether a main element is
    in it. Hashes of elements that hold text, and shapes, go to `into`. Marks and text count;
    references to other pages and places do not."""
    todo = [(node, iter(node.children), [node.tag])]
    while todo:
        here, rest, parts = todo[-1]
        for child in rest:
            if isinstance(child, str):
                if text := " ".join(child.split()):
                    parts.append(text)
                    here.size += len(text)
            else:
                todo.append((child, iter(child.children), [child.tag, *[f"{k}={v}" for k, v in marked(child).items()]]))
                break
        else:
            todo.pop()
            marks = 0 if here is node else len(marked(here))
            full = len(parts) > 1
            here.hash = _digest(parts)
            if _named(here)[1]:
                here.shape = _digest(["#shape", *parts[: 1 + marks]])
                into.add(here.shape)
            if full and here.tag not in ("#root", "html", "body", "article", "main") and not _is_main(here):
                into.add(here.hash)
            if todo:
                up = todo[-1][0]
                up.main |= here.main or _is_main(here)
                if full:
                    todo[-1][2].append(f"{here.hash:x}")
                if not other(here):
                    up.size += here.size
    return node.hash


def _digest(parts: list[str]) -> int:
    return int.from_bytes(xxhash.xxh64_digest("\x1f".join(parts)), "big", signed=True)


def boilerplate(node: Node, page: int, templates: frozenset[int]) -> bool:
    """Whether the element goes, on a page with so much text."""
    if node.hash in templates or other(node):
        return True
    word, part = _named(node)
    if not part or node.main:
        return False
    if word:
        return node.size < OUTRIGHT * page or not COMMENTS.isdisjoint(_NAME.findall(marked(node).get("class", "")))
    return node.shape in templates and node.size <= HALF * page


def _find(node: Node, wanted: Callable[[Node], bool], goes: Callable[[Node], bool]) -> list[Node]:
    """The outermost elements that are wanted, outside those that go."""
    out, todo = [], [node]
    while todo:
        n = todo.pop()
        if wanted(n):
            out.append(n)
        else:
            todo += [c for c in reversed(n.children) if not isinstance(c, str) and not goes(c)]
    return out


def main_text(root: Node, templates: frozenset[int]) -> str:
    """Blocks of the main content of a measured page, one a line."""
    goes = lambda n: boilerplate(n, root.size, templates)
    tops = _find(root, lambda n: n.tag == "article", goes) or _find(root, _is_main, goes) or [root]
    blocks, open_ = [], []

    def close() -> None:
        if text := " ".join(unescape("".join(open_)).split()):
            blocks.append(text)
        open_.clear()

    todo: list = list(reversed(tops))
    while todo:
        n = todo.pop()
        if n is None:
            close()
        elif isinstance(n, str):
            open_.append(n)
        elif goes(n):
            if n.tag not in INLINE:
                close()
        else:
            if n.tag == "br":
                open_.append(" ")
            inline = n.tag in INLINE
            if not inline:
                close()
                todo.append(None)
            todo += reversed(n.children)
    close()
    return "\n".join(blocks)


def text_of(html: str, templates: frozenset[int] = frozenset()) -> str:
    root = parse(html)
    hashed(root, set())
    return main_text(root, templates)


def _subtrees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in row_blocks(batch, "html"):
            page, found = [], []
            for raw in texts(block.column(1)):
                own: set[int] = {PAGE}
                page.append(hashed(parse(raw.decode()), own))
                found.append(sorted(own))
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(page, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["host", "page", "hashes"])


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block in row_blocks(batch, "html"):
            out = []
            for raw, templates in zip(texts(block.column(2)), block.column(3).to_pylist()):
                out.append(text_of(raw.decode(), frozenset(templates or ())))
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])


def site_templates(pages: DataFrame, share: float = 0.5, at_least: int = 10) -> DataFrame:
    """host, templates: hashes of the subtrees on `share` of the host's different pages and `at_least` of them."""
    host, _ = host_and_path(F.col("url"))
    hosted = pages.select(host.alias("host"), "html").where("host <> ''")
    counts = (
        hosted.mapInArrow(_subtrees, "host string, page long, hashes array<long>")
        .select("host", "page", F.explode("hashes").alias("hash"))
        .groupBy("host", "hash")
        .agg(F.count_distinct("page").alias("on"))
        .where(F.col("on") >= at_least)
    )
    counts = checkpointed(few(counts))
    totals = counts.where(F.col("hash") == PAGE).select("host", F.col("on").alias("pages"))
    often = counts.where(F.col("hash") != PAGE).join(totals, "host").where(F.col("on") >= F.col("pages") * share)
    return often.groupBy("host").agg(F.collect_list("hash").alias("templates"), F.count("*").alias("n"))


def extract_main_text(pages: DataFrame, share: float = 0.5, at_least: int = 10) -> DataFrame:
    """One row per page: page_id, url, text and n_chars."""
    templates = checkpointed(few(site_templates(bounded(pages), share, at_least)))
    small = (templates.agg(F.sum("n").alias("n")).first()["n"] or 0) <= BROADCAST_TEMPLATES
    host, _ = host_and_path(F.col("url"))
    rows = pages.select("page_id", "url", "html", host.alias("host"))
    table = templates.select("host", "templates")
    joined = rows.join(F.broadcast(table) if small else table, "host", "left").select("page_id", "url", "html", "templates")
    return joined.mapInArrow(_extract, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
