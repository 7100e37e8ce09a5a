"""Main text of web pages, with site templates removed.

A page is parsed to a tree. Its element subtrees are hashed (tag, text and children, with the host), before any rule is
looked at: containers everywhere, and on pages without an article every element. Each block of pages gives one row for
each distinct subtree and main text, and Spark counts the distinct main texts that a subtree comes with, so that copies of
a page count once. A subtree that comes with PAGES main texts of its host is template and goes, however many pages the
host has. One that holds most of its page's main text stays, and what is inside it goes only if it recurs as often without
it. Paragraphs and headings inside an article stay, since articles may share passages.

What the count cannot see, furniture of pages that are the only ones with it, goes by rule: navigation, headers, footers,
asides, forms, scripts, styles, notices, adverts and reader comments, by tag, role or exact class name. What is left of
the article elements (else of main, else of the body) is the main text. Pages without a recurring subtree in their main
text are done after the first pass; the others are parsed again.

The text has one line per block, in page order; a removed block ends a line, a removed inline element does not.

Defined results: null or empty html gives empty text; null ids are ids like others; unclosed and misnested tags are closed
where a browser would close them; text outside any tag is text of the body; repeated rows each get their row and count as
one page; pages whose url is null or has no :// are of one host; pages of any length are read whole; further columns may
have any name; empty tables give no rows.
"""

from __future__ import annotations

import gc
import re
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import deliver, few, keyed, materialize, pack, shards_for, to_bytes

#: A subtree is template from so many distinct main texts of its host.
PAGES = 5
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
DROP = frozenset("applet aside audio button canvas datalist dialog embed footer form frame frameset head iframe input map menu nav noframes noscript object option script select style svg template textarea title video".split())
#: Elements without a text of the page.
SILENT = frozenset("applet audio canvas embed frame frameset head iframe map noframes noscript object script style svg template textarea title video".split())
CONTAINER = frozenset("div section ul ol dl table figure header footer nav aside form details menu".split())
#: Class names and ids, whole, of menus, sidebars, notices, adverts and reader comments; and of headers and footers,
#: which count outside the article only.
_NAMES = re.compile(
    r"(main-|site-|top-|side-|footer-|header-|primary-)?(nav|navbar|navigation|menu|breadcrumbs?|pager|pagination)(-(bar|list|menu|links|top|bottom))?|(left-|right-|site-|page-)?sidebar(-(left|right|box))?"
    r"|(cookies?|consent|gdpr)(-(bar|banner|notice|consent|popup|message|box))?|(site-|page-|legal-|copyright-)?(notices?|disclaimer)|(page-|site-|top-)?banner|popup|modal"
    r"|(google-|banner-|top-|bottom-|side-|inline-|display-)?(ads?|adverts?|advertisements?|advertising|sponsor|sponsored|promo|promoted)(-(box|slot|banner|unit|container|wrapper|block))?|adbox"
    r"|(reader-|user-|article-|post-)?comments?(-(list|section|area|form|thread|body|box|item|container))?|comments-(list|section|area)|disqus(-thread)?"
)
_ENDS = re.compile(r"(site-|page-|global-|main-)?(header|footer|masthead)")
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: An opening tag closes open elements of these kinds, up to the nearest of the second kind.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}


class Node:
    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag, attrs=(), parent=None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("html")

    def updatepos(self, i, j):  # line numbers aren't used
        return j

    def _close(self, tags, until):
        node = found = self.at
        while node is not None and node.tag not in until:
            if node.tag in tags:
                found = node
                self.at = found.parent or found
                return
            node = node.parent

    def handle_starttag(self, tag, attrs):
        if tag == "html":
            return
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        elif tag in BLOCK or tag == "hr":
            self._close({"p"}, {"td", "th", "table", "button", "object"})
            if tag[0] == "h" and tag[1:].isdigit() and self.at.tag[0] == "h" and self.at.tag[1:].isdigit():
                self.at = self.at.parent
        if tag == "body":
            self._close({"head"}, set())
        node = Node(tag, attrs, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if tag in VOID or tag == "html":
            return
        node = self.at
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        if data:
            self.at.children.append(data)


def parse(html: object) -> Node:
    b = _Builder()
    if isinstance(html, str) and html:
        b.feed(html)
        if b.rawdata:
            try:
                b.close()
            except AssertionError:  # a cut-off declaration
                pass
    return b.root


@lru_cache(100_000)
def is_furniture(tag: str, attrs: tuple, inside: bool) -> bool:
    """Whether a rule removes the element. A header inside an article is part of it."""
    if tag in DROP or (tag == "header" and not inside):
        return True
    if tag in ("html", "body", "main"):
        return False
    for name, value in attrs:
        if not value:
            if name == "hidden":
                return True
            continue
        if name in ("class", "id"):
            for one in value.lower().replace("_", "-").split():
                if _NAMES.fullmatch(one) or not inside and _ENDS.fullmatch(one):
                    return True
        elif name == "role" and value.lower() in _ROLES or name == "aria-hidden" and value.lower() == "true":
            return True
    return False


class Layout:
    """The elements that hold a page's main text, and those within that rules remove."""

    def __init__(self, root: Node):
        self.root = root
        self.removed: set[int] = set()
        roots, mains = [], []
        stack: list[tuple[Node, object]] = [(root, False)]
        while stack:
            node, inside = stack.pop()
            if is_furniture(node.tag, tuple(node.attrs), bool(inside)):
                self.removed.add(id(node))
                continue
            here = node.tag in ("article", "main") or (node.attrs and any(n == "role" and v in ("main", "article") for n, v in node.attrs))
            if node.tag == "article" and inside != "article":
                roots.append(node)
            elif here and node.tag != "article":
                mains.append(node)
            stack += [(c, "article" if node.tag == "article" or inside == "article" else inside or here) for c in reversed(node.children) if isinstance(c, Node)]
        self.inside = bool(roots or mains)
        self.tops = roots or mains[:1] or [root]

    def text(self, without: set[int] = frozenset()) -> str:
        """One line per block; without: ids (of Node) of further elements to leave out."""
        blocks: list[str] = []
        parts: list[str] = []

        def flush():
            if line := " ".join("".join(parts).split()):
                blocks.append(line)
            parts.clear()

        for top in self.tops:
            todo: list = [top]
            while todo:
                x = todo.pop()
                if x is None:
                    flush()
                elif isinstance(x, str):
                    parts.append(x)
                elif x.tag == "br":
                    parts.append(" ")
                elif x.tag in BLOCK or x.tag == "hr":
                    flush()
                    if id(x) not in self.removed and id(x) not in without:
                        todo.append(None)
                        todo += reversed(x.children)
                elif id(x) not in self.removed and id(x) not in without:
                    todo += reversed(x.children)
            flush()
        return "\n".join(blocks)

    def may_go(self, node: Node) -> bool:
        return node.parent is not None and node.tag not in ("body", "article", "main") and (not self.inside or node.tag in CONTAINER)

    def subtrees(self) -> list[tuple[Node, int, int, bool]]:
        """(element, hash, characters of text, whether it is in the main text) for the elements with text that may be
        template, children first."""
        out: list[tuple[Node, int, int, bool]] = []
        known: dict[int, tuple[int, int]] = {}
        tops = set(map(id, self.tops))
        order: list[tuple[Node, bool]] = []
        todo = [(self.root, False)]
        while todo:
            node, live = todo.pop()
            live = (live or id(node) in tops) and id(node) not in self.removed
            order.append((node, live))
            todo += [(c, live) for c in node.children if isinstance(c, Node) and c.tag not in SILENT]
        for node, live in reversed(order):
            h, size = xxhash.xxh64(node.tag), 0
            for c in node.children:
                if isinstance(c, Node):
                    if id(c) in known:
                        k, more = known.pop(id(c))
                        h.update(b"\0" + k.to_bytes(8, "little"))
                        size += more
                elif text := " ".join(c.split()):
                    h.update(b"\1" + text.encode("utf-8", "surrogatepass"))
                    size += len(text) + 1
            known[id(node)] = h.intdigest(), size
            if size and self.may_go(node):
                out.append((node, *known[id(node)], live))
        return out


def main_text(root: Node, template: set[int] = frozenset()) -> str:
    return Layout(root).text(template)


def host_of(url: object) -> str:
    if not isinstance(url, str) or "://" not in url:
        return ""
    return re.split(r"[/?#]", url.split("://", 1)[1], maxsplit=1)[0].lower()


def host_key(url: object) -> int:
    return xxhash.xxh64_intdigest(to_bytes(host_of(url)) + b"\0")


def _parsed(table: pa.Table) -> pa.Table:
    """First pass over a block: main texts before templates go, and the keys of their subtrees.

    The html itself is kept only where there is a subtree in the main text that may be template.
    """
    texts, keys, kept = [], [], []
    gc.disable()  # a block's trees are small and go together
    for url, html in zip(table["url"].to_pylist(), table["html"].to_pylist()):
        layout = Layout(parse(html))
        own = host_key(url)
        subs = layout.subtrees()
        live = {h ^ own for _, h, _, x in subs if x}
        rest = {h ^ own for _, h, _, x in subs if not x} - live
        texts.append(layout.text())
        keys.append((np.fromiter(live, np.uint64, len(live)).tobytes(), np.fromiter(rest, np.uint64, len(rest)).tobytes()))
        kept.append(html if live else None)
    gc.enable()
    gc.collect()
    live, rest = ([k[i] for k in keys] for i in range(2))
    return pa.table({"id": table["id"], "url": table["url"], "html": pa.array(kept, pa.string()), "text": pa.array(texts, pa.string()), "live": pa.array(live, pa.binary()), "rest": pa.array(rest, pa.binary())})


def _recurring(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs of a subtree's key and the hash of a main text that it comes with."""
    pairs = set()
    for text, live, rest in zip(table["text"].to_pylist(), table["live"].to_pylist(), table["rest"].to_pylist()):
        t = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
        pairs.update((k, t) for k in np.frombuffer(live + rest, np.uint64).tolist())
    rows = np.array(list(pairs), np.uint64).reshape(-1, 2)
    return np.ascontiguousarray(rows[:, 0]).view(np.int64), np.ascontiguousarray(rows[:, 1]).view(np.int64)


def templates(layout: Layout, subs: list, text: str, common: dict[int, int], limit: float) -> set[int]:
    """ids (of Node) of the subtrees that are template; text: the page's main text, common: main texts by subtree."""
    gone: set[int] = set()
    # how often the nearest enclosing subtree that was spared recurs; parents come before children
    spared: dict[int, int] = {}
    for node, k, size in reversed(subs):
        n, above = common.get(k, 0), node.parent
        while above is not None and id(above) not in spared:
            above = above.parent
        known = spared[id(above)] if above is not None else 0
        if n - known >= limit:
            if 2 * size > len(text) > 0 and 2 * (len(text) - len(layout.text({id(node)}))) > len(text):
                spared[id(node)] = n
            else:
                gone.add(id(node))
    return gone


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = PAGES) -> DataFrame:
    """One row per page: id, url, text, n_chars, n_template (distinct subtrees that are template)."""
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    packed = pack(rows, ["id", "url", "html"], "html-blocks", fn=_parsed)
    asked = keyed(packed, _recurring, "key long, page long")
    total = asked.select("key", "page").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    total = materialize(total, "html-subtrees")
    back = asked.select("b", "key").distinct().join(few(total), "key")

    def finish(table, got):
        common = dict(zip(got["key"].to_numpy().view(np.uint64).tolist(), got["n"].to_pylist()))
        texts, gone_of = [], []
        for url, html, text, live, rest in zip(*(table[c].to_pylist() for c in ("url", "html", "text", "live", "rest"))):
            n = sum(k in common for k in np.frombuffer(rest, np.uint64).tolist())
            if any(k in common for k in np.frombuffer(live, np.uint64).tolist()):
                own = host_key(url)
                layout = Layout(parse(html))
                subs = [(node, h ^ own, size) for node, h, size, x in layout.subtrees() if x]
                gone = templates(layout, subs, text, common, least)
                n += len({k for node, k, _ in subs if id(node) in gone})
                text = layout.text(gone) if gone else text
            texts.append(text)
            gone_of.append(n)
        return {"id": table["id"], "url": table["url"], "text": texts, "n_chars": [len(t) for t in texts], "n_template": gone_of}

    return deliver(packed, back, finish, f"id {kind}, url string, text string, n_chars long, n_template long", shards_for(packed)).withColumnRenamed("id", id_col)
