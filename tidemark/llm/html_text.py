"""Operator 10, main text of web pages by removal of site templates.

Every page is parsed once to a tree of its block elements, each with a hash of its subtree (tags and texts), and the text blocks
in them. Spark counts in how many different pages of a host each subtree occurs (copies of a page count once, for their content
recurs too). On every page the subtrees that recur on ``LEAST_PAGES`` pages of its host are template and go with all they
hold, whatever their tags and names say. What is left is the page's own; there, elements that say what they are (menus, footers,
sidebars, adverts, forms, scripts, comments and the like) go by tag, role, class or id, since a menu or an advert may be
different on each page and a host may have too few pages. Of the rest, the text of the page's article or main element is
taken if it has one.

What holds the main part never goes: neither an article nor what is around it is looked up among the templates. On a page without
an article the smallest element with half of the text that no name takes away, links aside, stands for it. Inside, only what is
navigation is looked up, containers and lists with more than half of their text in links: prose and data that other pages share, a
passage, a table or a section, are the page's too. So an article that any number of pages share stays on all of them. A form around an
article, or with most of its text, is no form to fill in.

Parsing is linear in the page: elements have links to their parents, and what is asked of the open elements is kept by tag.

Defined results: a null or empty html has an empty text; a null url or one without a host belongs to the host ""; an empty
table gives an empty result; repeated rows are one page to the counts, and each gets its text; where all blocks of a page would
go as template they stay, and where names would leave nothing of an article its class and id names are not heard; an unclosed
comment or declaration ends at the next ">", an unclosed script at the end; a "<" that starts no tag is text; further
columns are not read.
"""

from __future__ import annotations

import html as html_module
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialise, table, text_slices

#: A subtree is template if it is on at least so many different pages of its host.
LEAST_PAGES = 3

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
HARD = frozenset("head title script style noscript template iframe object svg button select textarea canvas audio video".split())
#: Those of them that stand within a line: they end no block.
INLINE_HARD = HARD - frozenset(("head", "title"))
#: Links to a place of the same page that let a reader pass over the menus.
SKIP_LINK = re.compile(r"\s*(?:skip|jump|go) (?:directly |straight )?to (?:the )?(?:main|content|article|navigation|search|footer)\b", re.IGNORECASE)
#: Elements that are not the main part, unless they hold it.
SOFT = frozenset("nav footer aside form dialog menu".split())
RAW, TEXT_ONLY = frozenset("script style iframe noembed noframes xmp".split()), frozenset("title textarea".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar".split())
#: A class or id says what its element is if all its parts of two letters or more (between hyphens, underscores and digits) are of these two lists and one of the first.
DROPPED_NAMES = frozenset(
    "ad ads adbox advert adverts advertisement advertising adslot adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr "
    "masthead menu modal nav navbar navigation navmenu newsletter notice notices overlay pagination paywall popup promo promotion related respond share sharing sidebar signup "
    "skip social sponsor sponsored subscribe toolbar".split()
)
NEUTRAL_NAMES = frozenset(
    "all and area article articles bar block body bottom box buttons by col column container content count footer form from global google group header icons in inner item items js large latest leaderboard left "
    "link links list main media medium more new of our outer page panel post posts primary public rail reader readers recent rectangle region reply row secondary section site skyscraper slot small sticky stories story the thread to "
    "top unit user users visitor visitors widget wrap wrapper your zone".split()
)
#: Names are heard on these; a paragraph or heading is text whatever its class.
NAMED_TAGS = frozenset("div section ul ol dl table tbody tr td span header article details figure fieldset address center".split())
PARTS = re.compile(r"[^a-z]+")
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li "
    "main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements of an article that may be template, if over half of their text is links.
CONTAINERS, LISTS = frozenset("address aside center details dialog div fieldset figure footer form menu nav section table".split()), frozenset("dl ol ul".split())
#: A start tag of the key closes an open element of the values, up to the nearest of the stops.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = frozenset("html body article main section div ul ol dl table td th blockquote aside nav footer header form figure".split())
#: End tags of other elements do not close these.
WALLS = frozenset(("article", "main", "body"))

NAME = re.compile(r"[A-Za-z][^\s/>]*")
STOP = re.compile(r"[>\"']")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'=<>`]+)))?""")
CLOSING = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.IGNORECASE) for tag in RAW | TEXT_ONLY}


def lexed(page: str) -> Iterator[tuple[str, str, str]]:
    """("text", data, ""), ("start", tag, attributes) and ("end", tag, "") of a page, in order; each character is looked at a fixed number of times."""
    at, last = 0, page.rfind(">")
    unclosed: set[str] = set()
    while True:
        lt = page.find("<", at)
        if lt < 0 or lt > last:
            yield "text", page[at:], ""
            return
        if lt > at:
            yield "text", page[at:lt], ""
        name = NAME.match(page, lt + 2 if page.startswith("/", lt + 1) else lt + 1)
        if name is None:
            if page.startswith(("!", "?", "/"), lt + 1):
                close = page.find("-->", lt + 4) if page.startswith("<!--", lt) and "-->" not in unclosed else -1
                if close < 0 and page.startswith("<!--", lt):
                    unclosed.add("-->")
                at = close + 3 if close >= 0 else page.find(">", lt) + 1
            else:
                yield "text", "<", ""
                at = lt + 1
            continue
        i = name.end()
        while True:
            stop = STOP.search(page, i)
            i = stop.end() if stop else last + 1
            if stop is None or stop.group() == ">":
                break
            quote = stop.group()
            # A quote opens a value only after "=", and only if it is closed.
            if quote not in unclosed and page[max(0, stop.start() - 20) : stop.start()].rstrip().endswith("="):
                close = page.find(quote, i)
                if close < 0:
                    unclosed.add(quote)
                else:
                    i = close + 1
        tag, at = name.group().lower(), i
        if page[lt + 1] == "/":
            yield "end", tag, ""
            continue
        yield "start", tag, page[name.end() : i - 1]
        if tag in RAW or tag in TEXT_ONLY and tag not in unclosed:
            end = CLOSING[tag].search(page, at)
            if end is None and tag in TEXT_ONLY:
                unclosed.add(tag)
                continue
            until = end.start() if end else len(page)
            if tag in TEXT_ONLY:
                yield "text", page[at:until], ""
            at = until


class Node:
    """An element that breaks text into blocks or says what it is."""

    __slots__ = ("tag", "parent", "hard", "soft", "named", "main", "digest", "hash", "chars", "links")

    def __init__(self, tag: str, parent: int, hard: bool, soft: bool, named: bool, main: bool):
        self.tag, self.parent, self.hard, self.soft, self.named, self.main = tag, parent, hard, soft, named, main
        self.digest, self.hash, self.chars, self.links = xxhash.xxh64(tag), 0, 0, 0


class Page:
    """The tree of a page: ``nodes`` in document order (the first is the page itself) and ``blocks``, (node, text)."""

    def __init__(self, page: str):
        self.nodes = [Node("", -1, False, False, False, False)]
        self.blocks: list[tuple[int, str]] = []
        self.open = [0]
        self.text: list[str] = []
        #: Places in ``open`` of the open elements of a tag, of stops and of walls, outermost first.
        self.places: dict[str, list[int]] = {}
        self.stops: list[int] = []
        self.walls: list[int] = []
        self.in_link = False
        #: The element within a line whose content is no text, how many of the tag are open in it, and the other open tags in it.
        self.muted, self.depth, self.within = "", 0, Counter()
        #: Where in ``text`` an open link to a place of the page began.
        self.jump = -1
        for kind, value, attributes in lexed(page):
            if kind == "text":
                if self.muted:
                    continue
                self.text.append(value)
                if self.in_link:
                    self.nodes[self.open[-1]].links += len(value.strip())
            elif kind == "start":
                self.start(value, attributes)
            else:
                self.end(value)
        self.flush()
        self.close_to(1)

    def flush(self) -> None:
        words = html_module.unescape("".join(self.text)).split()
        self.text.clear()
        self.jump = -1
        if words:
            text, node = " ".join(words), self.nodes[self.open[-1]]
            node.digest.update("\x00" + text)
            node.chars += len(text)
            self.blocks.append((self.open[-1], text))

    def close_to(self, height: int) -> None:
        while len(self.open) > height:
            node = self.nodes[self.open.pop()]
            self.places[node.tag].pop()
            if node.tag in STOPS:
                self.stops.pop()
            if node.tag in WALLS:
                self.walls.pop()
            node.hash = node.digest.intdigest() - (1 << 63)
            node.digest = None
            above = self.nodes[node.parent]
            above.digest.update(f"\x01{node.hash}")
            above.chars += node.chars
            above.links += node.links

    def nearest(self, tags: tuple[str, ...]) -> int:
        return max((self.places[tag][-1] for tag in tags if self.places.get(tag)), default=0)

    def start(self, tag: str, attributes: str) -> None:
        if self.muted:
            if tag == self.muted:
                self.depth += 1
            elif tag not in VOID:
                self.within[tag] += 1
            return
        if tag in INLINE_HARD:
            if tag not in RAW:  # a raw one has no tags in it
                self.muted, self.depth = tag, 1
                self.within.clear()
            self.text.append(" ")
            return
        if tag in VOID:
            if tag == "hr":
                self.flush()
            elif tag in ("br", "img", "input"):
                self.text.append(" ")
            return
        self.in_link = self.in_link or tag == "a"
        values = {m[0].lower(): m[1] or m[2] or m[3] for m in reversed(ATTRIBUTE.findall(attributes))} if attributes and not attributes.isspace() else {}
        if tag == "a" and values.get("href", "").startswith("#"):
            self.jump = len(self.text)
        named = bool(values) and self.says_so(tag, values)
        if tag not in BLOCKS and tag not in HARD and tag not in SOFT and not named:
            return
        self.flush()
        closes = CLOSES.get(tag) or (("p",) if tag in BLOCKS else ())
        found = self.nearest(closes)
        if found and found >= (self.stops[-1] if self.stops else 0):
            self.close_to(found)
        main = tag in ("article", "main") or values.get("role", "").lower() == "main"
        height = len(self.open)
        self.nodes.append(Node(tag, self.open[-1], tag in HARD, tag in SOFT or tag == "header" and not self.in_main(), named, main))
        self.open.append(len(self.nodes) - 1)
        self.places.setdefault(tag, []).append(height)
        if tag in STOPS:
            self.stops.append(height)
        if tag in WALLS:
            self.walls.append(height)

    def in_main(self) -> bool:
        return bool(self.places.get("article") or self.places.get("main"))

    @staticmethod
    def says_so(tag: str, values: dict[str, str]) -> bool:
        if tag in ("html", "body", "main"):
            return False
        if values.get("role", "").lower() in DROPPED_ROLES or "hidden" in values or values.get("aria-hidden", "").lower() == "true" or "display:none" in values.get("style", "").replace(" ", "").lower():
            return True
        if tag in NAMED_TAGS:
            for name in f"{values.get('class', '')} {values.get('id', '')}".lower().split():
                parts = [p for p in PARTS.split(name) if len(p) > 1]
                if not DROPPED_NAMES.isdisjoint(parts) and all(p in DROPPED_NAMES or p in NEUTRAL_NAMES for p in parts):
                    return True
        return False

    def end(self, tag: str) -> None:
        if self.muted:
            if tag == self.muted:
                self.depth -= 1
                if not self.depth:
                    self.muted = ""
                return
            if self.within[tag]:
                self.within[tag] -= 1
                return
            if not self.nearest((tag,)):
                return
            self.muted = ""  # never closed: it ends with what it is in
        if tag == "a" and self.jump >= 0:
            if SKIP_LINK.match("".join(self.text[self.jump :])):
                del self.text[self.jump :]
            self.jump = -1
        if tag == "br":
            self.text.append(" ")
        self.in_link = self.in_link and tag != "a"
        found = self.nearest((tag,))
        if found and (tag in WALLS or tag == "html" or not self.walls or found > self.walls[-1]):
            self.flush()
            self.close_to(found)


#: What a node of the written tree is: it may be template; what its tag or name takes away; its block's text is the article's.
CANDIDATE, OUT, MAIN = 1, 2, 4


def page_tree(html: str) -> tuple[list[dict], list[dict]]:
    """Nodes as (parent, hash, flags) in document order, and blocks as (node, text) of the nodes that no name takes away."""
    page = Page(html)
    nodes = page.nodes
    count = len(nodes)
    # From the top: whether an element above takes a node away for its tag, and for tag or name.
    hard, out = [False] * count, [False] * count
    for i in range(1, count):
        n = nodes[i]
        hard[i] = hard[n.parent] or n.hard
        out[i] = out[n.parent] or n.hard or n.soft or n.named
    mains = [i for i in range(1, count) if nodes[i].main and not hard[i]]
    # An article in a sidebar is none of the page's, unless the page has no other; then what is around it is no sidebar.
    chosen = [i for i in mains if not out[i]] or mains
    around = [False] * count
    root = [0] * count
    for i in chosen:
        up = nodes[i].parent
        while up > 0 and not around[up]:
            around[up] = True
            up = nodes[up].parent
    picked = set(chosen)
    for i in range(1, count):
        root[i] = root[nodes[i].parent] or (i if i in picked else 0)

    def taken(names: bool) -> list[bool]:
        gone = [False] * count
        for i in range(1, count):
            n = nodes[i]
            soft = n.soft or names and n.named
            if soft and (around[i] or i == root[i] or n.tag == "form" and 2 * n.chars > nodes[root[i]].chars):
                soft = False
            gone[i] = gone[n.parent] or n.hard or soft
        return gone

    gone = taken(True)
    if chosen and not any(root[i] and not gone[i] for i, _ in page.blocks):
        gone = taken(False)
    main, holds = list(root), list(around)
    if not chosen:
        stand_in(nodes, page.blocks, gone, main, holds)
    flags = []
    for i in range(count):
        n = nodes[i]
        inside = main[i] and i != main[i]
        navigation = (n.tag in CONTAINERS or n.tag in LISTS) and 2 * n.links > n.chars
        may = i > 0 and not holds[i] and i != main[i] and n.tag not in ("html", "body") and (not inside or navigation)
        flags.append(CANDIDATE * bool(may) | OUT * gone[i] | MAIN * bool(root[i]))
    return [{"parent": n.parent, "hash": n.hash, "flags": f} for n, f in zip(nodes, flags)], [{"node": i, "text": text} for i, text in page.blocks if not gone[i]]


def stand_in(nodes: list[Node], blocks: list[tuple[int, str]], gone: list[bool], main: list[int], holds: list[bool]) -> None:
    """For a page without an article: note the smallest element with half of the text that is left, links aside, as the ``main`` of all in it, and what ``holds`` it."""
    count = len(nodes)
    links = [n.links for n in nodes]  # an element's own links, without those of the elements in it
    for n in nodes[1:]:
        links[n.parent] -= n.links
    left = [0] * count
    for i, text in blocks:
        if not gone[i]:
            left[i] += len(text)
    left = [max(0, t - k) if t else 0 for t, k in zip(left, links)]
    for i in range(count - 1, 0, -1):
        left[nodes[i].parent] += left[i]
    at = max((i for i in range(1, count) if left[i] and 2 * left[i] >= left[0]), default=0)
    if not at:
        return
    # Of two elements with half of the text one is in the other, or they are the two halves: then what holds both is the main part.
    up = nodes[at].parent
    if 2 * left[at] == left[0] and any(2 * left[i] == left[0] for i in range(1, count) if i != at and nodes[i].parent == up):
        at = up
    for i in range(at, count):
        if i == at or main[nodes[i].parent] == at and at:
            main[i] = at
    up = nodes[at].parent if at else -1
    while up >= 0:
        holds[up] = True
        up = nodes[up].parent


def main_text(nodes: list[dict], blocks: list[dict], templates: set[int]) -> tuple[str, int]:
    """The text of a page without the subtrees that are ``templates`` (their places among the candidates), and the number of topmost ones."""
    gone, number, place = [False] * len(nodes), 0, -1
    for i, n in enumerate(nodes):
        place += n["flags"] & CANDIDATE
        if i and gone[n["parent"]]:
            gone[i] = True
        elif n["flags"] & CANDIDATE and place in templates:
            gone[i], number = True, number + 1
    kept = [b for b in blocks if not gone[b["node"]]] or blocks
    main = [b for b in kept if nodes[b["node"]]["flags"] & MAIN]
    return "\n\n".join(b["text"] for b in main or kept), number


PLACES = np.dtype([("parent", "<i4"), ("flags", "u1")])


def packed(nodes: list[dict], blocks: list[dict]) -> tuple[bytes, bytes]:
    """The tree, and the blocks' texts, compressed; no block holds a line break."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    tree = np.fromiter(((n["parent"], n["flags"]) for n in nodes), PLACES, len(nodes))
    where = np.fromiter((b["node"] for b in blocks), "<i4", len(blocks))
    return squeeze(len(nodes).to_bytes(4, "little") + tree.tobytes() + where.tobytes()), squeeze("\n".join(b["text"] for b in blocks).encode("utf-8", "surrogatepass"))


def unpacked(tree: bytes, texts: bytes) -> tuple[list[dict], list[dict]]:
    expand = zstandard.ZstdDecompressor().decompress
    tree, texts = expand(tree), expand(texts).decode("utf-8", "surrogatepass")
    end = 4 + int.from_bytes(tree[:4], "little") * PLACES.itemsize
    nodes = [{"parent": p, "flags": f} for p, f in np.frombuffer(tree[4:end], PLACES).tolist()]
    where = np.frombuffer(tree[end:], "<i4").tolist()
    return nodes, [{"node": i, "text": t} for i, t in zip(where, texts.split("\n"))]


def parse_pages(rows: DataFrame) -> DataFrame:
    """(uid, host, keep, html) to (uid, host, keep, page, hashes, tree, texts).

    ``page`` is a hash of the texts that no name takes away, ``hashes`` those of the subtrees that may be template, in order.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, pages in text_slices(batches, "html", 500_000):
            page, hashes, cells = [], [], []
            for nodes, blocks in map(page_tree, pages):
                page.append(xxhash.xxh64_intdigest("\n".join(b["text"] for b in blocks)) - (1 << 63))
                hashes.append([n["hash"] for n in nodes if n["flags"] & CANDIDATE])
                cells.append(packed(nodes, blocks))
            trees, texts = zip(*cells)
            yield pa.RecordBatch.from_arrays(
                [batch.column("uid"), batch.column("host"), batch.column("keep"), pa.array(page, pa.int64()), pa.array(hashes, pa.list_(pa.int64())), pa.array(trees, pa.binary()), pa.array(texts, pa.binary())],
                ["uid", "host", "keep", "page", "hashes", "tree", "texts"],
            )

    keep = rows.schema["keep"].dataType.simpleString()
    return rows.mapInArrow(parse, f"uid long, host string, keep {keep}, page long, hashes array<bigint>, tree binary, texts binary")


def recurring_subtrees(subtrees: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(host, page, hash) to the (host, hash) on at least so many different pages of the host."""
    # Distinct first: a subtree on every page of a large host is counted by all tasks.
    each = subtrees.select("host", "hash", "page").distinct()
    return each.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_pages).select("host", "hash")


def extract(pages: DataFrame, carry: list[str], least_pages: int = LEAST_PAGES) -> DataFrame:
    """The ``carry`` columns of each page with text, n_chars and n_templates, the number of its subtrees that went as template."""
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    rows = pages.select(
        F.monotonically_increasing_id().alias("uid"), host.alias("host"), F.struct(*[F.col(f"`{c}`") for c in carry]).alias("keep"), "html"
    )
    parsed = materialise(parse_pages(rows), "page-trees")
    subtrees = parsed.select("uid", "host", "page", F.posexplode("hashes").alias("place", "hash"))
    recurring = materialise(recurring_subtrees(subtrees, least_pages), "page-templates")
    found = subtrees.join(recurring, ["host", "hash"]).groupBy("uid").agg(F.collect_list("place").alias("templates"))
    joined = parsed.select("uid", "keep", "tree", "texts").join(found, "uid", "left").select("keep", "tree", "texts", "templates")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 200):
                part = batch.slice(a, 200)
                texts, numbers = [], []
                for tree, cell, templates in zip(part.column("tree"), part.column("texts"), part.column("templates")):
                    text, number = main_text(*unpacked(tree.as_py(), cell.as_py()), set(templates.as_py() or ()))
                    texts.append(text)
                    numbers.append(number)
                yield pa.RecordBatch.from_arrays([part.column("keep"), pa.array(texts, pa.string()), pa.array(numbers, pa.int64())], ["keep", "text", "n_templates"])

    keep = joined.schema["keep"].dataType.simpleString()
    return joined.mapInArrow(choose, f"keep {keep}, text string, n_templates long").select("keep.*", "text", F.char_length("text").cast("long").alias("n_chars"), "n_templates")


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), ["page_id", "url"])


QUERIES = {"op10_html_text": op10_html_text}
ORACLE: dict[str, str] = {}
