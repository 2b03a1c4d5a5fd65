"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree whose nodes are element paths (tag, classes, id); the
elements of one path on a page, such as the paragraphs of an article, are one node with all their text. Over
the distinct pages that have a node, its importance mixes two entropies, each between 0 and 1:
presentation (how varied the sequences of child elements are) and content (how varied its text is).
A branch that looks and reads the same everywhere is template, and goes; so does a text block that a good part of the
host's pages repeat. Copies of a page count once, and so do near copies (pages of mostly the same repeated blocks), so
that two pages of their own are the least that tells template from text. Inside article and main elements the tree
removes nothing, for there a repeated title or passage is text.

What varies from page to page and is still no text, such as readers' comments or rotating adverts, no entropy can tell:
elements that HTML or their names declare to be navigation, adverts, forms, comments and the like have no importance
whatever their text. What is left inside the article (or main) element, else all that is left, is the main text.

The tree is aggregated from slim rows of hashes; each host's low-importance nodes then go back to its pages, which are
read a second time. Elements name their path by a hash of the parent's and their own label, and their text by hashes of
their parts, so that a page costs its length however deep it nests.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, durable

#: Weight of content against presentation; importance below which a branch goes.
GAMMA, LOW = 0.9, 0.25
#: Pages, near copies as one, that tell template from text.
PAGES = 2
#: Share of a host's distinct pages that must repeat a block for it to go.
REPEATED = 0.3
#: Share of a page's text in blocks of m pages or more from which the page counts as one of m near copies.
NEAR = 0.8
#: Hashes (8 bytes each) and hosts up to which the table of low nodes is broadcast; beyond it, it joins by a salted key.
HASHES, HOSTS = 1 << 21, 20_000
SALTS = 64

# Elements by what HTML says of them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
NOT_TEXT = set("head script style noscript template iframe object svg canvas select option button textarea input title".split())
ASIDE = set("nav footer aside form dialog menu".split())
MAIN = set("article main".split())
INLINE = set("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark meter nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = set("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSED_BY_SELF = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr",), "th": ("tr",), "option": ("select",)}
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
# Parts of class names and ids that name page furniture.
NAMES = set(
    "ad ads adv advert adverts advertisement adsense banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus footer gdpr "
    "login masthead menu modal nav navbar navigation newsletter notice notices pagination paywall popup promo promoted recommended related reply replies "
    "respond responses share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar tracking widget widgets".split()
)
HEADERS = set("header topbar".split())
SPLIT = re.compile(r"[\s_-]+|(?<=[a-z])(?=[A-Z])")


def hash_of(*parts: str | int) -> int:
    return xxhash.xxh64_intdigest("\0".join(map(str, parts))) >> 1


class Element:
    """An open element. ``block``: the innermost one that is not inline, itself included; ``low``: removed by the tree."""

    __slots__ = ("tag", "path", "noise", "main", "low", "block", "last", "style", "parts")

    def __init__(self, tag: str, path: int, noise: bool, main: bool, low: bool, block: Element | None, node: bool):
        self.tag, self.path, self.noise, self.main, self.low = tag, path, noise, main, low
        self.block = block or self
        if node:
            self.last, self.style, self.parts = "", xxhash.xxh64(), xxhash.xxh64()


def is_noise(tag: str, attrs: dict[str, str | None], main: bool) -> bool:
    if tag in NOT_TEXT or tag in ASIDE:
        return True
    if "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or re.search(r"display\s*:\s*none", attrs.get("style") or ""):
        return True
    if (attrs.get("role") or "").lower() in ROLES:
        return True
    names = {n.lower() for n in SPLIT.split(f"{attrs.get('class') or ''} {attrs.get('id') or ''}")}
    if tag not in ("html", "body", "main") and names & NAMES:
        return True
    return not main and (tag == "header" or (tag not in ("html", "body", "main", "article") and bool(names & HEADERS)))


class Reader(HTMLParser):
    """Blocks (noise, low, main, text) in page order and, if asked for, the elements outside noise and main as style tree nodes (path, style, content)."""

    def __init__(self, nodes: bool = False, low_paths: frozenset[int] | set[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.with_nodes, self.low_paths = nodes, low_paths
        self.blocks: list[tuple[bool, bool, bool, str]] = []
        self.nodes: list[tuple[int, int, int]] = []
        self.stack = [Element("", 0, False, False, False, None, nodes)]
        self.open: Counter[str] = Counter()
        self.held: list[str] = []

    def flush(self) -> None:
        text = " ".join("".join(self.held).split())
        self.held.clear()
        if text:
            top = self.stack[-1].block
            self.blocks.append((top.noise, top.low, top.main, text))
            if self.with_nodes and not top.noise:
                top.parts.update(text + "\n")

    def pop(self) -> None:
        e = self.stack.pop()
        self.open[e.tag] -= 1
        if self.with_nodes and e.block is e and not e.noise:
            content = e.parts.intdigest()
            if not e.main:
                self.nodes.append((e.path, e.style.intdigest() >> 1, content >> 1))
            self.stack[-1].block.parts.update(f"{content}\n")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        inline = tag in INLINE
        if not inline:
            self.flush()
            if tag in CLOSES_P:
                self.close("p", {"article", "section", "div", "td", "li", "body", "main", "blockquote"})
            if tag in CLOSED_BY_SELF:
                self.close(tag, set(CLOSED_BY_SELF[tag]))
        if tag == "br":
            self.held.append(" ")
        if tag in VOID:
            return
        named = dict(attrs)
        up = self.stack[-1]
        main = up.main or tag in MAIN or named.get("role") == "main" or named.get("itemprop") == "articleBody"
        noise = up.noise or is_noise(tag, named, up.main)
        path = up.path
        if not inline:
            label = tag + "".join(f".{c}" for c in sorted((named.get("class") or "").split())) + (f"#{named['id']}" if named.get("id") else "")
            path = hash_of(up.path, re.sub(r"[0-9]+", "0", label))
            if self.with_nodes and not up.noise and up.block.last != label:
                up.block.last = label
                up.block.style.update(label + "|")
        self.stack.append(Element(tag, path, noise, main, up.low or (path in self.low_paths and not main), up.block if inline else None, self.with_nodes and not inline and not noise))
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def close(self, tag: str, within: set[str]) -> None:
        """Close the innermost open ``tag``, looked for inside the nearest of ``within``."""
        if not self.open[tag]:
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag == tag:
                if tag not in INLINE:
                    self.flush()
                while len(self.stack) > k:
                    self.pop()
                return
            if self.stack[k].tag in within:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID:
            return
        if tag in INLINE:
            self.close(tag, CLOSES_P | {"li", "td", "body"})
        else:
            self.flush()
            self.close(tag, set())

    def handle_data(self, data: str) -> None:
        top = self.stack[-1]
        if top.noise and top.block is not top and not top.block.noise:
            return  # an advert within a line
        self.held.append(data)

    def done(self) -> None:
        self.rawdata += ">" if self.rawdata.startswith("<") else ""  # a tag cut off at the end
        super().close()
        self.flush()
        while len(self.stack) > 1:
            self.pop()


def read(html: str, nodes: bool = False, low_paths: frozenset[int] | set[int] = frozenset()) -> Reader:
    reader = Reader(nodes, low_paths)
    reader.feed(html)
    reader.done()
    return reader


def page_nodes(nodes: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """One (path, style, content) for each path of a page: of several elements, the hash of all their values in order."""
    found: dict[int, list[tuple[int, int]]] = {}
    for path, style, content in nodes:
        found.setdefault(path, []).append((style, content))
    return [(path, *(v[0] if len(v) == 1 else xxhash.xxh64_intdigest(np.array(v, np.int64).tobytes()) >> 1 for v in zip(*values))) for path, values in found.items()]


def block_hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


def main_text(html: str, low_paths: set[int], low_blocks: set[int]) -> str:
    kept = []
    for noise, low, main, text in read(html, low_paths=low_paths).blocks:
        if noise or (not main and (low or block_hash(text) in low_blocks)):
            continue
        kept.append((main, text))
    if any(main for main, _ in kept):
        kept = [(main, text) for main, text in kept if main]
    return "\n".join(text for _, text in kept)


def page_rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    return pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))


def page_weights():
    """Rows (host, sign, blocks, sizes, often, counts) -> (host, sign, weight, shared): 1 / m of a page that is one of m near copies, and its repeated blocks."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for host, sign, blocks, sizes, often, counts in zip(*(batch.column(c).to_pylist() for c in ("host", "sign", "blocks", "sizes", "often", "counts"))):
            pages = dict(zip(often, counts))
            shared = [b for b in blocks if b in pages]
            left, copies = NEAR * sum(sizes), 1
            for m, size in sorted(((pages.get(b, 1), size) for b, size in zip(blocks, sizes)), reverse=True):
                left -= size
                if left <= 0:
                    copies = m
                    break
            out.append({"host": host, "sign": sign, "weight": 1 / copies, "shared": shared})
        return pa.RecordBatch.from_pylist(out, pa.schema([("host", pa.string()), ("sign", pa.int64()), ("weight", pa.float64()), ("shared", pa.list_(pa.int64()))]))

    return step


def of_host(rows: DataFrame, table: DataFrame, lists: tuple[str, str], key: Column, how: str) -> DataFrame:
    """rows with the columns of a table by host: broadcast where it is small in rows and in the hashes of its lists, else joined by a salted key."""
    size = table.agg(F.count("*").alias("hosts"), F.coalesce(F.sum(sum((F.coalesce(F.size(c), F.lit(0)) for c in lists), F.lit(0))), F.lit(0)).alias("hashes")).first()
    if size["hosts"] <= HOSTS and size["hashes"] <= HASHES:
        return rows.join(F.broadcast(table), "host", how)
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(key, F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], how)


def style_tree(rows: DataFrame) -> DataFrame:
    """(host, paths, blocks): the low-importance nodes and the repeated blocks of each host that has any."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                reader = read(html, nodes=True)
                sizes = {block_hash(t): len(t) for noise, _, _, t in reader.blocks if not noise}
                blocks = sorted(sizes)
                seen = page_nodes(reader.nodes)
                sign = xxhash.xxh64_intdigest(np.array(blocks, np.int64).tobytes()) >> 1
                out.append({"host": host, "sign": sign, "nodes": [dict(zip(("path", "style", "content"), v)) for v in seen], "blocks": blocks, "sizes": [sizes[b] for b in blocks]})
            node = pa.struct([("path", pa.int64()), ("style", pa.int64()), ("content", pa.int64())])
            return pa.RecordBatch.from_pylist(out, pa.schema([("host", pa.string()), ("sign", pa.int64()), ("nodes", pa.list_(node)), ("blocks", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))]))

        return step

    seen = arrow_map(rows.filter("host <> ''").select("host", "html"), make, "host string, sign long, nodes array<struct<path:long,style:long,content:long>>, blocks array<long>, sizes array<long>")
    seen = durable(seen.dropDuplicates(["host", "sign"]))
    hosts = seen.groupBy("host").agg(F.count("*").alias("all"))
    often = seen.select("host", F.explode("blocks").alias("b")).groupBy("host", "b").agg(F.count("*").alias("c")).filter(F.col("c") >= PAGES).join(hosts, "host")
    often = often.filter(F.col("c") >= REPEATED * F.col("all")).groupBy("host").agg(F.collect_list("b").alias("often"), F.collect_list("c").alias("counts"))
    weighed = of_host(seen.select("host", "sign", "blocks", "sizes"), durable(often), ("often", "counts"), F.col("sign"), "inner")
    weighed = durable(arrow_map(weighed.select("host", "sign", "blocks", "sizes", "often", "counts"), page_weights, "host string, sign long, weight double, shared array<long>"))
    slack = 1e-6

    # pages without any such block are one each
    nodes = seen.join(weighed.select("host", "sign", "weight"), ["host", "sign"], "left")
    nodes = nodes.select("host", F.coalesce("weight", F.lit(1.0)).alias("weight"), F.explode("nodes").alias("n")).select("host", "weight", "n.*")

    def entropy(of: str) -> DataFrame:
        """Of the values of a node over the pages that have it: 0 (one value) to 1 (all differ)."""
        counted = nodes.groupBy("host", "path", of).agg(F.sum("weight").alias("c"))
        sums = counted.groupBy("host", "path").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("clogc"))
        return sums.filter(F.col("n") + slack >= PAGES).select("host", "path", (1 - F.col("clogc") / (F.col("n") * F.log("n"))).alias(of))

    importance = GAMMA * F.col("content") + (1 - GAMMA) * F.col("style")
    low = entropy("content").join(entropy("style"), ["host", "path"]).filter(importance < LOW).groupBy("host").agg(F.collect_list("path").alias("paths"))
    total = weighed.groupBy("host").agg(F.sum(1 - F.col("weight")).alias("less")).join(hosts, "host").select("host", (F.col("all") - F.col("less")).alias("total"))
    blocks = weighed.select("host", "weight", F.explode("shared").alias("b")).groupBy("host", "b").agg(F.sum("weight").alias("c")).join(total, "host")
    blocks = blocks.filter((F.col("c") + slack >= PAGES) & (F.col("c") + slack >= REPEATED * F.col("total"))).groupBy("host").agg(F.collect_list("b").alias("blocks"))
    return low.join(blocks, "host", "full_outer")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row.

    A null or empty html, or a page without main text, gives an empty text. Pages whose url is null or has no
    host belong to no tree: only what HTML declares is removed. Pages of any length, depth of nesting and malformation are
    read whole. Repeated rows give repeated rows; an empty table gives an empty result. Other columns are ignored, so their
    names cannot clash."""
    rows = page_rows(pages, id_col, url_col, html_col)
    low = durable(style_tree(rows))
    rows = of_host(rows, low, ("paths", "blocks"), F.xxhash64("page_id"), "left")

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(html, set(p or ()), set(b or ())) for html, p, b in zip(*(batch.column(c).to_pylist() for c in ("html", "paths", "blocks")))]
            return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

        return step

    return arrow_map(rows.select("page_id", "url", "html", "paths", "blocks"), make, "page_id long, url string, text string, n_chars long")
