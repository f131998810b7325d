"""Main text of web pages, with the templates of their sites removed.

Each page is read once into blocks of text, each with the hashes of the element subtrees around it. Spark counts on how
many different pages of a host each subtree stands and deletes those that recur on many. Names and roles of elements
remove menus, forms, adverts and the like on hosts with few pages.
"""

from __future__ import annotations

import html as entities
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonolake.llm.common import per_row, stored

#: A subtree is a template from this many different pages, and this share of the host's pages, on.
LEAST_PAGES, LEAST_SHARE = 5, 0.05
SALT = 16
#: Templates of all hosts up to this many bytes are sent to the tasks, so that no page is shuffled.
MOST_BYTES = 16 << 20

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|([^\s=/>\"']+)")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table caption tbody tfoot thead tr ul".split()
)
CELLS = frozenset("td th br wbr img".split())
GONE = frozenset("nav aside footer form button select option input label fieldset svg canvas object dialog audio video map menu head math search".split())
GONE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar tooltip form".split())
#: Parts of class names and ids, between other letters, that mark what is no article text.
GONE_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar "
    "footer header masthead cookie cookies consent notice notification alert popup modal overlay newsletter subscribe subscription signup login "
    "comment comments disqus replies respond share sharing social related recommended pagination pager widget toolbar form".split()
)
#: Names that only count outside an article: there they may name its own title or byline.
OUTSIDE = frozenset("header banner masthead".split())
HEAD_ONLY = frozenset("title meta link base style script noscript template".split())
#: An opening tag of the key closes open elements of the value, up to the nearest of the third.
CLOSES = {"li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select", "datalist")), "body": (("head",), ("html",))}
SCOPE = frozenset("table td th article main section div body html li button".split())
NAME_PART = re.compile(r"[A-Za-z][a-z]*|[A-Z]+(?![a-z])")


class Node:
    __slots__ = ("tag", "parent", "gone", "inside", "parts", "linked", "digest")

    def __init__(self, tag: str, parent: Node | None, gone: bool, inside: bool):
        self.tag, self.parent, self.gone, self.inside = tag, parent, gone, inside
        self.parts: list[str] = [tag]
        self.linked = tag == "a"
        self.digest = 0


def unwanted(tag: str, attributes: str, inside: bool) -> bool:
    if tag in GONE or tag == "header" and not inside:
        return True
    if tag in ("html", "body", "main") or not attributes or attributes.isspace():
        return False
    for name, value, bare in ATTRIBUTE.findall(attributes):
        name = (name or bare).lower()
        value = value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name == "role" and value.lower() in GONE_ROLES:
            return True
        if name in ("class", "id"):
            parts = {p.lower() for p in NAME_PART.findall(entities.unescape(value))} & GONE_NAMES
            if parts - OUTSIDE if inside else parts:
                return True
    return False


def page_blocks(html: str) -> list[tuple[str, list[int]]]:
    """Blocks of text in page order, each with the hashes of the subtrees that may be a template around it.

    If the page has an ``article`` or ``main`` element with text, only blocks inside are returned. Tags may be
    left open, wrongly nested or cut off.
    """
    import xxhash

    root = Node("", None, False, False)
    top, blocks, words = root, [], []
    done: list[Node] = []

    def close_block():
        if words:
            text = " ".join("".join(words).split())
            words.clear()
            if text:
                blocks.append((text, top))

    def pop() -> None:
        nonlocal top
        done.append(top)
        top = top.parent

    def text_of(raw: str) -> None:
        if raw:
            raw = entities.unescape(raw) if "&" in raw else raw
            top.parts.append(" ".join(raw.split()))
            if not top.gone:
                words.append(raw)

    at = 0
    while True:
        found = TOKEN.search(html, at)
        if found is None:
            text_of(html[at:])
            break
        text_of(html[at : found.start()])
        at = found.end()
        closing, tag, attributes = found.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            if tag in BLOCK:
                close_block()
            elif tag in CELLS:
                words.append(" ")
            node = top
            while node is not root and node.tag != tag:
                # an inline end tag does not reach over a block
                if tag not in BLOCK and node.tag in SCOPE:
                    node = root
                else:
                    node = node.parent
            if node is not root:
                close_block() if tag in BLOCK else None
                while top is not node:
                    pop()
                pop()
            continue
        if tag in BLOCK:
            close_block()
            if tag not in ("html", "body"):  # a block ends an open paragraph
                node = top
                while node is not root and node.tag != "p" and node.tag not in SCOPE:
                    node = node.parent
                if node is not root and node.tag == "p":
                    while top is not node:
                        pop()
                    pop()
        elif tag in CELLS:
            words.append(" ")
        if top.tag == "head" and tag not in HEAD_ONLY:
            pop()
        if tag in CLOSES:
            ends, within = CLOSES[tag]
            node = top
            while node is not root and node.tag not in ends and node.tag not in within:
                node = node.parent
            if node is not root and node.tag in ends:
                while top is not node:
                    pop()
                pop()
                if tag == "tr":
                    while top is not root and top.tag in ends:
                        pop()
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if attributes.endswith("/") and tag not in BLOCK:
            continue
        inside = top.inside or tag in ("article", "main")
        top = Node(tag, top, top.gone or unwanted(tag, attributes, top.inside), inside)
    close_block()
    while top is not root:
        pop()
    for node in done:  # children come before their parents
        node.digest = xxhash.xxh3_64_intdigest("\x00".join(node.parts).encode("utf-8", "surrogatepass")) - (1 << 63)
        node.parent.parts.append(str(node.digest))
        node.parent.linked |= node.linked
    if any(node.inside for _, node in blocks):
        blocks = [b for b in blocks if b[1].inside]
    out = []
    for text, node in blocks:
        around = []
        while node is not root:
            # inside an article only parts with links can be a template: its own words may well recur
            if node.tag not in ("html", "body", "article", "main") and (not node.inside or node.linked and node.tag in BLOCK - {"p"}):
                around.append(node.digest)
            node = node.parent
        out.append((text, around))
    return out


def read_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, host, a hash of the page and its blocks."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.when(host != "", host).alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    schema = "page_id long, url string, host string, page_hash long, blocks array<struct<text: string, around: array<bigint>>>"

    def batch_rows(batch):
        import pyarrow as pa
        import xxhash

        pages = batch.column(3).to_pylist()
        blocks = pa.array([[{"text": t, "around": a} for t, a in page_blocks(p)] for p in pages], pa.list_(pa.struct([("text", pa.string()), ("around", pa.list_(pa.int64()))])))
        hashes = pa.array([xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass")) - (1 << 63) for p in pages], pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), hashes, blocks], ["page_id", "url", "host", "page_hash", "blocks"])

    return rows.mapInArrow(per_row(batch_rows, "html"), schema)


def site_templates(read: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """``host`` and the hashes of its templates.

    Copies of a page count once. A host has at most 1 / ``least_share`` times as many templates as a page has
    subtrees, so the list is small whatever the number of pages.
    """
    known = read.where(F.col("host").isNotNull())
    seen = known.select("host", "page_hash", F.explode(F.array_distinct(F.flatten("blocks.around"))).alias("subtree")).distinct()
    sizes = known.select("host", "page_hash").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    often = seen.groupBy("host", "subtree").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    return often.join(sizes, "host").where(F.col("n") >= F.col("pages") * least_share).groupBy("host").agg(F.collect_list("subtree").alias("templates"))


def main_text(pages: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE, most_bytes: int = MOST_BYTES) -> DataFrame:
    """One row per input row: page_id, url, text, n_chars.

    Blocks are joined by a line feed, white space inside a block is one space, character references are decoded.
    A null or empty page has an empty text; a page without a host in its url loses no templates; ids may be null or
    repeat. The blocks are written once to the checkpoint folder and meet the templates of their host there. Templates
    of more than ``most_bytes`` in all are joined, each host in ``SALT`` pieces.
    """
    read = stored(read_pages(pages), "pages")
    templates = stored(site_templates(read, least_pages, least_share), "templates")
    templates = templates.withColumnRenamed("host", "_host")
    size = templates.agg(F.coalesce(F.sum(F.octet_length("_host") + 8 * F.size("templates") + 64), F.lit(0)).alias("bytes")).first()["bytes"]
    if size <= most_bytes:
        both = read.join(F.broadcast(templates), F.col("host") == F.col("_host"), "left")
    else:
        spread = templates.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        salt = F.pmod(F.xxhash64("page_id", "page_hash"), F.lit(SALT)).cast("int")
        both = read.withColumn("salt", salt).join(spread.hint("merge"), (F.col("host") == F.col("_host")) & (F.col("salt") == F.col("_salt")), "left")
    none = F.array().cast("array<bigint>")
    kept = F.filter("blocks", lambda b: ~F.arrays_overlap(b["around"], F.coalesce("templates", none)))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return both.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))
