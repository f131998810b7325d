"""Extraction of word groups from a table of HTML pages."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class Blocks(HTMLParser):
    """Texts of the items in each block of a page, by a stack of open elements.

    Blocks and items may nest and need not be closed; an end tag closes what was left open inside. An item belongs to
    the nearest block around it. Character references stay as written.
    """

    def __init__(self, block: tuple[str, frozenset], item: tuple[str, frozenset]):
        super().__init__(convert_charrefs=False)
        self.wanted = (block, item)
        self.open: list[tuple[str, int | None, list[str] | None]] = []  # tag, number of a block, text of an item
        self.counts: dict[str, int] = {}
        self.blocks: list[list[list[str]]] = []
        self.around: list[int] = []
        self.items: list[list[str]] = []

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            return
        classes = frozenset((dict(attrs).get("class") or "").split())
        is_block, is_item = (tag == name and needed <= classes for name, needed in self.wanted)
        number = text = None
        if is_block:
            number = len(self.blocks)
            self.blocks.append([])
            self.around.append(number)
        if is_item and self.around:
            text = []
            self.blocks[self.around[-1]].append(text)
            self.items.append(text)
        self.open.append((tag, number, text))
        self.counts[tag] = self.counts.get(tag, 0) + 1

    def handle_endtag(self, tag):
        if not self.counts.get(tag):
            return
        while True:
            closed, number, text = self.open.pop()
            self.counts[closed] -= 1
            if number is not None:
                self.around.pop()
            if text is not None:
                self.items.pop()
            if closed == tag:
                return

    def handle_data(self, data):
        for text in self.items:
            text.append(data)

    def handle_entityref(self, name):
        self.handle_data(f"&{name};")

    def handle_charref(self, name):
        self.handle_data(f"&#{name};")


def block_items(html: str | None, block: tuple[str, frozenset], item: tuple[str, frozenset]) -> list[list[str]]:
    reader = Blocks(block, item)
    reader.feed(html or "")
    reader.close()
    return [["".join(text) for text in items] for items in reader.blocks]


def _selector(tag: str, css_class: str | None) -> tuple[str, frozenset]:
    return tag.lower(), frozenset((css_class or "").split())


def element_blocks(pages: DataFrame, block: tuple[str, frozenset], item: tuple[str, frozenset]) -> DataFrame:
    """``page_id`` and ``blocks``, the item texts of each block in page order."""
    kind = pages.schema["page_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [block_items(html, block, item) for html in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.list_(pa.string())))], ["page_id", "blocks"])

    return pages.select("page_id", "html").mapInArrow(run, f"page_id {kind}, blocks array<array<string>>")


def extract_html_groups(
    pages: DataFrame,
    block_tag: str = "div",
    block_class: str | None = "well well-lg",
    item_tag: str = "a",
    item_class: str | None = "btn word-btn",
) -> DataFrame:
    """``(page_id, group_no, words)``: item texts per block, blocks without items dropped.

    A class list names classes that an element must have, in any order and among others.
    """
    blocks = element_blocks(pages, _selector(block_tag, block_class), _selector(item_tag, item_class))
    listed = blocks.select("page_id", F.posexplode("blocks").alias("group_no", "words"))
    return listed.filter(F.size("words") > 0)


def extract_page_count(
    pages: DataFrame, block_tag: str = "div", block_class: str | None = "col-sm-9", item_tag: str = "h5"
) -> DataFrame:
    """``(page_id, pages)``: number after the last slash of the heading, 0 without one."""
    blocks = element_blocks(pages, _selector(block_tag, block_class), _selector(item_tag, None))
    with_items = F.filter("blocks", lambda b: F.size(b) > 0)
    heading = F.try_element_at(F.try_element_at(with_items, F.lit(1)), F.lit(1))
    number = F.trim(F.element_at(F.split(heading, "/"), -1))
    return blocks.select("page_id", F.coalesce(number.try_cast("int"), F.lit(0)).alias("pages"))
