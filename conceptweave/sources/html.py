"""HTML to an ordered stream of blocks, by the parser of the standard library, batch by batch."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema

BLOCK_TAGS = {"p", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "td"}
VOID = {"br", "hr", "img", "meta", "link", "input", "col", "wbr"}
SKIP = {"script", "style"}
NUMBER_CLASSES = {"ParagrafNr", "Liste1Nr", "Liste2Nr"}
FIELDS = ["ordinal", "depth", "tag", "css_class", "element_id", "number", "bold", "text", "path", "plain"]


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[dict] = []
        self.stack: list[tuple[str, str, str, dict | None]] = []  # tag, class, id, block

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in VOID:
            if tag == "br" and (block := self._block()):
                block["text"].append(" ")
            return
        if tag in ("p", "li") and self.stack and self.stack[-1][0] == tag:  # these end where the next begins
            self.stack.pop()
        a = dict(attrs)
        cls, ident = a.get("class") or "", a.get("id") or ""
        block = None
        if tag in BLOCK_TAGS:
            block = {"ordinal": len(self.blocks), "depth": len(self.stack), "tag": tag, "css_class": cls, "element_id": ident, "number": [], "bold": [], "text": [], "plain": [], "left_out": {}, "path": "/".join(c for _, c, i, _ in self.stack for c in (c, f"#{i}" if i else "") if c)}
            self.blocks.append(block)
        elif tag in ("b", "i") and (held := self._block()) and tag not in held["left_out"]:
            held["left_out"][tag] = len(self.stack)  # the first of its kind, at this depth
        self.stack.append((tag, cls, ident, block))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                if tag in ("b", "i") and (held := self._block()) and held["left_out"].get(tag) == i:
                    held["left_out"][tag] = -1  # it is over; a second one at this depth stays
                del self.stack[i:]
                return

    def _block(self) -> dict | None:
        return next((b for _, _, _, b in reversed(self.stack) if b is not None), None)

    def handle_data(self, data: str) -> None:
        if any(t in SKIP for t, *_ in self.stack) or not (block := self._block()):
            return
        inner = []
        for t, cls, _, b in reversed(self.stack):
            if b is not None:
                break
            inner.append((t, cls))
        numbered = any(c in NUMBER_CLASSES for _, c in inner)
        if numbered:
            block["number"].append(data)
        if any(t in ("b", "strong") or c == "Bold" for t, c in inner):
            block["bold"].append(data)
        if not numbered:
            block["text"].append(data)
            if not any(block["left_out"].get(t) == d for d, (t, *_) in enumerate(self.stack) if t in ("b", "i")):
                block["plain"].append(data)


def parse_blocks(html: str | None) -> list[dict]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    return [b | {k: " ".join("".join(b[k]).split(" ")).strip(" \r\n\t") for k in ("number", "bold", "text", "plain")} for b in parser.blocks]


def inside(blocks: DataFrame, element_id: str, key: str = "doc_id") -> DataFrame:
    """Only the blocks of documents that stand in the element of this id; documents without such an element have none."""
    return blocks.filter((F.col("element_id") == element_id) | F.array_contains(F.split("path", "/"), f"#{element_id}"))


def unwrapped(blocks: DataFrame, css_class: str, key: str = "doc_id") -> DataFrame:
    """Blocks of this class are no elements of their own: they go, and what they hold stays."""
    return blocks.filter(F.col("css_class") != css_class)


def html_blocks(docs: DataFrame, key: str = "doc_id", html: str = "html") -> DataFrame:
    """(key, ordinal, depth, tag, css_class, element_id, number, bold, text, path, plain): one row per block element, in order; plain is the text without its first bold and italic part."""
    types = {"ordinal": pa.int32(), "depth": pa.int32()}
    kind = docs.schema[key].dataType
    arrow = pa.schema([(key, pa.int64() if kind.simpleString() == "bigint" else pa.string()), *[(f, types.get(f, pa.string())) for f in FIELDS]])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(k, *(b[f] for f in FIELDS)) for k, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for b in parse_blocks(h)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)

    return docs.select(key, F.col(html)).mapInArrow(parse, f"{key} {kind.simpleString()}, {schema.BLOCKS}")
