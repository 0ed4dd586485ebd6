"""HTML to text by the standard library's parser, in Arrow batches, and messages with provenance.

Text in script, style and template elements and in comments doesn't count.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCKS = ("p", "ul", "ol", "div", "blockquote", "pre")
_VOID = frozenset("area base br col embed hr img input keygen link menuitem meta param source track wbr".split())
_SILENT = frozenset(("script", "style", "template"))
#: Fixed values of the message format.
VERSION, METHOD = "1.0", "beautifulsoup_block_extraction"


class Node:
    __slots__ = ("items", "name", "parent")

    def __init__(self, name: str, parent: Node | None = None):
        self.name, self.parent, self.items = name, parent, []

    def strings(self):
        """Stripped text pieces in order, without the empty ones."""
        if self.name not in _SILENT:
            for x in self.items:
                if isinstance(x, Node):
                    yield from x.strings()
                elif piece := x.strip():
                    yield piece


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("")
        self.data: list[str] = []

    def flush(self):
        if self.data:
            self.at.items.append("".join(self.data))
            self.data = []

    def handle_starttag(self, tag, attrs):
        self.flush()
        node = Node(tag, self.at)
        self.at.items.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.flush()
        self.at.items.append(Node(tag, self.at))

    def handle_endtag(self, tag):
        self.flush()
        node = self.at
        while node.parent is not None and node.name != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.data.append(data)

    def handle_comment(self, data):
        self.flush()

    handle_decl = handle_pi = unknown_decl = handle_comment


def extract(html: str | None, preserve_structure: bool = True) -> str:
    """Top-level blocks joined by blank lines, list items as bullets; without any block all text, one piece a line."""
    if not html:
        return ""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    tree.flush()
    if not preserve_structure:
        return " ".join(tree.root.strings())
    blocks = []
    for x in tree.root.items:
        if isinstance(x, Node) and x.name in BLOCKS:
            if x.name in ("ul", "ol"):
                text = "\n\n".join("• " + "".join(li.strings()) for li in x.items if isinstance(li, Node) and li.name == "li")
            else:
                text = "".join(x.strings())
            if text:
                blocks.append(text)
    return "\n\n".join(blocks) if blocks else "\n".join(tree.root.strings())


def html_text(html: Column, preserve_structure: bool = True) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda h: extract(h, preserve_structure))

    return run(html)


def extraction(source_field: Column, at: Column) -> Column:
    """How a text was extracted; the time is given, so that results don't change from run to run."""
    return F.struct(F.lit(VERSION).alias("version"), F.lit(METHOD).alias("method"), source_field.alias("source_field"), at.alias("timestamp"))


def message(message_id: Column, timestamp: Column, speaker: Column, html: Column, plain: Column, source_field: Column, source_file: Column, source_format: Column, at: Column, preserve_html: bool = True) -> Column:
    """A message as a struct; text_html and extraction are null unless it came as HTML that is to be kept."""
    has = F.coalesce(html, F.lit("")) != ""
    keep = has & F.lit(preserve_html)
    return F.struct(
        message_id.cast("string").alias("message_id"), timestamp.alias("timestamp"), source_format.alias("timestamp_source"), speaker.alias("speaker"),
        F.when(has, html_text(html)).otherwise(F.coalesce(plain, F.lit(""))).alias("text"), source_file.alias("source_file"), source_format.alias("source_format"),
        F.lit(False).alias("has_thinking"), F.lit(None).cast("array<string>").alias("thinking_blocks"), F.when(keep, html).alias("text_html"), F.when(keep, extraction(source_field, at)).alias("extraction"),
    )
