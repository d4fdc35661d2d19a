"""Public pages as rows: title, links, blocks and key-value pairs."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

# Elements that end a line, and elements whose content is no text.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
SKIPPED = frozenset("script style template noscript".split())


class _Lines(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, str]] = []
        self.parts: list[str] = []
        self.skip, self.block = 0, "body"

    def _end(self, block: str) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((self.block, text))
        self.parts, self.block = [], block

    def handle_starttag(self, tag, attrs):
        if tag in SKIPPED:
            self.skip += 1
        elif tag in BLOCKS:
            self._end(tag)

    def handle_endtag(self, tag):
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in BLOCKS:
            self._end("body")

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)


def page_lines(pages: DataFrame, id_col: str, html: str) -> DataFrame:
    """The text of each block element, in order: id, line (from 1), block, text. Broken markup gives what can be read."""
    schema = f"{id_col} {pages.schema[id_col].dataType.simpleString()}, line int, block string, text string"

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, content in zip(batch[id_col], batch[html], strict=True):
                parser = _Lines()
                parser.feed(content or "")
                parser.close()
                parser._end("body")
                rows += [(page, i, block, text) for i, (block, text) in enumerate(parser.lines, 1)]
            yield pd.DataFrame(rows, columns=[id_col, "line", "block", "text"])

    return pages.select(id_col, html).mapInPandas(fn, schema)


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?s)<title>(.*?)</title>", 1)


def links(html: Column) -> Column:
    """The targets of a page's links, in order."""
    return F.regexp_extract_all(html, F.lit(r'<a href="([^"]*)"'), 1)


def language(html: Column) -> Column:
    return F.regexp_extract(html, r'<html lang="([a-z]+)"', 1)


def numbered(df: DataFrame, by: list[str], name: str, order: list[str]) -> DataFrame:
    """key: the name, with #n from its second use in the group on."""
    from pyspark.sql.window import Window

    turn = F.row_number().over(Window.partitionBy(*by, name).orderBy(*order))
    return df.withColumn("key", F.when(turn == 1, F.col(name)).otherwise(F.concat(F.col(name), F.lit("#"), turn.cast("string"))))
