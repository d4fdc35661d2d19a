"""Passages of texts for retrieval: by tokens along a text's own boundaries, and by characters page by page."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..sources.files import short_batches

# Tokens of a passage and of the overlap with the next; characters of a bid's passage.
PASSAGE_TOKENS, OVERLAP_TOKENS = 800, 100
LEAST_CHARS, MOST_CHARS = 200, 1200
#: Where a text may be cut, from the coarsest boundary (after the items, which are given) to the finest.
LINE, SENTENCE, WORD = re.compile(r"\n"), re.compile(r"(?<=[.;:!?])\s+(?=[A-ZÁÉÍÓÚÜÑ¿¡“\"«])"), re.compile(r"\s+")
#: The end of a sentence of a bid, and the heading of an item of one (recognised texts read O as 0).
BID_SENTENCE = re.compile(r"(?<=[.!?;:])\s+")
BID_ITEM = re.compile(r"\bRENGL[OÓ0]N\b|(?:(?<=[.;:!?] )|^)Rengl[oó0]n\s+\d", re.MULTILINE)
PAGE_BREAK = "\f"
#: Where each token of a text begins. Any tokeniser will do: a passage has as many tokens as begin in it.
Tokens = Callable[[str], Sequence[int]]


def words(text: str) -> list[int]:
    """A token for each word."""
    return [m.start() for m in re.finditer(r"\S+", text)]


def word_pieces(text: str, letters: int = 4) -> list[int]:
    """A token for each mark and each few letters of a word, as a model's own tokeniser would have about."""
    return [at for m in re.finditer(r"\w+|[^\w\s]", text) for at in range(m.start(), m.end(), letters)]


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """A span without the white space at its ends."""
    own = text[start:end]
    return start + len(own) - len(own.lstrip()), end - len(own) + len(own.rstrip())


def split(text: str, start: int, end: int, cuts: Sequence[int]) -> list[tuple[int, int]]:
    """The parts of a span between cuts, trimmed; blank ones are left out."""
    inner = sorted({c for c in cuts if start < c < end})
    parts = (trimmed(text, a, b) for a, b in zip([start, *inner], [*inner, end], strict=True))
    return [p for p in parts if p[0] < p[1]]


def passages(text: str, most: int = PASSAGE_TOKENS, overlap: int = OVERLAP_TOKENS, header: str = "", items: Sequence[int] = (), tokens: Tokens = words) -> list[tuple[int, int]]:
    """Spans that cover a text, each of most tokens at most together with the header that goes before it.

    A text that fits is one passage. Else the smallest parts are words; from there up, the words of a sentence, the sentences of a line, the lines of
    an item become one part where they fit together. Passages take as many parts as they can in order. One begins with the last whole lines,
    sentences or parts of the one before it, as many as have overlap tokens at most and leave room for its own first part. A word
    alone that is longer than the limit is a passage of its own: words are never cut. items: where items begin.
    """
    starts = sorted(tokens(text))
    room = most - len(tokens(header))
    size = lambda a, b: bisect_left(starts, b) - bisect_left(starts, a)
    whole = trimmed(text, 0, len(text))
    if whole[0] >= whole[1]:
        return []
    if size(*whole) <= room:
        return [whole]
    levels = [sorted(items), *([m.end() for m in p.finditer(text)] for p in (LINE, SENTENCE))]
    parts = split(text, *whole, [*levels[0], *(m.end() for m in WORD.finditer(text))])
    for level in (3, 2, 1):  # the words of a sentence, the sentences of a line, the lines of an item
        parts = _joined(parts, sorted(set().union(*levels[:level])), size, room)
    out: list[tuple[int, int]] = []
    at, back = 0, []
    while at < len(parts):
        first, end = parts[at]
        begin = next((b for b in back if size(b, end) <= room), first)
        after = at + 1
        while after < len(parts) and size(begin, parts[after][1]) <= room:
            end = parts[after][1]
            after += 1
        out.append((begin, end))
        inner = [c for found in levels[1:] for c in found[bisect_right(found, first) : bisect_left(found, end)]]
        whole_parts = {a for a, _ in split(text, first, end, [a for a, _ in parts[at:after]] + inner)}
        back = [b for b in sorted(whole_parts) if b > begin and size(b, end) <= overlap]
        at = after
    return out


def _joined(parts: list[tuple[int, int]], cuts: list[int], size: Callable[[int, int], int], room: int) -> list[tuple[int, int]]:
    """The parts between two cuts as one where all of them fit together, else as they are."""
    out: list[tuple[int, int]] = []
    at = 0
    while at < len(parts):
        nth = bisect_right(cuts, parts[at][0])
        limit = cuts[nth] if nth < len(cuts) else parts[-1][1] + 1
        after = at
        while after < len(parts) and parts[after][0] < limit:
            after += 1
        begin, end = parts[at][0], parts[after - 1][1]
        out += [(begin, end)] if size(begin, end) <= room else parts[at:after]
        at = after
    return out


def bid_passages(text: str, least: int = LEAST_CHARS, most: int = MOST_CHARS) -> list[tuple[int, int, int]]:
    """page (from 1), start and end of the passages of a bid's text, in which a form feed ends a page.

    The lines of a page are its blocks; one of fewer than least characters goes with the next of its page. A block longer than most is
    cut where items have their headings, then at sentences, a longer sentence at a space, a longer word where it has to be; sentences go
    together as far as there is room.
    """
    out: list[tuple[int, int, int]] = []
    begin = 0
    for page, content in enumerate(text.split(PAGE_BREAK), 1):
        lines = split(text, begin, begin + len(content), [begin + m.end() for m in LINE.finditer(content)])
        for start, end in _blocks(lines, least):
            spans = [(start, end)] if end - start <= most else split(text, start, end, [start + m.start() for m in BID_ITEM.finditer(text[start:end])])
            out += [(page, *s) for span in spans for s in _filled(text, *span, most)]
        begin += len(content) + 1
    return out


def _blocks(lines: list[tuple[int, int]], least: int) -> Iterator[tuple[int, int]]:
    held: tuple[int, int] | None = None
    for start, end in lines:
        held = (held[0] if held else start, end)
        if held[1] - held[0] >= least:
            yield held
            held = None
    if held:
        yield held


def _filled(text: str, start: int, end: int, most: int) -> Iterator[tuple[int, int]]:
    """Sentences in order, as many in a passage as have room."""
    if end - start <= most:
        yield start, end
        return
    held: tuple[int, int] | None = None
    for sentence in split(text, start, end, [start + m.end() for m in BID_SENTENCE.finditer(text[start:end])]):
        for a, b in _cut_hard(text, *sentence, most):
            if held and b - held[0] <= most:
                held = held[0], b
                continue
            if held:
                yield held
            held = a, b
    if held:
        yield held


def _cut_hard(text: str, start: int, end: int, most: int) -> Iterator[tuple[int, int]]:
    """A sentence in parts of most characters at most: each ends at its last space, or where it has to."""
    while end - start > most:
        space = text.rfind(" ", start + 1, start + most + 1)
        stop = space if space > start else start + most
        yield trimmed(text, start, stop)
        start = trimmed(text, stop, end)[0]
    if start < end:
        yield start, end


def cut(df: DataFrame, by: str, text: str, most: int = PASSAGE_TOKENS, overlap: int = OVERLAP_TOKENS, header: str | None = None, items: str | None = None, tokens: Tokens = words) -> DataFrame:
    """The :func:`passages` of texts: by, place (from 1), start, end, header, text. header and items: columns (the items' places, an array)."""
    short_batches(df.sparkSession)
    kind = df.schema[by].dataType.simpleString()
    head = F.coalesce(F.col(header), F.lit("")) if header else F.lit("")
    begin = F.coalesce(F.col(items).cast("array<int>"), F.array().cast("array<int>")) if items else F.array().cast("array<int>")

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (key, i, a, b, h, t[a:b])
                for key, t, h, own in zip(batch["by"], batch["text"].fillna(""), batch["header"], batch["items"], strict=True)
                for i, (a, b) in enumerate(passages(t, most, overlap, h, [int(x) for x in own], tokens), 1)
            ]
            yield pd.DataFrame(rows, columns=[by, "place", "start", "end", "header", "text"])

    rows = df.select(F.col(by).alias("by"), F.col(text).alias("text"), head.alias("header"), begin.alias("items"))
    return rows.mapInPandas(fn, f"{by} {kind}, place int, start int, end int, header string, text string")


def cut_bids(df: DataFrame, by: str, text: str, least: int = LEAST_CHARS, most: int = MOST_CHARS) -> DataFrame:
    """The :func:`bid_passages` of texts: by, place (from 1), key (p and the page, b and the place in it), start, end, text."""
    short_batches(df.sparkSession)
    kind = df.schema[by].dataType.simpleString()

    def fn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, t in zip(batch[by], batch[text].fillna(""), strict=True):
                own: dict[int, int] = {}
                for i, (page, a, b) in enumerate(bid_passages(t, least, most), 1):
                    own[page] = own.get(page, 0) + 1
                    rows.append((key, i, f"p{page}/b{own[page]}", a, b, t[a:b]))
            yield pd.DataFrame(rows, columns=[by, "place", "key", "start", "end", "text"])

    return df.select(by, text).mapInPandas(fn, f"{by} {kind}, place int, key string, start int, end int, text string")
