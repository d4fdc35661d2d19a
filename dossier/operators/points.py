"""Numbered points of opinions: which paragraph begins one, as a relation between the numbers of two points."""

from __future__ import annotations

import re
from itertools import zip_longest

from pyspark.sql import DataFrame, functions as F

from ..functions.headings import heading
from .structure import MARGIN, each_document

#: How a point is numbered, and how many points make a document a numbered one.
POINT = re.compile(r"^(?:([IVX]+)\.|(\d{1,2}(?:\.\d{1,2})+)\.?|(\d{1,2})\.)(?=\s|$)")
LEAST_POINTS = 2
#: Chapters are numbered I to XXXIX.
CHAPTERS = {t + u: 10 * i + j for i, t in enumerate(("", "X", "XX", "XXX")) for j, u in enumerate(("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"))}


def follows(last: tuple[int, ...], parts: tuple[int, ...]) -> bool:
    """A point goes on from the last one: where their numbers first differ it is the next (MARGIN may be missing), all below it are ones.

    A level that the last point doesn't have counts as none yet, so that one begins with 1.
    """
    differ = next((i for i, (a, b) in enumerate(zip_longest(last, parts, fillvalue=0)) if a != b), None)
    if differ is None or differ >= len(parts):
        return False
    step = parts[differ] - (last[differ] if differ < len(last) else 0)
    return 1 <= step <= (1 + MARGIN if differ < len(last) else 1) and set(parts[differ + 1 :]) <= {1}


def number_of(text: str) -> tuple[str, int | tuple[int, ...]] | None:
    """chapter and its number, or point and its parts; None for a paragraph that begins with neither."""
    m = POINT.match(text)
    if m is None:
        return None
    if m[1]:
        return ("chapter", CHAPTERS[m[1]]) if m[1] in CHAPTERS else None
    return "point", tuple(map(int, (m[2] or m[3]).split(".")))


class _State:
    """Where the numbering stands: the chapter, the last point, whether points may begin anew, and the open point's key."""

    chapter, prefix, last, anew, key, accepted = 0, "", None, True, None, 0

    def read(self, text: str, signed: bool) -> str | None:
        found = number_of(text)
        if signed:
            self.key = None
        elif found and found[0] == "chapter":
            if 1 <= found[1] - self.chapter <= 1 + MARGIN:
                self.chapter, self.anew = found[1], True
                name = next(k for k, n in CHAPTERS.items() if n == found[1])
                self._open(f"punto-{name.lower()}")
                self.prefix = f"{self.key}/"
        elif found and ((self.last and follows(self.last, found[1])) or (self.anew and set(found[1]) == {1})):
            self.last, self.anew = found[1], False
            self._open(f"{self.prefix}punto-{'.'.join(map(str, found[1]))}")
        return self.key

    def _open(self, key: str) -> None:
        self.key, self.accepted = key, self.accepted + 1


def points(texts: list[str], signed: list[bool]) -> list[str | None]:
    """The key of each paragraph's point, None outside any; a document of too few points counts its paragraphs up to the signature."""
    state = _State()
    keys = [state.read(t, s) for t, s in zip(texts, signed, strict=True)]
    if state.accepted >= LEAST_POINTS:
        return keys
    body = signed.index(True) if True in signed else len(signed)
    return [f"parrafo-{i + 1}" if i < body else None for i in range(len(texts))]


def points_of(paragraphs: DataFrame, by: str, order: str, text: str) -> DataFrame:
    """by, order, key: the numbered point that each paragraph of an opinion belongs to, null outside any."""
    signed = F.coalesce(heading(F.col(text)) == "signature", F.lit(False))
    rows = paragraphs.select(by, order, F.coalesce(F.col(text), F.lit("")).alias("text"), signed.alias("signed"))
    walk = lambda own: [(key,) for key in points([r.text for r in own], [bool(r.signed) for r in own])]
    return each_document(rows, by, order, walk, "key string")
