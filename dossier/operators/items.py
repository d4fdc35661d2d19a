"""Lists of items inside an article: a tree of two levels with the last paragraph of each item.

Beginnings are found in the order of the paragraphs; ends afterwards, from the leaves up, as how far an item reaches depends on the
item that follows it and on what the last one of its list presents.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import zip_longest

#: Levels of items, the letters of a list, and the one that it may leave out.
LEVELS = 2
LETTERS = "abcdefghijklmnñopqrstuvwxyz"
OPTIONAL = "ñ"


@dataclass
class Item:
    """An item: its paragraph and last paragraph, number, form (style, and whether it names itself an item), what it is inside of."""

    at: int
    number: str
    form: tuple
    above: Item | None
    end: int = 0
    inside: list[Item] = field(default_factory=list)
    announced: bool = False  # a paragraph of the article presents the list that it begins

    @property
    def key(self) -> str:
        return f"{self.above.key}/inc-{self.number}" if self.above else f"inc-{self.number}"


def comes_next(last: str, number: str) -> bool:
    """The number or letter after the last one; a list may leave out ñ."""
    if last.isdigit() and number.isdigit():
        return int(number) - int(last) == 1
    if len(last) != 1 or len(number) != 1 or last not in LETTERS or number not in LETTERS:
        return False
    between = LETTERS[LETTERS.index(last) + 1 : LETTERS.index(number)]
    return LETTERS.index(number) > LETTERS.index(last) and between in ("", OPTIONAL)


class _Lists:
    """The items open at a paragraph, from the first level down."""

    def __init__(self) -> None:
        self.first: list[Item] = []
        self.open: list[Item] = []

    def siblings(self, level: int) -> list[Item]:
        return self.open[level - 1].inside if level else self.first

    def add(self, level: int, at: int, number: str, form: tuple, announced: bool = False) -> bool:
        """Begins an item at a level, unless the list there has its number already."""
        own = self.siblings(level)
        if any(x.number == number for x in own):
            return False
        item = Item(at, number, form, self.open[level - 1] if level else None, announced=announced)
        own.append(item)
        self.open[level:] = [item]
        return True

    def read(self, at: int, number: str, form: tuple, presented: bool) -> bool:
        level = next((i for i, x in enumerate(self.open) if x.form == form), None)
        if level is not None:  # its list is open: it goes on with it or is no item
            return comes_next(self.open[level].number, number) and self.add(level, at, number, form)
        if number not in ("a", "1"):
            return False
        if form[1] and self.add(0, at, number, form):  # one that names itself an item is of the first level if it can be
            return True
        if len(self.open) < LEVELS:
            return self.add(len(self.open), at, number, form)
        return presented and not form[1] and self.add(0, at, number, form, announced=True)


def _close(own: list[Item]) -> None:
    """Ends from the leaves up: an item reaches to the next of its list, the last one as far as what is inside of it."""
    for item, after in zip_longest(own, own[1:]):
        _close(item.inside)
        item.end = after.at - 1 if after else max([item.at, *(x.end for x in item.inside)])


def _take_presented(own: list[Item], limit: int, presents: Sequence[bool]) -> None:
    """The last item of a list, if it has none inside and its last paragraph presents something, takes all up to the end of what it is inside of."""
    for item in own:
        last = item is own[-1]
        if item.inside:
            _take_presented(item.inside, limit if last else item.end, presents)
            item.end = max(item.end, item.inside[-1].end)
        elif last and presents[item.end]:
            item.end = max(item.end, limit)


def item_tree(headings: Sequence[tuple[str, tuple] | None], presents: Sequence[bool]) -> list[Item]:
    """The items of the first level, each with those inside of it, of an article's paragraphs (the first is its heading).

    headings: number and form of a paragraph that begins like an item, else None. presents: the paragraph ends in a colon. A list
    begins with a or 1 and goes on without gaps in its own form; a third level there is not, but where both are taken, a paragraph of the
    article that presents a list begins a new one of the first level and ends the item before it. What follows the last item of a list
    is the article's again.
    """
    lists, end = _Lists(), len(headings) - 1
    for at in range(1, len(headings)):
        if headings[at] is not None:
            number, form = headings[at]
            lists.read(at, number, form, presented=at > 1 and headings[at - 1] is None and presents[at - 1])
    first = lists.first
    _close(first)
    for before, item in zip(first, first[1:]):
        if item.announced:
            before.end = item.at - 2
    _take_presented(first, end, presents)
    if first and first[-1].form[1]:
        first[-1].end = end
    return first


def deepest(first: list[Item], paragraphs: int) -> list[Item | None]:
    """The innermost item of each paragraph."""
    out: list[Item | None] = [None] * paragraphs
    todo = list(first)
    while todo:  # what is inside comes after what holds it
        item = todo.pop(0)
        out[item.at : item.end + 1] = [item] * (item.end + 1 - item.at)
        todo += item.inside
    return out
