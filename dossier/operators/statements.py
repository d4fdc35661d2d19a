"""Statements of one document that say the same: equal, contained in one another, or alike word by word in order."""

from __future__ import annotations

from collections import Counter
from difflib import SequenceMatcher
from math import ceil

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.classes import MODAL_WORDS, NUMBER_WORDS, SENSE_WORDS, signature
from ..functions.text import split_words
from ..sources.files import short_batches
from .structure import each_document

# Words that don't count for the similarity, least words of a contained statement, words that may be left over.
COMMON_WORDS = (
    "a ante bajo con contra de del desde durante e el en entre la las lo los o para por segun sin sobre u un una uno unos unas y al se su sus que es son ser sera seran este esta estos estas ese esa"
).split()
COMMON = frozenset(COMMON_WORDS)
LEAST_CONTAINED = 3
MOST_LEFT_OVER = 1
#: Stands in the index for a statement of common words alone, which no content word could bring together with another.
BARE = "\u0001"


def order_ratio(a: list[str], b: list[str]) -> float:
    """Twice the words in matching runs over all words, of the words that count; 0 where one has none."""
    a, b = ([w for w in x if w not in COMMON] for x in (a, b))
    return SequenceMatcher(None, a, b, autojunk=False).ratio() if a and b else 0.0


def is_contained(short: list[str], long: list[str]) -> bool:
    """The long statement is the short one, a run of its words, and at most a word besides that doesn't change what it says."""
    n = len(short)
    if n < LEAST_CONTAINED:
        return False
    at = next((i for i in range(len(long) - n + 1) if long[i : i + n] == short), None)
    if at is None:
        return False
    rest = [w for w in long[:at] + long[at + n :] if w not in COMMON]
    changes = lambda w: w in SENSE_WORDS or w in MODAL_WORDS or w in NUMBER_WORDS or w == "%" or any(c.isdigit() for c in w)
    return len(rest) <= MOST_LEFT_OVER and not any(map(changes, rest))


def _reason(x: list[str], y: list[str], share: float, containment: bool) -> str | None:
    """Why two statements say the same, or null; x is the earlier one."""
    short, long = sorted((" ".join(x), " ".join(y)), key=len)
    if containment and f" {short} " in f" {long} " and is_contained(short.split(), long.split()):
        return "contained"
    return "similar" if share < 1 and order_ratio(x, y) >= share else None


def like_forms(forms: list[tuple[str, str]], share: float, containment: bool) -> list[tuple[int, int, str]]:
    """Pairs of a document's distinct forms (form and signature, in order) with one signature that are contained or that much alike: the places of both and why.

    Two forms whose matching runs cover share of their words have that many words in common, so they meet in an index of each one's
    rarest words (a repeated word is several); a contained form lacks at most one content word of the other. The pairs found are
    confirmed on the whole forms.
    """
    words = [form.split() for form, _ in forms]
    terms, often = [], Counter()
    for own, (_, signed) in zip(words, forms, strict=True):
        turns: Counter = Counter()
        mine = []
        for w in own:
            if w not in COMMON:
                turns[w] += 1
                mine.append((signed, w, turns[w]))
        often.update(mine)
        terms.append(mine)
    sets = [frozenset(mine) for mine in terms]
    lists: dict[tuple, list[int]] = {}
    out = []
    for j, mine in enumerate(terms):
        n = len(mine)
        # words that a partner has at least: of matching runs, and of a statement that contains this one or is in it
        least = ceil(n * (share / (2 - share)) - 1e-9)
        least = min(least, n - 1) if containment else least
        rare = [t for t in sorted(mine, key=lambda t: (often[t], t))[: n - least + 1] if often[t] > 1]
        if containment and n <= MOST_LEFT_OVER:
            rare.append((forms[j][1], BARE, 1))
        # a form meets the earlier ones of its lists, so a task holds one form's partners
        for i in sorted({i for t in rare for i in lists.get(t, ()) if t[1] != BARE or not n or not terms[i]}):
            few, many = sorted((len(terms[i]), n))
            # matching runs have no more words than both have in common, in any order, and a contained statement has all of its own in common
            common = len(sets[i] & sets[j])
            if (containment and many - few <= MOST_LEFT_OVER and common == few) or 2 * common >= share * (few + many) - 1e-9:
                if why := _reason(words[i], words[j], share, containment):
                    out.append((i, j, why))
        for t in rare:
            lists.setdefault(t, []).append(j)
    return out


def _groups(share: float, containment: bool):
    def walk(rows: list) -> list[tuple]:
        """The place of the statement that stands for each row's group."""
        forms: dict[str, int] = {}
        signed: list[tuple[str, str]] = []
        for r in rows:
            if r.form and r.form not in forms:
                forms[r.form] = len(signed)
                signed.append((r.form, r.signature))
        near: dict[int, list[int]] = {}
        for a, b, _ in like_forms(signed, share, containment):
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
        best: dict[int, int] = {}
        kept = []
        for r in rows:
            group = at = r.at
            if r.form:
                own = forms[r.form]
                group = min((best[f] for f in (own, *near.get(own, ())) if f in best), default=at)
                best[own] = min(group, best.get(own, group))
            kept.append((group,))
        return kept

    return walk


def unified_like(rows: DataFrame, by: str, order: str, form: Column, wide: Column, share: float = 1.0, containment: bool = False) -> DataFrame:
    """kept (place of the statement that stands for the row's group) of each row: by, order, kept.

    In the order of the document, a statement joins the first group that has a member that says the same: equal in form, contained, or
    with share of its words in matching runs, each under one signature (figures, conjunctions, negations and modals in order). It may so
    join a group whose first statement it isn't like. A wide statement, or one without a form, stays by itself. Documents are walked one by one: a
    task holds one document's statements, which are shuffled once. Rows with a null by or order go.
    """
    short_batches(rows.sparkSession)
    form = F.when(F.coalesce(wide, F.lit(False)), None).otherwise(form)
    own = rows.where(F.col(by).isNotNull() & F.col(order).isNotNull()).select(F.col(by).alias("by"), F.col(order).cast("bigint").alias("at"), form.alias("form"))
    own = own.repartition("by").withColumn("signature", F.md5(F.to_json(signature(split_words(F.col("form"))))))
    return each_document(own, "by", "at", _groups(share, containment), "kept bigint").select(F.col("by").alias(by), F.col("at").alias(order), "kept")
