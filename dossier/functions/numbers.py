"""Numbers spelt out in Spanish, read by a grammar of their word classes."""

from __future__ import annotations

import re

# The number words without accents, by class.
UNITS = {"un": 1, "uno": 1, "una": 1, "dos": 2, "tres": 3, "cuatro": 4, "cinco": 5, "seis": 6, "siete": 7, "ocho": 8, "nueve": 9}
TEENS = {w: 10 + i for i, w in enumerate("diez once doce trece catorce quince dieciseis diecisiete dieciocho diecinueve veinte".split())} | {f"veinti{w}": 20 + n for w, n in UNITS.items()}
TENS = {w: 30 + 10 * i for i, w in enumerate("treinta cuarenta cincuenta sesenta setenta ochenta noventa".split())}
HUNDREDS = {"ciento": 100} | {stem + end: 100 * n for n, stem in enumerate("doscient trescient cuatrocient quinient seiscient setecient ochocient novecient".split(), 2) for end in ("os", "as")}
HUNDRED, THOUSAND, MILLION = {"cien": 100}, "mil", ("millon", "millones")
VALUES = UNITS | TEENS | TENS | HUNDREDS | HUNDRED

#: Classes of words as patterns; the longest word first, as un begins uno.
_of = lambda words: "(?:" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + ")"
_BELOW_HUNDRED = f"(?:{_of(TENS)}(?: y {_of(UNITS)})?|{_of({**TEENS, **UNITS})})"
_BELOW_THOUSAND = f"(?:{_of(HUNDREDS)}(?: {_BELOW_HUNDRED})?|{_BELOW_HUNDRED}|cien)"
_LOWER = f"(?:(?:{_BELOW_THOUSAND} )?{THOUSAND}(?: {_BELOW_THOUSAND})?|{_BELOW_THOUSAND})"
#: A number: millions, then thousands, then the rest; each part may be all there is. A share (por ciento, por mil) is none.
NUMBER = rf"(?<![^\W\d_])(?!(?<=\bpor )(?:cien|ciento|mil)\b)(?:(?:{_BELOW_THOUSAND} )?{_of(MILLION)}(?: {_LOWER})?|{_LOWER})(?![^\W\d_])"
_FOUND = re.compile(NUMBER)


def value_of(number: str) -> int:
    """The value of a number in words: each scale multiplies what stands before it since the last one, or one."""
    total = part = 0
    for word in number.split():
        if word == THOUSAND or word in MILLION:
            total, part = total + (part or 1) * (1000 if word == THOUSAND else 1_000_000), 0
        else:
            part += VALUES.get(word, 0)  # y adds nothing
    return total + part


def figures(text: str) -> str:
    """A folded text with its numbers in words as figures."""
    return _FOUND.sub(lambda m: str(value_of(m[0])), text)
