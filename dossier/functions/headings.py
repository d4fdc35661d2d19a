"""What a paragraph of a norm opens with, by its first characters. The patterns read the same in Java and in RE2."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# How norms write their headings.
ARTICLE = r"^(?:ART[IÍ]CULO|Art[ií]culo|ART\.|Art\.)\s*(\d+)\s*(?:[°º]|o\b)?(?:\s*(bis|ter|quater|BIS|TER|QUATER)\b)?(?:\s*\.?\s*[-—–]+|\.(?:\s|$))"
INDEX = r"^[IÍ]NDICE:?$"
ANNEX = r"^ANEXO(?:\s+([IVXLCDM]+|\d+|[A-Z]))?(?:$|[\s\-—–:.(])"
ANNEX_ONLY = r"^ANEXO(?:\s+(?:[IVXLCDM]+|\d+|[A-Z]))?\s*(?:\([^()]*\)\s*)?$"
TITLE = r"^(T[IÍ]TULO|CAP[IÍ]TULO|SECCI[OÓ]N)\s+([IVXLCDM]+|\d+[ªº°]?)(?:$|[\s\-—–.:])"
CLAUSE = r"^CL[AÁ]USULA TRANSITORIA(?:$|\s)"
VISTO = r"^VISTO\b"
CONSIDERING = r"^(?:Y\s+)?CONSIDERANDO\s*:?\s*$"
RECITAL = r"^Que\s"
FORMULA = r"^Por ello\b"
SIGNATURE = r"^(?:Digitally signed by|Firmado digitalmente por|Date:\s*\d{4}\.\d{2}\.\d{2})"
PUBLICATION = r"^(?:NOTA:.*se publican? en la edici[oó]n web del BORA|e\.\s*\d{1,2}/\d{1,2}(?:/\d{2,4})?\s+N[°º]\s*[\d.]+(?:/\d+)?\s+v\.\s*\d{1,2}/\d{1,2}/\d{2,4}\s*$)"
ITEM = r"^((?:Inciso|INCISO|inciso|Inc\.|inc\.)\s*)?(?:([a-zñ])\)|(\d{1,2})\)|(\d{1,2})\.)(?:\s|$)"
LOOSE_ITEM = r"^((?:Inciso|INCISO|inciso|Inc\.|inc\.)\s*)?(?:([a-zñ])|(\d{1,2}))\)(?:\.\s|[A-ZÁÉÍÓÚÑ])"
LOWER = "[a-záéíóúüñç]"
CLOSING = r"(?:Comun[ií]quese|Reg[ií]strese|Publ[ií]quese)\b[^.]*(?:arch[ií]vese|Direcci[oó]n Nacional del Registro Oficial)"
#: The ladder: what is looked for, and whether the line has to be in capitals.
LADDER = (
    ("article", ARTICLE, False), ("index", INDEX, False), ("annex", ANNEX_ONLY, False), ("annex", ANNEX, True), ("title", TITLE, True), ("clause", CLAUSE, True), ("visto", VISTO, False),
    ("considering", CONSIDERING, False), ("recital", RECITAL, False), ("formula", FORMULA, False), ("signature", SIGNATURE, False), ("publication", PUBLICATION, False),
    ("item", ITEM, False), ("item", LOOSE_ITEM, False),
)
#: What a text that a pattern of the ladder matches begins with, where that is fixed: told before the pattern is asked.
BEGINNINGS = {
    ARTICLE: ("ART", "Art"), INDEX: ("INDICE", "ÍNDICE"), ANNEX_ONLY: ("ANEXO",), ANNEX: ("ANEXO",), TITLE: ("T", "CAP", "SECCI"), CLAUSE: ("CL",), VISTO: ("VISTO",), CONSIDERING: ("CONSIDERANDO", "Y"),
    RECITAL: ("Que",), FORMULA: ("Por ello",), SIGNATURE: ("Digitally", "Firmado", "Date:"), PUBLICATION: ("NOTA:", "e."),
}


def matches(text: Column, pattern: str) -> Column:
    """The text matches a pattern of the ladder; its beginning is asked first, as that costs little."""
    begins = [text.startswith(b) for b in BEGINNINGS.get(pattern, ())]
    return reduce(Column.__or__, begins) & text.rlike(pattern) if begins else text.rlike(pattern)


def capitals(text: Column) -> Column:
    """No small letter and three letters at least."""
    return ~text.rlike(LOWER) & (F.length(F.regexp_replace(text, r"[^\p{L}]", "")) >= 3)


def heading(text: Column) -> Column:
    """article, index, annex, title, clause, visto, considering, recital, formula, signature, publication, item, upper or text."""
    upper, out = capitals(text), F.when(F.lit(False), "text")
    for kind, pattern, only_upper in LADDER:
        out = out.when(matches(text, pattern) & upper if only_upper else matches(text, pattern), kind)
    return out.when(upper & text.rlike(r"^\p{L}"), "upper").otherwise("text")


def heading_groups(text: Column, kind: Column) -> Column:
    """What heading_parts reads: the groups of the pattern of a heading of that kind, parted by tabs; empty for the other kinds."""
    groups = lambda p, *g: F.regexp_replace(text, f"(?s){p}.*", "\t".join(f"${i}" for i in g))
    item = F.when(text.rlike(ITEM), groups(ITEM, 2, 3, 4, 1)).otherwise(F.regexp_replace(text, f"(?s){LOOSE_ITEM}.*", "$2\t$3\t\t$1"))
    return F.when(kind == "article", groups(ARTICLE, 1, 2)).when(kind == "item", item).when(kind == "title", groups(TITLE, 2, 1)).when(kind == "annex", groups(ANNEX, 1)).otherwise("")


def heading_parts(kind: str, groups: str) -> dict:
    """number, suffix, style (letter, paren or dot), word (an item that begins with the word for it) and level (of a title) that a
    heading of that kind has."""
    if kind == "item":
        *forms, word = groups.split("\t", 3)
        number, style = next((n, s) for n, s in zip(forms, ("letter", "paren", "dot"), strict=True) if n)
        return {"number": number, "style": style, "word": bool(word)}
    number, _, rest = groups.partition("\t")
    more = {"suffix": rest.lower()} if kind == "article" else {"level": "TCS".index(rest[0])} if kind == "title" else {}
    return {"number": number, **more}
