"""Text functions on columns.  All are expressions of the JVM but ``nfc``."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache, reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern import lexicons as lex

#: White space as a class that reads the same in Java and RE2: what ``str.split`` splits on.
WS = r"[\t-\r\x{1C}-\x{1F} \x{85}\p{Z}]"
WORD_CHAR = r"[\p{L}\p{N}_]"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once per row: an expression that a lambda names is evaluated for each element otherwise."""
    return F.transform(F.array(value), body)[0]


def nfc(c: Column | str) -> Column:
    """NUL dropped, canonical composition.  Spark has no such function."""

    @F.pandas_udf("string")
    def normalize(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFC", t))

    return normalize(F.replace(col(c), F.lit("\x00"), F.lit("")))


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Characters whose decomposition is a base character and marks, then the marks; and the base characters."""
    pairs, marks = [], []
    for c in map(chr, range(0xC0, sys.maxunicode + 1)):
        if unicodedata.category(c)[0] == "M":
            marks.append(c)
        elif (d := unicodedata.decomposition(c)) and d[0] != "<":
            base = unicodedata.normalize("NFC", "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x)[0] != "M"))
            if len(base) == 1 and base != c:
                pairs.append((c, base))
    return "".join([*(a for a, _ in pairs), *marks]), "".join(b for _, b in pairs)


def strip_accents(c: Column | str) -> Column:
    return F.translate(col(c), *_accents())


def tokens(c: Column | str) -> Column:
    """Runs of a-z, 0-9 and apostrophes of the folded text, in order; null for null."""
    return F.regexp_extract_all(strip_accents(F.lower(col(c))), F.lit("([a-z0-9']+)"), F.lit(1))


def stem(w: Column) -> Column:
    n = F.length(w)
    return F.when((n > 5) & w.endswith("es"), F.substring(w, F.lit(1), n - 2)).when((n > 4) & w.endswith("s"), F.substring(w, F.lit(1), n - 1)).when((n > 6) & w.endswith("cion"), F.substring(w, F.lit(1), n - 4)).otherwise(w)


def content_terms(toks: Column, stopwords: list[str] | None = None) -> Column:
    """Stemmed tokens of more than two characters that are no stop words."""
    stop = F.array(*map(F.lit, stopwords if stopwords is not None else lex.ALL_STOPWORDS))
    return F.transform(F.filter(toks, lambda t: (F.length(t) > 2) & ~F.array_contains(stop, t)), stem)


def squeezed(c: Column | str) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(col(c), WS + "+", " "))


def words(c: Column | str) -> Column:
    """Pieces between white space; empty for null or blank text."""
    s = squeezed(c)
    return F.when(F.coalesce(F.length(s), F.lit(0)) == 0, F.array().cast("array<string>")).otherwise(F.split(s, " "))


def strip(c: Column | str) -> Column:
    return F.regexp_replace(col(c), rf"\A{WS}+|{WS}+\z", "")


def normalized(c: Column | str) -> Column:
    return F.array_join(tokens(c), " ")


def without_fillers(c: Column | str, fillers: list[str] | None = None) -> Column:
    padded = F.concat(F.lit(" "), normalized(c), F.lit(" "))
    return F.trim(reduce(lambda x, f: F.replace(x, F.lit(f" {f} "), F.lit(" ")), fillers or lex.FILLERS, padded))


def slug(c: Column | str, sep: str = "-", length: int = 40, fallback: str | None = "nuevo-tema") -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(strip_accents(col(c))), "[^a-z0-9]+", sep), f"^{sep}+|{sep}+$", "")
    cut = F.regexp_replace(F.substring(s, 1, length), f"{sep}+$", "")
    return F.when(F.coalesce(cut, F.lit("")) == "", F.lit(fallback)).otherwise(cut) if fallback else cut


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays as sets; 0 if either is empty."""
    both, any_ = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), both / any_).otherwise(0.0)


def sentences(c: Column | str) -> Column:
    return F.split(col(c), rf"(?<=[.!?]){WS}+")


def word_count(c: Column | str) -> Column:
    return F.regexp_count(col(c), F.lit(WORD_CHAR + "+"))


def contains_any(c: Column, phrases: list[str]) -> Column:
    return reduce(lambda x, p: x | F.contains(c, F.lit(p)), phrases, F.lit(False))
