"""Pieces of SQL for the oracle: scalar expressions over a text, built to be nested."""

from __future__ import annotations

from functools import reduce

from lectern import lexicons as lex
from lectern.functions.text import WS
from lectern.operators.cleaning import CONTROL

NL = "chr(10)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strings(xs) -> str:
    return "[" + ", ".join(map(q, xs)) + "]"


def sub(x: str, pattern: str, to: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {to if to.startswith('chr') else q(to)}, 'g')"


def strip(x: str) -> str:
    return sub(x, rf"\A{WS}+|{WS}+\z", "")


def squeezed(x: str) -> str:
    return f"trim({sub(x, WS + '+', ' ')})"


def words(x: str) -> str:
    return f"list_filter(string_split({squeezed(x)}, ' '), lambda w: w <> '')"


def tokens(x: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({x})), {q('[a-z0-9' + chr(39) + ']+')})"


def stem(w: str) -> str:
    return f"CASE WHEN length({w}) > 5 AND ends_with({w}, 'es') THEN left({w}, length({w}) - 2) WHEN length({w}) > 4 AND ends_with({w}, 's') THEN left({w}, length({w}) - 1) WHEN length({w}) > 6 AND ends_with({w}, 'cion') THEN left({w}, length({w}) - 4) ELSE {w} END"


def content(toks: str, stop=None) -> str:
    return f"list_transform(list_filter({toks}, lambda t: length(t) > 2 AND NOT list_contains({strings(lex.ALL_STOPWORDS if stop is None else stop or ['-'])}, t)), lambda w: {stem('w')})"


def pdf_artifacts(x: str) -> str:
    x = reduce(lambda y, kv: f"replace({y}, {q(kv[0])}, {q(kv[1])})", lex.LIGATURES.items(), x)
    x = sub(x, r"-\n([\pL\pN_])", r"\1")
    from lectern.operators.cleaning import PAGE_NUMBER

    return sub(x, PAGE_NUMBER.replace("(?imd)", "(?im)"), "")


def entities(x: str) -> str:
    return sub(reduce(lambda y, kv: f"replace({y}, {q(kv[0])}, {q(kv[1])})", lex.ENTITIES.items(), x), r"&#?[\pL\pN_]+;", "")


def control(x: str) -> str:
    return sub(x, CONTROL, "")


def whitespace(x: str) -> str:
    x = f"replace(replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(9), ' ')"
    return strip(sub(sub(sub(x, " {2,}", " "), "(?m)^ +$", ""), "\n{3,}", "\n\n"))


def short_lines(x: str, least: int = 2) -> str:
    s = strip("l")
    noisy = f"(len({words('l')}) < {least} AND right({s}, 1) NOT IN ('.', ':', '?', '!') AND (list_contains({strings(lex.NOISE_WORDS)}, lower({s})) OR length({s}) < 4))"
    kept = f"{s} = '' OR starts_with({s}, '#') OR regexp_matches({s}, {q(rf'^(?:[-*•·]|\d+[.)]){WS}')}) OR NOT {noisy}"
    return f"array_to_string(list_filter(string_split({x}, {NL}), lambda l: {kept}), {NL})"


def punctuation(x: str) -> str:
    x = f"translate({x}, {q(lex.QUOTES[0])}, {q(lex.QUOTES[1])})"
    # No look-around: a dash between two signs that are no blanks, at either end of the text too; twice, for neighbours share a sign.
    ns = WS[:1] + "^" + WS[1:]
    for _ in range(2):
        x = sub(x, rf"(\A|{ns})[–—]({ns}|\z)", r"\1-\2")
    x = sub(sub(x, r"\.{3,}", "..."), r" ([.,;:!?])", r"\1")
    # Two points that no third follows become one; of three or more the last two do.
    return sub(x, r"(\.*)\.\.([^.]|\z)", r"\1.\2")
