"""Problem 3: text decoded or converted with a wrong character encoding.

Method: best-first graph search.  The states are the texts reachable from a run of
characters by encoding it in one character set and decoding the bytes in another, or
by unescaping entities; visited states are hashed; the frontier is ordered by a
character-plausibility cost, and the cheapest text reached is the repair.  The search ends
when no text that is left to reach can be cheaper, for each step costs ``STEP``: it has no
limit on states or depth.  Reading single bytes in another set twice in a row is one wrong
reading too many for any text and is no path.  Runs are the
pieces between ASCII blanks (a damaged text keeps those), so that damage in a part
of a document is found and repaired in place; each distinct run is searched once per
worker process.  A run of more than ``LONG`` characters is cut after ASCII signs, at NBSP before
ASCII and at ``LONG`` where it has neither, but never between two characters that aren't ASCII.

A document counts as affected if its runs get at least ``LEAST`` cheaper, or if
characters are gone for good: U+FFFD, or a question mark within words (no search can tell, so a
plain test does).  Runs that are a quoted sequence without a letter of its own are quotations.

Null, empty and ASCII texts give no row in ``affected`` and themselves in ``repaired``.
Rows are independent of each other: repeated rows give repeated results from
``repaired`` and one row from ``affected``.  Other columns are not touched.
"""

from __future__ import annotations

import heapq
import html
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 1.5
STEP, BETTER = 0.2, 0.5
LONG = 400
_SINGLE = ("cp1252", "latin-1", "mac_roman", "cp1251", "cp850", "cp437")
_LETTERS = "áéíóúüñçàâêîôûèùëïãõœÿ"
_LETTERS += _LETTERS.upper()
_OPEN, _CLOSE, _PLAIN = "¿¡«“‘‹„•—–-(", "»”’›…—–ºª®™", "¿¡«»“”‘’‹›—–…•·°ºª©®™±€£§½¼¾µ×÷¹²³"
#: ``examine`` looks at nothing else, so texts without any of it can't be affected.
SUSPECT = r"[^\x{00}-\x{7F}]|&#|\?"
_LOST = re.compile(r"[a-zà-ÿA-ZÀ-Ý]\?[a-zà-ÿ]|(?<![\w?])\?[a-zà-ÿ]{4}")
_URL = re.compile(r"https?:|www\.|[/=&]")
_RUN = re.compile(r"[^ \t\r\n]+")
_PART = re.compile(r"[^\x00-\x7F]*\xa0(?=[\x00-\x7F])|[^\x00-\x7F]*(?:(?:&(?:amp;)*#\w+;)+|[\x00-\x7F])|[^\x00-\x7F]+")
_ASCII_LETTER = re.compile(r"[A-Za-z]")
_QUOTED = re.compile(r"""^[(\[]*[«“"'‘„‹`]+[^A-Za-z]+[»”"'’›`]+[)\].,;:!?]*$""")
_memo: dict[str, tuple[str, float, tuple]] = {}


def cost(text: str) -> float:
    """How implausible the characters are where they stand; 0 for plain text."""
    total, ascii_letters, n = 0.0, bool(_ASCII_LETTER.search(text)), len(text)
    for i, c in enumerate(text):
        if c < "\x80":
            continue
        o = ord(c)
        before, after = (text[i - 1] if i else " "), (text[i + 1] if i + 1 < n else " ")
        if o < 0xA0:
            total += 3
        elif c == "\xa0":
            total += 0.3
        elif c == "\xad":
            total += 1
        elif c in _LETTERS or 0xC0 <= o < 0x250 and c.isalpha():
            known = c in _LETTERS
            if c.isupper() and before.islower():
                total += 3
            elif c.isupper() and after >= "\x80" and (not after.isalpha() or after in "ºª"):
                total += 0 if known and c not in "ÂÃ" and before.isupper() and after in "»”’›…—–" and not text[i + 2 : i + 3].isalpha() else 3
            elif not known:
                total += 1
        elif 0x300 <= o < 0x370 or o in (0x200B, 0xFEFF, 0x200D, 0xFE0F):
            total += 0.5 if o >= 0x2000 else 0
        elif c.isalpha() and c not in _PLAIN:
            total += 3 if ascii_letters else 1
        elif c in _PLAIN or o < 0x100 or 0x2000 <= o < 0x2200:
            left, right = before.isalpha(), after.isalpha()
            if left and right:
                total += 0 if c in "’'" else 0.5 if c in "—–-" else 3
            elif right and c not in _OPEN:
                total += 2 if text[i + 1 : i + 4].isalpha() and len(text) > i + 3 else 0
            elif left and c not in _CLOSE:
                total += 2
            elif c not in _PLAIN:
                total += 1
            elif before >= "\x80" and before.isalpha() and before.isupper():
                total += 1
        else:
            total += 2 if ascii_letters else 1
    return total


def _encode(text: str, charset: str) -> bytes | None:
    try:
        return text.encode(charset)
    except UnicodeError:
        if charset != "cp1252":
            return None
    try:  # bytes that cp1252 leaves undefined come through as control characters
        return b"".join(c.encode("latin-1") if "\x80" <= c < "\xa0" else c.encode(charset) for c in text)
    except UnicodeError:
        return None


def _apply(text: str, step: tuple[str, str]) -> str | None:
    if step[0] == "unescape":
        return html.unescape(text)
    raw = _encode(text, step[0])
    try:
        return None if raw is None else raw.decode(step[1])
    except UnicodeError:
        return None


def _steps(text: str, reread: bool = True):
    """(text, step) of each text one step away; ``reread``: whether single bytes may be read in another single-byte set."""
    if "&" in text and (u := html.unescape(text)) != text:
        yield u, ("unescape", "")
    for a in _SINGLE:
        if (raw := _encode(text, a)) is None:
            continue
        for b in ("utf-8", *_SINGLE) if reread else ("utf-8",):
            if a != b:
                try:
                    yield raw.decode(b), (a, b)
                except UnicodeError:
                    continue


def _cost(text: str) -> float:
    return cost(text) + text.count("&#") + 2 * text.count("&amp;#")


def repair_run(run: str) -> tuple[str, float, tuple]:
    """The cheapest reachable text, the gain, and the steps that lead there."""
    if run in _memo:
        return _memo[run]
    if len(_memo) > 300_000:
        _memo.clear()
    start = _cost(run)
    best, best_cost, best_path = run, start, ()
    lettered = bool(_ASCII_LETTER.search(run))
    if start >= 1 and (lettered or any(to == "utf-8" for _, (_, to) in _steps(run, False))):
        frontier, seen = [(start, 0, run, (), True)], {(run, True)}
        while frontier:
            c, depth, text, path, reread = heapq.heappop(frontier)
            if c < best_cost - BETTER:
                best, best_cost, best_path = text, c, path
            if c <= STEP * depth:  # plausible throughout: what is left to reach can only have more steps or more cost
                break
            if STEP * (depth + 1) >= best_cost - BETTER:
                continue
            for to, step in _steps(text, reread):
                after = step[1] in ("utf-8", "")
                if (to, after) not in seen and (lettered or depth or step[1] == "utf-8"):
                    seen.add((to, after))
                    heapq.heappush(frontier, (_cost(to) + STEP * (depth + 1), depth + 1, to, (*path, step), after))
    _memo[run] = best, start - best_cost, best_path
    return _memo[run]


def _along(run: str, path: tuple) -> str | None:
    for step in path:
        if (run := _apply(run, step)) is None:
            return None
    return run


def runs(text: str) -> Iterator[tuple[int, str]]:
    """(place, run) of the pieces that are searched."""
    for m in _RUN.finditer(text):
        if len(m.group()) <= LONG or m.group().isascii() and "&#" not in m.group():
            yield m.start(), m.group()
            continue
        at, held = m.start(), ""
        for part in _PART.findall(m.group()):
            if held and (len(held) + len(part) > LONG or held[-1] == "\xa0" or held[-1].isascii() and not held[-1].isalnum() and held[-1] not in "&#;'"):
                yield at, held
                at, held = at + len(held), ""
            held += part
        yield at, held


def examine(text: str) -> tuple[bool, str]:
    """(affected, repaired text).  The steps that gain most over the document are
    preferred for each of its runs where they lead to a text about as plausible."""
    gain, lost, found, paths = 0.0, 0, [], {}
    for start, run in runs(text):
        if run.isascii() and "&#" not in run or _QUOTED.match(run):
            continue
        if "\ufffd" in run:
            lost += 1
            continue
        to, won, path = repair_run(run)
        if path:
            found.append((start, start + len(run), run, to if won >= 1 else run))
        if path and won >= 1:
            if any(s[1] == "utf-8" for s in path) or _ASCII_LETTER.search(run) and "&#" not in run:
                gain += won
                paths[path] = paths.get(path, 0) + won
    marks = 0
    if "?" in text:
        marks = sum(1 for m in _LOST.finditer(text) if not _URL.search(text[max(0, m.start() - 40) : m.end() + 40]))
    if gain < LEAST:
        return bool(lost or marks), text
    path = max(paths, key=lambda p: (paths[p], str(p)))
    pieces, at = [], 0
    for a, b, run, to in found:
        same = _along(run, path)
        pieces += [text[at:a], same if same is not None and _cost(same) <= (_cost(to) + 1.5 if to != run else _cost(run) - 0.5) else to]
        at = b
    return True, "".join(pieces) + text[at:]


def _examined(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in pieces:
        r = [examine(t) for t in p["text"]]
        yield pd.DataFrame({"id": p["id"], "affected": [x[0] for x in r], "text_restored": [x[1] for x in r]})


def repaired(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each affected row's id and restored text."""
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.col("text").rlike(SUSPECT))
    return texts.mapInPandas(_examined, "id long, affected boolean, text_restored string").where("affected").select(F.col("id").alias(id_col), "text_restored")


def affected(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return repaired(df, id_col, text_col).select(id_col).distinct()
