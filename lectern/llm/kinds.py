"""Problem 4: figures on the shape of each text, and the kind of each.

Method: weak supervision.  Thresholds on the figures are noisy labelling functions that
vote for a kind (prose, list, table, junk) or abstain; their accuracies are learned by
expectation-maximisation from how they agree over all documents, and the posterior of
each document is the output.  The votes of a document are one small pattern, so only
the counts of distinct patterns (at most 5 to the number of functions, whatever the
number of documents) leave the executors.  Before the first document each function is taken to be
right ``PRIOR`` times, a fixed number: what it is worth is learned (``accuracies``).

Functions 1, 2 and 8 read the same shares of line shapes at different thresholds, so together they
count for more than three independent ones would; with the shape counted once, or with the others freed of
their conditions, the maximum that the rounds reach calls wrapped prose lists or short prose junk (see README).

Null and blank texts have figures 0, votes none, and no kind.  Texts of fewer than
``LEAST_CHARS`` characters without the blanks at both ends get a kind, but do not
count in ``found``.  Rows do not depend on each other; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("prose", "list", "table", "junk")
LEAST_CHARS, PRIOR = 40, 20
#: The most common function words of the four languages.
COMMON = frozenset(
    "a al ante con cuando de del desde e el en entre es esta este la las lo los más no o para pero por que qué se según si sin sino sobre su sus también tras un una y ya "
    "about after an and are as at be between by for from how if in into is it its more of on or some than that the their there this to was what when which who why with would "
    "au aux avec ce cette comme dans des du elle est et il je le les leur mais ne nous où ou par pas plus pour quand qu que qui sa ses son sur une "
    "ao aos as até com como da das do dos ela ele em foi há mais mas na nas nem não nos num os ou pela pelo quando são sem seu sua também um uma".split()
)
#: Words of site navigation.
MENU = frozenset(
    "accept accesibilidad accessibility acceder aceitar aceptar accepter accueil ajuda ajustes anterior archive archives archivo arquivo ayuda aide buscar búsqueda caché carrito cart compartir compartilhar configuración contact contacto contactez contato "
    "cookies cover couverture cuenta descargas downloads download téléchargements enlaces entrar envoyer fechar feed galería galeria galerie gallery help home idioma imprimer imprimir inicio início instagram language langue liens links ligações login logout mapa map plan menu menú next "
    "news newsletter novedades novidades nouvelles panier partager portada capa previous précédent suivant siguiente seguinte print privacidad privacidade privacy profile perfil publicidad rechercher recherche register registrarse registro registo rss s'abonner abonner salir sair search share sitemap "
    "subscribe suscribirse subscrever assinar suscripción terms términos termos top twitter volver voltar accueil connexion déconnexion inscription".split()
)
#: Letters of alphabets; of lower-case texts.
_WORD = re.compile(r"[a-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u0300-\u1fff\u2c00-\u2dff\u3040-\ud7ff]+")
_MARK = re.compile(r"(?:[-*•–—▪◦‣·+>]|\[[ xX]?\]|[☐☑✓✗]|\(?\d{1,3}[.)º°]|\(?[a-zA-Z][.)]|\d{1,3}(?:\.\d{1,3})+\.?|\(?[ivxIVX]{1,5}[.)])\s+")
_ENTRY = re.compile(r"(?:,\s+\d+(?:[–-]\d+)?)+$|(?:\.\s?){4,}\s*\d+$|…+\s*\d+$|\s[·_]{4,}\s*\d+$")
_GLOSS = re.compile(r"^[^:.;]{1,30}: [^:.;]{1,40}$")
_HEX = re.compile(r"^[0-9a-fA-F]{4,16}[: ]\s*(?:[0-9a-fA-F]{2,4}\s+){3,}")
_LOG = re.compile(r"\b(?:WRN|ERR|INF|DBG|WARN|ERROR|INFO|DEBUG|TRACE|FATAL)\b|\brc=\d|0x[0-9a-fA-F]{4,}")
_BLOB = re.compile(r"[A-Za-z0-9+/=_-]{32,}")
_TAG = re.compile(r"</?(?:table|tr|td|th|tbody|thead)\b[^>]*>", re.I)
_GAPS = re.compile(r" {2,}")
_MENU_CUT = re.compile(r"\s*[»›·|/>•\n]\s*|\s{2,}")
_COMMENT = re.compile(r"^\s*<!--.*-->\s*$|^#{1,6}\s")


def _cells(s: str) -> int:
    """How many cells a row of a table has; 1 if the line is none."""
    if "\t" in s and len(s) < 40 * (n := s.count("\t") + 1):
        return n
    if s[0] == "|" or s.count(" | ") > 1:
        return s.strip("|").count("|") + 1
    if ";" in s and (n := s.count(";")) and len(s) / (n + 1) < 26 and "; " not in s:
        return n + 1
    if "," in s and ", " not in s and (n := s.count(",")) and len(s) / (n + 1) < 26:
        return n + 1
    if "  " in s and len(g := _GAPS.split(s)) > 1 and len(s) / len(g) < 40 and not s.endswith((".", ",")):
        return len(g)
    return 1


def _middle(s: str) -> int:
    """Length of the piece without blanks in the middle of a line; one that takes more than half of it stands there."""
    c = len(s) // 2
    return (s.find(" ", c) % (len(s) + 1)) - s.rfind(" ", 0, c) - 1


def line_kind(s: str, words: list[str], letters: int, common: int) -> int:
    """Of one stripped line: 0 prose, 1 list, 2 table, 3 junk, 4 like an unmarked short item, 5 menu."""
    menu = 0 if MENU.isdisjoint(words) else sum(map(MENU.__contains__, words))
    if (
        len(words) > 9 and common > 0.12 * len(words) and letters > 0.7 * len(s) and menu < 4 and s[-1] in ".?!»”" and s[0] != "|" and "  " not in s and "\t" not in s and " | " not in s and ("," not in s or ", " in s)
        and (";" not in s or "; " in s) and (letters > 0.75 * len(s) or not _LOG.search(s)) and not _HEX.match(s) and _middle(s) < 32
    ):
        return 0  # what most lines are: no test below can come to anything else
    if _HEX.match(s) or _LOG.search(s) and letters < 0.75 * len(s):
        return 3
    if (b := _BLOB.search(s)) and len(b.group()) > 0.5 * len(s) and len(set(b.group())) > 8 and not b.group().isalpha():
        return 3
    m = _MARK.match(s)
    body = s[m.end() :] if m else s
    dense = len(s.replace(" ", ""))
    if m and letters > 0.3 * len(body):
        return 0 if len(words) > (3 if s[0] == "—" else 9) and body[-1:] in ".?!»”" else 1
    if _ENTRY.search(s) and letters > 2:
        return 1
    if menu >= 4 and menu > 0.6 * len(words):
        return 5
    if _cells(s) > 2:
        return 2
    if letters < 0.45 * dense:
        return 3
    if len(words) >= 8:
        return 3 if common < 0.06 * len(words) and letters < 9 * len(words) else 0
    if words and menu == len(words):
        return 5
    if _GLOSS.match(s):
        return 1
    return 0 if s[-1] in ".?!»”" or len(s) > 52 else 4


def figures(text: str | None) -> tuple:
    """(n_words, mean_word_length, symbol_ratio, digit_ratio, n_lines, line_end_ratio, common_ratio, vowel_ratio,
    shares of characters on prose, list, table, junk and menu lines, repeated word ratio)."""
    if not text or not text.strip():
        return (0, 0.0, 0.0, 0.0, 0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    if "<t" in text.lower():
        text = re.sub(r"</t[dh]>\s*<t[dh]\b[^>]*>", " | ", text, flags=re.I)
        text = re.sub(r"</tr>\s*", "\n", text, flags=re.I)
        text = re.sub(r"(?m)^.*<td.*$", lambda m: "| " + _TAG.sub("", m.group()) + " |", text, flags=re.I)
        text = _TAG.sub("", text)
    lines = [s for x in text.replace("\r", "\n").split("\n") if (s := x.strip()) and not _COMMENT.match(s)]
    body = "\n".join(lines)
    if not lines:
        lines, body = [text.strip()], text.strip()
    lower = body.lower()
    each = [_WORD.findall(s) for s in lower.split("\n")] if len(lower) == len(body) else [_WORD.findall(s.lower()) for s in lines]
    n = letters = common = 0
    share, before = [0] * 6, ""
    for s, words in zip(lines, each):
        of_line, known = len("".join(words)), sum(map(COMMON.__contains__, words))
        n, letters, common = n + len(words), letters + of_line, common + known
        k = line_kind(s, words, of_line, known)
        share[k] += len(s)
        if before[-1:] == ":" and k in (1, 4):  # a sentence that announces a list is part of it
            share[k] += len(before)
            share[0] -= len(before)
        before = s if k == 0 else ""
    dense = len(body) - body.count(" ") - body.count("\n")
    digits = sum(map(body.count, "0123456789"))
    vowels = sum(map(lower.count, "aeiouyáéíóúâãêôõàèëîïûü" if not lower.isascii() else "aeiouy"))
    # Unmarked short lines are items if they are many; else they are titles or ends of prose lines.
    if share[4] and (sum(len(s) < 45 and s[-1] not in ".?!" for s in lines) > 3 or len(lines) == 1):
        share[1] += share[4] if len(lines) > 1 else 0
        share[0] += share[4] if len(lines) == 1 else 0
    else:
        share[0] += share[4]
    all_chars = sum(map(len, lines))
    ends = sum(s[-1] in ".?!…:»”\"" for s in lines) / len(lines)
    distinct = 1 - len(set().union(*each)) / n if n else 0.0
    ratios = [share[k] / all_chars for k in (0, 1, 2, 3, 5)]
    return (n, letters / n if n else 0.0, (dense - letters - digits) / dense, digits / dense, len(lines), ends, common / n if n else 0.0, vowels / max(1, letters), *ratios, distinct)


NAMES = ("n_words", "mean_word_length", "symbol_ratio", "digit_ratio", "n_lines", "line_end_ratio", "common_ratio", "vowel_ratio", "prose_share", "list_share", "table_share", "junk_share", "menu_share", "repeat_ratio")


def votes(f: tuple) -> str:
    """The labelling functions' votes: a letter each, '-' where one abstains."""
    n, mean, sym, dig, lines, ends, common, vowel, p, li, ta, ju, me, rep = f
    if not lines:
        return ""
    top = max((p, "p"), (li, "l"), (ta, "t"), (ju + me, "j"))
    return "".join(
        (
            top[1],
            top[1] if top[0] > 0.6 else "-",
            "p" if common > 0.16 and p > 0.4 else "j" if common < 0.04 and n > 5 and ta + li < 0.5 else "-",
            "p" if ends > 0.5 and li + ta < 0.5 and ju < 0.5 else "-",
            "j" if sym + dig > 0.55 and ta < 0.5 and li < 0.5 else "p" if sym + dig < 0.06 and common > 0.2 and p >= li else "-",
            "j" if n > 4 and (vowel < 0.3 or mean > 14) and ta < 0.5 else "-",
            "j" if me > 0.5 else "-",
            "t" if ta > 0.5 else "l" if li > 0.5 and ta < 0.3 else "-",
            "p" if lines and n / lines > 12 and common > 0.15 else "-",
        )
    )


LETTER = {"p": 0, "l": 1, "t": 2, "j": 3}


def learn(counts: dict[str, int], rounds: int = 30) -> tuple[dict[str, list[float]], np.ndarray]:
    """Posterior over KINDS of each vote pattern, and the learned chance of each vote (KINDS, then none) by function
    and true kind.  Expectation-maximisation from the majority's view; each function has a confusion row per kind."""
    patterns = sorted(p for p in counts if p)
    if not patterns:
        return {}, np.empty((0, 4, 5))
    m, w = len(patterns[0]), np.array([counts[p] for p in patterns], float)
    seen = np.array([[LETTER.get(c, 4) for c in p] for p in patterns])
    post = np.array([[0.05 + sum(c == k for c in row) for k in range(4)] for row in seen])
    post /= post.sum(1, keepdims=True)
    prior_rows = np.full((4, 5), 0.05) + np.eye(4, 5) * 2
    prior_rows *= PRIOR / prior_rows.sum(1, keepdims=True)
    for _ in range(rounds):
        mass = post * w[:, None]
        prior = (mass.sum(0) + 1) / (mass.sum() + 4)
        logp = np.log(prior)[None, :].repeat(len(patterns), 0)
        tables = np.stack([prior_rows + np.stack([np.bincount(seen[:, j], mass[:, k], 5) for k in range(4)]) for j in range(m)])
        tables /= tables.sum(2, keepdims=True)
        for j in range(m):
            logp += np.log(tables[j][:, seen[:, j]]).T
        post = np.exp(logp - logp.max(1, keepdims=True))
        post /= post.sum(1, keepdims=True)
    return {p: x.tolist() for p, x in zip(patterns, post)}, tables


def _figure_batches(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in pieces:
        f = [figures(t) for t in p["text"]]
        yield pd.DataFrame({"id": p["id"], "n_chars": [len(t.strip()) if t else 0 for t in p["text"]], **dict(zip(NAMES, zip(*f))), "votes": [votes(x) for x in f]}) if len(f) else pd.DataFrame(
            columns=["id", "n_chars", *NAMES, "votes"]
        )


def described(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, the figures, votes), one row per row."""
    kinds = ", ".join(f"{c} {'int' if c in ('n_words', 'n_lines') else 'double'}" for c in NAMES)
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return texts.mapInPandas(_figure_batches, f"id long, n_chars int, {kinds}, votes string")


def _counts(df: DataFrame) -> Counter:
    return Counter({r["votes"]: r["count"] for r in df.where("votes is not null").groupBy("votes").count().collect()})


def accuracies(df: DataFrame) -> DataFrame:
    """(function, kind, voted, right): of documents of a kind, by the posterior, the share that each function votes on, and the share of these votes that is right (null without votes)."""
    rows = [(j + 1, KINDS[k], float(1 - x[4]), float(x[k] / (1 - x[4])) if x[4] < 1 else None) for j, table in enumerate(learn(_counts(df))[1]) for k, x in enumerate(table)]
    return df.sparkSession.createDataFrame(rows, "function int, kind string, voted double, right double")


def posteriors(df: DataFrame) -> DataFrame:
    """``df`` with a column ``votes``, plus ``kind`` and one probability per kind."""
    spark = df.sparkSession
    learned, _ = learn(_counts(df))
    rows = [(p, KINDS[int(np.argmax(x))], *x) for p, x in learned.items()]
    known = spark.createDataFrame(rows, "votes string, kind string, p_prose double, p_list double, p_table double, p_junk double")
    return df.join(F.broadcast(known), "votes", "left")


def found(df: DataFrame) -> DataFrame:
    """(id, kind) of what isn't prose, from ``posteriors``."""
    return df.where((F.col("kind") != "prose") & (F.col("n_chars") >= LEAST_CHARS)).select(F.col("id").alias("doc_id"), "kind").distinct()
