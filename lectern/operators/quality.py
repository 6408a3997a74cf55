"""Predicates on prose quality.  Null and short texts have quality 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import lexicons as lex
from lectern.functions.text import WS, col, let, word_count, words

_bare = lambda w: F.length(F.regexp_replace(w, r"[^\p{L}\p{N}_]", ""))
FIGURE = rf"(?i)(?<![\p{{L}}\p{{N}}_])(?:{"|".join(lex.FIGURE_LABELS)})(?![\p{{L}}\p{{N}}_])"


def prose_quality(text: Column | str, tool: bool = False) -> Column:
    """0 to 1: long words against short ones, numbers, commas and figure labels.  ``tool`` takes the stricter constants of the cleaning tool."""
    t = F.coalesce(col(text), F.lit(""))
    numbers = r"^[\d,.\-/]+$" if tool else r"^[\d,.\-]+$"

    def score(ws: Column) -> Column:
        n = F.greatest(F.size(ws), F.lit(1))
        share = lambda p: F.size(F.filter(ws, p)) / n
        numeric = share(lambda w: w.rlike(numbers))
        commas = (F.length(t) - F.length(F.replace(t, F.lit(","), F.lit("")))) / n
        figures = F.regexp_count(t, F.lit(FIGURE)) / n
        base = let(F.transform(ws, _bare), lambda sizes: F.size(F.filter(sizes, lambda k: k >= 5)) / n - F.size(F.filter(sizes, lambda k: k <= 2)) / n * 0.4)
        clamp = lambda x: F.greatest(F.lit(0.0), F.least(x, F.lit(1.0)))
        if tool:
            letters = F.length(F.regexp_replace(t, r"[^\p{L}]", "")) / F.greatest(F.length(t), F.lit(1))
            told = F.when((numeric > 0.20) | (letters < 0.35), 0.02).when(commas > 0.30, 0.03).otherwise(clamp(base - figures * 3))
        else:
            told = F.when(numeric > 0.20, 0.0).when(commas > 0.30, 0.03).otherwise(clamp(base - F.least(figures * 4, F.lit(0.35))))
        return F.round(F.when(F.size(ws) < 5, 0.0).otherwise(told), 6)

    return let(words(t), score)


def sentence_quality(sentence: Column | str) -> Column:
    ws = words(F.coalesce(col(sentence), F.lit("")))
    return F.when(F.size(ws) == 0, 0.0).otherwise(F.size(F.filter(ws, lambda w: _bare(w) >= 5)) / F.size(ws))


def bad_sentence(sentence: Column | str, tool: bool = False) -> Column:
    """True for captions, list entries, tables and other debris."""
    s = F.coalesce(col(sentence), F.lit(""))
    ws = words(s)
    n = F.size(ws)
    share = lambda p: F.size(F.filter(ws, p)) / F.greatest(n, F.lit(1))
    bad = (n < (4 if tool else 5)) | s.rlike("(?i)" + (lex.INSTRUMENTS_TOOL if tool else lex.INSTRUMENTS)) | s.rlike(rf"^{WS}*(?:{'|'.join(lex.NUMERALS)})(?![\p{{L}}\p{{N}}_])")
    bad = bad | s.rlike(rf"^{WS}*\d+[.)]{WS}") | s.rlike(rf"\.{WS}+\d+[.)]") | (share(lambda w: w.rlike(r"\d")) > 0.30)
    bad = bad | ((n >= 7) & (share(lambda w: w.rlike(r"^\p{Lu}")) > 0.45)) | (sentence_quality(s) < (0.28 if tool else 0.30))
    if tool:
        bad = bad | s.rlike(rf"(?i)^(?:{'|'.join(lex.TITLES).replace(' ', WS)}){WS}+[A-Z]")
    return bad


def is_table_row(line: Column | str) -> Column:
    from lectern.operators.cleaning import _cells

    return (F.size(_cells(col(line))) >= 3) & ~F.trim(col(line)).startswith("#")


def thin_files(files: DataFrame, path_col: str = "source", text_col: str = "text", least: int = 80) -> DataFrame:
    """(path, n_words, state): files without words, with fewer than ``least``, or ok; passages of a file add up."""
    per = files.groupBy(path_col).agg(F.sum(F.coalesce(word_count(text_col), F.lit(0))).alias("n_words"))
    return per.select(path_col, "n_words", F.when(F.col("n_words") == 0, "empty").when(F.col("n_words") < least, "thin").otherwise("ok").alias("state"))
