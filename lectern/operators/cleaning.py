"""Cleaning steps, each a column expression, and their composition.

Null stays null; empty text stays empty.  Steps work on one row alone, so repeated rows and
other columns do not matter."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern import lexicons as lex
from lectern.functions.text import WORD_CHAR, WS, col, let, nfc, squeezed, strip, words

PAGE_NUMBER = rf"(?imd)^{WS}*(?:p[aá]g(?:ina)?\.?{WS}*\d+|page{WS}*\d+|\d+{WS}*/{WS}*\d+|\[{WS}*\d+{WS}*\]|[-–—]{WS}*\d+{WS}*[-–—]|\d+){WS}*$"
LIST_ITEM = rf"^(?:[-*•·]|\d+[.)]){WS}"
CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}\x{E000}-\x{F8FF}]"


def _lines(c: Column) -> Column:
    return F.split(c, "\n")


def _unlines(a: Column) -> Column:
    return F.array_join(a, "\n")


def pdf_artifacts(c: Column | str) -> Column:
    """Ligatures spelled out, words divided at a line end joined, lines of a page number blanked."""
    c = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), lex.LIGATURES.items(), col(c))
    return F.regexp_replace(F.regexp_replace(c, f"-\n({WORD_CHAR})", "$1"), PAGE_NUMBER, "")


def entities(c: Column | str) -> Column:
    plain = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), lex.ENTITIES.items(), col(c))
    return F.when(~col(c).contains("&"), col(c)).otherwise(F.regexp_replace(plain, f"&#?{WORD_CHAR}+;", ""))


def control_characters(c: Column | str) -> Column:
    return F.regexp_replace(col(c), CONTROL, "")


def whitespace(c: Column | str) -> Column:
    c = F.translate(F.regexp_replace(col(c), "\r\n?", "\n"), "\t", " ")
    c = F.regexp_replace(F.regexp_replace(c, " {2,}", " "), "(?md)^ +$", "")
    return strip(F.regexp_replace(c, "\n{3,}", "\n\n"))


def short_noise_lines(c: Column | str, min_words: int = 2) -> Column:
    noise = F.array(*map(F.lit, lex.NOISE_WORDS))

    def kept(line: Column) -> Column:
        s = strip(line)
        # In the order of what tells most lines apart at least cost: few are that short.
        noisy = ((F.length(s) < 4) | F.array_contains(noise, F.lower(s))) & ~F.substring(s, -1, 1).isin(".", ":", "?", "!") & (F.size(words(line)) < min_words)
        return ~noisy | (s == "") | s.startswith("#") | s.rlike(LIST_ITEM)

    return _unlines(F.filter(_lines(col(c)), kept))


def duplicate_paragraphs(c: Column | str, min_words: int = 6) -> Column:
    """Drops a paragraph of at least ``min_words`` words seen before in the text."""
    paragraphs = F.split(col(c), "\n{2,}")
    keyed = F.transform(paragraphs, lambda p, i: F.struct(squeezed(F.lower(p)).alias("k"), i.alias("i"), p.alias("p")))
    # Sorted by key, the first of each run of equal keys is the first in the text.
    fresh = lambda order: F.filter(order, lambda x, i: (F.size(F.split(x["k"], " ")) < min_words) | (i == 0) | (F.get(order, i - 1)["k"] != x["k"]))
    back = F.array_sort(F.transform(let(F.array_sort(keyed), fresh), lambda x: F.struct(x["i"].alias("i"), x["p"].alias("p"))))
    return F.array_join(F.transform(back, lambda x: x["p"]), "\n\n")


def punctuation(c: Column | str) -> Column:
    c = F.translate(col(c), *lex.QUOTES)
    c = F.regexp_replace(c, rf"(?<!{WS})[–—](?!{WS})", "-")
    c = F.regexp_replace(F.regexp_replace(c, r"\.{3,}", "..."), r" ([.,;:!?])", "$1")
    return F.regexp_replace(c, r"\.{2}(?!\.)", ".")


def _islands(flags: Column, least: int) -> Column:
    """Of an array of booleans, which true ones stand in a run of at least ``least``: some window of that size around them is all true."""
    at = lambda f, i: F.coalesce(F.get(f, i), F.lit(False))

    def inside(f: Column) -> Column:
        windows = lambda i: reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [at(f, i - k + j) for j in range(least)]) for k in range(least)])
        return F.transform(f, lambda x, i: x & windows(i))

    return let(flags, inside)


def _cells(line: Column) -> Column:
    return F.filter(F.transform(F.split(strip(line), " {2,}"), strip), lambda x: x != "")


def broken_tables(c: Column | str) -> Column:
    """Two or more lines in a row of at least three cells each become ``a | b | c``."""
    lines = _lines(col(c))
    flags = F.transform(lines, lambda s: (F.size(_cells(s)) >= 3) & ~strip(s).startswith("#"))
    return F.when(~col(c).contains("  "), col(c)).when(~F.exists(flags, lambda x: x), col(c)).otherwise(_unlines(F.zip_with(lines, _islands(flags, 2), lambda s, row: F.when(row, F.array_join(_cells(s), " | ")).otherwise(s))))


_COLUMNS = r"^(.+?\S) {3,}(\S.+)"


def double_columns(c: Column | str, min_block: int = 4) -> Column:
    """Runs of at least ``min_block`` lines with a wide gap: all left parts, then all right parts."""
    lines = _lines(col(c))
    rstrip = lambda s: F.regexp_replace(s, rf"{WS}+\z", "")
    flags = F.transform(lines, lambda s: rstrip(s).rlike(_COLUMNS))
    marked = F.arrays_zip(lines.alias("s"), _islands(flags, min_block).alias("m"))
    part = lambda s, k: strip(F.regexp_extract(rstrip(s), _COLUMNS, k))
    zero = F.struct(F.array().cast("array<string>").alias("out"), F.array().cast("array<string>").alias("l"), F.array().cast("array<string>").alias("r"))
    flush = lambda a: F.when(F.size(a["l"]) > 0, F.concat(a["out"], F.array(F.array_join(a["l"], " "), F.array_join(a["r"], " ")))).otherwise(a["out"])
    none = F.array().cast("array<string>")

    def step(a: Column, x: Column) -> Column:
        s, m = x["s"], x["m"]
        return F.when(m, F.struct(a["out"].alias("out"), F.concat(a["l"], F.array(part(s, 1))).alias("l"), F.concat(a["r"], F.array(part(s, 2))).alias("r"))).otherwise(F.struct(F.concat(flush(a), F.array(s)).alias("out"), none.alias("l"), none.alias("r")))

    folded = F.aggregate(F.transform(marked, lambda x: F.struct(x["s"].alias("s"), x["m"].alias("m"))), zero, step, flush)
    return F.when(~col(c).contains("   "), col(c)).when(~F.exists(flags, lambda x: x), col(c)).otherwise(_unlines(folded))


def _repeated(keys: Column, least: int) -> Column:
    """Distinct values that stand at least ``least`` times in an array."""
    return let(F.array_sort(keys), lambda order: F.array_distinct(F.filter(order, lambda x, i: F.get(order, i + least - 1) == x)))


def repeated_headers(c: Column | str, min_count: int = 3, max_words: int = 10) -> Column:
    lines = _lines(col(c))
    key = lambda s: F.lower(strip(s))
    short = F.filter(lines, lambda s: (strip(s) != "") & ~strip(s).startswith("#") & (F.size(words(s)) <= max_words))
    kept = lambda gone: F.when(F.size(gone) == 0, col(c)).otherwise(_unlines(F.filter(lines, lambda s: ~F.array_contains(gone, key(s)) | strip(s).startswith("#"))))
    return let(_repeated(F.transform(short, key), min_count), kept)


def watermarks(c: Column | str) -> Column:
    lines = _lines(col(c))
    marks = F.array(*map(F.lit, lex.WATERMARKS))
    capital = F.filter(F.transform(lines, strip), lambda s: (F.upper(s) == s) & (F.lower(s) != s) & (F.length(s) >= 3) & (F.size(words(s)) == 1))
    mark = lambda s: F.array_contains(marks, F.lower(strip(s)))
    return let(_repeated(capital, 3), lambda gone: _unlines(F.filter(lines, lambda s: ~(mark(s) | ((F.size(gone) > 0) & F.array_contains(gone, strip(s)))))))


def _final(c: Column) -> Column:
    return strip(F.regexp_replace(F.regexp_replace(c, " {2,}", " "), "\n{3,}", "\n\n"))


def clean(c: Column | str, aggressive: bool = False) -> list[tuple[str, callable]]:
    """The steps of the whole cleaning in order, as (name, function of a column)."""
    geometry = [("tables", broken_tables), ("columns", double_columns)] if aggressive else []
    return [
        ("nfc", nfc), ("pdf", pdf_artifacts), *geometry, ("entities", entities), ("control", control_characters), ("whitespace", whitespace), ("headers", repeated_headers), ("watermarks", watermarks),
        ("short", lambda x: short_noise_lines(x, 4 if aggressive else 2)), ("paragraphs", duplicate_paragraphs), ("punctuation", punctuation), ("final", lambda x: _final(col(x))),
    ]


def cleaned(df: DataFrame, text_col: str = "text", out_col: str = "cleaned", aggressive: bool = False) -> DataFrame:
    """Adds the cleaned text.  Each step reads the column of the one before, so expressions stay small."""
    df = df.withColumn(out_col, F.col(text_col))
    for _, step in clean(text_col, aggressive):
        df = df.withColumn(out_col, step(F.col(out_col)))
    return df


def clean_stats(original: Column | str, cleaned_text: Column | str) -> list[Column]:
    o, c = col(original), col(cleaned_text)
    ow, cw = F.size(words(o)), F.size(words(c))
    lines = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))) + 1
    return [
        F.length(o).alias("original_chars"), F.length(c).alias("cleaned_chars"), (F.length(o) - F.length(c)).alias("removed_chars"), ow.alias("original_words"), cw.alias("cleaned_words"), (ow - cw).alias("removed_words"),
        lines(o).alias("original_lines"), lines(c).alias("cleaned_lines"), F.round((1 - F.length(c) / F.greatest(F.length(o), F.lit(1))) * 100, 1).alias("reduction_pct"),
    ]


def running_headers(pages: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text", min_pages: int = 3, max_words: int = 12) -> DataFrame:
    """(doc, line) of short lines that stand on at least ``min_pages`` pages of a document.  Counted per line, so no document is held in one task."""
    lines = pages.where(F.col(text).isNotNull()).select(doc, page, F.explode(F.array_distinct(F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), squeezed))).alias("line"))
    short = lines.where((F.col("line") != "") & (F.size(F.split("line", " ")) <= max_words)).distinct()
    return short.groupBy(doc, "line").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= min_pages)


def without_running_headers(pages: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text", min_pages: int = 3, max_words: int = 12) -> DataFrame:
    """(doc, page, text) with those lines removed.  Repeated (doc, page, text) rows come out once."""
    rows = pages.select(doc, page, text).distinct()
    gone = running_headers(rows, doc, page, text, min_pages, max_words)
    on_page = rows.select(doc, page, F.explode(F.array_distinct(F.transform(F.split(text, "\n"), squeezed))).alias("line")).join(gone.select(doc, "line"), [doc, "line"])
    per = on_page.groupBy(doc, page).agg(F.collect_set("line").alias("gone"))
    kept = F.filter(F.split(text, "\n"), lambda s: ~F.array_contains("gone", squeezed(s)))
    return rows.join(per, [doc, page], "left").select(doc, page, F.when(F.col("gone").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias(text))
