"""Cutting cleaned text into overlapping passages, and the import pipeline around it."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.operators import cleaning

_END = re.compile(r"(?<=[.!?])\s+")


def pack(text: str | None, most: int = 300, overlap: int = 50, least: int = 10) -> list[str]:
    """Sentences packed greedily into pieces of at most ``most`` words, each beginning with the last
    sentences of the one before that have at most ``overlap`` words (one at least).  Pieces of
    ``least`` words or fewer are dropped.  Null and blank texts give none."""
    if not text or not text.strip():
        return []
    sents = _END.split(text)
    sizes = [len(s.split()) for s in sents]
    spans, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if total + n > most and i > start:
            spans.append((start, i))
            start, total = i - 1, sizes[i - 1]
            while start > spans[-1][0] and total + sizes[start - 1] <= overlap:
                start -= 1
                total += sizes[start]
        total += n
    spans.append((start, len(sents)))
    pieces = (" ".join(sents[a:b]).strip() for a, b in spans)
    return [p for p in pieces if len(p.split()) > least]


def chunks(df: DataFrame, id_cols: list[str], text_col: str = "text", most: int = 300, overlap: int = 50) -> DataFrame:
    """(ids, chunk, text): one row per piece; packing is sequential within a text, so it runs on Arrow batches of whole texts."""

    @F.pandas_udf("array<string>")
    def packed(s: pd.Series) -> pd.Series:
        return s.map(lambda t: pack(t, most, overlap))

    return df.select(*id_cols, F.posexplode(packed(F.col(text_col))).alias("chunk", "chunk_text")).select(*id_cols, "chunk", F.col("chunk_text").alias("text"))


def paged_chunks(pages: DataFrame, doc: str = "doc_id", page: str = "page", text: str = "text", most: int = 300, overlap: int = 50) -> DataFrame:
    """Pages of files: running headers dropped, each page cleaned and cut, so that no piece spans two pages."""
    body = cleaning.without_running_headers(pages, doc, page, text)
    return chunks(cleaning.cleaned(body, text, "cleaned", aggressive=True), [doc, page], "cleaned", most, overlap)


def content_hash(c: str = "content"):
    return F.sha2(F.col(c), 256)


def imported(files: DataFrame, registry: DataFrame, domains: DataFrame, least_chars: int = 50) -> DataFrame:
    """(doc_id, file_hash, filename, status, domain, text_length): what becomes of each file.

    'duplicate' if its hash is registered or an earlier file of the batch has it, 'empty_or_unreadable' below ``least_chars``
    cleaned characters, else 'imported'.  Files are (doc_id, filename, text); domains (doc_id, domain)."""
    hashed = files.withColumn("file_hash", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    first = hashed.groupBy("file_hash").agg(F.min("doc_id").alias("first"))
    known = registry.select("file_hash").where("file_hash is not null").distinct().withColumn("known", F.lit(True))
    cleaned = cleaning.cleaned(hashed, "text", "cleaned")
    joined = cleaned.join(first, "file_hash").join(known, "file_hash", "left").join(domains, "doc_id", "left")
    size = F.coalesce(F.length("cleaned"), F.lit(0))
    status = F.when(F.col("known") | (F.col("doc_id") != F.col("first")), "duplicate").when(size < least_chars, "empty_or_unreadable").otherwise("imported")
    return joined.select("doc_id", "file_hash", "filename", status.alias("status"), F.when(status == "imported", F.coalesce("domain", F.lit("general"))).alias("domain"), size.alias("text_length"))


def unseen(files: DataFrame, registry: DataFrame, hash_col: str = "file_hash") -> DataFrame:
    """Files whose hash is not registered, one row per hash."""
    return files.join(registry.select(hash_col).distinct(), hash_col, "left_anti").dropDuplicates([hash_col])


# --- passages of scanned columns ------------------------------------------------------------


#: Figure labels within prose; ends of sentences that a capital follows; sizes of halves of a word.
FIGURE_INSIDE = r"(?iu)[a-záéíóúñü]{0,8}(?:FIGURA|CUADRO|TABLA|FIGURE)\s+\d+[^\n.]*"
SENTENCE_CUT = r"(?<=[.!?])\s+(?=[A-ZÁÉÍÓÚ])"
HALF_LEAST, HALF_MOST, LONG_FIRST, LONG_SECOND = 2, 7, 6, 5
_NOT_LETTER = re.compile(r"[^a-záéíóúñüA-ZÁÉÍÓÚÑÜ]")


def mend_breaks(text: str, stop: frozenset, standalone: frozenset) -> str:
    """Joins neighbours that look like halves of one word, from the left, each word once."""
    ws = text.split()
    bare = [_NOT_LETTER.sub("", w) for w in ws]
    half = [HALF_LEAST <= len(b) <= HALF_MOST and b[0].islower() and b.lower() not in stop and b.lower() not in standalone for b in bare]
    out, i = [], 0
    while i < len(ws):
        if i + 1 < len(ws) and half[i] and half[i + 1] and not (len(bare[i]) >= LONG_FIRST and len(bare[i + 1]) >= LONG_SECOND):
            out.append(ws[i] + ws[i + 1])
            i += 2
        else:
            out.append(ws[i])
            i += 1
    return " ".join(out)


def mended(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, text) with column breaks mended."""
    from lectern import lexicons as lex

    stop, alone = frozenset(lex.COLUMN_STOPWORDS), frozenset(lex.COLUMN_STANDALONE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield p.assign(text=[None if t is None else mend_breaks(t, stop, alone) for t in p["text"]])

    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInPandas(run, "id long, text string").withColumnRenamed("id", id_col)


def flat_cleaned(df: DataFrame, id_col: str, text_col: str = "text", least_words: int = 15, tool: bool = False) -> DataFrame:
    """(id, text): the text on one line without figure labels, columns mended, bad sentences dropped; '' if fewer than ``least_words`` are left."""
    from lectern.functions.text import squeezed, words
    from lectern.operators.quality import bad_sentence

    flat = df.select(id_col, F.regexp_replace(squeezed(F.coalesce(text_col, F.lit(""))), FIGURE_INSIDE, "").alias("text"))
    good = F.array_join(F.transform(F.filter(F.split("text", SENTENCE_CUT), lambda s: ~bad_sentence(F.trim(s), tool)), F.trim), " ")
    kept = mended(flat, id_col).select(id_col, good.alias("text"))
    return kept.select(id_col, F.when(F.size(words("text")) < least_words, "").otherwise(F.col("text")).alias("text"))


def clean_passages(df: DataFrame, id_col: str, text_col: str = "text", most_words: int = 120, least_words: int = 15) -> DataFrame:
    """(id, text): bad sentences dropped, the rest cut to ``most_words`` at a sentence end past the middle; '' if fewer than ``least_words`` are left."""
    from lectern.functions.text import squeezed, words
    from lectern.operators.quality import bad_sentence

    flat = df.select(id_col, F.regexp_replace(squeezed(F.coalesce(text_col, F.lit(""))), FIGURE_INSIDE, "").alias("text"))
    m = mended(flat, id_col)
    good = F.array_join(F.filter(F.split("text", SENTENCE_CUT), lambda s: ~bad_sentence(F.trim(s))), " ")
    kept = m.select(id_col, good.alias("good")).withColumn("ws", words("good"))
    cut = F.array_join(F.slice("ws", 1, most_words), " ")
    at = lambda mark: F.locate(mark, F.reverse(F.col("cut")))
    found = F.greatest(*[F.when(at(m) > 0, F.length("cut") - at(m)).otherwise(0) for m in (" .", " ?")])
    shown = kept.withColumn("cut", cut)
    return shown.select(id_col, F.when(F.size("ws") < least_words, "").when(F.size("ws") <= most_words, F.trim("good")).when(found > F.length("cut") / 2, F.substring(F.col("cut"), F.lit(1), found)).otherwise(F.concat("cut", F.lit("…"))).alias("text"))
