"""Problem 10: splitting oversized texts at natural boundaries.

Method: byte-range processing.  A text whose size in bytes does not exceed the limit
cannot exceed it in tokens and is left alone.  The others are read in ranges that
overlap (``tokens.stitched``); each worker detects the possible cuts of its ranges with
their levels (4 paragraph, 3 line, 2 sentence, 1 word, 0 other) and, for each, where the
next piece has to start to share the stated overlap.  The boundary tables are
stitched by prefix sums of the token counts; pieces are chosen on the tables alone
and emitted by offset from the ranges they touch, so no step loads a whole giant text.

Each piece but the last ends at the highest level, the latest of it, within the second
half of its room; the next piece starts at the last pre-token boundary that leaves at
least ``overlap`` tokens in common.  Token counts add up at pre-token boundaries and, within
a pre-token of more than an eighth of the limit, at the ends of its tokens, so sizes are
exact and every piece is within the limit.

The tokens of other tokenizers than the byte-level ones don't add up: their texts are counted and cut
whole; ``n_tokens`` of a text is exact, that of a piece the sum over its words, each encoded alone.

Null and empty texts, and texts within the limit, give no row.  Ids are expected to be
unique; rows of the same id and text come out once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.tokens import BYTE_LEVEL, CHUNK, TOKENIZERS, _pattern, encoder, file_chunks, stitched, stitched_chunks, token_bytes
from lectern.session import materialize

_SENTENCE = re.compile(r"""[.!?…][)\]"'»”’]*$""")
_COLUMNS = ["key", "at", "size", "n", "off", "tok", "level", "back", "back_tok", "rest", "rest_tok"]
_TABLE = "key long, at long, size long, n long, off array<int>, tok array<int>, level array<int>, back array<int>, back_tok array<int>, rest array<int>, rest_tok array<int>"


def _token_ends(word: str, sizes: list[int]) -> list[tuple[int, int]]:
    """(characters, tokens) up to each token of a long pre-token that ends with a character, but for its last two characters."""
    starts = np.flatnonzero((np.frombuffer(word.encode("utf-8"), np.uint8) & 0xC0) != 0x80)
    at = np.cumsum(sizes)
    place = np.searchsorted(starts, at)
    return [(k, n) for n, (k, byte) in enumerate(zip(place.tolist(), at.tolist()), 1) if k < len(starts) - 1 and starts[k] == byte]


def boundary_table(text: str, count, first: bool, limit: int, overlap: int, sizes=None):
    """(tokens, offsets, prefix tokens, levels, offsets to restart at, prefix tokens there, last offsets, prefix tokens there).

    ``sizes`` gives the bytes of each token of a pre-token.  Where a restart lies in the range before, its offset is -1 and its
    prefix tokens, below 0, say how far before; the last offsets are the boundaries in the last ``overlap`` tokens, where the
    range after finds its restarts."""
    ends, toks, levels, words = [0], [0], [0], [m.group() for m in _pattern().finditer(text)]
    blanks = []  # (boundary, tokens that two blank pre-tokens take less or more as one)
    for i, w in enumerate(words):
        n, end, have = count(w), ends[-1], toks[-1]
        if n > limit // 8 and sizes:
            for k, m in _token_ends(w, sizes(w)):
                ends.append(end + k), toks.append(have + m), levels.append(0)
        ends.append(end + len(w)), toks.append(have + n)
        after = words[i + 1] if i + 1 < len(words) else ""
        if w.isspace() and i and words[i - 1].isspace():
            blanks.append((len(ends) - 1, count(words[i - 1] + w) - count(words[i - 1]) - n))
        if w.isspace() and "\n" in (run := words[i - 1] * (i > 0 and words[i - 1].isspace()) + w):
            levels.append(0 if after[:1].isspace() else 4 if run.count("\n") > 1 else 3)
        elif after[:1].isspace():
            levels.append(2 if _SENTENCE.search(w) and "\n" not in after else 1)
        else:
            levels.append(0)
    e, t, lv = np.array(ends), np.array(toks), np.array(levels)
    shown = t.copy()  # blanks at the end of a piece are one pre-token, within the text they may be two
    for k, more in blanks:
        shown[k] += more
    keep, last1, last0 = [], 0, 0
    for i in range(1, len(e)):
        if lv[i] >= 2 or lv[i] == 1 and t[i] - last1 >= 32 or t[i] - last0 >= 64:
            keep.append(i)
            last1 = last0 = t[i]
    k = np.array(keep, dtype=int)
    back = np.searchsorted(t, t[k] - overlap, side="right") - 1
    before = (back < 0) & (not first)
    back = np.maximum(back, 0)
    rest = np.flatnonzero(t >= t[-1] - overlap)
    rest = np.concatenate([rest[:1] - 1, rest]) if rest[0] else rest
    return int(t[-1]), e[k], shown[k], lv[k], np.where(before, -1, e[back]), np.where(before, t[k] - overlap, t[back]), e[rest], t[rest]


def _tables(name: str, folder: str, limit: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, memo = encoder(name, folder), {}
        by_id = token_bytes(name, folder) if name in BYTE_LEVEL else None

        def count(w: str) -> int:
            if (n := memo.get(w)) is None:
                n = len(encode(w))
                if len(w) < 40 and len(memo) < 500_000:
                    memo[w] = n
            return n

        sizes = (lambda w: [len(by_id[i]) for i in encode(w)]) if by_id else None
        for b in batches:
            cols = [[] for _ in range(10)]
            for at, text in zip(b.column("at").to_pylist(), b.column("text").to_pylist()):
                n, *rest = boundary_table(text, count, at == 0, limit, overlap, sizes)
                for c, v in zip(cols, (at, len(text), n if by_id else len(encode(text)), *rest)):
                    c.append(v)
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int32())] * 7
            yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array(c, k) for c, k in zip(cols, kinds))], _COLUMNS)

    return run


def choose(parts: pd.DataFrame, limit: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of each piece, from the boundary tables of one text in order."""
    base = np.concatenate([[0], np.cumsum(parts["n"].to_numpy()[:-1])])
    cat = lambda c, add: np.concatenate([np.asarray(x, dtype=np.int64) + y for x, y in zip(parts[c], add)])
    zero = np.zeros(len(parts), dtype=np.int64)
    at = parts["at"].to_numpy()
    off, tok, level, back, back_tok = cat("off", at), cat("tok", base), cat("level", zero), cat("back", at), cat("back_tok", base)
    rest, rest_tok = cat("rest", at), cat("rest_tok", base)
    before = np.flatnonzero(cat("back", zero) < 0)
    found = np.maximum(np.searchsorted(rest_tok, back_tok[before], side="right") - 1, 0)
    back[before], back_tok[before] = rest[found], rest_tok[found]
    total, end = int(parts["n"].sum()), int(at[-1] + parts["size"].iloc[-1])
    out, start, have = [], 0, 0
    # The prefix sums of tokenizers whose tokens don't add up may end elsewhere than the count of the text.
    whole = max(total, int(tok[-1])) if len(tok) else total
    while whole - have > limit:
        lo, hi = np.searchsorted(tok, have + limit // 2, side="right"), np.searchsorted(tok, have + limit, side="right")
        if lo >= hi:
            lo = np.searchsorted(back_tok, have, side="right")
        room = level[lo:hi]
        i = lo + len(room) - 1 - int(np.argmax(room[::-1]))
        out.append((start, int(off[i]), int(tok[i] - have)))
        start, have = int(back[i]), int(back_tok[i])
    return [*out, (start, end, whole - have)]


def _chosen(limit: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = choose(pdf.sort_values("at"), limit)
        return pd.DataFrame({"key": pdf["key"].iloc[0], "piece": range(len(rows)), "start": [r[0] for r in rows], "end": [r[1] for r in rows], "n_tokens": [r[2] for r in rows]})

    return run


def ranges_of(df: DataFrame, limit: int, overlap: int, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """Ranges (key, at, text) of the texts that may be too long, and their boundary tables."""
    # A token of a byte-level vocabulary has a byte at least; other tokenizers may add one for the start.
    texts = df.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text")).where(F.octet_length("text") > limit - (name not in BYTE_LEVEL))
    long = F.length("text") > CHUNK if name in BYTE_LEVEL else F.lit(False)
    ranges = texts.where(~long).select("key", F.lit(0).cast("long").alias("at"), "text").union(stitched(texts.where(long).dropDuplicates(["key"]), name, folder))
    return ranges, tabled(ranges, limit, overlap, name, folder)


def tabled(ranges: DataFrame, limit: int, overlap: int, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The boundary tables of ranges (key, at, text)."""
    return materialize(ranges.mapInArrow(_tables(name, folder, limit, overlap), _TABLE), "boundaries")


def file_ranges(spark, paths: list[str], limit: int, overlap: int, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    """Ranges and boundary tables of giant files, read in ranges of bytes; the keys are the files' places in ``paths``."""
    ranges = stitched_chunks(file_chunks(spark, paths), name, folder)
    return ranges, tabled(ranges, limit, overlap, name, folder)


def oversized(tables: DataFrame, limit: int) -> DataFrame:
    return tables.dropDuplicates(["key", "at"]).groupBy("key").agg(F.sum("n").alias("n_tokens")).where(F.col("n_tokens") > limit)


def spans(tables: DataFrame, limit: int) -> DataFrame:
    """(key, piece, start, end, n_tokens) of the texts over the limit; offsets in characters."""
    kept = tables.dropDuplicates(["key", "at"]).join(oversized(tables, limit).select("key"), "key", "left_semi")
    return kept.groupBy("key").applyInPandas(_chosen(limit), "key long, piece int, start long, end long, n_tokens long")


def emitted(ranges: DataFrame, pieces: DataFrame) -> DataFrame:
    """The pieces with their text, cut from the ranges they touch."""
    slots = lambda a, b: F.explode(F.sequence(F.floor(a / CHUNK), F.floor((b - 1) / CHUNK)))
    p = pieces.where("end > start").withColumn("no", slots(F.col("start"), F.col("end")))
    r = ranges.dropDuplicates(["key", "at"]).withColumn("size", F.length("text")).where("size > 0").withColumn("no", slots(F.col("at"), F.col("at") + F.col("size")))
    both = p.join(r, ["key", "no"]).where("at < end and at + size > start").dropDuplicates(["key", "piece", "at"])
    cut = both.select("key", "piece", "start", "end", "n_tokens", "at", F.expr("substring(text, int(greatest(start - at, 0) + 1), int(least(end, at + size) - greatest(start, at)))").alias("text"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"]), "")
    return cut.groupBy("key", "piece", "start", "end", "n_tokens").agg(joined.alias("text"))


def limits_of(split_limits: DataFrame) -> tuple[str, int, int]:
    """The one row of limits; without a row, 2048 tokens with an overlap of 64."""
    row = split_limits.where("tokenizer is not null and max_tokens is not null").orderBy("tokenizer").limit(1).collect()
    return (row[0]["tokenizer"], row[0]["max_tokens"], row[0]["overlap_tokens"] or 0) if row else ("byte_bpe_50k", 2048, 64)
