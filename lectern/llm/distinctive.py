"""Problem 5: how distinctive a term is per record.

Method: graph of words.  In each record, terms within ``WINDOW`` of each other are
joined by an edge; a term's weight is the number of its distinct neighbours in the record,
in place of its frequency, times its rarity over all records, ln(1 + n / df).

A term is a run of letters or digits, folded (case, accents) and without a plural s;
HTML entities are resolved first.  Title and text of a record are one sequence, with a
gap that no edge crosses.  Null and empty texts and titles have no terms; a record of one
term has a weight of 0 for it.  Repeated ids are merged as one record in every count of
records.  Copies under other ids are records of their own.

``rare`` counts before it shuffles: each batch sends one row per term that is frequent
in it and single rows only for the others, so a term found in every record costs as
little as a rare one.  Of the terms asked for only a filter of ``SLOTS`` bits is sent to the tasks, at any
number of them; what passes it by chance is dropped by a join.
"""

from __future__ import annotations

import html
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.words import WORD, fold
from lectern.session import materialize

WINDOW = 4
#: Slots (a multiple of 8) of the filter that terms looked up are hashed to.  It is all that is sent of them, whatever their number.
SLOTS = 1 << 20


def term(word: str) -> str:
    return word[:-1] if len(word) > 3 and word[-1] == "s" else word


def terms_of(text: str | None) -> list[str]:
    if not text:
        return []
    return [term(w) for w in WORD.findall(fold(html.unescape(text) if "&" in text else text))]


def _positions(titles, texts, index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers of all records one after the other, gaps of WINDOW between sequences as -1, and the record of each place."""
    ids, owner, gap = [], [], [-1] * WINDOW
    sizes = []
    add = index.setdefault
    for title, text in zip(titles, texts):
        before = len(ids)
        for part in (title, text):
            for t in terms_of(part):
                ids.append(add(t, len(index)))
            ids += gap
        sizes.append(len(ids) - before)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return np.array(ids, dtype=np.int64), owner


def degrees(ids: np.ndarray, owner: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(record, term, distinct neighbours) of the terms at the given places."""
    near = np.concatenate([np.stack([owner[at], ids[at], ids[np.clip(at + k, 0, len(ids) - 1)]]) for k in range(1 - WINDOW, WINDOW) if k], axis=1)
    near = near[:, (near[2] >= 0) & (near[2] != near[1])]
    pairs = np.unique(np.stack([owner[at], ids[at]]), axis=1)
    width = np.int64(max(ids.max(), 0) + 1)
    key = np.unique((near[0] * width + near[1]) * width + near[2]) // width
    k, n = np.unique(key, return_counts=True)
    out = np.zeros(pairs.shape[1], np.int64)
    own = pairs[0] * width + pairs[1]
    out[np.searchsorted(own, k)] = n
    return pairs[0], pairs[1], out


def _slot(words, slots: int) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w) % slots for w in words), np.int64)


def _slots(slots: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            yield pd.DataFrame({"slot": np.unique(_slot(p["term"], slots))})

    return run


def _rare_batches(wanted, most: int, slots: int):
    """``wanted``: a broadcast of the slots in use, a bit each.  The row without a term counts the records that have any."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        used = np.unpackbits(np.frombuffer(wanted.value, np.uint8)).astype(bool)
        for p in batches:
            if not len(p):
                continue
            index: dict[str, int] = {}
            ids, owner = _positions(p["title"], p["text"], index)
            names = np.array(list(index), dtype=object)
            once = np.unique(np.stack([np.where(ids >= 0, ids, -1), owner]), axis=1)
            once = once[:, once[0] >= 0]
            n = np.bincount(once[0], minlength=len(names))
            look = used[_slot(index, slots)]
            often = np.flatnonzero(look & (n > most))
            few = look & (n <= most)
            at = np.flatnonzero((ids >= 0) & few[ids]) if len(names) else np.empty(0, np.int64)
            pid = p["pid"].to_numpy()
            some = pd.DataFrame({"term": [None], "n": [len(np.unique(owner[ids >= 0]))], "pid": pd.array([None], "Int64"), "degree": 0})
            out = [some, pd.DataFrame({"term": names[often], "n": n[often], "pid": pd.array([None] * len(often), "Int64"), "degree": 0})]
            if len(at):
                rec, t, d = degrees(ids, owner, at)
                out.append(pd.DataFrame({"term": names[t], "n": 1, "pid": pd.array(pid[rec], "Int64"), "degree": d}))
            yield pd.concat(out, ignore_index=True)

    return run


def _records(df: DataFrame, id_col: str, title_col: str, text_col: str) -> DataFrame:
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("pid"), F.col(title_col).alias("title"), F.col(text_col).alias("text"))


def rare(df: DataFrame, queries: DataFrame, most: int = 6, id_col: str = "pid", title_col: str = "title", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """(term, pid, df, weight) of the terms of ``queries`` (a column ``term``) that stand in at most ``most`` records.

    Which terms come out depends on the rarity alone, one factor of the weight; the degree tells which of their records they say most about.

    Ids are expected to be unique here."""
    wanted = queries.select("term").where("term is not null").distinct()
    used = np.zeros(slots, bool)
    used[wanted.mapInPandas(_slots(slots), "slot int").distinct().toArrow().column(0).to_numpy()] = True  # at most ``slots`` numbers
    sent = df.sparkSession.sparkContext.broadcast(np.packbits(used).tobytes())
    records = _records(df, id_col, title_col, text_col)
    seen = materialize(records.mapInPandas(_rare_batches(sent, most, slots), "term string, n long, pid long, degree long"), "terms")
    n = seen.where("term is null").agg(F.sum("n").alias("n_records"))
    rows = seen.join(wanted, "term", "left_semi")
    few = rows.groupBy("term").agg(F.sum("n").alias("df")).where(F.col("df") <= most)
    return rows.where("pid is not null").join(few, "term").crossJoin(F.broadcast(n)).select("term", "pid", "df", (F.col("degree") * F.log1p(F.col("n_records") / F.col("df"))).alias("weight"))


def _degree_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        for at in range(0, len(p), 2000):
            b = p.iloc[at : at + 2000]
            index: dict[str, int] = {}
            ids, owner = _positions(b["title"], b["text"], index)
            places = np.flatnonzero(ids >= 0)
            if len(places):
                rec, t, d = degrees(ids, owner, places)
                yield pd.DataFrame({"pid": b["pid"].to_numpy()[rec], "term": np.array(list(index), dtype=object)[t], "degree": d})


def weights(df: DataFrame, id_col: str = "pid", title_col: str = "title", text_col: str = "text") -> DataFrame:
    """(pid, term, weight) of every term of every record."""
    records = _records(df, id_col, title_col, text_col)
    rows = materialize(records.mapInPandas(_degree_batches, "pid long, term string, degree long").groupBy("pid", "term").agg(F.max("degree").alias("degree")), "degrees")
    n = rows.select("pid").distinct().count()
    df_of = rows.groupBy("term").agg(F.count("*").alias("df"))
    return rows.join(df_of, "term").select("pid", "term", (F.col("degree") * F.log1p(n / F.col("df"))).alias("weight"))


def _term_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        rows = [(i, t) for i, x in zip(p["id"], p["text"]) for t in dict.fromkeys(terms_of(x))]
        yield pd.DataFrame(rows, columns=["item_id", "term"])


def query_terms(df: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(item_id, term), each term of an item once."""
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    return texts.mapInPandas(_term_batches, "item_id long, term string").distinct()
