"""Problem 8: encoding of the whole corpus with a public tokenizer.

Method: overlapping chunk encoding.  A text of more than ``CHUNK`` characters is cut
into chunks that overlap by ``HALO`` characters; all chunks are pre-tokenised in
parallel, each from its own start.  The pattern of the pre-tokeniser looks ahead but
never back, so from a boundary that two neighbours share on, both see the same
pre-tokens: the first shared boundary of the overlap is where the text is cut, and
the pieces between cuts are encoded on their own.  Where one pre-token covers the overlap,
the cut is a token boundary that both chunks see with the same next token (token
sequences are valid pair by pair, so this too gives the ids of the whole).  Only chunks
without either are joined before encoding.  Ids decode by concatenating the bytes of
their tokens, whatever the cuts.

Null and empty texts have an empty list of ids and 0 tokens.  Repeated rows are
encoded once each; other columns are ignored.  Other tokenizers of the folder
(``word_bpe_49k``, ``piece_bpe_32k``) are applied to whole texts.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import materialize

TOKENIZERS = "/opt/tokenizers"
CHUNK, HALO = 32_768, 1_024
#: Fixed value: the pre-tokeniser pattern of the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BYTE_LEVEL = ("byte_bpe_50k", "byte_bpe_multi_50k")


@lru_cache(maxsize=4)
def _ranks(name: str, folder: str) -> dict[bytes, int]:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(maxsize=4)
def encoder(name: str = "byte_bpe_50k", folder: str = TOKENIZERS):
    """A function from a text to its list of ids, without special tokens."""
    if name in BYTE_LEVEL:
        import tiktoken

        return tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=_ranks(name, folder), special_tokens={}).encode_ordinary
    if name == "piece_bpe_32k":
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=os.path.join(folder, f"{name}.model"))
        return lambda text: model.encode(text, num_threads=1)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(folder, f"{name}.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def decode(ids: list[int], name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    """The text of byte-level ids: their bytes, concatenated."""
    by_id = token_bytes(name, folder)
    return b"".join(by_id[i] for i in ids).decode("utf-8")


@lru_cache(maxsize=4)
def token_bytes(name: str, folder: str) -> dict[int, bytes]:
    return {v: k for k, v in _ranks(name, folder).items()}


@lru_cache(maxsize=1)
def _pattern():
    import regex

    return regex.compile(PATTERN)


def boundaries(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the pre-tokens, and which of them a text may be cut at: not after two pre-tokens of blanks, which would be one at the end of a text."""
    ends, blank = [], []
    for m in _pattern().finditer(text):
        ends.append(m.end()), blank.append(m.group().isspace())
    b = np.array(blank, bool)
    return np.array(ends, np.int64), ~(b & np.concatenate([[False], b[:-1]]))


_CHUNK = "key long, no long, start long, size long, text string"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of each text, each of ``size`` characters of its own and up to HALO of the next: every character is copied about once."""
    for b in batches:
        for k, text in zip(b.column("key").to_pylist(), b.column("text").to_pylist()):
            starts = range(0, max(1, len(text)), CHUNK)
            for at in range(0, len(starts), 100):
                some = starts[at : at + 100]
                cols = [[k] * len(some), [s // CHUNK for s in some], some, [min(CHUNK, len(text) - s) for s in some]]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array([text[s : s + CHUNK + HALO] for s in some], pa.string())], ["key", "no", "start", "size", "text"])


def chunks(texts: DataFrame) -> DataFrame:
    """(key, text) to (key, no, start, size, text)."""
    return texts.select("key", "text").mapInArrow(_slices, _CHUNK)


def file_chunks(spark, paths: list[str]) -> DataFrame:
    """The same of UTF-8 files, the keys their places in ``paths``: each chunk is read as a range of bytes, and no task reads a whole file.

    Ranges begin and end within characters where they may; each begins with the first character that begins in it.  Bytes
    that are no UTF-8 come out as U+FFFD."""
    from pyarrow import fs
    from pyspark.sql import Window

    def opened(path: str):
        system, inner = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        return system.open_input_file(inner)

    sizes = []
    for i, path in enumerate(paths):
        with opened(path) as f:
            sizes.append((i, path, f.size()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, path, no in zip(*(b.column(c).to_pylist() for c in ("key", "path", "no"))):
                with opened(path) as f:
                    raw = f.read_at(CHUNK + 4 * HALO + 4, no * CHUNK)
                skip = 0
                while no and skip < 3 and skip < len(raw) and raw[skip] & 0xC0 == 0x80:
                    skip += 1
                own = CHUNK
                while own < min(len(raw), CHUNK + 3) and raw[own] & 0xC0 == 0x80:
                    own += 1
                text = raw[skip:own].decode("utf-8", "replace")
                halo = raw[own:].decode("utf-8", "replace")[:HALO]
                yield pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in (k, no, len(text))), pa.array([text + halo], pa.string())], ["key", "no", "size", "text"])

    rows = spark.createDataFrame(sizes, "key long, path string, n long").select("key", "path", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / CHUNK)))).alias("no"))
    ranges = materialize(rows.repartition("key", "no").mapInArrow(read, "key long, no long, size long, text string"), "ranges")
    w = Window.partitionBy("key").orderBy("no").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select("key", "no", F.coalesce(F.sum("size").over(w), F.lit(0)).alias("start"))
    return ranges.join(starts, ["key", "no"]).select("key", "no", "start", "size", "text")


def _cuts_within(text: str, start: int, lo: int, hi: int, name: str, folder: str) -> list[int]:
    """Where the tokens of a text end between two places, as place * 2**20 + the id of the next token."""
    ids = np.array(encoder(name, folder)(text), dtype=np.int64)
    size = np.array([len(token_bytes(name, folder)[i]) for i in ids.tolist()])
    raw = np.frombuffer(text.encode("utf-8"), np.uint8)
    char = np.cumsum((raw & 0xC0) != 0x80)  # of the byte before a place, how many characters begin up to it
    ends = np.cumsum(size)[:-1]
    whole = (raw[ends] & 0xC0) != 0x80
    at = char[ends[whole] - 1]
    keep = (at > lo) & (at < hi)
    return ((start + at[keep]) * 2**20 + ids[1:][whole][keep]).tolist()


def _edges(name: str, folder: str):
    """Boundaries in the first and the last HALO characters of each chunk, as offsets in the text; where a
    pre-token covers these, the ends of its tokens in them (``inner``, as of ``_cuts_within``)."""
    names = ["key", "no", "start", "size", "head", "tail", "head_inner", "tail_inner"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [[], [], [], []]
            for start, size, text in zip(*(b.column(c).to_pylist() for c in ("start", "size", "text"))):
                e, fit = boundaries(text)
                more = len(text) > size
                # The last boundary of a cut text may be no boundary of the whole one.
                true = e[:-1] if more else e
                first = int(e[0]) if len(e) else 0
                inner_head = _cuts_within(text[:first], start, 4, HALO - 4, name, folder) if first >= HALO else []
                last = int(true[-1]) if len(true) else 0
                inner_tail = _cuts_within(text[last:], start + last, size + 4 - last, len(text) - 4 - last, name, folder) if more and last < size else []
                true = np.concatenate([[0], true[fit[: len(true)]]])
                for c, v in zip(cols, (true[true < HALO] + start, true[true >= size] + start if more else [], inner_head, inner_tail)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:4]), *(pa.array(c, pa.list_(pa.int64())) for c in cols)], names)

    return run


def stitched(long_texts: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, text) to (key, at, text): pieces of each text, ``at`` their offset, that may be encoded on their own."""
    return stitched_chunks(chunks(long_texts), name, folder)


def stitched_chunks(chunk: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The same from chunks."""
    from pyspark.sql import Window

    chunk = materialize(chunk.repartition("key", "no"), "chunks")
    lists = ", ".join(f"{c} array<long>" for c in ("head", "tail", "head_inner", "tail_inner"))
    edges = materialize(chunk.mapInArrow(_edges(name, folder), f"key long, no long, start long, size long, {lists}"), "edges")
    before = edges.select("key", (F.col("no") + 1).alias("no"), "tail", "tail_inner")
    # Where no pre-token boundary is shared, a token boundary that both see with the same next token: what stands before and after it are parts of
    # two encodings, and the tokens beside it follow each other in one of them, so the whole is what encoding all at once gives.
    inner = F.shiftright(F.array_min(F.array_intersect("head_inner", "tail_inner")), 20)
    cut = F.when(F.col("no") == 0, F.lit(0).cast("long")).otherwise(F.coalesce(F.array_min(F.array_intersect("head", "tail")), inner))
    w = Window.partitionBy("key").orderBy("no")
    joint = edges.drop("tail", "tail_inner").join(before, ["key", "no"], "left").select("key", "no", "start", "size", cut.alias("cut"))
    # A chunk without a cut of its own belongs to the last one before it that has one.
    joint = joint.select("key", "no", "cut", F.last("cut", ignorenulls=True).over(w).alias("own"), F.lead("no").over(w).isNull().alias("last"), F.lead("cut").over(w).alias("next"))
    parts = chunk.join(materialize(joint, "joint"), ["key", "no"])
    begin, end = F.greatest("own", "start"), F.when(F.col("last"), F.col("start") + F.col("size")).otherwise(F.coalesce("next", F.col("start") + F.col("size")))
    parts = parts.withColumn("begin", begin).withColumn("end", end).select("key", "own", "no", (F.col("cut").isNotNull() & (F.col("last") | F.col("next").isNotNull())).alias("whole"), F.expr("substring(text, int(begin - start + 1), int(end - begin))").alias("text"))
    joined = parts.where("not whole").groupBy("key", "own").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "text"))), lambda x: x["text"]), "").alias("text"))
    return parts.where("whole").select("key", "own", "text").union(joined).select("key", F.col("own").alias("at"), "text")


def _id_batches(name: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name, folder)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                ids = [encode(t) if t else [] for t in b.column("text").to_pylist()]
                ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                flat = np.fromiter((i for x in ids for i in x), np.int32, int(ends[-1]))
                yield pa.RecordBatch.from_arrays([b.column("key"), b.column("at"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], ["key", "at", "ids"])

    return run


def _count_batches(name: str, folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(name, folder)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("key"), pa.array([len(encode(t)) if t else 0 for t in b.column("text").to_pylist()], pa.int64())], ["key", "n"])

    return run


def _split(df: DataFrame, id_col: str, text_col: str, name: str) -> tuple[DataFrame, DataFrame | None]:
    """Texts encoded as they stand, and the pieces of those that are stitched."""
    texts = df.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).alias("text"))
    if name not in BYTE_LEVEL:
        return texts.withColumn("at", F.lit(0).cast("long")).select("key", "at", "text"), None
    long = F.coalesce(F.length("text") > CHUNK, F.lit(False))
    return texts.where(~long).select("key", F.lit(0).cast("long").alias("at"), "text"), texts.where(long)


def encoded(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, ids) of each row."""
    short, long = _split(df, id_col, text_col, name)
    kind = "key long, at long, ids array<int>"
    out = short.mapInArrow(_id_batches(name, folder), kind).select("key", "ids")
    if long is not None:
        numbered = long.select(F.monotonically_increasing_id().alias("row"), "key", "text")
        numbered = materialize(numbered, "long") if not long.isEmpty() else None
        if numbered is not None:
            parts = stitched(numbered.select(F.col("row").alias("key"), "text"), name, folder).mapInArrow(_id_batches(name, folder), kind)
            joined = parts.groupBy("key").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda x: x["ids"])).alias("ids"))
            out = out.union(joined.withColumnRenamed("key", "row").join(numbered.select("row", "key"), "row").select("key", "ids"))
    return out.select(F.col("key").alias(id_col), "ids")


def counted(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(id, n_tokens), one row per id; rows of the same id add up."""
    short, long = _split(df, id_col, text_col, name)
    out = short.mapInArrow(_count_batches(name, folder), "key long, n long")
    if long is not None and not long.isEmpty():
        numbered = materialize(long.select(F.monotonically_increasing_id().alias("row"), "key", "text"), "long")
        parts = stitched(numbered.select(F.col("row").alias("key"), "text"), name, folder).mapInArrow(_count_batches(name, folder), "key long, n long")
        out = out.union(parts.withColumnRenamed("key", "row").join(numbered.select("row", "key"), "row").select("key", "n"))
    return out.groupBy(F.col("key").alias(id_col)).agg(F.sum("n").alias("n_tokens"))
