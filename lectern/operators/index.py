"""The inverted index as tables.

Passages are (pid, domain, source, title, text, page).  Passages of null or empty text count in
the number of passages and the mean length with length 0.  Repeated pids are one passage (the
least text).  The posting cap is a parameter; without one every posting is kept.

What is stored is the list of terms of each passage, made in one pass without a shuffle; only document frequencies
(one row per term and task) are shuffled.  ``postings`` is a view: the lists joined with the weights of terms by value, so a hot term
is split by adaptive skew handling like any hot key.  Postings under a cap are stored as such."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern import lexicons as lex
from lectern.functions.text import content_terms, tokens
from lectern.session import discard, freeing, materialize


#: Changes with what a build does, so that older snapshots are not read.
VERSION = 2
_COLUMNS = ("pid", "domain", "source", "title", "text", "page")


def capped_passages(passages: DataFrame, most: int) -> DataFrame:
    """The first ``most`` passages by source and id: a sort that keeps only as many rows per task."""
    return passages.orderBy(F.col("source").asc_nulls_last(), "pid").limit(most)


def term_frequencies(passages: DataFrame, id_col: str = "pid", text_col: str = "text", stopwords: list[str] | None = None) -> DataFrame:
    """(id, term, tf)."""
    terms = passages.where(F.col(id_col).isNotNull()).select(id_col, F.explode(content_terms(tokens(text_col), stopwords)).alias("term"))
    return terms.groupBy(id_col, "term").agg(F.count("*").alias("tf"))


def lengths(passages: DataFrame, tf: DataFrame, id_col: str = "pid") -> DataFrame:
    """(id, dl): terms of each passage, 0 where it has none."""
    dl = tf.groupBy(id_col).agg(F.sum("tf").alias("dl"))
    return passages.select(id_col).where(F.col(id_col).isNotNull()).distinct().join(dl, id_col, "left").select(id_col, F.coalesce("dl", F.lit(0)).alias("dl"))


def document_frequencies(tf: DataFrame) -> DataFrame:
    return tf.groupBy("term").agg(F.count("*").alias("df"))


def idf(n: Column, df: Column) -> Column:
    return F.log((n - df + 0.5) / (df + 0.5) + 1)


def bm25(idf_: Column, tf: Column, dl: Column, avgdl: Column, k1: float = lex.BM25_K1, b: float = lex.BM25_B) -> Column:
    return F.round(idf_ * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)), 6)


def capped_postings(postings: DataFrame, most: int) -> DataFrame:
    """The ``most`` postings of greatest weight of each term, ties by pid."""
    w = Window.partitionBy("term").orderBy(F.desc("w"), "pid")
    return postings.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("rank")


@dataclass
class Index:
    """Tables of one build: passages, lists (pid, domain, dl, terms, tfs), idf (term, df, idf), n and avgdl; under a cap the postings that are left."""

    passages: DataFrame
    lists: DataFrame
    idf: DataFrame
    n: int
    avgdl: float
    capped: DataFrame | None = None

    @property
    def postings(self) -> DataFrame:
        """(term, pid, tf, dl, w)."""
        return self.postings_of(self.idf).select("term", "pid", "tf", "dl", "w")

    def postings_of(self, weights: DataFrame, lists: DataFrame | None = None) -> DataFrame:
        """(term, pid, tf, dl, w, domain) of the terms of ``weights`` (term, idf), of some of the lists if given."""
        lists = self.lists if lists is None else lists
        if self.capped is not None:
            return self.capped.join(weights.select("term"), "term", "left_semi").join(lists.select("pid", "domain"), "pid").select("term", "pid", "tf", "dl", "w", "domain")
        rows = lists.select("pid", "domain", "dl", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("pid", "domain", "dl", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))
        return rows.join(weights.select("term", "idf"), "term").select("term", "pid", "tf", "dl", bm25(F.col("idf"), F.col("tf"), F.col("dl"), F.lit(float(self.avgdl))).alias("w"), "domain")

    def domains(self) -> DataFrame:
        return self.passages.groupBy("domain").agg(F.count("*").alias("n_passages"))


def _one_per_pid(rows: DataFrame) -> DataFrame:
    return rows.groupBy("pid").agg(F.min_by(F.struct(*_COLUMNS[1:]), F.coalesce("text", F.lit(""))).alias("r")).select("pid", "r.*")


def _distinct(passages: DataFrame, store: Callable) -> DataFrame:
    """Stored passages of distinct pids; texts are shuffled only where a pid comes twice."""
    passages = passages.select(*_COLUMNS)
    if passages.groupBy("pid").count().where("count > 1").isEmpty():
        return store(passages, "passages")
    return store(_one_per_pid(passages), "passages")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pid, domain, terms) with the terms of each passage once and how often it has them."""
    for whole in batches:
        for at in range(0, whole.num_rows, 10_000):
            b = whole.slice(at, 10_000)
            n, lists = b.num_rows, b.column(2)
            dl = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            names = lists.flatten().dictionary_encode()
            key, tf = np.unique(np.repeat(np.arange(n), dl) * max(1, len(names.dictionary)) + names.indices.to_numpy(zero_copy_only=False), return_counts=True)
            row, code = np.divmod(key, max(1, len(names.dictionary)))
            ends = pa.array(np.searchsorted(row, np.arange(n + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(dl), pa.ListArray.from_arrays(ends, names.dictionary.take(pa.array(code))), pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int64)))], ["pid", "domain", "dl", "terms", "tfs"])


def term_lists(passages: DataFrame, stopwords: list[str] | None = None) -> DataFrame:
    """(pid, domain, dl, terms, tfs): the terms of each passage and how often it has them, in one pass without a shuffle."""
    rows = passages.where("pid is not null").select("pid", "domain", content_terms(tokens("text"), stopwords).alias("terms"))
    return rows.mapInArrow(_counted, f"pid {rows.schema['pid'].dataType.simpleString()}, domain string, dl long, terms array<string>, tfs array<long>")


def _weighted(rows: DataFrame, lists: DataFrame, store: Callable, most: int | None = None) -> Index:
    """The index of passages and their lists: everything that depends on the whole collection."""
    size = lists.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    n, avgdl = max(1, size["n"]), size["avgdl"] or 1.0
    df = document_frequencies(lists.select(F.explode("terms").alias("term")))
    terms = store(df.select("term", "df", idf(F.lit(float(n)), F.col("df")).alias("idf")), "idf")
    out = Index(rows, lists, terms, n, avgdl)
    if most is not None:
        out.capped = store(capped_postings(out.postings, most), "capped")
    return out


def _table(df: DataFrame, name: str) -> DataFrame:
    return materialize(df, name, free=True)


def build(passages: DataFrame, tier: str | None = None, stopwords: list[str] | None = None, store: Callable[[DataFrame, str], DataFrame] = _table) -> Index:
    """All tables, each written once, by ``store``.  ``tier`` sets the caps on passages and postings; None sets none."""
    caps = lex.TIERS[tier] if tier else (None, None)
    rows = _distinct(capped_passages(passages, caps[0]) if tier else passages, store)
    return _weighted(rows, store(term_lists(rows, stopwords), "lists"), store, caps[1])


def updated(index: Index, fresh: DataFrame, removed: DataFrame | None = None, stopwords: list[str] | None = None) -> Index:
    """The index after passages came, changed (a pid that is indexed already) or went (``removed``: pid): the same as a new build over
    what is left.  Only the texts of ``fresh`` are read; the others keep their lists, so the index must have no cap."""
    fresh = materialize(_one_per_pid(fresh.select(*_COLUMNS).where("pid is not null")), "fresh", free=True)
    gone = fresh.select("pid") if removed is None else fresh.select("pid").union(removed.select("pid")).distinct()
    rows = _table(index.passages.join(gone, "pid", "left_anti").select(*fresh.columns).union(fresh), "passages")
    lists = _table(index.lists.join(gone, "pid", "left_anti").select(*index.lists.columns).union(term_lists(fresh, stopwords)), "lists")
    discard(fresh)
    return _weighted(rows, lists, _table)


def files_signature(files: DataFrame) -> str:
    """One string for the files a table is stored in: their paths, sizes and times of change."""
    spark = files.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    marks = []
    for name in sorted(files.inputFiles()):
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        status = path.getFileSystem(conf).getFileStatus(path)
        marks.append(f"{name}:{status.getLen()}:{status.getModificationTime()}")
    return hashlib.sha256("\n".join(marks).encode()).hexdigest()


def cached(passages: DataFrame, path: str, tier: str | None = None, of: DataFrame | None = None) -> Index:
    """The index of a stored table: loaded from below ``path`` if one was built from the same files, else built and saved there.

    ``of`` is the table as it was read, where ``passages`` is made of it."""
    mark = files_signature(passages if of is None else of)
    place = f"{path}/{mark[:24]}-{tier or 'all'}"
    spark = passages.sparkSession
    if (found := load(spark, place, VERSION, tier, mark)) is None:
        _manifest(build(passages, tier, store=lambda df, name: _put(df, place, name)), place, VERSION, tier, mark)
        found = load(spark, place, VERSION, tier, mark)
    return found


def stats(index: Index) -> DataFrame:
    passages = index.passages.agg(F.count("*").alias("passages"), F.countDistinct("domain").alias("domains"))
    return passages.crossJoin(F.broadcast(index.idf.agg(F.count("*").alias("terms"))))


def _put(df: DataFrame, path: str, name: str) -> DataFrame:
    with freeing(df.sparkSession):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{path}/{name}")


def _manifest(index: Index, path: str, version: int, tier: str | None, signature: str) -> None:
    spark = index.passages.sparkSession
    spark.createDataFrame([(version, tier, signature, index.n, float(index.avgdl), index.capped is not None)], "version int, tier string, signature string, n long, avgdl double, capped boolean").write.mode("overwrite").parquet(f"{path}/manifest")


def save(index: Index, path: str, version: int, tier: str | None, signature: str) -> None:
    """A snapshot: the tables and a manifest row that says what they were built from."""
    for name in ("passages", "lists", "idf", *["capped"] * (index.capped is not None)):
        _put(getattr(index, name), path, name)
    _manifest(index, path, version, tier, signature)


def load(spark, path: str, version: int, tier: str | None, signature: str) -> Index | None:
    """The snapshot, if it was built by this version, for this tier, from files of this signature."""
    try:
        m = spark.read.parquet(f"{path}/manifest").first()
    except Exception as e:  # no snapshot yet
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise
    if m is None or (m["version"], m["tier"], m["signature"]) != (version, tier, signature):
        return None
    return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("passages", "lists", "idf")), m["n"], m["avgdl"], spark.read.parquet(f"{path}/capped") if m["capped"] else None)
