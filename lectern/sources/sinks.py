"""Writing passages and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import col


def markdown(chunks: DataFrame, doc: str = "doc_id") -> DataFrame:
    """(doc, content): the pieces of each document as one Markdown text with its metadata.  chunks: doc, filename, domain, chunk, page, text."""
    n = F.count("*").over(Window.partitionBy(doc))
    page = F.coalesce(F.concat(F.lit(" | pag:"), F.col("page").cast("string")), F.lit(""))
    head = F.format_string("<!-- fuente:%s | categoria:%s | frag:%d/%d%s -->\n", F.coalesce("filename", F.lit("")), F.coalesce("domain", F.lit("general")), F.col("chunk") + 1, F.col("n"), page)
    rows = chunks.withColumn("n", n).select(doc, "chunk", F.concat(F.format_string("## Fragmento %d\n\n", F.col("chunk") + 1), head, "text").alias("part"))
    return rows.groupBy(doc).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "part"))), lambda x: x["part"]), "\n\n").alias("content"))


def formatted(c: Column | str) -> Column:
    """Text with headings: kept if it has some; else short first lines of blocks become headings, blocks without one are numbered."""
    t = F.trim(col(c))
    blocks = F.filter(F.split(t, r"\n\s*\n"), lambda b: F.trim(b) != "")

    def block(b: Column, i: Column) -> Column:
        first = F.trim(F.split(F.trim(b), "\n")[0])
        titled = (F.length(first) < 80) & ~first.endswith(".") & F.contains(F.trim(b), F.lit("\n"))
        rest = F.trim(F.regexp_replace(F.trim(b), r"\A[^\n]*\n", ""))
        return F.when(titled & (F.size(blocks) > 1), F.concat(F.lit("## "), first, F.lit("\n\n"), rest)).otherwise(F.concat(F.lit("## Sección "), (i + 1).cast("string"), F.lit("\n\n"), F.trim(b)))

    return F.when(t.contains("##") | t.contains("# "), t).otherwise(F.array_join(F.transform(blocks, block), "\n\n"))


def next_index(files: DataFrame, path_col: str = "source") -> DataFrame:
    """(folder, next_index): 1 more than the greatest leading number of a file name in its folder."""
    name = F.element_at(F.split(path_col, "/"), -1)
    number = F.regexp_extract(name, r"^(\d+)-", 1).try_cast("int")
    return files.where(F.col(path_col).isNotNull()).groupBy(F.substring_index(path_col, "/", 1).alias("folder")).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_index"))


def import_report(imported: DataFrame) -> DataFrame:
    return imported.groupBy("status").agg(F.count("*").alias("n"), F.sum("text_length").alias("chars"))


def registered(rows: DataFrame) -> DataFrame:
    """The registry: one row per hash, the one registered first."""
    rest = [c for c in rows.columns if c != "file_hash"]
    pick = F.min_by(F.struct(*rest), F.struct("registered_at", "doc_id"))
    return rows.where("file_hash is not null").groupBy("file_hash").agg(pick.alias("r")).select("file_hash", "r.*")


def appended(rows: DataFrame, path: str, by: str | None = None) -> None:
    """Adds rows to a log kept as a table; ``by`` is a column its files are divided by, so that readers of few values read few files."""
    writer = rows.write.mode("append")
    (writer.partitionBy(by) if by else writer).parquet(path)


def kept_last(log: DataFrame, most: int, order: str, per: str | None = None) -> DataFrame:
    """What a log keeps: the last ``most`` rows (10 turns of a session, 200 gaps, 200 actions), of each value of ``per`` where one is given.

    Rows of equal order are kept by the hash of the whole row, so the choice doesn't depend on the partitioning."""
    tie = F.xxhash64(*log.columns)
    if per is None:
        return log.orderBy(F.desc(order), tie).limit(most)
    w = Window.partitionBy(per).orderBy(F.desc(order), tie)
    return log.withColumn("_age", F.row_number().over(w)).where(F.col("_age") <= most).drop("_age")


def merged_terms(learned: DataFrame, fresh: DataFrame) -> DataFrame:
    """(lang, term): a learned vocabulary and what was learned since."""
    return learned.select("lang", "term").union(fresh.select("lang", "term")).where("lang is not null and term is not null").distinct()
