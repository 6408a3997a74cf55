"""Files of Markdown and text as passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions.text import strip

_COMMENT = r"(?s)\A<!--(.*?)-->\s*"


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 where valid (a byte-order mark dropped), else as Latin-1."""
    return F.regexp_replace(F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1")), r"\A\x{FEFF}", "")


def files(spark: SparkSession, path: str, extensions: str = "{md,markdown,txt}") -> DataFrame:
    """(path, modified, size, content) of the files below ``path``."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{extensions}").load(path)
    root = path.replace("file://", "").rstrip("/")
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/+", "/"), f"^{root}/", "")
    return rows.select(rel.alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def listed(files_: DataFrame, passages: DataFrame) -> DataFrame:
    """(path, domain, n_passages, size_kb): every file, with 0 passages where it has none."""
    counts = passages.groupBy(F.col("source").alias("path")).agg(F.count("*").alias("n"))
    return files_.join(counts, "path", "left").select("path", domain_of("path").alias("domain"), F.coalesce("n", F.lit(0)).alias("n_passages"), F.round(F.col("size") / 1024, 1).alias("size_kb"))


def domain_of(path: str) -> Column:
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise("general")


def passages(texts: DataFrame, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """(source, pos, domain, title, page, text): one row per block of a Markdown file.

    Blocks are divided by blank lines.  A leading comment gives the page (``pag:N``) and is dropped; blocks of heading lines
    alone set the running title; heading marks of other blocks are stripped."""
    blocks = texts.select(F.col(path_col).alias("source"), F.posexplode(F.split(F.regexp_replace(F.coalesce(text_col, F.lit("")), "\r\n?", "\n"), r"\n\s*\n")).alias("pos", "block"))
    b = blocks.withColumn("block", strip("block")).where("block != ''").withColumn("comment", F.regexp_extract("block", _COMMENT, 1)).withColumn("body", strip(F.regexp_replace("block", _COMMENT, "")))
    b = b.where("body != ''").withColumn("page", F.regexp_extract("comment", r"pag:\s*(\d+)", 1).try_cast("int"))
    lines = F.filter(F.split("body", "\n"), lambda s: F.trim(s) != "")
    heading = F.forall(lines, lambda s: F.ltrim(s).startswith("#"))
    b = b.withColumn("title", F.when(heading, F.trim(F.regexp_replace(F.try_element_at(lines, F.lit(1)), r"^\s*#+\s*", ""))))
    w = Window.partitionBy("source").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    carried = b.withColumn("running", F.last("title", ignorenulls=True).over(w)).where("title is null")
    return carried.select("source", "pos", domain_of("source").alias("domain"), F.coalesce("running", F.lit("")).alias("title"), "page", strip(F.regexp_replace("body", r"(?m)^#+\s*", "")).alias("text"))


def numbered(passages_: DataFrame) -> DataFrame:
    """Adds ``pid``: a hash of source and place, the same on every read."""
    return passages_.withColumn("pid", F.xxhash64("source", "pos"))
