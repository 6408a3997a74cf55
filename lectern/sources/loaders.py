"""Word lists, intents, settings and registries from files.

Missing files are empty lists, or the defaults.  Nulls and repeated rows are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import tokens


def _exists(spark: SparkSession, path: str) -> bool:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(conf).exists(at)


def stopwords(spark: SparkSession, folder: str, langs: tuple[str, ...] = ("es", "en")) -> DataFrame:
    """(lang, term) of the files ``stopwords_<lang>.txt``, words between blanks.  Indexing takes the union of the terms."""
    out = spark.createDataFrame([], "lang string, term string")
    for lang in langs:
        if _exists(spark, path := f"{folder}/stopwords_{lang}.txt"):
            words = spark.read.text(path).select(F.explode(F.split("value", r"\s+")).alias("term")).where("term != ''")
            out = out.union(words.select(F.lit(lang).alias("lang"), "term"))
    return out.distinct()


_INTENTS = "map<string, struct<examples: map<string, array<string>>, responses: map<string, array<string>>>>"


def intents(spark: SparkSession, path: str) -> DataFrame:
    """(intent, lang, example) of a JSON object {intent: {examples: {lang: [text]}}}."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "intent string, lang string, example string")
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", _INTENTS).alias("all"))
    one = parsed.select(F.explode("all").alias("intent", "body")).select("intent", F.explode("body.examples").alias("lang", "examples"))
    return one.select("intent", "lang", F.explode("examples").alias("example")).where("example is not null").distinct()


def vocabulary(examples: DataFrame) -> DataFrame:
    """(lang, term): the words of the examples (lang, example)."""
    return examples.select("lang", F.explode(tokens("example")).alias("term")).distinct()


def learned(spark: SparkSession, path: str) -> DataFrame:
    """(lang, term) of a JSON object {lang: [term]}."""
    if not _exists(spark, path):
        return spark.createDataFrame([], "lang string, term string")
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string, array<string>>").alias("all"))
    return parsed.select(F.explode("all").alias("lang", "terms")).select("lang", F.explode("terms").alias("term")).where("term is not null").distinct()


def settings(spark: SparkSession, path: str, defaults: dict) -> dict:
    """The settings of a JSON object, those it lacks from ``defaults``.  One small object, so it is read on the driver."""
    import json

    if not _exists(spark, path):
        return dict(defaults)
    rows = spark.read.text(path, wholetext=True).take(1)
    return {**defaults, **(json.loads(rows[0][0]) if rows and rows[0][0].strip() else {})}


REGISTRY = "filename string, category string, imported_at timestamp, chunk_count int, doc_id long"


def registry(spark: SparkSession, path: str) -> DataFrame:
    """(file_hash, filename, category, imported_at, chunk_count, doc_id) of a JSON object {file_hash: record}."""
    if not _exists(spark, path):
        return spark.createDataFrame([], f"file_hash string, {REGISTRY}")
    parsed = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, struct<{REGISTRY}>>").alias("all"))
    return parsed.select(F.explode("all").alias("file_hash", "r")).select("file_hash", "r.*")


def with_defaults(df: DataFrame, **defaults) -> DataFrame:
    """Nulls of the named columns replaced."""
    filled: dict[str, Column] = {c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()}
    return df.withColumns(filled)
