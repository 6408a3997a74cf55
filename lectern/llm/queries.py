"""Queries of the ten problems and, where SQL can say it, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import distinctive, kinds, language, mixing, mojibake, neardup, pieces, scans, subjects, tokens
from lectern.session import materialize, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_pairs(*neardup.similar_classes(table(spark, sf_dir, "documents"), k=3, threshold=0.5, min_words=20))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_groups(*neardup.similar_classes(table(spark, sf_dir, "documents"), k=3, threshold=0.5, min_words=20))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.found(scans.examined(table(spark, sf_dir, "scan_pages")))


def p2_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.paragraphs(scans.examined(table(spark, sf_dir, "scan_pages")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.affected(table(spark, sf_dir, "documents"))


def p3_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.repaired(table(spark, sf_dir, "documents"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = materialize(kinds.described(table(spark, sf_dir, "documents")).select("id", "n_chars", "votes"), "votes")
    return kinds.found(kinds.posteriors(votes))


def p4_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures = materialize(kinds.described(table(spark, sf_dir, "documents")), "figures")
    return kinds.posteriors(figures).drop("votes").withColumnRenamed("id", "doc_id")


def p4_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each labelling function is worth, as learned."""
    return kinds.accuracies(materialize(kinds.described(table(spark, sf_dir, "documents")).select("votes"), "votes"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The passages of each item's rare terms: its cases ask for the rarity of a term only, so the weights that ``rare`` gives play no part in which rows come out."""
    items = materialize(distinctive.query_terms(table(spark, sf_dir, "benchmark")), "items")
    return distinctive.rare(table(spark, sf_dir, "passages"), items).join(items, "term").select("item_id", "pid").distinct()


def p5_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much each item's rare terms say about their passages: the sums of the weights."""
    items = materialize(distinctive.query_terms(table(spark, sf_dir, "benchmark")), "items")
    held = distinctive.rare(table(spark, sf_dir, "passages"), items).join(items, "term")
    return held.groupBy("item_id", "pid").agg(F.round(F.sum("weight"), 6).alias("weight"), F.count("*").alias("n_terms"))


def p5_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return distinctive.weights(table(spark, sf_dir, "passages"))


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return materialize(language.segmented(documents, language.trained(documents)), "segments")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.found(_segments(spark, sf_dir))


def p6_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each segment's place, language and confidence."""
    s = _segments(spark, sf_dir).select(F.col("id").alias("doc_id"), F.posexplode("segments").alias("segment", "s"))
    return s.select("doc_id", "segment", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.col("s.lang").alias("lang"), F.col("s.confidence").alias("confidence"))


def p6_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.document_languages(_segments(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = subjects.profiles(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_areas"))
    return subjects.found(docs, subjects.propagated(docs)).select("doc_id", "domain")


def p7_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = subjects.profiles(table(spark, sf_dir, "documents"), table(spark, sf_dir, "subject_areas"))
    return subjects.composition(subjects.found(docs, subjects.propagated(docs)))


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encoded(table(spark, sf_dir, "documents"))


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(mixing.sized(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(mixing.sized(table(spark, sf_dir, "documents")), table(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, limit, overlap = pieces.limits_of(table(spark, sf_dir, "split_limits"))
    _, tables = pieces.ranges_of(table(spark, sf_dir, "documents"), limit, overlap, name=name)
    return pieces.spans(tables, limit).where("piece = 0").select(F.col("key").alias("doc_id"))


def p10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, limit, overlap = pieces.limits_of(table(spark, sf_dir, "split_limits"))
    ranges, tables = pieces.ranges_of(table(spark, sf_dir, "documents"), limit, overlap, name=name)
    return pieces.emitted(ranges, pieces.spans(tables, limit)).withColumnRenamed("key", "doc_id")


def queries() -> dict:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1].isdigit()}


_TERMS = "list_transform(regexp_extract_all(strip_accents(lower({})), '[\\pL\\pN]+'), lambda w: CASE WHEN length(w) > 3 AND ends_with(w, 's') THEN left(w, length(w) - 1) ELSE w END)"


def oracle_sql() -> dict[str, str]:
    """SQL for what needs no model, tokenizer or similarity search."""
    text = "coalesce(title, '') || ' ' || coalesce(text, '')"
    return {
        "p5_found": f"""WITH s AS (SELECT DISTINCT pid, unnest({_TERMS.format(text)}) AS term FROM passages), f AS (SELECT term FROM s GROUP BY term HAVING count(*) <= 6),
i AS (SELECT DISTINCT item_id, unnest({_TERMS.format("text")}) AS term FROM benchmark WHERE text IS NOT NULL) SELECT DISTINCT item_id, pid FROM i JOIN f USING (term) JOIN s USING (term)""",
    }
