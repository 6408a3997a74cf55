"""Adding to a collection of Markdown files, and looking it over.

Files are rows (path, text); nothing is changed in place: what is added or rewritten comes out as
new rows, to be written as a new version.  Blank additions give no row; repeated ids are one addition (the least text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import slug, strip, word_count, words
from lectern.operators.chunking import flat_cleaned
from lectern.operators.index import Index
from lectern.operators.quality import prose_quality
from lectern.operators.retrieval import classify_domains, query_terms, search
from lectern.sources.corpus import domain_of
from lectern.sources.sinks import formatted, next_index

#: Lengths of titles and of names made of them; least score of a file to be added to.
TITLE, DOMAIN, NEW_DOMAIN, LEAST_SCORE = 60, 30, 20, 0.1


def title_of(text: Column, title: Column) -> Column:
    """The given title, else the first line without heading marks, cut to ``TITLE`` characters."""
    first = F.trim(F.regexp_replace(F.substring_index(text, "\n", 1), "^#+", ""))
    return F.coalesce(F.when(F.trim(title) != "", title), F.when(first != "", F.substring(first, 1, TITLE)), F.lit("Sin titulo"))


def ingested(texts: DataFrame, index: Index, files: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """(doc_id, title, domain, is_new_domain, path, content): where each text goes and what is written there.

    texts: doc_id, text, title, domain.  A given domain is kept; else the one its words score best in, or, where too few
    of them are known, a new one named after the title.  Files of a folder are numbered on from its greatest number, in the
    order of the ids; numbers of a folder are counted by blocks, so a folder that takes most texts is no single task.  files: path."""
    given = texts.where("doc_id is not null").groupBy("doc_id").agg(F.min_by(F.struct("text", "title", "domain"), F.coalesce("text", F.lit(""))).alias("r")).select("doc_id", "r.*")
    given = given.withColumn("text", strip("text")).where("text != ''").withColumn("title", title_of(F.col("text"), F.col("title")))
    told = classify_domains(query_terms(given.where("domain is null").select(F.col("doc_id").alias("qid"), "text"), synonyms), index).select(F.col("qid").alias("doc_id"), F.col("domain").alias("told"), "is_new")
    both = given.join(told, "doc_id", "left")
    fresh = F.col("domain").isNull() & F.coalesce("is_new", F.lit(True))
    word = slug(F.get(F.split(F.trim("title"), r"[\s\-_]+"), F.lit(0)), "-", NEW_DOMAIN, None)
    new = F.coalesce(F.when(word != "", word), slug("title", "-", NEW_DOMAIN))
    folder = F.when(F.col("domain").isNotNull(), slug("domain", "-", DOMAIN)).when(fresh, new).otherwise(F.col("told"))
    rows = both.select("doc_id", "title", folder.alias("domain"), fresh.alias("is_new_domain"), "text").withColumn("block", F.shiftright("doc_id", 12))
    earlier = Window.partitionBy("domain").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = rows.groupBy("domain", "block").agg(F.count("*").alias("n")).select("domain", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = rows.join(before, ["domain", "block"]).join(next_index(files, "path").withColumnRenamed("folder", "domain"), "domain", "left")
    number = F.coalesce("next_index", F.lit(1)) + F.col("before") + F.row_number().over(Window.partitionBy("domain", "block").orderBy("doc_id")) - 1
    name = F.format_string("%s/%02d-%s.md", "domain", number, slug("title"))
    return numbered.select("doc_id", "title", "domain", "is_new_domain", name.alias("path"), F.concat(F.lit("# "), "title", F.lit("\n\n"), formatted("text")).alias("content"))


def enriched(additions: DataFrame, files: DataFrame) -> DataFrame:
    """(path, text): the files that get additions (id, path, section, text), each as a section at the end, in the order of the ids.

    A section without a title is called ``Ampliación`` and the number of sections then plus one.  Additions to a path that isn't there are left out."""
    once = additions.where("id is not null and trim(text) != ''").groupBy("id").agg(F.min_by(F.struct("path", "section", "text"), "text").alias("r")).select("id", "r.*")
    lists = once.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("id", "section", "text"))).alias("more"))
    both = files.groupBy("path").agg(F.min("text").alias("text")).join(lists, "path")
    have = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"(?m)^##\s"))
    head = lambda x, i: F.coalesce(F.when(F.trim(x["section"]) != "", x["section"]), F.concat(F.lit("Ampliación "), (have + i + 1).cast("string")))
    parts = F.transform("more", lambda x, i: F.concat(F.lit("\n\n## "), head(x, i), F.lit("\n\n"), strip(x["text"]), F.lit("\n")))
    return both.select("path", F.concat(F.coalesce("text", F.lit("")), F.array_join(parts, "")).alias("text"))


def enrichment_targets(additions: DataFrame, index: Index, synonyms: DataFrame | None = None) -> DataFrame:
    """(id, path, section, text): additions (id, query, section, text) with the file of the best hit of their query; without one of ``LEAST_SCORE`` they are left out."""
    hits = search(query_terms(additions.select(F.col("id").alias("qid"), F.col("query").alias("text")), synonyms), index, 1).where(F.col("score") >= LEAST_SCORE)
    return additions.join(hits.select(F.col("qid").alias("id"), F.col("source").alias("path")), "id").select("id", "path", "section", "text")


def cleaned_files(files: DataFrame, least_words: int = 20, least_quality: float = 0.15) -> DataFrame:
    """(path, text, removed, words_before, words_after): files without bad blocks and sentences.

    Headings stay; blocks of fewer than five words, of low quality, or of fewer than ``least_words`` after their bad sentences went, are removed."""
    blocks = files.select("path", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n\n")).alias("pos", "block")).withColumn("block", strip("block")).where("block != ''")
    head = F.col("block").rlike(r"^#{1,6}\s")
    worth = blocks.withColumn("id", F.xxhash64("path", "pos")).withColumn("body", ~head & (F.size(words("block")) >= 5) & (prose_quality("block", tool=True) >= least_quality))
    flat = flat_cleaned(worth.where("body").select("id", F.col("block").alias("text")), "id", least_words=least_words, tool=True).withColumnRenamed("text", "clean")
    kept = worth.join(flat, "id", "left").withColumn("out", F.when(head, F.col("block")).otherwise(F.coalesce("clean", F.lit(""))))
    part = F.transform(F.filter(F.sort_array(F.collect_list(F.struct("pos", "out"))), lambda x: x["out"] != ""), lambda x: x["out"])
    return kept.groupBy("path").agg(F.concat(F.array_join(part, "\n\n"), F.lit("\n")).alias("text"), F.count_if(F.col("out") == "").alias("removed"), F.sum(F.size(words("block"))).alias("words_before"), F.sum(F.size(words("out"))).alias("words_after"))


def restored(versions: DataFrame, since: Column) -> DataFrame:
    """(path, text): of each file the oldest saved version (path, saved_at, text) not before ``since``: what it was before the rewrites since then."""
    return versions.where(F.col("saved_at") >= since).groupBy("path").agg(F.min_by("text", F.struct("saved_at", F.coalesce("text", F.lit("")))).alias("text"))


def categories(files: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(domain): the folders that hold files, and those of ``more`` (name), as slugs."""
    have = files.where("path is not null and instr(path, '/') > 0").select(domain_of("path").alias("domain"))
    return (have if more is None else have.union(more.select(slug("name", "_", 50, None).alias("domain")).where("domain != ''"))).distinct()


def looked_over(files: DataFrame, wanted: DataFrame, least: int = 80, least_orphan: int = 30) -> DataFrame:
    """(action, path, words): what a look over the files (path, text) finds: 'empty' and 'thin' files, 'orphan' files of at least
    ``least_orphan`` words outside any folder, and 'stub' for each wanted domain (domain) without a folder."""
    per = files.where("path is not null").groupBy("path").agg(F.sum(F.coalesce(word_count("text"), F.lit(0))).alias("words"))
    inside = F.instr("path", "/") > 0
    action = F.when(inside & (F.col("words") == 0), "empty").when(inside & (F.col("words") < least), "thin").when(~inside & (F.col("words") >= least_orphan), "orphan")
    found = per.select(action.alias("action"), "path", "words").where("action is not null")
    missing = wanted.where("domain is not null").select("domain").distinct().join(categories(files), "domain", "left_anti")
    return found.union(missing.select(F.lit("stub"), F.concat("domain", F.lit("/00-introduccion.md")), F.lit(0).cast("long")))


def routed(orphans: DataFrame, index: Index, synonyms: DataFrame | None = None) -> DataFrame:
    """(path, to): where files (path, text) without a folder belong: the domain their words score best in, else a folder of their name."""
    q = orphans.select(F.xxhash64("path").alias("qid"), "path", "text")
    told = classify_domains(query_terms(q.select("qid", "text"), synonyms), index).select("qid", "domain")
    stem = F.substring(F.replace(F.lower(F.regexp_replace("path", r"\.[^.]*$", "")), F.lit(" "), F.lit("_")), 1, 30)
    return q.join(told, "qid", "left").select("path", F.concat(F.coalesce("domain", stem), F.lit("/"), "path").alias("to"))
