"""Classification and understanding of short texts, in batch.  Null texts have no tokens."""

from __future__ import annotations

from collections import deque
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern import lexicons as lex
from lectern.functions.text import col, contains_any, jaccard, normalized, slug, tokens, without_fillers

_strings = lambda xs: F.array(*map(F.lit, xs))


def keyword_scores(docs: DataFrame, lexicon: DataFrame, patterns: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, domain, score): keywords of each domain found in the text, plus 2 per match of the domain's pattern.

    ``lexicon`` (domain, keyword) is a parameter of a few hundred rows; a keyword listed twice counts twice.  The keywords are
    folded into one expression over the text, so documents are read once and nothing is multiplied by the lexicon."""
    rows = [(r["domain"], r["keyword"]) for r in lexicon.select("domain", "keyword").where("domain is not null and keyword is not null").collect()]
    words: dict[str, list[str]] = {}
    for d, k in rows:
        words.setdefault(d, []).append(k)
    low = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col), F.lower(text_col).alias("low"), tokens(text_col).alias("toks")).withColumn("joined", F.array_join("toks", "\n"))
    each = []
    for d in sorted(words.keys() | (patterns or {}).keys()):
        keys = _strings(words.get(d, [])) if d in words else F.array().cast("array<string>")
        hits = F.size(F.filter(keys, lambda k: F.contains(F.col("low"), k) | F.contains(F.col("joined"), k)))
        extra = 2 * F.regexp_count("low", F.lit(patterns[d])) if patterns and d in patterns else F.lit(0)
        each.append(F.struct(F.lit(d).alias("domain"), (hits + extra).cast("long").alias("score")))
    scored = low.where("low is not null").select(id_col, F.explode(F.array(*each)).alias("s"))
    return scored.select(id_col, "s.domain", "s.score").where("score > 0")


def best_domains(scores: DataFrame, docs: DataFrame, least: int = 2, id_col: str = "doc_id") -> DataFrame:
    """(id, domain): the best score, ties by name; 'general' below ``least``."""
    best = scores.groupBy(id_col).agg(F.min_by("domain", F.struct(-F.col("score"), "domain")).alias("domain"), F.max("score").alias("score"))
    return docs.select(id_col).distinct().join(best, id_col, "left").select(id_col, F.when(F.col("score") >= least, F.col("domain")).otherwise("general").alias("domain"))


def domains_or_new(best: DataFrame, filenames: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Where nothing was found, a domain named after the file; 'general' for generic names."""
    named = slug(F.regexp_replace("filename", r"\.[A-Za-z0-9]+$", ""), "_", 50, None)
    names = filenames.groupBy(id_col).agg(F.min(named).alias("named"))
    new = F.when(F.coalesce("named", F.lit("")).isin("", "general", "untitled", "documento", "document"), "general").otherwise(F.col("named"))
    return best.join(names, id_col, "left").select(id_col, F.when(F.col("domain") != "general", F.col("domain")).otherwise(new).alias("domain"))


def suggestions(scores: DataFrame, docs: DataFrame, top_k: int = 3, id_col: str = "doc_id") -> DataFrame:
    w = Window.partitionBy(id_col).orderBy(F.desc("score"), "domain")
    top = scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
    return docs.select(id_col).distinct().join(top, id_col, "left").select(id_col, F.coalesce("rank", F.lit(1)).alias("rank"), F.coalesce("domain", F.lit("general")).alias("domain"), F.coalesce("score", F.lit(0)).alias("score"))


def language(text: Column | str, vocabulary: dict[str, list[str]] | None = None) -> list[Column]:
    """score_es, score_en and lang: distinct tokens among stop words and learned words of each; es unless en has more."""
    toks = F.array_distinct(F.coalesce(tokens(text), F.array().cast("array<string>")))
    own = {c: F.size(F.array_intersect(toks, _strings(lex.STOPWORDS[c].split()))) + (F.size(F.array_intersect(toks, _strings(vocabulary[c]))) if vocabulary and vocabulary.get(c) else 0) for c in ("es", "en")}
    return [own["es"].alias("score_es"), own["en"].alias("score_en"), F.when(own["en"] > own["es"], "en").otherwise("es").alias("lang")]


def resolved_languages(turns: DataFrame, session: str = "conv_id", order: str = "turn", text: str = "text", history: int = 6) -> DataFrame:
    """(session, order, resolved): decisive turns keep their language, others take the commonest of the last ``history`` resolved ones (the last one on a tie).

    Sessions are sorted by the engine and read as a stream that remembers ``history`` turns; repeated turns count once (the least text)."""
    once = turns.groupBy(session, order).agg(F.min(text).alias(text)).select(session, order, *language(text))

    def run(batches):
        current, last, begun = None, deque(maxlen=history), False
        for p in batches:
            out = []
            for s, es, en, own in zip(p[session], p["score_es"], p["score_en"], p["lang"]):
                s = None if pd.isna(s) else s
                if not begun or s != current:
                    current, begun = s, True
                    last.clear()
                n_en = sum(x == "en" for x in last)
                if not last or es + en >= 2 and abs(es - en) >= 2:
                    to = own
                else:
                    to = "en" if 2 * n_en > len(last) else "es" if 2 * n_en < len(last) else last[-1]
                last.append(to)
                out.append(to)
            yield p[[session, order]].assign(resolved=out)

    kinds = {f.name: f.dataType.simpleString() for f in once.schema.fields}
    return once.repartition(session).sortWithinPartitions(session, order).mapInPandas(run, f"{session} {kinds[session]}, {order} {kinds[order]}, resolved string")


def intents(texts: DataFrame, examples: DataFrame, least: float = 0.2, id_col: str = "id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, intent, score): the example of the text's language with the greatest Jaccard overlap of tokens; null below ``least``.

    ``examples`` (intent, lang, example) is a parameter.  Texts meet only examples that share a token with them: an equality join on tokens, pre-aggregated by pair."""
    ex = examples.select("intent", F.col("lang").alias("l"), F.monotonically_increasing_id().alias("e"), F.array_distinct(tokens("example")).alias("et")).where(F.size("et") > 0)
    tx = texts.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).alias("l"), F.array_distinct(F.coalesce(tokens(text_col), F.array().cast("array<string>"))).alias("tt"))
    shared = tx.select("id", "l", F.size("tt").alias("nt"), F.explode("tt").alias("tok")).join(ex.select("intent", "l", "e", F.size("et").alias("ne"), F.explode("et").alias("tok")), ["l", "tok"])
    pairs = shared.groupBy("id", "e", "intent", "nt", "ne").agg(F.count("*").alias("both")).withColumn("score", F.round(F.col("both") / (F.col("nt") + F.col("ne") - F.col("both")), 6))
    best = pairs.groupBy("id").agg(F.max("score").alias("score"), F.min_by("intent", F.struct(-F.col("score"), "intent")).alias("intent"))
    return tx.select("id").distinct().join(best, "id", "left").select("id", F.when(F.col("score") >= least, F.col("intent")).alias("intent"), F.coalesce("score", F.lit(0.0)).alias("score"))


def learned_words(texts: DataFrame, known: dict[str, list[str]] | None = None, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, term): tokens not known in their language."""
    pairs = texts.where(F.col(lang_col).isin("es", "en")).select(F.col(lang_col).alias("lang"), F.explode(F.array_distinct(tokens(text_col))).alias("term")).distinct()
    rows = [(c, t) for c, ts in (known or {c: v.split() for c, v in lex.STOPWORDS.items()}).items() for t in ts]
    return pairs.join(texts.sparkSession.createDataFrame(rows, "lang string, term string"), ["lang", "term"], "left_anti")


def rotation(log: DataFrame, key: str = "intent", ts: str = "ts", ident: str = "usage_id", responses: int = 3) -> DataFrame:
    """Adds which of ``responses`` replies is due: they take turns per key and language, in order of time and id.

    Rows are counted per hour and numbered within the hour, so a key that holds most rows is no single task."""
    hour = F.coalesce(F.date_trunc("hour", F.col(ts)).cast("string"), F.lit(""))
    rows = log.withColumn("_hour", hour)
    per = rows.groupBy(key, "lang", "_hour").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(key, "lang").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(F.col(key).alias("_key"), F.col("lang").alias("_lang"), F.col("_hour").alias("_of"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    both = rows.join(per, rows[key].eqNullSafe(per["_key"]) & rows["lang"].eqNullSafe(per["_lang"]) & (rows["_hour"] == per["_of"]))
    place = F.row_number().over(Window.partitionBy(key, "lang", "_hour").orderBy(ts, ident))
    return both.withColumn("response", ((F.col("_before") + place - 1) % responses).cast("int")).drop("_hour", "_key", "_lang", "_of", "_before")


def is_question(text: Column | str) -> Column:
    t, n = F.coalesce(col(text), F.lit("")), normalized(F.coalesce(col(text), F.lit("")))
    phrases = [p for _, ps in lex.REWRITES for p in ps]
    return t.contains("?") | t.contains("¿") | F.coalesce(F.get(tokens(t), F.lit(0)).isin(*lex.QUESTION_STARTS), F.lit(False)) | contains_any(n, phrases)


def is_challenge(text: Column | str) -> Column:
    return contains_any(normalized(F.coalesce(col(text), F.lit(""))), lex.CHALLENGE)


def is_explain_request(text: Column | str) -> Column:
    return contains_any(normalized(F.coalesce(col(text), F.lit(""))), lex.EXPLAIN)


def question_type(text: Column | str) -> Column:
    n = normalized(F.coalesce(col(text), F.lit("")))
    return reduce(lambda x, r: x.when(contains_any(n, r[1]), F.lit(r[0])), lex.REWRITES[1:], F.when(contains_any(n, lex.REWRITES[0][1]), F.lit(lex.REWRITES[0][0])))


def core_topic(text: Column | str) -> Column:
    toks = F.split(without_fillers(F.coalesce(col(text), F.lit(""))), " ")
    plain = F.filter(toks, lambda t: (F.length(t) > 2) & ~F.array_contains(_strings(lex.QUESTION_STARTS + lex.ALL_STOPWORDS), t))
    core = F.filter(plain, lambda t: ~F.array_contains(_strings(lex.INTENT_WORDS), t))
    return F.array_join(F.slice(F.when(F.size(core) > 0, core).otherwise(plain), 1, 5), " ")


def _content(toks: Column) -> Column:
    return F.filter(toks, lambda t: (F.length(t) > 3) & ~F.array_contains(_strings(lex.QUESTION_STARTS), t))


def is_followup(text: Column | str, has_memory: Column) -> Column:
    t = F.coalesce(col(text), F.lit(""))
    toks, n = tokens(t), normalized(t)
    single = [m for m in lex.FOLLOWUP if " " not in m]
    content = _content(toks)
    return contains_any(n, [m for m in lex.FOLLOWUP if " " in m]) | F.arrays_overlap(toks, _strings(single)) | (F.size(content) == 0) | (has_memory & F.forall(content, lambda c: F.array_contains(_strings(lex.ACTION_VERBS), c)))


def in_context(turns: DataFrame, session: str = "conv_id", order: str = "turn", text: str = "text") -> DataFrame:
    """(session, order, is_followup, query): follow-ups are searched with the topic of the turn before and terms for their verbs."""
    once = turns.groupBy(session, order).agg(F.min(text).alias("text"))
    w = Window.partitionBy(session).orderBy(order)
    before = once.withColumn("before", F.lag("text").over(w)).withColumn("first", F.row_number().over(w) == 1)
    marked = before.withColumn("is_followup", is_followup("text", ~F.col("first")))
    verbs = {k: v for k, v in lex.table(lex.ACTION_SYNONYMS).items()}
    lookup = F.create_map(*[x for k, v in verbs.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    none = F.array().cast("array<string>")
    topic = F.slice(_content(tokens(F.coalesce("before", F.lit("")))), 1, 6)
    actions = F.slice(F.flatten(F.transform(_content(tokens(F.coalesce("text", F.lit("")))), lambda c: F.coalesce(F.try_element_at(lookup, c), none))), 1, 4)
    query = F.when(F.col("is_followup") & ~F.col("first"), F.concat_ws(" ", F.array_join(F.concat(topic, actions), " "), F.coalesce("text", F.lit("")))).otherwise(F.coalesce("text", F.lit("")))
    return marked.select(session, order, "is_followup", F.trim(query).alias("query"))


def looks_like_code(text: Column | str) -> Column:
    t = F.coalesce(col(text), F.lit(""))
    hits = reduce(lambda x, p: x + t.rlike(p.replace("(?m)", "(?md)")).cast("int"), lex.CODE_PATTERNS, F.lit(0))
    return (hits >= 2) & (F.trim(t).contains("\n") | (F.length(t) > 60))


def route(text: Column | str, intent: Column, intent_score: Column, knowledge_score: Column) -> Column:
    """What kind of reply a message gets, in fixed priority."""
    t = F.coalesce(col(text), F.lit(""))
    return (
        F.when(is_challenge(t), "debate").when(is_explain_request(t), "explain").when(looks_like_code(t) | t.contains("```"), "code")
        .when(intent.isNotNull() & (intent_score >= 0.5), "smalltalk").when(knowledge_score > 0, "knowledge")
        .when(intent.isNotNull() & (F.size(F.split(F.trim(t), r"\s+")) <= 3), "smalltalk").otherwise("unknown")
    )
