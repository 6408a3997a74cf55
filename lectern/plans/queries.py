"""The library's queries over the test tables, each with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import lexicons as lex
from lectern.functions import text as tx
from lectern.operators import changes, chunking, cleaning, codes, index, knowledge, logs, nlu, quality, retrieval
from lectern.plans import sql as s
from lectern.session import materialize, shared_dir, spread, table
from lectern.sources import corpus, formats, sinks
from lectern.streaming import windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def documents(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents")).where("text is not null")


def _text(name: str, step: Callable, sql: str | None) -> None:
    """A cleaning step over the text of every document."""

    def run(spark: SparkSession, d: str) -> DataFrame:
        return documents(spark, d).select("doc_id", step(F.col("text")).alias("cleaned"))

    run.__name__ = name
    query(f"SELECT doc_id, {sql} AS cleaned FROM documents WHERE text IS NOT NULL" if sql else None)(run)


def _lines(x: str = "text", keep: str = "TRUE") -> str:
    return f"SELECT doc_id, unnest(string_split({x}, {s.NL})) AS line, generate_subscripts(string_split({x}, {s.NL}), 1) AS pos FROM documents WHERE text IS NOT NULL AND {keep}"


_text("c01_nfc", tx.nfc, "nfc_normalize(replace(text, chr(0), ''))")
_text("c02_pdf_artifacts", cleaning.pdf_artifacts, s.pdf_artifacts("text"))
_text("c03_entities", cleaning.entities, s.entities("text"))
_text("c04_control_characters", cleaning.control_characters, s.control("text"))
_text("c05_whitespace", cleaning.whitespace, s.whitespace("text"))
_text("c06_short_lines", lambda c: cleaning.short_noise_lines(c, 4), s.short_lines("text", 4))
_text("c07_duplicate_paragraphs", cleaning.duplicate_paragraphs, None)
SQL["c07_duplicate_paragraphs"] = f"""
WITH p AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n{{2,}}')) AS para, generate_subscripts(regexp_split_to_array(text, '\\n{{2,}}'), 1) AS pos FROM documents WHERE text IS NOT NULL),
k AS (SELECT doc_id, para, pos, {s.squeezed("lower(para)")} AS key FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS rn FROM k)
SELECT doc_id, string_agg(para, chr(10) || chr(10) ORDER BY pos) AS cleaned FROM r WHERE rn = 1 OR len(string_split(key, ' ')) < 6 GROUP BY doc_id"""
_text("c08_punctuation", cleaning.punctuation, s.punctuation("text"))
_CELLS = f"list_filter(list_transform(regexp_split_to_array({s.strip('line')}, ' {{2,}}'), lambda c: {s.strip('c')}), lambda c: c <> '')"
_text("c09_broken_tables", cleaning.broken_tables, None)
SQL["c09_broken_tables"] = f"""
WITH l AS ({_lines()}), f AS (SELECT *, len({_CELLS}) >= 3 AND NOT starts_with({s.strip("line")}, '#') AS hit, {_CELLS} AS cells FROM l),
g AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM f), n AS (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, grp) AS size FROM g)
SELECT doc_id, string_agg(CASE WHEN hit AND size >= 2 THEN array_to_string(cells, ' | ') ELSE line END, chr(10) ORDER BY pos) AS cleaned FROM n GROUP BY doc_id"""
_text("c10_double_columns", cleaning.double_columns, None)
_RS = s.sub("line", rf"{tx.WS}+\z", "")
SQL["c10_double_columns"] = f"""
WITH l AS ({_lines()}), f AS (SELECT *, regexp_matches({_RS}, '^.+?[^\\s] {{3,}}[^\\s].*') AS hit, {s.strip(f"regexp_extract({_RS}, '^(.+?[^\\s]) {{3,}}([^\\s].+)', 1)")} AS lft, {s.strip(f"regexp_extract({_RS}, '^(.+?[^\\s]) {{3,}}([^\\s].+)', 2)")} AS rgt FROM l),
h AS (SELECT *  REPLACE (hit AND rgt <> '' AS hit) FROM f),
g AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM h), n AS (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, grp) AS size FROM g),
o AS (SELECT doc_id, pos, line AS out FROM n WHERE NOT (hit AND size >= 4) UNION ALL
      SELECT doc_id, min(pos), string_agg(lft, ' ' ORDER BY pos) || chr(10) || string_agg(rgt, ' ' ORDER BY pos) FROM n WHERE hit AND size >= 4 GROUP BY doc_id, grp)
SELECT doc_id, string_agg(out, chr(10) ORDER BY pos) AS cleaned FROM o GROUP BY doc_id"""
_text("c11_repeated_headers", cleaning.repeated_headers, None)
SQL["c11_repeated_headers"] = f"""
WITH l AS ({_lines()}), k AS (SELECT *, lower({s.strip("line")}) AS key, starts_with({s.strip("line")}, '#') AS head, {s.strip("line")} <> '' AND NOT starts_with({s.strip("line")}, '#') AND len({s.words("line")}) <= 10 AS short FROM l),
c AS (SELECT doc_id, key FROM k WHERE short GROUP BY doc_id, key HAVING count(*) >= 3)
SELECT d.doc_id, coalesce((SELECT string_agg(k.line, chr(10) ORDER BY k.pos) FROM k WHERE k.doc_id = d.doc_id AND (k.head OR NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = k.doc_id AND c.key = k.key))), '') AS cleaned FROM documents d WHERE text IS NOT NULL"""
_text("c12_watermarks", cleaning.watermarks, None)
SQL["c12_watermarks"] = f"""
WITH l AS ({_lines()}), k AS (SELECT *, {s.strip("line")} AS st FROM l), c AS (SELECT doc_id, st FROM k WHERE upper(st) = st AND lower(st) <> st AND length(st) >= 3 AND len({s.words("st")}) = 1 GROUP BY doc_id, st HAVING count(*) >= 3)
SELECT d.doc_id, coalesce((SELECT string_agg(k.line, chr(10) ORDER BY k.pos) FROM k WHERE k.doc_id = d.doc_id AND NOT list_contains({s.strings(lex.WATERMARKS)}, lower(k.st)) AND NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = k.doc_id AND c.st = k.st)), '') AS cleaned FROM documents d WHERE text IS NOT NULL"""


def _whole(aggressive: bool, source: str = "documents") -> str:
    """The composition as one chain of tables s0 (doc_id, text), s1, ..."""
    n, ctes = 0, [f"s0 AS (SELECT doc_id, nfc_normalize(replace(text, chr(0), '')) AS text FROM {source} WHERE text IS NOT NULL)"]

    def scalar(e):
        nonlocal n
        ctes.append(f"s{n + 1} AS MATERIALIZED (SELECT doc_id, {e} AS text FROM s{n})")
        n += 1

    def lines(name):
        return f"{name}{n} AS (SELECT doc_id, unnest(string_split(text, {s.NL})) AS line, generate_subscripts(string_split(text, {s.NL}), 1) AS pos FROM s{n})"

    def joined(of, keep, order="pos", out="line"):
        """Kept lines put together again, texts without any as ''."""
        nonlocal n
        ctes.append(f"s{n + 1} AS MATERIALIZED (SELECT s.doc_id, coalesce(j.text, '') AS text FROM s{n} s LEFT JOIN (SELECT doc_id, string_agg({out}, chr(10) ORDER BY {order}) AS text FROM {of} WHERE {keep} GROUP BY doc_id) j USING (doc_id))")
        n += 1

    scalar(s.pdf_artifacts("text"))
    if aggressive:
        i = n
        ctes.append(lines("l"))
        ctes.append(f"f{i} AS (SELECT *, len({_CELLS}) >= 3 AND NOT starts_with({s.strip('line')}, '#') AS hit, {_CELLS} AS cells FROM l{i})")
        ctes.append(f"g{i} AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM f{i})")
        ctes.append(f"n{i} AS (SELECT doc_id, pos, CASE WHEN hit AND sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, grp) >= 2 THEN array_to_string(cells, ' | ') ELSE line END AS line FROM g{i})")
        joined(f"n{i}", "TRUE")
        i = n
        parts = [s.strip(f"regexp_extract({_RS}, '^(.+?[^\\s]) {{3,}}([^\\s].+)', {k})") for k in (1, 2)]
        ctes.append(lines("l"))
        ctes.append(f"f{i} AS (SELECT *, regexp_matches({_RS}, '^.+?[^\\s] {{3,}}[^\\s].*') AND {parts[1]} <> '' AS hit, {parts[0]} AS lft, {parts[1]} AS rgt FROM l{i})")
        ctes.append(f"g{i} AS (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS grp FROM f{i})")
        ctes.append(f"n{i} AS (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, grp) AS size FROM g{i})")
        ctes.append(f"o{i} AS (SELECT doc_id, pos, line FROM n{i} WHERE NOT (hit AND size >= 4) UNION ALL SELECT doc_id, min(pos), string_agg(lft, ' ' ORDER BY pos) || chr(10) || string_agg(rgt, ' ' ORDER BY pos) FROM n{i} WHERE hit AND size >= 4 GROUP BY doc_id, grp)")
        joined(f"o{i}", "TRUE")
    for step in (s.entities, s.control, s.whitespace):
        scalar(step("text"))
    i, st = n, s.strip("line")
    ctes.append(lines("l"))
    ctes.append(f"k{i} AS (SELECT *, lower({st}) AS key, starts_with({st}, '#') AS head, {st} <> '' AND NOT starts_with({st}, '#') AND len({s.words('line')}) <= 10 AS short FROM l{i})")
    ctes.append(f"c{i} AS (SELECT doc_id, key, TRUE AS gone FROM k{i} WHERE short GROUP BY doc_id, key HAVING count(*) >= 3)")
    joined(f"k{i} LEFT JOIN c{i} USING (doc_id, key)", "head OR gone IS NULL")
    i = n
    ctes.append(lines("l"))
    ctes.append(f"k{i} AS (SELECT *, {st} AS st FROM l{i})")
    ctes.append(f"c{i} AS (SELECT doc_id, st, TRUE AS gone FROM k{i} WHERE upper(st) = st AND lower(st) <> st AND length(st) >= 3 AND len({s.words('st')}) = 1 GROUP BY doc_id, st HAVING count(*) >= 3)")
    joined(f"k{i} LEFT JOIN c{i} USING (doc_id, st)", f"gone IS NULL AND NOT list_contains({s.strings(lex.WATERMARKS)}, lower(st))")
    scalar(s.short_lines("text", 4 if aggressive else 2))
    i = n
    ctes.append(f"p{i} AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\n{{2,}}')) AS para, generate_subscripts(regexp_split_to_array(text, '\\n{{2,}}'), 1) AS pos FROM s{i})")
    ctes.append(f"k{i} AS (SELECT doc_id, para, pos, {s.squeezed('lower(para)')} AS key FROM p{i})")
    ctes.append(f"r{i} AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS rn FROM k{i})")
    ctes.append(f"s{i + 1} AS MATERIALIZED (SELECT s.doc_id, coalesce(j.text, '') AS text FROM s{i} s LEFT JOIN (SELECT doc_id, string_agg(para, chr(10) || chr(10) ORDER BY pos) AS text FROM r{i} WHERE rn = 1 OR len(string_split(key, ' ')) < 6 GROUP BY doc_id) j USING (doc_id))")
    n += 1
    scalar(s.punctuation("text"))
    scalar(s.strip(s.sub(s.sub("text", " {2,}", " "), "\n{3,}", "\n\n")))
    return "WITH " + ",\n".join(ctes) + f",\nwhole AS (SELECT doc_id, text AS cleaned FROM s{n})"


_CLEAN, _CLEAN_AGGRESSIVE = _whole(False), _whole(True)


@query(f"{_CLEAN} SELECT * FROM whole")
def c00_clean(spark, d):
    return cleaning.cleaned(documents(spark, d)).select("doc_id", "cleaned")


@query(f"{_CLEAN_AGGRESSIVE} SELECT * FROM whole")
def c00_clean_aggressive(spark, d):
    return cleaning.cleaned(documents(spark, d), aggressive=True).select("doc_id", "cleaned")


_W = s.whitespace("text")
_NLS = lambda x: f"length({x}) - length(replace({x}, chr(10), '')) + 1"


@query(f"""WITH c AS (SELECT doc_id, text, {_W} AS c FROM documents WHERE text IS NOT NULL)
SELECT doc_id, length(text) AS original_chars, length(c) AS cleaned_chars, length(text) - length(c) AS removed_chars, len({s.words("text")}) AS original_words, len({s.words("c")}) AS cleaned_words, len({s.words("text")}) - len({s.words("c")}) AS removed_words,
{_NLS("text")} AS original_lines, {_NLS("c")} AS cleaned_lines, round((1 - length(c) / greatest(length(text), 1)) * 100, 1) AS reduction_pct FROM c""")
def c13_clean_stats(spark, d):
    docs = documents(spark, d).withColumn("c", cleaning.whitespace("text"))
    return docs.select("doc_id", *cleaning.clean_stats("text", "c"))


@query(f"""WITH l AS (SELECT DISTINCT doc_id, page, unnest(list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: {s.squeezed("x")})) AS line FROM scan_pages WHERE text IS NOT NULL)
SELECT doc_id, line, count(*) AS n_pages FROM l WHERE line <> '' AND len(string_split(line, ' ')) <= 12 GROUP BY doc_id, line HAVING count(*) >= 3""")
def c14_running_headers(spark, d):
    return cleaning.running_headers(table(spark, d, "scan_pages"))


@query(f"""WITH o AS (SELECT DISTINCT doc_id, page, text FROM scan_pages WHERE text IS NOT NULL), l AS (SELECT doc_id, page, unnest(list_distinct(list_transform(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: {s.squeezed("x")}))) AS line FROM o),
g AS (SELECT doc_id, list(line) AS gone FROM (SELECT doc_id, line FROM (SELECT DISTINCT * FROM l) WHERE line <> '' AND len(string_split(line, ' ')) <= 12 GROUP BY doc_id, line HAVING count(*) >= 3) GROUP BY doc_id)
SELECT doc_id, page, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT list_contains(gone, {s.squeezed("x")})), chr(10)) END AS text FROM o LEFT JOIN g USING (doc_id)""")
def c14_pages_without_headers(spark, d):
    return cleaning.without_running_headers(table(spark, d, "scan_pages").where("text is not null"))


@query()
def c15_column_breaks(spark, d):
    return chunking.mended(documents(spark, d), "doc_id")


@query()
def c16_clean_passages(spark, d):
    return chunking.clean_passages(table(spark, d, "passages"), "pid")


def _fillers(x: str) -> str:
    y = f"' ' || array_to_string({s.tokens(x)}, ' ') || ' '"
    for f in lex.FILLERS:
        y = f"replace({y}, {s.q(f' {f} ')}, ' ')"
    return f"trim({y})"


@query(f"SELECT item_id, array_to_string({s.tokens('text')}, ' ') AS normalized, {_fillers('text')} AS core FROM benchmark")
def c18_fillers(spark, d):
    return table(spark, d, "benchmark").select("item_id", tx.normalized("text").alias("normalized"), tx.without_fillers("text").alias("core"))


@query("""WITH a AS (SELECT doc_id, title, regexp_replace(regexp_replace(lower(strip_accents(coalesce(title, ''))), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS s FROM documents), b AS (SELECT doc_id, title, regexp_replace(left(s, 40), '-+$', '') AS s FROM a)
SELECT doc_id, CASE WHEN s = '' THEN 'nuevo-tema' ELSE s END AS slug FROM b""")
def c19_slugs(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.slug(F.coalesce("title", F.lit(""))).alias("slug"))


@query("SELECT doc_id, strip_accents(text) AS plain FROM documents WHERE text IS NOT NULL AND regexp_full_match(text, '[\\x{0}-\\x{17F}\\x{300}-\\x{36F}\\x{2000}-\\x{206F}]*')")
def c20_strip_accents(spark, d):
    return documents(spark, d).where(F.col("text").rlike(r"^[\x{0}-\x{17F}\x{300}-\x{36F}\x{2000}-\x{206F}]*$(?!\n)")).select("doc_id", tx.strip_accents("text").alias("plain"))


@query("SELECT doc_id, strip_accents(text) AS plain FROM documents WHERE text IS NOT NULL")
def c21_strip_accents_all(spark, d):
    """Every text; the SQL of ``c20_strip_accents`` leaves out those with other characters."""
    return documents(spark, d).select("doc_id", tx.strip_accents("text").alias("plain"))


# --- tokens ---------------------------------------------------------------------------------------


@query(f"SELECT doc_id, len({s.tokens('text')}) AS n_tokens, array_to_string({s.tokens('text')}, ' ') AS tokens FROM documents WHERE text IS NOT NULL")
def t01_tokens(spark, d):
    return documents(spark, d).select("doc_id", F.size(tx.tokens("text")).cast("long").alias("n_tokens"), F.array_join(tx.tokens("text"), " ").alias("tokens"))


@query(f"SELECT doc_id, array_to_string({s.content(s.tokens('text'))}, ' ') AS terms FROM documents WHERE text IS NOT NULL")
def t03_content_terms(spark, d):
    return documents(spark, d).select("doc_id", F.array_join(tx.content_terms(tx.tokens("text")), " ").alias("terms"))


def synonyms(spark: SparkSession) -> DataFrame:
    rows = [(k, v) for k, vs in lex.table(lex.SYNONYMS).items() for v in vs]
    return spark.createDataFrame(rows, "canon string, variant string")


_SYN = ", ".join(f"({s.q(k)}, {s.strings(vs)})" for k, vs in lex.table(lex.SYNONYMS).items())
_TERMS = f"""own AS (SELECT item_id AS qid, lower(text) AS low, {s.content(s.tokens("text"))} AS base FROM benchmark),
g AS (SELECT grp, variants, {s.stem("replace(grp, ' ', '')")} AS st, list_distinct(flatten(list_transform(list_prepend(grp, variants), lambda v: {s.content(s.tokens("v"))}))) AS terms FROM (VALUES {_SYN}) t(grp, variants)),
extra AS (SELECT DISTINCT qid, unnest(list_filter(terms, lambda t: NOT list_contains(base, t))) AS term FROM own, g WHERE list_contains(base, st) OR len(list_filter(variants, lambda v: contains(low, v))) > 0),
terms AS (SELECT qid, term, count(*) AS n FROM (SELECT qid, unnest(base) AS term FROM own) GROUP BY qid, term UNION ALL SELECT qid, term, 1 FROM extra)"""


def benchmark(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), "text")


@query(f"WITH {_TERMS} SELECT * FROM terms")
def t04_query_terms(spark, d):
    return retrieval.query_terms(benchmark(spark, d), synonyms(spark))


@query(f"SELECT doc_id, len(string_split(regexp_replace(text, {s.q('([.!?])' + tx.WS + '+')}, '\\1' || chr(1), 'g'), chr(1))) AS n_sentences FROM documents WHERE text IS NOT NULL")
def t05_sentences(spark, d):
    return documents(spark, d).select("doc_id", F.size(tx.sentences("text")).cast("long").alias("n_sentences"))


@query(f"""WITH t AS (SELECT doc_id, list_distinct({s.tokens("title")}) AS a, list_distinct({s.tokens("text")}) AS b FROM documents WHERE text IS NOT NULL AND title IS NOT NULL)
SELECT doc_id, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / (len(a) + len(b) - len(list_intersect(a, b))) ELSE 0 END, 6) AS overlap FROM t""")
def t06_jaccard(spark, d):
    return documents(spark, d).where("title is not null").select("doc_id", F.round(tx.jaccard(F.array_distinct(tx.tokens("title")), F.array_distinct(tx.tokens("text"))), 6).alias("overlap"))


_PLAIN = f"list_filter(string_split({_fillers('text')}, ' '), lambda t: length(t) > 2 AND NOT list_contains({s.strings(lex.QUESTION_STARTS + lex.ALL_STOPWORDS)}, t))"


@query(f"""WITH p AS (SELECT item_id, {_PLAIN} AS p FROM benchmark), c AS (SELECT item_id, p, list_filter(p, lambda t: NOT list_contains({s.strings(lex.INTENT_WORDS)}, t)) AS c FROM p)
SELECT item_id, array_to_string((CASE WHEN len(c) > 0 THEN c ELSE p END)[1:5], ' ') AS core FROM c""")
def t07_core_topics(spark, d):
    return table(spark, d, "benchmark").select("item_id", nlu.core_topic("text").alias("core"))


@query("SELECT doc_id, len(regexp_extract_all(text, '[\\pL\\pN_]+')) AS n_words FROM documents WHERE text IS NOT NULL")
def t08_word_counts(spark, d):
    return documents(spark, d).select("doc_id", tx.word_count("text").cast("long").alias("n_words"))


# --- chunks and imports -----------------------------------------------------------------------------


_SPLIT = f"string_split(regexp_replace(text, {s.q('([.!?])' + tx.WS + '+')}, '\\1' || chr(1), 'g'), chr(1))"
_STOP = lambda start, least: f"coalesce((list_filter(range(greatest({least}, {start} + 1), n), lambda j: ps[j + 2] - ps[{start} + 1] > 300))[1], n)"
_CHUNKS_OF = lambda source: f"""e AS (SELECT doc_id, unnest({_SPLIT}) AS sent, generate_subscripts({_SPLIT}, 1) AS pos FROM {source} WHERE text IS NOT NULL), z AS (SELECT *, len({s.words("sent")}) AS size FROM e),
q AS (SELECT *, sum(size) OVER (PARTITION BY doc_id ORDER BY pos) AS upto FROM z), d AS (SELECT doc_id, count(*) AS n, list(sent ORDER BY pos) AS sents, list_prepend(0, list(CAST(upto AS BIGINT) ORDER BY pos)) AS ps FROM q GROUP BY doc_id),
r(doc_id, piece, start, stop) AS (SELECT doc_id, 0, CAST(0 AS BIGINT), CAST({_STOP("0", "0")} AS BIGINT) FROM d UNION ALL
SELECT doc_id, piece + 1, again, CAST({_STOP("again", "stop + 1")} AS BIGINT) FROM (SELECT r.doc_id, piece, stop, n, ps, (list_filter(range(start, stop), lambda k: k = stop - 1 OR ps[stop + 1] - ps[k + 1] <= 50))[1] AS again FROM r JOIN d USING (doc_id) WHERE stop < n)),
chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY piece) - 1 AS chunk, {s.strip("array_to_string(sents[start + 1:stop], ' ')")} AS text FROM r JOIN d USING (doc_id) WHERE ps[stop + 1] - ps[start + 1] > 10)"""  # noqa: E731
_CHUNKS = _CHUNKS_OF("documents")


@query(f"WITH RECURSIVE {_CHUNKS} SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, text FROM chunks")
def h01_chunks(spark, d):
    return chunking.chunks(documents(spark, d), ["doc_id"])


_BODIES = SQL["c14_pages_without_headers"].replace("WITH o AS", "o AS", 1)
_BODIES = _BODIES[: _BODIES.rindex("SELECT doc_id, page, CASE")] .rstrip() + ", bodies AS (" + _BODIES[_BODIES.rindex("SELECT doc_id, page, CASE") :] + "), keyed AS (SELECT doc_id || ':' || page || ':' || md5(text) AS doc_id, doc_id AS d, page, text FROM bodies)"
_PAGES_CLEAN = _whole(True, "keyed").removeprefix("WITH ") + ", sheets AS (SELECT doc_id, cleaned AS text FROM whole)"


@query(f"WITH RECURSIVE {_BODIES}, {_PAGES_CLEAN}, {_CHUNKS_OF('sheets')} SELECT k.d AS doc_id, k.page, CAST(chunk AS INTEGER) AS chunk, c.text FROM chunks c JOIN keyed k USING (doc_id)")
def h02_paged_chunks(spark, d):
    return chunking.paged_chunks(table(spark, d, "scan_pages").where("text is not null"))


@query("SELECT doc_id, sha256(text) AS file_hash FROM documents WHERE text IS NOT NULL")
def h04_hashes(spark, d):
    return documents(spark, d).select("doc_id", F.sha2("text", 256).alias("file_hash"))


@query("SELECT DISTINCT file_hash FROM imports a WHERE registered_at >= TIMESTAMP '2024-01-02' AND file_hash NOT IN (SELECT file_hash FROM imports WHERE registered_at < TIMESTAMP '2024-01-02')")
def h05_unseen(spark, d):
    rows, split = table(spark, d, "imports"), F.lit("2024-01-02").cast("timestamp")
    return chunking.unseen(rows.where(F.col("registered_at") >= split), rows.where(F.col("registered_at") < split)).select("file_hash")


# --- index and retrieval -----------------------------------------------------------------------------

_TF = f"""p AS (SELECT pid, domain, source, title, text, page FROM passages), tf AS (SELECT pid, term, count(*) AS tf FROM (SELECT pid, unnest({s.content(s.tokens("text"))}) AS term FROM p) GROUP BY pid, term)"""
_IDX = f"""{_TF}, dl AS (SELECT p.pid, coalesce(sum(tf), 0) AS dl FROM p LEFT JOIN tf USING (pid) GROUP BY p.pid), sz AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
idf AS (SELECT term, df, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM df, sz), post AS (SELECT tf.term, tf.pid, tf, dl, round(idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)), 6) AS w FROM tf JOIN dl USING (pid) JOIN idf USING (term), sz)"""


def built(spark: SparkSession, d: str, tier: str | None = None) -> index.Index:
    """The index of the passages, built once for the same files and loaded from then on."""
    stored = table(spark, d, "passages")
    return index.cached(spread(stored), f"{shared_dir(spark)}/lectern/index", tier, of=stored)


@query("SELECT pid, source FROM passages ORDER BY source NULLS LAST, pid LIMIT 600")
def i01_capped_passages(spark, d):
    return index.capped_passages(table(spark, d, "passages"), 600).select("pid", "source")


@query(f"WITH {_TF} SELECT pid, term, tf FROM tf")
def i02_term_frequencies(spark, d):
    return index.term_frequencies(table(spark, d, "passages"))


@query(f"WITH {_TF} SELECT term, count(*) AS df FROM tf GROUP BY term")
def i03_document_frequencies(spark, d):
    return index.document_frequencies(index.term_frequencies(table(spark, d, "passages")))


@query(f"WITH {_IDX} SELECT pid, CAST(dl AS BIGINT) AS dl FROM dl")
def i04_lengths(spark, d):
    p = table(spark, d, "passages")
    return index.lengths(p, index.term_frequencies(p))


@query(f"WITH {_IDX} SELECT term, df, round(idf, 9) AS idf FROM idf")
def i05_idf(spark, d):
    return built(spark, d).idf.withColumn("idf", F.round("idf", 9))


@query(f"WITH {_IDX} SELECT term, pid, tf, CAST(dl AS BIGINT) AS dl, w FROM post")
def i06_postings(spark, d):
    return built(spark, d).postings


@query(f"WITH {_IDX}, r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY w DESC, pid) AS rn FROM post) SELECT term, pid, w FROM r WHERE rn <= 40")
def i07_capped_postings(spark, d):
    return index.capped_postings(built(spark, d).postings, 40).select("term", "pid", "w")


@query("SELECT domain, count(*) AS n_passages FROM passages GROUP BY domain")
def i08_domains(spark, d):
    return table(spark, d, "passages").groupBy("domain").agg(F.count("*").alias("n_passages"))


@query(f"WITH {_IDX} SELECT (SELECT count(*) FROM p) AS passages, (SELECT count(DISTINCT domain) FROM p) AS domains, (SELECT count(*) FROM idf) AS terms")
def i09_stats(spark, d):
    return index.stats(built(spark, d))


@query(f"WITH {_IDX.replace('FROM passages)', 'FROM passages ORDER BY source NULLS LAST, pid LIMIT 600)')}, r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY w DESC, pid) AS rn FROM post) SELECT term, pid, tf, CAST(dl AS BIGINT) AS dl, w FROM r WHERE rn <= 40")
def i10_tier_build(spark, d):
    return built(spark, d, "low").postings


_RAW = f"{_IDX}, {_TERMS}, raw AS (SELECT qid, pid, round(sum(w * n), 6) AS raw FROM terms JOIN post USING (term) GROUP BY qid, pid)"
_HITS = f"""{_RAW}, rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY raw DESC, pid) AS rank, max(raw) OVER (PARTITION BY qid) AS best FROM raw), hits AS (SELECT qid, CAST(rank AS INTEGER) AS rank, pid, domain, source, title, text, page, round(CASE WHEN best > 0 THEN raw / best ELSE 0 END, 4) AS score, round(raw, 4) AS raw_score FROM rk JOIN p USING (pid) WHERE rank <= 10)"""


def found(spark: SparkSession, d: str, top_k: int = 10):
    idx = built(spark, d)
    terms = materialize(retrieval.query_terms(benchmark(spark, d), synonyms(spark)), "queryterms")
    return idx, terms, materialize(retrieval.search(terms, idx, top_k), "hits")


@query(f"WITH {_RAW} SELECT qid, pid, raw FROM raw")
def q01_scores(spark, d):
    return retrieval.scores(retrieval.query_terms(benchmark(spark, d), synonyms(spark)), built(spark, d))


@query(f"WITH {_HITS} SELECT * FROM hits")
def q02_search(spark, d):
    return found(spark, d)[2]


@query(f"""WITH {_HITS}, f AS (SELECT qid, domain, unnest(list_distinct({s.content(s.tokens("text"))})) AS term FROM hits), n AS (SELECT f.* FROM f WHERE NOT EXISTS (SELECT 1 FROM terms t WHERE t.qid = f.qid AND t.term = f.term)),
w AS (SELECT qid, term, round(sum(idf), 6) AS weight, coalesce(array_to_string(list_sort(list_distinct(list(domain))), ','), '') AS domains FROM n JOIN idf USING (term) GROUP BY qid, term), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY weight DESC, term) AS rank FROM w)
SELECT qid, CAST(rank AS INTEGER) AS rank, term, weight, domains FROM r WHERE rank <= 8""")
def q03_related(spark, d):
    idx, terms, hits = found(spark, d)
    return retrieval.related(terms, hits, idx)


@query(f"""WITH {_IDX}, {_TERMS}, pd AS (SELECT pid, domain FROM p WHERE domain IS NOT NULL), sizes AS (SELECT domain, count(*) AS size FROM pd GROUP BY domain),
per AS (SELECT qid, domain, round(sum(w * n) / any_value(size), 6) AS score, sum(n) AS hits FROM terms JOIN post USING (term) JOIN pd USING (pid) JOIN sizes USING (domain) GROUP BY qid, domain),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, domain) AS rank, max(score) OVER (PARTITION BY qid) AS best FROM per), asked AS (SELECT qid, sum(n) AS n_terms FROM terms GROUP BY qid),
rest AS (SELECT qid, string_agg(domain, ',' ORDER BY rank) AS alternatives, round(1 - max(score / best), 4) AS margin FROM r WHERE rank BETWEEN 2 AND 4 GROUP BY qid)
SELECT r.qid, r.domain, CAST(1 AS DOUBLE) AS confidence, coalesce(alternatives, '') AS alternatives, hits / n_terms < 0.08 AS is_new, coalesce(margin, 1.0) AS margin FROM r JOIN asked USING (qid) LEFT JOIN rest USING (qid) WHERE rank = 1""")
def q04_domains(spark, d):
    return retrieval.classify_domains(retrieval.query_terms(benchmark(spark, d), synonyms(spark)), built(spark, d))


_BARE = "length(regexp_replace(w, '[^\\pL\\pN_]', '', 'g'))"
_PROSE = f"""ws AS (SELECT *, {s.words("coalesce(text, '')")} AS ws FROM hits), wn AS (SELECT *, greatest(len(ws), 1) AS wn, length(text) - length(replace(text, ',', '')) AS commas, len(list_filter(regexp_extract_all(text, '[\\pL\\pN_]+'), lambda w: list_contains({s.strings(lex.FIGURE_LABELS)}, upper(w)))) AS figs FROM ws),
pq AS (SELECT *, round(CASE WHEN len(ws) < 5 THEN 0 WHEN len(list_filter(ws, lambda w: regexp_full_match(w, '[\\d,.\\-]+'))) / wn > 0.20 THEN 0 WHEN commas / wn > 0.30 THEN 0.03 ELSE greatest(0, least(1, len(list_filter(ws, lambda w: {_BARE} >= 5)) / wn - len(list_filter(ws, lambda w: {_BARE} <= 2)) / wn * 0.4 - least(figs / wn * 4, 0.35))) END, 6) AS quality FROM wn),
ok AS (SELECT qid, pid, score, coalesce(source, '') AS src, list_distinct({s.tokens("coalesce(text, '')")}) AS tk, row_number() OVER (PARTITION BY qid ORDER BY round(score * greatest(quality, 0.05), 6) DESC, pid) AS place FROM pq),
s1 AS (SELECT * FROM ok WHERE score >= 0.06 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY place) = 1),
s2 AS (SELECT ok.qid, ok.pid FROM ok JOIN s1 ON s1.qid = ok.qid AND ok.place > s1.place AND ok.score >= 0.32 AND ok.src <> s1.src
AND (CASE WHEN len(ok.tk) > 0 AND len(s1.tk) > 0 THEN len(list_intersect(ok.tk, s1.tk)) / (len(ok.tk) + len(s1.tk) - len(list_intersect(ok.tk, s1.tk))) ELSE 0 END) <= 0.55 QUALIFY row_number() OVER (PARTITION BY ok.qid ORDER BY ok.place) = 1)"""


@query(f"WITH {_HITS}, {_PROSE} SELECT qid, CAST(1 AS INTEGER) AS section, pid FROM s1 UNION ALL SELECT qid, CAST(2 AS INTEGER), pid FROM s2")
def q05_sections(spark, d):
    return retrieval.sections(found(spark, d)[2], quality.prose_quality("text"))


_NORM = lambda x: f"array_to_string({s.tokens(x)}, ' ')"
_ANY = lambda x, ps: f"len(list_filter({s.strings(ps)}, lambda m: contains({x}, m))) > 0"
_PHRASES = [p for _, ps in lex.REWRITES for p in ps]
_QUESTION = lambda x: f"(contains({x}, '?') OR contains({x}, '¿') OR coalesce(list_contains({s.strings(lex.QUESTION_STARTS)}, ({s.tokens(x)})[1]), FALSE) OR {_ANY(_NORM(x), _PHRASES)})"


@query(f"""WITH {_HITS}, q AS (SELECT item_id AS qid, len(list_filter({s.tokens("text")}, lambda t: length(t) > 2 AND NOT list_contains({s.strings(lex.ALL_STOPWORDS + lex.QUESTION_STARTS)}, t))) AS c, {_QUESTION("text")} AS framed FROM benchmark),
t AS (SELECT *, max(raw_score) OVER (PARTITION BY qid) AS top FROM hits), n AS (SELECT qid, max(top) AS top, count(DISTINCT CASE WHEN top > 0 AND raw_score / top >= 0.78 THEN coalesce(domain, '') END) AS domains FROM t GROUP BY qid)
SELECT q.qid, CASE WHEN top IS NULL THEN 'empty' WHEN framed AND c >= 1 THEN 'ok' WHEN c > 1 OR top <= 0 THEN 'ok' WHEN domains >= 2 THEN 'ambiguous' ELSE 'ok' END AS outcome FROM q LEFT JOIN n USING (qid)""")
def q06_assess(spark, d):
    return retrieval.assess(benchmark(spark, d), found(spark, d)[2])


@query(f"""WITH {_HITS}, f AS (SELECT qid, domain, min(rank) AS rank FROM hits WHERE domain IS NOT NULL GROUP BY qid, domain), o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS option FROM f),
pl AS (SELECT item_id AS qid, {_PLAIN} AS pl FROM benchmark), co AS (SELECT qid, pl, list_filter(pl, lambda t: NOT list_contains({s.strings(lex.INTENT_WORDS)}, t)) AS co FROM pl)
SELECT qid, CAST(option AS INTEGER) AS option, domain, trim(array_to_string((CASE WHEN len(co) > 0 THEN co ELSE pl END)[1:5], ' ') || ' ' || domain) AS refined FROM o JOIN co USING (qid) WHERE option <= 4""")
def q07_clarify(spark, d):
    return retrieval.clarify(benchmark(spark, d), found(spark, d)[2])


@query(f"""WITH {_HITS} SELECT qid, string_agg('[' || rank || '] ' || coalesce(source, '') || coalesce(', p. ' || page, '') || ': ' || left(coalesce(text, ''), 600), chr(10) ORDER BY rank) AS context FROM hits WHERE rank <= 5 AND score >= 0.05 GROUP BY qid""")
def q08_context(spark, d):
    return retrieval.context_blocks(found(spark, d)[2])


@query("""WITH o AS (SELECT conv_id, turn, min(role) AS role, min(text) AS text FROM conversations GROUP BY conv_id, turn), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM o)
SELECT conv_id, string_agg(coalesce(role, '') || ': ' || left(coalesce(text, ''), 120), chr(10) ORDER BY turn) AS history FROM r WHERE age <= 4 GROUP BY conv_id""")
def q09_history(spark, d):
    return logs.history_blocks(table(spark, d, "conversations"))


@query(f"""WITH {_HITS} SELECT qid, string_agg(coalesce(source, '') || coalesce(', página ' || page, '') || ' (' || printf('%.2f', CAST(round(CAST(score AS DECIMAL(6, 4)), 2) AS DOUBLE)) || ')', '; ' ORDER BY rank) AS sources FROM hits WHERE rank <= 5 GROUP BY qid""")
def q10_sources(spark, d):
    return retrieval.source_lists(found(spark, d)[2])


@query(f"WITH {_HITS} SELECT qid, rank, CASE WHEN score >= 0.25 THEN 'high' WHEN score >= 0.12 THEN 'medium' ELSE 'low' END AS label, CASE WHEN score >= 0.5 THEN 'high' WHEN score >= 0.2 THEN 'medium' ELSE 'low' END AS strict_label FROM hits")
def q11_confidence(spark, d):
    return found(spark, d)[2].select("qid", "rank", retrieval.confidence_label(F.col("score")).alias("label"), retrieval.confidence_label(F.col("score"), 0.5, 0.2).alias("strict_label"))


_OUTCOME = f"""qa AS (SELECT item_id AS qid, len(list_filter({s.tokens("text")}, lambda t: length(t) > 2 AND NOT list_contains({s.strings(lex.ALL_STOPWORDS + lex.QUESTION_STARTS)}, t))) AS c, {_QUESTION("text")} AS framed FROM benchmark),
ta AS (SELECT *, max(raw_score) OVER (PARTITION BY qid) AS top FROM hits), na AS (SELECT qid, max(top) AS top, count(DISTINCT CASE WHEN top > 0 AND raw_score / top >= 0.78 THEN coalesce(domain, '') END) AS domains FROM ta GROUP BY qid),
oa AS (SELECT qa.qid, CASE WHEN top IS NULL THEN 'empty' WHEN framed AND c >= 1 THEN 'ok' WHEN c > 1 OR top <= 0 THEN 'ok' WHEN domains >= 2 THEN 'ambiguous' ELSE 'ok' END AS outcome FROM qa LEFT JOIN na USING (qid))"""


@query(f"""WITH {_HITS.replace("rank <= 10)", "rank <= 5)")}, {_PROSE}, {_OUTCOME}, ch AS (SELECT qid, 1 AS section, pid FROM s1 UNION ALL SELECT qid, 2, pid FROM s2), bo AS (SELECT ch.qid, string_agg(text, chr(10) || chr(10) ORDER BY section) AS body FROM ch JOIN hits ON hits.qid = ch.qid AND hits.pid = ch.pid GROUP BY ch.qid),
so AS (SELECT qid, string_agg(coalesce(source, '') || coalesce(', página ' || page, '') || ' (' || printf('%.2f', CAST(round(CAST(score AS DECIMAL(6, 4)), 2) AS DOUBLE)) || ')', '; ' ORDER BY rank) AS sources FROM hits GROUP BY qid), be AS (SELECT qid, domain, score FROM hits WHERE rank = 1)
SELECT oa.qid, outcome, domain, coalesce(score, 0) AS score, CASE WHEN coalesce(score, 0) >= 0.25 THEN 'high' WHEN coalesce(score, 0) >= 0.12 THEN 'medium' ELSE 'low' END AS label, CASE WHEN outcome = 'ok' THEN concat_ws(chr(10), body, '[' || sources || ']') END AS reply FROM oa LEFT JOIN be USING (qid) LEFT JOIN bo USING (qid) LEFT JOIN so USING (qid)""")
def a01_answers(spark, d):
    return retrieval.answered(benchmark(spark, d), built(spark, d), synonyms(spark))


_PREV = "pr AS (SELECT qid, pid, round(sum(w * n), 6) AS raw FROM (SELECT qid, term, count(*) AS n FROM (SELECT qid, unnest(base) AS term FROM own) GROUP BY qid, term) JOIN post USING (term) GROUP BY qid, pid), pk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY raw DESC, pid) AS rank, max(raw) OVER (PARTITION BY qid) AS best FROM pr)"


@query(f"""WITH {_HITS}, {_PREV}, pv AS (SELECT qid, round(raw / best, 4) AS score, round(raw, 4) AS raw_score FROM pk WHERE rank = 5), ag AS (SELECT qid, max(raw_score) AS best, max(score) AS support FROM hits GROUP BY qid)
SELECT qid, CASE WHEN ag.best > 1.15 * pv.raw_score THEN 'correct' WHEN pv.score >= 0.18 AND support >= 0.12 THEN 'defend' ELSE 'concede' END AS stance FROM pv LEFT JOIN ag USING (qid)""")
def a04_debate(spark, d):
    """The answer under attack is the fifth hit of a search for the question's own terms; the search again knows synonyms."""
    idx, _, hits = found(spark, d)
    before = retrieval.search(retrieval.query_terms(benchmark(spark, d)), idx, 5)
    return retrieval.debate(before.where("rank = 5").select("qid", "score", "raw_score"), hits)


# --- quality ----------------------------------------------------------------------------------------

_QUAL = f"""WITH t AS (SELECT doc_id, text, {s.words("text")} AS ws FROM documents WHERE text IS NOT NULL),
u AS (SELECT *, greatest(len(ws), 1) AS n, len(list_filter(ws, lambda w: {_BARE} >= 5)) AS lng, len(list_filter(ws, lambda w: {_BARE} <= 2)) AS sht, length(text) - length(replace(text, ',', '')) AS commas,
len(list_filter(regexp_extract_all(text, '[\\pL\\pN_]+'), lambda w: list_contains({s.strings(lex.FIGURE_LABELS)}, upper(w)))) AS figs, length(regexp_replace(text, '[^\\pL]', '', 'g')) AS letters FROM t)"""


@query(_QUAL + """ SELECT doc_id, round(CASE WHEN len(ws) < 5 THEN 0 WHEN len(list_filter(ws, lambda w: regexp_full_match(w, '[\\d,.\\-]+'))) / n > 0.20 THEN 0 WHEN commas / n > 0.30 THEN 0.03 ELSE greatest(0, least(1, lng / n - sht / n * 0.4 - least(figs / n * 4, 0.35))) END, 6) AS quality FROM u""")
def pq01_prose_quality(spark, d):
    return documents(spark, d).select("doc_id", quality.prose_quality("text").alias("quality"))


@query(_QUAL + """ SELECT doc_id, round(CASE WHEN len(ws) < 5 THEN 0 WHEN len(list_filter(ws, lambda w: regexp_full_match(w, '[\\d,.\\-/]+'))) / n > 0.20 OR letters / greatest(length(text), 1) < 0.35 THEN 0.02 WHEN commas / n > 0.30 THEN 0.03 ELSE greatest(0, least(1, lng / n - sht / n * 0.4 - figs / n * 3)) END, 6) AS quality FROM u""")
def pq02_tool_quality(spark, d):
    return documents(spark, d).select("doc_id", quality.prose_quality("text", tool=True).alias("quality"))


def _sents(spark, d):
    return documents(spark, d).select("doc_id", F.posexplode(tx.sentences("text")).alias("pos", "sentence"))


_SENT = f"WITH x AS (SELECT doc_id, string_split(regexp_replace(text, {s.q('([.!?])' + tx.WS + '+')}, '\\1' || chr(1), 'g'), chr(1)) AS ss FROM documents WHERE text IS NOT NULL), y AS (SELECT doc_id, unnest(ss) AS sentence, generate_subscripts(ss, 1) - 1 AS pos FROM x), z AS (SELECT *, {s.words('sentence')} AS ws FROM y)"


@query(_SENT + f" SELECT doc_id, CAST(pos AS INTEGER) AS pos, round(CASE WHEN len(ws) = 0 THEN 0 ELSE len(list_filter(ws, lambda w: {_BARE} >= 5)) / len(ws) END, 6) AS quality FROM z")
def pq03_sentence_quality(spark, d):
    return _sents(spark, d).select("doc_id", "pos", F.round(quality.sentence_quality("sentence"), 6).alias("quality"))


def _bad(least: int, pattern: str, floor: float, extra: str = "FALSE") -> str:
    w = tx.WS
    return f"""{_SENT}, b AS (SELECT *, greatest(len(ws), 1) AS n FROM z) SELECT doc_id, CAST(pos AS INTEGER) AS pos, (len(ws) < {least} OR regexp_matches(sentence, {s.q("(?i)" + pattern)}) OR regexp_matches(sentence, {s.q(rf"^{w}*(?:II|III|IV|VI|VII|VIII|IX|XI|XII)(?:[^\pL\pN_]|$)")})
OR regexp_matches(sentence, {s.q(rf"^{w}*\d+[.)]{w}")}) OR regexp_matches(sentence, {s.q(rf"\.{w}+\d+[.)]")}) OR len(list_filter(ws, lambda w: regexp_matches(w, '\\d'))) / n > 0.30 OR (len(ws) >= 7 AND len(list_filter(ws, lambda w: regexp_matches(w, '^\\p{{Lu}}'))) / n > 0.45)
OR (CASE WHEN len(ws) = 0 THEN 0 ELSE len(list_filter(ws, lambda w: {_BARE} >= 5)) / n END) < {floor} OR {extra}) AS bad FROM b"""


@query(_bad(5, lex.INSTRUMENTS, 0.30))
def pq04_bad_sentences(spark, d):
    return _sents(spark, d).select("doc_id", "pos", quality.bad_sentence("sentence").alias("bad"))


@query(_bad(4, lex.INSTRUMENTS_TOOL, 0.28, f"regexp_matches(sentence, {s.q(rf'(?i)^(?:DR\.|DRA\.|DR{tx.WS}|DRA{tx.WS}|PROF\.|LIC\.|ING\.){tx.WS}+[A-Z]')})"))
def pq05_bad_sentences_tool(spark, d):
    return _sents(spark, d).select("doc_id", "pos", quality.bad_sentence("sentence", tool=True).alias("bad"))


@query("SELECT source, CAST(sum(coalesce(len(regexp_extract_all(text, '[\\pL\\pN_]+')), 0)) AS BIGINT) AS n_words, CASE WHEN sum(coalesce(len(regexp_extract_all(text, '[\\pL\\pN_]+')), 0)) = 0 THEN 'empty' WHEN sum(len(regexp_extract_all(text, '[\\pL\\pN_]+'))) < 80 THEN 'thin' ELSE 'ok' END AS state FROM passages GROUP BY source")
def pq06_thin_files(spark, d):
    return quality.thin_files(table(spark, d, "passages"))


@query(f"WITH l AS ({_lines()}) SELECT doc_id, count(*) AS n_rows FROM l WHERE len({_CELLS}) >= 3 AND NOT starts_with(trim(line), '#') GROUP BY doc_id")
def pq07_table_rows(spark, d):
    return documents(spark, d).select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(quality.is_table_row("line")).groupBy("doc_id").agg(F.count("*").alias("n_rows"))


# --- classification and understanding -----------------------------------------------------------------

_KW = f"""k AS (SELECT DISTINCT doc_id, lower(text) AS low, array_to_string({s.tokens("text")}, chr(10)) AS joined FROM documents WHERE text IS NOT NULL), sc AS (SELECT doc_id, domain, count(*) AS score FROM k, subject_areas WHERE contains(low, keyword) OR contains(joined, keyword) GROUP BY doc_id, domain)"""


def _scores(spark, d):
    return nlu.keyword_scores(spread(table(spark, d, "documents")), table(spark, d, "subject_areas"))


@query(f"WITH {_KW} SELECT * FROM sc")
def n01_keyword_scores(spark, d):
    return _scores(spark, d)


_BEST = f"{_KW}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, domain) AS rank FROM sc)"


@query(f"WITH {_BEST} SELECT d.doc_id, CASE WHEN r.score >= 2 THEN r.domain ELSE 'general' END AS domain FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND rank = 1")
def n02_best_domains(spark, d):
    return nlu.best_domains(_scores(spark, d), table(spark, d, "documents"))


_IMPORTED = f"""{_CLEAN}, {_BEST}, fi AS (SELECT d.doc_id, text, sha256(coalesce(text, '')) AS file_hash, filename FROM documents d LEFT JOIN (SELECT doc_id, min(filename) AS filename FROM imports GROUP BY doc_id) USING (doc_id)),
fs AS (SELECT file_hash, min(doc_id) AS first FROM fi GROUP BY file_hash), im AS (SELECT fi.doc_id, file_hash, filename, CAST(coalesce(length(cleaned), 0) AS INTEGER) AS text_length, first,
file_hash IN (SELECT file_hash FROM imports WHERE registered_at < TIMESTAMP '2024-01-02' AND file_hash IS NOT NULL) AS known, CASE WHEN r.score >= 2 THEN r.domain ELSE 'general' END AS dom FROM fi JOIN fs USING (file_hash) LEFT JOIN whole USING (doc_id) LEFT JOIN r ON r.doc_id = fi.doc_id AND rank = 1),
imported AS (SELECT doc_id, file_hash, filename, text_length, dom, CASE WHEN known OR doc_id <> first THEN 'duplicate' WHEN text_length < 50 THEN 'empty_or_unreadable' ELSE 'imported' END AS status FROM im)"""


@query(f"{_IMPORTED} SELECT doc_id, file_hash, filename, status, CASE WHEN status = 'imported' THEN dom END AS domain, text_length FROM imported")
def h03_imported(spark, d):
    docs = table(spark, d, "documents")
    files = docs.join(table(spark, d, "imports").groupBy("doc_id").agg(F.min("filename").alias("filename")), "doc_id", "left").select("doc_id", "filename", "text")
    scores = nlu.keyword_scores(docs.where("text is not null"), table(spark, d, "subject_areas"))
    return chunking.imported(files, table(spark, d, "imports").where("registered_at < timestamp'2024-01-02'"), nlu.best_domains(scores, docs))


@query(f"""WITH {_BEST}, nm AS (SELECT doc_id, regexp_replace(lower(strip_accents(regexp_replace(filename, '\\.[A-Za-z0-9]+$', ''))), '[^a-z0-9]+', '_', 'g') AS a FROM imports), nn AS (SELECT doc_id, min(regexp_replace(left(regexp_replace(a, '^_+|_+$', '', 'g'), 50), '_+$', '')) AS named FROM nm GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN r.score >= 2 THEN r.domain WHEN coalesce(named, '') IN ('', 'general', 'untitled', 'documento', 'document') THEN 'general' ELSE named END AS domain FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id AND rank = 1 LEFT JOIN nn ON nn.doc_id = d.doc_id""")
def n03_domains_or_new(spark, d):
    return nlu.domains_or_new(nlu.best_domains(_scores(spark, d), table(spark, d, "documents")), table(spark, d, "imports"))


@query(f"WITH {_BEST} SELECT d.doc_id, CAST(coalesce(rank, 1) AS INTEGER) AS rank, coalesce(domain_, 'general') AS domain, coalesce(score, 0) AS score FROM documents d LEFT JOIN (SELECT doc_id, rank, domain AS domain_, score FROM r WHERE rank <= 3) r ON r.doc_id = d.doc_id")
def n04_suggestions(spark, d):
    return nlu.suggestions(_scores(spark, d), table(spark, d, "documents"))


_ES, _EN = (s.strings(lex.STOPWORDS[c].split()) for c in ("es", "en"))
_LANG = lambda src: f"l AS (SELECT *, len(list_intersect(tk, list_distinct({_ES}))) AS score_es, len(list_intersect(tk, list_distinct({_EN}))) AS score_en FROM ({src}))"


@query(f"WITH {_LANG(f'SELECT doc_id, list_distinct({s.tokens(chr(116) + chr(101) + chr(120) + chr(116))}) AS tk FROM documents WHERE text IS NOT NULL')} SELECT doc_id, CAST(score_es AS INTEGER) AS score_es, CAST(score_en AS INTEGER) AS score_en, CASE WHEN score_en > score_es THEN 'en' ELSE 'es' END AS lang FROM l")
def n06_languages(spark, d):
    return documents(spark, d).select("doc_id", *nlu.language("text"))


@query(f"""WITH RECURSIVE o AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY conv_id, turn), {_LANG(f'SELECT conv_id, turn, list_distinct({s.tokens("coalesce(text, chr(32))")}) AS tk FROM o')},
k AS (SELECT conv_id, turn, score_es, score_en, CASE WHEN score_en > score_es THEN 'en' ELSE 'es' END AS own, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM l),
r(conv_id, turn, rn, resolved, last) AS (SELECT conv_id, turn, rn, own, [own] FROM k WHERE rn = 1 UNION ALL
SELECT conv_id, turn, rn, pick, list_append(last, pick)[-6:] FROM (SELECT k.conv_id, k.turn, k.rn, last, CASE WHEN score_es + score_en >= 2 AND abs(score_es - score_en) >= 2 THEN own WHEN 2 * len(list_filter(last, lambda x: x = 'en')) > len(last) THEN 'en' WHEN 2 * len(list_filter(last, lambda x: x = 'en')) < len(last) THEN 'es' ELSE last[-1] END AS pick
FROM r JOIN k ON k.conv_id = r.conv_id AND k.rn = r.rn + 1)) SELECT conv_id, turn, resolved FROM r""")
def n07_resolved_languages(spark, d):
    return nlu.resolved_languages(table(spark, d, "conversations"))


def _examples(spark, d):
    return table(spark, d, "subject_areas").select(F.col("domain").alias("intent"), "lang", F.col("keyword").alias("example"))


@query(f"""WITH ex AS (SELECT domain AS intent, lang AS l, row_number() OVER () AS e, list_distinct({s.tokens("keyword")}) AS et FROM subject_areas), tx AS (SELECT usage_id AS id, lang AS l, list_distinct({s.tokens("text")}) AS tt FROM usage_log WHERE text IS NOT NULL),
pr AS (SELECT id, e, intent, round(len(list_intersect(tt, et)) / (len(tt) + len(et) - len(list_intersect(tt, et))), 6) AS score FROM tx JOIN ex USING (l) WHERE len(list_intersect(tt, et)) > 0), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, intent) AS rn FROM pr)
SELECT i.id, CASE WHEN b.score >= 0.2 THEN b.intent END AS intent, coalesce(b.score, 0) AS score FROM (SELECT DISTINCT id FROM tx) i LEFT JOIN b ON b.id = i.id AND rn = 1""")
def n08_intents(spark, d):
    texts = logs.distinct_usage(table(spark, d, "usage_log").where("text is not null"))
    return nlu.intents(texts, _examples(spark, d), id_col="usage_id")


@query(f"""WITH w AS (SELECT DISTINCT lang, unnest({s.tokens("text")}) AS term FROM usage_log WHERE lang IN ('es', 'en') AND text IS NOT NULL) SELECT lang, term FROM w WHERE NOT (lang = 'es' AND list_contains({_ES}, term)) AND NOT (lang = 'en' AND list_contains({_EN}, term))""")
def n09_learned_words(spark, d):
    return nlu.learned_words(table(spark, d, "usage_log"))


_ONCE = "once AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY usage_id ORDER BY logged_at, coalesce(text, '')) AS rn FROM usage_log) WHERE rn = 1)"


@query(f"WITH {_ONCE} SELECT usage_id, CAST((row_number() OVER (PARTITION BY intent, lang ORDER BY ts, usage_id) - 1) % 3 AS INTEGER) AS response FROM once")
def n10_rotation(spark, d):
    return nlu.rotation(logs.distinct_usage(table(spark, d, "usage_log"))).select("usage_id", "response")


_TYPE = " ".join(f"WHEN {_ANY(_NORM('text'), ps)} THEN {s.q(label)}" for label, ps in lex.REWRITES)


@query(f"SELECT item_id, {_QUESTION('text')} AS question, {_ANY(_NORM('text'), lex.CHALLENGE)} AS challenge, {_ANY(_NORM('text'), lex.EXPLAIN)} AS explain, CASE {_TYPE} END AS kind FROM benchmark")
def n11_question_flags(spark, d):
    return table(spark, d, "benchmark").select("item_id", nlu.is_question("text").alias("question"), nlu.is_challenge("text").alias("challenge"), nlu.is_explain_request("text").alias("explain"), nlu.question_type("text").alias("kind"))


_CONT = lambda x: f"list_filter({s.tokens(x)}, lambda t: length(t) > 3 AND NOT list_contains({s.strings(lex.QUESTION_STARTS)}, t))"


@query(f"""WITH o AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY conv_id, turn), b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS first FROM o), c AS (SELECT *, coalesce(text, '') AS t FROM b)
SELECT conv_id, turn, ({_ANY(_NORM("t"), [m for m in lex.FOLLOWUP if " " in m])} OR list_has_any({s.tokens("t")}, {s.strings([m for m in lex.FOLLOWUP if " " not in m])}) OR len({_CONT("t")}) = 0 OR (NOT first AND len(list_filter({_CONT("t")}, lambda c: NOT list_contains({s.strings(lex.ACTION_VERBS)}, c))) = 0)) AS is_followup FROM c""")
def n12_followups(spark, d):
    return nlu.in_context(table(spark, d, "conversations")).select("conv_id", "turn", "is_followup")


_ACT = " ".join(f"WHEN {s.q(k)} THEN {s.strings(v)}" for k, v in lex.table(lex.ACTION_SYNONYMS).items())


@query(f"""WITH o AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY conv_id, turn), b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS first, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS before FROM o), c AS (SELECT *, coalesce(text, '') AS t FROM b),
f AS (SELECT *, ({_ANY(_NORM("t"), [m for m in lex.FOLLOWUP if " " in m])} OR list_has_any({s.tokens("t")}, {s.strings([m for m in lex.FOLLOWUP if " " not in m])}) OR len({_CONT("t")}) = 0 OR (NOT first AND len(list_filter({_CONT("t")}, lambda c: NOT list_contains({s.strings(lex.ACTION_VERBS)}, c))) = 0)) AS is_followup FROM c)
SELECT conv_id, turn, trim(CASE WHEN is_followup AND NOT first THEN array_to_string(list_concat(({_CONT("before")})[1:6], (flatten(list_transform({_CONT("t")}, lambda c: CASE c {_ACT} ELSE [] END)))[1:4]), ' ') || ' ' || t ELSE t END) AS query FROM f""")
def n13_in_context(spark, d):
    return nlu.in_context(table(spark, d, "conversations")).select("conv_id", "turn", "query")


_CODE = " + ".join(f"CAST(regexp_matches(text, {s.q(p)}) AS INTEGER)" for p in lex.CODE_PATTERNS)


@query(f"SELECT doc_id, ({_CODE}) >= 2 AND (contains(trim(text), chr(10)) OR length(text) > 60) AS code FROM documents WHERE text IS NOT NULL")
def n15_code_like(spark, d):
    return documents(spark, d).select("doc_id", nlu.looks_like_code("text").alias("code"))


@query()
def a14_code_notes(spark, d):
    return codes.analyzed(table(spark, d, "documents"), "doc_id", "text").select("id", "language", "ok", "n_lines", "n_blank", F.size("notes").alias("n_notes"))


_CODE_OF = lambda x: "(" + " + ".join(f"CAST(regexp_matches({x}, {s.q(p)}) AS INTEGER)" for p in lex.CODE_PATTERNS) + f") >= 2 AND (contains(trim({x}), chr(10)) OR length({x}) > 60)"


@query(f"""WITH told AS ({SQL["n08_intents"]}), {_ONCE}, j AS (SELECT usage_id, coalesce(text, '') AS t, told.intent AS told, coalesce(told.score, 0) AS told_score, coalesce(once.score, 0) AS known FROM once LEFT JOIN told ON told.id = usage_id)
SELECT usage_id, CASE WHEN {_ANY(_NORM("t"), lex.CHALLENGE)} THEN 'debate' WHEN {_ANY(_NORM("t"), lex.EXPLAIN)} THEN 'explain' WHEN ({_CODE_OF("t")}) OR contains(t, '```') THEN 'code' WHEN told IS NOT NULL AND told_score >= 0.5 THEN 'smalltalk'
WHEN known > 0 THEN 'knowledge' WHEN told IS NOT NULL AND len(regexp_split_to_array(trim(t), '\\s+')) <= 3 THEN 'smalltalk' ELSE 'unknown' END AS route FROM j""")
def a20_routes(spark, d):
    log = logs.distinct_usage(table(spark, d, "usage_log"))
    told = nlu.intents(log.where("text is not null"), _examples(spark, d), id_col="usage_id").withColumnsRenamed({"id": "usage_id", "intent": "told", "score": "told_score"})
    return log.join(told, "usage_id", "left").select("usage_id", nlu.route("text", F.col("told"), F.coalesce("told_score", F.lit(0.0)), F.coalesce("score", F.lit(0.0))).alias("route"))


# --- logs, files, windows -----------------------------------------------------------------------------


@query("""WITH o AS (SELECT conv_id, turn, min(role) AS role, min(text) AS text FROM conversations GROUP BY conv_id, turn), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS INTEGER) AS age FROM o) SELECT conv_id, turn, role, text, age FROM r WHERE age <= 10""")
def a08_session_memory(spark, d):
    return logs.last_turns(table(spark, d, "conversations"))


@query("SELECT conv_id, count(DISTINCT turn) AS n_turns, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def s20_sessions(spark, d):
    return logs.sessions(table(spark, d, "conversations"))


@query(f"""WITH {_ONCE}, b AS (SELECT CAST(floor((usage_id - 1) / 10) AS BIGINT) AS block, count(*) AS n, round(avg(CASE WHEN coalesce(mode, 'unknown') = 'unknown' THEN 1.0 ELSE 0.0 END), 6) AS unknown_rate, round(sum(CAST(round(latency_ms * 100) AS BIGINT)) / 100.0 / count(*), 6) AS avg_latency FROM once WHERE latency_ms >= 0 GROUP BY 1)
SELECT block, n, unknown_rate, avg_latency, CASE WHEN unknown_rate > 0.4 THEN 0.15 ELSE 0.2 END AS min_score, CAST(CASE WHEN avg_latency > 200 THEN 40 WHEN avg_latency < 50 THEN 70 ELSE 50 END AS INTEGER) AS history FROM b""")
def a09_tuned(spark, d):
    return logs.tuned(table(spark, d, "usage_log"))


@query(f"WITH {_ONCE} SELECT coalesce(mode, '') AS mode, count(*) AS n, count(DISTINCT session_id) AS n_sessions FROM once GROUP BY 1")
def a10_modes(spark, d):
    return logs.by_mode(table(spark, d, "usage_log"))


@query(f"WITH {_ONCE} SELECT usage_id, ts, text FROM once WHERE coalesce(score, 0) <= 0.06 ORDER BY ts DESC, usage_id DESC LIMIT 200")
def s19_gaps(spark, d):
    return logs.gaps(table(spark, d, "usage_log"))


@query(f"WITH {_ONCE} SELECT usage_id, logged_at, text FROM once ORDER BY logged_at DESC, usage_id DESC LIMIT 500")
def s18_usage_tail(spark, d):
    return logs.tail(logs.distinct_usage(table(spark, d, "usage_log")), 500, F.desc("logged_at"), F.desc("usage_id")).select("usage_id", "logged_at", "text")


_MACHINES = "SELECT 32 * c + r AS machine, c AS cores, r AS ram_gb FROM range(1, 17) c(c), range(0, 32) r(r)"


def _machines(spark):
    m = spark.range(32, 17 * 32).select(F.col("id").alias("machine"), F.floor(F.col("id") / 32).alias("cores"), (F.col("id") % 32).alias("ram_gb"))
    return m.withColumn("free_gb", F.col("ram_gb") / 4)


@query(f"SELECT machine, CASE WHEN ram_gb < 2 OR cores <= 2 THEN 'low' WHEN ram_gb < 8 OR cores <= 4 THEN 'medium' ELSE 'high' END AS tier FROM ({_MACHINES})")
def a11_tiers(spark, d):
    """Every size of machine up to 16 cores and 31 GB."""
    return _machines(spark).select("machine", logs.tier(F.col("cores"), F.col("ram_gb")).alias("tier"))


@query(f"""WITH {_ONCE}, m AS ({_MACHINES}), n AS (SELECT count(*) / 30000.0 AS need FROM passages), l AS (SELECT avg(latency_ms) AS latency FROM once WHERE latency_ms >= 0)
SELECT machine, x.p AS priority, x.n AS note FROM (SELECT machine, unnest(list_filter([{{'p': 1, 'n': CASE WHEN ram_gb / 4 < 0.5 THEN 'memory' END}}, {{'p': 2, 'n': CASE WHEN ram_gb < need THEN 'capacity' END}}, {{'p': 2, 'n': CASE WHEN latency > 80 THEN 'latency' END}},
{{'p': 3, 'n': CASE WHEN cores <= 2 THEN 'cores' END}}, {{'p': 4, 'n': CASE WHEN ram_gb >= need AND ram_gb < 1.5 * need THEN 'headroom' END}}], lambda e: e.n IS NOT NULL)) AS x FROM m, n, l)""")
def a11_advice(spark, d):
    return logs.advice(_machines(spark), table(spark, d, "passages").count(), table(spark, d, "usage_log"))


@query(f"""WITH {_ONCE}, la AS (SELECT * FROM once ORDER BY logged_at DESC, usage_id DESC LIMIT 50), u AS (SELECT round(avg(CASE WHEN coalesce(mode, 'unknown') = 'unknown' THEN 1.0 ELSE 0.0 END), 4) AS share, count(*) AS n FROM la),
g AS (SELECT ts, usage_id, text FROM once WHERE coalesce(score, 0) <= 0.06 AND text IS NOT NULL ORDER BY ts DESC, usage_id DESC LIMIT 3)
SELECT 'usage' AS kind, share, n, '' AS topics FROM u WHERE share > 0.1 UNION ALL SELECT 'knowledge', NULL, count(*), string_agg(text, '; ' ORDER BY ts, usage_id) FROM g HAVING count(*) > 0""")
def a10_suggestions(spark, d):
    """With a limit of 0.1 on the share of questions without an answer."""
    return logs.suggestions(table(spark, d, "usage_log"), unknown=0.1)


@query(f"WITH {_IDX} SELECT term, pid, tf, CAST(dl AS BIGINT) AS dl, w FROM post")
def w06_incremental(spark, d):
    """An index of the passages with a page, to which the others come."""
    rows = table(spark, d, "passages")
    return index.updated(index.build(rows.where("page is not null")), rows.where("page is null")).postings


@query(f"WITH {_IDX.replace('FROM passages)', 'FROM passages WHERE domain IS NOT NULL)')} SELECT term, pid, tf, CAST(dl AS BIGINT) AS dl, w FROM post")
def w06_removed(spark, d):
    """The index of all passages, from which those without a domain go."""
    return index.updated(built(spark, d), table(spark, d, "passages").limit(0), table(spark, d, "passages").where("domain is null").select("pid")).postings


_FILES = "SELECT CASE WHEN source IS NULL THEN CAST(doc_id AS VARCHAR) ELSE source || '/' || doc_id END || '.md' AS path, text FROM documents"


def _files(spark, d):
    return spread(table(spark, d, "documents")).select(F.concat(F.coalesce(F.concat("source", F.lit("/")), F.lit("")), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")


@query(f"""WITH f AS ({_FILES}), w AS (SELECT path, coalesce(len(regexp_extract_all(text, '[\\pL\\pN_]+')), 0) AS words, contains(path, '/') AS inside FROM f), a AS (SELECT CASE WHEN inside AND words = 0 THEN 'empty' WHEN inside AND words < 80 THEN 'thin' WHEN NOT inside AND words >= 30 THEN 'orphan' END AS action, path, words FROM w)
SELECT * FROM a WHERE action IS NOT NULL UNION ALL SELECT DISTINCT 'stub', source || '/00-introduccion.md', 0 FROM mix_targets WHERE source IS NOT NULL AND source NOT IN (SELECT source FROM documents WHERE source IS NOT NULL)""")
def a13_looked_over(spark, d):
    return knowledge.looked_over(_files(spark, d), table(spark, d, "mix_targets").select(F.col("source").alias("domain")))


@query("SELECT DISTINCT source AS domain FROM documents WHERE source IS NOT NULL")
def n05_categories(spark, d):
    return knowledge.categories(_files(spark, d))


@query("""WITH o AS (SELECT doc_id, CAST(doc_id AS VARCHAR) || '.md' AS path, text, title, domain FROM documents WHERE domain IS NOT NULL AND trim(domain) <> '')
SELECT path, coalesce(text, '') || chr(10) || chr(10) || '## ' || CASE WHEN trim(title) <> '' THEN title ELSE 'Ampliación ' || (len(regexp_extract_all(coalesce(text, ''), '(?m)^##[\t-\r ]')) + 1) END || chr(10) || chr(10) || trim(domain) || chr(10) AS text FROM o""")
def k05_enriched(spark, d):
    """To each document with a domain that name is added, as a section of the document's title."""
    docs = spread(table(spark, d, "documents")).withColumn("path", F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    return knowledge.enriched(docs.select(F.col("doc_id").alias("id"), "path", F.col("title").alias("section"), F.col("domain").alias("text")), docs.select("path", "text"))


@query()
def k03_ingested(spark, d):
    """Where each document would go in the collection of the passages."""
    docs, files = spread(table(spark, d, "documents")), table(spark, d, "passages").select(F.col("source").alias("path")).distinct()
    return knowledge.ingested(docs.select("doc_id", "text", "title", F.lit(None).cast("string").alias("domain")), built(spark, d), files, synonyms(spark))


@query()
def c17_cleaned_files(spark, d):
    return knowledge.cleaned_files(_files(spark, d))


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM (SELECT conv_id, turn, min(role) AS role, min(text) AS text FROM conversations GROUP BY conv_id, turn)) WHERE age <= 10")
def k08_kept_turns(spark, d):
    rows = table(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"), F.min("text").alias("text"))
    return sinks.kept_last(rows, 10, "turn", "conv_id")


@query("""WITH b AS (SELECT category AS path, max(file_hash || coalesce(chunk_count, -1)) AS b FROM imports WHERE registered_at < TIMESTAMP '2024-01-02 12:00:00' GROUP BY 1), a AS (SELECT category AS path, max(file_hash || coalesce(chunk_count, -1)) AS a FROM imports WHERE registered_at >= TIMESTAMP '2024-01-02' GROUP BY 1)
SELECT path, CASE WHEN b IS NULL THEN 'new' WHEN a IS NULL THEN 'deleted' WHEN a <> b THEN 'modified' END AS change FROM a FULL OUTER JOIN b USING (path) WHERE path IS NOT NULL AND (b IS NULL OR a IS NULL OR a <> b)""")
def w02_changes(spark, d):
    """Categories as paths: what the imports of two overlapping times leave in them."""
    rows = table(spark, d, "imports").where("category is not null").select(F.col("category").alias("path"), F.concat("file_hash", F.coalesce("chunk_count", F.lit(-1)).cast("string")).alias("mark"), "registered_at")
    return changes.changes(rows.where("registered_at < timestamp'2024-01-02 12:00:00'"), rows.where("registered_at >= timestamp'2024-01-02'"), signature=("mark",))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def w07_tumbling(spark, d):
    return windows.tumbling(table(spark, d, "events"))


@query("SELECT time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE * k AS window_start, count(*) AS n FROM events, range(4) r(k) GROUP BY 1")
def w07_sliding(spark, d):
    return windows.sliding(table(spark, d, "events"))


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events), r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)
SELECT user_id, min(ts) AS session_start, count(*) AS n FROM r GROUP BY user_id, run""")
def w07_sessions(spark, d):
    return windows.sessions(table(spark, d, "events"))


@query("SELECT string_split(source, '/')[1] AS folder, CAST(coalesce(max(TRY_CAST(nullif(regexp_extract(string_split(source, '/')[-1], '^(\\d+)-', 1), '') AS INTEGER)), 0) + 1 AS INTEGER) AS next_index FROM passages WHERE source IS NOT NULL GROUP BY 1")
def k06_next_index(spark, d):
    return sinks.next_index(table(spark, d, "passages"))


@query("SELECT file_hash, doc_id, filename, registered_at FROM (SELECT *, row_number() OVER (PARTITION BY file_hash ORDER BY registered_at, doc_id) AS rn FROM imports) WHERE rn = 1")
def k07_registry(spark, d):
    return sinks.registered(table(spark, d, "imports")).select("file_hash", "doc_id", "filename", "registered_at")


@query(f"""WITH RECURSIVE {_CHUNKS}, m AS (SELECT doc_id, min(filename) AS filename, min(category) AS domain FROM imports GROUP BY doc_id), c AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS k FROM chunks)
SELECT doc_id, string_agg('## Fragmento ' || (chunk + 1) || chr(10) || chr(10) || '<!-- fuente:' || coalesce(filename, '') || ' | categoria:' || coalesce(domain, 'general') || ' | frag:' || (chunk + 1) || '/' || k || ' -->' || chr(10) || text, chr(10) || chr(10) ORDER BY chunk) AS content
FROM c LEFT JOIN m USING (doc_id) GROUP BY doc_id""")
def k02_markdown(spark, d):
    pieces = chunking.chunks(documents(spark, d), ["doc_id"])
    named = table(spark, d, "imports").groupBy("doc_id").agg(F.min("filename").alias("filename"), F.min("category").alias("domain"))
    return sinks.markdown(pieces.join(named, "doc_id", "left").withColumn("page", F.lit(None).cast("int")))


_FIRST = "trim(string_split(trim(b), chr(10))[1])"


@query(f"""WITH t AS (SELECT doc_id, trim(text) AS t FROM documents WHERE text IS NOT NULL), b AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '\\n[\\t-\\r ]*\\n'), lambda b: trim(b) <> '') AS bs FROM t)
SELECT doc_id, CASE WHEN contains(t, '##') OR contains(t, '# ') THEN t ELSE array_to_string(list_transform(bs, lambda b, i: CASE WHEN length({_FIRST}) < 80 AND NOT ends_with({_FIRST}, '.') AND contains(trim(b), chr(10)) AND len(bs) > 1
THEN '## ' || {_FIRST} || chr(10) || chr(10) || trim(regexp_replace(trim(b), '\\A[^\\n]*\\n', '')) ELSE '## Sección ' || i || chr(10) || chr(10) || trim(b) END), chr(10) || chr(10)) END AS markdown FROM b""")
def k04_formatted(spark, d):
    return documents(spark, d).select("doc_id", sinks.formatted("text").alias("markdown"))


@query(f"{_IMPORTED} SELECT status, count(*) AS n, CAST(sum(text_length) AS BIGINT) AS chars FROM imported GROUP BY status")
def k09_import_report(spark, d):
    return sinks.import_report(h03_imported(spark, d))


@query(r"""WITH b AS (SELECT coalesce(source, '') || '/' || doc_id || '.md' AS source, regexp_split_to_array(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '\n[\t-\r ]*\n') AS bs FROM documents WHERE text IS NOT NULL),
c AS (SELECT source, generate_subscripts(bs, 1) - 1 AS pos, unnest(bs) AS block FROM b), """ + f"""e AS (SELECT source, pos, {s.strip("block")} AS block FROM c), f AS (SELECT source, pos, regexp_extract(block, '(?s)\\A<!--(.*?)-->[\\t-\\r ]*', 1) AS comment, {s.strip("regexp_replace(block, '(?s)" + chr(92) + "A<!--(.*?)-->[" + chr(92) + "t-" + chr(92) + "r ]*', '')")} AS body FROM e WHERE block <> ''),
h AS (SELECT source, pos, body, TRY_CAST(nullif(regexp_extract(comment, 'pag:[\\t-\\r ]*(\\d+)', 1), '') AS INTEGER) AS page, list_filter(string_split(body, chr(10)), lambda l: trim(l) <> '') AS ls FROM f WHERE body <> ''),
t AS (SELECT *, CASE WHEN len(list_filter(ls, lambda l: NOT starts_with(ltrim(l), '#'))) = 0 THEN trim(regexp_replace(ls[1], '^[\\t-\\r ]*#+[\\t-\\r ]*', '')) END AS title FROM h),
r AS (SELECT *, last_value(title IGNORE NULLS) OVER (PARTITION BY source ORDER BY pos ROWS UNBOUNDED PRECEDING) AS running FROM t)
SELECT source, CAST(pos AS INTEGER) AS pos, string_split(source, '/')[1] AS domain, coalesce(running, '') AS title, page, {s.strip("regexp_replace(body, '(?m)^#+[" + chr(92) + "t-" + chr(92) + "r ]*', '', 'g')")} AS text FROM r WHERE title IS NULL""")
def s02_markdown_passages(spark, d):
    docs = documents(spark, d).select(F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"), "text")
    return corpus.passages(docs)


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<script\b[^>]*>.*?</script>', '', 'g'), '(?is)<style\b[^>]*>.*?</style>', '', 'g'), '(?s)<[^>]+>', '', 'g'), '&nbsp;', ' '), '&[a-z]+;', '', 'g'), '\n[\t-\r ]*\n', chr(10), 'g') AS text FROM documents WHERE text IS NOT NULL""")
def s04_html_text(spark, d):
    return documents(spark, d).select("doc_id", formats.html_text("text").alias("text"))


@query("SELECT n_regionkey, 'Columnas: n_nationkey | n_name | n_comment' || chr(10) || string_agg('n_nationkey: ' || n_nationkey || '. n_name: ' || n_name, chr(10) ORDER BY n_nationkey) AS text FROM nation GROUP BY n_regionkey")
def s14_csv_prose(spark, d):
    """A CSV file for each region, quoted, with an empty column and an empty row."""
    row = F.concat(F.col("n_nationkey").cast("string"), F.lit(';"'), F.col("n_name"), F.lit('";'))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", row.alias("row")))), lambda x: x["row"])
    files = table(spark, d, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("n_nationkey;n_name;n_comment\n;;\n"), F.array_join(rows, "\r\n")).alias("csv"))
    return files.select("n_regionkey", formats.csv_prose(F.col("csv")).alias("text"))


@query("SELECT n_nationkey, 'n_nationkey: ' || n_nationkey || '. n_name: ' || n_name AS text FROM nation")
def s14_records_prose(spark, d):
    n = table(spark, d, "nation")
    return n.select("n_nationkey", formats.records_prose(n, "n_nationkey", "n_name").alias("text"))


@query("SELECT doc_id, CASE WHEN source = 'biblioteca_central' AND regexp_full_match(text, '[\\x{1}-\\x{FF}]*') THEN text ELSE ltrim(text, chr(65279)) END AS text FROM documents WHERE text IS NOT NULL")
def s03_decoded(spark, d):
    """Each text as the bytes of a file: of one source in Latin-1 where it has no other characters, else in UTF-8 with a byte-order mark."""
    latin = F.coalesce(F.col("source") == "biblioteca_central", F.lit(False)) & F.col("text").rlike(r"\A[\x{1}-\x{FF}]*\z")
    raw = F.when(latin, F.encode("text", "ISO-8859-1")).otherwise(F.concat(F.unhex(F.lit("EFBBBF")), F.encode("text", "UTF-8")))
    return documents(spark, d).select("doc_id", corpus.decoded(raw).alias("text"))


@query(f"WITH f AS ({_FILES}), p AS (SELECT source AS path, count(*) AS n FROM passages WHERE source IS NOT NULL GROUP BY 1), a AS (SELECT path, strlen(coalesce(text, '')) AS size FROM f UNION ALL SELECT path, 1024 FROM p) SELECT path, CASE WHEN contains(path, '/') THEN string_split(path, '/')[1] ELSE 'general' END AS domain, coalesce(n, 0) AS n_passages, round(size / 1024, 1) AS size_kb FROM a LEFT JOIN p USING (path)")
def s22_listing(spark, d):
    """The documents as files, and the files of the passages."""
    p = table(spark, d, "passages")
    files = _files(spark, d).select("path", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size")).union(p.where("source is not null").select(F.col("source").alias("path"), F.lit(1024).cast("long")).distinct())
    return corpus.listed(files, p)


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def s21_uploads(spark, d):
    return documents(spark, d).select("doc_id", formats.uploaded(F.base64(F.encode("text", "UTF-8"))).alias("text"))
