"""Defined results for nulls, empty and odd texts, ties, repeated rows and empty tables."""

import base64
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from lectern import lexicons as lex
from lectern import session
from lectern.functions import text as tx
from lectern.operators import changes, chunking, cleaning, codes, index, knowledge, logs, nlu, quality, retrieval
from lectern.sources import corpus, formats, loaders, sinks
from lectern.streaming import imports, windows


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "text string").select(expr.alias("x")).first()["x"]


@pytest.mark.parametrize("name,step", cleaning.clean("text", aggressive=True))
def test_cleaning_steps_keep_null_and_empty(spark, name, step):
    rows = spark.createDataFrame([(None,), ("",)], "text string").select(step(F.col("text")).alias("x")).collect()
    assert [r["x"] for r in rows] == [None, ""]


def test_accents_of_all_characters(spark):
    assert one(spark, tx.strip_accents("text"), "Árbol ≠ ∉ ≱ € ™ Ω Ж Ӝ ё \U0002F800 👍 e\u0301 \u20DD한 ắ �") == "Arbol = ∈ ≥ € ™ Ω Ж Ж е \u4E3D 👍 e 한 a �"


def test_accents_of_each_character_as_duckdb(spark):
    import duckdb

    points = "SELECT i FROM range(192, 1114112) t(i) WHERE NOT i BETWEEN 55296 AND 57343"
    want = dict(duckdb.sql(f"SELECT i, strip_accents(chr(i::INT)) AS x FROM ({points}) WHERE x <> chr(i::INT)").fetchall())
    rows = spark.createDataFrame([(i, chr(i)) for i in want], "i int, text string").select("i", tx.strip_accents("text").alias("x")).collect()
    assert len(want) > 4000 and {r["i"]: r["x"] for r in rows} == want


def test_cleaning_examples(spark):
    assert one(spark, cleaning.pdf_artifacts("text"), "trans-\nporte ﬁno\n  Página 3\n[ 4 ]\nfin") == "transporte fino\n\n\nfin"
    assert one(spark, cleaning.entities("text"), "&amp;lt; &nope; &#243;x") == "<  x"
    assert one(spark, cleaning.punctuation("text"), "a.... b ,c “d” e–f") == 'a.. b,c "d" e-f'
    assert one(spark, cleaning.broken_tables("text"), "h1  h2  h3\na  b  c\nprosa  normal") == "h1 | h2 | h3\na | b | c\nprosa  normal"
    assert one(spark, cleaning.broken_tables("text"), "h1  h2  h3\nprosa") == "h1  h2  h3\nprosa"
    assert one(spark, cleaning.double_columns("text"), "\n".join(f"l{i} x    r{i} y" for i in range(4))) == "l0 x l1 x l2 x l3 x\nr0 y r1 y r2 y r3 y"
    assert one(spark, cleaning.repeated_headers("text"), "Cap 1\nuno\nCAP 1\ndos\ncap 1\ntres") == "uno\ndos\ntres"
    assert one(spark, cleaning.repeated_headers("text"), "Cap 1\nuno\nCap 1") == "Cap 1\nuno\nCap 1"
    assert one(spark, cleaning.watermarks("text"), "DRAFT\nuno\nZZZ\nZZZ\nZZZ\nONU") == "uno\nONU"
    p = "uno dos tres cuatro cinco seis"
    assert one(spark, cleaning.duplicate_paragraphs("text"), f"{p}\n\nx\n\nx\n\n{p.upper()}") == f"{p}\n\nx\n\nx"


def test_running_headers_need_three_pages(spark):
    pages = spark.createDataFrame([(1, i, f"Cabecera  X\ntexto {i}") for i in (1, 2, 3)] + [(2, 1, "Cabecera X\na"), (2, 2, None)], "doc_id long, page int, text string")
    rows = {(r["doc_id"], r["page"]): r["text"] for r in cleaning.without_running_headers(pages).collect()}
    assert rows == {(1, 1): "texto 1", (1, 2): "texto 2", (1, 3): "texto 3", (2, 1): "Cabecera X\na", (2, 2): None}


def test_tokens_and_stems(spark):
    assert one(spark, tx.tokens("text"), "Ácido Ñandú's 3D") == ["acido", "nandu's", "3d"]
    assert one(spark, tx.content_terms(tx.tokens("text")), "las funciones mutacion casas es") == ["funcion", "muta", "casa"]
    assert one(spark, tx.tokens("text"), None) is None
    assert one(spark, tx.words("text"), "   ") == []


def test_pack():
    sents = [f"s{i} " + "w " * 8 + "fin." for i in range(12)]
    pieces = chunking.pack(" ".join(sents), 30, 12)
    assert all(len(p.split()) <= 40 for p in pieces) and pieces[0].startswith("s0") and "s11" in pieces[-1]
    for a, b in zip(pieces, pieces[1:]):
        assert b.split(".")[0] in a
    assert chunking.pack(None) == [] and chunking.pack("  ") == [] and chunking.pack("pocas palabras.") == []
    assert len(chunking.pack("w " * 500)) == 1


def test_mended_breaks():
    stop, alone = frozenset(lex.COLUMN_STOPWORDS), frozenset(lex.COLUMN_STANDALONE)
    assert chunking.mend_breaks("el flu jo de (mio cardio) y", stop, alone) == "el flujo de (miocardio) y"
    assert chunking.mend_breaks("", stop, alone) == ""


def _passages(spark):
    rows = [(1, "a", "a/x.md", "t", "gato gato perro", 1), (2, "a", "a/y.md", "t", "perro raton", None), (3, "b", "b/x.md", "t", None, None), (3, "b", "b/x.md", "t", None, None), (4, "b", "b/z.md", None, "", None)]
    return spark.createDataFrame(rows, "pid long, domain string, source string, title string, text string, page int")


def test_index_and_search(spark):
    idx = index.build(_passages(spark).withColumn("term", F.lit("x")).withColumn("w", F.lit(1)))
    assert idx.n == 4 and {r["pid"]: r["dl"] for r in idx.postings.select("pid", "dl").collect()} == {1: 3, 2: 2}
    q = spark.createDataFrame([(1, "perro"), (2, None), (3, ""), (4, "nada"), (1, "perro")], "qid long, text string")
    terms = retrieval.query_terms(q)
    hits = retrieval.search(terms, idx)
    got = hits.orderBy("rank").collect()
    assert [(r["qid"], r["pid"]) for r in got] == [(1, 2), (1, 1)] and got[0]["score"] == 1.0
    assert {r["qid"]: r["outcome"] for r in retrieval.assess(q, hits).collect()} == {1: "ok", 2: "empty", 3: "empty", 4: "empty"}
    empty = index.build(_passages(spark).where("false"))
    assert empty.n == 1 and retrieval.search(terms, empty).count() == 0


def test_index_snapshot(spark, tmp_path):
    idx = index.build(_passages(spark))
    index.save(idx, str(tmp_path / "i"), 3, None, "sig")
    assert index.load(spark, str(tmp_path / "i"), 3, None, "sig").postings.count() == idx.postings.count()
    assert index.load(spark, str(tmp_path / "i"), 3, "low", "sig") is None and index.load(spark, str(tmp_path / "none"), 3, None, "sig") is None


def test_debate(spark):
    prev = spark.createDataFrame([(1, 1.0, 2.0), (2, 0.1, 2.0), (3, 1.0, 1.0), (4, 1.0, 1.0)], "qid long, score double, raw_score double")
    hits = spark.createDataFrame([(1, 1.0, 2.0), (2, 1.0, 2.0), (3, 1.0, 3.0)], "qid long, score double, raw_score double")
    assert {r["qid"]: r["stance"] for r in retrieval.debate(prev, hits).collect()} == {1: "defend", 2: "concede", 3: "correct", 4: "concede"}


def test_quality(spark):
    assert one(spark, quality.prose_quality("text"), None) == 0.0
    assert one(spark, quality.prose_quality("text"), "1 2 3 4 cinco seis") == 0.0
    assert one(spark, quality.prose_quality("text", tool=True), "1 2 3 4 cinco seis") == 0.02
    assert one(spark, quality.bad_sentence("text"), "FIGURA 3 muestra claramente los resultados obtenidos aquí.")
    assert not one(spark, quality.bad_sentence("text"), "Los resultados obtenidos muestran claramente una tendencia estable.")


def test_language_resolution(spark):
    turns = [(1, 0, "the cat is on the table with him"), (1, 1, "ok"), (1, 2, "que es el gato de la casa"), (1, 3, None), (1, 3, None), (2, 0, None)]
    got = nlu.resolved_languages(spark.createDataFrame(turns, "conv_id long, turn int, text string"))
    assert {(r["conv_id"], r["turn"]): r["resolved"] for r in got.collect()} == {(1, 0): "en", (1, 1): "en", (1, 2): "es", (1, 3): "en", (2, 0): "es"}


def test_keyword_patterns_and_intents(spark):
    docs = spark.createDataFrame([(1, "la célula y el tribunal"), (2, None), (3, "")], "doc_id long, text string")
    lexicon = spark.createDataFrame([("bio", "célula"), ("bio", "célula"), ("ley", "tribunal"), (None, "x")], "domain string, keyword string")
    scores = nlu.keyword_scores(docs, lexicon, {"ley": "tribunal|juez"})
    assert {(r["domain"], r["score"]) for r in scores.collect()} == {("bio", 2), ("ley", 3)}
    assert {r["doc_id"]: r["domain"] for r in nlu.best_domains(scores, docs).collect()} == {1: "ley", 2: "general", 3: "general"}
    ex = spark.createDataFrame([("saludo", "es", "hola que tal"), ("adios", "es", "hasta luego")], "intent string, lang string, example string")
    tx_ = spark.createDataFrame([(1, "hola", "es"), (2, "otra cosa", "es"), (3, None, "es")], "id long, text string, lang string")
    got = {r["id"]: r["intent"] for r in nlu.intents(tx_, ex).collect()}
    assert got == {1: "saludo", 2: None, 3: None}


def test_context_and_routes(spark):
    turns = spark.createDataFrame([(1, 0, "qué es la diabetes gestacional"), (1, 1, "como se corrige"), (1, 2, None)], "conv_id long, turn int, text string")
    got = {r["turn"]: (r["is_followup"], r["query"]) for r in nlu.in_context(turns).collect()}
    assert got[0] == (False, "qué es la diabetes gestacional") and got[1][0] and got[1][1].startswith("diabetes gestacional corrección") and got[2][0]
    assert one(spark, nlu.route("text", F.lit(None).cast("string"), F.lit(0.0), F.lit(0.0)), "estas equivocado") == "debate"
    assert one(spark, nlu.route("text", F.lit("saludo"), F.lit(0.9), F.lit(0.0)), "hola") == "smalltalk"
    assert one(spark, nlu.route("text", F.lit(None).cast("string"), F.lit(0.0), F.lit(0.0)), None) == "unknown"


def test_changes(spark):
    a = spark.createDataFrame([("x", 1, 1), ("y", 1, 1), ("z", 1, 1)], "path string, modified int, size int")
    b = spark.createDataFrame([("x", 1, 1), ("y", 2, 1), ("w", 1, 1), ("w", 1, 1)], "path string, modified int, size int")
    assert {(r["path"], r["change"]) for r in changes.changes(a, b).collect()} == {("y", "modified"), ("z", "deleted"), ("w", "new")}
    assert changes.signature(a) == changes.signature(a.orderBy(F.desc("path"))) and changes.is_stale(changes.signature(a), b)


def test_code_notes(spark):
    rows = [(1, "import os\ndef f(a=[]):\n    try:\n        return a == None\n    except:\n        pass\n"), (2, "function f() { return (1; }"), (3, None), (4, "def f(:\n  pass"), (5, "SELECT 1 FROM t")]
    got = {r["id"]: r for r in codes.analyzed(spark.createDataFrame(rows, "id long, code string")).collect()}
    assert {n["note"] for n in got[1]["notes"]} >= {"bare-except", "compare-none", "mutable-default", "unused-import", "no-docstring"}
    assert got[2]["language"] == "javascript" and not got[2]["ok"] and got[3]["language"] == "desconocido" and not got[4]["ok"] and got[5]["language"] == "sql"


def test_logs(spark):
    log = spark.createDataFrame([(1, "s", "2024-01-01 00:00:01", "2024-01-01 00:00:02", "a", "unknown", 0.0, 300.0), (1, "s", "2024-01-01 00:00:01", "2024-01-01 00:00:09", "a", "unknown", 0.0, 300.0), (2, "s", "2024-01-01 00:00:03", "2024-01-01 00:00:04", None, "knowledge", None, -1.0)], "usage_id long, session_id string, ts string, logged_at string, text string, mode string, score double, latency_ms double")
    assert logs.distinct_usage(log).count() == 2
    r = logs.tuned(log).collect()
    assert len(r) == 1 and (r[0]["n"], r[0]["min_score"], r[0]["history"]) == (1, 0.15, 40)


def test_markdown_passages(spark):
    md = "# Título\n\n<!-- pag:7 --> Uno dos.\n\n<!-- solo -->\n\n## Otro\n# x\n\ntexto\n\n"
    rows = corpus.passages(spark.createDataFrame([("dom/a.md", md), ("b.txt", None)], "path string, text string")).orderBy("pos").collect()
    assert [(r["domain"], r["title"], r["page"], r["text"]) for r in rows] == [("dom", "Título", 7, "Uno dos."), ("dom", "Otro", None, "texto")]


def test_formats(spark, tmp_path):
    def zipped(**files):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            for k, v in files.items():
                z.writestr(k.replace("__", "/").replace("_xml", ".xml"), v)
        return b.getvalue()

    sheet = '<worksheet><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c></row></sheetData></worksheet>'
    files = [
        ("a.docx", zipped(word__document_xml="<d><p><t>Hola</t><t> tú</t></p><p><t>fin</t></p></d>")), ("b.odt", zipped(content_xml="<d><p>uno</p><p>dos</p></d>")), ("c.pptx", zipped(ppt__slides__slide1_xml="<d><t>x</t></d>", ppt__slides__slide10_xml="<d><t>z</t></d>", ppt__slides__slide2_xml="<d><t>y</t></d>")),
        ("d.xlsx", zipped(xl__sharedStrings_xml="<s><si><t>col</t></si></s>", xl__worksheets__sheet1_xml=sheet)), ("e.rtf", rb"{\rtf1 Caf\'e9\par \u241?o}"), ("f.html", b"<p>a&nbsp;b</p><script>x</script>&eacute;"), ("g.csv", "x;y\n1;\n2;3\n".encode()), ("h.txt", "ñ".encode("latin-1")), ("i.docx", b"broken"), ("j.bin", b"x"),
        ("k.txt", b""),
    ]
    got = {r["path"]: r["text"] for r in formats.extracted(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert got == {"a.docx": "Hola tú\nfin", "b.odt": "uno\ndos", "c.pptx": "## Diapositiva 1\nx\n## Diapositiva 2\ny\n## Diapositiva 3\nz", "d.xlsx": "## Hoja: 1\ncol | 5", "e.rtf": "Café\nño", "f.html": "a b", "g.csv": "Columnas: x | y\nx: 1\nx: 2. y: 3", "h.txt": "ñ", "i.docx": None, "k.txt": ""}
    assert one(spark, formats.uploaded("text"), base64.b64encode("añ".encode()).decode()) == "añ"


def test_files_and_listing(spark, tmp_path):
    (tmp_path / "dom").mkdir()
    (tmp_path / "dom" / "a.md").write_text("# T\n\nuno")
    (tmp_path / "dom" / "x.bin").write_bytes(b"x")
    f = corpus.files(spark, str(tmp_path))
    p = corpus.passages(f.select("path", corpus.decoded(F.col("content")).alias("text")))
    assert [(r["path"], r["domain"], r["n_passages"]) for r in corpus.listed(f, p).collect()] == [("dom/a.md", "dom", 1)]


def test_formatted(spark):
    assert one(spark, sinks.formatted("text"), "## ya\n\nx") == "## ya\n\nx"
    assert one(spark, sinks.formatted("text"), "Uno\ncuerpo.\n\nfrase sola.") == "## Uno\n\ncuerpo.\n\n## Sección 2\n\nfrase sola."
    assert one(spark, sinks.formatted("text"), None) is None


def test_import_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    body = "Una frase con bastantes palabras para llegar al mínimo de once en total. " * 3
    (src / "a.txt").write_text(body)
    (src / "b.txt").write_text(body)
    for _ in range(2):
        imports.import_stream(spark, str(src), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def test_import_stream_keeps_the_index(spark, tmp_path):
    src = tmp_path / "in" / "fisica"
    src.mkdir(parents=True)
    body = "La energía {} del sistema se conserva con bastantes palabras para llegar al mínimo de once en total. " * 3
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    for i in range(2):
        (src / f"{i}.txt").write_text(body.replace("{}", f"palabra{i}"))
        imports.import_stream(*args, index_path=f"file://{tmp_path}/index").awaitTermination()
    last = max(int(p.name) for p in (tmp_path / "index").iterdir())
    got = index.load(spark, f"file://{tmp_path}/index/{last}", index.VERSION, None, str(last))
    assert got.n == 2 and got.passages.count() == 2 and {r["domain"] for r in got.passages.collect()} != set()
    whole = index.build(got.passages)
    assert sorted(map(tuple, got.postings.collect())) == sorted(map(tuple, whole.postings.collect()))


PASSAGES = [(1, "fisica", "fisica/01-a.md", "t", "energía energía campo", 1), (2, "fisica", "fisica/02-b.md", "t", "campo onda", None), (3, "bio", "bio/a.md", "t", "célula núcleo", None), (4, None, None, None, None, None)]


def _stored(spark, rows):
    return spark.createDataFrame(rows, "pid long, domain string, source string, title string, text string, page int")


def test_index_cached_and_updated(spark, tmp_path):
    _stored(spark, PASSAGES).write.parquet(str(tmp_path / "p"))
    stored = spark.read.parquet(str(tmp_path / "p"))
    one = index.cached(stored, f"file://{tmp_path}/i")
    before = sorted(p.name for p in (tmp_path / "i").iterdir())
    again = index.cached(stored, f"file://{tmp_path}/i")
    assert sorted(p.name for p in (tmp_path / "i").iterdir()) == before and one.n == again.n == 4
    fresh = [(2, "fisica", "s", "t", "onda nueva", None), (5, "bio", "s", "t", "célula", None), (5, "bio", "s", "t", "célula", None)]
    got = index.updated(again, _stored(spark, fresh), spark.createDataFrame([(3,), (99,)], "pid long"))
    want = index.build(_stored(spark, [PASSAGES[0], PASSAGES[3], *fresh]))
    assert sorted(map(tuple, got.postings.collect())) == sorted(map(tuple, want.postings.collect())) and (got.n, got.avgdl) == (want.n, want.avgdl)
    none = index.updated(index.build(_stored(spark, [])), _stored(spark, []))
    assert none.postings.count() == 0


def test_frequent_terms_are_looked_up_exactly(spark, monkeypatch):
    import random

    rng = random.Random(5)
    rows = [(i, "d", "s", "t", " ".join(rng.choice(["agua", "tierra", "fuego", f"raro{rng.randrange(40)}", f"unico{i}"]) for _ in range(12)), None) for i in range(300)]
    idx = index.build(_stored(spark, rows))
    asked = [(1, "agua raro3"), (2, "agua tierra fuego"), (3, "raro1 raro2 agua"), (4, "unico7 agua agua"), (5, "nada"), (6, "raro5"), (7, None)]
    terms = retrieval.query_terms(spark.createDataFrame(asked, "qid long, text string"))
    for k in (1, 3):
        got = []
        for worth in (0, 10**9):
            monkeypatch.setattr(retrieval, "WORTH", worth)
            got.append(sorted(map(tuple, retrieval.search(terms, idx, k).collect())))
        assert got[0] == got[1] and len(got[0]) >= 5 * min(k, 2)


def test_added_files(spark):
    idx = index.build(_stored(spark, PASSAGES))
    texts = spark.createDataFrame([(1, "# La energía\n\ny el campo", None, None), (2, "campo de energía", "Otro", None), (3, "zanahoria", None, None), (4, "x", "T", "Mi Tema"), (5, "  ", None, None), (6, None, None, None)], "doc_id long, text string, title string, domain string")
    files = spark.createDataFrame([("fisica/01-a.md",), ("fisica/07-b.md",), (None,)], "path string")
    got = {r["doc_id"]: (r["title"], r["domain"], r["is_new_domain"], r["path"]) for r in knowledge.ingested(texts, idx, files).collect()}
    assert got == {1: ("La energía", "fisica", False, "fisica/08-la-energia.md"), 2: ("Otro", "fisica", False, "fisica/09-otro.md"), 3: ("zanahoria", "zanahoria", True, "zanahoria/01-zanahoria.md"), 4: ("T", "mi-tema", False, "mi-tema/01-t.md")}
    more = spark.createDataFrame([(1, "a.md", None, "uno"), (2, "a.md", "Dos", "dos "), (3, "none.md", "x", "y"), (4, "a.md", None, " ")], "id long, path string, section string, text string")
    assert [tuple(r) for r in knowledge.enriched(more, spark.createDataFrame([("a.md", "# A\n\n## B\nx"), ("b.md", "y")], "path string, text string")).collect()] == [("a.md", "# A\n\n## B\nx\n\n## Ampliación 2\n\nuno\n\n\n## Dos\n\ndos\n")]
    asked = spark.createDataFrame([(1, "energía", None, "x"), (2, "nada", None, "y")], "id long, query string, section string, text string")
    assert [tuple(r) for r in knowledge.enrichment_targets(asked, idx).collect()] == [(1, "fisica/01-a.md", None, "x")]


def test_looking_over_files(spark):
    files = spark.createDataFrame([("a/x.md", "uno dos"), ("a/y.md", None), ("z.md", "energía campo " * 20), ("w.md", "corto"), (None, "x")], "path string, text string")
    wanted = spark.createDataFrame([("a",), ("b",), (None,)], "domain string")
    assert {tuple(r) for r in knowledge.looked_over(files, wanted).collect()} == {("thin", "a/x.md", 2), ("empty", "a/y.md", 0), ("orphan", "z.md", 40), ("stub", "b/00-introduccion.md", 0)}
    assert {tuple(r) for r in knowledge.routed(files.where("path in ('z.md', 'w.md')"), index.build(_stored(spark, PASSAGES))).collect()} == {("z.md", "fisica/z.md"), ("w.md", "w/w.md")}
    assert {r[0] for r in knowledge.categories(files, spark.createDataFrame([("Mi Tema",)], "name string")).collect()} == {"a", "mi_tema"}


def test_cleaned_files_and_versions(spark):
    good = "El sistema nervioso central coordina diversas funciones mediante impulsos eléctricos continuos entre distintas regiones cerebrales. " * 2
    files = spark.createDataFrame([("a.md", f"# Título\n\ntres palabras solas\n\n{good}\n\n1 2 3 4 5 6 7 8 9"), ("b.md", None)], "path string, text string")
    got = {r["path"]: r for r in knowledge.cleaned_files(files).collect()}
    assert got["a.md"]["text"] == f"# Título\n\n{good.strip()}\n" and got["a.md"]["removed"] == 2 and "b.md" not in got
    versions = spark.createDataFrame([("a", 1, "v1"), ("a", 2, "v2"), ("a", 3, "v3"), ("b", 1, "w")], "path string, saved_at int, text string")
    assert [tuple(r) for r in knowledge.restored(versions, F.lit(2)).collect()] == [("a", "v2")]


def test_loaders(spark, tmp_path):
    (tmp_path / "stopwords_es.txt").write_text("que el\nla  que\n")
    (tmp_path / "intents.json").write_text('{"saludo": {"examples": {"es": ["Hola tú", "hola tú"], "en": ["hi"]}, "responses": {}}, "x": {}}')
    (tmp_path / "vocab.json").write_text('{"es": ["uno", "uno"], "en": []}')
    (tmp_path / "registry.json").write_text('{"h1": {"filename": "a.pdf", "chunk_count": 3}, "h2": {}}')
    (tmp_path / "config.json").write_text('{"top_k": 7}')
    d = str(tmp_path)
    assert {tuple(r) for r in loaders.stopwords(spark, d).collect()} == {("es", "que"), ("es", "el"), ("es", "la")}
    found = loaders.intents(spark, f"{d}/intents.json")
    assert {tuple(r) for r in loaders.vocabulary(found).collect()} == {("es", "hola"), ("es", "tu"), ("en", "hi")}
    assert [tuple(r) for r in loaders.learned(spark, f"{d}/vocab.json").collect()] == [("es", "uno")]
    assert {(r["file_hash"], r["filename"], r["chunk_count"]) for r in loaders.registry(spark, f"{d}/registry.json").collect()} == {("h1", "a.pdf", 3), ("h2", None, None)}
    assert loaders.settings(spark, f"{d}/config.json", {"top_k": 5, "k1": 1.5}) == {"top_k": 7, "k1": 1.5} and loaders.settings(spark, f"{d}/none.json", {"a": 1}) == {"a": 1}
    assert loaders.registry(spark, f"{d}/none.json").count() == loaders.intents(spark, f"{d}/none.json").count() == loaders.learned(spark, f"{d}/none.json").count() == 0
    assert [tuple(r) for r in loaders.with_defaults(spark.createDataFrame([(1, None)], "a int, b string"), b="x").collect()] == [(1, "x")]


def test_log_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("s", i, f"t{i}") for i in range(5)] + [("r", 1, "x")], "session string, turn int, text string")
    for _ in range(2):
        sinks.appended(rows, str(tmp_path / "log"), "session")
    log = spark.read.parquet(str(tmp_path / "log")).select(*rows.columns)
    assert log.count() == 12 and {(r["session"], r["turn"]) for r in sinks.kept_last(log.distinct(), 2, "turn", "session").collect()} == {("s", 4), ("s", 3), ("r", 1)}
    assert [r["turn"] for r in sinks.kept_last(log, 3, "turn").orderBy("turn").collect()] == [3, 4, 4]
    a, b = (spark.createDataFrame(x, "lang string, term string") for x in ([("es", "uno"), (None, "x")], [("es", "uno"), ("en", "one")]))
    assert {tuple(r) for r in sinks.merged_terms(a, b).collect()} == {("es", "uno"), ("en", "one")}


def test_explanations(spark):
    idx = index.build(_stored(spark, [*PASSAGES, (9, "meta", "meta/a.md", "t", "el índice del sistema", None)]))
    hits = retrieval.search(retrieval.query_terms(spark.createDataFrame([(1, "energía")], "qid long, text string")), idx)
    got = {r["qid"]: (r["score"], r["label"], r["sources"]) for r in retrieval.explained(hits, spark.createDataFrame([(10, 1), (11, 5)], "qid long, previous long")).collect()}
    assert got == {10: (1.0, "high", "fisica/01-a.md, página 1 (1.00)"), 11: (0.0, "low", "")}
    told = {r["qid"]: (r["reply"], r["score"]) for r in retrieval.self_explained(spark.createDataFrame([(1, "¿Cómo buscas?"), (2, None)], "qid long, text string"), idx, {"buscas": "índice"}, "meta", "hechos").collect()}
    assert told == {1: ("el índice del sistema\n\nhechos", 1.0), 2: ("hechos", 0.4)}


def test_templates_and_snapshot(spark):
    templates = spark.createDataFrame([("bucle", ["bucle", "for"], "for x in y:"), ("clase", ["clase", "objeto"], "class A:")], "name string, keywords array<string>, code string")
    asked = spark.createDataFrame([(1, "Un bucle for"), (2, "una clase y un bucle"), (3, "nada"), (4, None)], "id long, text string")
    assert {r["id"]: r["name"] for r in codes.generated(asked, templates).collect()} == {1: "bucle", 2: "bucle", 3: None, 4: None}
    assert session.snapshot(spark)["cores"] == 4 and session.snapshot(spark)["executors"] == 1


def test_cleared_tables(spark, data):
    kept = session.materialize(spark.range(3), "x")
    assert kept.count() == 3
    session.clear(spark)
    assert not session.shared_dir(spark).startswith("/") and pytest.raises(Exception, spark.read.parquet, session._own_dir(spark))


def test_code_lines(spark):
    assert codes.kind_of("El informe final; la clase return class import from print.") == "desconocido" and codes.kind_of("", "a/b.java") == "java"
    assert codes.kind_of("public class A {\n  public static void main(String[] a) {}\n}") == "java" and codes.kind_of("#include <iostream>\nint main() { std::cout << 1; }") == "cpp"


def test_stream_windows(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet")
    events.write.parquet(str(tmp_path / "e"))
    stream = windows.tumbling(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")))
    q = stream.writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("w").count() == windows.tumbling(events).count()


def _shuffled(spark):
    """Rows that all stages so far wrote to shuffles."""
    sc = spark.sparkContext
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), sc._jvm.java.util.ArrayList())
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_no_pair_of_query_and_passage_is_shuffled(spark, monkeypatch):
    rows = [(i, f"d{i % 3}", "s", "t", f"agua tierra fuego raro{i % 50}", None) for i in range(2000)]
    before = _shuffled(spark)
    idx = index.build(_stored(spark, rows))
    idx.idf.count()
    assert _shuffled(spark) - before < 4000  # pids and terms of tasks, not the 8,000 postings
    terms = retrieval.query_terms(spark.createDataFrame([(q, f"agua tierra raro{q}") for q in range(100)], "qid long, text string")).localCheckpoint()
    monkeypatch.setattr(retrieval, "WORTH", 100_000)  # there are 404,000 pairs
    for result, n in ((retrieval.search(terms, idx, 3), 300), (retrieval.classify_domains(terms, idx), 100), (retrieval.scores(terms, idx), 200_000)):
        before = _shuffled(spark)
        assert result.count() == n and _shuffled(spark) - before < 10_000


def test_scores_of_passages_are_those_of_joins(spark, monkeypatch):
    rows = [(f"p{i:03}", [None, "a", "b"][i % 3], "s", "t", f"agua {'tierra ' * (i % 4)} {'fuego' if i % 7 else ''} comun", None) for i in range(90)] + [("p900", "a", "s", "t", None, None), ("p005", "a", "s", "t", "a", None)]
    idx = index.build(spark.createDataFrame(rows, "pid string, domain string, source string, title string, text string, page int"))
    terms = retrieval.query_terms(spark.createDataFrame([("x", "agua fuego fuego"), ("y", "tierra comun"), ("z", "comun"), ("n", None), ("o", "nada")], "qid string, text string"))
    for name, value in (("ROUND", 3), ("BLOCK", 16), ("BATCH", 5)):
        monkeypatch.setattr(retrieval, name, value)
    for exclude in (None, ["a"]):
        got = []
        for worth in (0, 10**9):
            monkeypatch.setattr(retrieval, "WORTH", worth)
            got.append([sorted(map(tuple, x.collect())) for x in (retrieval.scores(terms, idx, None, exclude), retrieval.search(terms, idx, 4, exclude))])
        assert got[0] == got[1] and len(got[0][1]) == 12


def test_query_texts_are_read_once(spark, tmp_path):
    spark.createDataFrame([(1, "La célula y la celula"), (2, "nada"), (3, None), (4, "")], "qid long, text string").write.parquet(str(tmp_path / "q"))
    synonyms = spark.createDataFrame([("celula", "unidad viva"), ("onda", "nad")], "canon string, variant string")
    terms = retrieval.query_terms(spark.read.parquet(str(tmp_path / "q")), synonyms)
    assert sorted(map(tuple, terms.collect())) == [(1, "celula", 2), (1, "unidad", 1), (1, "viva", 1), (2, "nad", 1), (2, "nada", 1), (2, "onda", 1)]
    assert terms._jdf.queryExecution().sparkPlan().toString().count("FileScan parquet") == 1
