"""The operators for training text: brute force, round trips, held-out accuracy and odd rows."""

import random
import re
import unicodedata
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lectern.llm import distinctive, kinds, language, mixing, mojibake, neardup, pieces, queries, scans, subjects, tokens, words


def docs(spark, rows, schema="doc_id long, text string"):
    """Rows with columns of clashing names beside them."""
    return spark.createDataFrame(rows, schema).withColumns({c: F.lit("other") for c in ("id", "key", "n", "votes", "kind", "term", "at", "a", "b", "whole")})


# --- 1 ---


def brute_pairs(texts: dict[int, str], k: int, threshold: float, least: int) -> set[tuple[int, int]]:
    sets, by = {}, defaultdict(set)
    for i, t in texts.items():
        w = re.findall(r"[^\W_]+", "".join(c for c in unicodedata.normalize("NFD", t.lower()) if not unicodedata.combining(c)))
        if len(w) >= least:
            sets[i] = set(zip(*(w[j:] for j in range(k))))
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) > threshold * len(sets[a] | sets[b])}


def test_pairs_as_brute_force(spark, data):
    pdf = pd.read_parquet(f"{data}/documents.parquet").dropna(subset=["text"])
    got = {tuple(r) for r in queries.p1_found(spark, data).collect()}
    assert got == brute_pairs(dict(zip(pdf.doc_id, pdf.text)), 3, 0.5, 20)


def test_hot_group_of_near_copies(spark):
    rng = random.Random(3)
    base = [rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(60)]
    rows = []
    for i in range(320):
        w = list(base)
        w[rng.randrange(60)] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, rows[0][1]) for i in range(5)] + [(2000, None), (2001, ""), (2002, "una dos")]
    members, links = neardup.similar_classes(docs(spark, rows), k=3, threshold=0.5, min_words=20)
    got = {tuple(r) for r in neardup.similar_pairs(members, links).collect()}
    want = brute_pairs({i: t for i, t in rows if t}, 3, 0.5, 20)
    assert got <= want and len(got) >= 0.999 * len(want)
    groups = neardup.similar_groups(members, links).collect()
    assert len(groups) == 325 and {r["group_id"] for r in groups} == {0}


def test_pairs_just_over_the_threshold(spark):
    rng = random.Random(8)
    rows = []
    for i in range(300):  # runs of three words around each replaced word differ; the second text of a pair keeps somewhat more than half
        w = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        v = list(w)
        for j in rng.sample(range(0, 120, 3), rng.randrange(12, 15)):
            v[j] = f"x{rng.randrange(10**6)}"
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(v))]
    want = brute_pairs(dict(rows), 3, 0.5, 20)
    got = {tuple(r) for r in neardup.similar_pairs(*neardup.similar_classes(docs(spark, rows), k=3, threshold=0.5, min_words=20)).collect()}
    assert len(want) > 100 and got <= want and len(got) >= 0.99 * len(want)


def test_thresholds_follow_from_the_similarity():
    sample = np.random.default_rng(1).integers(0, 2**16, (500, neardup.CODES)).astype(np.uint16)
    for similarity in (0.5, 0.65, 0.8):
        t = [t for _, t in neardup.fit_partitions(sample, similarity, 10**6)]
        assert neardup.missed(t, similarity) <= neardup.MISS and neardup._tail(neardup.CODES, 1 - similarity, neardup.CODES - neardup.least_equal(similarity)) <= neardup.MISS
    assert sum(t + 1 for t in t) < sum(t + 1 for _, t in neardup.fit_partitions(sample, 0.5, 10**6))


@pytest.mark.parametrize("step", [1, 7, 1000])
def test_buckets_across_batches(step, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(neardup, "BLOCK", 4)
    sig = np.repeat([-5, 2, 3, 9, 12], [3, 13, 1, 4, 5])
    ids = np.arange(len(sig))
    rows = [r for b in neardup._probe(pa.RecordBatch.from_arrays([pa.array(sig[a : a + step]), pa.array(ids[a : a + step])], ["sig", "id"]) for a in range(0, len(sig), step)) for r in b.to_pylist()]
    small = {(r["a"], r["b"]) for r in rows if r["sig"] is None}
    assert small == {(a, b) for a in ids for b in ids if a < b and sig[a] == sig[b] and sig[a] in (-5, 9)}
    large = [(r["sig"], r["block"], r["a"]) for r in rows if r["sig"] is not None]
    assert sorted(x[2] for x in large) == ids[(sig == 2) | (sig == 12)].tolist() and max(Counter(x[:2] for x in large).values()) == 4
    assert {x[1] for x in large if x[0] == 2} == {0, 1, 2, 3} and {x[1] for x in large if x[0] == 12} == {0, 1}


def test_candidates_in_rounds(spark, monkeypatch):
    from lectern.session import shared_dir

    rng, tags = random.Random(4), []
    rows = []
    for g in range(6):
        base = [f"g{g}w{rng.randrange(300)}" for _ in range(60)]
        for i in range(30):
            w = list(base)
            w[rng.randrange(60)] = f"x{g}y{i}"
            rows.append((100 * g + i, " ".join(w)))
    write = neardup.materialize
    monkeypatch.setattr(neardup, "materialize", lambda df, tag, **options: (tags.append(tag), write(df, tag, **options))[1])
    monkeypatch.setattr(neardup, "BLOCK", 8)  # buckets of 30 are cut into blocks
    monkeypatch.setattr(neardup, "ROUND", 1)
    monkeypatch.setattr(neardup, "AT_ONCE", 1)
    monkeypatch.setattr(neardup, "VERIFIED_AT_ONCE", 1)
    folder = Path(shared_dir(spark).removeprefix("file://")) / "lectern" / spark.sparkContext.applicationId
    before = set(folder.glob("*"))
    got = [tuple(r) for r in neardup.similar_pairs(*neardup.similar_classes(docs(spark, rows), k=3, threshold=0.5, min_words=20)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(dict(rows), 3, 0.5, 20)
    assert tags.count("likely") > 3 and tags.count("runs") == tags.count("links") > 3
    left = {p.name.partition("-")[0] for p in set(folder.glob("*")) - before}
    assert not left & {"sketch", "reps", "probe", "runs"} and {"members", "likely", "links"} <= left


def test_no_documents_no_pairs(spark):
    members, links = neardup.similar_classes(docs(spark, []))
    assert members.count() == 0 and neardup.similar_pairs(members, links).count() == 0


# --- 2 ---

PAGES = [
    (1, 1, "El gato negro\n\nEl perro duerme en la casa y el gato mira la ven-\ntana abierta. El perro come y la casa es gran¬\n- 5 -"),
    (1, 2, "El gat0 negro\nde como siempre. Una obra teórico-\npráctica del perro.\n- 6 -"),
    (1, 2, "El gat0 negro\nde como siempre. Una obra teórico-\npráctica del perro.\n- 6 -"),
    (1, 3, "El gato negro\nLa obra teórico-práctica y la obra teórico-práctica del perro.\n1999\n- 7 -"),
    (2, 1, None), (2, 2, "   "), (3, 1, "Sin nada."), (None, 1, "x"), (3, None, "x"),
]


def test_scanned_noise(spark):
    pages = scans.examined(docs(spark, PAGES, "doc_id long, page int, text string"))
    got = {tuple(r) for r in scans.found(pages).collect()}
    want = {(1, 1, "hyphen"), *((1, p, n) for p in (1, 2, 3) for n in ("header", "page_number")), (1, 2, "ocr")}
    assert got == want
    text = " ".join(r["text"] for r in scans.paragraphs(pages).where("doc_id = 1").orderBy("paragraph").collect())
    assert "ventana abierta" in text and "grande como" in text and "gato negro" not in text and "teórico-práctica del" in text


def test_scan_readings():
    assert scans.number("Página 12 de 30") == (12, True) and scans.number("[ l56 ]") == (156, True) and scans.number("– 7 –") == (7, True) and scans.number("p. 9") == (9, True)
    assert scans.number("xiv") == (14, True) and scans.number("8.5") is None and scans.number("12") == (12, False)
    assert scans.key("repubhc") == scans.key("republic") == scans.key("repub1ic") and scans.key("modern") == scans.key("rnodern") and scans.key("liindía") == scans.key("lundía")


def test_words_around_speak_against_a_neighbour(spark):
    es, fr = "el gato ve el perro y el pan del campo con el agua ", "il tente expliquer cette chose avec patience pour nous tous "
    rows = [(i, 1, es * 10) for i in range(12)] + [(100 + i, 1, fr * 10) for i in range(12)]
    rows += [(200 + i, 1, "il tente d'expliquer cette chose avec patience") for i in range(4)] + [(300, 1, es + "y cl perro ve dcl campo el pan"), (301, 1, "il tente cxpliquer cette chose")]
    pages = scans.examined(docs(spark, rows, "doc_id long, page int, text string"))
    got = {(r["doc_id"], r["word"]) for r in scans.misread(pages, scans.divisions(pages)).collect()}
    assert got == {(300, "cl"), (300, "dcl"), (301, "cxpliquer")}
    assert "d'expliquer" in scans.paragraphs(pages).where("doc_id = 200").first()["text"]


def test_words_of_few_sightings_in_large_tables(spark, monkeypatch):
    monkeypatch.setattr(scans, "FREQUENT", 0.01)  # of some 1,400 words: as with 10 sightings in 7 million at the usual value
    rows = [(i, 1, "el gato ve el perro y el pan del campo " * 10) for i in range(14)] + [(100 + i, 1, "el visir Núrtola duerme") for i in range(10)] + [(120 + i, 1, "el visir duerme") for i in range(8)]
    pages = scans.examined(docs(spark, [*rows, (200, 1, "el visir Núrfola duerme")], "doc_id long, page int, text string"))
    got = {(r["doc_id"], r["word"], r["meant"]) for r in scans.misread(pages, scans.divisions(pages)).collect()}
    assert got == {(200, "núrfola", "núrtola")}


def test_tokens_blended_with_digits_and_signs(spark):
    right = "Ella sabe mucho porque la crónica es larga "
    rows = [(i, 1, right * 5) for i in range(10)] + [(100 + i, 1, "Notre salle est grande " * 10) for i in range(12)]
    rows += [(200 + i, 1, "Ella s@be mucho p0rque la cr6nica es l@rga") for i in range(20)] + [(300, 1, "Ella sabe mucho\nP0RQUE la 5abe y l25 o x2y es larga"), (301, 1, "Ella sabe mucho p0r-\nque la crónica es larga")]
    pages = scans.examined(docs(spark, rows, "doc_id long, page int, text string"))
    text = {r["doc_id"]: r["text"] for r in scans.paragraphs(pages).where("doc_id >= 200").collect()}
    assert {text[200 + i] for i in range(20)} == {right.strip()} == {text[301]}
    assert text[300] == "Ella sabe mucho PORQUE la Sabe y 125 o x2y es larga"
    assert {tuple(r) for r in scans.found(pages).collect()} == {*((d, 1, "ocr") for d in [*range(200, 220), 300, 301]), (301, 1, "hyphen")}


def test_blended_tokens_and_their_places():
    assert scans.words_of("El p0rque de 5km y c@sa 12 |ocal") == (["el", "de", "y"], [(1, "p0rque"), (3, "c@sa"), (3, "|ocal")])


def test_words_around_speak_against_a_blend(spark):
    es, fr = "el gato ve el perro y el pan del campo con el agua ", "il tente expliquer cette chose avec patience pour nous tous "
    rows = [(i, 1, es * 10) for i in range(12)] + [(100 + i, 1, fr * 10) for i in range(12)] + [(200, 1, es + "y el p@n del camp0"), (201, 1, fr + "e1 chose avec patience pour nous e1 cette chose")]
    pages = scans.examined(docs(spark, rows, "doc_id long, page int, text string"))
    got = {(r["doc_id"], r["word"], r["meant"]) for r in scans.misread(pages, scans.divisions(pages)).collect()}
    assert got == {(200, "p@n", "pan"), (200, "camp0", "campo")}


def test_paragraphs_over_many_pages(spark):
    rows = [(1, p, 0, "abc de" if p % 2 else "fgh-") for p in range(scans.PAGES - 3, scans.PAGES + 2)] + [(1, scans.PAGES + 1, 1, "Fin."), (1, scans.PAGES + 2, 0, "Otro"), (1, scans.PAGES + 4, 0, "tras un hueco")]
    got = [tuple(r) for r in scans.stitched(docs(spark, rows, "doc_id long, page int, paragraph int, text string")).orderBy("paragraph").collect()]
    n = scans.PAGES
    assert got == [(1, 0, n - 3, n + 1, "abc de fghabc de fghabc de"), (1, 1, n + 1, n + 1, "Fin."), (1, 2, n + 2, n + 2, "Otro"), (1, 3, n + 4, n + 4, "tras un hueco")]


def test_no_pages(spark):
    assert scans.found(scans.examined(docs(spark, [], "doc_id long, page int, text string"))).count() == 0


# --- 3 ---

CLEAN = "La función del señor Núñez reúne además «la última canción» – así."


@pytest.mark.parametrize("way", [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp1251"), ("latin-1", "cp1251"), ("latin-1", "cp850"), ("cp850", "cp1252")])
def test_encodings_are_undone(way):
    text = CLEAN.replace("–", "-").replace("«", "").replace("»", "") if way[0] != "utf-8" else CLEAN.replace("Ú", "U")
    hit, repaired = mojibake.examine(text.encode(way[0]).decode(way[1], "replace"))
    assert hit and sum(a == b for a, b in zip(repaired, text)) > 0.93 * len(text)


def test_long_runs_without_blanks():
    for whole in ("La última canción también. ".replace(" ", "\xa0") * 30, "función,última;" * 60, "canción" * 100, "日本語" * 200):
        bad = whole.encode("utf-8").decode("latin-1")
        assert len(bad) > 600 and mojibake.examine(bad) == (True, whole) and mojibake.examine(whole) == (False, whole)
        assert "".join(r for _, r in mojibake.runs(bad)) == bad
    assert mojibake.examine("x" * 1000 + "ñ" + "y" * 1000)[0] is False


def test_search_has_no_limit_of_states():
    assert mojibake.repair_run("canciÃ³n")[0] == "canción"
    bad = "canción"
    for _ in range(5):  # deeper than the search once went
        bad = bad.encode("utf-8").decode("latin-1")
    assert mojibake.repair_run(bad)[0] == "canción"
    assert mojibake.repair_run("последний")[0] == "последний"


def test_single_damaged_words(spark):
    bad = ["La Ãºltima vez.", "MÃ¡s de uno.", "Un Ã¡rea.", "Il va Ã\xa0 Paris.", "A 25Â°C.", "El 1Âº de mayo.", "ESPAÃ‘A", "INTRODUCCIÃ“N"]
    whole = ["La última vez.", "Más de uno.", "Un área.", "Il va à Paris.", "A 25°C.", "El 1º de mayo.", "ESPAÑA", "INTRODUCCIÓN"]
    fine = [*whole, "«GRAVITÉ».", "“CAFÉ”", "a? b", "Temp. 3º–5ª"]
    got = {r["doc_id"]: r["text_restored"] for r in mojibake.repaired(docs(spark, list(enumerate(bad + fine)))).collect()}
    assert got == dict(enumerate(whole))


def test_what_is_no_damage(spark):
    fine = [CLEAN, "La secuencia «Ã±» delata un archivo.", "Un rombo «�» marca un byte.", "Ærtholm og Blåvær, ÅÄÖ.", "Слово «мир» cierra.", "40 Å ± 3 µm; Temp. ¾ de 18 ºC", "Â = ½·(Ã + Ë)", "", None, "¿Por qué? https://x.es/?a=b", "x" * 100_000]
    bad = ["En la pr?ctica, la funci?n", "la funci�n", "cafÃ©", "M&#195;&#161;s de"]
    rows = [(i, t) for i, t in enumerate(fine + bad)] + [(len(fine), bad[0])]
    assert {r["doc_id"] for r in mojibake.affected(docs(spark, rows)).collect()} == set(range(len(fine), len(fine) + len(bad)))


# --- 4 ---

SHAPES = {
    "prose": "Se entiende por gravedad una fuerza cuya función principal es la de atraer los cuerpos. El estudio de la fuerza comenzó en el siglo pasado.",
    "list": "- un proceso\n- el método (1932)\n- la idea\n- otro caso notable\n- resultado final\n- el informe",
    "table": "caso;medida;valor\nuno;3.2;44\ndos;4.1;55\ntres;9.9;12\ncuatro;1.0;77",
    "junk": "00000000  5d c9 ea 58 80 f5 c9 6f\n00000010  e6 74 d5 8f 52 0c 90 19\n00000020  0d 7d 29 6d be 3b ed 82",
}


def test_kinds(spark, data):
    rows = [(i * 10 + j, t) for i, t in enumerate(SHAPES.values()) for j in range(4)] + [(90, None), (91, "  "), (92, "ab")]
    got = {r["id"]: r["kind"] for r in kinds.posteriors(kinds.described(docs(spark, rows))).collect()}
    assert all(got[i * 10 + j] == k for i, k in enumerate(SHAPES) for j in range(4)) and got[90] is None and got[91] is None
    assert kinds.found(kinds.posteriors(kinds.described(docs(spark, [])))).count() == 0


def test_menu_lines_of_any_length():
    menu = "home login contact menu search share cookies help de la y."
    for k in (1, 17, 40):  # 11, 187 and 440 words
        line = " ".join([menu] * k)
        f = kinds.figures(line)
        assert f[12] == 1.0 and kinds.votes(f)[0] == "j"


def test_learned_accuracies_do_not_depend_on_the_prior_at_size():
    counts = Counter({"ppppp-p-p": 9000, "ll-------": 300, "tt-----t-": 300, "jjj-j-j--": 300, "j---jj---": 100})
    one, big = kinds.learn(counts), kinds.learn(Counter({k: v * 100 for k, v in counts.items()}))
    assert all(np.argmax(one[0][k]) == np.argmax(big[0][k]) for k in counts)
    assert np.abs(one[1][:, 0] - big[1][:, 0]).max() < 0.01 and one[1].shape == (9, 4, 5)


def test_kinds_agree_with_labels(spark, data):
    labels = spark.read.parquet(f"{data}/labels.parquet").dropna(subset=["quality"]).dropDuplicates(["doc_id"])
    kind = kinds.posteriors(kinds.described(spark.read.parquet(f"{data}/documents.parquet"))).withColumnRenamed("id", "doc_id")
    rows = labels.where("quality = 1").join(kind, "doc_id").where("n_chars >= 40").collect()
    assert np.mean([r["kind"] == "prose" for r in rows]) > 0.85


# --- 5 ---


def test_rare_terms_as_brute_force(spark, data):
    items, passages = pd.read_parquet(f"{data}/benchmark.parquet"), pd.read_parquet(f"{data}/passages.parquet")
    stand = defaultdict(set)
    for pid, title, text in zip(passages.pid, passages.title, passages.text):
        for t in distinctive.terms_of(title) + distinctive.terms_of(text):
            stand[t].add(pid)
    want = {(i, p) for i, text in zip(items.item_id, items.text) for t in distinctive.terms_of(text) if 1 <= len(stand[t]) <= 6 for p in stand[t]}
    assert {tuple(r) for r in queries.p5_found(spark, data).collect()} == want


def test_rare_terms_with_a_full_filter(spark, data):
    want = {tuple(r) for r in queries.p5_found(spark, data).collect()}
    wanted = distinctive.query_terms(spark.read.parquet(f"{data}/benchmark.parquet"))
    passages = spark.read.parquet(f"{data}/passages.parquet")
    assert want == {tuple(r) for r in distinctive.rare(passages, wanted, slots=8).join(wanted, "term").select("item_id", "pid").distinct().collect()}
    all_ = distinctive.weights(passages).withColumnRenamed("weight", "w")
    one = distinctive.rare(passages, wanted).join(all_, ["pid", "term"])
    assert one.count() > 0 and one.where("abs(weight - w) > 1e-9").count() == 0
    assert {(r["item_id"], r["pid"]) for r in queries.p5_passages(spark, data).collect()} == want


def test_graph_of_words(spark):
    rows = [(1, "Gato", "gato perro gatos ratón"), (2, None, "perro"), (3, "", None), (4, "x", "perro " * 30)]
    got = {(r["pid"], r["term"]): r["weight"] for r in distinctive.weights(docs(spark, rows, "pid long, title string, text string")).collect()}
    assert got[1, "gato"] == pytest.approx(2 * np.log1p(3 / 1)) and got[1, "perro"] == pytest.approx(2 * np.log1p(3 / 3)) and got[2, "perro"] == 0 and got[4, "perro"] == 0
    assert distinctive.weights(docs(spark, [], "pid long, title string, text string")).count() == 0


# --- 6 ---


def test_languages_held_out(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet")
    machines = language.trained(d.where("doc_id % 2 = 0"))
    segments = language.segmented(d.where("doc_id % 2 = 1"), machines)
    rows = language.document_languages(segments).where("label in ('es', 'en', 'fr', 'pt') and lang is not null").collect()
    assert np.mean([r["label"] == r["lang"] for r in rows]) > 0.85


def test_languages_of_odd_rows(spark, data):
    d = spark.read.parquet(f"{data}/documents.parquet")
    machines = language.trained(d)
    es = "La relación entre la fuerza y el campo se mide en silencio y cambia cada mañana. Por eso, hay que distinguir la fuerza del campo general. "
    en = "The relation between the force and the field is measured quietly and shifts every morning. Thus, one must tell the force from the field. "
    rows = [(1, es, "spa"), (2, es, "en"), (3, es + en, "es"), (4, None, None), (5, "", "es"), (6, es, " ES-mx"), (7, es, "und"), (8, "ok", None), (9, es + "Dijo «the force» ayer.", "es")]
    found = language.found(language.segmented(docs(spark, rows, "doc_id long, text string, lang string").drop("key"), machines))
    assert {tuple(r) for r in found.collect()} == {(2, "es"), (3, "es"), (3, "en"), (7, "es")}
    assert language.trained(docs(spark, [], "doc_id long, text string, lang string")) is None
    assert language.found(language.segmented(docs(spark, rows, "doc_id long, text string, lang string"), None)).count() == 0


# --- 7 ---


def test_subjects(spark):
    areas = spark.createDataFrame([("ley", "es", "juez"), ("bio", "es", "célula")], "domain string, lang string, keyword string")
    law = "El juez dicta la condena en el pleito y el juez revisa el pleito con la condena que pide el fiscal de la sala. "
    life = "La célula tiene un núcleo y la célula guarda el núcleo junto a la membrana que rodea el tejido de la planta. "
    rows = [(i, law, "Ley ") for i in range(5)] + [(10 + i, life, "BIO") for i in range(5)] + [(20, law.replace("juez", "x"), None), (21, law + life, None), (22, "Nada de esto trata de algo y cada cosa es como otra cosa que no se dice aquí en tanto que sí se calla.", None), (23, None, "bio"), (24, "", None), (25, law, "bio")]
    p = subjects.profiles(docs(spark, rows, "doc_id long, text string, domain string"), areas)
    got = {(r["doc_id"], r["domain"]) for r in subjects.found(p, subjects.propagated(p)).collect()}
    assert got == {(i, "ley") for i in (*range(5), 20, 21, 25)} | {(i, "bio") for i in (*range(10, 15), 21)}
    none = subjects.profiles(docs(spark, [], "doc_id long, text string, domain string"), areas)
    assert subjects.found(none, subjects.propagated(none)).count() == 0


def test_subjects_by_joins_as_by_passes(spark, data):
    p = subjects.profiles(spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/subject_areas.parquet"))
    one, two = ({(r["id"], r["label"]): r["weight"] for r in subjects.propagated(p, most_terms=n).collect()} for n in (subjects.TERMS, 0))
    assert one.keys() == two.keys() and len(one) > 50 and all(abs(one[k] - two[k]) < 1e-3 * max(1, two[k]) for k in one)


def test_subjects_over_long_paths(spark):
    areas = spark.createDataFrame([("ley", "es", "juez"), ("bio", "es", "célula")], "domain string, lang string, keyword string")
    rest = "Nada de esto trata de algo y cada cosa es como otra cosa que no se dice aquí en tanto que sí se calla. "
    links = ["El juez dicta la condena y el juez revisa la condena. ", "Una condena y el pleito con un pleito. ", "El pleito y el fiscal con un fiscal. ", "Un fiscal en la sala y la sala. ", "La sala y el acta con un acta. "]
    rows = [(10 * j + i, x + rest, "ley" if j == 0 else None) for j, x in enumerate(links) for i in range(5)] + [(100 + i, "La célula tiene un núcleo y la célula guarda el núcleo. " + rest, "bio") for i in range(5)]
    p = subjects.profiles(docs(spark, rows, "doc_id long, text string, domain string"), areas)
    got = {(r["doc_id"], r["domain"]) for r in subjects.found(p, subjects.propagated(p)).collect()}
    assert got == {(i, "ley" if i < 100 else "bio") for i, _, _ in rows}


# --- 8 and 10 ---


def long_texts() -> dict[int, str]:
    rng = random.Random(1)
    plain = "".join(rng.choice(["palabra", " ", "\n\n", "ñandú", "!?", "  ", "123", "👩‍🔬", "it's "]) for _ in range(40_000))
    return {1: plain, 2: "a" * 70_000, 3: " " * 70_000, 4: "x" + " " * 40_000 + "fin. " * 5_000, 5: "corto", 6: "línea larga " * 6_000}


def test_stitched_ids(spark):
    texts = long_texts()
    del texts[2]  # slow to encode whole; tokens.stitched joins its chunks, see below
    rows = [*texts.items(), (7, None), (8, ""), (5, "corto")]
    got = tokens.encoded(docs(spark, rows)).collect()
    encode = tokens.encoder()
    assert len(got) == len(rows)
    for r in got:
        text = dict(rows)[r["doc_id"]] or ""
        assert r["ids"] == encode(text) and tokens.decode(r["ids"]) == text
    counts = {r["doc_id"]: r["n_tokens"] for r in tokens.counted(docs(spark, rows)).collect()}
    assert counts[1] == len(encode(texts[1])) and counts[7] == 0 and counts[5] == 2 * len(encode("corto"))


def test_stitched_pieces_restore_the_text(spark):
    got = defaultdict(str)
    for r in tokens.stitched(spark.createDataFrame(list(long_texts().items()), "key long, text string")).orderBy("key", "at").collect():
        assert len(got[r["key"]]) == r["at"]
        got[r["key"]] += r["text"]
    assert got == long_texts()


@pytest.mark.parametrize("name", ["word_bpe_49k", "piece_bpe_32k", "byte_bpe_multi_50k"])
def test_other_tokenizers(spark, name):
    got = {r["doc_id"]: r["ids"] for r in tokens.encoded(docs(spark, [(1, "hola mundo"), (2, None)]), name=name).collect()}
    assert got == {1: list(tokens.encoder(name)("hola mundo")), 2: []}


def test_pieces(spark):
    texts = long_texts()
    rows = [*texts.items(), (7, None), (8, "")]
    encode, limit, overlap = tokens.encoder(), 500, 32
    ranges, tables = pieces.ranges_of(docs(spark, rows), limit, overlap)
    got = pieces.emitted(ranges, pieces.spans(tables, limit)).collect()
    assert {r["key"] for r in got} == {i for i, t in texts.items() if len(t) > 3000 and (i == 2 or len(encode(t)) > limit)}
    for i in {r["key"] for r in got}:
        rs = sorted((r for r in got if r["key"] == i), key=lambda r: r["piece"])
        assert rs[0]["start"] == 0 and rs[-1]["end"] == len(texts[i])
        for r in rs:
            assert r["text"] == texts[i][r["start"] : r["end"]] and len(encode(r["text"])) <= limit
        for a, b in zip(rs, rs[1:]):
            assert a["start"] < b["start"] < a["end"]
            if i in (1, 6):
                assert overlap - 2 <= len(encode(texts[i][b["start"] : a["end"]])) <= 2 * overlap
    assert pieces.limits_of(spark.createDataFrame([], "tokenizer string, max_tokens int, overlap_tokens int")) == ("byte_bpe_50k", 2048, 64)


def test_long_words_count_exactly(spark):
    rng = random.Random(4)
    word = "".join(rng.choice("abcdefghijklmnñé") for _ in range(1500))
    encode = tokens.encoder()
    rest = " uno dos tres cuatro cinco." * 400
    while len(encode(word + rest)) > 2045:
        rest = rest[:-1]
    rows = [(1, word + rest), (2, word + rest + " y algo más y otra cosa"), (3, "¡" * 3000 + "'s " + word * 3)]
    ranges, tables = pieces.ranges_of(docs(spark, rows), 2048, 64)
    assert {r["key"]: r["n_tokens"] for r in pieces.oversized(tables, 2048).collect()} == {i: n for i, t in rows if (n := len(encode(t))) > 2048}
    for r in pieces.emitted(ranges, pieces.spans(tables, 2048)).collect():
        assert r["n_tokens"] == len(encode(r["text"])) <= 2048


@pytest.mark.parametrize("name", ["word_bpe_49k", "piece_bpe_32k"])
def test_limits_of_other_tokenizers(spark, name):
    encode, text = tokens.encoder(name), "Una frase corta que dice algo; otra que dice más cosas. " * 3000
    ranges, tables = pieces.ranges_of(docs(spark, [(1, text), (2, text[:700]), (3, None)]), 400, 20, name=name)
    assert {r["key"]: r["n_tokens"] for r in pieces.oversized(tables, 400).collect()} == {1: len(encode(text))}
    got = sorted(pieces.emitted(ranges, pieces.spans(tables, 400)).collect(), key=lambda r: r["piece"])
    assert len(got) > 2 and all(len(encode(r["text"])) <= 400 for r in got) and got[-1]["end"] == len(text)


def test_files_by_ranges_of_bytes(spark, tmp_path):
    texts = [long_texts()[1], "ñandú 👩‍🔬 corre. " * 30_000, "", "corto"]
    paths = []
    for i, t in enumerate(texts):
        (tmp_path / f"{i}.txt").write_bytes(t.encode("utf-8"))
        paths.append(str(tmp_path / f"{i}.txt"))
    got = defaultdict(str)
    for r in tokens.stitched_chunks(tokens.file_chunks(spark, paths)).orderBy("key", "at").collect():
        assert len(got[r["key"]]) == r["at"]
        got[r["key"]] += r["text"]
    assert [got[i] for i in range(4)] == texts
    ranges, tables = pieces.file_ranges(spark, paths, 500, 32)
    encode = tokens.encoder()
    assert {r["key"]: r["n_tokens"] for r in pieces.oversized(tables, 500).collect()} == {i: n for i, t in enumerate(texts) if (n := len(encode(t))) > 500}


def test_a_word_over_many_chunks(spark):
    rng = random.Random(6)
    texts = {1: "".join(rng.choice("abcdeñ") for _ in range(100_000)), 2: "x " + "".join(rng.choice("<>=+*") for _ in range(80_000)) + " fin", 3: "uno " + "".join(rng.choice(" \n\t") for _ in range(70_000)) + "dos"}
    pieces_of = tokens.stitched(spark.createDataFrame(list(texts.items()), "key long, text string")).collect()
    assert Counter(r["key"] for r in pieces_of) == {1: 4, 2: 3, 3: 3} and max(len(r["text"]) for r in pieces_of) < 2 * tokens.CHUNK
    encode = tokens.encoder()
    got = {r["doc_id"]: r["ids"] for r in tokens.encoded(docs(spark, list(texts.items()))).collect()}
    assert all(got[i] == encode(t) for i, t in texts.items())


def test_pieces_cut_at_paragraphs(spark):
    para = "Una frase corta que dice algo. Otra frase que dice más cosas. " * 4
    text = (para.strip() + "\n\n") * 20
    ranges, tables = pieces.ranges_of(docs(spark, [(1, text)]), 400, 16)
    got = sorted(pieces.emitted(ranges, pieces.spans(tables, 400)).collect(), key=lambda r: r["piece"])
    assert len(got) > 2 and all(r["text"].endswith("\n\n") for r in got)


# --- 9 ---


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, s, "palabra " * rng.randrange(1, 60)) for i, s in enumerate(["a"] * 900 + ["b"] * 300 + ["c"] * 100 + ["z"] * 50)] + [(5000, None, "x"), (5001, "a", None)]
    d = docs(spark, rows, "doc_id long, source string, text string")
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 2), ("c", 0.1, 4), ("none", 0.1, 3)], "source string, target_share double, max_repeats int")
    sizes = mixing.sized(d)
    rate = {r["source"]: r for r in mixing.rates(sizes, targets).collect()}
    copies = mixing.mixed(sizes, targets).collect()
    n = Counter(r["doc_id"] for r in copies)
    source = {i: s for i, s, _ in rows}
    for i, k in n.items():
        assert int(rate[source[i]]["rate"]) <= k <= rate[source[i]]["max_repeats"]
    share = {r["source"]: r["actual_share"] for r in mixing.shares(sizes, targets).collect()}
    assert abs(share["a"] - 0.5 / 0.9) < 0.05 and abs(share["b"] - 0.3 / 0.9) < 0.05 and share["none"] == 0 and "z" not in share
    assert sorted(map(tuple, copies)) == sorted(map(tuple, mixing.mixed(sizes.repartition(3), targets).collect()))
    twice = mixing.sized(docs(spark, [(1, "a", "uno dos"), (1, "b", "tres"), (1, None, None)], "doc_id long, source string, text string")).collect()
    assert [(r["doc_id"], r["source"], r["n_tokens"]) for r in twice] == [(1, "a", sum(len(tokens.encoder()(x)) for x in ("uno dos", "tres")))]
    assert mixing.mixed(mixing.sized(docs(spark, [], "doc_id long, source string, text string")), targets).count() == 0


def test_shingles():
    w = words.word_hashes(words.folded_words("Él dijo: «sí», él DIJO si"))
    assert len(np.unique(words.shingle_hashes(w, 3))) == 3 and len(words.shingle_hashes(w[:2], 3)) == 0
