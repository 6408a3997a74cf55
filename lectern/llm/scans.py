"""Problem 2: noise in text from scanned pages.

Method.  Skip-gram vectors of the frequent words are learned over all pages; rare words are
linked to frequent neighbours that plausible glyph edits lead to and corrected in context;
running headers and page numbers are removed and the rest is reflowed.

* Furniture: a line at the edge of a page is a running header or footer if lines of the
  same glyph key stand at the edges of another page of the file; it is a page number if it
  reads as one and its distance to the page's place agrees with another page, or if it is
  dressed as one (``Page 3 of 9``, ``- 3 -``).
* Glyph key: a folding under which all usual confusions of a scanner (0 o, 1 l i |, rn m, cl d,
  c e, f t, h b li, ...) coincide.  Words of one key are a plausible edit apart, so rare words
  meet their frequent neighbours by an equality join, not by comparing all words.
* Frequent words, those that others may be a misreading of, are seen ``LEAST_COUNT`` times whatever the
  corpus, and are joined.  Context words, the frequent ones that the words around are reduced to, have
  a relative frequency of at least ``FREQUENT``: at most 1 / FREQUENT of them, and so are the only
  list that is broadcast.
* Vectors: for each frequent word, its shifted positive pointwise mutual information with
  the context words around it - the matrix that skip-gram with negative sampling
  factorises - projected to ``DIM`` dimensions by hashed signs.
* Of a frequent word, a share of at most ``RATE`` is misread in one way.  A rare word seen no more
  often than that beside its frequent neighbour is an error unless the words around speak against
  the neighbour; one seen up to two standard deviations more often is one only if, by the vectors,
  the neighbour is at home among them.
* A token that blends letters with digits or signs is misread however often it is seen, and the page has ``ocr`` even where
  no frequent word is near.  Its neighbour is the frequent word of its key, accents aside, that takes the fewest edits, unless
  the words around speak against it.
* The words around speak against it if they are found beside the neighbour far less often than
  chance has it (``AGAINST``, log odds), at this place or at all places of the rare word together.
  The vectors can't say so, since they hold positive information only.  Words of one or two letters
  with no words around are left alone.
* A word divided at the end of a line counts unless its two parts are more often seen joined
  by a hyphen within lines than written as one word.

Null and blank pages have no noise and no paragraphs.  Repeated rows of a page count once (the
least text is taken if they differ).  Missing pages divide the text: nothing is joined across
them.  Rows without an id or a page are left out.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.session import materialize

FREQUENT, LEAST_COUNT, RATE, DIM, AROUND = 2e-6, 3, 0.05, 64, 3
AGAINST = -5.0
EDGE = 3
#: Each glyph as the strokes that a scanner may tell apart otherwise.
_STROKES = str.maketrans({
    "0": "o", "6": "o", "@": "a", "1": "l", "|": "l", "!": "l", "i": "l", "9": "g", "5": "s", "c": "e", "f": "t", "8": "ll", "b": "ll", "h": "ll", "u": "ll", "m": "rn", "d": "el", "ﬁ": "tl", "ﬂ": "tl",
})
_ACCENTS = str.maketrans("éóñ", "oon")
_LIGATURES = str.maketrans({"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl"})
_DIGITS = str.maketrans({"l": "1", "I": "1", "|": "1", "i": "1", "O": "0", "o": "0", "S": "5", "s": "5", "B": "8", "g": "9", "@": "0", "Z": "2"})
_NUM = r"([0-9lI|iOoSsBg@]*[0-9][0-9lI|iOoSsBg@]*)"
_DRESSED = re.compile(rf"^[\s\-–—·~\[\]().|]*(?:p[aáo@](?:g|9)(?:[eo]|ina|\.)?\s+|p[aáo@]g[ií1l|]n[a@]\s+|p[.á]g?\.?\s*){_NUM}(?:\s*(?:/|of|0f|de|dc|sur|d[eo])\s*{_NUM})?[\s\-–—·~\[\]().|]*$", re.I)
_FRAMED = re.compile(rf"^\s*(?:[-–—·~]\s*{_NUM}\s*[-–—·~]|\[\s*{_NUM}\s*\]|{_NUM}\s*/\s*{_NUM})\s*$")
_PLAIN = re.compile(rf"^\s*{_NUM}\s*$")
_ROMAN = re.compile(r"^\s*[-–—·\[(]?\s*(x{0,4}(?:ix|iv|v?i{0,4}|[vl1|][il1|]{0,4}))\s*[-–—·\])]?\s*$", re.I)
_SIDE = re.compile(rf"^\s*{_NUM}\s{{2,}}(\S.*)$|^(\s*\S.*?)\s{{2,}}{_NUM}\s*$")
_ENDS = (".", ",", ";", ":", "?", "!")
_WORD = re.compile(r"[^\W\d_]+")
_COMPOUND = re.compile(r"(?<![\w-])([^\W\d_]+)-([^\W\d_]+)(?![\w-])")
_BREAK = re.compile(r"([^\W_][\w@|]*)([-–\xad¬])\s*$")
_HYPHENS = ("-", "–", "\xad", "¬")
_FIRST = re.compile(r"^\s*([^\W_@|][\w@|]*|[@|]\w+)")
_BLEND = re.compile(r"(?:[^\W\d_]|[@|~])*(?:[^\W\d_][0-9@|~]|[0-9@|~][^\W\d_])[\w@|~]*")
_BLENDS = re.compile(r"[@|~]|[0-9][^\W\d_]|[^\W\d_][0-9]")
_MIXED, _CODE = re.compile(r"[0-9@|~]"), re.compile(r"[2347]")
_MISREAD_NUMBER = re.compile(r"(?=\D*\d\D*\d)[0-9lI|oO]*\d")
_UNITS = re.compile(r"^\d+(?:st|nd|rd|th|er|re|e|a|o|º|ª|km|m|cm|mm|kg|g|h|s|C|D)$|\w@\w+\.\w")


_TOKEN = re.compile(r"[\w@|~]+")
_keys: dict[str, str] = {}


def key(word: str) -> str:
    """Glyph key of a word or line: letters only, confusable glyphs as one."""
    if (k := _keys.get(word)) is None:
        if len(_keys) > 300_000:
            _keys.clear()
        k = "".join(word.lower().translate(_STROKES).split())
        _keys[word] = k = k if k.isalpha() else "".join(filter(str.isalpha, k))
    return k


def words_of(text: str) -> tuple[list[str], list[tuple[int, str]]]:
    """Words in small letters, without tokens that blend letters with digits or signs; and such tokens, units apart, each with the number of words before it."""
    out, blends = [], []
    for token in _TOKEN.findall(text):
        if token.isalpha():
            out.append(token.lower())
        elif not token.isdigit():
            blends += [(len(out), m.lower()) for m in _BLEND.findall(token) if not _UNITS.search(m)]
            out += [w.lower() for w in _WORD.findall(_BLEND.sub(" ", token))]
    return out, blends


def line_key(line: str) -> str:
    """Key of a header, in which accents may be misread as well."""
    return key(line.lower().translate(_ACCENTS))


def number(line: str) -> tuple[int, bool] | None:
    """(the page number a line reads as, whether it is dressed as one)."""
    for pattern in (_DRESSED, _FRAMED):
        if m := pattern.match(line):
            return int(next(g for g in m.groups() if g).translate(_DIGITS)[:9]), True
    if m := _PLAIN.match(line):
        return int(m.group(1).translate(_DIGITS)[:9]), False
    if (m := _ROMAN.match(line)) and m.group(1):
        return roman(m.group(1).lower().replace("l", "i").replace("1", "i").replace("|", "i")), len(m.group(1)) > 1
    return None


def roman(s: str) -> int:
    values = [{"i": 1, "v": 5, "x": 10}[c] for c in s]
    return sum(-v if any(w > v for w in values[i + 1 : i + 2]) else v for i, v in enumerate(values))


def edge_lines(text: str | None) -> list[int]:
    """Places of the lines at the edges of a page."""
    full = [i for i, s in enumerate((text or "").split("\n")) if s.strip()]
    return sorted({*full[:EDGE], *full[-EDGE:]})


def readings(line: str) -> list[tuple[str, object, bool]]:
    """What a line at an edge may be: ('n', number, dressed) and ('h', glyph key, has a number beside it)."""
    if n := number(line):
        return [("n", n[0], n[1])]
    out: list[tuple[str, object, bool]] = []
    side = _SIDE.match(line)
    body = (side.group(2) or side.group(3)) if side else line
    if not body.strip().endswith(_ENDS) and len(k := line_key(body)) >= 5:
        out.append(("h", k, bool(side)))
        if side:
            out.append(("n", int((side.group(1) or side.group(4)).translate(_DIGITS)[:9]), False))
    return out


def _edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        rows = []
        for doc, page, text in zip(p["doc_id"], p["page"], p["text"]):
            lines = (text or "").split("\n")
            for i in edge_lines(text):
                for kind, what, _ in readings(lines[i]):
                    rows.append((doc, page, kind, what if kind == "h" else str(what - page)))
        yield pd.DataFrame(rows, columns=["doc_id", "page", "kind", "what"])


def page_rows(df: DataFrame, id_col: str = "doc_id", page_col: str = "page", text_col: str = "text") -> DataFrame:
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(page_col).cast("int").alias("page"), F.col(text_col).alias("text")).where("doc_id is not null and page is not null")
    return rows.groupBy("doc_id", "page").agg(F.min("text").alias("text"))


def with_furniture(pages: DataFrame) -> DataFrame:
    """Pages with the glyph keys and number offsets that their edges share with another page of the file."""
    edges = materialize(pages.mapInPandas(_edges, "doc_id long, page int, kind string, what string").distinct(), "edges")
    shared = edges.groupBy("doc_id", "kind", "what").agg(F.count("*").alias("n")).where("n > 1")
    per = edges.join(shared, ["doc_id", "kind", "what"]).groupBy("doc_id", "page").agg(
        F.collect_set(F.when(F.col("kind") == "h", F.col("what"))).alias("heads"), F.collect_set(F.when(F.col("kind") == "n", F.col("what"))).alias("offsets")
    )
    numbered = shared.where("kind = 'n'").select("doc_id").distinct().withColumn("numbered", F.lit(True))
    return materialize(pages.join(per, ["doc_id", "page"], "left").join(numbered, "doc_id", "left").select("doc_id", "page", "text", "heads", "offsets", F.coalesce("numbered", F.lit(False)).alias("numbered")), "pages")


def furniture(text: str, page: int, heads: set, offsets: set, numbered: bool) -> tuple[set[int], bool, bool]:
    """(places of the lines that are furniture, has a header, has a page number)."""
    lines, out, header, num = text.split("\n"), set(), False, False
    edge = edge_lines(text)
    for i in edge:
        may_be = readings(lines[i])
        for kind, what, dressed in may_be:
            if kind == "h" and what in heads:
                out.add(i)
                header, num = True, num or dressed
            elif kind == "n" and i not in out and len(may_be) == 1:
                if str(what - page) in offsets or dressed or not numbered and what < 1000 and i in (edge[0], edge[-1]):
                    out.add(i)
                    num = True
    return out, header, num


def examine(text: str | None, page: int, heads, offsets, numbered: bool) -> dict:
    """What one page shows by itself: furniture, divided words, blended tokens, its words."""
    empty = {"header": False, "page_number": False, "blend": False, "breaks": [], "words": [], "blends": [], "compounds": [], "first": None, "body": ""}
    if not text or not text.strip():
        return empty
    if any(c in text for c in "ﬁﬂﬀﬃﬄ"):
        text = text.translate(_LIGATURES)
    off, header, num = furniture(text, page, set(heads if heads is not None else ()), set(offsets if offsets is not None else ()), numbered)
    lines = text.split("\n")
    body = [s for i, s in enumerate(lines) if i not in off]
    while body and not body[-1].strip():
        body.pop()
    breaks, joined, skip = [], [], ""
    full = [s for s in body if s.strip()]
    for i, s in enumerate(full):
        rest = s[len(skip) + s.index(skip) :] if skip else s
        skip = ""
        if rest.rstrip()[-1:] in _HYPHENS and (m := _BREAK.search(rest)):
            n = _FIRST.match(full[i + 1]) if i + 1 < len(full) else None
            if i + 1 == len(full) or n:
                breaks.append((m.group(1), n.group(1) if n else None, m.group(2)))
                rest = rest[: m.start()]
                skip = n.group(1) if n else ""
        joined.append(rest)
    flat = " ".join(joined)
    compounds = [f"{a}-{b}".lower() for a, b in _COMPOUND.findall(flat)]
    heads_text = " ".join(lines[i] for i in off)
    words, blends = words_of(flat)
    in_heads, _ = words_of(heads_text)
    words += [""] * AROUND + [w for w in in_heads if len(w) > 1]
    blend = _BLENDS.search(text) is not None and bool(words_of(text)[1])
    first = _FIRST.match(full[0]) if full else None
    return {"header": header, "page_number": num, "blend": blend, "breaks": breaks, "words": words, "blends": blends, "compounds": compounds, "first": first.group(1) if first else None, "body": "\n".join(body)}


def mapped(df: DataFrame, f, ddl: str, rows: int = 500) -> DataFrame:
    """``mapInPandas`` in slices of ``rows``: a page becomes hundreds of words, and a worker holds those of one slice only."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = (b.slice(at, rows).to_pandas() for b in batches for at in range(0, b.num_rows, rows))
        for out in f(slices):
            yield pa.RecordBatch.from_pandas(out, schema, preserve_index=False)

    return df.mapInArrow(run, ddl)


_EXAMINED = "doc_id long, page int, header boolean, page_number boolean, blend boolean, breaks array<struct<a:string, b:string, mark:string>>, words array<string>, blends array<struct<at:int, word:string>>, compounds array<string>, first string, body string"


def _examine_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        rows = [examine(*r) for r in zip(p["text"], p["page"], p["heads"], p["offsets"], p["numbered"])]
        out = pd.DataFrame(rows, columns=["header", "page_number", "blend", "breaks", "words", "blends", "compounds", "first", "body"])
        out["breaks"] = [[{"a": a, "b": b, "mark": c} for a, b, c in x] for x in out["breaks"]]
        out["blends"] = [[{"at": at, "word": w} for at, w in x] for x in out["blends"]]
        out.insert(0, "page", p["page"].to_numpy()), out.insert(0, "doc_id", p["doc_id"].to_numpy())
        yield out


def examined(df: DataFrame, **columns) -> DataFrame:
    return materialize(mapped(with_furniture(page_rows(df, **columns)), _examine_batches, _EXAMINED), "examined")


def _key(column):
    return F.pandas_udf(lambda s: s.map(lambda w: key(w) if w else ""), "string")(column)


def divisions(pages: DataFrame) -> DataFrame:
    """Each word divided at the end of a line or page: (doc_id, page, a, b, joined, over: the next page has b)."""
    each = pages.select("doc_id", "page", F.explode("breaks").alias("x")).select("doc_id", "page", "x.*")
    following = pages.select("doc_id", (F.col("page") - 1).alias("page"), "first")
    each = each.join(following, ["doc_id", "page"], "left").withColumn("over", F.col("b").isNull()).withColumn("b", F.coalesce("b", "first")).drop("first")
    each = each.withColumn("joined", F.concat(F.lower("a"), F.coalesce(F.lower("b"), F.lit(""))))
    each = materialize(each.withColumn("key", _key("joined")), "divided")
    plain = pages.select(F.explode("words").alias("w")).where("length(w) > 3").groupBy("w").count().select(_key("w").alias("key"), "count").groupBy("key").agg(F.sum("count").alias("plain"))
    hyphened = pages.select(F.explode("compounds").alias("w")).groupBy("w").count().select(_key("w").alias("key"), "count").groupBy("key").agg(F.sum("count").alias("hyphened"))
    known = each.join(hyphened, "key", "left").join(plain, "key", "left")
    own = (F.col("mark").isin("-", "–")) & (F.coalesce("hyphened", F.lit(0)) > F.coalesce("plain", F.lit(0)))
    return known.where(~own).select("doc_id", "page", "a", "b", "joined", "over")


def _misread_at_most(n):
    """Column: how often one misreading of a word of n sightings is seen, with two standard deviations to spare."""
    return RATE * n + 2 * F.sqrt(RATE * n)


def frequent_words(pages: DataFrame) -> DataFrame:
    """(word, n, key, context: whether it is a context word) of the words frequent enough, without those that may be a misreading of a more frequent word of their key."""
    counts = materialize(pages.select(F.explode("words").alias("word")).where("word != ''").groupBy("word").agg(F.count("*").alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    often = counts.where(F.col("n") >= LEAST_COUNT).withColumn("key", _key("word"))
    most = often.groupBy("key").agg(F.max("n").alias("most"))
    return materialize(often.join(most, "key").where(F.col("n") > _misread_at_most(F.col("most"))).select("word", "n", "key", (F.col("n") >= FREQUENT * total).alias("context")), "frequent")


def _sign(word: str) -> np.ndarray:
    bits = np.frombuffer(xxhash.xxh64_digest(word), np.uint8)
    return np.unpackbits(bits).astype(np.float32) * 2 - 1


def _pair_batches(context: frozenset):
    """Pairs of a word and a context word near it, both ways."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            index: dict[str, int] = {"": 0}
            ids = []
            for words in p["words"]:
                ids += [index.setdefault(w, len(index)) for w in words]
                ids += [0] * AROUND
            names, x = np.array(list(index), dtype=object), np.array(ids, np.int64)
            near = np.fromiter((w in context for w in index), bool, len(index))
            keys = []
            for k in range(1, AROUND + 1):
                for a, b in ((x[:-k], x[k:]), (x[k:], x[:-k])):
                    keep = (a > 0) & near[b]
                    keys.append(a[keep] * len(index) + b[keep])
            key_, n = np.unique(np.concatenate(keys), return_counts=True)
            yield pd.DataFrame({"a": names[key_ // len(index)], "b": names[key_ % len(index)], "n": n})

    return run


def _project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial sums of PMI times the context's signs, per word and batch."""
    for p in batches:
        signs = {b: _sign(b) for b in set(p["b"])}
        sums: dict[str, np.ndarray] = {}
        for a, b, v in zip(p["a"], p["b"], p["pmi"]):
            sums[a] = sums.get(a, 0) + v * signs[b]
        yield pd.DataFrame({"word": list(sums), "part": [v.astype(float) for v in sums.values()]})


def neighbours(pages: DataFrame, frequent: DataFrame, context: frozenset) -> DataFrame:
    """(a, b, n): how often the context word b is among the words around the frequent word a."""
    pairs = mapped(pages.select("words"), _pair_batches(context), "a string, b string, n long", 2000)
    pairs = pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))
    return materialize(pairs.join(frequent.select(F.col("word").alias("a")), "a", "left_semi").select("a", "b", "n"), "pairs")


def vectors(pairs: DataFrame, shift: float = 1.0) -> DataFrame:
    """(word, vector) of the frequent words."""
    total = pairs.agg(F.sum("n")).first()[0] or 1
    size = pairs.groupBy("a").agg(F.sum("n").alias("size"))
    rated = pairs.join(size, "a").join(pairs.groupBy("b").agg(F.sum("n").alias("other")), "b")
    rated = rated.withColumn("pmi", F.log(F.col("n") * F.lit(float(total)) / F.col("size") / F.col("other")) - shift).where("pmi > 0")
    parts = rated.select("a", "b", "pmi").mapInPandas(_project, "word string, part array<double>")
    sums = [F.sum(F.col("part")[i]) for i in range(DIM)]
    return materialize(parts.groupBy("word").agg(F.array(*sums).alias("vector")), "vectors")


def _rare_batches(context: frozenset):
    """Sightings of all words but the context words, and of tokens that blend letters with digits or signs, with the context words around.

    A blend may be read with another accent, so its key is that of a header.  Digits that look like no letter make it a code, which has no neighbour."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for doc, page, words, blends, divided in zip(p["doc_id"], p["page"], p["words"], p["blends"], p["divided"]):
                for i, w in enumerate(words):
                    if w and w not in context:
                        around = [x for x in (*words[max(0, i - AROUND) : i], *words[i + 1 : i + 1 + AROUND]) if x in context]
                        rows.append((doc, page, w, key(w), around, None, False))
                for x in blends:
                    if not _CODE.search(w := x["word"]):
                        around = [c for c in words[max(0, x["at"] - AROUND) : x["at"] + AROUND] if c in context]
                        rows.append((doc, page, w, line_key(w), around, None, False))
                for d in divided if divided is not None else ():
                    if (w := d["joined"]) not in context:
                        rows.append((doc, page, w, line_key(w) if _MIXED.search(w) else key(w), [], d["a"], d["over"]))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "word", "key", "around", "a", "over"])

    return run


def _at_home(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Adds how far the words around agree with the candidate's vector."""
    for p in batches:
        fit = []
        for around, v in zip(p["around"], p["vector"]):
            v = np.asarray(v, float) if v is not None else np.zeros(DIM)
            fit.append(float(np.mean([v @ _sign(c) for c in around]) / DIM) if len(around) else 0.0)
        yield p.drop(columns=["around", "vector"]).assign(fit=fit)


def spoken(asked: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, said, together): the log odds that the words around a sighting give its neighbour, and those of all sightings of the word, each within ``AGAINST``."""
    total = pairs.agg(F.sum("n")).first()[0] or 1
    size = pairs.groupBy("a").agg(F.sum("n").alias("size"))
    each = asked.select("id", "word", F.col("meant").alias("a"), F.explode("around").alias("b")).join(pairs, ["a", "b"], "left")
    each = each.join(size, "a", "left").join(pairs.groupBy("b").agg(F.sum("n").alias("other")), "b", "left")
    chance = F.coalesce(F.col("size") * F.col("other") / F.lit(float(total)), F.lit(0.0))
    said = materialize(each.groupBy("id", "word").agg(F.sum(F.log((F.coalesce("n", F.lit(0)) + 1) / (chance + 1))).alias("said")), "said")
    of_word = said.groupBy("word").agg(F.sum(F.greatest(F.least("said", F.lit(-AGAINST)), F.lit(AGAINST))).alias("together"))
    return said.join(of_word, "word").select("id", "said", "together")


def misread(pages: DataFrame, divided: DataFrame) -> DataFrame:
    """(doc_id, page, word, meant) of rare words that are a frequent neighbour misread."""
    frequent = frequent_words(pages)
    context = frozenset(r["word"] for r in frequent.where("context").select("word").collect())  # at most 1 / FREQUENT
    joined = divided.where("b is not null").groupBy("doc_id", "page").agg(F.collect_list(F.struct("joined", "a", "over")).alias("divided"))
    source = pages.select("doc_id", "page", "words", "blends").join(joined, ["doc_id", "page"], "left")
    rare = materialize(mapped(source, _rare_batches(context), "doc_id long, page int, word string, key string, around array<string>, a string, over boolean"), "rare")
    # The rest of a word that the page before divides is no word.
    rests = divided.where("over and b is not null").select("doc_id", (F.col("page") + 1).alias("page"), F.lower("b").alias("word")).join(pages.select("doc_id", "page", F.lower("first").alias("word")), ["doc_id", "page", "word"])
    rare = rare.join(rests.distinct(), ["doc_id", "page", "word"], "left_anti")
    counts = rare.groupBy("word").agg(F.count("*").alias("seen"))
    best = frequent.groupBy("key").agg(F.max_by("word", F.struct("n", "word")).alias("meant"), F.max("n").alias("n"))
    mixed = F.col("word").rlike(_MIXED.pattern)
    links = rare.where(~mixed).select("word", "key").distinct().join(frequent, "word", "left_anti").join(best, "key").join(counts, "word").where(F.col("seen") <= _misread_at_most(F.col("n"))).select("word", "meant", "n", "seen")
    # A blend shows by itself that it is misread, however often it is seen; it has most letters of the word that was meant.
    near = frequent.select(F.col("word").alias("meant"), "n", F.pandas_udf(lambda s: s.map(line_key), "string")("word").alias("key"))
    near = rare.where(mixed).select("word", "key").distinct().join(near, "key").groupBy("word").agg(F.min_by(F.struct("meant", "n"), F.struct(F.levenshtein("word", "meant"), -F.col("n"), "meant")).alias("x"))
    links = links.union(near.join(counts, "word").select("word", "x.meant", "x.n", "seen"))
    pairs = neighbours(pages, frequent, context)
    asked = materialize(rare.drop("key").join(links, "word").withColumn("id", F.monotonically_increasing_id()), "asked")
    held = asked.join(vectors(pairs).withColumnRenamed("word", "meant"), "meant", "left").join(spoken(asked, pairs), "id", "left")
    held = held.where(F.when(F.col("said").isNull(), F.length("word") > 2).otherwise((F.col("said") > AGAINST) & (F.col("together") > AGAINST)))
    fitted = held.select("doc_id", "page", "word", "meant", "n", "seen", "a", "over", "around", "vector")
    fitted = mapped(fitted, _at_home, "doc_id long, page int, word string, meant string, n long, seen long, a string, over boolean, fit double", 2000)
    # Of a word divided by the page, the part that differs tells on which page it was misread.
    page = F.col("page") + F.when(F.col("over") & F.startswith(F.col("meant"), F.lower("a")), 1).otherwise(0)
    return fitted.where((F.col("seen") <= RATE * F.col("n")) | (F.col("fit") > 0) | mixed).select("doc_id", page.alias("page"), "word", "meant", "n", "seen", "fit")


def found(pages: DataFrame) -> DataFrame:
    """(doc_id, page, noise)."""
    divided = materialize(divisions(pages), "divisions")
    ocr = misread(pages, divided).select("doc_id", "page").union(pages.where("blend").select("doc_id", "page"))
    kinds = [("hyphen", divided.select("doc_id", "page")), ("header", pages.where("header").select("doc_id", "page")), ("page_number", pages.where("page_number").select("doc_id", "page")), ("ocr", ocr)]
    out = None
    for name, rows in kinds:
        rows = rows.distinct().withColumn("noise", F.lit(name))
        out = rows if out is None else out.union(rows)
    return out


_READ = re.compile(rf"{_BLEND.pattern}|{_WORD.pattern}")
_LEAD = re.compile(r"^\s{2,}\S")


def reflow(body: str, fixes: dict[str, str]) -> list[str]:
    """Paragraphs of a page: wrapped lines joined, divided words mended, misread words and numbers replaced."""
    out, current = [], ""

    def fix(m: re.Match) -> str:
        w = m.group()
        to = fixes.get(w.lower())
        if to is None and _MISREAD_NUMBER.fullmatch(w):
            return w.translate(_DIGITS)
        return w if to is None else to.upper() if w.isupper() and len(w) > 1 else to.capitalize() if w[0].isupper() or w[0] in "58" else to  # 5 and 8 look like capitals

    for line in [*body.split("\n"), ""]:
        s = line.strip()
        if not s or _LEAD.match(line) and current.endswith((".", "?", "!", ":")):
            if current:
                out.append(current)
            current = ""
        if s:
            m = _BREAK.search(current)
            current = (current[: m.end(1)] + ("-" if f"{m.group(1)}-{_FIRST.match(s).group(1) if _FIRST.match(s) else ''}".lower() in fixes else "") if m else current + " " * bool(current)) + s
    return [_READ.sub(fix, p) for p in out]


def _reflow_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for p in batches:
        rows = []
        for doc, page, body, fixes in zip(p["doc_id"], p["page"], p["body"], p["fixes"]):
            known = {f["word"]: f["meant"] for f in fixes} if fixes is not None else {}
            rows += [(doc, page, i, s) for i, s in enumerate(reflow(body or "", known))]
        yield pd.DataFrame(rows, columns=["doc_id", "page", "paragraph", "text"])


#: Pages whose paragraphs one task numbers.
PAGES = 1024


def _before(rows: DataFrame, value: str) -> DataFrame:
    """``rows`` (doc_id, page, ...) with ``offset``: the sum of a column over the pages of the file before, by blocks of pages."""
    rows = rows.withColumn("block", F.floor(F.col("page") / PAGES))
    earlier = Window.partitionBy("doc_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = rows.groupBy("doc_id", "block").agg(F.sum(value).alias("sum")).select("doc_id", "block", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("base"))
    within = Window.partitionBy("doc_id", "block").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(blocks, ["doc_id", "block"]).withColumn("offset", F.col("base") + F.coalesce(F.sum(value).over(within), F.lit(0))).drop("block", "base")


def stitched(rows: DataFrame) -> DataFrame:
    """Paragraphs (doc_id, page, paragraph, text) of pages as those of files: one that a page leaves unfinished goes on with the next page.

    Pages are held against their neighbours and paragraphs numbered by prefix sums, so no task holds a file."""
    rows = materialize(rows, "paragraphs")
    per = rows.groupBy("doc_id", "page").agg(F.count("*").alias("n"), (~F.max_by("text", "paragraph").rlike(r"[.?!:»”]\s*$")).alias("open"))
    goes_on = per.where("open").select("doc_id", (F.col("page") + 1).alias("page"), F.lit(1).alias("joined"))
    per = per.join(goes_on, ["doc_id", "page"], "left").select("doc_id", "page", F.coalesce("joined", F.lit(0)).alias("joined"), (F.col("n") - F.coalesce("joined", F.lit(0))).alias("fresh"))
    numbered = rows.join(_before(per, "fresh"), ["doc_id", "page"]).select("doc_id", (F.col("offset") + F.col("paragraph") - F.col("joined")).cast("int").alias("paragraph"), "page", "text")
    divided = r"(?<=[\p{L}\p{N}_@|])[-–\x{AD}¬]\s*$"
    joined = F.aggregate("parts", F.lit(""), lambda s, x: F.when(s == "", x["text"]).when(s.rlike(divided), F.concat(F.regexp_replace(s, divided, ""), x["text"])).otherwise(F.concat(s, F.lit(" "), x["text"])))
    parts = numbered.groupBy("doc_id", "paragraph").agg(F.min("page").alias("page"), F.max("page").alias("last_page"), F.array_sort(F.collect_list(F.struct("page", "text"))).alias("parts"))
    return parts.select("doc_id", "paragraph", "page", "last_page", joined.alias("text"))


def paragraphs(pages: DataFrame) -> DataFrame:
    """(doc_id, paragraph, page, last_page, text): continuous readable paragraphs of each file."""
    divided = materialize(divisions(pages), "divisions")
    fixes = misread(pages, divided).select("doc_id", "page", F.struct("word", "meant").alias("fix"))
    compounds = pages.select("doc_id", "page", F.explode("breaks").alias("x")).select("doc_id", "page", F.col("x.a").alias("a"), F.col("x.b").alias("b")).where("b is not null")
    own = compounds.join(divided.where("b is not null").select("doc_id", "page", "a", "b"), ["doc_id", "page", "a", "b"], "left_anti")
    own = own.select("doc_id", "page", F.struct(F.lower(F.concat_ws("-", "a", "b")).alias("word"), F.lower(F.concat_ws("-", "a", "b")).alias("meant")).alias("fix"))
    per = fixes.union(own).groupBy("doc_id", "page").agg(F.collect_set("fix").alias("fixes"))
    rows = pages.select("doc_id", "page", "body").join(per, ["doc_id", "page"], "left").mapInPandas(_reflow_batches, "doc_id long, page int, paragraph int, text string")
    return stitched(rows)
