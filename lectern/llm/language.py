"""Problem 6: missing or wrong document language labels.

Method: hierarchical discrimination.  A first linear support vector machine tells the
family (Germanic or Romance); within the Romance family one-versus-one machines
separate each pair of languages and vote.  All are trained here, on at
most ``SAMPLE`` labelled documents of each language (the rows of the least hashes, at most
``SENTENCES`` sentences of each, evenly spread), first
on the labels as they are and then without the sentences that the first machines
put elsewhere, for some labels are wrong.  Features are words and their character
n-grams, so a sentence's score is the sum of scores that each distinct word gets once.

Segments are sentences; neighbours of one language are one segment.  A sentence of
fewer than ``LEAST_WORDS`` words, or without a clear margin, takes the language of its
neighbours.  A document has whole sentences in a second language if those that end like a
sentence, with a margin of at least ``STRONG``, have ten words together.  The confidence is the logistic of the mean margin of the deciding machine.

Null and blank texts get no segment and a language of null with confidence 0.  If no
labelled document is at hand, nothing can be learned and every language is null.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import kinds
from lectern.session import materialize

LANGS = ("es", "fr", "pt", "en")
SAMPLE, SENTENCES, DIM, LEAST_WORDS, MARGIN, STRONG, CLAIM = 250, 40, 1 << 15, 4, 0.25, 0.75, 0.9
#: End of a whole sentence.
_WHOLE = re.compile(r"[.?!…][»”\"')\]*_]*\s*$")
_PAIRS = ((0, 1), (0, 2), (1, 2))
#: Ends of sentences; of paragraphs; of lines that end like a sentence or before an item (others are wrapped lines).
_CUT = re.compile(
    r"[.!?…:;»”\n\t—–](?:(?<=[.!?…])[»”\"')\]]*\s+|(?<=[:;»”])[^\S\n]*\n\s*|(?<=\n)(?:\s*\n\s*|(?=\s*(?:[-*•–—#|<>\[(+]|\d|\w[.)]\s)))|(?<=\t)\t*|(?<=[—–])\s+(?=[A-ZÁÉÍÓÚÀÉÊ¿¡]))"
)
#: Letters of alphabets, with the marks of decomposed accents.
_WORD = re.compile(r"[a-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u0300-\u1fff\u2c00-\u2dff\u3040-\ud7ff]+")
#: Names of the languages as labels write them.
NAMES = {
    "es": "es spa esp español espanol castellano spanish cas",
    "en": "en eng english inglés ingles",
    "fr": "fr fra fre français francais french francés frances",
    "pt": "pt por português portugues portuguese portugués",
}
#: Codes of other languages, which name a language none of these texts is in, and stand-ins for none.
NO_LANGUAGE = ("", "und", "unknown", "auto", "??", "n/a", "none", "null", "mul", "mis", "zxx", "-", "?", "desconocido")


def normalized(label):
    """Column: es, en, fr or pt; another code as it is; null for a missing label."""
    clean = F.lower(F.trim(label))
    base = F.regexp_extract(clean, r"^([^\-_]+)", 1)
    out = F.when(clean.isNull() | clean.isin(*NO_LANGUAGE), F.lit(None).cast("string"))
    for code, names in NAMES.items():
        out = out.when(base.isin(*names.split()), F.lit(code))
    return out.otherwise(base)


def features(word: str) -> np.ndarray:
    w = f"_{word}_"
    grams = [w, *(w[i : i + n] for n in (2, 3, 4) for i in range(len(w) - n + 1))]
    return np.array([xxhash.xxh32_intdigest(g) % DIM for g in grams])


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, end) of each sentence or line."""
    out, at = [], 0
    for m in _CUT.finditer(text):
        if m.end() > at:
            out.append((at, m.end()))
        at = m.end()
    return [*out, (at, len(text))] if at < len(text) else out


def _train(examples: list[tuple[np.ndarray, int]], epochs: int = 2) -> np.ndarray:
    """Averaged Pegasos: a linear machine under hinge loss; examples are (feature ids, +1 or -1)."""
    w, mean, lam, rng = np.zeros(DIM), np.zeros(DIM), 1e-4, np.random.default_rng(5)
    sides = [[i for i, e in enumerate(examples) if e[1] == s] for s in (1, -1)]
    if not all(sides):
        return w
    n, t = 2 * max(map(len, sides)), 0
    order = np.stack([np.concatenate([rng.permutation(s) for _ in range(-(-epochs * n // 2 // len(s)))])[: epochs * n // 2] for s in sides], 1).ravel()
    scale = 1.0
    for i in order:  # both sides alternate, so a rare language weighs as much
        x, y = examples[i]
        t += 1
        eta = 1 / (lam * (t + 1000))
        hit = y * scale * w[x].sum() / len(x) < 1
        scale *= 1 - eta * lam
        if hit:
            np.add.at(w, x, eta * y / len(x) / scale)
        if t % 50 == 0:
            mean += scale * w
    return mean / max(1, t // 50)


def fit(rows: list[tuple[str, str]]) -> np.ndarray | None:
    """4 machines as rows: family (Germanic positive), then es-fr, es-pt, fr-pt."""
    sents, memo = [], {}
    for text, lang in rows:
        for a, b in sentences(text):
            words = _WORD.findall(text[a:b].lower())
            if len(words) >= 6:
                for v in words:
                    if v not in memo:
                        memo[v] = features(v)
                sents.append((np.concatenate([memo[v] for v in words]), LANGS.index(lang)))
    if len({c for _, c in sents}) < 2:
        return None
    for _ in range(2):
        machines = [_train([(x, 1 if c == 3 else -1) for x, c in sents])]
        machines += [_train([(x, 1 if c == i else -1) for x, c in sents if c in (i, j)]) for i, j in _PAIRS]
        m = np.stack(machines)
        told = _decide_all(np.stack([m[:, x].sum(1) / len(x) for x, _ in sents]))[0]
        kept = [e for e, k in zip(sents, told) if e[1] == k]
        if len({c for _, c in kept}) < len({c for _, c in sents}):
            break
        sents = kept
    return m


def _decide_all(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(language, margin) of each row of four scores."""
    votes, margin = np.zeros((len(s), 3)), np.zeros((len(s), 3))
    for k, (i, j) in enumerate(_PAIRS, 1):
        won = s[:, k] > 0
        votes[:, i] += won
        votes[:, j] += ~won
        margin[:, i] += s[:, k] / 2
        margin[:, j] -= s[:, k] / 2
    best = np.argmax(votes + 1e-3 * margin, 1)
    inner = np.minimum(-s[:, 0], margin[np.arange(len(s)), best])
    germanic = s[:, 0] > 0
    return np.where(germanic, 3, best), np.where(germanic, s[:, 0], inner)


class Model:
    """The machines, and the scores of each word seen so far as a row of ``table`` (the last column counts features)."""

    def __init__(self, machines: np.ndarray):
        self.machines, self.index, self.table = machines, {}, np.zeros((1024, len(machines) + 1))

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self.index) > 300_000:
            self.index.clear()
        get = self.index.get
        out = list(map(get, words))
        if None in out:
            for w in set(words).difference(self.index):
                n = self.index[w] = len(self.index)
                if n == len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                f = features(w)
                self.table[n, :-1], self.table[n, -1] = self.machines[:, f].sum(1), len(f)
            out = list(map(get, words))
        return np.array(out, np.int64)

    def segments(self, texts: list[str]) -> list[list[tuple[int, int, int, float, int, int]]]:
        """Of each text (start, end, language, margin, words, words in whole sentences beyond doubt) of each segment."""
        spans, words, sizes, counts = [], [], [], []
        for text in texts:
            lower = text.lower()
            if len(lower) != len(text):  # a few letters change their length; offsets must hold
                lower = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
            found = sentences(text)
            for a, b in found:
                w = [] if text.startswith("<!--", a) else _WORD.findall(lower, a, b)
                words += w
                sizes.append(len(w))
            spans += found
            counts.append(len(found))
        n = np.array(sizes, np.int64)
        score = np.zeros((len(n), self.table.shape[1]))
        if words:
            rows = self.rows(words)
            table = self.table[rows]
            full = np.flatnonzero(n)
            score[full] = np.add.reduceat(table, np.concatenate([[0], np.cumsum(n[full])[:-1]]))
        lang, margin = _decide_all(score[:, :-1] / np.maximum(score[:, -1:], 1))
        clear = (n >= LEAST_WORDS) & (margin >= MARGIN)
        strong = clear & (margin >= STRONG)
        out, at = [], 0
        for text, k in zip(texts, counts):
            out.append(self._joined(text, spans[at : at + k], lang[at : at + k], margin[at : at + k], n[at : at + k], clear[at : at + k], strong[at : at + k], score[at : at + k]))
            at += k
        return out

    @staticmethod
    def _joined(text, spans, lang, margin, n, clear, strong, score):
        if not len(n) or not n.any():
            return []
        if not clear.any():  # the text as a whole decides
            total = score.sum(0)
            k, m = _decide_all((total[:-1] / total[-1])[None, :])
            return [(0, spans[-1][1], int(k[0]), float(m[0]), int(n.sum()), 0)]
        first = int(np.argmax(clear))
        if (lang[clear] == lang[first]).all():  # most texts
            m = float((margin * n)[clear].sum() / n[clear].sum())
            return [(0, spans[-1][1], int(lang[first]), m, int(n.sum()), int(n[strong].sum()))]  # one language, no other to count words for
        out, last = [], int(lang[first])
        for (a, b), k, m, w, c, s in zip(spans, lang.tolist(), margin.tolist(), n.tolist(), clear.tolist(), strong.tolist()):
            last = k if c else last
            s = s and _WHOLE.search(text, max(a, b - 20), b) is not None
            if out and out[-1][2] == last:
                p = out[-1]
                out[-1] = (p[0], b, last, (p[3] * p[4] + m * w) / max(1, p[4] + w) if c else p[3], p[4] + w, p[5] + w * s)
            else:
                out.append((a, b, last, m, w, w * s))
        return out


_model: dict[bytes, Model] = {}


def _loaded(packed: bytes) -> Model:
    key = xxhash.xxh64_digest(packed)
    if key not in _model:
        _model.clear()
        _model[key] = Model(np.frombuffer(packed, np.float32).reshape(4, DIM).astype(np.float64))
    return _model[key]


def _excerpts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """At most SENTENCES sentences of each text, evenly spread."""
    for p in batches:
        out = []
        for text in p["text"]:
            spans = sentences(text)
            out.append("\n\n".join(text[a:b].strip() for a, b in spans[:: -(-len(spans) // SENTENCES) or 1]) if len(spans) > SENTENCES else text)
        yield pd.DataFrame({"text": out, "lang": p["lang"]})


def trained(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> np.ndarray | None:
    """Fit on at most SAMPLE labelled documents of each language, picked by hash, and SENTENCES of each."""
    named = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), normalized(F.col(lang_col)).alias("lang")).where(F.col("lang").isin(*LANGS) & F.col("text").rlike(r"(\p{L}+\P{L}+){20}"))
    able = materialize(named.select("id", "lang"), "labelled")
    ids = [r["id"] for lang in LANGS for r in able.where(F.col("lang") == lang).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()]
    if not ids:
        return None
    rows = named.where(F.col("id").isin(ids)).orderBy("lang", F.xxhash64("id"), "id").select("text", "lang").mapInPandas(_excerpts, "text string, lang string").collect()
    return fit([(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: LANGS.index(r["lang"]))])


_SEGMENTS = "id long, label string, votes string, n_words int, segments array<struct<start:int, end:int, lang:string, confidence:double, n_words:int, sure_words:int>>"


def segmented(df: DataFrame, machines: np.ndarray | None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row: id, normalised label, votes on the kind of text, and its segments."""
    packed = df.sparkSession.sparkContext.broadcast(machines.astype(np.float32).tobytes() if machines is not None else b"")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for at in range(0, len(p), 1000):
                yield some(p.iloc[at : at + 1000])

    def some(p: pd.DataFrame) -> pd.DataFrame:
        texts = [t if t and packed.value else "" for t in p["text"]]
        shapes = [kinds.figures(t) for t in texts]
        found = _loaded(packed.value).segments(texts) if packed.value else [[]] * len(texts)
        segments = [[{"start": a, "end": b, "lang": LANGS[k], "confidence": 1 / (1 + np.exp(-4 * m)), "n_words": n, "sure_words": c} for a, b, k, m, n, c in x] for x in found]
        return pd.DataFrame({"id": p["id"], "label": p["label"], "votes": [kinds.votes(f) for f in shapes], "n_words": p["n_words"], "segments": segments})

    texts = df.select(F.col(id_col).cast("long").alias("id"), normalized(F.col(lang_col)).alias("label"), F.col(text_col).alias("text"))
    texts = texts.withColumn("n_words", F.coalesce(F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+")), F.lit(0)))
    return texts.mapInPandas(run, _SEGMENTS)


def document_languages(segments: DataFrame) -> DataFrame:
    """(id, label, lang, confidence): the language of most words, and the share of words it has times its confidence."""
    s = segments.select("id", "label", F.posexplode_outer("segments").alias("pos", "s"))
    per = s.groupBy("id", "label", F.col("s.lang").alias("lang")).agg(F.sum("s.n_words").alias("n"), F.sum(F.col("s.confidence") * F.col("s.n_words")).alias("c"))
    best = F.max_by(F.struct("lang", "c"), F.struct("n", "lang"))
    return per.groupBy("id", "label").agg(best.alias("best"), F.sum("n").alias("all")).select("id", "label", F.col("best.lang").alias("lang"), F.coalesce(F.col("best.c") / F.col("all"), F.lit(0.0)).alias("confidence"))


def sentence_languages(least_words: int = 10):
    """Column: the language of most words, and every other one that has ``least_words`` in whole sentences beyond doubt."""
    s = F.col("segments")
    of = lambda lang: F.filter(s, lambda x: x["lang"] == lang)
    total = lambda xs, c: F.aggregate(xs, F.lit(0), lambda a, x: a + x[c])
    most = F.array_max(F.array(*[F.struct(total(of(c), "n_words").alias("n"), F.lit(c).alias("lang")) for c in LANGS]))["lang"]
    return F.array_compact(F.array(*[F.when((most == c) | (total(of(c), "sure_words") >= least_words), F.lit(c)) for c in LANGS]))


def found(segments: DataFrame, least_words: int = 20) -> DataFrame:
    """(doc_id, lang) of documents whose label is missing or wrong, or that have whole sentences in two languages.

    A label of one of the languages is wrong only where the mean confidence is at least ``CLAIM``: entries without function words say little."""
    sums = F.aggregate("segments", F.struct(F.lit(0.0).alias("c"), F.lit(0).alias("n")), lambda a, x: F.struct((a["c"] + x["confidence"] * x["n_words"]).alias("c"), (a["n"] + x["n_words"]).alias("n")))
    kept = kinds.posteriors(segments).where((F.col("n_words") >= least_words) & F.col("kind").isin("prose", "list"))
    kept = kept.select("id", "label", sentence_languages().alias("langs"), sums.alias("sums"))
    doubtful = F.col("label").isin(*LANGS) & (F.col("sums.c") < CLAIM * F.col("sums.n"))
    wrong = ~F.coalesce(F.array_contains("langs", F.col("label")), F.lit(False)) & ~doubtful
    return kept.where(F.col("label").isNull() | wrong | (F.size("langs") > 1)).select(F.col("id").alias("doc_id"), F.explode("langs").alias("lang")).distinct()
