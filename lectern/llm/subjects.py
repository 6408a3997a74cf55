"""Problem 7: the subject areas of each document.

Method: label propagation over a verified document-similarity graph by iterative
DataFrame joins.  Two documents are neighbours if they share a subject-bearing term;
the graph is kept in its factored form, documents and terms, so no group of
documents that share a term is ever expanded into pairs.  An edge is verified if the
term's labels, over the labelled documents that hold it, concentrate on one subject
(``PURITY``, corrected for the subjects' sizes, from at least ``LEAST_DOCS`` documents); other
terms carry no label.

Trusted seeds are clamped: documents whose given label is confirmed by keywords of that
subject.  In each round terms take the mean labels of their documents, and the
documents that aren't seeds take the labels of their terms, until a round reaches no further
document and moves less than ``MOVED`` of a document's labels in the mean (at most ``ROUNDS``
rounds; the terms' labels may swing between two states).  At the end a seed keeps its label, and
each document, seeds included, has every subject with at least ``SHARE`` of
the subject-bearing words, if these are at least ``TOPICAL`` of all words, so that
several subjects or none may remain.

Terms are 64-bit hashes of folded words.  The labels of the verified terms, up to ``TERMS`` of them, are sent to the tasks, and a
round is one pass over the documents, which adds up its terms' labels before anything is shuffled; beyond that number a
round is made of joins.  Both give the same labels.

Null and empty texts, tables, junk and texts of fewer than 20 words have no row.  Without any
seed nothing is labelled.  Ids are expected to be unique.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import kinds
from lectern.llm.words import folded_words, word_hashes
from lectern.session import materialize

PURITY, LEAST_DOCS, SHARE, TOPICAL, ROUNDS = 0.6, 3, 0.25, 0.02, 50
MOVED = 0.001
#: Most verified terms that are broadcast (136 bytes each with 16 subjects).
TERMS = 250_000
#: English names of the subject codes.
ENGLISH = {
    "medicine": "medicina", "programming": "programacion", "physics": "fisica", "chemistry": "quimica", "history": "historia", "biology": "biologia",
    "law": "derecho", "geology": "geologia", "economics": "economia", "genetics": "genetica", "astronomy": "astronomia", "nutrition": "nutricion",
    "mathematics": "matematicas", "philosophy": "filosofia", "botany": "botanica", "architecture": "arquitectura",
}
_STOP = frozenset(w for x in kinds.COMMON for w in folded_words(x))


def _profile(codes: frozenset, keywords: dict[str, frozenset], names: dict[str, str]):
    def code(raw) -> str | None:
        c = "".join(folded_words(raw)) if isinstance(raw, str) else ""
        c = names.get(c, c)
        return c if c in codes else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            rows = []
            for raw, text in zip(p["label"], p["text"]):
                words = folded_words(text)
                counts = Counter(words)
                label, seen = code(raw), {}
                for w in counts.keys() & keywords.keys():
                    for c in keywords[w]:
                        seen[c] = seen.get(c, 0) + counts[w] / len(keywords[w])
                if label and not (seen.get(label, 0) >= 2 and seen[label] > 0.6 * sum(seen.values())):
                    label = None
                keep = [w for w in counts if len(w) > 2 and w not in _STOP and not w.isdigit()]
                rows.append((label, kinds.votes(kinds.figures(text)), len(words), word_hashes(keep).view(np.int64), [counts[w] for w in keep]))
            yield pd.DataFrame({"id": p["id"], **dict(zip(("seed", "votes", "n_words", "terms", "counts"), map(list, zip(*rows)) if rows else ([],) * 5))})

    return run


def profiles(df: DataFrame, subject_areas: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "domain", names: dict[str, str] = ENGLISH) -> DataFrame:
    """One row per document: id, trusted label or null, votes on the kind, words, distinct terms and their counts.

    ``subject_areas`` (domain, keyword) is the code list, a parameter of a few hundred rows; ``names`` are other names of its codes."""
    areas = [(r["domain"], r["keyword"]) for r in subject_areas.select("domain", "keyword").where("domain is not null and keyword is not null").distinct().collect()]
    keywords: dict[str, set] = {}
    for c, k in areas:
        for w in folded_words(k):
            keywords.setdefault(w, set()).add(c)
    run = _profile(frozenset(c for c, _ in areas), {k: frozenset(v) for k, v in keywords.items()}, names)
    texts = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(text_col).alias("text")).where("id is not null")
    return materialize(texts.mapInPandas(run, "id long, seed string, votes string, n_words int, terms array<long>, counts array<int>"), "profiles")


def _pure(mass: DataFrame, sizes: dict[str, float]) -> DataFrame:
    """(term, labels: array<struct<label, p>>) of the verified terms, from their masses (term, label, mass)."""
    size = F.create_map(*[x for k, v in sizes.items() for x in (F.lit(k), F.lit(float(v)))])
    rated = mass.withColumn("rate", F.round(F.col("mass") / size[F.col("label")], 12))
    per = rated.groupBy("term").agg(F.round(F.sum("mass"), 4).alias("n"), F.round(F.sum("rate"), 10).alias("all"), F.max("rate").alias("top"), F.collect_list(F.struct("label", "rate")).alias("rates"))
    pure = per.where((F.col("n") >= LEAST_DOCS) & (F.round(F.col("top") - PURITY * F.col("all"), 9) >= 0))
    kept = F.filter("rates", lambda x: F.round(x["rate"] - 0.3 * F.col("all"), 9) > 0)
    return pure.select("term", F.transform(kept, lambda x: F.struct(x["label"].alias("label"), (x["rate"] / F.col("all")).alias("p"))).alias("labels"))


class Labels:
    """The labels of verified terms as a table to look up: sorted terms and a row of weights each."""

    def __init__(self, terms: DataFrame, names: list[str]):
        rows = terms.toArrow()
        self.terms = rows.column("term").to_numpy()
        self.weights = np.zeros((len(self.terms) + 1, len(names)), np.float64)  # the last row is for other terms
        place = {n: i for i, n in enumerate(names)}
        for i, labels in enumerate(rows.column("labels").to_pylist()):
            for x in labels:
                self.weights[i, place[x["label"]]] = x["p"]
        order = np.argsort(self.terms, kind="stable")
        self.terms, self.weights[:-1] = self.terms[order], self.weights[:-1][order]

    def of(self, terms: np.ndarray) -> np.ndarray:
        if not len(self.terms):
            return np.zeros((len(terms), self.weights.shape[1]), np.float64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return self.weights[np.where(self.terms[at] == terms, at, len(self.terms))]


def _held(b: pa.RecordBatch, *tables) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Terms of the documents of a batch one after the other, the document of each, and for each table the documents' label weights."""
    lists = b.column("terms")
    sizes = np.diff(lists.offsets.to_numpy())
    flat, n = lists.flatten().to_numpy(), b.column("counts").flatten().to_numpy().astype(np.float64)
    doc = np.repeat(np.arange(b.num_rows), sizes)
    code, unique = pd.factorize(flat)
    out = []
    for t in tables:
        w = t.of(unique).astype(np.float64)
        hit = np.flatnonzero(w.any(1)[code]) if len(unique) else np.empty(0, np.int64)
        sums = np.zeros((b.num_rows, t.weights.shape[1]))
        for j in range(sums.shape[1]):
            sums[:, j] = np.bincount(doc[hit], n[hit] * w[code[hit], j], b.num_rows)
        out.append(sums)
    return unique, code, doc, out


def _mass_batches(tables, names: list[str]):
    """Partial masses of all terms as (term, label, mass), of a batch; as rows without a term: the labels' sizes, how far labels moved, documents
    reached and newly reached.  ``tables``: broadcasts of the terms' labels before and now; both None for the first round, of seeds alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 10_000):
                yield one(whole.slice(at, 10_000))

    def one(b: pa.RecordBatch) -> pa.RecordBatch:
        used = [t.value for t in tables if t is not None]
        unique, code, doc, weights = _held(b, *used)
        place = {n: i for i, n in enumerate(names)}
        seed = np.array([place.get(s, -1) for s in b.column("seed").to_pylist()], np.int64)
        seeded = np.zeros((b.num_rows, len(names)))
        seeded[np.flatnonzero(seed >= 0), seed[seed >= 0]] = 1
        states = [seeded]
        for w in weights:
            total = w.sum(1, keepdims=True)
            states.append(np.where(seed[:, None] >= 0, seeded, w / np.where(total > 0, total, 1)))
        now, before = states[-1], states[-2] if len(states) > 1 else seeded
        known, fresh = now.any(1), now.any(1) & ~before.any(1)
        # Each pair of a document and a label it has, times the document's terms, which stand together.
        d, j = np.nonzero(now)
        sizes = np.bincount(doc, minlength=b.num_rows)
        first = np.cumsum(sizes) - sizes
        many = sizes[d]
        at = np.repeat(first[d] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        summed = np.bincount(code[at] * len(names) + np.repeat(j, many), np.repeat(now[d, j], many), len(unique) * len(names))
        has = np.flatnonzero(summed)
        t, k, m = unique[has // len(names)], has % len(names), summed[has]
        moved = float(np.abs(now - before)[known | before.any(1)].sum() / 2)
        extra = [*now.sum(0), moved, float((known | before.any(1)).sum()), float(fresh.sum())]
        kinds_ = [*names, "\1moved", "\1documents", "\1fresh"]
        return pa.RecordBatch.from_arrays(
            [pa.concat_arrays([pa.array(t.astype(np.int64)), pa.nulls(len(extra), pa.int64())]), pa.array([names[int(i)] for i in k] + kinds_, pa.string()), pa.array(np.concatenate([m.astype(np.float64), extra]))], ["term", "label", "mass"]
        )

    return run


def _weight_batches(table, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weights = _held(b, table.value)[3][0]
            d, j = np.nonzero(weights)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(d)), pa.array([names[i] for i in j], pa.string()), pa.array(weights[d, j])], ["id", "label", "weight"])

    return run


def _joined_masses(docs: DataFrame, before: DataFrame | None, now: DataFrame) -> DataFrame:
    """The same rows as of ``_mass_batches``, by joins; ``before`` and ``now``: (id, label, weight) of the documents."""
    mass = now.join(docs.select("id", "terms"), "id").select(F.explode("terms").alias("term"), "label", "weight").groupBy("term", "label").agg(F.sum("weight").alias("mass"))
    sizes = now.groupBy("label").agg(F.sum("weight").alias("mass"))
    old = now.limit(0) if before is None else before
    both = now.withColumnRenamed("weight", "now").join(old.withColumnRenamed("weight", "then"), ["id", "label"], "full")
    per = both.groupBy("id").agg(F.sum(F.abs(F.coalesce("now", F.lit(0.0)) - F.coalesce("then", F.lit(0.0)))).alias("moved"), F.max(F.col("then").isNotNull()).alias("known"))
    stats = per.agg((F.coalesce(F.sum("moved"), F.lit(0.0)) / 2).alias("a"), F.count("*").cast("double").alias("b"), F.count_if(~F.col("known")).cast("double").alias("c"))
    rows = stats.select(F.explode(F.array(*[F.struct(F.lit(k).alias("label"), F.col(c).alias("mass")) for k, c in (("\1moved", "a"), ("\1documents", "b"), ("\1fresh", "c"))])).alias("x")).select("x.*")
    return mass.union(sizes.union(rows).select(F.lit(None).cast("long"), "label", "mass"))


def _carried(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, label, weight): the mass of each label on each document, from its terms."""
    words = docs.select("id", F.explode(F.arrays_zip("terms", "counts")).alias("t")).select("id", F.col("t.terms").alias("term"), F.col("t.counts").alias("n"))
    held = words.join(terms, "term").select("id", "n", F.explode("labels").alias("l"))
    return held.groupBy("id", F.col("l.label").alias("label")).agg(F.sum(F.col("n") * F.col("l.p")).alias("weight"))


def _labelled(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(id, label, weight) of the documents: seeds as they are, the others by their terms, weights summing to 1."""
    carried = _carried(docs.where("seed is null"), terms)
    total = carried.groupBy("id").agg(F.sum("weight").alias("total"))
    seeds = docs.where("seed is not null").select("id", F.col("seed").alias("label"), F.lit(1.0).alias("weight"))
    return materialize(seeds.union(carried.join(total, "id").select("id", "label", F.col("weight") / F.col("total"))), "labels")


def propagated(docs: DataFrame, rounds: int = ROUNDS, most_terms: int = TERMS) -> DataFrame:
    """(id, label, weight): words of each subject in each document, after propagation."""
    context, kind = docs.sparkSession.sparkContext, "term long, label string, mass double"
    names = sorted(r["seed"] for r in docs.where("seed is not null").select("seed").distinct().collect())  # codes of the list of subjects
    slim, empty = docs.select("id", "seed", "terms", "counts"), docs.select(F.lit(0).cast("long").alias("term"), F.lit(None).cast("array<struct<label:string,p:double>>").alias("labels")).limit(0)
    if not names:
        return _carried(docs, empty)
    tables, labels, terms = [], [None, None], empty
    for turn in range(rounds + 1):
        if len(tables) == turn:  # no table so far was too large to send
            rows = slim.mapInArrow(_mass_batches([*[None, None], *tables][-2:], names), kind)
        else:
            now = _labelled(docs, terms)
            rows, labels = _joined_masses(docs, labels[1], now), [labels[1], now]
        summed = materialize(rows.groupBy("term", "label").agg(F.round(F.sum("mass"), 6).alias("mass")), "masses")  # rounded, so that the order of additions decides no tie
        told = {r["label"]: r["mass"] for r in summed.where("term is null").collect()}
        if turn and not told["\1fresh"] and told["\1moved"] < MOVED * max(1.0, told["\1documents"]):
            break
        terms = materialize(_pure(summed.where("term is not null"), {n: max(told.get(n, 0.0), 1e-9) for n in names}), "termlabels")
        if len(tables) == turn and terms.count() <= most_terms:
            tables.append(context.broadcast(Labels(terms, names)))
    if len(tables) < turn or len(tables) == 0:
        return _carried(docs, terms)
    return slim.mapInArrow(_weight_batches(tables[-1], names), "id long, label string, weight double")


def found(docs: DataFrame, carried: DataFrame, least_words: int = 20) -> DataFrame:
    """(doc_id, domain, share) of prose and lists that have a subject."""
    carried = materialize(carried, "carried")
    total = carried.groupBy("id").agg(F.sum("weight").alias("total"))
    kept = kinds.posteriors(docs.select("id", "votes", "n_words", "seed")).where((F.col("n_words") >= least_words) & F.col("kind").isin("prose", "list")).select("id", "n_words", "seed")
    seeded = F.coalesce(F.col("label") == F.col("seed"), F.lit(False))
    share = (F.col("weight") / F.col("total")).alias("share")
    return carried.join(total, "id").join(kept, "id").where(seeded | (F.col("total") >= TOPICAL * F.col("n_words")) & (F.col("weight") >= SHARE * F.col("total"))).select(F.col("id").alias("doc_id"), F.col("label").alias("domain"), share)


def composition(labelled: DataFrame) -> DataFrame:
    """Documents of each subject, a document of several subjects by its shares."""
    return labelled.groupBy("domain").agg(F.count("*").alias("n_docs"), F.sum("share").alias("doc_shares"))
