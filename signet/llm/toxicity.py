"""Toxicity by the nearest labelled examples (operator 12).

Terms are lower-case words, and their first three to six letters ('idi*'), which meet
inflected and joined forms.  Of the terms of the labelled examples those count whose
document frequencies differ between the labels (G² of at least LEAST; the TERMS best).
A text is a vector of (1 + log tf) * idf over these terms, of length one; idf rests on
the document frequencies of all documents.

Examples with a vector stand in an inverted index, alike ones side by side, in blocks
of BLOCK.  Each term knows the largest weight that it has in a block, so a query bounds
every block, takes blocks from the highest bound on, scores them exactly, and stops
where no bound reaches its k-th best: the k nearest are exact, ties to the smaller id.
Neighbours vote by 1 / (distance + SOFT); missing neighbours count for the share of
label 1.  A logistic regression over votes, best likenesses, the number, weight and
most frequent of the terms and the words of the text turns them into a probability; it is fitted on examples whose fold had no
part in the choice of terms or in the index, weighed to the counts of all training rows.

The examples are a bounded sample: FIT_ROWS training rows of each label at most (the
least by a hash of doc_id; whole texts, whatever their length).  Their texts stay in
tasks; the driver gets counts of the best terms and sparse vectors.  Document
frequencies and scores are one Arrow pass each over all texts, without a shuffle of texts.

Null and empty texts have no terms and are scored like any text without terms.  Labels
repeated for an id count by their mean; null labels and ids don't count.  Rows that
repeat an example's id are one example (the least text).  Equal texts get equal scores.
Words of over 64 letters count by their first letters only.  Without both labels every
score is the share of label 1, or 0.5.  Columns named score, neighbours or terms are replaced.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, stored, table
from .quality import _chance, _logistic

FIT_ROWS, TERMS, LEAST, FOLDS, BLOCK, NEAREST, SOFT, ACCEPT = 1500, 4096, 24.0, 5, 64, 15, 0.05, 0.7
STEMS, LONGEST, KNOWN_WORDS = (3, 4, 5, 6), 64, 1 << 18
_WORD = re.compile(r"\w+")
NEIGHBOURS = "array<struct<doc_id:bigint,label:int,similarity:double>>"


def forms(word: str) -> list[str]:
    """The terms of a word (lower case): itself and its beginnings."""
    return ([word] if len(word) <= LONGEST else []) + [f"{word[:n]}*" for n in STEMS if len(word) > n]


@dataclass
class Counted:
    """Counts of known terms in texts; words are resolved once, as far as KNOWN_WORDS go."""

    number: dict[str, int]
    _words: dict[str, list[int]] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return {"number": self.number, "_words": {}}

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
        """(terms, counts, words of the text), by ascending term."""
        found: dict[int, int] = {}
        if len(self._words) > KNOWN_WORDS:
            self._words.clear()
        words = _WORD.findall((text or "").lower())
        for word, n in Counter(words).items():
            if (ids := self._words.get(word)) is None:
                ids = self._words[word] = [self.number[f] for f in forms(word) if f in self.number]
            for i in ids:
                found[i] = found.get(i, 0) + n
        terms = np.array(sorted(found), np.int64)
        return terms, np.array([found[i] for i in terms.tolist()], np.float64), len(words)


def _spans(starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after another."""
    n = stops - starts
    return np.repeat(starts - np.concatenate([[0], n.cumsum()[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


class Index:
    """Vectors of examples as postings by term, cut into blocks of examples with the largest weight of each."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], ids: np.ndarray, labels: np.ndarray, terms: int):
        # examples whose heaviest terms agree stand together, so that few blocks matter to a query
        heads = [(int(t[np.argmax(w)]), int(i), at) for at, ((t, w), i) in enumerate(zip(vectors, ids, strict=True)) if len(t)]
        order = [at for *_, at in sorted(heads)]
        self.ids, self.labels, self.blocks = ids[order], labels[order], -(-len(order) // BLOCK)
        term = np.concatenate([np.zeros(0, np.int64), *(vectors[at][0] for at in order)])
        self.weight = np.concatenate([np.zeros(0), *(vectors[at][1] for at in order)])
        self.place = np.repeat(np.arange(len(order)), [len(vectors[at][0]) for at in order])
        by = np.lexsort((self.place, term))
        term, self.weight, self.place = term[by], self.weight[by], self.place[by]
        block = self.place // BLOCK
        opens = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(block, prepend=-1)) if len(term) else np.zeros(0, np.int64)
        self.start, self.block = np.append(opens, len(term)), block[opens]
        self.most = np.maximum.reduceat(self.weight, opens) if len(opens) else np.zeros(0)
        self.term = np.searchsorted(term[opens], np.arange(terms + 1))  # entries of a term: from, to

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the k nearest examples with a cosine above 0; nearest first, ties to the smaller id."""
        entries = _spans(self.term[terms], self.term[terms + 1])
        weight = np.repeat(weights, self.term[terms + 1] - self.term[terms])
        bound = np.bincount(self.block[entries], weight * self.most[entries], self.blocks)
        order, at, step = np.argsort(-bound, kind="stable"), 0, 2
        places, scores, least = np.zeros(0, np.int64), np.zeros(0), 0.0
        while at < self.blocks and bound[order[at]] > 0 and bound[order[at]] >= least - 1e-9:
            chosen = np.zeros(self.blocks, bool)
            chosen[order[at : at + step]] = True
            own = np.flatnonzero(chosen[self.block[entries]])
            starts, stops = self.start[entries[own]], self.start[entries[own] + 1]
            postings = _spans(starts, stops)
            found = np.bincount(self.place[postings], self.weight[postings] * np.repeat(weight[own], stops - starts), len(self.ids))
            more = np.flatnonzero(found)
            places, scores = np.append(places, more), np.append(scores, found[more])
            if len(scores) >= k:
                least = np.partition(scores, -k)[-k]
            at, step = at + step, 2 * step
        scores = scores.round(9)
        best = np.lexsort((self.ids[places], -scores))[:k]
        return places[best], scores[best]


@dataclass
class Model:
    """What scoring needs: terms, the index of some thousand examples at most, and the calibration."""

    names: list[str]
    idf: np.ndarray
    index: Index
    share: float
    weights: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def vector(self, terms: np.ndarray, counts: np.ndarray, *_) -> tuple[np.ndarray, np.ndarray, float]:
        """(terms, weights of length one, the length before)."""
        keep = self.idf[terms] > 0
        terms, weights = terms[keep], (1 + np.log(counts[keep])) * self.idf[terms[keep]]
        length = float(np.sqrt((weights**2).sum()))
        return terms, weights / length if length else weights, length

    def features(self, terms: np.ndarray, counts: np.ndarray, words: int) -> tuple[list[float], np.ndarray, np.ndarray]:
        """What the calibration rests on, and the examples that voted with their cosines."""
        most = float(counts[self.idf[terms] > 0].max(initial=0.0))
        terms, weights, length = self.vector(terms, counts)
        places, near = self.index.nearest(terms, weights, NEAREST) if len(terms) else (np.zeros(0, np.int64), np.zeros(0))
        label = self.index.labels[places]
        vote, rest = 1 / (SOFT + 1 - np.minimum(near, 1.0)), (NEAREST - len(near)) / (SOFT + 1)
        voted = float(((vote * label).sum() + rest * self.share) / (vote.sum() + rest))
        best = [float(near[label == y].max(initial=0.0)) for y in (1, 0)]
        sizes = [float(np.log1p(x)) for x in (length, len(terms), most, words)] if len(near) else [0.0] * 4
        return [voted, voted * voted, *best, *sizes, float(len(near) > 0)], places, near

    def score(self, rows: np.ndarray) -> np.ndarray:
        return _chance(((rows - self.mean) / self.spread) @ self.weights[1:] + self.weights[0])


def _g2(a: Column, b: Column, na: int, nb: int) -> Column:
    """How far the shares a / na and b / nb lie apart (log-likelihood ratio)."""
    part = lambda seen, all_: F.when(seen > 0, seen * F.log(seen / all_)).otherwise(0.0)
    both, n = (a + b) / (na + nb), na + nb
    one = part(a, both * na) + part(b, both * nb) if na and nb else F.lit(0.0)
    return 2 * (one + part(na - a, (1 - both) * na) + part(nb - b, (1 - both) * nb)) if n and na and nb else one


def _counting(number: dict[str, int], columns: list[str], schema: str):
    """An Arrow function: the given columns of each row with its terms and counts."""
    counted = Counted(number)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counted.of(t.as_py()) for t in batch.column("text")]
            lists = [pa.array([f[i].astype(np.int64).tolist() for f in found], pa.list_(pa.int64())) for i in (0, 1)]
            words = pa.array([f[2] for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *lists, words], names=[*columns, "terms", "counts", "words"])

    return run, f"{schema}, terms array<long>, counts array<long>, words long"


def document_frequencies(docs: DataFrame, number: dict[str, int]) -> tuple[np.ndarray, int]:
    """In how many of all rows of ``docs`` (text) each of the given terms stands, and how many rows there are."""
    shared = docs.sparkSession.sparkContext.broadcast(Counted(number))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(shared.value.number) + 1, np.int64)
        for batch in batches:
            sums[-1] += batch.num_rows
            for text in batch.column("text"):
                sums[shared.value.of(text.as_py())[0]] += 1
        seen = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(sums[seen])], names=["term", "n"])

    sums = np.zeros(len(number) + 1, np.int64)
    for row in docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        sums[row.term] = row.n
    return sums[:-1], int(sums[-1])


def fit(docs: DataFrame, marks: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """Learns from the rows of ``docs`` (doc_id, text) that ``marks`` (doc_id, label) names; frequencies are of all ``docs``."""
    known = marks.join(docs.select("doc_id"), "doc_id", "left_semi")
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    chosen = [(r.doc_id, label, place % FOLDS) for label in (1, 0) for place, r in enumerate(known.filter(F.col("label") == label).orderBy(*order).limit(fit_rows).collect())]
    bad, good = counts.get(1, 0), counts.get(0, 0)
    share = (bad + 1e-9) / (bad + good + 2e-9)
    n = 9
    if not bad or not good:
        model = Model([], np.zeros(0), Index([], np.zeros(0, np.int64), np.zeros(0, np.int64), 0), share, np.zeros(n + 1), np.zeros(n), np.ones(n))
        model.weights[0] = np.clip(np.log(share + 1e-12) - np.log(1 - share + 1e-12), -30, 30)
        return model
    some = F.broadcast(docs.sparkSession.createDataFrame(chosen, "doc_id long, label int, fold int"))
    sample = stored(docs.join(some, "doc_id").groupBy("doc_id", "label", "fold").agg(F.min("text").alias("text")))
    size = np.zeros((2, FOLDS), int)
    for _, label, fold in chosen:
        size[label, fold] += 1

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [list(dict.fromkeys(f for w in set(_WORD.findall((t.as_py() or "").lower())) for f in forms(w))) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("fold"), pa.array(own, pa.list_(pa.string()))], names=["label", "fold", "terms"])

    each = sample.mapInArrow(terms, "label int, fold int, terms array<string>").select("label", "fold", F.explode("terms").alias("term"))
    cells = [(label, fold) for label in (1, 0) for fold in range(FOLDS)]
    seen = each.groupBy("term").agg(*(F.count_if((F.col("label") == a) & (F.col("fold") == f)).alias(f"n{a}{f}") for a, f in cells))
    total = lambda a, out: sum((F.col(f"n{a}{f}") for f in range(FOLDS) if f != out), F.lit(0))
    variants = [*range(FOLDS), FOLDS]  # without each fold, and with all of them
    g2 = [_g2(total(1, v), total(0, v), *(int(size[a].sum() - (size[a, v] if v < FOLDS else 0)) for a in (1, 0))).alias(f"g{v}") for v in variants]
    best = seen.select("term", *g2).withColumn("best", F.greatest(*(F.col(f"g{v}") for v in variants))).filter(F.col("best") >= LEAST)
    rows = best.orderBy(F.desc("best"), "term").limit(2 * TERMS).collect()

    names = [r.term for r in rows]
    gain = np.array([[r[f"g{v}"] for v in variants] for r in rows]).reshape(len(rows), len(variants))
    number = {t: i for i, t in enumerate(names)}
    run, schema = _counting(number, ["doc_id", "label", "fold"], "doc_id long, label int, fold int")
    examples = sorted(sample.mapInArrow(run, schema).collect())
    frequency, documents = document_frequencies(docs, number)
    idf = np.log((1 + documents) / (1 + frequency)) + 1
    ids, labels, folds = (np.array([e[i] for e in examples], np.int64) for i in range(3))
    tf = [(np.array(e.terms, np.int64), np.array(e.counts, np.float64), e.words) for e in examples]

    def model(variant: int) -> Model:
        allowed = np.zeros(len(names), bool)
        allowed[np.argsort(-gain[:, variant], kind="stable")[:TERMS]] = True
        made = Model(names, np.where(allowed & (gain[:, variant] >= LEAST), idf, 0.0), None, share, np.zeros(n + 1), np.zeros(n), np.ones(n))
        part = np.flatnonzero(folds != variant)
        made.index = Index([made.vector(*tf[i])[:2] for i in part], ids[part], labels[part], len(names))
        return made

    x, y = np.zeros((len(examples), n)), labels.astype(float)
    for fold in range(FOLDS):
        without = model(fold)
        for i in np.flatnonzero(folds == fold):
            x[i] = without.features(*tf[i])[0]
    whole = model(FOLDS)
    weight = np.where(y == 1, bad / y.sum(), good / (len(y) - y.sum()))
    whole.mean, whole.spread = x.mean(0), x.std(0) + 1e-9
    whole.weights = _logistic((x - whole.mean) / whole.spread, y, weight * len(y) / weight.sum())
    return whole


def score(docs: DataFrame, model: Model, text: str = "text", evidence: bool = True) -> DataFrame:
    """``docs`` with ``score``, and as evidence ``neighbours`` (the examples that voted, nearest first) and ``terms`` (up to five that weigh most)."""
    docs = docs.drop("score", "neighbours", "terms")
    shared = docs.sparkSession.sparkContext.broadcast((model, Counted({t: i for i, t in enumerate(model.names) if model.idf[i] > 0})))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, counted = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                counts = [counted.of(t.as_py()) for t in part.column(text)]
                found = [own.features(*c) for c in counts]
                added = [pa.array(own.score(np.array([f[0] for f in found])), pa.float64())]
                if evidence:
                    near = [[{"doc_id": int(own.index.ids[p]), "label": int(own.index.labels[p]), "similarity": float(s)} for p, s in zip(f[1], f[2], strict=True)] for f in found]
                    added.append(pa.array(near, pa.list_(pa.struct([("doc_id", pa.int64()), ("label", pa.int32()), ("similarity", pa.float64())]))))
                    heavy = [[own.names[t] for _, t in sorted(zip((-own.vector(*c)[1]).tolist(), c[0].tolist(), strict=True))[:5]] for c in counts]
                    added.append(pa.array(heavy, pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays([*part.columns, *added], names=[*part.schema.names, *names])

    names = ["score", "neighbours", "terms"][: 3 if evidence else 1]
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    return docs.mapInArrow(run, ", ".join([*kept, "score double", *([f"neighbours {NEIGHBOURS}", "terms array<string>"] if evidence else [])]))


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """The model that ``labels`` (doc_id, toxic) of the training ids of ``docs`` give."""
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("label"))
    return fit(docs.select("doc_id", "text"), marks.filter(~held_out("doc_id", 3, 1)))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, learned(docs, table(spark, sf_dir, "labels")), evidence=False)
    return found.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
