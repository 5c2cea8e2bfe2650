"""Quality classifier by compression (operator 3).

Two zstandard dictionaries are built, one from good and one from bad labelled text.
A text is compressed with either, piece by piece so that the dictionary matters over
the whole of a long text; the difference of the two sizes by the text's bytes is the
signal, and a logistic calibration over that difference, the compression ratio and
the length turns it into the probability of label 1.

Fitting takes a bounded sample: FIT_ROWS labelled training rows of each label (the
least by a hash of doc_id), as far as their whole texts fit into FIT_BYTES (in that
order; one that doesn't fit makes room for the next); one half for the dictionaries and
one for the calibration, reweighted to the label counts of all training rows.  Scoring
is one Arrow pass over whole texts, without a shuffle.  Rows that repeat a document are
one for fitting (the least text of an id) and get a score each.  Where there is too little
text to train a dictionary on, all of it is the dictionary.

Null and empty texts are scored like any other (difference zero).  Labels repeated
for an id count by their mean; null labels are ignored; without both labels every
score is the share of label 1, or 0.5.  A column named score is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held_out, table

FIT_ROWS, FIT_BYTES, DICTIONARY_BYTES, PIECE, LEVEL, ACCEPT = 1500, 24 << 20, 112_640, 2048, 3, 0.7


@dataclass
class Model:
    """What scoring needs: two dictionaries and the calibration; some 250 kB whatever the input."""

    good: bytes
    bad: bytes
    weights: np.ndarray
    mean: np.ndarray
    spread: np.ndarray

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def sizes(self, data: bytes) -> tuple[int, int]:
        if not hasattr(self, "_compress"):
            self._compress = [_compressor(self.good), _compressor(self.bad)]
        good, bad = self._compress
        pieces = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        return sum(len(good(p)) for p in pieces), sum(len(bad(p)) for p in pieces)

    def features(self, text: str | None) -> list[float]:
        data = (text or "").encode()
        if not data:
            return _expand(0.0, 1.0, 0.0)
        good, bad = self.sizes(data)
        return _expand((bad - good) / len(data), min(good, bad) / len(data), float(np.log1p(len(data))))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        rows = np.array([self.features(t) for t in texts]).reshape(len(texts), -1)
        return _chance(((rows - self.mean) / self.spread) @ self.weights[1:] + self.weights[0])


def _compressor(dictionary: bytes):
    plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if not dictionary:
        return zstandard.ZstdCompressor(**plain).compress
    known = zstandard.ZstdCompressionDict(dictionary)  # with zstandard's own header, or plain content
    known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=known, **plain).compress


def _expand(difference: float, ratio: float, length: float) -> list[float]:
    return [difference, difference * length, difference * abs(difference), ratio, ratio * ratio, length, ratio * length]


def _chance(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _dictionary(texts: list[str]) -> bytes:
    samples = [d[i : i + PIECE] for d in (t.encode() for t in texts) for i in range(0, len(d), PIECE)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: all of it serves as one
        return b"".join(dict.fromkeys(samples))


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weighted ridge logistic regression by Newton steps; the first weight is the constant."""
    x = np.column_stack((np.ones(len(x)), x))
    w, penalty = np.zeros(x.shape[1]), ridge * len(x) * np.diag([1e-6, *np.ones(x.shape[1] - 1)])
    for _ in range(60):
        p = _chance(x @ w)
        step = np.linalg.solve(x.T @ (x * (weight * p * (1 - p) + 1e-9)[:, None]) + penalty, x.T @ (weight * (y - p)) - penalty @ w)
        w += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, marks: DataFrame, fit_rows: int = FIT_ROWS, fit_bytes: int = FIT_BYTES) -> Model:
    """Learns from the rows of ``docs`` (doc_id, text) that ``marks`` (doc_id, label) names.

    ``fit_rows`` ids of each label are chosen without their texts, and of these what fits
    into ``fit_bytes``; then only these texts are read and reach the driver.
    """
    known = docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("size")).join(marks, "doc_id")
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    ids: dict[int, list[int]] = {}
    for label in (1, 0):
        some = known.filter(F.col("label") == label).groupBy("doc_id").agg(F.max("size").alias("size")).orderBy(*order).limit(fit_rows).collect()
        left, ids[label] = fit_bytes, []
        for r in some:
            if r["size"] <= left:
                left -= r["size"]
                ids[label].append(r.doc_id)
    chosen = docs.sparkSession.createDataFrame([(i, place, label) for label, own in ids.items() for place, i in enumerate(own)], "doc_id long, place int, label int")
    rows = docs.join(F.broadcast(chosen), "doc_id").groupBy("label", "place").agg(F.min("text").alias("text")).orderBy("label", "place").collect()
    texts = {label: [r.text or "" for r in rows if r.label == label] for label in (1, 0)}
    n = len(_expand(0, 0, 0))
    model = Model(_dictionary(texts[1][::2]), _dictionary(texts[0][::2]), np.zeros(n + 1), np.zeros(n), np.ones(n))
    good, bad = counts.get(1, 0), counts.get(0, 0)
    if not texts[1] or not texts[0]:
        share = (good + 1e-9) / (good + bad + 2e-9)
        model.weights[0] = np.clip(np.log(share + 1e-12) - np.log(1 - share + 1e-12), -30, 30)
        return model
    rest = [(t, label) for label in (1, 0) for t in texts[label][1::2] or texts[label]]
    x, y = np.array([model.features(t) for t, _ in rest]), np.array([label for _, label in rest], float)
    weight = np.where(y == 1, good / y.sum(), bad / (len(y) - y.sum()))
    model.mean, model.spread = x.mean(0), x.std(0) + 1e-9
    model.weights = _logistic((x - model.mean) / model.spread, y, weight * len(y) / weight.sum())
    return model


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of label 1."""
    docs = docs.drop("score")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = shared.value.scores([t.as_py() for t in part.column(text)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(made)], names=[*part.schema.names, "score"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(run, f"{kept}, score double")


def learned(docs: DataFrame, labels: DataFrame) -> Model:
    """The model that ``labels`` (doc_id, quality) of the training ids of ``docs`` give."""
    marks = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("label"))
    marks = marks.filter(~held_out("doc_id", 4))
    return fit(docs.select("doc_id", "text"), marks)


def keep_good(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, with its columns."""
    named = docs.withColumn("__row", F.struct(*[c for c in docs.columns])).select("text", "__row") if "score" in docs.columns else docs
    kept = score(named, learned(docs, labels)).filter(F.col("score") >= accept)
    return kept.select("__row.*") if "__row" in kept.columns else kept.select(docs.columns)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = score(docs, learned(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out("doc_id", 4).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
