"""Interaction of filters, by first failure over every order of them (operator 11).

Each document gets a mask of the filters it fails.  Filters that look at one document
(words, repetition, capitals, symbols) are one Arrow pass, which also gives a digest of
the text; that a text stands under a smaller id is found by the least id of a digest.
A table of 2^k masks by k! orders says at which step an order removes such a document,
so one look-up a document gives its removals in all orders; each task adds them up by
part, order, step and label (``np.bincount``), and Spark sums what the tasks have.

Texts travel once, to their own task's Python; after it a document is its id, part,
mask and digest.  A digest that has more than one in HEAVY of all rows is looked up by
broadcast (there are at most HEAVY such), all others by a shuffle, so that no group of
copies meets in one task.  Tasks keep PARTS parts at most and hand on what they have.

Null texts are empty and null sources the part ''.  A null id is neither smaller nor
larger than another.  Rows that repeat an id count each, and don't make each other
copies.  Labels of an id count if any row has them; null labels don't.  Empty tables
give no rows.  Only doc_id, text, source, quality and toxic are read; other columns don't matter.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

LETTERS, HEAVY, PARTS, ROWS = "ABCDE", 1024, 512, 4096
COPY = 4  #: place of the filter that looks at other documents


@dataclass(frozen=True)
class Limits:
    """A fails below so many words, B below that share of distinct ones, C above that share of capitals (percent), D with any of the symbols."""

    words: int = 200
    distinct: int = 50
    capitals: int = 2
    symbols: bytes = b"#$%&*|"

    def failed(self, data: bytes) -> int:
        """The mask of what a text (UTF-8) fails by itself; ``bytes.split`` takes the white space of words."""
        words, found = data.split(), np.frombuffer(data, np.uint8)
        points, capitals = int(np.count_nonzero((found & 0xC0) != 0x80)), int(np.count_nonzero((found >= 65) & (found <= 90)))
        return (
            (len(words) < self.words)
            | (100 * len(set(words)) < self.distinct * len(words)) << 1
            | (100 * capitals > self.capitals * points) << 2
            | any(s in data for s in self.symbols) << 3
        )


def first_failures(k: int) -> np.ndarray:
    """[mask, order]: the step (from 0) whose filter is the first of the order that the mask has; k if none."""
    orders = np.array(list(permutations(range(k))))
    found = np.full((1 << k, math.factorial(k)), k, np.int64)
    for mask in range(1 << k):
        fails = (mask >> orders) & 1
        found[mask] = np.where(fails.any(1), fails.argmax(1), k)
    return found


def failures(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, part, mask, digest) of each row of ``docs`` (doc_id, text, source): what it fails by itself, and its text's SHA-256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t.as_py() or "").encode() for t in batch.column("text")]
            masks = pa.array([limits.failed(t) for t in texts], pa.int32())
            digests = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), masks, digests], names=["doc_id", "part", "mask", "digest"])

    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, part string, mask int, digest binary")


def with_copies(rows: DataFrame, bit: int = COPY, heavy: int = HEAVY) -> DataFrame:
    """``rows`` (doc_id, digest, mask, ...), the mask with ``bit`` where a smaller doc_id has the same digest; without the digest."""
    known = rows.groupBy("digest").agg(F.min("doc_id").alias("__first"), F.max("doc_id").alias("__last"), F.count("*").alias("__n"))
    known = stored(known.filter("__first < __last").drop("__last"))
    often = F.col("__n") > rows.count() / heavy
    much, rest = known.filter(often).drop("__n"), known.filter(~often).drop("__n")
    lone = rows.join(F.broadcast(much.select("digest")), "digest", "left_anti").join(rest, "digest", "left")
    both = rows.join(F.broadcast(much), "digest").unionByName(lone)
    later = F.coalesce(F.col("doc_id") > F.col("__first"), F.lit(False))
    return both.withColumn("mask", F.col("mask").bitwiseOR(F.when(later, 1 << bit).otherwise(0))).drop("digest", "__first")


def with_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` with booleans ``good`` and ``toxic``: whether any label of that id says so."""
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(*(F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(n) for c, n in (("quality", "good"), ("toxic", "toxic"))))
    no = {"good": F.lit(False), "toxic": F.lit(False)}
    found = rows.filter("doc_id is not null").join(marks.filter("good or toxic"), "doc_id", "left")
    found = found.withColumns({c: F.coalesce(F.col(c), v) for c, v in no.items()})
    return found.unionByName(rows.filter("doc_id is null").withColumns(no))


def removals(rows: DataFrame, k: int = len(LETTERS)) -> DataFrame:
    """(part, order, step, n, good, toxic) of ``rows`` (part, mask, good, toxic): removals of each order and step; under order -1 rows by mask."""
    first = first_failures(k)
    orders, cells = first.shape[1], first.shape[1] * (k + 1)

    def given(held: dict[str, tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        columns: list[list[np.ndarray]] = [[], [], [], [], []]
        names: list[str] = []
        for part, (removed, masks) in held.items():
            at = np.flatnonzero(removed[0].reshape(orders, k + 1)[:, :k])
            order, step = at // k, at % k
            mask = np.flatnonzero(masks)
            sums = removed[:, order * (k + 1) + step]
            none = np.zeros(len(mask), np.int64)
            for column, a, b in zip(columns, (order, step, *sums), (none - 1, mask, masks[mask], none, none), strict=True):
                column += [a, b]
            names += [part] * (len(at) + len(mask))
        order, step, *sums = (np.concatenate([np.zeros(0, np.int64), *c]) for c in columns)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(order, pa.int32()), pa.array(step, pa.int32()), *map(pa.array, sums)], names=["part", "order", "step", "n", "good", "toxic"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                some = batch.slice(at, ROWS)
                coded = some.column("part").dictionary_encode()
                names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
                mask, *labels = (some.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "good", "toxic"))
                cell = (code[:, None] * orders + np.arange(orders)) * (k + 1) + first[mask]
                found = np.stack([np.bincount(cell[rows].ravel(), minlength=len(names) * cells).reshape(-1, cells) for rows in (slice(None), *labels)], 1)
                masks = np.bincount(code.astype(np.int64) << k | mask, minlength=len(names) << k).reshape(-1, 1 << k)
                for i, name in enumerate(names):
                    if name in held:
                        held[name][0].__iadd__(found[i])
                        held[name][1].__iadd__(masks[i])
                    else:
                        held[name] = found[i].copy(), masks[i].copy()
                if len(held) > PARTS:
                    yield given(held)
                    held = {}
        yield given(held)

    partial = rows.select("part", "mask", "good", "toxic").mapInArrow(run, "part string, order int, step int, n long, good long, toxic long")
    return partial.groupBy("part", "order", "step").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def report(sums: DataFrame, letters: str = LETTERS) -> DataFrame:
    """What ``removals`` found, one row for each part, order and step; a part's sums are some hundred rows, whatever the corpus."""
    k = len(letters)
    perms = np.array(list(permutations(range(k))))
    names = ["".join(letters[i] for i in p) for p in perms]
    kinds = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        order, step, *sums = (rows.column(c).to_numpy() for c in ("order", "step", "n", "good", "toxic"))
        removed = np.zeros((3, len(perms), k), np.int64)
        at = order >= 0
        for kind, values in zip(removed, sums, strict=True):
            kind[order[at], step[at]] = values[at]
        masks = np.zeros(1 << k, np.int64)
        masks[step[~at]] = sums[0][~at]
        fails = np.array([masks[(np.arange(1 << k) >> i) & 1 == 1].sum() for i in range(k)])
        shapley = np.bincount(perms.ravel(), removed[0].ravel(), k).astype(np.int64)
        found = [masks.sum() - removed[0].cumsum(1), removed[0], fails[perms] - removed[0], masks[1 << perms], removed[1], removed[2], shapley[perms]]
        n = perms.size
        columns = [pa.array([key[0].as_py()] * n), pa.array(np.repeat(names, k)), pa.array(np.tile(np.arange(1, k + 1), len(perms)), pa.int32()), *(pa.array(x.ravel().astype(np.int64)) for x in found)]
        return pa.table(columns, names=["part", "filter_order", "step", *kinds])

    return sums.groupBy("part").applyInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in kinds))


def audit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row for each part, order of the five filters and step: what is kept, removed, redundant, and the labelled rows lost."""
    rows = with_copies(stored(failures(docs, limits)))
    return report(removals(with_labels(rows, labels)))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY t) AS least FROM d
), f AS (
  SELECT doc_id, part, [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words),
    100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t), regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails FROM w
), marked AS (
  SELECT part, fails, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = f.doc_id AND l.quality = 1) AS good,
    EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = f.doc_id AND l.toxic = 1) AS toxic FROM f
), kinds AS (
  SELECT part, fails, len(list_filter(fails, lambda x: x)) AS n_fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM marked GROUP BY ALL
), letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS i), orders AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS o FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), steps AS (
  SELECT o, i AS step, o[i] AS own, list_slice(o, 1, i - 1) AS earlier FROM orders, letters
), seen AS (
  SELECT part, o, step, own, n, good, toxic, n_fails, fails[own] AS here, len(list_filter(earlier, lambda x: fails[x])) > 0 AS gone FROM kinds, steps
), found AS (
  SELECT part, o, step, own, sum(n) FILTER (NOT here AND NOT gone) AS kept, sum(n) FILTER (here AND NOT gone) AS removed, sum(n) FILTER (here AND gone) AS redundant,
    sum(n) FILTER (here AND n_fails = 1) AS unique_fails, sum(good) FILTER (here AND NOT gone) AS good_lost, sum(toxic) FILTER (here AND NOT gone) AS toxic_lost FROM seen GROUP BY ALL
)
SELECT part, array_to_string(list_transform(o, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, CAST(step AS INTEGER) AS step,
  CAST(coalesce(kept, 0) AS BIGINT) AS kept, CAST(coalesce(removed, 0) AS BIGINT) AS removed, CAST(coalesce(redundant, 0) AS BIGINT) AS redundant,
  CAST(coalesce(unique_fails, 0) AS BIGINT) AS unique_fails, CAST(coalesce(good_lost, 0) AS BIGINT) AS good_lost, CAST(coalesce(toxic_lost, 0) AS BIGINT) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, own), 0) AS BIGINT) AS shapley
FROM found
"""
