"""Document fingerprints from closed syncmers (operator 9); DataFrame operations only.

The alphabet is words, cut into pieces of at most PIECE code points so that scripts
without spaces have letters too.  A run of K pieces is an anchor if the least of its
runs of S pieces, by a hash, is its first or its last one: that depends on the K
pieces alone, so an anchor survives whatever changes elsewhere.  A fingerprint is
the anchors' 32-bit hashes in text order; likeness is the Jaccard index of two sets
of anchors.  Texts of fewer than K pieces have each piece as an anchor.

Neighbours by descending id: ids are cut at their quantiles, large buckets once more at
their own, and an id that is a cut has a bucket to itself, so one that very many rows
share (or none have) can be cut by the texts' hashes.  Buckets keep the order; each also
gets a copy of the row that opens the next one, and a window over a bucket reads the row
after.  Whole texts are shuffled once.

Null and empty texts have the fingerprint "" and are fully alike.  Rows of equal id
stand in the order of their texts' hashes; rows without an id come last.  A lone row
is its own neighbour.  Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, table

K, S, PIECE = 5, 2, 16
#: Quantiles of all ids, and of those of a large bucket; buckets for each shuffle partition.
CUTS, FINER, SPREAD = 1024, 256, 8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def anchors(text: Column | str) -> Column:
    """The anchors of a text, array<int> in text order."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"), F.lit(0))
    pieces = F.transform(found, lambda x: F.xxhash64(x))

    def runs(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - S), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(S))))

    def closed(h: Column, r: Column) -> Column:
        edges = lambda i: F.least(F.get(r, i), F.get(r, i + (K - S)))
        inner = lambda i: F.least(*(F.get(r, i + j) for j in range(1, K - S)))
        places = F.filter(F.sequence(F.lit(0), F.size(h) - K), lambda i: edges(i) <= inner(i))
        return F.transform(places, lambda i: F.hash(F.get(r, i), F.get(r, i + S), F.get(h, i + (K - 1))))

    return _let(pieces, lambda h: F.when(F.size(h) < K, F.transform(h, lambda x: F.hash(x))).otherwise(_let(runs(h), lambda r: closed(h, r))))


def as_text(marks: Column) -> Column:
    return F.array_join(F.transform(marks, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column | str, b: Column | str) -> Column:
    """Jaccard index of two arrays of anchors; 1 if both are empty."""
    every = F.size(F.array_union(a, b))
    return F.when(every == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / every)


def _quantiles(value: Column | str, parts: int) -> Column:
    return F.array_distinct(F.percentile_approx(value, F.array(*(F.lit(i / parts) for i in range(1, parts))), F.lit(100 * parts)))


def _place(value: Column, cuts: Column, steps: int) -> Column:
    """Twice the number of cuts below ``value``, and one more if it is a cut itself; by halving steps, of which 2 ** ``steps`` exceeds the cuts."""
    halves = F.array(*(F.lit(1 << k) for k in range(steps - 1, -1, -1)))
    below = F.aggregate(halves, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(cuts, at + step - 1) < value, F.lit(False)), at + step).otherwise(at))
    return _let(below, lambda at: 2 * at + F.coalesce((F.get(cuts, at) == value).cast("int"), F.lit(0)))


def followed(rows: DataFrame, columns: list[str], slim: DataFrame, cuts: int = CUTS, finer: int = FINER) -> DataFrame:
    """``rows`` (doc_id, mark, ...) with ``next_<column>``: the given columns of the row after, by descending (doc_id, mark); the first follows the last.

    ``slim`` holds doc_id and mark of the same rows and nothing that is costly to compute.
    What is broadcast are rows for each bucket: some SPREAD for each shuffle partition, and
    at most FINER cuts for each large bucket.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first, n = slim.agg(_quantiles("doc_id", cuts), F.count("*")).first()
    target = max(1, n // (SPREAD * parts))
    known = F.array(*map(F.lit, first or [])).cast("array<long>")
    id = F.coalesce("doc_id", F.lit(0))
    one = F.when(F.col("doc_id").isNull(), -1).otherwise(_place(id, known, cuts.bit_length()))
    whole = slim.withColumn("one", one).groupBy("one").agg(F.count("*").alias("n"), _quantiles("doc_id", finer).alias("cuts"))
    every = F.ceil(F.lit(finer) / (F.col("n") / target)).cast("int")  # as many of these as the bucket's size asks for
    large = cut(whole.filter(F.col("n") > target).select("one", F.filter("cuts", lambda _, i: (i + 1) % F.greatest(every, F.lit(1)) == 0).alias("cuts")))

    def placed(df: DataFrame) -> DataFrame:
        df = df.withColumn("one", one).join(F.broadcast(large), "one", "left")
        return df.withColumn("two", F.when(F.col("cuts").isNull() | F.col("doc_id").isNull(), 0).otherwise(_place(id, F.col("cuts"), finer.bit_length()))).drop("cuts")

    slices = placed(slim).groupBy("one", "two").agg(F.count("*").alias("n"), F.min("doc_id").eqNullSafe(F.max("doc_id")).alias("same"))
    slices = cut(slices.filter(F.col("same") & (F.col("n") > 2 * target)).select("one", "two", F.ceil(F.col("n") / target).cast("int").alias("slices")))
    share = (F.col("mark") / F.lit(2.0**64)) + 0.5  # a hash, so its range is evenly filled

    def sliced(df: DataFrame) -> DataFrame:
        df = placed(df).join(F.broadcast(slices), ["one", "two"], "left")
        return df.withColumn("three", F.coalesce(F.least(F.floor(share * F.col("slices")).cast("int"), F.col("slices") - 1), F.lit(0))).drop("slices")

    keys = ["one", "two", "three"]
    order = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("i"), F.col("mark").alias("m"))
    heads = sliced(slim).groupBy(*keys).agg(F.max(order).alias("head"))  # a few rows for each shuffle partition
    before, ends = W.partitionBy(F.lit(1)).orderBy(*keys), F.struct(*keys)
    heads = cut(heads.select(*keys, "head", F.coalesce(F.lead(ends).over(before), F.min(ends).over(W.partitionBy(F.lit(1)))).alias("to")))
    opens = order.eqNullSafe(F.col("head"))
    rows = sliced(rows).join(F.broadcast(heads), keys).withColumn("copy", F.explode(F.when(opens, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    rows = rows.withColumns({k: F.when(F.col("copy"), F.col(f"to.{k}")).otherwise(F.col(k)) for k in keys}).drop("head", "to")
    after = W.partitionBy(*keys).orderBy("copy", F.desc_nulls_last("doc_id"), F.desc("mark"))
    return rows.select("*", *(F.lead(c).over(after).alias(f"next_{c}") for c in columns)).filter(~F.col("copy")).drop(*keys, "copy")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_chars, edited, marks, edited_marks, next_marks (arrays of anchors) for each row of ``docs``."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("mark", F.xxhash64("text"))
    found = followed(rows.withColumn("marks", anchors("text")), ["text", "marks"], rows.select("doc_id", "mark"))
    n = F.length("text")
    cut_off = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut_off), F.substring("next_text", F.lit(1), cut_off))
    found = found.select("doc_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"), "marks", "next_marks")
    return found.withColumn("edited_marks", anchors("edited"))


def op9_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "utf-8"), 256).alias("edited_sha256"), as_text(F.col("marks")).alias("fingerprint"), as_text(F.col("edited_marks")).alias("edited_fingerprint"),
        likeness("marks", "edited_marks").alias("near_edited"), likeness("marks", "next_marks").alias("near_next"),
    )
