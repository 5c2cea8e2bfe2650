"""Mixing sources to target weights by weighted fair queueing (operator 8); DataFrame operations only.

Documents of a source stand in a fixed shuffled order (a digest of id, source, text
and place among equal rows) and are offered up to MOST times over.  A copy's virtual finish time is the
words its source has offered up to its end, divided by the source's target; copies
are taken in the order of finish times until the total budget is used up.

Nothing large is sorted in one place: sums within a source are those of digest
slices plus a slice's own rows, and the place where the budget ends is found by
histograms of finish times, narrowed until a bin holds few copies; all that reaches
the driver is a bin count and one cut-off.  One row per source is sorted in a
single task, for their rank.

Null and empty texts have size 0.  Null sources are one source, the last, and not
the same as ''.  Every row is offered by itself: rows without an id are told apart by
their texts, and n equal rows are n offers that stand apart in the queue, so reruns
agree whatever the order of the input.  A source without words has target 0; a text
without words is taken once or not at all.  No rows give no rows.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, cut, prefixes, repeated, table

WEIGHTS, MOST, BINS, FEW = (5, 2, 1), 3, 1024, 5000


def words(text: Column | str) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """Adds ``target`` to (source, source_size): the total shared by weight, none above ``most`` times its size.

    Sources stand by cap over weight; each place gives the level at which that source
    and the later ones would share what the earlier caps leave.  Levels rise up to the
    first source that isn't capped and fall after it, so the highest is the one.
    """
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("rank", F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1).withColumn("weight", cycle)
    ranked = ranked.withColumn("cap", F.lit(most).cast("long") * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    every, ahead = W.partitionBy(F.lit(1)), W.partitionBy(F.lit(1)).orderBy("ratio", "rank").rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(ahead), F.lit(0))
    level = left / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(ahead), F.lit(0)))
    ranked = ranked.withColumn("level", level)
    ranked = ranked.withColumn("level", F.max("level").over(every))
    target = F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight"))
    return ranked.select("source", "source_size", target.alias("target"))


def _finish(copy: Column | int) -> Column:
    """When the given copy (from 0) of a unit ends; null where the source has no target."""
    at = (F.lit(copy) if isinstance(copy, int) else copy).cast("long")
    return (at * F.col("source_size") + F.col("before") + F.col("size")) / F.nullif(F.col("target"), F.lit(0.0))


def _cutoff(units: DataFrame, budget: int, most: int) -> tuple[float, str]:
    """The last copy, as (finish, order), of those taken in the order of finish times within the budget."""
    copies = units.filter("size > 0").select("size", "order", F.explode(F.array(*map(_finish, range(most)))).alias("finish"))
    low, used, high = 0.0, 0, copies.agg(F.max("finish")).first()[0] or 0.0
    while True:  # copies up to low are taken and use `used`; the budget ends in (low, high]
        width = (high - low) / BINS
        within = copies.filter((F.col("finish") > low) & (F.col("finish") <= high))
        bins = F.least(F.greatest(F.ceil((F.col("finish") - low) / width) - 1, F.lit(0)), F.lit(BINS - 1)) if width > 0 else F.lit(0)
        found = within.groupBy(bins.cast("int").alias("bin")).agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.max("finish").alias("last")).orderBy("bin").collect()
        for bin in found:
            if used + bin.words > budget:
                break
            used, low = used + bin.words, bin.last
        else:
            return high, "g"  # everything fits; "g" stands after all hex digits
        high = bin.last
        if bin.n <= FEW or high <= low or width <= 0:
            break
    last = within.filter((F.col("finish") > low) & (F.col("finish") <= high)).withColumn("sum", F.sum("size").over(W.partitionBy(F.lit(1)).orderBy("finish", "order")))
    row = last.filter(F.col("sum") <= budget - used).agg(F.max(F.struct("finish", "order")).alias("x")).first().x
    return (row.finish, row.order) if row else (low, "g")


def _key(text: Column | str, *others: Column | str) -> Column:
    """What equal rows share beside id and source: a digest of the text, and of other columns that are given."""
    return F.concat_ws(":", F.md5(F.coalesce(text, F.lit("")).cast("binary")), *([F.hex(F.xxhash64(*others))] if others else []))


def _others(docs: DataFrame) -> list[str]:
    """Columns of ``docs`` beside id, source and text that Spark can hash."""
    return [f.name for f in docs.schema if f.name not in ("doc_id", "source", "text") and not re.search("map<|variant", f.dataType.simpleString())]


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(doc_id, source, key, size, source_size, target, copies): one row per row of ``docs``."""
    plain = docs.select("doc_id", "source", _key(F.col("text"), *_others(docs)).alias("key"), words(F.col("text")).alias("size"))
    equal = cut(plain.groupBy("doc_id", "source", "key", "size").agg(F.count("*").alias("n")))
    name = F.concat_ws(":", F.coalesce(F.concat(F.lit("i"), F.col("doc_id").cast("string")), F.lit("n")), F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")), "key", "place")
    units = cut(repeated(equal, "n", "place").select("doc_id", "source", "key", "size", F.md5(name).alias("order")))
    sizes = cut(units.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows")))
    sources = cut(targets(sizes.drop("rows"), weights, most))
    units = prefixes(units, ["source"], F.col("order"), "size", sizes.agg(F.coalesce(F.max("rows"), F.lit(0))).first()[0])
    known = units.alias("u").join(sources.alias("s"), F.col("u.source").eqNullSafe(F.col("s.source"))).select("u.*", "s.source_size", "s.target")
    known = cut(known)
    finish, order = _cutoff(known, sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0], most)
    taken = [((_finish(i) < finish) | ((_finish(i) == finish) & (F.col("order") <= order))) for i in range(most)]
    copies = sum((F.coalesce(t, F.lit(False)).cast("int") for t in taken), F.lit(0))
    copies = F.when(F.col("size") == 0, F.least(copies, F.lit(1))).otherwise(copies)
    return known.select("doc_id", "source", "key", "size", "source_size", "target", copies.alias("copies"))


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, with its columns.

    Of n equal rows each comes as often as all of them do, and what is left over comes from one of them.
    """
    keys = ["doc_id", "source", "key"]
    plan = cut(mix(docs).groupBy(*keys).agg(F.sum("copies").alias("all"), F.count("*").alias("n")).filter(F.col("all") > 0))
    own = {"doc_id": F.col("d.doc_id"), "source": F.col("d.source"), "key": _key(F.col("d.text"), *(F.col(f"d.`{c}`") for c in _others(docs)))}
    same = [own[k].eqNullSafe(F.col(f"p.{k}")) for k in keys]
    each = docs.alias("d").join(plan.filter(F.col("all") >= F.col("n")).alias("p"), same).select("d.*", F.floor(F.col("p.all") / F.col("p.n")).alias("__n"))
    rest = docs.alias("d").join(plan.filter(F.col("all") % F.col("n") > 0).alias("p"), same)
    rest = rest.groupBy(*(F.col(f"p.{k}").alias(f"__{k}") for k in keys), (F.col("p.all") % F.col("p.n")).alias("__n")).agg(F.first(F.struct("d.*")).alias("__row"))
    return repeated(each, "__n", "__place").select(docs.columns).unionByName(repeated(rest, "__n", "__place").select("__row.*").select(docs.columns))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH plain AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS key, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), units AS (
  SELECT doc_id, source, size, md5(coalesce('i' || CAST(doc_id AS VARCHAR), 'n') || ':' || coalesce('s' || source, 'n') || ':' || key || ':' ||
    CAST(row_number() OVER (PARTITION BY doc_id, source, key, size) - 1 AS VARCHAR)) AS ord FROM plain
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM units GROUP BY source
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM sizes
), weighed AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, 3 * source_size AS cap FROM ranked
), levels AS (
  SELECT *, cap / weight AS ratio,
    CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0) AS DOUBLE)
      / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM weighed WINDOW w AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), shares AS (
  SELECT source, source_size,
    least(CAST(cap AS DOUBLE), (SELECT max(level) FROM levels) * weight) AS target
  FROM levels
), queue AS (
  SELECT u.*, s.source_size, s.target, copy,
    (copy * s.source_size + sum(size) OVER (PARTITION BY u.source, copy ORDER BY ord)) / nullif(s.target, 0) AS finish
  FROM units u JOIN shares s ON u.source IS NOT DISTINCT FROM s.source, range(3) r(copy)
), sums AS (
  SELECT *, sum(size) OVER (ORDER BY finish, ord) AS used, (SELECT sum(size) FROM units) AS budget FROM queue WHERE size > 0
), firsts AS (
  SELECT ord, count(*) FILTER (used <= budget) AS copies FROM sums GROUP BY ord
)
SELECT doc_id, size, source_size, target, CAST(size * coalesce(copies, 0) AS BIGINT) AS taken
FROM queue LEFT JOIN firsts USING (ord) WHERE copy = 0
"""
