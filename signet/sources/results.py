"""Stored results by content: keys, hits and misses, replays, and results chosen from a catalog."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as T


def cache_key(content: str, *parts: str) -> Column:
    """The key of a stored result: the content's SHA-256 and the versions that made it."""
    return F.concat_ws("__", F.sha2(F.col(content), 256), *(T.slug(F.lit(p)) for p in parts))


def missing(inputs: DataFrame, stored: DataFrame, key: str = "key") -> DataFrame:
    """Inputs without a stored result: one row of each key; only keys of ``stored`` are read."""
    return inputs.dropDuplicates([key]).join(stored.select(key), key, "left_anti")


def hits(inputs: DataFrame, stored: DataFrame, schema: str, enabled: bool = True) -> DataFrame:
    """``inputs`` (key, ...) with ``result``: what is stored, parsed by ``schema``; null where nothing is, or nothing that parses."""
    if not enabled:
        return inputs.withColumn("result", F.from_json(F.lit(None).cast("string"), schema))
    parsed = F.from_json("payload", schema)
    good = F.when(F.get_json_object("payload", "$").isNotNull() & parsed.isNotNull() & F.exists(F.array(*(parsed[c.split()[0]].isNotNull() for c in schema.split(", "))), lambda x: x), parsed)
    one = stored.groupBy("key").agg(F.max("payload").alias("payload")).select("key", good.alias("result"))
    return inputs.join(one, "key", "left")


def cleared(stored: DataFrame, prefix: str = "") -> tuple[DataFrame, int]:
    """What stays when all results whose key begins with ``prefix`` go, and how many go."""
    gone = F.col("key").startswith(prefix)
    return stored.filter(~gone), stored.filter(gone).count()


def replayed(inputs: DataFrame, stored: DataFrame, schema: str) -> DataFrame:
    """``inputs`` (sha, ...) with the first valid result, by key, of those whose key begins with the content's digest."""
    rows = hits(stored.select("key").distinct(), stored, schema).filter("result is not null").withColumn("sha", F.split_part("key", F.lit("__"), F.lit(1)))
    return inputs.join(rows.groupBy("sha").agg(F.min_by("result", "key").alias("result")), "sha", "left")


def stub(document_id: Column) -> Column:
    """Which of four stored cases stands for a document, by its name: fixed values."""
    token = T.tr_normalize(document_id)
    return F.when(token.contains("case2") | token.endswith("02"), 2).when(token.contains("case3") | token.endswith("03"), 3).when(token.contains("case4") | token.endswith("04"), 4).otherwise(1)


def holds(payload: Column, path: str, equals: str | None = None, contains: dict[str, str] | None = None) -> Column:
    """Whether a JSON text has ``equals`` at a dotted path, or there a list with an element that has all of ``contains``; a missing path says no."""
    found = F.get_json_object(payload, f"$.{path}")
    if equals is not None:
        return F.coalesce(found == equals, F.lit(False))
    items = F.from_json(found, "array<map<string,string>>")
    return F.coalesce(F.exists(items, lambda x: reduce(and_, (F.coalesce(F.try_element_at(x, F.lit(k)) == v, F.lit(False)) for k, v in (contains or {}).items()), F.lit(bool(contains)))), F.lit(False))


def choice(payload: Column, catalog: Sequence[tuple[str, Sequence[dict]]]) -> Column:
    """The first name of a catalog (name, conditions), of a program's own size, whose conditions all hold."""
    return F.coalesce(*(F.when(reduce(and_, (holds(payload, **c) for c in conditions), F.lit(True)), F.lit(name)) for name, conditions in catalog), F.lit(None).cast("string"))


def stage_counts(rows: DataFrame, observation: Observation) -> DataFrame:
    """``rows`` (status, cached, ...) as they are; what passes by is counted on the way: ``total``, ``failed`` and ``cached``."""
    return rows.observe(observation, F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(F.col("cached")).alias("cached"))
