"""Nested documents put together bottom-up: all that belongs to a key meets in one aggregation, not in a join for each kind."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Part:
    """Rows that belong to a key: its newest by ``order``, or all of them in that order."""

    rows: DataFrame
    order: str
    many: bool = False


def assembled(base: DataFrame, key: str, parts: Mapping[str, Part]) -> DataFrame:
    """``base`` with a column for each part: a struct of the newest row's columns (null if none), or an array of all.

    Also ``<part>_count``.  All tables are stacked and grouped once, so each is shuffled once
    and sums of the newest are partial; what is gathered as an array is what one key has.
    Rows of parts whose key has no row in ``base``, and null keys, aren't shown.
    """
    own = [c for c in base.columns if c != key]
    stack = [base.select(key, F.struct(F.lit(True).alias("__there"), *own).alias("__base"))]
    for name, part in parts.items():
        stack.append(part.rows.select(key, F.col(part.order).alias(f"__order_{name}"), F.struct(*(c for c in part.rows.columns if c != key)).alias(name)))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), stack).filter(F.col(key).isNotNull())
    sums = [F.first("__base", ignorenulls=True).alias("__base")]
    for name, part in parts.items():
        one = F.struct(F.col(f"__order_{name}").alias("order"), F.col(name).alias("row"))
        found = F.transform(F.array_sort(F.collect_list(F.when(F.col(name).isNotNull(), one))), lambda x: x.row) if part.many else F.max(F.when(F.col(name).isNotNull(), one)).row
        sums += [found.alias(name), F.count(name).alias(f"{name}_count")]
    return rows.groupBy(key).agg(*sums).filter("__base is not null").select(key, *(F.col("__base")[c].alias(c) for c in own), *(c for name in parts for c in (name, f"{name}_count")))
