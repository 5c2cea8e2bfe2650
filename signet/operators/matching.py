"""Fuzzy matches of short texts by insertions and deletions, within blocks."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Letters that are counted one by one before a pair is compared; all others count together.
LETTERS = "aeiorn"


def indel_ratio(a: str, b: str) -> float:
    """200 LCS / (m + n), with the longest common subsequence in bit-parallel steps; 100 for two empty texts."""
    if not a and not b:
        return 100.0
    places: dict[str, int] = {}
    for i, letter in enumerate(a):
        places[letter] = places.get(letter, 0) | 1 << i
    whole = (1 << len(a)) - 1
    free = whole
    for letter in b:
        hit = free & places.get(letter, 0)
        free = ((free + hit) | (free - hit)) & whole
    return 200.0 * (len(a) - free.bit_count()) / (len(a) + len(b))


@F.pandas_udf(DoubleType())
def _ratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio(a: Column, b: Column) -> Column:
    return _ratios(a, b)


def any_ratio(threshold: float) -> Callable[[Column, Column], Column]:
    """Whether any pair of two lists of texts, place by place, has a ratio of ``threshold`` or more; empty lists have none."""

    @F.pandas_udf("boolean")
    def found(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([any(indel_ratio(x, y) >= threshold for x, y in zip(xs, ys, strict=True)) for xs, ys in zip(a, b, strict=True)], dtype="bool")

    return found


def _shared(a: Column, b: Column) -> Column:
    """At least as many letters as the longest common subsequence has: those that both texts hold, in any order."""
    letters = [F.least(*(F.length(side) - F.length(F.translate(side, c, "")) for side in (a, b))) for c in LETTERS]
    rest = F.least(*(F.length(F.translate(side, LETTERS, "")) for side in (a, b)))
    return sum(letters, start=rest)


def possible(a: Column, b: Column, threshold: float) -> Column:
    """Whether lengths and counts of letters leave room for a ratio of ``threshold``."""
    m, n = F.length(a), F.length(b)
    return (200 * F.least(m, n) >= threshold * (m + n)) & (200 * _shared(a, b) >= threshold * (m + n))


def within(left: DataFrame, right: DataFrame, block: list[str], threshold: float = 90.0, distinct: bool = False) -> DataFrame:
    """(block, left_id, right_id, score) of pairs in one block with a ratio of ``threshold`` or more.

    ``left`` has (block, left_id, left_text), ``right`` the same of its own.  What the
    lengths alone rule out never reaches Python: the ratio can't pass
    200 min(m, n) / (m + n), nor what the counts of letters allow: the common
    subsequence takes a letter at most as often as both texts have it.  With ``distinct``
    equal texts are no pair.
    """
    pairs = left.join(right, block)
    if distinct:
        pairs = pairs.filter("left_text != right_text and left_text != '' and right_text != ''")
    pairs = pairs.filter(possible(F.col("left_text"), F.col("right_text"), threshold))
    return pairs.withColumn("score", ratio(F.col("left_text"), F.col("right_text"))).filter(F.col("score") >= threshold).select(*block, "left_id", "right_id", "score")


def numbered(left: DataFrame, right: DataFrame, block: list[str], threshold: float = 90.0) -> DataFrame:
    """``within`` for large blocks of texts that are words and a number: the same pairs, most of them never built.

    A common subsequence of two texts is no longer than that of their digits and that of
    all else together.  The latter is found once for each two shapes (a text without its
    digits, and how many it has) of a block; where it leaves room for the threshold only
    if all digits agree, the two meet by their digits.  All other pairs of these shapes
    are compared one by one, and shapes that leave no room never meet.
    """
    bare = lambda c: F.translate(c, "0123456789", "")
    digits = lambda c: F.regexp_replace(c, "[^0-9]+", "")
    sides = [rows.withColumns({f"{side}_shape": bare(f"{side}_text"), "number": digits(f"{side}_text")}).withColumn(f"{side}_width", F.length("number")) for side, rows in (("left", left), ("right", right))]
    shapes = [[f"{side}_shape", f"{side}_width"] for side in ("left", "right")]
    kinds = sides[0].select(*block, *shapes[0]).distinct().join(sides[1].select(*block, *shapes[1]).distinct(), block)
    a, b, least, most = F.col("left_shape"), F.col("right_shape"), F.least("left_width", "right_width"), F.greatest("left_width", "right_width")
    letters = F.length(a) + F.length(b)
    needed = F.ceil(threshold * (letters + F.col("left_width") + F.col("right_width")) / 200 - 1e-9)
    kinds = kinds.filter(F.least(F.length(a), F.length(b)) + least >= needed).filter(_shared(a, b) + least >= needed)
    kinds = kinds.withColumn("digits", needed - F.round(ratio(a, b) * letters / 200)).filter(F.col("digits") <= least).withColumn("all", F.col("digits") >= most).drop("digits")
    met = sides[0].join(kinds, [*block, *shapes[0]])
    pairs = [met.filter(keep).drop(*drop).join(sides[1].drop(*drop), [*block, *shapes[1], *on]) for keep, on, drop in (("all", ["number"], []), ("not all", [], ["number"]))]
    pairs = pairs[0].unionByName(pairs[1].filter(possible(F.col("left_text"), F.col("right_text"), threshold)), allowMissingColumns=True)
    return pairs.withColumn("score", ratio(F.col("left_text"), F.col("right_text"))).filter(F.col("score") >= threshold).select(*block, "left_id", "right_id", "score")


def best(left: DataFrame, right: DataFrame, block: list[str], threshold: float = 90.0, pairs: Callable[..., DataFrame] = within) -> DataFrame:
    """The best of ``pairs``, ``within`` or ``numbered``, for each left_id; ties go to the smaller right_id."""
    pairs = pairs(left, right, block, threshold)
    top = W.partitionBy(*block, "left_id").orderBy(F.desc("score"), "right_id")
    return pairs.withColumn("__place", F.row_number().over(top)).filter("__place = 1").drop("__place")
