"""Helpers that several operators of this subpackage use."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as every word-based contract here has it: space and \t \n \v \f \r.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or a fresh one where it is unset."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="signet-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared folder, so that later plans start from files and survive lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut``, by a Parquet table in the shared folder: smaller for many rows, and with known size."""
    place = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def held_out(doc_id: Column | str, mod: int, rest: int = 2) -> Column:
    """True where crc32(doc_id as text) mod ``mod`` is ``rest``; a null id counts as the text ''."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % mod == rest


def repeated(df: DataFrame, n: str, place: str, rows: int = 4096) -> DataFrame:
    """Each row of ``df`` as often as its column ``n`` says, numbered by ``place`` from 0; rows that come often are spread over tasks first."""
    some = df.filter(F.col(n).between(1, rows)).withColumn(place, F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    many = df.filter(F.col(n) > rows).withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1, F.lit(rows).cast("long"))))
    many = many.repartition("__from").withColumn(place, F.explode(F.sequence(F.col("__from"), F.least(F.col("__from") + rows, F.col(n)) - 1))).drop("__from")
    return some.withColumn(place, F.col(place).cast("long")).unionByName(many)


def prefixes(df: DataFrame, by: list[str], order: Column, value: str, most: int, rows: int = 1 << 16) -> DataFrame:
    """Adds ``before``: the sum of ``value`` over the rows of the same ``by`` that stand earlier.

    Rows stand in the order of ``order``, a string of lower-case hex digits that is
    spread evenly (a digest).  Its leading digits cut each group into slices, so many
    that the largest group, of ``most`` rows, has some ``rows`` in each (256 slices at
    least); slice sums are small, so only a slice's own rows meet in one task.
    """
    from pyspark.sql import Window as W

    digits = 2
    while 16**digits * rows < most:
        digits += 1
    sliced = df.withColumn("__slice", F.conv(F.substring(order, 1, digits), 16, 10).cast("int"))
    sums = sliced.groupBy(*by, "__slice").agg(F.sum(value).alias("__sum"))
    ahead = W.partitionBy(*by).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*by, "__slice", F.coalesce(F.sum("__sum").over(ahead), F.lit(0)).alias("__ahead"))
    keys = [F.col(f"s.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, "__slice"]]
    both = sliced.alias("r").join(sums.alias("s"), keys).select("r.*", "s.__ahead")
    own = W.partitionBy(*by, "__slice").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return both.withColumn("before", F.col("__ahead") + F.coalesce(F.sum(value).over(own), F.lit(0))).drop("__slice", "__ahead")
