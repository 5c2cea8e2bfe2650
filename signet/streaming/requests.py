"""Requests as a stream: evaluation against static rules, and counts by time with late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.authority import evaluate


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table, a file or a folder of files, as a stream of its rows."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{sf_dir}/{name[:-1]}[{name[-1]}].parquet")


def rates(events: DataFrame, width: str, late: str) -> DataFrame:
    """(start, kind, n): events by window and kind; a window is final when the newest event is ``late`` past its end.

    ``events`` has (at, kind).  State is one count for each open window and kind.
    """
    return events.withWatermark("at", late).groupBy(F.window("at", width), "kind").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "kind", "n")


def decide(requests: DataFrame, authorities: DataFrame, persons: DataFrame, rules: DataFrame, companies: DataFrame, reps: DataFrame) -> DataFrame:
    """Verdicts for a stream of transactions: the rules are static and each request is decided alone, so no state is kept."""
    return evaluate(requests, authorities, persons, rules, companies, reps)


def drain(stream: DataFrame, place: str) -> DataFrame:
    """Runs ``stream`` over all that is there, appending to Parquet under ``place``, and reads the result; reruns go on from the checkpoint."""
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start(f"{place}/rows")
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{place}/rows")
