"""Streams with state: runs that fail by a deadline, actions stored once with their audit, requests that wait for an answer."""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources import snapshots

#: How a run ends.
DONE, FAILED = "ANALYZED", "ANALYSIS_FAILED"
RUNS = "key long, started timestamp, ended timestamp, outcome string"


class _Runs(StatefulProcessor):
    """One open run a key at most; its start is the state, and a timer ends it."""

    def __init__(self, deadline_ms: int):
        self.deadline = deadline_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "started long")

    def _failed(self, key: tuple, started: int) -> dict:
        return {"key": key[0], "started": _at(started), "ended": _at(started + self.deadline), "outcome": FAILED}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.open.get()[0] if self.open.exists() else None
        before, found = held, []
        for at, _, ends in sorted((int(r.ms), int(r.seq), bool(r.ends)) for part in rows for r in part.itertuples()):
            if held is not None and at > held + self.deadline:
                found.append(self._failed(key, held))
                held = None
            if ends and held is not None:
                found.append({"key": key[0], "started": _at(held), "ended": _at(at), "outcome": DONE})
                held = None
            elif not ends and held is None:
                held = at
        if held != before:
            if before is not None:
                self.handle.deleteTimer(before + self.deadline)
            if held is None:
                self.open.clear()
            else:
                self.open.update((held,))
                self.handle.registerTimer(held + self.deadline)
        yield _frame(found)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.open.get()[0] if self.open.exists() else None
        if held is not None and held + self.deadline <= expiredTimerInfo.getExpiryTimeInMs():
            self.open.clear()
            yield _frame([self._failed(key, held)])

    def close(self) -> None:
        pass


def _at(ms: int) -> pd.Timestamp:
    return pd.Timestamp(ms, unit="ms")


def _frame(rows: list[dict]) -> pd.DataFrame:
    made = pd.DataFrame(rows, columns=["key", "started", "ended", "outcome"])
    return made.astype({"key": "int64", "started": "datetime64[us]", "ended": "datetime64[us]"})


def runs(events: DataFrame, deadline: datetime.timedelta, late: str) -> DataFrame:
    """(key, started, ended, outcome) of a stream of ``events`` (key long, at, seq long, ends boolean): runs and how they ended.

    A run starts with an event that doesn't end one, unless one is open, and ends with the
    next that does.  Without such within ``deadline`` it fails then, by a timer in event
    time; events after that start anew.  Event times count in milliseconds, ties by seq.
    State is one number for each open run.  Null keys and times aren't runs.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = events.filter("key is not null and at is not null").withColumn("ms", F.unix_millis("at")).withWatermark("at", late)
    return rows.groupBy("key").transformWithStateInPandas(_Runs(deadline // datetime.timedelta(milliseconds=1)), RUNS, "append", "EventTime")


def runs_of(events: DataFrame, deadline: datetime.timedelta, late: datetime.timedelta) -> DataFrame:
    """What ``runs`` gives once a table's events have all come, as a batch: runs still open at the watermark aren't shown.

    Events of a key are folded in order by one ``aggregate``, for an application has few.
    """
    ms = datetime.timedelta(milliseconds=1)
    rows = events.filter("key is not null and at is not null").select("key", F.unix_millis("at").alias("ms"), "seq", "ends")
    each = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("ms", "seq", "ends"))).alias("events"))
    none = F.lit(None).cast("long")
    limit = F.lit(deadline // ms)
    made = F.array().cast("array<struct<started:bigint,ended:bigint,outcome:string>>")

    def ended(started, at, outcome):
        return F.array(F.struct(started.alias("started"), at.alias("ended"), F.lit(outcome).alias("outcome")))

    def step(state, e):
        over = state.open.isNotNull() & (e.ms > state.open + limit)
        found = F.when(over, F.concat(state.found, ended(state.open, state.open + limit, FAILED))).otherwise(state.found)
        held = F.when(over, none).otherwise(state.open)
        done = e.ends & held.isNotNull()
        return F.struct(
            F.when(done, none).when(~e.ends & held.isNull(), e.ms).otherwise(held).alias("open"),
            F.when(done, F.concat(found, ended(held, e.ms, DONE))).otherwise(found).alias("found"),
        )

    newest = rows.agg(F.max("ms") - late // ms).first()[0]
    watermark = F.lit(newest).cast("long")

    def last(state):
        over = state.open.isNotNull() & (state.open + limit < watermark)
        return F.when(over, F.concat(state.found, ended(state.open, state.open + limit, FAILED))).otherwise(state.found)

    folded = each.select("key", F.aggregate("events", F.struct(none.alias("open"), made.alias("found")), step, last).alias("runs"))
    return folded.select("key", F.inline("runs")).select("key", F.timestamp_millis("started").alias("started"), F.timestamp_millis("ended").alias("ended"), "outcome")


def stored_once(stream: DataFrame, root: str, state: str, made: Callable[[DataFrame], Mapping[str, DataFrame]]) -> None:
    """Runs ``stream`` over all that is there; ``made`` gives the tables that a batch leads to, stored together and once.

    A batch's tables become visible by one rename, under the batch's number; a batch that is
    run again after a crash finds its number taken, or takes it now.
    """

    def store(batch: DataFrame, number: int) -> None:
        snapshots.append(batch.sparkSession, root, number, made(batch))

    query = stream.writeStream.foreachBatch(store).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()


def with_audit(decided: DataFrame, key: str, action: str) -> dict[str, DataFrame]:
    """Decisions, and an audit row for each with the action's name and what it said."""
    detail = F.to_json(F.struct(*(c for c in decided.columns if c != key)))
    return {"decisions": decided, "audit": decided.select(F.lit(action).alias("action"), F.col(key).cast("string").alias("entity"), detail.alias("detail"))}


def answered(requests: DataFrame, answers: DataFrame, within: str, late: str) -> DataFrame:
    """Every request (id, asked_at) of a stream with the answers (id, answered_at, by) that came ``within`` it, or none when no more can come.

    Both sides have watermarks, so state holds what can still meet: requests for ``within``
    and ``late``, answers for ``late``.
    """
    a = requests.withWatermark("asked_at", late).alias("a")
    b = answers.withWatermark("answered_at", late).alias("b")
    meets = (F.col("a.id") == F.col("b.id")) & (F.col("b.answered_at") >= F.col("a.asked_at")) & (F.col("b.answered_at") <= F.col("a.asked_at") + F.expr(f"INTERVAL {within}"))
    return a.join(b, meets, "left_outer").select(F.col("a.id").alias("id"), "asked_at", "answered_at", "by")


def first_pending(rows: DataFrame) -> DataFrame:
    """Of requests without an answer each company's newest: what a client's list shows first.  ``rows`` has (company, id, asked_at, answered_at)."""
    own = W.partitionBy("company").orderBy(F.desc("asked_at"), F.desc("id"))
    return rows.filter("answered_at is null").withColumn("__place", F.row_number().over(own)).filter("__place = 1").drop("__place", "answered_at")


def appended(spark: SparkSession, root: str, name: str) -> DataFrame:
    """All rows of a table that ``stored_once`` made visible."""
    return snapshots.read_all(spark, root, name)
