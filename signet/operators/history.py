"""Records that change: state machines, corrections over an immutable base, superseded versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# The states that may follow each state.
APPLICATION = {
    "DRAFT": ["IDENTITY_VERIFIED"],
    "IDENTITY_VERIFIED": ["DOCUMENT_SCANNED"],
    "DOCUMENT_SCANNED": ["ANALYZING"],
    "ANALYZING": ["ANALYZED", "ANALYSIS_FAILED"],
    "ANALYSIS_FAILED": ["ANALYZING"],
    "ANALYZED": ["APPROVED", "DOC_REQUESTED", "ESCALATED", "ANALYZING"],
}
TRANSACTION = {"REQUESTED": ["ALLOWED", "PENDING_COSIGN", "DENIED"], "PENDING_COSIGN": ["ALLOWED", "DENIED"]}


def steps(events: DataFrame, key: str, order: list[str], state: str, allowed: dict[str, list[str]]) -> DataFrame:
    """``events`` with ``previous`` state, ``version`` (1 for the first) and ``legal``; any first state is legal."""
    own = W.partitionBy(key).orderBy(*order)
    known = [f"{a}>{b}" for a, after in allowed.items() for b in after]
    rows = events.withColumns({"previous": F.lag(state).over(own), "version": F.row_number().over(own)})
    return rows.withColumn("legal", F.col("previous").isNull() | F.concat_ws(">", "previous", state).isin(known))


def fold(corrections: DataFrame, key: str) -> DataFrame:
    """(key, path, value): the last correction of each path by ``seq`` wins; maps and arrays aren't needed, and sums are partial."""
    return corrections.groupBy(key, "path").agg(F.max_by("new_value", "seq").alias("value"))


def checked_corrections(base: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """(key, seq, path, stale): a correction is stale where its ``old_value`` isn't what the path held before it.

    ``base`` has (key, path, value); a missing path holds null.  Every correction counts
    as applied for the next, so one stale row doesn't hide those behind it.
    """
    own = W.partitionBy(key, "path").orderBy("seq")
    rows = corrections.join(base.withColumnRenamed("value", "__base"), [key, "path"], "left")
    held = F.when(F.row_number().over(own) == 1, F.col("__base")).otherwise(F.lag("new_value").over(own))
    return rows.select(key, "seq", "path", (~F.col("old_value").eqNullSafe(held)).alias("stale"))


def supersede(rows: DataFrame, key: str, id: str, order: list[Column | str]) -> DataFrame:
    """``rows`` with ``version``, ``superseded_by`` (the next row's id) and ``state``: ACTIVE for each key's last row, else SUSPENDED."""
    own = W.partitionBy(key).orderBy(*order)
    rows = rows.withColumns({"version": F.row_number().over(own), "superseded_by": F.lead(id).over(own)})
    return rows.withColumn("state", F.when(F.col("superseded_by").isNull(), "ACTIVE").otherwise("SUSPENDED"))


def apply_batches(base: DataFrame, corrections: DataFrame, key: str) -> DataFrame:
    """(key, batch, applied): batches of corrections in their order; one that doesn't find what it expects is refused whole.

    ``base`` has (key, path, value), ``corrections`` (key, batch, seq, path, old_value,
    new_value).  A batch sees what the batches applied before it, and its own earlier rows,
    have put; a path that the document doesn't have refuses it.  What is gathered in one
    row are the corrections of one document.
    """
    held = base.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("path", "value"))).alias("held"))
    items = corrections.groupBy(key, "batch").agg(F.array_sort(F.collect_list(F.struct("seq", "path", "old_value", "new_value"))).alias("items"))
    batches = items.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("batch", "items"))).alias("batches"))
    rows = batches.join(held, key, "left").withColumn("held", F.coalesce("held", F.create_map().cast("map<string,string>")))

    def put(held: Column, item: Column) -> Column:
        return F.map_concat(F.map_filter(held, lambda k, _: k != item.path), F.create_map(item.path, item.new_value))

    def tried(state: Column, item: Column) -> Column:
        fits = state.fits & F.map_contains_key(state.now, item.path) & F.element_at(state.now, item.path).eqNullSafe(item.old_value)
        return F.struct(fits.alias("fits"), F.when(fits, put(state.now, item)).otherwise(state.now).alias("now"))

    def step(state: Column, batch: Column) -> Column:
        end = F.aggregate(batch["items"], F.struct(F.lit(True).alias("fits"), state.held.alias("now")), tried)
        made = F.struct(batch["batch"].alias("batch"), end.fits.alias("applied"))
        return F.struct(F.when(end.fits, end.now).otherwise(state.held).alias("held"), F.concat(state.found, F.array(made)).alias("found"))

    kind = corrections.schema["batch"].dataType.simpleString()
    none = F.array().cast(f"array<struct<batch:{kind},applied:boolean>>")
    found = F.aggregate("batches", F.struct("held", none.alias("found")), step, lambda s: s.found)
    return rows.select(key, F.inline(found))


def once(requests: DataFrame, results: DataFrame, key: str = "application") -> DataFrame:
    """(key, action): what an analysis does with each of ``requests`` (key, state): return what is stored, refuse while one runs, or run."""
    rows = requests.join(results.select(key, F.lit(True).alias("__stored")).distinct(), key, "left")
    action = F.when((F.col("state") == "ANALYZED") & F.col("__stored"), "RETURN_STORED").when(F.col("state") == "ANALYZING", "IN_PROGRESS").when(F.col("state").isin("DOCUMENT_SCANNED", "ANALYSIS_FAILED", "ANALYZED"), "RUN").otherwise("INVALID_STATE")
    return rows.select(key, action.alias("action"))


def retried(attempts: DataFrame, most: int = 2) -> DataFrame:
    """(job, tries, status): the first good one of up to ``most`` attempts (job, attempt, ok) decides; without one a job is degraded, and no other job is touched."""
    first = F.min(F.when(F.col("ok"), F.col("attempt")))
    rows = attempts.filter(F.col("attempt") <= most).groupBy("job").agg(first.alias("first"), F.max("attempt").alias("last"))
    return rows.select("job", F.coalesce("first", "last").alias("tries"), F.when(F.col("first").isNotNull(), "success").otherwise("failed").alias("status"))
