"""Registry files as tables: fail-closed scans, look-ups, patches, new versions beside old ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """schema_version string, companies array<struct<mersis string, legal_name string, tax_number string, status string,
    representatives array<struct<id string, name string, tckn string, mode string, status string, effective_at string>>>>"""
VERSION = "1.0"


def read_registry(spark: SparkSession, path: str, seed: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Companies, and representatives with their company's mersis; ``path`` holds one JSON object a file.

    Fails closed: a file that isn't JSON, has another version, no companies, or companies
    without mersis or status raises.  Where nothing is at ``path``, ``seed`` is read.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    if seed is not None and not (there is not None and len(there)):
        path = seed
    rows = spark.read.schema(SCHEMA).option("mode", "FAILFAST").json(path, multiLine=True)
    whole = (F.col("schema_version") == VERSION) & F.col("companies").isNotNull() & F.forall("companies", lambda c: c.mersis.isNotNull() & c.status.isNotNull() & c.representatives.isNotNull() & F.forall(c.representatives, lambda r: r.id.isNotNull() & r.status.isNotNull()))
    checked = F.when(F.coalesce(whole, F.lit(False)), F.col("companies")).otherwise(F.raise_error(F.lit("a registry file breaks its contract")).cast(rows.schema["companies"].dataType))
    companies = rows.select(checked.alias("companies")).select(F.inline("companies"))
    return companies.drop("representatives"), companies.select("mersis", F.inline("representatives"))


def reshaped(companies: DataFrame, reps: DataFrame) -> DataFrame:
    """One row: a map from each mersis to name, status and representatives, for requests that carry a registry; only for one of a bank's size."""
    people = reps.groupBy("mersis").agg(F.array_sort(F.collect_list(F.struct("name", "tckn", "mode", "status"))).alias("reps"))
    entry = F.struct("mersis", F.struct(F.col("legal_name").alias("name"), "status", F.coalesce("reps", F.array().cast("array<struct<name:string,tckn:string,mode:string,status:string>>")).alias("reps")))
    return companies.join(people, "mersis", "left").agg(F.map_from_entries(F.collect_list(entry)).alias("registry"))


def company(companies: DataFrame, mersis: str) -> DataFrame:
    """The company of exactly this number, or no row."""
    return companies.filter(F.col("mersis") == mersis).limit(1)


def patched(reps: DataFrame, patches: DataFrame) -> DataFrame:
    """``reps`` with the status that ``patches`` (mersis, rep_id, status) give them; of patches of one key, the last in order of status counts once."""
    new = patches.groupBy("mersis", F.col("rep_id").alias("id")).agg(F.max("status").alias("__status"))
    return reps.join(new, ["mersis", "id"], "left").withColumn("status", F.coalesce("__status", "status")).select(*reps.columns)


def unknown_patches(reps: DataFrame, patches: DataFrame) -> DataFrame:
    """Patches that no representative has: what a keyed update refuses."""
    return patches.join(reps.select("mersis", F.col("id").alias("rep_id")), ["mersis", "rep_id"], "left_anti")


def write(companies: DataFrame, reps: DataFrame, path: str, version: int) -> str:
    """A whole new version beside the old ones; readers take the newest with a success marker, so none sees half of one."""
    people = reps.groupBy("mersis").agg(F.collect_list(F.struct(*[c for c in reps.columns if c != "mersis"])).alias("representatives"))
    companies.join(people, "mersis", "left").write.mode("errorifexists").json(f"{path}/version={version}")
    return f"{path}/version={version}"
