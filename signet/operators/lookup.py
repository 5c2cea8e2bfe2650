"""Look-ups that bring together what a decision is about: registry entries, people, the latest of everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .authority import latest

# The label that a page has if a document contains what a reference of this type names.
REFERENCE_LABELS = {"ic_yonerge": "ic_yonerge_annex", "board_resolution": "board_resolution_annex", "gazette": "gazette_annex"}
# States of an application after which nothing follows, and the step of a form that a state belongs to.
TERMINAL = ["APPROVED", "DOC_REQUESTED", "ESCALATED"]


def _first(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.withColumn("__place", F.row_number().over(W.partitionBy(*keys).orderBy(order))).filter("__place = 1").drop("__place")


def registry_company(rows: DataFrame, number: str, companies: DataFrame) -> DataFrame:
    """``rows`` with ``company`` (mersis) and ``company_status`` of the first of ``companies`` (ordinal, mersis, status) whose number has the same digits."""
    keyed = companies.select("ordinal", F.col("mersis").alias("company"), F.col("status").alias("company_status"), T.digits_only(F.col("mersis")).alias("__key")).filter("__key != ''")
    return rows.withColumn("__key", T.digits_only(F.col(number))).join(_first(keyed, ["__key"], "ordinal").drop("ordinal"), "__key", "left").drop("__key")


def find_person(rows: DataFrame, by: str, name: str, people: DataFrame, prefix: str) -> DataFrame:
    """``rows`` with the columns of the first of ``people`` (by, ordinal, name, ...) of the same normalised name, under ``prefix``; empty names match nobody."""
    rest = [c for c in people.columns if c not in (by, "ordinal")]
    keyed = people.select(F.col(by).alias("__by"), "ordinal", T.tr_normalize(F.col("name")).alias("__plain"), *(F.col(c).alias(f"{prefix}{c}") for c in rest)).filter("__plain != ''")
    same = (F.col(by) == F.col("__by")) & (T.tr_normalize(F.col(name)) == F.col("__plain"))
    return rows.join(_first(keyed, ["__by", "__plain"], "ordinal").drop("ordinal"), same, "left").drop("__by", "__plain")


def cases(applications: DataFrame, documents: DataFrame, representatives: DataFrame, companies: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows for ``comparison.compare``: an application, its document, and the registry's company and person.

    applications(case_id, app_company, app_tax, app_mersis, app_name, app_tckn, as_of),
    documents(case_id, doc_company, doc_tax, doc_mersis, doc_valid_until),
    representatives(case_id, ordinal, name, tckn, mode), companies(ordinal, mersis, status),
    reps(company, ordinal, name, tckn, status).
    """
    rows = find_person(applications.join(documents, "case_id", "left"), "case_id", "app_name", representatives, "rep_")
    rows = registry_company(rows, "app_mersis", companies)
    return find_person(rows, "company", "app_name", reps, "reg_rep_").withColumnRenamed("company_status", "reg_status").drop("company")


def chain(applications: DataFrame, documents: DataFrame, extractions: DataFrame, reports: DataFrame, corrections: DataFrame, authorities: DataFrame) -> DataFrame:
    """Each application with its latest document, that one's latest extraction, the latest report on it, how many corrections, and its latest authority."""
    last = lambda df, key, id: latest(df, key, F.desc(id))
    rows = applications.join(last(documents.select("application", "document"), "application", "document"), "application", "left")
    rows = rows.join(last(extractions.select("document", "extraction"), "document", "extraction"), "document", "left")
    rows = rows.join(last(reports.select("extraction", "report", "verdict"), "extraction", "report"), "extraction", "left")
    rows = rows.join(corrections.groupBy("extraction").agg(F.count("*").alias("corrected")), "extraction", "left")
    rows = rows.join(last(authorities.select("application", "authority"), "application", "authority"), "application", "left")
    return rows.select("application", "document", "extraction", "report", "verdict", F.coalesce("corrected", F.lit(0)).alias("corrected"), "authority")


def references(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Distinct references (doc, ordinal, type, date, number), the first of equals, with ``found``: in_file, external or unknown."""
    label = F.try_element_at(F.create_map(*(F.lit(x) for pair in REFERENCE_LABELS.items() for x in pair)), F.col("type"))
    one = _first(rows, ["doc", "type", "date", "number"], "ordinal").withColumn("label", label)
    seen = pages.select("doc", F.explode("labels").alias("label")).distinct().withColumn("there", F.lit(True))
    found = F.when(F.col("there"), "in_file").when(F.col("type") == "other", "unknown").otherwise("external")
    return one.join(seen, ["doc", "label"], "left").select(*rows.columns, found.alias("found"))


def available(verdict: Column, review: Column) -> Column:
    """How an application can be approved, by its report's verdict and how many paths still wait for a person."""
    return F.when((review > 0) | verdict.isNull(), "hidden").when(verdict == "READY", "normal").when(verdict == "CO_SIGNER_REQUIRED", "override").otherwise("hidden")


def form_step(status: Column) -> Column:
    """The step of a branch's form; 1 without a status."""
    return F.when(F.coalesce(status, F.lit("DRAFT")) == "DRAFT", 1).when(status.isin("IDENTITY_VERIFIED", "DOCUMENT_SCANNED", "ANALYZING", "ANALYSIS_FAILED"), 2).otherwise(3)


def is_terminal(status: Column) -> Column:
    return status.isin(TERMINAL)


def newest_distinct(events: DataFrame, key: str, id: str, most: int = 8) -> DataFrame:
    """The ``most`` keys whose newest event is newest; a report, so the limit is the feature."""
    return events.groupBy(key).agg(F.max(id).alias(id)).orderBy(F.desc(id)).limit(most)


def audit(rows: DataFrame, most: int = 200, **equal: object) -> DataFrame:
    """The ``most`` newest audit rows, by ``id``, whose columns have the values given; a value of None asks nothing."""
    for column, value in equal.items():
        rows = rows if value is None else rows.filter(F.col(column) == value)
    return rows.orderBy(F.desc("id")).limit(most)
