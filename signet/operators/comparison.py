"""Nine comparison checks of an application against a document and a registry, and their verdict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

# The checks of a report in their order, and those that ask the registry.
CHECKS = ["company_name_match", "tax_number_match", "mersis_number_match", "applicant_in_document", "identity_match", "authority_mode", "registry_status", "registry_representative_match", "document_validity"]
REGISTRY = ["registry_status", "registry_representative_match"]


def compare(cases: DataFrame) -> DataFrame:
    """``cases`` with a status column for each check and ``verdict``.

    A row holds application fields (app_*), the document's (doc_*, with the
    representative of the applicant's name, rep_*), the registry's (reg_*) and as_of;
    whatever is missing is red, and only a JOINT authority is amber.
    """
    green = lambda ok: F.when(F.coalesce(ok, F.lit(False)), "green").otherwise("red")
    same_digits = lambda a, b: (T.digits_only(F.col(a)) == T.digits_only(F.col(b))) & (T.digits_only(F.col(a)) != "")
    found = T.name_equal(F.col("app_name"), F.col("rep_name"))
    status = {
        "company_name_match": green(T.company_equal(F.col("app_company"), F.col("doc_company"))),
        "tax_number_match": green(same_digits("app_tax", "doc_tax")),
        "mersis_number_match": green(same_digits("app_mersis", "doc_mersis")),
        "applicant_in_document": green(found),
        "identity_match": green(found & T.masked_equal(F.col("app_tckn"), F.col("rep_tckn"))),
        "authority_mode": F.when(found & (F.col("rep_mode") == "SOLE"), "green").when(found & (F.col("rep_mode") == "JOINT"), "amber").otherwise("red"),
        "registry_status": green(F.upper("reg_status") == "ACTIVE"),
        "registry_representative_match": green(F.col("reg_status").isNotNull() & T.name_equal(F.col("app_name"), F.col("reg_rep_name")) & (F.col("reg_rep_status") == "ACTIVE") & (F.col("app_tckn").isNull() | F.col("reg_rep_tckn").isNull() | T.masked_equal(F.col("app_tckn"), F.col("reg_rep_tckn")))),
        "document_validity": green(F.col("doc_valid_until") >= F.col("as_of")),
    }
    checked = cases.select("*", *(s.alias(k) for k, s in status.items()))
    any_of = lambda names, value: F.array_contains(F.array(*names), value)
    plain = [c for c in CHECKS if c not in REGISTRY]
    verdict = F.when(any_of(plain, "red"), "MISMATCH").when(any_of(REGISTRY, "red"), "REGISTRY_CONFLICT").when(any_of(CHECKS, "amber"), "CO_SIGNER_REQUIRED").otherwise("READY")
    return checked.withColumn("verdict", verdict)
