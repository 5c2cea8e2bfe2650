"""Transactions against versioned authority rules and the live registry: limits, scopes, thresholds and co-signers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..storage import cut

# Verdicts of a report that a person may approve, and the one that takes a reason.
APPROVABLE, WITH_REASON = ["READY", "CO_SIGNER_REQUIRED"], "CO_SIGNER_REQUIRED"


def listed(reps: DataFrame) -> DataFrame:
    """(company, person, once, active): registered people, whether they stand there once, and whether any entry is active."""
    return reps.groupBy("company", "person").agg((F.count("*") == 1).alias("once"), F.bool_or(F.col("status") == "ACTIVE").alias("active"))


def evaluate(transactions: DataFrame, authorities: DataFrame, persons: DataFrame, rules: DataFrame, companies: DataFrame, reps: DataFrame) -> DataFrame:
    """txn_id, verdict, failed_step, cosigner; the first failing step decides.

    transactions(txn_id, company, subject, amount, initiator, day), authorities(company,
    status, valid_until), persons(company, person, source_id, mode, max_amount): the people
    of the authority; rules(company, scope, threshold, mode, blocked, ordinal, signers as
    source ids); the live registry: companies(company, status), reps(company, person,
    status).  A joint rule takes exactly one active person beside the initiator, and only
    its own signers.  What one document names is gathered into one row, so transactions
    are shuffled once; a company with very many of them is split by Spark's skew join.

    What isn't known never helps: a person without a mode may not act alone, a null signer
    is nobody, a company, person or authority without a status isn't active, and a
    transaction without an amount, or without a day where validity ends, is not proved.  Null limits and dates
    of validity are open, and a rule blocks only where ``blocked`` is true.
    """
    active = listed(reps)
    people = persons.join(active, ["company", "person"], "left").groupBy("company").agg(F.collect_list(F.struct("person", "source_id", "mode", "max_amount", F.coalesce(F.col("once") & F.col("active"), F.lit(False)).alias("sure"), F.coalesce("active", F.lit(False)).alias("active"))).alias("people"))
    terms = rules.groupBy("company").agg(F.array_sort(F.collect_list(F.struct(F.col("threshold").isNull().alias("open"), F.coalesce("threshold", F.lit(0)).alias("least"), "ordinal", "threshold", F.lower("scope").alias("scope"), "mode", F.coalesce("blocked", F.lit(False)).alias("blocked"), "signers"))).alias("rules"))
    known = authorities.join(people, "company", "left").join(terms, "company", "left").join(companies.select("company", F.col("status").alias("live")), "company", "left")
    rows = transactions.join(known, "company", "left")
    own = F.filter("people", lambda p: p.person == F.col("initiator"))
    in_scope = F.filter("rules", lambda r: r.scope == F.lower("subject"))
    rows = rows.withColumns({"own": own, "in_scope": in_scope})
    rows = rows.withColumn("rule", F.get(F.filter("in_scope", lambda r: ~r.blocked & (r.open | (F.col("amount") <= r.threshold))), 0)).withColumn("me", F.get("own", 0))
    rows = rows.withColumn("others", F.filter("people", lambda p: p.active & (p.source_id != F.col("me.source_id")) & F.array_contains(F.col("rule.signers"), p.source_id)))
    surely = lambda c: F.coalesce(c, F.lit(False))
    sole = surely((F.col("me.mode") == "SOLE") & (F.col("me.max_amount").isNull() | (F.col("me.max_amount") >= F.col("amount"))))
    signer = surely(F.array_contains(F.col("rule.signers"), F.col("me.source_id")))
    one = surely(F.size("others") == 1)
    mode = F.col("rule.mode")
    proved = F.col("amount").isNotNull() & (F.col("valid_until").isNull() | F.col("day").isNotNull()) & surely(((mode == "SOLE") & sole) | ((mode == "JOINT") & signer & one))
    step = (
        F.when(F.col("status").isNull(), "no_authority").when(F.col("status") != "ACTIVE", "authority_not_active").when(F.col("valid_until") < F.col("day"), "authority_expired")
        .when(F.coalesce(F.size("own"), F.lit(0)) != 1, "initiator_unknown").when(F.coalesce(F.col("live"), F.lit("")) != "ACTIVE", "company_not_active").when(~surely(F.col("me.sure")), "initiator_not_active")
        .when(surely(F.exists("in_scope", lambda r: r.blocked)), "scope_blocked").when(F.col("rule").isNull(), "no_rule")
        .when((mode == "SOLE") & ~sole, "over_limit").when((mode == "JOINT") & ~signer, "not_a_signer")
        .when((mode == "JOINT") & ~one, "no_cosigner").when(mode.isNull() | ~mode.isin("SOLE", "JOINT"), "unknown_mode").when(~proved, "not_proved")
    )
    rows = rows.withColumn("failed_step", step)
    verdict = F.when(F.col("failed_step").isNotNull(), "DENIED").when(F.col("rule.mode") == "SOLE", "ALLOWED").otherwise("PENDING_COSIGN")
    return rows.select("txn_id", verdict.alias("verdict"), "failed_step", F.when(verdict == "PENDING_COSIGN", F.get("others", 0)["person"]).alias("cosigner"))


def cosign(requests: DataFrame, transactions: DataFrame, now: DataFrame, reps: DataFrame) -> DataFrame:
    """(txn_id, cosigner, answer, status, code): second signatures, one for each transaction.

    requests(txn_id, cosigner); transactions(txn_id, company, status, initiator, required,
    cosigner) as they stand; ``now``: their evaluation against today's authority and
    registry.  ``answer`` says why nothing changes, or what the new status rests on.
    """
    live = listed(reps).select("company", F.col("person").alias("asked"), F.col("active").alias("live"))
    rows = requests.select("txn_id", F.col("cosigner").alias("asked")).join(transactions, "txn_id", "left").join(now.select("txn_id", F.col("verdict").alias("verdict"), F.col("cosigner").alias("due")), "txn_id", "left").join(live, ["company", "asked"], "left")
    answer = (
        F.when(F.col("status").isNull(), "NOT_FOUND").when((F.col("status") == "ALLOWED") & F.col("cosigner").eqNullSafe(F.col("asked")), "ALREADY_ALLOWED").when(F.col("status") != "PENDING_COSIGN", "NOT_PENDING")
        .when(F.col("asked").eqNullSafe(F.col("initiator")), "SELF_COSIGN").when(~F.col("asked").eqNullSafe(F.col("required")), "WRONG_COSIGNER")
        .when(~F.col("verdict").eqNullSafe(F.lit("PENDING_COSIGN")) | ~F.col("due").eqNullSafe(F.col("asked")), "REVALIDATION_FAILED").when(~F.coalesce("live", F.lit(False)), "COSIGNER_NOT_ACTIVE").otherwise("SIGNED")
    )
    status = F.when(F.col("answer") == "SIGNED", "ALLOWED").when(F.col("answer").isin("REVALIDATION_FAILED", "COSIGNER_NOT_ACTIVE"), "DENIED").otherwise(F.col("status"))
    code = F.when(F.col("answer").isin("SIGNED", "ALREADY_ALLOWED"), T.authorization_code(F.col("txn_id").cast("string"), F.lit("cosign")))
    return rows.withColumn("answer", answer).select("txn_id", F.col("asked").alias("cosigner"), "answer", status.alias("status"), code.alias("code"))


def approve(applications: DataFrame, persons: DataFrame, review: DataFrame, versions: DataFrame) -> DataFrame:
    """(application, refused, version): why an application isn't approved, or the version of its authority.

    ``applications`` has one row each with the latest of all that belongs to it:
    (application, status, company, tax, applicant, identity_seen, verdict, reason, doc_company,
    doc_tax, original_seen, live, approved_before); persons(application, mask): people who
    stand in the registry once and active; review(application, path): paths that block;
    versions(company, version): authorities so far.
    """
    found = persons.select("application", F.col("mask").alias("applicant")).distinct().withColumn("known", F.lit(True))
    open_ = review.groupBy("application").agg(F.count("*").alias("open"))
    rows = applications.join(found, ["application", "applicant"], "left").join(open_, "application", "left").join(versions.groupBy("company").agg(F.max("version").alias("last")), "company", "left")
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    refused = (
        F.when((F.col("status") == "APPROVED") & ~no("approved_before"), "ALREADY_APPROVED").when(F.col("status") != "ANALYZED", "INVALID_STATE").when(F.col("doc_company").isNull(), "NO_EXTRACTION")
        .when(~F.coalesce(F.col("verdict").isin(APPROVABLE), F.lit(False)), "VERDICT_NOT_APPROVABLE").when((F.col("verdict") == WITH_REASON) & (F.trim(F.coalesce("reason", F.lit(""))) == ""), "REASON_REQUIRED")
        .when(F.coalesce("open", F.lit(0)) > 0, "REVIEW_OPEN").when(no("identity_seen"), "IDENTITY_NOT_SEEN").when(no("original_seen"), "ORIGINAL_NOT_SEEN")
        .when(F.coalesce("live", F.lit("")) != "ACTIVE", "COMPANY_NOT_ACTIVE").when(~F.col("doc_company").eqNullSafe(F.col("company")) | ~F.col("doc_tax").eqNullSafe(F.col("tax")), "OTHER_COMPANY")
        .when(no("known"), "APPLICANT_NOT_FOUND")
    )
    own = W.partitionBy("company", F.col("refused").isNull()).orderBy("application")
    version = F.when(F.col("refused").isNull(), F.coalesce("last", F.lit(0)) + F.row_number().over(own))
    return rows.withColumn("refused", refused).select("application", "refused", version.alias("version"))


def with_codes(rows: DataFrame, key: str, tries: int = 20, parts: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``code``: each row's authorisation code by its unique ``key`` (and ``parts``, the same for all), drawn again where an earlier key has the same.

    Codes rest on keys and parts alone, so reruns agree.  Each try ranks the rows of a code, by a
    shuffle on it; usually the first finds nothing to draw again.
    """
    named = (F.col(key).cast("string"), *map(F.lit, parts))
    rows = rows.withColumn("code", T.authorization_code(*named))
    for salt in range(1, tries + 1):
        own = W.partitionBy("code").orderBy(key)
        rows = cut(rows.withColumn("__again", F.row_number().over(own) > 1))
        if rows.filter("__again").isEmpty():
            return rows.drop("__again")
        drawn = T.authorization_code(*named, F.lit(str(salt)))
        rows = rows.withColumn("code", F.when(F.col("__again"), drawn).otherwise(F.col("code"))).drop("__again")
    raise RuntimeError("codes still collide")


def latest(df: DataFrame, key: str, *order: Column | str) -> DataFrame:
    """The first row of each key; Spark limits each group before the shuffle."""
    return df.withColumn("__place", F.row_number().over(W.partitionBy(key).orderBy(*order))).filter("__place = 1").drop("__place")


def active(authorities: DataFrame) -> DataFrame:
    """Of each company's ACTIVE authorities the one of the highest version."""
    return latest(authorities.filter("status = 'ACTIVE'"), "company", F.desc("version"))


def with_effective_dates(persons: DataFrame, reps: DataFrame) -> DataFrame:
    """``persons`` (company, person, ...) with the registry's ``effective_at`` and present ``registry_status``."""
    return persons.join(reps.select("company", "person", "effective_at", F.col("status").alias("registry_status")), ["company", "person"], "left")


def history(transactions: DataFrame, authorities: DataFrame) -> DataFrame:
    """Decided transactions with their authority's version and status; those without an authority or verdict aren't shown.  ``place`` counts from the newest."""
    rows = transactions.filter("verdict is not null").join(authorities.select("authority", "version", F.col("status").alias("authority_status")), "authority")
    return rows.withColumn("place", F.row_number().over(W.partitionBy("company").orderBy(F.desc("txn_id"))))
