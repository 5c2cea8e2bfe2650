"""Queries over what users see: labels of actions, states, verdicts and rules, and pages that only support; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import extraction_queries, inputs
from .functions import labels as L
from .functions import text as T
from .operators import pages, projection

INPUTS = {
    "audit": """SELECT event_id, user_id AS application, CASE event_type WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'IDENTITY_ATTESTED' ELSE 'DOCUMENT_UPLOADED' END WHEN 'purchase' THEN 'TRANSACTION_AUTHORIZED' WHEN 'signup' THEN 'APPLICATION_CREATED' WHEN 'error' THEN 'ANALYSIS_FAILED' ELSE upper(event_type) END AS action,
        CASE event_id % 5 WHEN 0 THEN 'branch_user:' || CAST(user_id AS STRING) WHEN 1 THEN 'mobile_user:' || CAST(user_id AS STRING) WHEN 2 THEN 'system' WHEN 3 THEN 'Branch_user:1' END AS actor FROM events""",
    "applications": """SELECT o_orderkey AS application, CASE o_orderkey % 6 WHEN 0 THEN 'READY' WHEN 1 THEN 'CO_SIGNER_REQUIRED' WHEN 2 THEN 'MISMATCH' WHEN 3 THEN 'REGISTRY_CONFLICT' WHEN 4 THEN 'NEW' END AS verdict,
        CASE o_orderkey % 7 WHEN 0 THEN 'DRAFT' WHEN 1 THEN 'ANALYZED' WHEN 2 THEN 'APPROVED' WHEN 3 THEN 'ESCALATED' WHEN 4 THEN 'ANALYSIS_FAILED' WHEN 5 THEN 'DOC_REQUESTED' ELSE 'draft' END AS status FROM orders""",
}


def audit_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often who did what, in the words of a screen, by application."""
    rows = inputs.rows(spark, sf_dir, INPUTS["audit"]).select("application", L.action(F.col("action")).alias("action"), L.actor(F.col("actor")).alias("actor"))
    return rows.groupBy("application", "action", "actor").agg(F.count("*").alias("n"))


def application_badges(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = inputs.rows(spark, sf_dir, INPUTS["applications"])
    return rows.select("application", L.shown(F.col("status"), L.APPLICATION_STATES).alias("state"), L.verdict_badge(F.col("verdict")).alias("badge")).select("application", "state", "badge.*")


def rule_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Executable rules as a screen shows them: scope, mode and limit."""
    found = projection.flat_rules(*extraction_queries.by_document(spark, sf_dir, "rules", "parties", "signatories")).filter("not blocked")
    limit = T.amount_range(F.lit(None).cast("bigint"), F.col("threshold"))
    return found.select("doc", "rule", L.shown(F.col("scope"), L.SCOPES).alias("scope"), L.shown(F.coalesce("mode", F.lit("UNKNOWN")), L.MODES).alias("mode"), limit.alias("limit_text"))


def supporting_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of each document that hold only annexes, and those whose annexes can't make a rule."""
    rows = inputs.rows(spark, sf_dir, extraction_queries.INPUTS["pages"])
    return rows.groupBy("doc").agg(F.count_if(pages.supporting_only()).alias("supporting"), F.count_if(pages.annex_only()).alias("annexed"), F.count("*").alias("n"))


ALL = (audit_labels, application_badges, rule_labels, supporting_pages)


def oracle_sql() -> dict[str, str]:
    rules = extraction_queries.oracle_sql()["scope_fan_out"]
    annex = "('ic_yonerge_annex', 'board_resolution_annex', 'gazette_annex', 'imza_beyannamesi')"
    return {
        "audit_labels": f"""{inputs.given(INPUTS, "audit")} SELECT application, CASE action WHEN 'IDENTITY_ATTESTED' THEN 'Kimlik doğrulandı' WHEN 'DOCUMENT_UPLOADED' THEN 'Belge yüklendi' WHEN 'TRANSACTION_AUTHORIZED' THEN 'İşlem yetkisi kontrol edildi' WHEN 'APPLICATION_CREATED' THEN 'Başvuru oluşturuldu' WHEN 'ANALYSIS_FAILED' THEN 'Belge incelemesi tamamlanamadı' ELSE 'Kayıt güncellendi' END AS action,
            CASE WHEN actor LIKE 'branch_user:%' THEN 'Şube görevlisi' WHEN actor LIKE 'system%' THEN 'Sistem' WHEN actor LIKE 'mobile_user:%' THEN 'Mobil kullanıcı' ELSE 'Yetkili kullanıcı' END AS actor, count(*) AS n FROM audit GROUP BY ALL""",
        "application_badges": f"""{inputs.given(INPUTS, "applications")}, words(status, state) AS (VALUES ('DRAFT', 'Taslak — kimlik doğrulanmadı'), ('ANALYZED', 'Analiz tamamlandı'), ('APPROVED', 'Onaylandı'), ('ESCALATED', 'Uyum birimine iletildi'), ('ANALYSIS_FAILED', 'Analiz başarısız'), ('DOC_REQUESTED', 'Yeni belge istendi')),
            badges(verdict, label, symbol, status) AS (VALUES ('READY', 'Onaya hazır', '✓', 'Uygun'), ('CO_SIGNER_REQUIRED', 'İkinci imza gerekli', '!', 'Dikkat'), ('MISMATCH', 'Bilgiler uyuşmuyor', '×', 'Engel'), ('REGISTRY_CONFLICT', 'Sicil kaydıyla çelişiyor', '×', 'Engel'))
            SELECT application, coalesce(state, a.status) AS state, coalesce(label, a.verdict) AS label, symbol, b.status FROM applications a LEFT JOIN words w ON w.status = a.status LEFT JOIN badges b ON b.verdict = a.verdict""",
        "rule_labels": f"""WITH flat AS ({rules}), sums AS (SELECT *, replace(format('{{:,}}', threshold // 100), ',', '.') || ',' || lpad(CAST(threshold % 100 AS STRING), 2, '0') || ' TL ve altı' AS below FROM flat WHERE NOT blocked)
            SELECT doc, rule, CASE scope WHEN 'general' THEN 'Genel işlemler' WHEN 'credit' THEN 'Kredi işlemleri' ELSE scope END AS scope, CASE mode WHEN 'SOLE' THEN 'Münferit' WHEN 'JOINT' THEN 'Müşterek' ELSE 'Belirsiz' END AS mode, coalesce(below, 'Tutar sınırı yok') AS limit_text FROM sums""",
        "supporting_pages": f"""{inputs.given(extraction_queries.INPUTS, "pages")}, told AS (SELECT doc, len(list_filter(labels, lambda x: x IN {annex})) AS hits, len(labels) AS size, list_contains(labels, 'rules') AS ruled FROM pages)
            SELECT doc, count(*) FILTER (hits = size) AS supporting, count(*) FILTER (hits > 0 AND NOT ruled) AS annexed, count(*) AS n FROM told GROUP BY doc""",
    }
