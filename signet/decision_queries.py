"""Queries over decisions, histories, look-ups and stored results; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import inputs
from .functions import text as T
from .operators import authority, comparison, history, lookup, merging, validation
from .sources import documents, results

INPUTS = {
    "requests": "SELECT o_orderkey AS txn_id, CASE o_orderkey % 4 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS cosigner FROM orders",
    "pending": """SELECT o_orderkey AS txn_id, o_custkey AS company, CASE o_orderkey % 5 WHEN 0 THEN 'ALLOWED' WHEN 1 THEN 'DENIED' ELSE 'PENDING_COSIGN' END AS status, CASE WHEN o_custkey % 3 = 0 THEN 'b' ELSE 'd' END AS initiator,
        CASE WHEN o_orderkey % 7 = 0 THEN 'a' ELSE 'c' END AS required, CASE WHEN o_orderkey % 5 = 0 THEN 'c' END AS cosigner FROM orders WHERE o_orderkey % 11 > 0""",
    "now": "SELECT o_orderkey AS txn_id, CASE WHEN o_custkey % 13 = 0 THEN 'DENIED' ELSE 'PENDING_COSIGN' END AS verdict, CASE WHEN o_orderkey % 7 = 0 THEN 'a' WHEN o_orderkey % 17 = 0 THEN 'd' ELSE 'c' END AS cosigner FROM orders",
    "signers": "SELECT c_custkey AS company, p AS person, CASE WHEN (c_custkey + k) % 6 = 0 THEN 'REMOVED' ELSE 'ACTIVE' END AS status, CAST(2000 + k AS STRING) || '-01-01' AS effective_at FROM customer CROSS JOIN (VALUES (0, 'a'), (1, 'c'), (2, 'd')) v(k, p)",
    "applications": """SELECT o_orderkey AS application, CASE o_orderkey % 10 WHEN 0 THEN 'APPROVED' WHEN 1 THEN 'DRAFT' ELSE 'ANALYZED' END AS status, o_custkey AS company, o_custkey + 5 AS tax, 'm' || CAST(o_custkey % 9 AS STRING) AS applicant, o_orderkey % 23 > 0 AS identity_seen,
        CASE o_custkey % 6 WHEN 0 THEN 'MISMATCH' WHEN 1 THEN 'CO_SIGNER_REQUIRED' WHEN 2 THEN NULL ELSE 'READY' END AS verdict, CASE WHEN o_orderkey % 2 = 0 THEN '  ' ELSE 'known' END AS reason, CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN 0 ELSE o_custkey END AS doc_company,
        o_custkey + 5 AS doc_tax, o_orderkey % 19 > 0 AS original_seen, CASE WHEN o_custkey % 10 = 0 THEN 'PASSIVE' ELSE 'ACTIVE' END AS live, o_orderkey % 20 = 0 AS approved_before FROM orders""",
    "approvers": "SELECT o_orderkey AS application, 'm' || CAST(k AS STRING) AS mask FROM orders CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6)) v(k) WHERE (o_orderkey + k) % 2 = 0",
    "review": "SELECT l_orderkey AS doc, CASE l_partkey % 6 WHEN 0 THEN 'company.name' WHEN 1 THEN 'rules[' || CAST(l_linenumber AS STRING) || ']' WHEN 2 THEN 'validUntil' WHEN 3 THEN 'representatives[rep-1].mode' WHEN 4 THEN 'representatives[1].mode' ELSE 'company.name2' END AS path FROM lineitem WHERE l_suppkey % 4 = 0",
    "corrected": "SELECT l_orderkey AS doc, 'company.name' AS path FROM lineitem WHERE l_partkey % 2 = 0 UNION ALL SELECT l_orderkey, 'validUntil' FROM lineitem WHERE l_partkey % 9 = 0",
    "versions": "SELECT c_custkey AS company, CAST(c_custkey % 4 AS BIGINT) AS version FROM customer WHERE c_custkey % 4 > 0",
    "records": "SELECT o_orderkey AS authority, o_custkey AS company, o_orderkey % 100 AS version, CASE WHEN o_orderkey % 3 = 0 THEN 'SUSPENDED' ELSE 'ACTIVE' END AS status FROM orders WHERE o_orderkey % 2 = 0",
    "decided": "SELECT o_orderkey AS txn_id, o_custkey AS company, CASE WHEN o_orderkey % 6 > 0 THEN 'ALLOWED' END AS verdict, o_orderkey + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS authority FROM orders",
    "app": """SELECT c_custkey AS case_id, 'Nil ' || c_mktsegment || ' Ltd. Şti.' AS app_company, '1' || CAST(c_custkey AS STRING) AS app_tax, '01 ' || CAST(c_custkey % 300 AS STRING) AS app_mersis, 'Çağ  ' || c_mktsegment AS app_name, '123***' || CAST(10 + c_custkey % 80 AS STRING) AS app_tckn, CAST('2026-08-01' AS DATE) AS as_of FROM customer""",
    "read": "SELECT c_custkey AS case_id, 'NİL ' || c_mktsegment || ' LİMİTED ŞİRKETİ' AS doc_company, '1' || CAST(c_custkey AS STRING) AS doc_tax, '01' || CAST(c_custkey % 300 AS STRING) AS doc_mersis, CAST('2027-01-01' AS DATE) AS doc_valid_until FROM customer WHERE c_custkey % 12 > 0",
    "named": """SELECT c_custkey AS case_id, k AS ordinal, CASE WHEN (c_custkey + k) % 3 = 0 THEN 'cag ' || lower(c_mktsegment) ELSE 'Başka ' || CAST(k AS STRING) END AS name, '123******' || CAST(10 + (c_custkey + k) % 80 AS STRING) AS tckn, CASE WHEN k % 2 = 0 THEN 'SOLE' ELSE 'JOINT' END AS mode FROM customer CROSS JOIN (VALUES (0), (1), (2), (3)) v(k)""",
    "registered": "SELECT s_suppkey AS ordinal, '01' || CAST(s_suppkey % 60 AS STRING) AS mersis, CASE WHEN s_suppkey % 8 = 0 THEN 'Passive' ELSE 'active' END AS status FROM supplier",
    "registered_people": "SELECT '01' || CAST(s_suppkey % 60 AS STRING) AS company, s_suppkey AS ordinal, 'CAĞ ' || CASE s_suppkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'HOUSEHOLD' END AS name, CASE WHEN s_suppkey % 2 = 0 THEN '123**' || CAST(10 + s_suppkey % 80 AS STRING) END AS tckn, CASE WHEN s_suppkey % 5 = 0 THEN 'REMOVED' ELSE 'ACTIVE' END AS status FROM supplier",
    "links": "SELECT o_custkey AS application, o_orderkey AS document, o_orderkey // 2 AS extraction, o_orderkey % 1000 AS report, CASE WHEN o_orderkey % 2 = 0 THEN 'READY' ELSE 'MISMATCH' END AS verdict, o_orderkey % 50 AS authority FROM orders",
    "clients": "SELECT c_custkey AS application FROM customer",
    "refs": "SELECT o_custkey AS doc, o_orderkey AS ordinal, CASE o_orderkey % 5 WHEN 0 THEN 'ic_yonerge' WHEN 1 THEN 'gazette' WHEN 2 THEN 'other' WHEN 3 THEN 'board_resolution' ELSE 'imza_beyannamesi' END AS type, CAST(NULL AS DATE) AS date, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 3 AS STRING) END AS number FROM orders",
    "labelled": "SELECT o_custkey AS doc, split(CASE o_orderkey % 3 WHEN 0 THEN 'rules~gazette_annex' WHEN 1 THEN 'rules' ELSE 'ic_yonerge_annex' END, '~') AS labels FROM orders WHERE o_custkey % 2 = 0",
    "held": "SELECT DISTINCT user_id AS doc, event_type AS path, '0' AS value FROM events WHERE user_id % 3 > 0",
    "batches": "SELECT user_id AS doc, event_id // 40 AS batch, min(event_id) AS seq, event_type AS path, CAST(min(event_id) // 40 % 2 AS STRING) AS old_value, CAST(max(event_id) % 2 AS STRING) AS new_value FROM events GROUP BY user_id, event_id // 40, event_type",
    "analyses": "SELECT o_orderkey AS application, CASE o_orderkey % 5 WHEN 0 THEN 'ANALYZED' WHEN 1 THEN 'ANALYZING' WHEN 2 THEN 'DOCUMENT_SCANNED' WHEN 3 THEN 'ANALYSIS_FAILED' ELSE 'DRAFT' END AS state FROM orders",
    "done": "SELECT o_orderkey AS application FROM orders WHERE o_orderkey % 3 = 0",
    "attempts": "SELECT l_orderkey AS job, l_linenumber AS attempt, l_partkey % 3 = 0 AS ok FROM lineitem",
    "payloads": """SELECT c_custkey AS id, '{"kind": {"a": "' || CASE WHEN c_custkey % 3 = 0 THEN 'x' ELSE 'y' END || '"}, "list": [{"k": "1", "v": "' || CAST(c_custkey % 2 AS STRING) || '"}, {"k": "2"}]}' AS payload FROM customer""",
    "stored": """SELECT sha2(c_name, 256) || '__1-0__' || c_mktsegment AS key, CASE c_custkey % 4 WHEN 0 THEN '{"v": ' WHEN 1 THEN NULL ELSE '{"v": ' || CAST(c_custkey AS STRING) || '}' END AS payload FROM customer WHERE c_custkey % 5 > 0""",
    "texts": """SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN '1.' || CAST(100 + o_orderkey % 900 AS STRING) || ',5 TL' WHEN 1 THEN CAST(o_orderkey AS STRING) || ' ₺' WHEN 2 THEN '12,345' WHEN 3 THEN '99999999999999999999' ELSE 'yok' END AS amount, CAST(o_totalprice * 1000 AS BIGINT) AS bytes,
        CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderkey % 3 * 150000 AS BIGINT) END AS low, CASE WHEN o_orderkey % 4 > 0 THEN CAST(123456 AS BIGINT) END AS high, CASE o_orderkey % 6 WHEN 0 THEN 'rules_p3-5' WHEN 1 THEN 'a_p1+4' WHEN 2 THEN 'x_p7' WHEN 3 THEN 'x_p5-3' WHEN 4 THEN '_p1_p2' ELSE 'rules' END AS chunk,
        CASE o_orderkey % 4 WHEN 0 THEN '```json' || chr(10) || '[1]' || chr(10) || '```' ELSE ' [2] ' END AS answer, CASE o_orderkey % 5 WHEN 0 THEN 'C:' || chr(92) || 'a' || chr(92) || 'b?.pdf' WHEN 1 THEN '/x/ y .pdf ' WHEN 2 THEN NULL WHEN 3 THEN '<>' ELSE 'imza sirküsü.pdf' END AS file,
        CASE o_orderkey % 4 WHEN 0 THEN 'IŞIK  Çelik-Öz' WHEN 1 THEN ' İÇ ve DIŞ' WHEN 2 THEN 'Kâmil' ELSE '...' END AS name, CASE o_orderkey % 5 WHEN 0 THEN 'Case2 x' WHEN 1 THEN 'doc 03' WHEN 2 THEN 'case4' WHEN 3 THEN '1102' ELSE 'case1' END AS document FROM orders""",
}
CATALOG = [("both", [{"path": "kind.a", "equals": "x"}, {"path": "list", "contains": {"k": "1", "v": "1"}}]), ("listed", [{"path": "list", "contains": {"k": "1", "v": "0"}}]), ("never", [{"path": "kind.b", "equals": "x"}]), ("kind", [{"path": "kind.a", "equals": "y"}])]


def _input(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [inputs.rows(spark, sf_dir, INPUTS[n]) for n in names]


def cosigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authority.cosign(*_input(spark, sf_dir, "requests", "pending", "now", "signers"))


def blocking_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validation.blocking(*_input(spark, sf_dir, "review", "corrected"))
    return found.groupBy("doc", "path").agg(F.count("*").alias("n"))


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    given, persons, review, corrected, versions = _input(spark, sf_dir, "applications", "approvers", "review", "corrected", "versions")
    open_ = validation.blocking(review, corrected).withColumnRenamed("doc", "application")
    return authority.approve(given, persons, open_, versions)


def active_authorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    (records,) = _input(spark, sf_dir, "records")
    return authority.latest(records.filter("status = 'ACTIVE'"), "company", F.desc("version"), F.desc("authority")).select("company", "authority", "version")


def transaction_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authority.history(*_input(spark, sf_dir, "decided", "records")).select("txn_id", "place", "version", "authority_status")


def effective_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pending, signers = _input(spark, sf_dir, "pending", "signers")
    return authority.with_effective_dates(pending.select("company", F.col("initiator").alias("person"), "txn_id"), signers).select("txn_id", "effective_at", "registry_status")


def case_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine checks from tables as they are kept, with every look-up."""
    found = lookup.cases(*_input(spark, sf_dir, "app", "read", "named", "registered", "registered_people"))
    return comparison.compare(found).select("case_id", "rep_name", "rep_mode", "reg_status", "reg_rep_status", *comparison.CHECKS, "verdict")


def latest_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    clients, links = _input(spark, sf_dir, "clients", "links")
    corrections = links.filter("document % 3 = 0").select("extraction")
    return lookup.chain(clients, links, links, links, corrections, links)


def reference_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.references(*_input(spark, sf_dir, "refs", "labelled")).drop("date")


def reference_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    (refs,) = _input(spark, sf_dir, "refs")
    found = merging.distinct_in_order(refs, ["doc"], "ordinal", "type")
    return found.select("doc", F.array_join("items", ";").alias("types"))


def correction_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.apply_batches(*_input(spark, sf_dir, "held", "batches"), "doc")


def corrected_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    (corrected,) = _input(spark, sf_dir, "corrected")
    return corrected.groupBy("doc").agg(F.array_join(F.array_sort(F.collect_set("path")), ";").alias("paths"))


def analysis_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.once(*_input(spark, sf_dir, "analyses", "done"))


def retried_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.retried(*_input(spark, sf_dir, "attempts"))


def catalog_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    (payloads,) = _input(spark, sf_dir, "payloads")
    return payloads.select("id", results.choice(F.col("payload"), CATALOG).alias("entry"))


def stored_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    (stored,) = _input(spark, sf_dir, "stored")
    asked = inputs.rows(spark, sf_dir, "SELECT c_custkey AS id, sha2(c_name, 256) || '__1-0__' || c_mktsegment AS key FROM customer")
    return results.hits(asked, stored, "v bigint").select("id", "result.v")


def replayed_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    (stored,) = _input(spark, sf_dir, "stored")
    asked = inputs.rows(spark, sf_dir, "SELECT c_custkey AS id, sha2(c_name, 256) AS sha FROM customer")
    return results.replayed(asked, stored, "v bigint").select("id", "result.v")


def ingested_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document texts as files with the beginnings of four types."""
    heads = F.when(F.col("doc_id") % 4 == 0, "%PDF-").when(F.col("doc_id") % 4 == 1, "\u0000").otherwise("")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.format_string("/in/%d .x", "doc_id").alias("path"), F.encode(F.concat(heads, F.when(F.col("doc_id") % 8 != 2, F.col("text")).otherwise("")), "utf-8").alias("content"))
    return documents.ingest(docs, 5000)


def form_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    (rows,) = _input(spark, sf_dir, "texts")
    c = F.col
    pages = F.array_join(F.transform(T.chunk_pages(c("chunk")), lambda p: p.cast("string")), ",")
    return rows.select(
        "id", T.parse_amount(c("amount")).alias("minor"), T.file_size(c("bytes")).alias("size"), T.amount_range(c("low"), c("high")).alias("span"), pages.alias("pages"), T.without_fence(c("answer")).alias("answer"),
        T.display_name(c("file"), F.lit(".pdf")).alias("file"), T.normalize_name(c("name")).alias("name"), results.stub(c("document")).alias("stub"),
    )


def authorization_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes that more than one transaction has: none are allowed."""
    (rows,) = _input(spark, sf_dir, "pending")
    codes = authority.with_codes(rows.select("txn_id"), "txn_id", parts=("cosign",))
    return codes.groupBy("code").agg(F.count("*").alias("n")).select(F.length("code").alias("width"), "n").groupBy("width", "n").agg(F.count("*").alias("codes"))


def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open and waiting applications, active authorities, alerts of the registry."""
    applications, records, registered, people = _input(spark, sf_dir, "applications", "records", "registered", "registered_people")
    own = applications.agg(F.count_if(~lookup.is_terminal(F.col("status"))).alias("open_count"), F.count_if(F.col("status") == "ANALYZED").alias("review_count"))
    active = records.agg(F.count_if(F.col("status") == "ACTIVE").alias("active_count"))
    alerts = registered.agg(F.count_if(F.upper("status") != "ACTIVE").alias("a")).select("a").union(people.agg(F.count_if(F.col("status") == "REMOVED"))).agg(F.sum("a").alias("alert_count"))
    return own.select("*", active.scalar().alias("active_count"), alerts.scalar().alias("alert_count"))


def branch_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    (rows,) = _input(spark, sf_dir, "applications")
    return rows.select("application", lookup.form_step(F.col("status")).alias("step"), lookup.is_terminal(F.col("status")).alias("terminal"), lookup.available(F.col("verdict"), F.col("application") % 2).alias("approve"))


def newest_applications(spark: SparkSession, sf_dir: str) -> DataFrame:
    (links,) = _input(spark, sf_dir, "links")
    return lookup.newest_distinct(links, "application", "document")


def audit_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("event_id", "id")
    return lookup.audit(events, event_type="click", user_id=None).select("id", "user_id")


ALL = (
    cosigned, blocking_review, approvals, active_authorities, transaction_history, effective_dates, case_lookups, latest_chain, reference_files, reference_lists, correction_batches, corrected_paths, analysis_actions,
    retried_jobs, catalog_choices, stored_hits, replayed_results, ingested_files, form_texts, authorization_codes, dashboard, branch_forms, newest_applications, audit_filtered,
)


def oracle_sql() -> dict[str, str]:
    own = {k: v.replace("sha2(c_name, 256)", "sha256(c_name)") for k, v in INPUTS.items()}
    given = lambda *names, more="": inputs.given(own, *names, more=more)
    n, mask = inputs.normal, lambda x: f"CASE WHEN regexp_full_match(trim({x}), '[0-9]{{3}}\\*+[0-9]{{2}}') THEN left(trim({x}), 3) || right(trim({x}), 2) END"
    open_ = "SELECT doc, path FROM review WHERE (path IN ('company.name', 'validUntil') OR path LIKE 'representatives[rep-%') AND (doc, path) NOT IN (SELECT doc, path FROM corrected)"
    green = lambda ok: f"CASE WHEN coalesce({ok}, false) THEN 'green' ELSE 'red' END"
    last = lambda key, id: f"SELECT {key}, max({id}) AS {id} FROM links GROUP BY {key}"
    money = lambda x: f"replace(format('{{:,}}', {x} // 100), ',', '.') || ',' || lpad(CAST({x} % 100 AS STRING), 2, '0') || ' TL'"
    return {
        "cosigned": f"""{given("requests", "pending", "now", "signers")}, j AS (SELECT r.txn_id, r.cosigner AS asked, p.status, p.initiator, p.required, p.cosigner, n.verdict, n.cosigner AS due, s.status = 'ACTIVE' AS live FROM requests r LEFT JOIN pending p ON p.txn_id = r.txn_id LEFT JOIN now n ON n.txn_id = r.txn_id LEFT JOIN signers s ON s.company = p.company AND s.person = r.cosigner),
            a AS (SELECT *, CASE WHEN status IS NULL THEN 'NOT_FOUND' WHEN status = 'ALLOWED' AND cosigner = asked THEN 'ALREADY_ALLOWED' WHEN status <> 'PENDING_COSIGN' THEN 'NOT_PENDING' WHEN asked = initiator THEN 'SELF_COSIGN' WHEN asked <> required THEN 'WRONG_COSIGNER' WHEN verdict <> 'PENDING_COSIGN' OR due <> asked THEN 'REVALIDATION_FAILED' WHEN NOT coalesce(live, false) THEN 'COSIGNER_NOT_ACTIVE' ELSE 'SIGNED' END AS answer FROM j)
            SELECT txn_id, asked AS cosigner, answer, CASE WHEN answer = 'SIGNED' THEN 'ALLOWED' WHEN answer IN ('REVALIDATION_FAILED', 'COSIGNER_NOT_ACTIVE') THEN 'DENIED' ELSE status END AS status,
              CASE WHEN answer IN ('SIGNED', 'ALREADY_ALLOWED') THEN 'YTK-' || array_to_string(list_transform(range(8), lambda i: substr('0123456789ABCDEFGHJKMNPQRSTVWXYZ', CAST(('0x' || substr(sha256(CAST(txn_id AS STRING) || '|cosign'), 2 * i + 1, 2)) AS INT) % 32 + 1, 1)), '') END AS code FROM a""",
        "blocking_review": f"{given('review', 'corrected')} SELECT doc, path, count(*) AS n FROM ({open_}) GROUP BY ALL",
        "approvals": f"""{given("applications", "approvers", "review", "corrected", "versions")}, marked AS (SELECT a.*, CASE WHEN status = 'APPROVED' AND approved_before THEN 'ALREADY_APPROVED' WHEN status <> 'ANALYZED' THEN 'INVALID_STATE' WHEN doc_company IS NULL THEN 'NO_EXTRACTION' WHEN verdict IS NULL OR verdict NOT IN ('READY', 'CO_SIGNER_REQUIRED') THEN 'VERDICT_NOT_APPROVABLE'
              WHEN verdict = 'CO_SIGNER_REQUIRED' AND trim(reason) = '' THEN 'REASON_REQUIRED' WHEN application IN (SELECT doc FROM ({open_})) THEN 'REVIEW_OPEN' WHEN NOT identity_seen THEN 'IDENTITY_NOT_SEEN' WHEN NOT original_seen THEN 'ORIGINAL_NOT_SEEN' WHEN live <> 'ACTIVE' THEN 'COMPANY_NOT_ACTIVE' WHEN doc_company <> company OR doc_tax <> tax THEN 'OTHER_COMPANY'
              WHEN (application, applicant) NOT IN (SELECT application, mask FROM approvers) THEN 'APPLICANT_NOT_FOUND' END AS refused FROM applications a)
            SELECT application, refused, CASE WHEN refused IS NULL THEN coalesce((SELECT max(version) FROM versions v WHERE v.company = m.company), 0) + row_number() OVER (PARTITION BY company, refused IS NULL ORDER BY application) END AS version FROM marked m""",
        "active_authorities": f"{given('records')} SELECT company, authority, version FROM records WHERE status = 'ACTIVE' QUALIFY row_number() OVER (PARTITION BY company ORDER BY version DESC, authority DESC) = 1",
        "transaction_history": f"{given('decided', 'records')} SELECT d.txn_id, count(*) OVER (PARTITION BY d.company ORDER BY d.txn_id DESC) AS place, r.version, r.status AS authority_status FROM decided d JOIN records r ON r.authority = d.authority WHERE d.verdict IS NOT NULL",
        "effective_dates": f"{given('pending', 'signers')} SELECT p.txn_id, s.effective_at, s.status AS registry_status FROM pending p LEFT JOIN signers s ON s.company = p.company AND s.person = p.initiator",
        "case_lookups": f"""{given("app", "read", "named", "registered", "registered_people")}, person AS (SELECT a.case_id, arg_min(r.name, r.ordinal) AS rep_name, arg_min(r.mode, r.ordinal) AS rep_mode, arg_min(r.tckn, r.ordinal) AS rep_tckn FROM app a JOIN named r ON r.case_id = a.case_id AND {n("a.app_name")} = {n("r.name")} GROUP BY a.case_id),
            company AS (SELECT a.case_id, arg_min(g.mersis, g.ordinal) AS company, arg_min(g.status, g.ordinal) AS reg_status FROM app a JOIN registered g ON regexp_replace(a.app_mersis, '[^0-9]', '', 'g') = regexp_replace(g.mersis, '[^0-9]', '', 'g') GROUP BY a.case_id),
            rep AS (SELECT a.case_id, arg_min(q.name, q.ordinal) AS reg_rep_name, arg_min(coalesce(q.tckn, '-'), q.ordinal) AS t, arg_min(q.status, q.ordinal) AS reg_rep_status FROM app a JOIN company c ON c.case_id = a.case_id JOIN registered_people q ON q.company = c.company AND {n("a.app_name")} = {n("q.name")} GROUP BY a.case_id),
            rows AS (SELECT a.*, d.* EXCLUDE (case_id), p.* EXCLUDE (case_id), c.reg_status, r.reg_rep_name, nullif(r.t, '-') AS reg_rep_tckn, r.reg_rep_status FROM app a LEFT JOIN read d ON d.case_id = a.case_id LEFT JOIN person p ON p.case_id = a.case_id LEFT JOIN company c ON c.case_id = a.case_id LEFT JOIN rep r ON r.case_id = a.case_id),
            checked AS (SELECT case_id, rep_name, rep_mode, reg_status, reg_rep_status, {green("doc_company IS NOT NULL")} AS company_name_match, {green("app_tax = doc_tax")} AS tax_number_match, {green("replace(app_mersis, ' ', '') = doc_mersis")} AS mersis_number_match, {green("rep_name IS NOT NULL")} AS applicant_in_document, {green(f"{mask('app_tckn')} = {mask('rep_tckn')}")} AS identity_match,
              CASE rep_mode WHEN 'SOLE' THEN 'green' WHEN 'JOINT' THEN 'amber' ELSE 'red' END AS authority_mode, {green("upper(reg_status) = 'ACTIVE'")} AS registry_status, {green(f"reg_status IS NOT NULL AND reg_rep_status = 'ACTIVE' AND (reg_rep_tckn IS NULL OR {mask('app_tckn')} = {mask('reg_rep_tckn')})")} AS registry_representative_match, {green("doc_valid_until >= as_of")} AS document_validity FROM rows)
            SELECT *, CASE WHEN 'red' IN (company_name_match, tax_number_match, mersis_number_match, applicant_in_document, identity_match, authority_mode, document_validity) THEN 'MISMATCH' WHEN 'red' IN (registry_status, registry_representative_match) THEN 'REGISTRY_CONFLICT' WHEN authority_mode = 'amber' THEN 'CO_SIGNER_REQUIRED' ELSE 'READY' END AS verdict FROM checked""",
        "latest_chain": f"""{given("clients", "links")}, d AS ({last("application", "document")}), e AS ({last("document", "extraction")}), r AS (SELECT extraction, max(report) AS report, arg_max(verdict, report) AS verdict FROM links GROUP BY extraction), k AS (SELECT extraction, count(*) AS corrected FROM links WHERE document % 3 = 0 GROUP BY extraction), a AS ({last("application", "authority")})
            SELECT c.application, d.document, e.extraction, r.report, r.verdict, coalesce(k.corrected, 0) AS corrected, a.authority FROM clients c LEFT JOIN d ON d.application = c.application LEFT JOIN e ON e.document = d.document LEFT JOIN r ON r.extraction = e.extraction LEFT JOIN k ON k.extraction = e.extraction LEFT JOIN a ON a.application = c.application""",
        "reference_files": f"""{given("refs", "labelled")}, one AS (SELECT * FROM refs QUALIFY row_number() OVER (PARTITION BY doc, type, number ORDER BY ordinal) = 1), there AS (SELECT DISTINCT doc, unnest(labels) AS label FROM labelled)
            SELECT doc, ordinal, type, number, CASE WHEN (doc, CASE type WHEN 'ic_yonerge' THEN 'ic_yonerge_annex' WHEN 'gazette' THEN 'gazette_annex' WHEN 'board_resolution' THEN 'board_resolution_annex' ELSE '-' END) IN (SELECT doc, label FROM there) THEN 'in_file' WHEN type = 'other' THEN 'unknown' ELSE 'external' END AS found FROM one""",
        "reference_lists": f"{given('refs')} SELECT doc, string_agg(type, ';' ORDER BY first) AS types FROM (SELECT doc, type, min(ordinal) AS first FROM refs GROUP BY ALL) GROUP BY doc",
        "correction_batches": f"""{given("held", "batches", more="RECURSIVE ")}, items AS (SELECT doc, batch, list({{'path': path, 'old_value': old_value, 'new_value': new_value}} ORDER BY seq) AS items, row_number() OVER (PARTITION BY doc ORDER BY batch) AS k FROM batches GROUP BY doc, batch),
            run AS (SELECT doc, 0::BIGINT AS k, NULL::BIGINT AS batch, false AS applied, coalesce((SELECT map_from_entries(list({{'k': path, 'v': value}})) FROM held h WHERE h.doc = d.doc), MAP {{}}::MAP(VARCHAR, VARCHAR)) AS now FROM (SELECT DISTINCT doc FROM items) d UNION ALL SELECT doc, k, batch, fits, CASE WHEN fits THEN map_concat(now, map_from_entries(list_transform(items, lambda x: {{'k': x.path, 'v': x.new_value}}))) ELSE now END
              FROM (SELECT r.doc, i.k, i.batch, i.items, r.now, list_bool_and(list_transform(i.items, lambda x: coalesce(map_contains(r.now, x.path) AND r.now[x.path] = x.old_value, false))) AS fits FROM run r JOIN items i ON i.doc = r.doc AND i.k = r.k + 1))
            SELECT doc, batch, applied FROM run WHERE k > 0""",
        "corrected_paths": f"{given('corrected')} SELECT doc, string_agg(DISTINCT path, ';' ORDER BY path) AS paths FROM corrected GROUP BY doc",
        "analysis_actions": f"{given('analyses', 'done')} SELECT application, CASE WHEN state = 'ANALYZED' AND application IN (SELECT application FROM done) THEN 'RETURN_STORED' WHEN state = 'ANALYZING' THEN 'IN_PROGRESS' WHEN state = 'DRAFT' THEN 'INVALID_STATE' ELSE 'RUN' END AS action FROM analyses",
        "retried_jobs": f"{given('attempts')} SELECT job, coalesce(min(attempt) FILTER (ok), max(attempt)) AS tries, CASE WHEN bool_or(ok) THEN 'success' ELSE 'failed' END AS status FROM attempts WHERE attempt <= 2 GROUP BY job",
        "catalog_choices": "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 AND c_custkey % 2 = 1 THEN 'both' WHEN c_custkey % 2 = 0 THEN 'listed' WHEN c_custkey % 3 <> 0 THEN 'kind' END AS entry FROM customer",
        "stored_hits": "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 > 0 AND c_custkey % 4 > 1 THEN c_custkey END AS v FROM customer",
        "replayed_results": "SELECT c_custkey AS id, CASE WHEN c_custkey % 5 > 0 AND c_custkey % 4 > 1 THEN c_custkey END AS v FROM customer",
        "ingested_files": """SELECT path, CAST(doc_id AS STRING) || ' .x' AS name, CASE doc_id % 4 WHEN 0 THEN 'application/pdf' END AS mime, octet_length(content) AS bytes, sha256(content) AS sha256, CASE WHEN octet_length(content) = 0 THEN 'EMPTY' WHEN octet_length(content) > 5000 THEN 'TOO_LARGE' WHEN doc_id % 4 > 0 THEN 'UNSUPPORTED_TYPE' END AS refused
            FROM (SELECT doc_id, '/in/' || CAST(doc_id AS STRING) || ' .x' AS path, encode(CASE doc_id % 4 WHEN 0 THEN '%PDF-' WHEN 1 THEN chr(0) ELSE '' END || CASE WHEN doc_id % 8 <> 2 THEN text ELSE '' END) AS content FROM documents)""",
        "form_texts": f"""{given("texts")} SELECT id, CASE id % 5 WHEN 0 THEN (1000 + 100 + id % 900) * 100 + 50 WHEN 1 THEN id * 100 END AS minor, CASE WHEN bytes < 1024 THEN bytes || ' B' WHEN bytes < 1048576 THEN CAST(round(bytes / 1024) AS BIGINT) || ' KB' ELSE CAST(round(bytes / 1048576, 1) AS DECIMAL(20, 1)) || ' MB' END AS size,
            CASE WHEN low IS NULL AND high IS NULL THEN 'Tutar sınırı yok' WHEN low IS NULL THEN {money("high")} || ' ve altı' WHEN high IS NULL THEN {money("low")} || ' ve üzeri' ELSE {money("low")} || ' – ' || {money("high")} END AS span,
            CASE id % 6 WHEN 0 THEN '3,4,5' WHEN 1 THEN '1,4' WHEN 2 THEN '7' WHEN 4 THEN '2' ELSE '' END AS pages, CASE WHEN id % 4 = 0 THEN '[1]' ELSE '[2]' END AS answer, CASE id % 5 WHEN 0 THEN 'b?.pdf' WHEN 1 THEN 'y .pdf' WHEN 3 THEN '<>' WHEN 4 THEN 'imza sirküsü.pdf' ELSE 'belge.pdf' END AS file,
            CASE id % 4 WHEN 0 THEN 'ışık çelik öz' WHEN 1 THEN 'iç ve dış' WHEN 2 THEN 'k mil' ELSE '' END AS name, CASE id % 5 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 2 THEN 4 WHEN 3 THEN 2 ELSE 1 END AS stub FROM texts""",
        "authorization_codes": f"{given('pending')} SELECT 12 AS width, 1 AS n, count(*) AS codes FROM pending",
        "dashboard": f"{given('applications', 'records', 'registered', 'registered_people')} SELECT (SELECT count(*) FROM applications WHERE status <> 'APPROVED') AS open_count, (SELECT count(*) FROM applications WHERE status = 'ANALYZED') AS review_count, (SELECT count(*) FROM records WHERE status = 'ACTIVE') AS active_count, (SELECT count(*) FROM registered WHERE upper(status) <> 'ACTIVE') + (SELECT count(*) FROM registered_people WHERE status = 'REMOVED') AS alert_count",
        "branch_forms": f"{given('applications')} SELECT application, CASE status WHEN 'DRAFT' THEN 1 ELSE 3 END AS step, status = 'APPROVED' AS terminal, CASE WHEN application % 2 = 1 OR verdict IS NULL THEN 'hidden' WHEN verdict = 'READY' THEN 'normal' WHEN verdict = 'CO_SIGNER_REQUIRED' THEN 'override' ELSE 'hidden' END AS approve FROM applications",
        "newest_applications": f"{given('links')} SELECT application, max(document) AS document FROM links GROUP BY application ORDER BY document DESC LIMIT 8",
        "audit_filtered": "SELECT event_id AS id, user_id FROM events WHERE event_type = 'click' ORDER BY event_id DESC LIMIT 200",
    }
