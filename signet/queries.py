"""Every query of the engine by name, and the SQL that DuckDB can run beside it.

Inputs are derived from the driver's tables by SELECTs that Spark and DuckDB both
run (``INPUTS``); what is computed from them is written twice, as DataFrame operators
here and as SQL in ``oracle_sql``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decision_queries, display_queries, extraction_queries, inputs, store_queries
from . import record_queries as R
from .functions import text as T
from .operators import authority, comparison, pages

TABLES = inputs.TABLES
#: Driver rows as the engine's own inputs.
INPUTS = {
    "transactions": """SELECT o_orderkey AS txn_id, o_custkey AS company, CASE WHEN o_orderkey % 5 = 0 THEN 'CREDIT' WHEN o_orderkey % 7 = 0 THEN 'REAL_ESTATE' ELSE 'GENERAL' END AS subject,
        CAST(floor(o_totalprice * 100) AS BIGINT) AS amount, 'p' || CAST(o_orderkey % 4 AS STRING) AS initiator, CAST(o_orderdate AS DATE) AS day FROM orders""",
    "authorities": """SELECT c_custkey AS company, CASE WHEN c_custkey % 9 = 0 THEN 'SUSPENDED' ELSE 'ACTIVE' END AS status,
        CASE WHEN c_custkey % 4 = 0 THEN CAST('1996-06-30' AS DATE) END AS valid_until FROM customer WHERE c_custkey % 13 <> 0""",
    "persons": """SELECT c_custkey AS company, 'p' || CAST(k AS STRING) AS person, 's' || CAST(k AS STRING) AS source_id, CASE WHEN k = 0 THEN 'SOLE' WHEN c_custkey % 2 = 0 THEN 'SOLE' ELSE 'JOINT' END AS mode,
        CASE WHEN k = 0 THEN CAST(20000000 AS BIGINT) END AS max_amount FROM customer CROSS JOIN (VALUES (0), (1), (2)) v(k) WHERE k < 2 OR c_custkey % 3 = 0""",
    "rules": """SELECT c_custkey AS company, s AS scope, CASE WHEN o = 0 THEN CAST(10000000 AS BIGINT) WHEN o = 1 THEN CAST(30000000 AS BIGINT) END AS threshold, CASE WHEN o = 2 THEN 'JOINT' ELSE 'SOLE' END AS mode, s = 'real_estate' AS blocked, o AS ordinal,
        split(CASE WHEN o < 2 THEN 'none' WHEN c_custkey % 5 = 0 THEN 's0~s1~s2' WHEN c_custkey % 5 = 1 THEN 's1~s2' ELSE 's0~s1' END, '~') AS signers
        FROM customer CROSS JOIN (VALUES ('general', 0), ('general', 1), ('general', 2), ('credit', 2), ('real_estate', 2)) v(s, o) WHERE o < 2 OR c_custkey % 6 <> 0""",
    "companies": "SELECT c_custkey AS company, CASE WHEN c_custkey % 17 = 0 THEN 'PASSIVE' ELSE 'ACTIVE' END AS status FROM customer WHERE c_custkey % 19 <> 0",
    "reps": "SELECT c_custkey AS company, 'p' || CAST(k AS STRING) AS person, CASE WHEN (c_custkey + k) % 7 = 0 THEN 'REMOVED' ELSE 'ACTIVE' END AS status FROM customer CROSS JOIN (VALUES (0, 0), (1, 0), (2, 0), (1, 1)) v(k, again) WHERE again = 0 OR c_custkey % 8 = 0",
    "cases": """SELECT c_custkey AS case_id, c_name || CASE c_custkey % 3 WHEN 0 THEN ' Ltd. Şti.' WHEN 1 THEN ' A.Ş.' ELSE ' San. ve Tic. Ltd.Şti.' END AS app_company,
        upper(c_name) || CASE c_custkey % 3 WHEN 0 THEN ' LİMİTED ŞİRKETİ' WHEN 1 THEN ' Anonim Şirketi' ELSE ' SANAYİ VE TİCARET LTD ŞTİ' END || CASE WHEN c_custkey % 11 = 0 THEN ' x' ELSE '' END AS doc_company,
        'VKN ' || CAST(1000000000 + c_custkey AS STRING) AS app_tax, CAST(1000000000 + c_custkey + CASE WHEN c_custkey % 17 = 0 THEN 1 ELSE 0 END AS STRING) AS doc_tax,
        '0123 ' || CAST(c_custkey AS STRING) AS app_mersis, '0123' || CAST(c_custkey AS STRING) AS doc_mersis,
        'İpek  ÇİĞDEM-' || c_mktsegment AS app_name, CASE WHEN c_custkey % 19 = 0 THEN NULL ELSE 'ipek çiğdem ' || lower(c_mktsegment) END AS rep_name,
        '123***' || CAST(10 + c_custkey % 80 AS STRING) AS app_tckn, '123******' || CAST(10 + c_custkey % 80 AS STRING) AS rep_tckn, CASE WHEN c_custkey % 3 = 0 THEN 'JOINT' ELSE 'SOLE' END AS rep_mode,
        CASE WHEN c_custkey % 23 = 0 THEN NULL WHEN c_custkey % 29 = 0 THEN 'CLOSED' ELSE 'active' END AS reg_status, 'Ipek Cigdem ' || c_mktsegment AS reg_rep_name,
        CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE '123****' || CAST(10 + c_custkey % 80 AS STRING) END AS reg_rep_tckn, CASE WHEN c_custkey % 31 = 0 THEN 'REMOVED' ELSE 'ACTIVE' END AS reg_rep_status,
        CASE WHEN c_custkey % 37 = 0 THEN NULL WHEN c_custkey % 2 = 0 THEN CAST('2026-08-01' AS DATE) ELSE CAST('2028-03-15' AS DATE) END AS doc_valid_until, CAST('2026-08-01' AS DATE) AS as_of FROM customer""",
    "doc_pages": "SELECT l_orderkey AS doc, l_linenumber + CAST(l_partkey % 2 AS INT) * 2 AS page FROM lineitem",
    "ids": """SELECT c_custkey AS id, CAST(10000000000 + (c_custkey * 7919) % 89999999999 AS STRING) AS tckn, CAST(1000000000 + (c_custkey * 104729) % 8999999999 AS STRING) AS vkn,
        CASE c_custkey % 3 WHEN 0 THEN ' 123***45 ' WHEN 1 THEN '12345678901' ELSE '98*****76' END AS mask FROM customer""",
    "dates": """SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN CAST(CAST(o_orderdate AS DATE) AS STRING) WHEN 1 THEN '14.03.' || CAST(1990 + o_orderkey % 40 AS STRING) WHEN 2 THEN ' 31/02/2026'
        WHEN 3 THEN CAST(1 + o_orderkey % 40 AS STRING) || '-' || CAST(1 + o_orderkey % 14 AS STRING) || '-2026' WHEN 4 THEN CAST(1 + o_orderkey % 28 AS STRING) || ' AĞUSTOS 2026' ELSE '14.03.26' END AS raw FROM orders""",
}


#: The same with holes: one column after another is null in some rows.
GAPS = {
    "transactions": f"""SELECT txn_id, CASE WHEN txn_id % 101 <> 0 THEN company END AS company, CASE WHEN txn_id % 103 <> 0 THEN subject END AS subject, CASE WHEN txn_id % 11 <> 0 THEN amount END AS amount,
        CASE WHEN txn_id % 107 <> 0 THEN initiator END AS initiator, CASE WHEN txn_id % 13 <> 0 THEN day END AS day FROM ({INPUTS["transactions"]}) t""",
    "authorities": f"SELECT company, CASE WHEN company % 23 <> 0 THEN status END AS status, valid_until FROM ({INPUTS['authorities']}) t",
    "persons": f"""SELECT company, CASE WHEN company % 29 <> 0 THEN person END AS person, CASE WHEN company % 10 <> 3 OR person = 'p1' THEN source_id END AS source_id, CASE WHEN company % 3 <> 1 THEN mode END AS mode, max_amount
        FROM ({INPUTS["persons"]}) t""",
    "rules": f"""SELECT company, CASE WHEN company % 31 <> 0 THEN scope END AS scope, threshold, CASE WHEN company % 37 <> 0 THEN mode END AS mode, CASE WHEN company % 2 = 0 OR blocked THEN blocked END AS blocked, ordinal,
        CASE WHEN company % 7 = 0 THEN NULL WHEN company % 7 = 1 THEN array(CAST(NULL AS STRING), 's1') ELSE signers END AS signers FROM ({INPUTS["rules"]}) t""",
    "companies": f"SELECT company, CASE WHEN company % 41 <> 0 THEN status END AS status FROM ({INPUTS['companies']}) t",
    "reps": f"SELECT company, person, CASE WHEN company % 43 <> 0 OR person <> 'p0' THEN status END AS status FROM ({INPUTS['reps']}) t",
}
GIVEN = ("transactions", "authorities", "persons", "rules", "companies", "reps")


def _input(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return inputs.rows(spark, sf_dir, INPUTS[name])


def authorize_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authority.evaluate(*(_input(spark, sf_dir, n) for n in GIVEN))


def authorize_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over inputs with holes in every column: what isn't known denies."""
    return authority.evaluate(*(inputs.rows(spark, sf_dir, GAPS[n]) for n in GIVEN))


def compare_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comparison.compare(_input(spark, sf_dir, "cases")).select("case_id", *comparison.CHECKS, "verdict")


def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.select("doc_id", F.sha2(T.tr_normalize(F.col("text")), 256).alias("normal_sha256"))


def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = T.redact(F.concat_ws(" ", F.lit("id 12345678901;"), F.col("doc_id").cast("string"), "text"))
    return docs.select("doc_id", kept.alias("kept"))


def identifier_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return _input(spark, sf_dir, "ids").select("id", T.valid_tckn(c("tckn")).alias("tckn_ok"), T.valid_vkn(c("vkn")).alias("vkn_ok"), T.masked_id(c("mask")).alias("masked"))


def parse_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _input(spark, sf_dir, "dates").select("id", T.parse_date(F.col("raw")).alias("parsed"))


def format_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _input(spark, sf_dir, "transactions").select("txn_id", T.format_amount(F.col("amount")).alias("label"))


def page_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.windows(_input(spark, sf_dir, "doc_pages"))
    return found.select("doc", "start", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"))


def page_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.runs(_input(spark, sf_dir, "doc_pages"))


def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authority.latest(_input(spark, sf_dir, "transactions"), "company", F.desc("day"), F.desc("txn_id")).select("company", "txn_id", "amount")


def next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = _input(spark, sf_dir, "transactions").groupBy("company").agg(F.max("txn_id").alias("last"))
    known = _input(spark, sf_dir, "authorities").join(versions, "company", "left")
    return known.select("company", (F.coalesce("last", F.lit(0)) + 1).alias("next"))


def audit_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_type = 'click' or value > 50")
    return events.orderBy(F.desc("event_id")).limit(200).select("event_id", "user_id", "event_type")


def dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = authorize_batch(spark, sf_dir)
    return found.agg(F.count_if(F.col("verdict") == "PENDING_COSIGN").alias("open_count"), F.count_if(F.col("verdict") == "ALLOWED").alias("allowed"), F.count_if(F.col("failed_step") == "authority_not_active").alias("alerts"))


def denied_by_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    return authorize_batch(spark, sf_dir).filter("verdict = 'DENIED'").groupBy("failed_step").agg(F.count("*").alias("n"))


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions whose company has no authority: what a foreign key would refuse."""
    return _input(spark, sf_dir, "transactions").join(_input(spark, sf_dir, "authorities"), "company", "left_anti").select("txn_id", "company")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (authorize_batch, authorize_gaps, compare_checks, normalize_text, redact_text, identifier_checks, parse_dates, format_amounts, page_windows, page_runs, latest_version, next_version, audit_newest, dashboard_counts, denied_by_step, orphans, *R.ALL, *extraction_queries.ALL, *decision_queries.ALL, *store_queries.ALL, *display_queries.ALL)}


def _with(*names: str) -> str:
    return inputs.given(INPUTS, *names)


_normal = inputs.normal


def _core(x: str) -> str:
    """SQL of a company's name without its legal form; longest forms first, and never to nothing."""
    two, one = "limited sirketi|anonim sirketi|kollektif sirketi|komandit sirketi|ltd sti|a s", "limited|anonim|sirketi|sirket|ltd|sti|as"
    bare = f"CASE WHEN regexp_full_match({_normal(x)}, '({two})( ({two}|{one}))*') THEN regexp_extract({_normal(x)}, '^({two})', 1) ELSE regexp_replace({_normal(x)}, '(.)( ({two}|{one}))+$', '\\1') END"
    return f"regexp_replace({bare}, '\\bsan( ve)? tic\\b', 'sanayi\\1 ticaret', 'g')"


_STEPS = f"""{_with(*GIVEN)}, live AS (SELECT company, person, count(*) AS n, bool_or(status = 'ACTIVE') AS active FROM reps GROUP BY company, person), picked AS (
  SELECT t.txn_id, r.mode, r.signers FROM transactions t JOIN rules r ON r.company = t.company AND r.scope = lower(t.subject) AND NOT r.blocked AND (r.threshold IS NULL OR t.amount <= r.threshold)
  QUALIFY row_number() OVER (PARTITION BY t.txn_id ORDER BY r.threshold NULLS LAST, r.ordinal) = 1
), joined AS (
  SELECT t.*, a.status, a.valid_until, p.source_id, p.mode AS my_mode, p.max_amount AS my_max, c.status AS company_status, l.n = 1 AND l.active AS sure, k.mode, k.signers,
    (SELECT count(*) FROM rules r WHERE r.company = t.company AND r.scope = lower(t.subject) AND r.blocked) AS blocks
  FROM transactions t LEFT JOIN authorities a ON t.company = a.company LEFT JOIN persons p ON p.company = t.company AND p.person = t.initiator
  LEFT JOIN companies c ON c.company = t.company LEFT JOIN live l ON l.company = t.company AND l.person = t.initiator LEFT JOIN picked k ON k.txn_id = t.txn_id
), counted AS (
  SELECT j.txn_id, count(o.person) AS others, min(o.person) AS other FROM joined j JOIN persons o ON o.company = j.company AND o.source_id <> j.source_id AND list_contains(j.signers, o.source_id)
  JOIN live l ON l.company = o.company AND l.person = o.person AND l.active GROUP BY j.txn_id
), stepped AS (
  SELECT j.txn_id, n.other, j.mode, CASE WHEN status IS NULL THEN 'no_authority' WHEN status <> 'ACTIVE' THEN 'authority_not_active' WHEN valid_until < day THEN 'authority_expired'
    WHEN my_mode IS NULL THEN 'initiator_unknown' WHEN company_status IS DISTINCT FROM 'ACTIVE' THEN 'company_not_active' WHEN NOT coalesce(sure, false) THEN 'initiator_not_active' WHEN blocks > 0 THEN 'scope_blocked' WHEN j.mode IS NULL THEN 'no_rule'
    WHEN j.mode = 'SOLE' AND NOT (my_mode = 'SOLE' AND (my_max IS NULL OR my_max >= amount)) THEN 'over_limit' WHEN j.mode = 'JOINT' AND NOT list_contains(signers, source_id) THEN 'not_a_signer' WHEN j.mode = 'JOINT' AND coalesce(n.others, 0) <> 1 THEN 'no_cosigner' END AS failed_step
  FROM joined j LEFT JOIN counted n ON n.txn_id = j.txn_id
), decided AS (
  SELECT txn_id, CASE WHEN failed_step IS NOT NULL THEN 'DENIED' WHEN mode = 'SOLE' THEN 'ALLOWED' ELSE 'PENDING_COSIGN' END AS verdict, failed_step,
    CASE WHEN failed_step IS NULL AND mode = 'JOINT' THEN other END AS cosigner FROM stepped
)"""


def _gap_steps() -> str:
    """Each condition for a verdict stands by itself here; nulls are decided one by one."""
    given = inputs.given({n: q.replace("array(", "list_value(") for n, q in GAPS.items()}, *GIVEN)
    return f"""{given}, mine AS (
  SELECT t.txn_id, count(p.person) AS n, min(p.source_id) AS source_id, min(p.mode) AS mode, min(p.max_amount) AS most FROM transactions t LEFT JOIN persons p ON p.company = t.company AND p.person = t.initiator GROUP BY t.txn_id
), live AS (SELECT company, person, count(*) AS n, count(*) FILTER (status = 'ACTIVE') AS active FROM reps GROUP BY company, person), fit AS (
  SELECT t.txn_id, r.mode, coalesce(r.signers, []) AS signers FROM transactions t JOIN rules r ON r.company = t.company AND r.scope = lower(t.subject) WHERE r.blocked IS NOT TRUE AND (r.threshold IS NULL OR t.amount <= r.threshold)
  QUALIFY row_number() OVER (PARTITION BY t.txn_id ORDER BY r.threshold NULLS LAST, r.ordinal) = 1
), seconds AS (
  SELECT t.txn_id, count(*) AS n, min(o.person) AS person FROM transactions t JOIN fit f ON f.txn_id = t.txn_id JOIN mine m ON m.txn_id = t.txn_id JOIN persons o ON o.company = t.company JOIN live l ON l.company = o.company AND l.person = o.person
  WHERE l.active > 0 AND o.source_id IS NOT NULL AND m.source_id IS NOT NULL AND o.source_id <> m.source_id AND len(list_filter(f.signers, lambda x: x IS NOT NULL AND x = o.source_id)) > 0 GROUP BY t.txn_id
), steps AS (
  SELECT t.txn_id, f.mode, s.person, CASE
    WHEN a.status IS NULL THEN 'no_authority' WHEN a.status <> 'ACTIVE' THEN 'authority_not_active' WHEN a.valid_until IS NOT NULL AND t.day IS NOT NULL AND a.valid_until < t.day THEN 'authority_expired'
    WHEN m.n <> 1 THEN 'initiator_unknown' WHEN c.status IS NULL OR c.status <> 'ACTIVE' THEN 'company_not_active' WHEN l.n IS NULL OR l.n <> 1 OR l.active <> 1 THEN 'initiator_not_active'
    WHEN EXISTS (SELECT 1 FROM rules r WHERE r.company = t.company AND r.scope = lower(t.subject) AND r.blocked IS TRUE) THEN 'scope_blocked' WHEN f.txn_id IS NULL THEN 'no_rule'
    WHEN f.mode = 'SOLE' AND (m.mode IS NULL OR m.mode <> 'SOLE' OR m.most IS NOT NULL AND (t.amount IS NULL OR t.amount > m.most)) THEN 'over_limit'
    WHEN f.mode = 'JOINT' AND (m.source_id IS NULL OR len(list_filter(f.signers, lambda x: x IS NOT NULL AND x = m.source_id)) = 0) THEN 'not_a_signer'
    WHEN f.mode = 'JOINT' AND (s.n IS NULL OR s.n <> 1) THEN 'no_cosigner' WHEN f.mode IS NULL THEN 'unknown_mode' WHEN t.amount IS NULL OR a.valid_until IS NOT NULL AND t.day IS NULL THEN 'not_proved' END AS failed_step
  FROM transactions t LEFT JOIN mine m ON m.txn_id = t.txn_id LEFT JOIN authorities a ON a.company = t.company LEFT JOIN companies c ON c.company = t.company
  LEFT JOIN live l ON l.company = t.company AND l.person = t.initiator LEFT JOIN fit f ON f.txn_id = t.txn_id LEFT JOIN seconds s ON s.txn_id = t.txn_id
) SELECT txn_id, CASE WHEN failed_step IS NOT NULL THEN 'DENIED' WHEN mode = 'SOLE' THEN 'ALLOWED' ELSE 'PENDING_COSIGN' END AS verdict, failed_step, CASE WHEN failed_step IS NULL AND mode = 'JOINT' THEN person END AS cosigner FROM steps"""


def _compare() -> str:
    mask = lambda x: f"CASE WHEN regexp_full_match(trim({x}), '[0-9]{{3}}\\*+[0-9]{{2}}') THEN left(trim({x}), 3) || right(trim({x}), 2) END"
    digits = lambda x: f"regexp_replace({x}, '[^0-9]', '', 'g')"
    green = lambda ok: f"CASE WHEN coalesce({ok}, false) THEN 'green' ELSE 'red' END"
    found = f"coalesce({_normal('app_name')} = {_normal('rep_name')}, false)"
    tests = {
        "company_name_match": green(f"{_core('app_company')} = {_core('doc_company')}"),
        "tax_number_match": green(f"{digits('app_tax')} = {digits('doc_tax')}"),
        "mersis_number_match": green(f"{digits('app_mersis')} = {digits('doc_mersis')}"),
        "applicant_in_document": green(found),
        "identity_match": green(f"{found} AND {mask('app_tckn')} = {mask('rep_tckn')}"),
        "authority_mode": f"CASE WHEN {found} AND rep_mode = 'SOLE' THEN 'green' WHEN {found} AND rep_mode = 'JOINT' THEN 'amber' ELSE 'red' END",
        "registry_status": green("upper(reg_status) = 'ACTIVE'"),
        "registry_representative_match": green(f"reg_status IS NOT NULL AND {_normal('app_name')} = {_normal('reg_rep_name')} AND reg_rep_status = 'ACTIVE' AND (app_tckn IS NULL OR reg_rep_tckn IS NULL OR {mask('app_tckn')} = {mask('reg_rep_tckn')})"),
        "document_validity": green("doc_valid_until >= as_of"),
    }
    registry = ["registry_status", "registry_representative_match"]
    plain = ", ".join(c for c in tests if c not in registry)
    verdict = f"CASE WHEN 'red' IN ({plain}) THEN 'MISMATCH' WHEN 'red' IN ({', '.join(registry)}) THEN 'REGISTRY_CONFLICT' WHEN 'amber' IN ({plain}) THEN 'CO_SIGNER_REQUIRED' ELSE 'READY' END"
    return f"{_with('cases')}, checked AS (SELECT case_id, {', '.join(f'{s} AS {k}' for k, s in tests.items())} FROM cases) SELECT *, {verdict} AS verdict FROM checked"


def _identifiers() -> str:
    d = lambda x, i: f"CAST(substr({x}, {i}, 1) AS INTEGER)"
    odd, even = " + ".join(d("tckn", i) for i in (1, 3, 5, 7, 9)), " + ".join(d("tckn", i) for i in (2, 4, 6, 8))
    tckn = f"(((7 * ({odd}) - ({even})) % 10) + 10) % 10 = {d('tckn', 10)} AND ({odd} + {even} + {d('tckn', 10)}) % 10 = {d('tckn', 11)}"
    parts = [f"(CASE WHEN ({d('vkn', i)} + {10 - i}) % 10 = 9 THEN 9 ELSE (({d('vkn', i)} + {10 - i}) % 10) * {1 << (10 - i)} % 9 END)" for i in range(1, 10)]
    vkn = f"(10 - ({' + '.join(parts)}) % 10) % 10 = {d('vkn', 10)}"
    mask = "CASE WHEN regexp_full_match(trim(mask), '[0-9]{3}\\*+[0-9]{2}') THEN left(trim(mask), 3) || '******' || right(trim(mask), 2) END"
    return f"{_with('ids')} SELECT id, {tckn} AS tckn_ok, {vkn} AS vkn_ok, {mask} AS masked FROM ids"


def oracle_sql() -> dict[str, str]:
    return R.oracle_sql(_normal) | extraction_queries.oracle_sql() | decision_queries.oracle_sql() | store_queries.oracle_sql(_STEPS) | display_queries.oracle_sql() | {
        "authorize_batch": f"{_STEPS} SELECT * FROM decided",
        "authorize_gaps": _gap_steps(),
        "compare_checks": _compare(),
        "normalize_text": f"SELECT doc_id, sha256({_normal('text')}) AS normal_sha256 FROM documents",
        "redact_text": "SELECT doc_id, CASE WHEN length(t) > 500 THEN left(t, 500) || '…[truncated]' ELSE t END AS kept FROM (SELECT doc_id, regexp_replace('id 12345678901; ' || CAST(doc_id AS STRING) || coalesce(' ' || text, ''), '(^|[^0-9])[0-9]{11}($|[^0-9])', '\\1[REDACTED_TCKN]\\2', 'g') AS t FROM documents)",
        "identifier_checks": _identifiers(),
        "parse_dates": f"{_with('dates')} SELECT id, CAST(coalesce(try_strptime(raw, '%Y-%m-%d'), try_strptime(trim(raw), '%d.%m.%Y'), try_strptime(trim(raw), '%d/%m/%Y'), try_strptime(raw, '%d-%m-%Y'), try_strptime(replace(raw, ' AĞUSTOS ', '-8-'), '%d-%m-%Y')) AS DATE) AS parsed FROM (SELECT id, CASE WHEN raw = '14.03.26' THEN NULL ELSE raw END AS raw FROM dates)",
        "format_amounts": f"{_with('transactions')} SELECT txn_id, replace(format('{{:,}}', amount // 100), ',', '.') || ',' || lpad(CAST(amount % 100 AS STRING), 2, '0') || ' TL' AS label FROM transactions",
        "page_windows": f"{_with('doc_pages')}, lists AS (SELECT doc, list_sort(list_distinct(list(page))) AS p FROM doc_pages GROUP BY doc), starts AS (SELECT doc, p, unnest(CASE WHEN len(p) <= 4 THEN [0] ELSE range(0, len(p) - 1, 3) END) AS start FROM lists) SELECT doc, start, array_to_string(p[start + 1:start + 4], ',') AS pages FROM starts",
        "page_runs": f"{_with('doc_pages')}, d AS (SELECT DISTINCT doc, page FROM doc_pages), marked AS (SELECT *, page - lag(page) OVER (PARTITION BY doc ORDER BY page) AS gap FROM d), numbered AS (SELECT *, sum(CASE WHEN gap = 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY page) AS run FROM marked) SELECT doc, min(page) AS first_page, max(page) AS last_page, count(*) AS n FROM numbered GROUP BY doc, run",
        "latest_version": f"{_with('transactions')} SELECT company, txn_id, amount FROM transactions t WHERE NOT EXISTS (SELECT 1 FROM transactions u WHERE u.company = t.company AND (u.day > t.day OR u.day = t.day AND u.txn_id > t.txn_id))",
        "next_version": f"{_with('transactions', 'authorities')} SELECT a.company, coalesce((SELECT max(txn_id) FROM transactions t WHERE t.company = a.company), 0) + 1 AS next FROM authorities a",
        "audit_newest": "SELECT event_id, user_id, event_type FROM events WHERE event_type = 'click' OR value > 50 ORDER BY event_id DESC LIMIT 200",
        "dashboard_counts": f"{_STEPS} SELECT count(*) FILTER (verdict = 'PENDING_COSIGN') AS open_count, count(*) FILTER (verdict = 'ALLOWED') AS allowed, count(*) FILTER (failed_step = 'authority_not_active') AS alerts FROM decided",
        "denied_by_step": f"{_STEPS} SELECT failed_step, count(*) AS n FROM decided WHERE verdict = 'DENIED' GROUP BY failed_step",
        "orphans": f"{_with('transactions', 'authorities')} SELECT txn_id, company FROM transactions WHERE company NOT IN (SELECT company FROM authorities)",
    }
