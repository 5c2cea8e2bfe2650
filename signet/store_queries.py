"""Queries over stores, versions, patches, nested values and streams with state; and their SQL."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import inputs
from .functions import text as T
from .functions.nested import redact_columns
from .operators import authority, merging, patches, views
from .sources import results, snapshots, store
from .storage import shared_dir
from .streaming import requests, stateful

DEADLINE, LATE, WITHIN, SIDE_LATE = datetime.timedelta(hours=30), datetime.timedelta(days=2), "30 DAYS", "10 days 7 hours"
INPUTS = {
    "companies": "SELECT c_custkey AS company, CASE WHEN c_custkey % 17 = 0 THEN 'PASSIVE' ELSE 'ACTIVE' END AS status FROM customer",
    "payloads": """SELECT o_orderkey AS document, struct(struct('Firma ' || CAST(o_custkey AS STRING) AS name, 'firma ' || CAST(o_custkey AS STRING) AS normalized, CAST(o_custkey AS STRING) AS tax) AS company, CAST(o_orderdate AS DATE) AS valid_until,
        array(struct('rep-1' AS id, 'Ada' AS name, 'ada' AS normalized, 'SOLE' AS mode), struct('rep-2' AS id, 'Ece' AS name, 'ece' AS normalized, 'JOINT' AS mode)) AS reps) AS payload FROM orders""",
    "corrections": """SELECT l_orderkey AS document, CAST(floor(l_extendedprice * 100) AS BIGINT) AS seq, CASE l_suppkey % 6 WHEN 0 THEN 'company.name' WHEN 1 THEN 'valid_until' WHEN 2 THEN 'reps[rep-1].mode' WHEN 3 THEN 'reps[rep-2].name' WHEN 4 THEN 'reps[rep-9].mode' ELSE 'company.city' END AS path,
        CASE WHEN l_suppkey % 6 = 1 THEN CASE l_partkey % 3 WHEN 0 THEN '2031-05-06' WHEN 1 THEN 'soon' END WHEN l_partkey % 7 = 0 THEN NULL ELSE 'Işık ' || CAST(l_linenumber AS STRING) END AS value FROM lineitem""",
    "readings": """SELECT o_custkey AS doc, o_orderkey AS ordinal, CASE WHEN o_orderkey % 4 > 0 THEN 'Firma ' || CAST(o_orderkey AS STRING) END AS legal_name, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_custkey AS STRING) END AS vkn,
        CASE WHEN o_orderkey % 5 = 0 THEN 'Noter ' || CAST(o_orderkey % 7 AS STRING) END AS notary, CASE WHEN o_orderkey % 2 = 0 THEN '14.03.2026' ELSE 'okunmuyor' END AS notary_date, o_orderkey % 3 AS page, 'q' || CAST(o_orderkey % 2 AS STRING) AS quote FROM orders""",
    "page_maps": "SELECT c_custkey AS doc, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS company_line FROM customer",
}


def _input(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return inputs.rows(spark, sf_dir, INPUTS[name])


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of documents by content: stored in batches, one of them twice, some dropped in between, and found again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.select("doc_id", results.cache_key("text", "1.0", "reader").alias("key"), F.sha2("text", 256).alias("source"), F.to_json(F.struct(F.length("text").alias("chars"))).alias("payload"))
    path = _place(spark, "results")
    for batch, rest in (("first", 0), ("first", 0), ("second", 1)):
        if batch == "second":
            store.drop(path, "0")
        store.put(docs.filter(F.col("doc_id") % 3 == rest).dropDuplicates(["key"]), path, batch)
    found = store.found(docs.select("doc_id", "key"), path)
    return found.select("doc_id", F.col("payload").isNotNull().alias("hit"), F.get_json_object("payload", "$.chars").cast("long").alias("chars"))


def registry_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A registry through three changes and back: each company's status as of every version."""
    root, now = _place(spark, "registry"), _input(spark, sf_dir, "companies")
    snapshots.publish(spark, root, {"companies": now}, after=0)
    for version, (every, status) in enumerate(((5, "CLOSED"), (7, "PASSIVE")), 1):
        old = snapshots.read(spark, root, "companies")
        snapshots.publish(spark, root, {"companies": old.withColumn("status", F.when(F.col("company") % every == 0, status).otherwise(F.col("status")))}, after=version)
    snapshots.reset(spark, root, 2)
    shown = {f"v{v}": snapshots.read(spark, root, "companies", v) for v in (1, 2, 3)} | {"now": snapshots.read(spark, root, "companies")}
    stack = [df.select("company", F.lit(name).alias("version"), "status") for name, df in shown.items()]
    rows = stack[0].union(stack[1]).union(stack[2]).union(stack[3])
    return rows.groupBy("company").pivot("version", list(shown)).agg(F.first("status"))


def effective_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads with the corrections that fit them; those that don't are listed."""
    editable = ["company.name", "company.tax", "valid_until", "reps[].name", "reps[].mode"]
    derived = {"company.normalized": ("name", T.tr_normalize), "reps[].normalized": ("name", T.tr_normalize)}
    found = patches.effective(_input(spark, sf_dir, "payloads"), _input(spark, sf_dir, "corrections"), "document", editable, derived, strict=False)
    p = F.col("payload")
    rep = lambda i: F.concat_ws("|", *(F.coalesce(p.reps[i][c], F.lit("-")) for c in ("id", "name", "normalized", "mode")))
    return found.select("document", p.company["name"].alias("name"), p.company.normalized.alias("normalized"), p.company.tax.alias("tax"), p.valid_until.cast("string").alias("valid_until"), rep(0).alias("rep_1"), rep(1).alias("rep_2"), F.array_join("refused", ";").alias("refused"))


def redacted_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested audit details of documents with their texts redacted and bytes counted."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" 12345678901")).alias("text"), "source")
    inner = F.struct("text", F.array(F.struct(F.concat(F.lit("no 98765432109;"), "source").alias("note"))).alias("notes"), F.create_map(F.lit("raw"), F.left("text", F.lit(600))).alias("more"), F.encode("source", "utf-8").alias("bytes"), F.col("doc_id").alias("n"))
    found = redact_columns(docs.select("doc_id", inner.alias("detail")), "detail")
    return found.select("doc_id", F.sha2(F.concat_ws("|", "detail.text", F.col("detail.more")["raw"]), 256).alias("texts_sha256"), F.col("detail.notes")[0].note.alias("note"), F.col("detail.bytes").alias("bytes"), F.col("detail.n").alias("n"))


def failed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a stream of events that ended by a purchase, or by their deadline."""
    events = requests.read_table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"), (F.col("event_type") == "purchase").alias("ends"))
    found = requests.drain(stateful.runs(events, DEADLINE, "2 days"), _place(spark, "runs"))
    return found.select("key", F.unix_millis("started").alias("started_ms"), F.unix_millis("ended").alias("ended_ms"), "outcome")


def audited_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions on a stream of transactions, each stored with its audit row."""
    from .queries import GIVEN, INPUTS as BASE

    fixed = [inputs.rows(spark, sf_dir, BASE[n]) for n in GIVEN[1:]]
    stream = inputs.over(spark, BASE["transactions"], {"orders": requests.read_table(spark, sf_dir, "orders")})
    root = _place(spark, "decided")
    stateful.stored_once(stream, root, f"{root}-state", lambda batch: stateful.with_audit(authority.evaluate(batch, *fixed), "txn_id", "TRANSACTION_AUTHORIZED"))
    audit = stateful.appended(spark, root, "audit")
    return stateful.appended(spark, root, "decisions").join(audit.withColumn("txn_id", F.col("entity").cast("long")), "txn_id").select("txn_id", "verdict", "action", "detail")


def pending_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of one stream with the signatures of another that came in time, or without once none can come."""
    asked = requests.read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("timestamp").alias("asked_at"))
    signed = requests.read_table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").cast("timestamp").alias("answered_at"), F.col("l_suppkey").alias("by"))
    found = requests.drain(stateful.answered(asked, signed, WITHIN, SIDE_LATE), _place(spark, "signatures"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return found.select("id", day("asked_at"), day("answered_at"), "by")


def case_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as applications with their newest document, its rules within it, and how many documents there are."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    rules = table("lineitem").select(F.col("l_orderkey").alias("document"), F.col("l_linenumber").alias("ordinal"), F.col("l_partkey").alias("part"))
    orders = table("orders").select(F.col("o_orderkey").alias("document"), F.col("o_custkey").alias("application"), F.col("o_orderdate").cast("timestamp").alias("seen"), F.col("o_orderstatus").alias("state"))
    documents = views.assembled(orders, "document", {"rules": views.Part(rules.withColumn("place", F.struct("ordinal", "part")), "place", many=True)})
    customers = table("customer").select(F.col("c_custkey").alias("application"), F.col("c_name").alias("company"))
    found = views.assembled(customers, "application", {"document": views.Part(documents, "document")})
    d = F.col("document")
    return found.select("application", "company", d.document.alias("document"), T.instant(d.seen).alias("seen"), d.state.alias("state"), F.array_join(F.transform(d.rules, lambda r: F.concat_ws(":", r.ordinal, r.part)), ",").alias("rules"), F.col("document_count").alias("documents"))


def merged_companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Company and notary of each document from all of its readings."""
    r = _input(spark, sf_dir, "readings")
    evidence = F.array(F.struct("page", "quote"), F.struct((F.col("page") + 1).alias("page"), "quote"))
    given = r.select("doc", "ordinal", F.struct("legal_name", "vkn").alias("company"), evidence.alias("company_evidence"), F.when(F.col("notary").isNotNull(), F.struct(F.col("notary").alias("name"), F.col("notary_date").alias("date"))).alias("notary"), evidence.alias("notary_evidence"))
    found = merging.companies(given, _input(spark, sf_dir, "page_maps"))
    shown = lambda c: F.array_join(F.transform(c, lambda e: F.concat_ws(":", e.page, e.quote)), ",").alias(c)
    return found.select("doc", "company.legal_name", "company.vkn", F.col("notary.name").alias("notary"), F.col("notary.date").cast("string").alias("notary_date"), shown("company_evidence"), shown("notary_evidence"))


def stage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many jobs failed or were cached, counted while they are stored."""
    jobs = inputs.rows(spark, sf_dir, "SELECT l_orderkey AS job, CASE WHEN l_partkey % 11 = 0 THEN 'failed' ELSE 'success' END AS status, l_suppkey % 3 = 0 AS cached FROM lineitem")
    seen = Observation("stage")
    results.stage_counts(jobs, seen).write.parquet(_place(spark, "jobs"))
    return spark.createDataFrame([tuple(seen.get[c] for c in ("total", "failed", "cached"))], "total long, failed long, cached long")


ALL = (stored_results, registry_versions, effective_payloads, redacted_details, failed_runs, audited_decisions, pending_signatures, case_views, merged_companies, stage_counts)


def oracle_sql(steps: str) -> dict[str, str]:
    """``steps`` is the SQL of decisions (txn_id, verdict, failed_step, cosigner) as ``decided``."""
    given = lambda *names: inputs.given(INPUTS, *names)
    norm, limit, late = inputs.normal, DEADLINE // datetime.timedelta(milliseconds=1), LATE // datetime.timedelta(milliseconds=1)
    red = lambda x: f"(SELECT CASE WHEN length(y) > 500 THEN left(y, 500) || '…[truncated]' ELSE y END FROM (SELECT regexp_replace({x}, '(^|[^0-9])[0-9]{{11}}($|[^0-9])', '\\1[REDACTED_TCKN]\\2', 'g') AS y))"
    field = lambda path, value, old: f"CASE WHEN any_value(path) FILTER (path = '{path}') IS NOT NULL THEN any_value({value}) FILTER (path = '{path}') ELSE {old} END"
    seen = lambda order: f"(SELECT string_agg(CAST(p AS VARCHAR) || ':' || q, ',' ORDER BY place) FROM (SELECT p, q, min({order}) AS place FROM e WHERE e.doc = m.doc {{}} GROUP BY p, q))"
    return {
        "stored_results": """WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(coalesce(text, '')) AS h FROM documents), kept AS (SELECT DISTINCT t FROM d WHERE doc_id % 3 = 1 OR doc_id % 3 = 0 AND left(h, 1) <> '0')
            SELECT doc_id, k.t IS NOT NULL AS hit, CAST(CASE WHEN k.t IS NOT NULL THEN length(d.t) END AS BIGINT) AS chars FROM d LEFT JOIN kept k ON k.t = d.t""",
        "registry_versions": f"""{given("companies")}, two AS (SELECT company, status AS v1, CASE WHEN company % 5 = 0 THEN 'CLOSED' ELSE status END AS v2 FROM companies)
            SELECT company, v1, v2, CASE WHEN company % 7 = 0 THEN 'PASSIVE' ELSE v2 END AS v3, v2 AS now FROM two""",
        "effective_payloads": f"""{inputs.given({"corrections": INPUTS["corrections"]}, "corrections")}, ranked AS (SELECT document, path, max(seq) AS seq FROM corrections GROUP BY ALL), last AS (SELECT DISTINCT c.document, c.path, c.value FROM corrections c JOIN ranked r ON r.document = c.document AND r.path = c.path AND r.seq = c.seq),
            good AS (SELECT * FROM last WHERE path IN ('company.name', 'reps[rep-1].mode', 'reps[rep-2].name') OR path = 'valid_until' AND (value IS NULL OR try_cast(value AS DATE) IS NOT NULL)),
            made AS (SELECT o_orderkey AS document, {field("company.name", "value", "'Firma ' || CAST(any_value(o_custkey) AS VARCHAR)")} AS name, {field("company.name", norm("value"), "'firma ' || CAST(any_value(o_custkey) AS VARCHAR)")} AS normalized, CAST(any_value(o_custkey) AS VARCHAR) AS tax,
              {field("valid_until", "value", "CAST(CAST(any_value(o_orderdate) AS DATE) AS VARCHAR)")} AS valid_until, {field("reps[rep-1].mode", "coalesce(value, '-')", "'SOLE'")} AS mode, {field("reps[rep-2].name", "coalesce(value, '-')", "'Ece'")} AS rep, {field("reps[rep-2].name", f"coalesce({norm('value')}, '-')", "'ece'")} AS rep_normal
              FROM orders LEFT JOIN good g ON g.document = o_orderkey GROUP BY o_orderkey)
            SELECT m.document, name, normalized, tax, valid_until, 'rep-1|Ada|ada|' || mode AS rep_1, 'rep-2|' || rep || '|' || rep_normal || '|JOINT' AS rep_2, coalesce((SELECT string_agg(path, ';' ORDER BY path) FROM last l WHERE l.document = m.document AND (l.document, l.path) NOT IN (SELECT document, path FROM good)), '') AS refused FROM made m""",
        "redacted_details": f"""SELECT doc_id, sha256({red("t")} || '|' || {red("left(t, 600)")}) AS texts_sha256, 'no [REDACTED_TCKN];' || source AS note, '<' || CAST(strlen(source) AS VARCHAR) || ' bytes omitted>' AS bytes, doc_id AS n FROM (SELECT doc_id, source, coalesce(text, '') || ' 12345678901' AS t FROM documents)""",
        "failed_runs": f"""WITH RECURSIVE e AS (SELECT user_id AS key, epoch_us(ts) // 1000 AS ms, event_type = 'purchase' AS ends, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000, event_id) AS n FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL),
            r AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS held, CAST(NULL AS BIGINT) AS started, CAST(NULL AS BIGINT) AS ended, CAST(NULL AS VARCHAR) AS outcome FROM e UNION ALL
              SELECT key, n, CASE WHEN NOT ends AND free IS NULL THEN ms WHEN ends THEN NULL ELSE free END, CASE WHEN over THEN held WHEN ends AND free IS NOT NULL THEN free END, CASE WHEN over THEN held + {limit} WHEN ends AND free IS NOT NULL THEN ms END, CASE WHEN over THEN 'ANALYSIS_FAILED' WHEN ends AND free IS NOT NULL THEN 'ANALYZED' END
              FROM (SELECT e.key, e.n, e.ms, e.ends, r.held, coalesce(e.ms > r.held + {limit}, false) AS over, CASE WHEN e.ms > r.held + {limit} THEN NULL ELSE r.held END AS free FROM r JOIN e ON e.key = r.key AND e.n = r.n + 1)),
            ends AS (SELECT key, arg_max(coalesce(held, -1), n) AS held FROM r GROUP BY key)
            SELECT key, started AS started_ms, ended AS ended_ms, outcome FROM r WHERE outcome IS NOT NULL UNION ALL SELECT key, held, held + {limit}, 'ANALYSIS_FAILED' FROM ends WHERE held >= 0 AND held + {limit} < (SELECT max(ms) - {late} FROM e)""",
        "audited_decisions": f"""{steps} SELECT txn_id, verdict, 'TRANSACTION_AUTHORIZED' AS action, '{{"verdict":"' || verdict || '"' || coalesce(',"failed_step":"' || failed_step || '"', '') || coalesce(',"cosigner":"' || cosigner || '"', '') || '}}' AS detail FROM decided""",
        "pending_signatures": """WITH b AS (SELECT l_orderkey, l_shipdate, l_suppkey FROM lineitem WHERE l_linenumber = 1), w AS (SELECT least((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM b)) - INTERVAL 10 DAY - INTERVAL 7 HOUR AS mark)
            SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS asked_at, strftime(l_shipdate, '%Y-%m-%d') AS answered_at, l_suppkey AS by FROM orders LEFT JOIN b ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 30 DAY
            WHERE l_orderkey IS NOT NULL OR o_orderdate + INTERVAL 30 DAY < (SELECT mark FROM w)""",
        "case_views": """WITH d AS (SELECT o_custkey, max(o_orderkey) AS document, count(*) AS documents FROM orders GROUP BY o_custkey), r AS (SELECT l_orderkey, string_agg(CAST(l_linenumber AS VARCHAR) || ':' || CAST(l_partkey AS VARCHAR), ',' ORDER BY l_linenumber, l_partkey) AS rules FROM lineitem GROUP BY l_orderkey)
            SELECT c_custkey AS application, c_name AS company, d.document, strftime(o.o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS seen, o.o_orderstatus AS state, CASE WHEN d.document IS NOT NULL THEN coalesce(r.rules, '') END AS rules, coalesce(d.documents, 0) AS documents
            FROM customer LEFT JOIN d ON d.o_custkey = c_custkey LEFT JOIN orders o ON o.o_orderkey = d.document LEFT JOIN r ON r.l_orderkey = d.document""",
        "merged_companies": f"""{given("readings", "page_maps")}, m AS (SELECT doc, min(ordinal) AS first, min(ordinal) FILTER (notary IS NOT NULL) AS noted FROM readings GROUP BY doc),
            e AS (SELECT doc, ordinal, page + k AS p, quote AS q, ordinal * 2 + k AS place FROM readings, range(2) x(k))
            SELECT coalesce(m.doc, p.doc) AS doc, CASE WHEN m.doc IS NULL THEN coalesce(p.company_line, 'UNREADABLE') ELSE f.legal_name END AS legal_name, f.vkn, n.notary, CASE WHEN n.notary_date LIKE '%.%' THEN '2026-03-14' END AS notary_date,
              coalesce({seen("place").format("")}, '') AS company_evidence, coalesce({seen("place").format("AND e.ordinal = m.noted")}, '') AS notary_evidence
            FROM m FULL JOIN page_maps p ON p.doc = m.doc LEFT JOIN readings f ON f.doc = m.doc AND f.ordinal = m.first LEFT JOIN readings n ON n.doc = m.doc AND n.ordinal = m.noted""",
        "stage_counts": "SELECT count(*) AS total, count(*) FILTER (l_partkey % 11 = 0) AS failed, count(*) FILTER (l_suppkey % 3 = 0) AS cached FROM lineitem",
    }
