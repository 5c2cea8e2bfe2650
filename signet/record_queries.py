"""Queries over rosters, histories, fuzzy matches and streams, and their SQL; inputs are SELECTs that both engines run."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import inputs
from .functions import text as T
from .operators import history, matching, roster
from .sources.results import cache_key
from .storage import shared_dir
from .streaming import requests

INPUTS = {
    "appointments": """SELECT c_nationkey AS doc, c_custkey AS ordinal, CASE WHEN c_custkey % 10 = 0 THEN 'UNREADABLE' WHEN c_custkey % 97 = 0 THEN NULL ELSE 'Kişi ' || CAST(c_custkey % 200 AS STRING) END AS name,
        CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS title FROM customer""",
    "specimens": """SELECT s_nationkey AS doc, s_suppkey AS ordinal, CASE WHEN s_suppkey % 10 = 0 THEN 'Unreadable' ELSE 'KİŞİ  ' || CAST(s_suppkey % 200 AS STRING) END AS name, 'specimen' AS title FROM supplier""",
    "groups": """SELECT n_nationkey AS doc, o AS ordinal, g AS name FROM nation CROSS JOIN (VALUES (0, 'B Grubu Yetkilisi'), (1, 'b GRUP'), (2, 'II. Derecesi'), (3, 'ikinci derece imza'), (4, 'V. Yetkili')) v(o, g) WHERE o < 4 OR n_nationkey % 2 = 0""",
    "parties": """SELECT c_nationkey AS doc, c_custkey // 3 AS rule, c_custkey AS party, CASE WHEN c_custkey % 4 = 0 THEN 'GROUP' ELSE 'PERSON' END AS kind,
        CASE c_custkey % 3 WHEN 0 THEN '2 DERECE yetkilileri' WHEN 1 THEN 'B grubu' ELSE 'Z Grubu' END AS ref,
        CASE c_custkey % 5 WHEN 0 THEN 'Beşinci derece' WHEN 1 THEN 'kisi ' || CAST(c_custkey % 400 AS STRING) ELSE 'KİŞİ ' || CAST(c_custkey % 200 AS STRING) END AS name FROM customer""",
    "hints": "SELECT n_nationkey AS doc, 'Kurul, KİŞİ ' || CAST(n_nationkey * 3 + 210 AS STRING) || ' ve  kişi 3' || CAST(n_nationkey % 10 AS STRING) || '.' AS hint FROM nation WHERE n_nationkey % 3 > 0",
    "members": "SELECT c_nationkey AS company, c_custkey AS person, '123***' || CAST(10 + c_custkey % 90 AS STRING) AS tckn, 'Ad ' || CAST(c_custkey % 300 AS STRING) AS name FROM customer",
    "reps": "SELECT s_nationkey AS company, s_suppkey AS rep, '123*****' || CAST(10 + s_suppkey % 90 AS STRING) AS tckn, 'AD  ' || CAST(s_suppkey % 300 AS STRING) AS name, CASE WHEN s_suppkey % 7 = 0 THEN 'REMOVED' ELSE 'ACTIVE' END AS status FROM supplier",
    "states": """SELECT event_id, user_id AS application, CASE event_id % 7 WHEN 0 THEN 'DRAFT' WHEN 1 THEN 'IDENTITY_VERIFIED' WHEN 2 THEN 'DOCUMENT_SCANNED' WHEN 3 THEN 'ANALYZING' WHEN 4 THEN 'ANALYZED' WHEN 5 THEN 'ANALYSIS_FAILED' ELSE 'APPROVED' END AS state FROM events""",
    "corrections": """SELECT user_id AS doc, event_id AS seq, event_type AS path, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(event_id % 2 AS STRING) END AS old_value, CAST(event_id // 2 % 2 AS STRING) AS new_value FROM events""",
    "held": "SELECT DISTINCT user_id AS doc, event_type AS path, '0' AS value FROM events WHERE user_id % 2 = 0",
}


def _input(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return inputs.rows(spark, sf_dir, INPUTS[name])


def roster_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roster.merge_roster(_input(spark, sf_dir, "appointments"), _input(spark, sf_dir, "specimens"))


def _resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roster.resolve_parties(*(_input(spark, sf_dir, n) for n in ("parties", "appointments", "groups", "hints")))


def party_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).select("doc", "party", "found", "target")


def joint_signers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roster.joint_signers(_resolved(spark, sf_dir)).select("doc", "rule", F.array_join("signers", "; ").alias("signers"))


def unresolved_parties(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _resolved(spark, sf_dir).filter("found = 'UNRESOLVED'").groupBy("doc").agg(F.count("*").alias("n"))


def or_join_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roster.unique_active(_input(spark, sf_dir, "members"), _input(spark, sf_dir, "reps")).select("company", "person", "rep")


def group_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _input(spark, sf_dir, "parties").select("party", T.group_code(F.col("ref")).alias("ref_code"), T.group_code(F.col("name")).alias("name_code"))


def state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.steps(_input(spark, sf_dir, "states"), "application", ["event_id"], "state", history.APPLICATION).select("event_id", "previous", "version", "legal")


def fold_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.fold(_input(spark, sf_dir, "corrections"), "doc")


def stale_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.checked_corrections(_input(spark, sf_dir, "held"), _input(spark, sf_dir, "corrections"), "doc")


def superseded_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", "o_orderdate")
    return history.supersede(orders, "o_custkey", "o_orderkey", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "version", "superseded_by", "state")


def result_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of stored results by document content, and how many documents share each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.groupBy(cache_key("text", " 1.0", "Live AI / v2 ").alias("key")).agg(F.count("*").alias("n"))


def fuzzy_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The supplier of the same nation whose name is nearest to each customer's, at a ratio of 70 or more."""
    left = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("left_id"), T.tr_normalize(F.col("c_name")).alias("left_text"))
    right = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("right_id"), T.tr_normalize(F.col("s_name")).alias("right_text"))
    return matching.best(left, right, ["nation"], 70.0, matching.numbered)


def stream_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and kind from a stream, windows that are final only."""
    place = shared_dir(spark)
    events = requests.read_table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("kind"))
    found = requests.drain(requests.rates(events, "1 day", "2 days"), f"{place}/stream-{uuid.uuid4().hex}")
    return found.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "kind", "n")


ALL = (roster_merge, party_resolution, joint_signers, unresolved_parties, or_join_unique, group_codes, state_machine, fold_corrections, stale_corrections, superseded_versions, result_keys, fuzzy_best_match, stream_rates)


def oracle_sql(normal) -> dict[str, str]:
    """``normal`` writes the SQL of a normalised text."""

    def given(*names: str) -> str:
        return inputs.given(INPUTS, *names)

    code = inputs.group_code

    mask = lambda x: f"CASE WHEN regexp_full_match(trim({x}), '[0-9]{{3}}\\*+[0-9]{{2}}') THEN left(trim({x}), 3) || right(trim({x}), 2) END"
    resolved = f"""{given("parties", "appointments", "groups", "hints")}, named AS (SELECT doc, {normal("name")} AS plain, arg_min(name, ordinal) AS person FROM appointments WHERE {normal("name")} <> '' GROUP BY ALL),
        coded AS (SELECT doc, {code("name")} AS code, arg_min(name, ordinal) AS spelling FROM groups GROUP BY ALL),
        resolved AS (SELECT p.doc, p.rule, p.party, CASE WHEN kind = 'GROUP' THEN 'GROUP' WHEN person IS NOT NULL THEN 'PERSON' WHEN spelling IS NOT NULL OR hinted THEN 'GROUP' ELSE 'UNRESOLVED' END AS found,
          CASE WHEN kind = 'GROUP' THEN coalesce(spelling, ref) ELSE coalesce(person, spelling, CASE WHEN hinted THEN p.name END) END AS target
          FROM (SELECT *, EXISTS (SELECT 1 FROM hints h WHERE h.doc = q.doc AND contains({normal("h.hint")}, {normal("q.name")})) AS hinted FROM parties q) p LEFT JOIN named n ON n.doc = p.doc AND p.kind <> 'GROUP' AND n.plain = {normal("p.name")}
          LEFT JOIN coded c ON c.doc = p.doc AND c.code = CASE WHEN kind = 'GROUP' THEN {code("ref")} ELSE {code("p.name")} END)"""  # fmt: skip
    follow = "DRAFT IDENTITY_VERIFIED, IDENTITY_VERIFIED DOCUMENT_SCANNED, DOCUMENT_SCANNED ANALYZING, ANALYZING ANALYZED, ANALYZING ANALYSIS_FAILED, ANALYSIS_FAILED ANALYZING, ANALYZED APPROVED, ANALYZED DOC_REQUESTED, ANALYZED ESCALATED, ANALYZED ANALYZING"
    legal = ", ".join("('{}', '{}')".format(*pair.split()) for pair in follow.split(", "))
    return {
        "roster_merge": f"""{given("appointments", "specimens")}, rows AS (SELECT *, 0 AS rank FROM appointments UNION ALL SELECT *, 1 FROM specimens), keyed AS (SELECT *, coalesce({normal("name")}, '') AS plain FROM rows)
            SELECT doc, arg_min(name, rank * 1000000000000 + ordinal) FILTER (name IS NOT NULL) AS name, arg_min(title, rank * 1000000000000 + ordinal) FILTER (title IS NOT NULL) AS title, bool_or(rank = 0) AS appointed, bool_or(rank = 1) AS signed
            FROM keyed GROUP BY doc, plain, CASE WHEN plain IN ('', 'unreadable') THEN rank * 1000000000000 + ordinal END""",
        "party_resolution": f"{resolved} SELECT doc, party, found, target FROM resolved",
        "joint_signers": f"{resolved}, one AS (SELECT doc, rule, target, min(party) AS party, bool_and(found <> 'UNRESOLVED') AS known FROM resolved GROUP BY doc, rule, target) SELECT doc, rule, CASE WHEN bool_and(known) THEN string_agg(target, '; ' ORDER BY party) END AS signers FROM one GROUP BY doc, rule",
        "unresolved_parties": f"{resolved} SELECT doc, count(*) AS n FROM resolved WHERE found = 'UNRESOLVED' GROUP BY doc",
        "or_join_unique": f"""{given("members", "reps")}, hits AS (SELECT m.company, m.person, count(*) AS n, min(r.rep) AS rep, min(r.status) AS status FROM members m JOIN reps r ON r.company = m.company AND ({mask("m.tckn")} = {mask("r.tckn")} OR {normal("m.name")} = {normal("r.name")}) GROUP BY ALL)
            SELECT m.company, m.person, h.rep FROM members m LEFT JOIN hits h ON h.company = m.company AND h.person = m.person AND h.n = 1 AND h.status = 'ACTIVE'""",
        "group_codes": f"{given('parties')} SELECT party, {code('ref')} AS ref_code, {code('name')} AS name_code FROM parties",
        "state_machine": f"{given('states')}, seen AS (SELECT *, lag(state) OVER w AS previous, row_number() OVER w AS version FROM states WINDOW w AS (PARTITION BY application ORDER BY event_id)) SELECT event_id, previous, version, previous IS NULL OR (previous, state) IN ({legal}) AS legal FROM seen",
        "fold_corrections": f"{given('corrections')} SELECT doc, path, new_value AS value FROM corrections c WHERE NOT EXISTS (SELECT 1 FROM corrections d WHERE d.doc = c.doc AND d.path = c.path AND d.seq > c.seq)",
        "stale_corrections": f"{given('corrections', 'held')}, history AS (SELECT doc, path, -1 AS seq, NULL AS old_value, value AS new_value FROM held UNION ALL SELECT doc, path, seq, old_value, new_value FROM corrections), seen AS (SELECT *, lag(new_value) OVER (PARTITION BY doc, path ORDER BY seq) AS before FROM history) SELECT doc, seq, path, old_value IS DISTINCT FROM before AS stale FROM seen WHERE seq >= 0",
        "superseded_versions": "SELECT o_orderkey, row_number() OVER w AS version, lead(o_orderkey) OVER w AS superseded_by, CASE WHEN lead(o_orderkey) OVER w IS NULL THEN 'ACTIVE' ELSE 'SUSPENDED' END AS state FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
        "result_keys": "SELECT sha256(text) || '__1-0__live-ai-v2' AS key, count(*) AS n FROM documents GROUP BY ALL",
        "fuzzy_best_match": f"""WITH RECURSIVE pairs AS (SELECT c_nationkey AS nation, c_custkey AS left_id, s_suppkey AS right_id, {normal("c_name")} AS a, {normal("s_name")} AS b FROM customer JOIN supplier ON s_nationkey = c_nationkey), {inputs.ratios("pairs", 70.0)}
            SELECT nation, left_id, right_id, score FROM scored QUALIFY row_number() OVER (PARTITION BY left_id ORDER BY score DESC, right_id) = 1""",
        "stream_rates": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type AS kind, count(*) AS n FROM events GROUP BY date_trunc('day', ts), event_type HAVING date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 2 DAY FROM events)",
    }
