"""Queries over what was read from documents: chunk plans, flags, merged rules, projections; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import inputs
from .functions import text as T
from .operators import merging, pages, projection, validation

INPUTS = {
    "pages": """SELECT l_orderkey AS doc, l_linenumber AS page, split(CASE min(l_partkey) % 11 WHEN 0 THEN 'rules' WHEN 1 THEN 'rules,notary_block' WHEN 2 THEN 'appointments' WHEN 3 THEN 'specimens' WHEN 4 THEN 'gazette_annex'
        WHEN 5 THEN 'board_resolution_annex' WHEN 6 THEN 'other_unknown' WHEN 7 THEN 'identity_header,appointments' WHEN 8 THEN 'cover_or_blank' WHEN 9 THEN 'rules' ELSE 'dayanak' END, ',') AS labels, min(l_quantity) > 15 AS continues FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "rendered": "SELECT l_orderkey AS doc, l_linenumber + CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE 0 END AS page FROM lineitem GROUP BY l_orderkey, l_linenumber",
    "docs": "SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 5 > 0 THEN 'Şirket ' || CAST(o_custkey AS STRING) END AS company, split(CASE WHEN o_orderkey % 3 = 0 THEN ' A grubu; var.~B.' ELSE '' END, '~') AS hints FROM orders",
    "companies": """SELECT o_orderkey AS doc, 0 AS item, CASE o_orderkey % 4 WHEN 0 THEN '' WHEN 1 THEN CAST(1000000000 + o_custkey AS STRING) WHEN 2 THEN '12' ELSE NULL END AS vkn, 1 AS page,
        CASE WHEN o_orderkey % 6 > 0 THEN 'Unvan ' || CAST(o_custkey AS STRING) END AS quote FROM orders""",
    "appointments": """SELECT o_orderkey AS doc, 0 AS chunk, CAST(o_custkey % 5 AS INT) AS item, CASE o_orderkey % 6 WHEN 0 THEN '123**45' WHEN 1 THEN '123******45' WHEN 2 THEN 'Unreadable' WHEN 3 THEN 'P-77'
        WHEN 4 THEN CAST(10000000000 + o_custkey * 7919 AS STRING) ELSE NULL END AS id_no, CAST(1 + o_custkey % 3 AS INT) AS page FROM orders""",
    "signatories": """SELECT l_orderkey AS doc, l_linenumber - 1 AS sig, 'Kişi ' || CAST(min(l_partkey) % 40 AS STRING) || CASE WHEN min(l_partkey) % 2 = 0 THEN ' öz' ELSE '' END AS name, CASE min(l_suppkey) % 4 WHEN 0 THEN 'A Grubu' WHEN 1 THEN '2. derece' END AS group_name,
        CASE min(l_partkey) % 5 WHEN 0 THEN 'Münferit' WHEN 1 THEN 'müşterek imza' WHEN 2 THEN 'Sınırlı Yetkili' END AS form, split(CASE WHEN min(l_partkey) % 3 = 0 THEN 'kişi 7~Yok Kimse' WHEN min(l_partkey) % 3 = 1 THEN 'A GRUBU' ELSE 'II. Derece' END, '~') AS joint_names,
        CASE WHEN min(l_partkey) % 6 = 0 THEN CAST('2027-05-01' AS DATE) END AS valid_until, CASE WHEN min(l_suppkey) % 3 > 0 THEN l_linenumber END AS page,
        CASE min(l_partkey) % 9 WHEN 0 THEN '01.05.2027 tarihine kadar' WHEN 3 THEN '02/06/2027 Tarihine Kadar ve 31.02.2027' WHEN 4 THEN 'süresiz' WHEN 5 THEN '7-8-2026' WHEN 6 THEN 'UNREADABLE' ELSE 'imza' END AS quote,
        CASE WHEN min(l_suppkey) % 2 = 0 THEN l_linenumber + 1 END AS specimen_page FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "rules": """SELECT l_orderkey AS doc, l_linenumber - 1 AS rule, CASE WHEN min(l_partkey) % 3 = 0 THEN 'joint' ELSE 'sole' END AS form, CASE WHEN min(l_suppkey) % 3 > 0 THEN CAST(floor(min(l_extendedprice)) AS BIGINT) END AS amount_max,
        split(CASE min(l_partkey) % 4 WHEN 0 THEN 'general~credit~general' WHEN 1 THEN 'unlimited' WHEN 2 THEN 'credit' ELSE 'general' END, '~') AS scope_tags, CASE WHEN min(l_suppkey) % 7 = 0 THEN 'Taşınmaz KAPSAM dışı' ELSE 'her iş' END AS scope_text,
        CASE WHEN min(l_partkey) % 13 = 0 THEN 'yetkili değildir' WHEN min(l_partkey) % 13 = 1 THEN 'UNREADABLE' ELSE 'imzalar' END AS quote, CASE min(l_suppkey) % 5 WHEN 0 THEN 'annex' WHEN 1 THEN 'directive' ELSE 'circular' END AS source, l_linenumber AS page, min(l_quantity) > 40 AS partial FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "parties": """SELECT l_orderkey AS doc, l_linenumber - 1 AS rule, k AS item, CASE WHEN (min(l_partkey) + k) % 3 = 0 THEN 'group' WHEN (min(l_partkey) + k) % 11 = 0 THEN 'external' ELSE 'person' END AS type,
        CASE WHEN (min(l_partkey) + k) % 3 = 0 THEN CASE WHEN min(l_suppkey) % 2 = 0 THEN 'a grup' ELSE 'İkinci Derece' END ELSE 'sig-' || CAST(1 + (min(l_suppkey) + k) % 5 AS STRING) END AS ref FROM lineitem CROSS JOIN (VALUES (0), (1)) v(k) GROUP BY l_orderkey, l_linenumber, k""",
    "results": """SELECT l_orderkey AS doc, l_linenumber - 1 AS chunk, 'rules_p' || CASE l_linenumber % 3 WHEN 0 THEN '1-3' WHEN 1 THEN '2+5' ELSE 'x' END AS chunk_id, CASE WHEN min(l_partkey) % 5 = 0 THEN 'annex' ELSE 'rules' END AS agent,
        CASE WHEN min(l_partkey) % 4 = 0 THEN 'witness' ELSE 'primary' END AS role, CASE WHEN min(l_suppkey) % 6 = 0 THEN 'failed' ELSE 'success' END AS status, min(l_suppkey) % 2 AS n_rules, min(l_partkey) % 10 > 0 AS valid FROM lineitem GROUP BY l_orderkey, l_linenumber""",
    "raw_rules": """SELECT l_orderkey AS doc, l_linenumber AS ordinal, l_linenumber // 2 AS chunk, 'rules_p' || CAST(l_linenumber // 2 AS STRING) AS chunk_id, l_linenumber % 2 AS item, CASE WHEN min(l_suppkey) % 3 = 0 THEN 'witness' ELSE 'primary' END AS role,
        CASE WHEN min(l_partkey) % 7 = 0 THEN 'annex' ELSE 'rules' END AS agent, min(l_partkey) % 8 = 0 AS supporting, l_linenumber // 2 AS page, CAST(NULL AS BIGINT) AS amount_min, CAST(100 * (l_orderkey % 3) AS BIGINT) AS amount_max, CASE WHEN min(l_partkey) % 2 = 0 THEN 'TL' ELSE 'tl ' END AS currency,
        CASE WHEN l_orderkey % 2 = 0 THEN 'joint' ELSE 'sole' END AS form, CASE WHEN min(l_partkey) % 9 = 0 THEN 'b' ELSE 'a' END AS joint_with, CAST(NULL AS DATE) AS valid_until, 'Yetki ' || CASE min(l_partkey) % 5 WHEN 0 THEN 'İmza sahibi' WHEN 1 THEN 'imza sahipi' WHEN 2 THEN 'İMZA SAHİBİ!' ELSE 'başka biri' END AS quote,
        min(l_quantity) > 45 AS partial, split(CASE min(l_partkey) % 3 WHEN 0 THEN 'Genel~kredi' WHEN 1 THEN 'GENEL' ELSE 'taşıt' END, '~') AS scope_tags, CASE WHEN min(l_suppkey) % 2 = 0 THEN 'her iş' ELSE 'her türlü iş' END AS scope_text FROM lineitem GROUP BY l_orderkey, l_linenumber""",
}


def _input(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [inputs.rows(spark, sf_dir, INPUTS[n]) for n in names]


def by_document(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    """Inputs that group lines, all on one partitioning by document."""
    return [inputs.rows(spark, sf_dir, INPUTS[n], by="l_orderkey") for n in names]


def chunk_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, docs = _input(spark, sf_dir, "pages", "docs")
    return pages.headers(pages.chunks(found), docs).select("doc", "chunk_id", T.page_list(F.col("focus")).alias("focus"), "supporting", "header")


def page_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pages.page_differences(*_input(spark, sf_dir, "pages", "rendered"))
    return found.select("doc", *(F.array_join(F.transform(c, lambda p: p.cast("string")), ",").alias(c) for c in ("missing", "extra")))


def _report(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = {"documents": "docs"} | {n: n for n in validation.INPUTS if n != "documents"}
    return validation.report(**{n: inputs.rows(spark, sf_dir, INPUTS[name]) for n, name in named.items()})


def provenance_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.placed(_report(spark, sf_dir))


def review_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = validation.summed_up(_report(spark, sf_dir))
    return found.select("doc", F.array_join("review", ";").alias("review"), F.array_join("codes", ";").alias("codes"), *validation.SEVERITIES)


def reader_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    (raw,) = _input(spark, sf_dir, "raw_rules")
    return validation.disagreements(raw)


def rule_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules merged by identity and quote; party types are those of one person each."""
    raw, mapped = _input(spark, sf_dir, "raw_rules", "pages")
    party = F.struct(F.lit("person").alias("type"), F.lit(None).cast("string").alias("ref"), F.col("joint_with").alias("name"))
    raw = raw.withColumns({"who": party, "joint": F.array(party)})
    found = merging.rules(raw, mapped.select("doc", "page", pages.annex_only().alias("annex")))
    return found.select("doc", "ordinal", "first", "kind", "source", "confidence", F.array_join("tags", ";").alias("tags"), "scope")


def scope_fan_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = projection.flat_rules(*by_document(spark, sf_dir, "rules", "parties", "signatories"))
    return found.select("doc", "rule", "scope", "threshold", "mode", F.array_join("signers", ";").alias("signers"), "blocked", "unresolved")


def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    signatories, rules, parties = by_document(spark, sf_dir, "signatories", "rules", "parties")
    return projection.people(signatories, rules, parties).select("doc", "rep", "mode", "max_amount", F.array_join("co_signers", ";").alias("co_signers"), "uncertain")


def authority_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection.evidence(*_input(spark, sf_dir, "docs", "rules", "signatories", "companies"))


ALL = (chunk_plan, page_gaps, provenance_flags, review_outcome, reader_disagreements, rule_merge, scope_fan_out, representatives, authority_evidence)


def _plan() -> str:
    has = lambda *ls: "(" + " OR ".join(f"list_contains(labels, '{x}')" for x in ls) + ")"
    texts = lambda x: f"list_transform({x}, lambda v: CAST(v AS STRING))"
    whole = lambda x: f"({x}[-1] - {x}[1] = len({x}) - 1)"
    shown = lambda x, s: f"CASE WHEN len({x}) = 1 THEN CAST({x}[1] AS STRING) WHEN {whole(x)} THEN {x}[1] || '-' || {x}[-1] ELSE array_to_string({texts(x)}, '{s}') END"
    span = "CASE WHEN len(section) = 1 THEN CAST(section[1] AS STRING) ELSE list_min(section) || '-' || list_max(section) END"
    blockers = has("specimens", "gazette_annex", "imza_beyannamesi", "cover_or_blank")
    marks = "list_sort(list_filter(labels, lambda x: x IN ('ic_yonerge_annex', 'board_resolution_annex', 'gazette_annex', 'imza_beyannamesi')))"
    return f"""{inputs.given(INPUTS, "pages", "docs", more="RECURSIVE ")}, p AS (SELECT *, {has("rules")} AS ruled, {has("rules")} OR NOT {blockers} AS open FROM pages),
        chain AS (SELECT doc, page FROM p WHERE ruled UNION SELECT p.doc, p.page FROM chain c JOIN p ON p.doc = c.doc AND p.page = c.page - 1 WHERE p.continues AND p.open),
        section AS (SELECT doc, page FROM chain UNION SELECT q.doc, q.page FROM p JOIN p q ON q.doc = p.doc AND q.page = p.page + 1 WHERE p.ruled AND p.continues AND q.open),
        cuts AS (SELECT *, page - lag(page, 1, -9) OVER (PARTITION BY doc ORDER BY page) <> 1 AS cut FROM section), numbered AS (SELECT *, sum(CAST(cut AS INT)) OVER (PARTITION BY doc ORDER BY page) AS run FROM cuts),
        lists AS (SELECT doc, list(page ORDER BY page) AS section FROM numbered GROUP BY doc, run), starts AS (SELECT doc, section, unnest(CASE WHEN len(section) <= 4 THEN [0] ELSE range(0, len(section) - 1, 3) END) AS s FROM lists),
        a AS (SELECT *, {marks} AS marks FROM pages), b AS (SELECT *, lag(page) OVER w AS q, lag(marks) OVER w AS old FROM a WINDOW w AS (PARTITION BY doc ORDER BY page)),
        c AS (SELECT *, sum(CASE WHEN q = page - 1 AND old = marks THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY page) AS run FROM b),
        every AS (SELECT doc, 'appointments' AS agent, list(page ORDER BY page) AS pages, list(page ORDER BY page) AS focus, coalesce(list(page ORDER BY page) FILTER ({has("appointments")}), list(page ORDER BY page)) AS section, false AS supporting FROM pages WHERE {has("appointments", "identity_header", "dayanak", "notary_block")} GROUP BY doc
          UNION ALL SELECT doc, 'rules', section[s + 1:s + 4], CASE WHEN len(section) <= 4 OR s + 3 >= len(section) - 1 THEN section[s + 1:s + 4] ELSE section[s + 1:s + 3] END, section, false FROM starts
          UNION ALL SELECT doc, 'specimens', [page], [page], list(page) OVER (PARTITION BY doc), false FROM pages WHERE {has("specimens")}
          UNION ALL SELECT doc, 'annex', list(page ORDER BY page), list(page ORDER BY page), list(page ORDER BY page), true FROM c WHERE len(marks) > 0 GROUP BY doc, run
          UNION ALL SELECT doc, 'review', [page], [page], [page], true FROM pages WHERE {has("other_unknown")}),
        rest AS (SELECT *, list_filter(pages, lambda x: NOT list_contains(focus, x)) AS other FROM every)
        SELECT r.doc, agent || '_p' || {shown("pages", "+")} AS chunk_id, {shown("focus", ", ")} AS focus, supporting, 'Document: imza sirküleri of ' || coalesce(company, 'UNREADABLE') || '. ' || CASE WHEN r.doc % 3 = 0 THEN 'A grubu; var; B' ELSE 'No structure hints' END
          || '. This request covers pages ' || {shown("pages", ", ")} || ' of the ' || CASE agent WHEN 'review' THEN 'unclassified' ELSE agent END || ' section spanning pages ' || {span} || '.'
          || CASE WHEN agent = 'rules' AND len(other) > 0 THEN ' Emit only clauses whose first quoted words begin on pages ' || {shown("focus", ", ")} || '; pages ' || {shown("other", ", ")} || ' are continuation context only.' ELSE '' END || ' Page numbers below are absolute.' AS header
        FROM rest r JOIN docs d ON d.doc = r.doc"""  # fmt: skip


_PEOPLE = f"""coded AS (SELECT *, {inputs.group_code("group_name")} AS code FROM signatories),
    met AS (SELECT p.doc, p.rule, p.item, s.sig FROM parties p JOIN coded s ON s.doc = p.doc AND (p.type = 'person' AND p.ref = 'sig-' || CAST(s.sig + 1 AS STRING) OR p.type = 'group' AND s.code <> '' AND s.code = {inputs.group_code("p.ref")})),
    joint AS (SELECT doc, rule, list(sig ORDER BY item, sig) AS sigs FROM (SELECT doc, rule, sig, min(item) AS item FROM met GROUP BY ALL) GROUP BY doc, rule HAVING (SELECT count(DISTINCT item) FROM met m WHERE m.doc = any_value(doc)) > 0),
    whole AS (SELECT m.doc, m.rule FROM met m GROUP BY m.doc, m.rule HAVING count(DISTINCT m.item) = 2),
    signing AS (SELECT j.* FROM joint j JOIN whole w ON w.doc = j.doc AND w.rule = j.rule)""".replace(" HAVING (SELECT count(DISTINCT item) FROM met m WHERE m.doc = any_value(doc)) > 0", "")


def _tckn(x: str) -> str:
    d = lambda i: f"CAST(substr({x}, {i}, 1) AS INTEGER)"
    odd, even = " + ".join(map(d, (1, 3, 5, 7, 9))), " + ".join(map(d, (2, 4, 6, 8)))
    return f"({x}[1] <> '0' AND (((7 * ({odd}) - ({even})) % 10) + 10) % 10 = {d(10)} AND ({odd} + {even} + {d(10)}) % 10 = {d(11)})"


def _vkn(x: str) -> str:
    d = lambda i: f"CAST(substr({x}, {i}, 1) AS INTEGER)"
    parts = " + ".join(f"(CASE WHEN ({d(i)} + {10 - i}) % 10 = 9 THEN 9 ELSE (({d(i)} + {10 - i}) % 10) * {1 << (10 - i)} % 9 END)" for i in range(1, 10))
    return f"((10 - ({parts}) % 10) % 10 = {d(10)})"


def _flag_sql() -> str:
    has = lambda x: f"list_contains(labels, '{x}')"
    blocks = {
        "INVALID_VKN": ("serious", "id_checksum", "SELECT doc, 'company.vkn', page FROM companies WHERE vkn <> '' AND (length(vkn) <> 10 OR NOT " + _vkn("CASE WHEN length(vkn) = 10 THEN vkn ELSE '0000000000' END") + ")"),
        "MASK_NORMALIZED": ("warn", "id_checksum", "SELECT doc, format('raw_chunks[{}].output.appointments[{}].id_no_masked', chunk, item), page FROM appointments WHERE id_no = '123**45'"),
        "IDENTITY_UNREADABLE": ("warn", "id_checksum", "SELECT doc, format('raw_chunks[{}].output.appointments[{}].id_no_masked', chunk, item), page FROM appointments WHERE lower(id_no) = 'unreadable'"),
        "IDENTITY_TYPE_UNKNOWN": ("warn", "id_checksum", "SELECT doc, format('raw_chunks[{}].output.appointments[{}].id_no_masked', chunk, item), page FROM appointments WHERE id_no LIKE 'P-%' OR regexp_full_match(id_no, '[0-9]+') AND length(id_no) <> 11"),
        "INVALID_TCKN": ("serious", "id_checksum", "SELECT doc, format('raw_chunks[{}].output.appointments[{}].id_no_masked', chunk, item), page FROM appointments WHERE regexp_full_match(id_no, '[0-9]{{11}}') AND NOT ".replace("{{", "{").replace("}}", "}") + _tckn("CASE WHEN regexp_full_match(id_no, '[0-9]{11}') THEN id_no ELSE '10000000146' END")),
        "UNRESOLVED_REFERENCE": ("warn", "unresolved_reference", f"""SELECT p.doc, format('rules[{{}}].{{}}', p.rule, CASE WHEN p.item = 0 THEN 'who' ELSE 'joint_with[' || CAST(p.item - 1 AS STRING) || ']' END), r.page FROM parties p JOIN rules r ON r.doc = p.doc AND r.rule = p.rule WHERE NOT EXISTS (SELECT 1 FROM met m WHERE m.doc = p.doc AND m.rule = p.rule AND m.item = p.item)
            UNION ALL SELECT n.doc, format('signatories[{{}}].joint_with_names[{{}}]', n.sig, n.item), n.page FROM (SELECT doc, sig, page, unnest(range(len(joint_names))) AS item, unnest(joint_names) AS name FROM signatories) n
            WHERE NOT EXISTS (SELECT 1 FROM coded s WHERE s.doc = n.doc AND ({inputs.normal("s.name")} = {inputs.normal("n.name")} OR s.code <> '' AND s.code = {inputs.group_code("n.name")}))"""),
        "VALIDITY_DATE_DROPPED": ("serious", "validity_missing_or_conflict", "SELECT doc, format('signatories[{}].valid_until', sig), page FROM signatories WHERE valid_until IS NULL AND (quote LIKE '%2027%' OR quote = '7-8-2026')"),
        "VALIDITY_MISSING": ("warn", "validity_missing_or_conflict", "SELECT doc, format('signatories[{}].valid_until', sig), page FROM signatories WHERE valid_until IS NULL AND quote IN ('imza', 'UNREADABLE')"),
        "VALIDITY_CONFLICT": ("serious", "validity_missing_or_conflict", "SELECT doc, format('signatories[{}].valid_until', sig), page FROM signatories WHERE valid_until IS NOT NULL AND quote LIKE '02/06/2027%'"),
        "RULES_SECTION_EMPTY": ("serious", "rule_completeness", f"SELECT doc, 'rules', min(page) FROM pages WHERE {has('rules')} AND doc NOT IN (SELECT doc FROM rules WHERE source <> 'annex') GROUP BY doc"),
        "RULE_CHUNK_EMPTY": ("serious", "rule_completeness", f"""SELECT r.doc, format('raw_chunks[{{}}].output.rules', r.chunk), min(p.page) FROM results r JOIN pages p ON p.doc = r.doc AND {has('rules')} AND (r.chunk_id = 'rules_p1-3' AND p.page BETWEEN 1 AND 3 OR r.chunk_id = 'rules_p2+5' AND p.page IN (2, 5))
            WHERE r.status = 'success' AND r.agent = 'rules' AND r.role = 'primary' AND r.n_rules = 0 GROUP BY r.doc, r.chunk"""),
        "APPOINTMENTS_SECTION_MISSING": ("serious", "structure_sanity", f"SELECT doc, 'page_map.pages', NULL FROM docs WHERE doc NOT IN (SELECT doc FROM pages WHERE {has('appointments')})"),
        "NOTARY_BLOCK_MISSING": ("warn", "structure_sanity", f"SELECT doc, 'page_map.pages', NULL FROM docs WHERE doc NOT IN (SELECT doc FROM pages WHERE {has('notary_block')})"),
        "SIGNATORY_ROSTER_EMPTY": ("serious", "structure_sanity", "SELECT doc, 'signatories', NULL FROM docs WHERE doc NOT IN (SELECT doc FROM signatories)"),
        "AUTHORITY_RULES_INCOMPLETE": ("serious", "structure_sanity", "SELECT doc, 'rules', (SELECT s.page FROM signatories s WHERE s.doc = d.doc AND s.form LIKE 'Sınırlı%' ORDER BY sig LIMIT 1) FROM docs d WHERE doc IN (SELECT doc FROM signatories WHERE form LIKE 'Sınırlı%') AND doc NOT IN (SELECT doc FROM rules WHERE source <> 'annex')"),
        "APPOINTMENT_WITHOUT_SPECIMEN": ("info", "structure_sanity", "SELECT doc, format('signatories[{}].specimen_bboxes', sig), page FROM signatories WHERE page IS NOT NULL AND specimen_page IS NULL"),
        "SPECIMEN_WITHOUT_APPOINTMENT": ("warn", "structure_sanity", "SELECT doc, format('signatories[{}].evidence', sig), specimen_page FROM signatories WHERE page IS NULL AND specimen_page IS NOT NULL"),
        "POSSIBLE_ROSTER_MATCH": ("info", "structure_sanity", "SELECT id, 'signatories', NULL FROM scored WHERE a <> b"),
        "RAW_CHUNK_INVALID": ("serious", "chunk_failed", "SELECT doc, format('raw_chunks[{}]', chunk), NULL FROM results WHERE NOT valid"),
        "CHUNK_FAILED": ("serious", "chunk_failed", "SELECT doc, format('raw_chunks[{}]', chunk), NULL FROM results WHERE valid AND status = 'failed'"),
        "PARTIAL_CLAUSE": ("warn", "partial_clause", "SELECT doc, format('rules[{}]', rule), page FROM rules WHERE partial"),
        "ANNEX_ONLY_RULE": ("warn", "annex_only_rule", "SELECT doc, format('rules[{}]', rule), page FROM rules WHERE source = 'annex'"),
        "OTHER_UNKNOWN_PAGE": ("serious", "other_unknown", f"SELECT doc, format('page_map.pages[{{}}]', page - 1), page FROM pages WHERE {has('other_unknown')}"),
    }
    order = ["id_checksum", "unresolved_reference", "validity_missing_or_conflict", "model_disagreement", "quote_cross_check", "rule_completeness", "structure_sanity", "chunk_failed", "partial_clause", "other_unknown", "annex_only_rule"]
    union = " UNION ".join(f"SELECT doc, '{severity}' AS severity, '{check}' AS check_name, field_path, '{code}' AS anomaly_code, CAST(evidence_page AS INT) AS evidence_page FROM ({sql}) t(doc, field_path, evidence_page)" for code, (severity, check, sql) in blocks.items())
    ranks = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(order))
    pairs = f"pairs AS (SELECT x.doc AS id, {inputs.normal('x.name')} AS a, {inputs.normal('y.name')} AS b FROM signatories x JOIN signatories y ON y.doc = x.doc AND x.page IS NOT NULL AND y.page IS NULL)"
    with_ = inputs.given(INPUTS, "pages", "docs", "companies", "appointments", "signatories", "rules", "parties", "results", more="RECURSIVE ")
    return f"""{with_}, {_PEOPLE}, {pairs}, {inputs.ratios("pairs", 90.0)}, flags AS ({union}), placed AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY CASE severity WHEN 'serious' THEN 0 WHEN 'warn' THEN 1 ELSE 2 END, CASE check_name {ranks} END, field_path, anomaly_code, evidence_page NULLS FIRST) AS place FROM flags)"""


def _merge_sql() -> str:
    """Groups of one identity have two rules at most here, so one comparison decides."""
    plain = inputs.normal("quote")
    annex = "(SELECT doc, page FROM pages WHERE (list_contains(labels, 'gazette_annex') OR list_contains(labels, 'board_resolution_annex')) AND NOT list_contains(labels, 'rules'))"
    better = "(NOT y.partial, length(y.quote)) > (NOT x.partial, length(x.quote))"
    return f"""{inputs.given(INPUTS, "raw_rules", "pages", more="RECURSIVE ")}, keyed AS (SELECT *, {plain} AS q, CASE WHEN role = 'witness' THEN 'witness' WHEN supporting OR (doc, page) IN {annex} OR agent = 'annex' THEN 'supporting' ELSE 'primary' END AS kind FROM raw_rules),
        pairs AS (SELECT x.doc AS id, x.q AS a, y.q AS b FROM keyed x JOIN keyed y ON y.doc = x.doc), {inputs.ratios("pairs", 90.0)}, alike AS (SELECT DISTINCT id, a, b FROM scored),
        two AS (SELECT x.doc, x.kind, x.ordinal AS o1, y.ordinal AS o2, {better} AS flip, x.scope_tags AS t1, y.scope_tags AS t2, x.scope_text AS s1, y.scope_text AS s2 FROM keyed x JOIN keyed y ON y.doc = x.doc AND y.kind = x.kind AND x.kind <> 'witness' AND y.page = x.page AND x.ordinal < y.ordinal AND y.joint_with = x.joint_with
          JOIN alike l ON l.id = x.doc AND l.a = y.q AND l.b = x.q),
        made AS (SELECT doc, kind, CASE WHEN flip THEN o2 ELSE o1 END AS ordinal, o1 AS first, CASE WHEN flip THEN t2 ELSE t1 END AS win, CASE WHEN flip THEN t1 ELSE t2 END AS lose, CASE WHEN length({inputs.normal("s2")}) > length({inputs.normal("s1")}) THEN s2 ELSE s1 END AS scope FROM two
          UNION ALL SELECT doc, kind, ordinal, ordinal, scope_tags, [], scope_text FROM keyed k WHERE kind <> 'witness' AND NOT EXISTS (SELECT 1 FROM two t WHERE t.doc = k.doc AND k.ordinal IN (t.o1, t.o2))),
        kept AS (SELECT m.doc, m.kind, m.ordinal, m.first, list_concat(win, list_filter(lose, lambda x: NOT list_contains(list_transform(win, lambda y: {inputs.normal("y")}), {inputs.normal("x")}))) AS tags, m.scope, k.q, k.partial FROM made m JOIN keyed k ON k.doc = m.doc AND k.ordinal = m.ordinal)
        SELECT doc, ordinal, first, kind, 'circular' AS source, CASE WHEN partial THEN 'low' WHEN EXISTS (SELECT 1 FROM keyed w JOIN alike l ON l.id = w.doc AND l.a = p.q AND l.b = w.q WHERE w.doc = p.doc AND w.kind = 'witness') OR EXISTS (SELECT 1 FROM kept w JOIN alike l ON l.id = w.doc AND l.a = p.q AND l.b = w.q WHERE w.doc = p.doc AND w.kind = 'supporting') THEN 'high' ELSE 'medium' END AS confidence, array_to_string(tags, ';') AS tags, scope FROM kept p WHERE kind = 'primary'
        UNION ALL SELECT doc, ordinal, first, kind, 'annex', 'low', array_to_string(tags, ';'), scope FROM kept s WHERE kind = 'supporting' AND NOT EXISTS (SELECT 1 FROM kept w JOIN alike l ON l.id = w.doc AND l.a = s.q AND l.b = w.q WHERE w.doc = s.doc AND w.kind = 'primary')"""  # fmt: skip


def oracle_sql() -> dict[str, str]:
    blocked = f"regexp_matches({inputs.normal("scope_text || ' ' || quote")}, 'kapsam disi|yetkili degildir|yetki disinda|ayrica karar aranir')"
    reps = lambda x: f"array_to_string(list_transform({x}, lambda s: 'rep-' || CAST(s + 1 AS STRING)), ';')"
    flags, plain = _flag_sql(), inputs.normal("quote")
    return {
        "chunk_plan": _plan(),
        "page_gaps": f"""{inputs.given(INPUTS, "pages", "rendered")}, m AS (SELECT doc, page FROM pages EXCEPT SELECT doc, page FROM rendered), e AS (SELECT doc, page FROM rendered EXCEPT SELECT doc, page FROM pages)
            SELECT doc, coalesce((SELECT string_agg(CAST(page AS STRING), ',' ORDER BY page) FROM m WHERE m.doc = d.doc), '') AS missing, coalesce((SELECT string_agg(CAST(page AS STRING), ',' ORDER BY page) FROM e WHERE e.doc = d.doc), '') AS extra FROM (SELECT doc FROM m UNION SELECT doc FROM e) d""",
        "provenance_flags": f"{flags} SELECT * FROM placed",
        "review_outcome": f"""{flags}, firsts AS (SELECT doc, severity, field_path, anomaly_code, place, place = min(place) FILTER (severity <> 'info') OVER (PARTITION BY doc, field_path) AS path_first, place = min(place) OVER (PARTITION BY doc, anomaly_code) AS code_first FROM placed)
            SELECT doc, coalesce(string_agg(field_path, ';' ORDER BY place) FILTER (path_first), '') AS review, string_agg(anomaly_code, ';' ORDER BY place) FILTER (code_first) AS codes, count(*) FILTER (severity = 'serious') AS serious, count(*) FILTER (severity = 'warn') AS warn, count(*) FILTER (severity = 'info') AS info FROM firsts GROUP BY doc""",
        "reader_disagreements": f"""{inputs.given(INPUTS, "raw_rules", more="RECURSIVE ")}, keyed AS (SELECT *, {plain} AS q FROM raw_rules), pairs AS (SELECT p.doc AS id, p.q AS a, w.q AS b FROM keyed p JOIN keyed w ON w.doc = p.doc AND w.chunk_id = p.chunk_id AND p.role = 'primary' AND w.role = 'witness'), {inputs.ratios("pairs", 90.0)},
            nearest AS (SELECT p.*, w.joint_with AS other FROM keyed p JOIN keyed w ON w.doc = p.doc AND w.chunk_id = p.chunk_id AND p.role = 'primary' AND w.role = 'witness' JOIN (SELECT DISTINCT id, a, b, score FROM scored) s ON s.id = p.doc AND s.a = p.q AND s.b = w.q QUALIFY row_number() OVER (PARTITION BY p.doc, p.ordinal ORDER BY s.score DESC, w.item) = 1)
            SELECT doc, 'warn' AS severity, 'model_disagreement' AS check_name, format('raw_chunks[{{}}].output.rules[{{}}].joint_with', chunk, item) AS field_path, 'MODEL_DISAGREEMENT' AS anomaly_code, CAST(page AS INT) AS evidence_page FROM nearest WHERE other <> joint_with
            UNION ALL SELECT doc, 'warn', 'quote_cross_check', format('raw_chunks[{{}}].output.rules[{{}}].evidence.quote', chunk, item), 'QUOTE_NOT_CORROBORATED', CAST(page AS INT) FROM keyed p WHERE role = 'primary' AND EXISTS (SELECT 1 FROM keyed w WHERE w.doc = p.doc AND w.chunk_id = p.chunk_id AND w.role = 'witness') AND NOT EXISTS (SELECT 1 FROM nearest n WHERE n.doc = p.doc AND n.ordinal = p.ordinal)""",
        "rule_merge": _merge_sql(),
        "scope_fan_out": f"""{inputs.given(INPUTS, "rules", "parties", "signatories")}, {_PEOPLE}, marked AS (SELECT r.*, {blocked} AS excluded, g.sigs FROM rules r LEFT JOIN signing g ON g.doc = r.doc AND g.rule = r.rule WHERE source <> 'annex'), tags AS (SELECT *, form = 'joint' AND sigs IS NULL AND NOT excluded AS unresolved, unnest(CASE WHEN len(list_filter(scope_tags, lambda t: t <> 'unlimited')) = 0 THEN ['general'] ELSE list_distinct(list_filter(scope_tags, lambda t: t <> 'unlimited')) END) AS scope FROM marked)
            SELECT doc, rule, scope, amount_max AS threshold, CASE WHEN NOT (excluded OR unresolved) THEN upper(form) END AS mode, CASE WHEN form = 'joint' AND NOT (excluded OR unresolved) THEN {reps("sigs")} ELSE '' END AS signers, excluded OR unresolved AS blocked, unresolved FROM tags""",
        "representatives": f"""{inputs.given(INPUTS, "rules", "parties", "signatories")}, {_PEOPLE}, usable AS (SELECT * FROM rules WHERE NOT {blocked}),
            sole AS (SELECT m.sig, u.* FROM usable u JOIN met m ON m.doc = u.doc AND m.rule = u.rule AND m.item = 0 WHERE form = 'sole'),
            alone AS (SELECT doc, sig, CASE WHEN bool_or(list_contains(scope_tags, 'general')) THEN CASE WHEN bool_or(list_contains(scope_tags, 'general') AND amount_max IS NULL) THEN NULL ELSE max(amount_max) FILTER (list_contains(scope_tags, 'general')) END ELSE CASE WHEN bool_or(amount_max IS NULL) THEN NULL ELSE max(amount_max) END END AS amount FROM sole GROUP BY doc, sig),
            together AS (SELECT g.doc, g.rule, unnest(g.sigs) AS sig, g.sigs FROM signing g JOIN usable u ON u.doc = g.doc AND u.rule = g.rule AND u.form = 'joint'),
            others AS (SELECT t.doc, t.sig, list(s.name ORDER BY t.rule, list_position(t.sigs, s.sig)) AS names FROM together t JOIN signatories s ON s.doc = t.doc AND list_contains(t.sigs, s.sig) AND s.sig <> t.sig GROUP BY t.doc, t.sig),
            rows AS (SELECT s.doc, s.sig, s.joint_names, a.doc IS NOT NULL AS is_sole, EXISTS (SELECT 1 FROM together t WHERE t.doc = s.doc AND t.sig = s.sig) AS is_joint, a.amount, coalesce({inputs.normal("s.form")}, '') AS f, coalesce(o.names, []) AS names FROM signatories s LEFT JOIN alone a ON a.doc = s.doc AND a.sig = s.sig LEFT JOIN others o ON o.doc = s.doc AND o.sig = s.sig),
            listed AS (SELECT *, list_concat(joint_names, names) AS every FROM rows)
            SELECT doc, 'rep-' || CAST(sig + 1 AS STRING) AS rep, CASE WHEN is_sole THEN 'SOLE' WHEN is_joint THEN 'JOINT' WHEN contains(f, 'munferit') THEN 'SOLE' ELSE 'JOINT' END AS mode, amount AS max_amount, CASE WHEN is_sole OR NOT is_joint AND contains(f, 'munferit') THEN '' WHEN is_joint THEN array_to_string(list_filter(every, lambda x, i: list_position(every, x) = i), ';') ELSE array_to_string(joint_names, ';') END AS co_signers,
              NOT is_sole AND NOT is_joint AND NOT contains(f, 'munferit') AND NOT contains(f, 'musterek') AS uncertain FROM listed""",
        "authority_evidence": f"""{inputs.given(INPUTS, "docs", "rules", "signatories", "companies")}, every AS (SELECT doc, 0 AS k, partial, source <> 'circular' AS other, page, rule AS n, quote FROM rules WHERE source <> 'annex' AND quote <> 'UNREADABLE' UNION ALL SELECT doc, 1, false, false, 0, sig, quote FROM signatories WHERE quote <> 'UNREADABLE' AND page IS NOT NULL UNION ALL SELECT doc, 2, false, false, 0, item, quote FROM companies WHERE quote IS NOT NULL),
            best AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY doc ORDER BY k, partial, other, page, n) = 1)
            SELECT d.doc, coalesce(b.quote, 'UNREADABLE') AS quote, CASE b.k WHEN 0 THEN b.page WHEN 1 THEN (SELECT page FROM signatories s WHERE s.doc = b.doc AND s.sig = b.n) WHEN 2 THEN 1 ELSE 1 END AS page FROM docs d LEFT JOIN best b ON b.doc = d.doc""",
    }
