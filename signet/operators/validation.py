"""Flags on what was read from documents: families of checks with one schema, their dedupe, order and summary.

Flags are rows of (doc, severity, check_name, field_path, anomaly_code, evidence_page);
null or odd values give no flag or the one for it, never an error, so one family can't
take another down.  What a single row shows is found in that row; what a document's rows
show together is found once they stand in one row, so all families need one shuffle of
slim facts by document, and each input is read once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from . import matching

# Severities and checks in the order of a report.
SEVERITIES = ["serious", "warn", "info"]
CHECKS = [
    "id_checksum", "unresolved_reference", "validity_missing_or_conflict", "model_disagreement", "quote_cross_check", "rule_completeness",
    "structure_sanity", "chunk_failed", "partial_clause", "other_unknown", "annex_only_rule", "validator_internal_error",
]
# Normalised words of a limited authority.
LIMITED = ["sinirli yetkili", "ic yonergede"]
COLUMNS = ["doc", "severity", "check_name", "field_path", "anomaly_code", "evidence_page"]

_FLAG = "struct<severity:string,check_name:string,field_path:string,anomaly_code:string,evidence_page:int>"
#: What a row of any input tells of its document.
_FACTS = {
    "own": f"array<{_FLAG}>", "listed": "boolean", "appoints": "boolean", "notarised": "boolean", "ruled": "int", "binding": "boolean", "clause": "struct<rule:bigint,page:int>",
    "party": "struct<rule:bigint,item:bigint,ref:string,code:string>", "empty": "struct<chunk:bigint,pages:array<int>>", "signs": "boolean", "ref": "string", "code": "string",
    "plain": "string", "appointed": "boolean", "asked": "array<struct<path:string,plain:string,code:string,page:int>>", "limited": "struct<sig:bigint,page:int>",
}


def _flag(severity: Column | str, check: str, path: Column | str, code: Column | str, page: Column | None = None) -> Column:
    value = lambda x: F.lit(x) if isinstance(x, str) else x
    page = F.lit(None) if page is None else page
    return F.struct(value(severity).alias("severity"), F.lit(check).alias("check_name"), value(path).alias("field_path"), value(code).alias("anomaly_code"), page.cast("int").alias("evidence_page"))


def _flags(rows: DataFrame, *flag: Column | str) -> DataFrame:
    return rows.select("doc", _flag(*flag).alias("flag")).select("doc", "flag.*")


def _path(form: str, *columns: str | Column) -> Column:
    return F.format_string(form, *columns)


def _where(*found: tuple[Column, Column]) -> Column:
    """The flags whose condition is true; by concat, for what a lambda's array is made of is never compiled."""
    none = F.array().cast(f"array<{_FLAG}>")
    return F.concat(*(F.when(keep, F.array(flag)).otherwise(none) for keep, flag in found))


def _told(rows: DataFrame, **facts: Column) -> DataFrame:
    return rows.select("doc", *(facts.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in _FACTS.items()))


def of_companies(companies: DataFrame) -> DataFrame:
    """Checksums of companies (doc, vkn, page)."""
    bad = (F.col("vkn") != "") & ~T.valid_vkn(F.col("vkn"))
    return _told(companies, own=_where((bad, _flag("serious", "id_checksum", "company.vkn", "INVALID_VKN", F.col("page")))))


def of_appointments(appointments: DataFrame) -> DataFrame:
    """Numbers of appointed people (doc, chunk, item, id_no, page)."""
    mask, raw = T.masked_id(F.col("id_no")), F.col("id_no")
    code = (
        F.when(mask.isNotNull(), F.when(F.trim(raw) != mask, "MASK_NORMALIZED")).when(T.tr_normalize(raw) == "unreadable", "IDENTITY_UNREADABLE")
        .when(~raw.rlike("^[0-9]{11}$"), "IDENTITY_TYPE_UNKNOWN").when(~T.valid_tckn(raw), "INVALID_TCKN")
    )
    rows = appointments.withColumn("found", F.when(raw != "", code))
    severity = F.when(F.col("found") == "INVALID_TCKN", "serious").otherwise("warn")
    path = _path("raw_chunks[%d].output.appointments[%d].id_no_masked", "chunk", "item")
    return _told(rows, own=_where((F.col("found").isNotNull(), _flag(severity, "id_checksum", path, F.col("found"), F.col("page")))))


def of_signatories(signatories: DataFrame) -> DataFrame:
    """Ends of rights against the dates of their evidence, specimens and appointments; names, groups and joint names for the whole.

    ``signatories`` has (doc, sig, name, group_name, form, joint_names, valid_until, quote,
    page, specimen_page): page is that of the appointment, null without one.
    """
    rows = signatories.withColumns({"dates": T.dates_in(F.col("quote")), "words": T.tr_normalize(F.col("quote"))})
    dates, until, page = F.col("dates"), F.col("valid_until"), F.col("page")
    late = (
        F.when(until.isNull() & (F.size(dates) > 0), "VALIDITY_DATE_DROPPED").when(until.isNull() & ~T.says_indefinite(F.col("quote")), "VALIDITY_MISSING")
        .when(until.isNotNull() & (F.size(dates) > 0) & F.col("words").contains("tarihine kadar") & ~F.array_contains(dates, until), "VALIDITY_CONFLICT")
    )
    rows = rows.withColumn("late", late)
    severity = F.when(F.col("late") == "VALIDITY_MISSING", "warn").otherwise("serious")
    appointed, signed = page.isNotNull(), F.col("specimen_page").isNotNull()
    own = _where(
        (F.col("late").isNotNull(), _flag(severity, "validity_missing_or_conflict", _path("signatories[%d].valid_until", "sig"), F.col("late"), page)),
        (appointed & ~signed, _flag("info", "structure_sanity", _path("signatories[%d].specimen_bboxes", "sig"), "APPOINTMENT_WITHOUT_SPECIMEN", page)),
        (~appointed & signed, _flag("warn", "structure_sanity", _path("signatories[%d].evidence", "sig"), "SPECIMEN_WITHOUT_APPOINTMENT", F.col("specimen_page"))),
    )
    asked = lambda plain, i: F.struct(_path("signatories[%d].joint_with_names[%d]", F.col("sig"), i), plain, T.plain_code(plain), page)
    limited = F.when(T.tr_normalize(F.col("form")).rlike("|".join(LIMITED)), F.struct("sig", "page"))
    return _told(
        rows, own=own, signs=F.lit(True), ref=_path("sig-%d", F.col("sig") + 1), code=T.group_code(F.col("group_name")), plain=T.tr_normalize(F.col("name")),
        appointed=appointed, asked=F.transform(F.transform("joint_names", T.tr_normalize), asked), limited=limited,
    )


def of_pages(pages: DataFrame) -> DataFrame:
    """Sections of pages (doc, page, labels) and pages that nobody knows."""
    has = lambda label: F.array_contains("labels", label)
    unknown = _flag("serious", "other_unknown", _path("page_map.pages[%d]", F.col("page") - 1), "OTHER_UNKNOWN_PAGE", F.col("page"))
    return _told(pages, own=_where((has("other_unknown"), unknown)), appoints=has("appointments"), notarised=has("notary_block"), ruled=F.when(has("rules"), F.col("page")))


def of_rules(rules: DataFrame) -> DataFrame:
    """Rules (doc, rule, source, partial, page) that are cut off or stand in an annex only."""
    path, page = _path("rules[%d]", "rule"), F.col("page")
    own = _where((F.col("partial"), _flag("warn", "partial_clause", path, "PARTIAL_CLAUSE", page)), (F.col("source") == "annex", _flag("warn", "annex_only_rule", path, "ANNEX_ONLY_RULE", page)))
    return _told(rules, own=own, binding=F.col("source").isin("circular", "directive"), clause=F.struct("rule", "page"))


def of_parties(parties: DataFrame) -> DataFrame:
    """Parties (doc, rule, item, type, ref) of rules: who is item 0, the others follow; a person's ref is a signatory's id (sig-n), a group's its name."""
    ref = F.col("ref")
    return _told(parties, party=F.struct("rule", "item", F.when(F.col("type") == "person", ref), F.when(F.col("type") == "group", T.group_code(ref))))


def of_results(results: DataFrame) -> DataFrame:
    """Readings (doc, chunk, chunk_id, agent, role, status, n_rules, valid) that failed or gave no rule."""
    chunk = _path("raw_chunks[%d]", "chunk")
    own = _where((~F.col("valid"), _flag("serious", "chunk_failed", chunk, "RAW_CHUNK_INVALID")), (F.col("valid") & (F.col("status") == "failed"), _flag("serious", "chunk_failed", chunk, "CHUNK_FAILED")))
    none = (F.col("status") == "success") & (F.col("agent") == "rules") & (F.col("role") == "primary") & (F.col("n_rules") == 0)
    return _told(results, own=own, empty=F.when(none, F.struct("chunk", T.chunk_pages(F.col("chunk_id")))))


def pairs(raw_rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rules of primary readings whose chunk also has a witness, and those witnesses' rules; of equal chunks the last reading counts."""
    last = W.partitionBy("doc", "chunk_id", "role").orderBy(F.desc("chunk"))
    rows = raw_rules.withColumn("place", F.rank().over(last)).filter("place = 1").drop("place")
    witness = rows.filter("role = 'witness'")
    primary = rows.filter("role = 'primary'").join(witness.select("doc", "chunk_id").distinct(), ["doc", "chunk_id"], "left_semi")
    return primary, witness


def disagreements(raw_rules: DataFrame, threshold: float = 90.0) -> DataFrame:
    """Fields in which the nearest witness rule differs, and rules that no witness quotes.

    ``raw_rules`` has (doc, chunk, chunk_id, role, item, form, amount_min, amount_max,
    joint_with, quote, page) of successful readings of rules.
    """
    primary, witness = pairs(raw_rules)
    quote = T.tr_normalize(F.col("quote"))
    left = primary.select("doc", "chunk_id", F.struct("item").alias("left_id"), quote.alias("left_text"))
    right = witness.select("doc", "chunk_id", F.struct("item").alias("right_id"), quote.alias("right_text"))
    best = matching.best(left, right, ["doc", "chunk_id"], threshold).select("doc", "chunk_id", F.col("left_id.item").alias("item"), F.col("right_id.item").alias("seen"))
    fields = ["form", "amount_min", "amount_max", "joint_with"]
    other = witness.select("doc", "chunk_id", F.col("item").alias("seen"), *(F.col(c).alias(f"w_{c}") for c in fields))
    rows = primary.join(best, ["doc", "chunk_id", "item"], "left").join(other, ["doc", "chunk_id", "seen"], "left")
    unlike = F.filter(F.array(*(F.when(~F.col(c).eqNullSafe(F.col(f"w_{c}")), F.lit("sole_or_joint" if c == "form" else c)) for c in fields)), lambda c: c.isNotNull())
    apart = rows.filter("seen is not null").withColumn("field", F.explode(unlike))
    found = _flags(apart, "warn", "model_disagreement", _path("raw_chunks[%d].output.rules[%d].%s", "chunk", "item", "field"), "MODEL_DISAGREEMENT", F.col("page"))
    return found.union(_flags(rows.filter("seen is null"), "warn", "quote_cross_check", _path("raw_chunks[%d].output.rules[%d].evidence.quote", "chunk", "item"), "QUOTE_NOT_CORROBORATED", F.col("page")))


#: Inputs of ``flags`` and what their rows tell.
INPUTS = {
    "documents": lambda rows: _told(rows, listed=F.lit(True)), "pages": of_pages, "rules": of_rules, "parties": of_parties, "results": of_results,
    "signatories": of_signatories, "companies": of_companies, "appointments": of_appointments,
}


def _gathered(told: DataFrame) -> DataFrame:
    """One row for each document; lists go through the shuffle as one, for every list of its own costs a buffer a row."""
    lists = ["own", "ruled", "clause", "party", "empty", "ref", "code", "plain", "appointed", "asked"]
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False)).alias(c)
    rows = told.groupBy("doc").agg(
        F.collect_list(F.struct(*lists)).alias("all"), *map(some, ("listed", "appoints", "notarised", "binding", "signs")),
        F.count("limited").alias("n_limited"), F.min_by("limited.page", "limited.sig").alias("limited_page"),
    )
    each = lambda c: F.array_compact(F.col(f"all.{c}"))
    names = lambda keep: F.array_distinct(F.transform(F.filter("all", lambda x: (x["plain"] != "") & keep(x["appointed"])), lambda x: x["plain"]))
    return rows.select(
        "doc", "listed", "appoints", "notarised", "binding", "signs", "n_limited", "limited_page", F.flatten(each("own")).alias("own"), F.array_sort(F.array_distinct(each("ruled"))).alias("ruled"),
        each("clause").alias("clauses"), each("party").alias("parties"), each("empty").alias("empties"), each("ref").alias("refs"), F.array_remove(each("code"), "").alias("codes"),
        F.array_remove(each("plain"), "").alias("people"), F.flatten(each("asked")).alias("asked"), names(lambda x: x).alias("heads"), names(lambda x: ~x).alias("others"),
    )


def gathered_flags(threshold: float = 90.0, **given: DataFrame) -> DataFrame:
    """(doc, flags): all flags of the ``given`` inputs, by name as in ``INPUTS``; an input that isn't given has no rows.

    What a document should have (sections, a roster) is asked of ``documents`` only; all
    else of whatever has rows.  Rows without a doc stand together as one document.  What
    stands in one row is what one document holds.
    """
    rows = _gathered(reduce(DataFrame.union, (INPUTS[name](rows) for name, rows in given.items())))
    met = lambda items, x: F.coalesce(F.array_contains(items, x), F.lit(False))
    slot = lambda p: F.when(p["item"] == 0, "who").otherwise(_path("joint_with[%d]", p["item"] - 1))
    lost = F.filter("parties", lambda p: ~met("refs", p["ref"]) & ~met("codes", p["code"]))
    of_party = lambda p: F.transform(F.filter("clauses", lambda r: r["rule"] == p["rule"]), lambda r: _flag("warn", "unresolved_reference", _path("rules[%d].%s", p["rule"], slot(p)), "UNRESOLVED_REFERENCE", r["page"]))
    nobody = F.filter("asked", lambda a: ~met("people", a["plain"]) & ~met("codes", a["code"]))
    seen = F.filter(F.transform("empties", lambda e: F.struct(e["chunk"].alias("chunk"), F.array_intersect("ruled", e["pages"]).alias("met"))), lambda e: F.size(e["met"]) > 0)
    near = lambda a: F.filter("others", lambda b: (a != b) & matching.possible(a, b, threshold))
    rows = rows.withColumn("near", F.flatten(F.transform("heads", lambda a: F.transform(near(a), lambda b: F.struct(a.alias("a"), b.alias("b"))))))
    alike = matching.any_ratio(threshold)(F.col("near.a"), F.col("near.b"))
    structure = "structure_sanity"
    together = _where(
        ((F.size("ruled") > 0) & ~F.col("binding"), _flag("serious", "rule_completeness", "rules", "RULES_SECTION_EMPTY", F.array_min("ruled"))),
        (F.col("listed") & ~F.col("appoints"), _flag("serious", structure, "page_map.pages", "APPOINTMENTS_SECTION_MISSING")),
        (F.col("listed") & ~F.col("notarised"), _flag("warn", structure, "page_map.pages", "NOTARY_BLOCK_MISSING")),
        (F.col("listed") & ~F.col("signs"), _flag("serious", structure, "signatories", "SIGNATORY_ROSTER_EMPTY")),
        ((F.col("n_limited") > 0) & ~F.col("binding"), _flag("serious", structure, "rules", "AUTHORITY_RULES_INCOMPLETE", F.col("limited_page"))),
        (F.col("alike"), _flag("info", structure, "signatories", "POSSIBLE_ROSTER_MATCH")),
    )
    every = F.concat(
        "own", F.flatten(F.transform(lost, of_party)), F.transform(nobody, lambda a: _flag("warn", "unresolved_reference", a["path"], "UNRESOLVED_REFERENCE", a["page"])),
        F.transform(seen, lambda e: _flag("serious", "rule_completeness", _path("raw_chunks[%d].output.rules", e["chunk"]), "RULE_CHUNK_EMPTY", F.array_min(e["met"]))), together,
    )
    return rows.withColumn("alike", alike).select("doc", F.explode(F.array(every)).alias("flags"))  # found once, whatever is asked of it above


def flags(threshold: float = 90.0, **given: DataFrame) -> DataFrame:
    """All flags of the ``given`` inputs, one row each."""
    return gathered_flags(threshold, **given).select("doc", F.explode("flags").alias("flag")).select("doc", "flag.*")


def report(threshold: float = 90.0, **given: DataFrame) -> DataFrame:
    """(doc, flags): what ``ordered`` gives of ``flags``, as one list a document, put in order within its row; documents without flags have none."""
    rank = lambda names, x: F.coalesce(*(F.when(x == name, i) for i, name in enumerate(names)), F.lit(99))
    keyed = F.transform("flags", lambda f: F.struct(rank(SEVERITIES, f["severity"]).alias("a"), rank(CHECKS, f["check_name"]).alias("b"), f["field_path"].alias("c"), F.coalesce(f["anomaly_code"], F.lit("")).alias("d"), f["evidence_page"].alias("e"), f.alias("flag")))
    placed = F.transform(F.array_sort(F.array_distinct(keyed)), lambda x: x["flag"])
    return gathered_flags(threshold, **given).filter(F.size("flags") > 0).select("doc", F.explode(F.array(placed)).alias("flags"))


def placed(reports: DataFrame) -> DataFrame:
    """Flags of ``report`` one row each, with ``place``, from 1."""
    rows = reports.select("doc", F.posexplode("flags").alias("place", "flag"))
    return rows.select("doc", *(f"flag.{c}" for c in COLUMNS[1:]), (F.col("place") + 1).alias("place"))


def summed_up(reports: DataFrame) -> DataFrame:
    """``outcome`` of ``report``, found within each row."""
    paths = lambda keep, c: F.array_distinct(F.transform(F.filter("flags", keep), lambda f: f[c]))
    of = lambda severity: lambda f: f["severity"] == severity
    counts = (F.size(F.filter("flags", of(s))).cast("bigint").alias(s) for s in SEVERITIES)
    return reports.select("doc", paths(lambda f: f["severity"] != "info", "field_path").alias("review"), paths(lambda f: f["anomaly_code"].isNotNull(), "anomaly_code").alias("codes"), *counts)


def ordered(flags: DataFrame, *more: DataFrame) -> DataFrame:
    """Distinct flags of all families with ``place``, from 1: by severity, check, path (as text) and code."""
    every = reduce(DataFrame.unionByName, (flags, *more)).select(*COLUMNS).distinct()
    rank = lambda names, c: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, names)), F.col(c)), F.lit(0)), F.lit(99))
    own = W.partitionBy("doc").orderBy(rank(SEVERITIES, "severity"), rank(CHECKS, "check_name"), "field_path", F.coalesce("anomaly_code", F.lit("")), "evidence_page")
    return every.withColumn("place", F.row_number().over(own))


def outcome(flags: DataFrame) -> DataFrame:
    """doc, review (paths of flags above info), codes, and counts by severity, from ``ordered`` flags."""
    listed = lambda keep, c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("place", c)))), lambda x: x[c]))
    counts = (F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES)
    return flags.groupBy("doc").agg(listed(F.col("severity") != "info", "field_path").alias("review"), listed(F.col("anomaly_code").isNotNull(), "anomaly_code").alias("codes"), *counts)


#: Paths that a person can correct; only these stand in the way of an approval.
CORRECTABLE = r"^(company\.(name|taxNumber|mersisNumber)|representatives\[[a-z][a-z0-9_-]{0,63}\]\.(name|mode)|validUntil)$"


def blocking(review: DataFrame, corrected: DataFrame) -> DataFrame:
    """Paths (doc, path) of ``review`` that a person can correct and that ``corrected`` (doc, path) doesn't have."""
    return review.filter(F.col("path").rlike(CORRECTABLE)).join(corrected.select("doc", "path").distinct(), ["doc", "path"], "left_anti")
