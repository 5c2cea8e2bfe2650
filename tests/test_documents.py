"""Operators over documents where SQL is too narrow: long merges, missing values, files and streams."""

import json
import random

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from signet.functions import text as T
from signet.operators import authority, history, matching, merging, pages, projection, validation
from signet.sources import documents, registry, results
from signet.streaming import requests


def party(name):
    return ("person", None, name)


RAW = "doc int, ordinal int, agent string, role string, supporting boolean, page int, amount_min long, amount_max long, currency string, form string, who struct<type:string,ref:string,name:string>, joint array<struct<type:string,ref:string,name:string>>, valid_until date, quote string, partial boolean, scope_tags array<string>, scope_text string"


def greedy(rows, threshold=90.0):
    """Survivors of one document by a plain loop over all rules in order."""
    found = []
    for row in sorted(rows, key=lambda r: r["ordinal"]):
        names = [row["who"][2], *sorted(p[2] for p in row["joint"])]
        key = (row["page"], row["amount_max"], row["form"], tuple(sorted(names) if row["form"] == "joint" else names))
        scored = [(matching.indel_ratio(row["quote"], o["quote"]), -k) for k, o in enumerate(found) if o["key"] == key]
        best = max((s for s in scored if s[0] >= threshold), default=None)
        if best is None:
            found.append({"key": key, "first": row["ordinal"], "ordinal": row["ordinal"], "quote": row["quote"], "score": (not row["partial"], len(row["quote"])), "tags": list(row["scope_tags"]), "scope": row["scope_text"]})
            continue
        other = found[-best[1]]
        score = (not row["partial"], len(row["quote"]))
        scope = row["scope_text"] if len(row["scope_text"]) > len(other["scope"]) else other["scope"]
        first, second = (row["scope_tags"], other["tags"]) if score > other["score"] else (other["tags"], row["scope_tags"])
        tags = [*first, *dict.fromkeys(t for t in second if t not in first)]
        if score > other["score"]:
            other.update(ordinal=row["ordinal"], quote=row["quote"], score=score)
        other.update(tags=tags, scope=scope)
    return {(f["ordinal"], f["first"], ";".join(f["tags"]), f["scope"]) for f in found}


@pytest.mark.parametrize("batch", [10_000, 1, 3])
def test_long_merges_equal_a_plain_loop(spark, batch):
    """Groups may stand across Arrow batches of any size."""
    rng, rows = random.Random(4), []
    for doc in range(30):
        for ordinal in range(rng.randrange(1, 14)):
            quote = list("imza yetkisi genel islemler icin gecerlidir")
            for _ in range(rng.randrange(0, 7)):
                quote[rng.randrange(len(quote))] = rng.choice("abcdefgh")
            a, b = rng.choice("xy"), rng.choice("xy")
            rows.append((doc, ordinal, "rules", "primary", False, rng.choice([1, 1, 1, 2]), None, rng.choice([None, None, 5]), None, rng.choice(["sole", "joint"]), party(a), [party(b)], None, "".join(quote), rng.random() < 0.2, rng.sample(["p", "q", "r"], rng.randrange(0, 3)), "s" * rng.randrange(1, 5)))
    raw = spark.createDataFrame(rows, RAW)
    got = {}
    usual = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    found = merging.merged(raw.withColumn("kind", F.lit("primary"))).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", usual)
    for r in found:
        got.setdefault(r.doc, set()).add((r.ordinal, r.first, ";".join(r.tags), r.scope))
    names = [c.split()[0] for c in RAW.replace("struct<type:string,ref:string,name:string>", "s").split(", ")]
    by_doc = {}
    for row in rows:
        by_doc.setdefault(row[0], []).append(dict(zip(names, row, strict=True)))
    assert got == {doc: greedy(own) for doc, own in by_doc.items()}
    assert sum(map(len, got.values())) < len(rows)


def test_confidence_and_sources(spark):
    def rule(ordinal, role, agent, page, quote, partial=False, supporting=False):
        return (1, ordinal, agent, role, supporting, page, None, None, "TL", "sole", party("a"), [], None, quote, partial, ["general"], "t")

    rows = [rule(0, "primary", "rules", 1, "ilk hüküm metni"), rule(1, "witness", "rules", 1, "ilk hukum metni"), rule(2, "primary", "rules", 2, "başka bir kural"), rule(3, "primary", "rules", 3, "yarım kalan kural", True),
            rule(4, "primary", "annex", 5, "ilk hüküm metni"), rule(5, "primary", "rules", 6, "yalnız ekte olan", supporting=True), rule(6, "witness", "rules", 3, "yarım kalan kural"), rule(7, "primary", "rules", 9, "ek sayfasında")]
    mapped = spark.createDataFrame([(1, 9, True), (1, 1, False)], "doc int, page int, annex boolean")
    got = {r.ordinal: (r.source, r.confidence) for r in merging.rules(spark.createDataFrame(rows, RAW), mapped).collect()}
    assert got == {0: ("circular", "high"), 2: ("circular", "medium"), 3: ("circular", "low"), 5: ("annex", "low"), 7: ("annex", "low")}


def test_merged_rules_of_odd_rows(spark):
    rows = [(1, k, "rules", role, None, 1, None, None, None, "sole", party(None), None, None, quote, partial, tags, None) for k, role, quote, partial, tags in [(0, "primary", None, None, None), (1, "primary", None, True, ["a"]), (2, "witness", None, False, None), (3, None, "tek kural", False, [])]]
    rows.append((None, 0, None, "primary", True, None, None, None, None, None, None, None, None, "q", None, ["a", None], "x"))
    raw, mapped = spark.createDataFrame(rows, RAW), spark.createDataFrame([(1, None, None), (None, 1, True)], "doc int, page int, annex boolean")
    got = {(r.doc, r.ordinal): (r.first, r.tags) for r in merging.merged(merging.candidates(raw, mapped)).collect()}
    # rules without a quote have equal, empty ones, and what isn't known to be partial isn't; a rule without a role is a primary one
    assert got == {(1, 0): (0, ["a"]), (1, 3): (3, []), (None, 0): (0, ["a", None])}
    found = {(r.doc, r.ordinal): (r.kind, r.confidence) for r in merging.rules(raw, mapped).collect()}
    assert found[1, 0] == ("primary", "medium") and found[1, 3] == ("primary", "medium")
    assert not merging.rules(raw.limit(0), mapped).count() and merging.rules(raw, mapped.limit(0)).count() == len(found)


def test_sections_equal_the_rule(spark):
    rng, rows = random.Random(6), []
    kinds = ["rules", "specimens", "dayanak", "gazette_annex", "other_unknown"]
    for doc in range(60):
        for page in sorted(rng.sample(range(1, 13), 8)):
            rows.append((doc, page, rng.sample(kinds, rng.randrange(1, 3)), rng.random() < 0.6))
    got = {(r.doc, r.page) for r in pages.rule_section(spark.createDataFrame(rows, "doc int, page int, labels array<string>, continues boolean")).collect()}
    known, want = {(d, p): (labels, on) for d, p, labels, on in rows}, set()
    open_ = lambda labels: "rules" in labels or not set(labels) & set(pages.BLOCKERS)
    for (d, p), (labels, on) in known.items():
        if "rules" in labels:
            want.add((d, p))
            q = p - 1
            while (d, q) in known and known[d, q][1] and open_(known[d, q][0]):
                want.add((d, q))
                q -= 1
            if on and (d, p + 1) in known and open_(known[d, p + 1][0]):
                want.add((d, p + 1))
    assert got == want


def test_pruned_pairs_are_no_matches(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("aeiornxyz ") for _ in range(rng.randrange(0, 14))) for _ in range(90)]
    left = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts[:45])], "k int, left_id int, left_text string")
    right = spark.createDataFrame([(0, i, t) for i, t in enumerate(texts[45:])], "k int, right_id int, right_text string")
    got = {(r.left_id, r.right_id): r.score for r in matching.within(left, right, ["k"], 60.0).collect()}
    want = {(i, j): matching.indel_ratio(a, b) for i, a in enumerate(texts[:45]) for j, b in enumerate(texts[45:])}
    assert got == {k: v for k, v in want.items() if v >= 60} and len(got) > 20


def test_a_batch_sees_its_own_rows_and_is_refused_whole(spark):
    base = spark.createDataFrame([("d", "a", "1"), ("d", "b", None)], "doc string, path string, value string")
    rows = [("d", 1, 1, "a", "1", "2"), ("d", 1, 2, "a", "2", "3"), ("d", 2, 3, "a", "3", "4"), ("d", 2, 4, "b", "x", "y"), ("d", 3, 5, "a", "3", "5"), ("d", 4, 6, "b", None, "z"), ("d", 5, 7, "c", None, "1"), ("e", 1, 1, "a", None, "1")]
    corrections = spark.createDataFrame(rows, "doc string, batch int, seq int, path string, old_value string, new_value string")
    got = {(r.doc, r.batch): r.applied for r in history.apply_batches(base, corrections, "doc").collect()}
    assert got == {("d", 1): True, ("d", 2): False, ("d", 3): True, ("d", 4): True, ("d", 5): False, ("e", 1): False}
    assert history.apply_batches(base, corrections.limit(0), "doc").count() == 0


def write(path, whole):
    path.write_text(whole if isinstance(whole, str) else json.dumps(whole))
    return str(path)


def test_registry_fails_closed(spark, tmp_path):
    person = {"id": "r1", "name": "N", "tckn": None, "mode": "SOLE", "status": "ACTIVE"}
    good = {"schema_version": "1.0", "companies": [{"mersis": "01", "legal_name": "X", "status": "ACTIVE", "representatives": [person]}]}
    seed = write(tmp_path / "seed.json", good)
    companies, reps = registry.read_registry(spark, str(tmp_path / "none.json"), seed)
    assert companies.count() == reps.count() == 1
    odd = [good | {"schema_version": "2.0"}, {"schema_version": "1.0"}, {"schema_version": "1.0", "companies": [{"mersis": "01"}]}, '{"schema_version": "1.0", "companies": [', good | {"companies": [good["companies"][0] | {"representatives": [{"name": "N"}]}]}]
    for i, whole in enumerate(odd):
        with pytest.raises((PySparkException, Py4JJavaError)):
            registry.read_registry(spark, write(tmp_path / f"odd{i}.json", whole))[1].collect()
    place = registry.write(companies, reps, str(tmp_path / "kept"), 1)
    again = spark.read.schema("mersis string, representatives array<struct<id:string>>").json(place).first()
    assert again.mersis == "01" and again.representatives[0].id == "r1"
    twice = spark.createDataFrame([("01", "r1", "REMOVED"), ("01", "r1", "REMOVED"), ("02", "r9", "ACTIVE")], "mersis string, rep_id string, status string")
    assert [r.status for r in registry.patched(reps, twice).collect()] == ["REMOVED"]
    assert [r.rep_id for r in registry.unknown_patches(reps, twice).collect()] == ["r9"]
    assert registry.company(companies, "01").count() == 1 and registry.company(companies, "02").count() == 0
    assert registry.reshaped(companies, reps).first().registry["01"].reps[0].mode == "SOLE"


def test_stored_results(spark):
    stored = spark.createDataFrame([("aa__1__x", '{"v": 1}'), ("aa__1__y", "{"), ("bb__1__x", None)], "key string, payload string")
    asked = spark.createDataFrame([("aa__1__x",), ("aa__1__y",), ("bb__1__x",), ("cc",)], "key string")
    assert {r.key: r.v for r in results.hits(asked, stored, "v bigint").select("key", "result.v").collect()} == {"aa__1__x": 1, "aa__1__y": None, "bb__1__x": None, "cc": None}
    assert results.hits(asked, stored, "v bigint", enabled=False).filter("result is not null").count() == 0
    left, gone = results.cleared(stored, "aa")
    assert gone == 2 and left.count() == 1
    files = spark.createDataFrame([("a", b"\xff\xd8\xff0"), ("b", b""), ("c", None), ("d", b"\x89PNG\r\n\x1a\n")], "path string, content binary")
    assert {r.path: (r.mime, r.refused) for r in documents.ingest(files).collect()} == {"a": ("image/jpeg", None), "b": (None, "EMPTY"), "c": (None, "EMPTY"), "d": ("image/png", None)}


def test_flags_of_nothing_and_order(spark):
    none = spark.createDataFrame([], "doc int, page int, labels array<string>")
    rules = spark.createDataFrame([], "doc int, rule int, source string, partial boolean, page int")
    readings = spark.createDataFrame([(1, 10, "rules_p1", "rules", "primary", "failed", 0, True), (1, 2, "rules_p1", "rules", "primary", "failed", 0, True)], "doc int, chunk int, chunk_id string, agent string, role string, status string, n_rules int, valid boolean")
    told = validation.flags(pages=none, rules=rules, results=readings)
    found = validation.ordered(told, told)
    assert [(r.field_path, r.place) for r in found.orderBy("place").collect()] == [("raw_chunks[10]", 1), ("raw_chunks[2]", 2)]
    assert validation.outcome(found.limit(0)).count() == 0


def test_reports_are_the_ordered_flags(spark):
    readings = [(d, c, "rules_p1", "rules", role, status, 0, valid) for d in (1, 2, None) for c, role, status, valid in ((10, "primary", "failed", True), (2, "primary", "success", True), (3, "witness", "success", False), (3, "witness", "success", False))]
    readings = spark.createDataFrame([*readings, (7, 1, "x", "rules", "witness", "success", 1, True)], "doc int, chunk int, chunk_id string, agent string, role string, status string, n_rules int, valid boolean")
    pages = spark.createDataFrame([(1, 1, ["rules", "other_unknown"]), (2, 9, None), (3, None, ["other_unknown"])], "doc int, page int, labels array<string>")
    companies = spark.createDataFrame([(1, "12", None), (4, "", 1), (5, "1234567890", 2)], "doc int, vkn string, page int")
    given = {"pages": pages, "results": readings, "companies": companies, "documents": pages.select("doc").distinct()}
    want, made = validation.ordered(validation.flags(**given)), validation.report(**given)
    assert sorted(map(repr, validation.placed(made).select(want.columns).collect())) == sorted(map(repr, want.collect())) and want.count() > 10
    sums = validation.outcome(want)
    assert sorted(map(repr, validation.summed_up(made).select(sums.columns).collect())) == sorted(map(repr, sums.collect()))
    plan = validation.placed(made)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan  # flags are found and put in order in the row of their document


def test_codes_of_groups_without_lambdas(spark):
    texts = [None, "", "grup", "Grubu grup", "A grubu", "a grup grubu b", "İkinci Derece", "II. imza yetkilisi", "grupa", "a grup", "x-grup-2", "V", "yetkili imza vi derece", "Ⅱ grup", "K\u212a \u0130\u0307 grup", "ﬁ grubu"]
    words = {"grup", "grubu", "derece", "derecesi", "imza", "yetkili", "yetkilisi", "yetkilileri"}
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(T.tr_normalize(F.col("t")).alias("plain"), T.group_code(F.col("t")).alias("code"))
    for r in rows.collect():
        kept = " ".join(w for w in (r.plain or "").split() if w not in words)
        assert r.code == T.GROUP_RANKS.get(kept, kept)
    assert "lambda" not in rows._jdf.queryExecution().optimizedPlan().toString()  # what a lambda's array is made of is never compiled


def test_stream_of_requests(spark, tmp_path):
    rows = [(i, 1, "general", 100 * i, "p0", None) for i in range(6)]
    kinds = "txn_id long, company long, subject string, amount long, initiator string, day date"
    place = str(tmp_path / "asked.parquet")
    spark.createDataFrame(rows, kinds).write.parquet(place)
    given = (
        spark.createDataFrame([(1, "ACTIVE", None)], "company long, status string, valid_until date"), spark.createDataFrame([(1, "p0", "s0", "SOLE", 300)], "company long, person string, source_id string, mode string, max_amount long"),
        spark.createDataFrame([(1, "general", None, "SOLE", False, 0, [])], "company long, scope string, threshold long, mode string, blocked boolean, ordinal int, signers array<string>"),
        spark.createDataFrame([(1, "ACTIVE")], "company long, status string"), spark.createDataFrame([(1, "p0", "ACTIVE")], "company long, person string, status string"),
    )
    found = requests.drain(requests.decide(requests.read_table(spark, str(tmp_path), "asked"), *given), f"file://{tmp_path}/out")
    want = {i: "ALLOWED" if i <= 3 else "DENIED" for i in range(6)}
    assert {r.txn_id: r.verdict for r in found.collect()} == want
    assert {r.txn_id: r.verdict for r in authority.evaluate(spark.read.parquet(place), *given).collect()} == want


def test_flags_of_odd_rows(spark):
    docs = spark.createDataFrame([(1,), (2,), (None,)], "doc int")
    people = spark.createDataFrame(
        [(1, 0, "Ayşe Kaya Demirtaş", None, None, None, None, None, 2, None), (1, 1, "ayse kaya demirtas", "A Grubu", "Sınırlı Yetkili", ["b", None, ""], None, "süresiz", None, 3),
         (1, 2, "Ayşe Kaya Demirtaşı", None, None, [], None, "süresiz", None, None), (3, 0, None, "", None, ["a grubu"], None, "süresiz", 1, 1)],
        "doc int, sig int, name string, group_name string, form string, joint_names array<string>, valid_until date, quote string, page int, specimen_page int",
    )
    parties = spark.createDataFrame([(1, 0, 0, "person", "sig-1"), (1, 0, 1, "group", "A grup"), (1, 0, 2, "person", None), (1, 0, 3, None, "sig-1"), (1, 9, 0, "person", "sig-9")], "doc int, rule int, item int, type string, ref string")
    rules = spark.createDataFrame([(1, 0, "annex", None, 4), (2, 0, None, True, None)], "doc int, rule int, source string, partial boolean, page int")
    mapped = spark.createDataFrame([(1, 3, ["rules", None]), (1, 2, ["rules"]), (2, None, None), (4, 1, ["notary_block"])], "doc int, page int, labels array<string>")
    readings = spark.createDataFrame([(1, 0, "rules_p2-3", "rules", "primary", "success", 0, True), (1, 1, None, "rules", "primary", "success", 0, None), (1, 2, "rules_p7", "rules", "primary", "success", 0, True)], "doc int, chunk int, chunk_id string, agent string, role string, status string, n_rules int, valid boolean")
    given = {"documents": docs, "signatories": people, "parties": parties, "rules": rules, "pages": mapped, "results": readings}
    got = {(r.doc, r.field_path, r.anomaly_code, r.evidence_page) for r in validation.flags(**given).collect()}
    lacks = {(d, p, c, None) for d in (1, 2, None) for p, c in (("page_map.pages", "APPOINTMENTS_SECTION_MISSING"), ("page_map.pages", "NOTARY_BLOCK_MISSING"))}
    assert got == lacks | {
        (2, "signatories", "SIGNATORY_ROSTER_EMPTY", None), (None, "signatories", "SIGNATORY_ROSTER_EMPTY", None), (1, "signatories[0].valid_until", "VALIDITY_MISSING", 2),
        (1, "signatories[0].specimen_bboxes", "APPOINTMENT_WITHOUT_SPECIMEN", 2), (1, "signatories[1].evidence", "SPECIMEN_WITHOUT_APPOINTMENT", 3), (1, "signatories", "POSSIBLE_ROSTER_MATCH", None),
        (3, "signatories[0].joint_with_names[0]", "UNRESOLVED_REFERENCE", 1), *((1, f"signatories[1].joint_with_names[{i}]", "UNRESOLVED_REFERENCE", None) for i in range(3)), (1, "rules[0].joint_with[1]", "UNRESOLVED_REFERENCE", 4), (1, "rules[0].joint_with[2]", "UNRESOLVED_REFERENCE", 4),
        (1, "rules[0]", "ANNEX_ONLY_RULE", 4), (2, "rules[0]", "PARTIAL_CLAUSE", None), (1, "rules", "RULES_SECTION_EMPTY", 2), (1, "rules", "AUTHORITY_RULES_INCOMPLETE", None), (1, "raw_chunks[0].output.rules", "RULE_CHUNK_EMPTY", 2),
    }
    assert validation.flags(**{name: rows.limit(0) for name, rows in given.items()}).count() == 0


def test_people_behind_parties_of_odd_rows(spark):
    rules = spark.createDataFrame(
        [(1, 0, "joint", 5, ["general"], None, "q"), (1, 1, "sole", None, None, None, None), (1, 1, "sole", None, None, None, None), (2, 0, "joint", 1, [], None, None), (None, 0, "sole", 1, [], None, None), (1, 2, "joint", 1, ["credit"], None, None), (1, 3, "sole", 9, ["credit"], None, None)],
        "doc int, rule int, form string, amount_max long, scope_tags array<string>, scope_text string, quote string",
    )
    parties = spark.createDataFrame(
        [(1, 0, 0, "group", "A grubu"), (1, 0, 1, "person", "sig-1"), (1, 0, 1, "person", "sig-1"), (1, 1, 0, "person", "sig-1"), (2, 0, 0, "person", "sig-1"), (1, 2, 0, None, "sig-1"), (1, 2, 1, "group", None), (None, 0, 0, "person", "sig-1"), (1, 3, 0, "person", "sig-3")],
        "doc int, rule int, item int, type string, ref string",
    )
    signatories = spark.createDataFrame(
        [(1, 0, "Ali", None, None, None), (1, 1, "Can", "a grup", None, ["Ece", ""]), (1, 2, None, "A", "münferit", None), (3, 0, "Eda", "A", "müşterek", None)],
        "doc int, sig int, name string, group_name string, form string, joint_names array<string>",
    )
    found = {(r.doc, r.rule): (r.first and [x.sig for x in r.first], r.sigs and [x.sig for x in r.sigs]) for r in projection.resolved(rules, parties, signatories).collect()}
    assert found == {(1, 0): ([1, 2], [1, 2, 0]), (1, 1): ([0], [0]), (2, 0): (None, None), (None, 0): (None, None), (1, 2): ([], None), (1, 3): ([2], [2])}
    people = {(r.doc, r.sig): (r["mode"], r.max_amount, r.co_signers, r.uncertain) for r in projection.people(signatories, rules, parties).collect()}
    # a repeated sole rule without a limit leaves Ali without one; Can signs with all that rule 0 names, nameless people left out
    assert people == {(1, 0): ("SOLE", None, [], False), (1, 1): ("JOINT", None, ["Ece", "Ali"], False), (1, 2): ("SOLE", 9, [], False), (3, 0): ("JOINT", None, [], False)}
    flat = {(r.doc, r.rule): (r.signers, r.blocked, r.unresolved) for r in projection.flat_rules(rules.withColumn("source", F.lit("circular")), parties, signatories).collect()}
    assert flat[1, 0] == (["rep-2", "rep-3", "rep-1"], False, False) and flat[1, 2] == flat[2, 0] == ([], True, True)
    none = [d.limit(0) for d in (rules, parties, signatories)]
    assert not projection.resolved(*none).count() and not projection.people(none[2], rules, parties).count()


def test_flat_rules_know_their_parties_without_gathering_them(spark):
    rules = spark.createDataFrame(
        [(1, 0, "joint", 5, ["credit", None, "unlimited", "credit"], None, "q", "circular"), (1, None, "joint", 6, None, "x", None, "circular"), (1, 1, "joint", 7, [None], "KAPSAM dışı", None, "circular"), (1, 2, None, 8, [], None, None, "circular"), (2, 0, "sole", None, ["general"], None, None, "circular"), (1, 3, "joint", 1, [], None, None, "annex")],
        "doc int, rule int, form string, amount_max long, scope_tags array<string>, scope_text string, quote string, source string",
    )
    parties = spark.createDataFrame([(1, 0, 0, "group", "A grubu"), (1, 0, 1, "person", "sig-1"), (1, None, 0, "person", "sig-2"), (1, 1, 0, "person", "sig-1"), (1, 2, 0, "group", "A"), (9, 0, 0, "person", "sig-1")], "doc int, rule int, item int, type string, ref string")
    signatories = spark.createDataFrame([(1, 0, "Ali", "a grup"), (1, 1, "Can", None), (1, None, "Ece", "A")], "doc int, sig int, name string, group_name string")
    found = projection.flat_rules(rules, parties, signatories)
    assert {(r.doc, r.rule, r.scope, r["mode"], tuple(r.signers), r.blocked, r.unresolved) for r in found.collect()} == {
        (1, 0, "credit", "JOINT", ("rep-1",), False, False), (1, None, "general", "JOINT", ("rep-2",), False, False), (1, 1, "general", None, (), True, False), (1, 2, "general", None, (), False, False), (2, 0, "general", "SOLE", (), False, False),
    }


def test_labels_of_rules_shuffle_lines_once_for_each_input_and_run_no_lambda(spark):
    from signet import display_queries

    plan = display_queries.rule_labels(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 3 and "lambdafunction" not in plan and "collect_list" not in plan
