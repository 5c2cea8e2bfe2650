"""Transactions whose inputs have holes: no single null turns a refusal into a consent."""

import datetime
import itertools

import pytest
from pyspark.sql import functions as F

from signet import decision_queries
from signet.functions import text as T
from signet.operators import authority as A

DAY = datetime.date(2026, 1, 5)
SCHEMAS = {
    "transactions": "txn_id long, company long, subject string, amount long, initiator string, day date",
    "authorities": "company long, status string, valid_until date",
    "persons": "company long, person string, source_id string, mode string, max_amount long",
    "rules": "company long, scope string, threshold long, mode string, blocked boolean, ordinal int, signers array<string>",
    "companies": "company long, status string",
    "reps": "company long, person string, status string",
}
#: Company 1 acts alone, company 2 by two signatures; columns whose null means "open" or "no".
ALONE = {
    "transactions": (1, 1, "general", 100, "a", DAY),
    "authorities": (1, "ACTIVE", datetime.date(2027, 1, 1)),
    "persons": (1, "a", "s1", "SOLE", 500),
    "rules": (1, "general", 1000, "SOLE", False, 0, ["s1"]),
    "companies": (1, "ACTIVE"),
    "reps": (1, "a", "ACTIVE"),
}
OPEN = {("authorities", "valid_until"), ("persons", "max_amount"), ("persons", "source_id"), ("rules", "threshold"), ("rules", "blocked"), ("rules", "ordinal"), ("rules", "signers"), ("transactions", "txn_id")}


def decided(spark, tables):
    frames = [spark.createDataFrame(tables[n], SCHEMAS[n]) for n in SCHEMAS]
    return sorted(map(tuple, A.evaluate(*frames).collect()), key=str)


def test_every_null_denies_or_is_open(spark):
    """One company for each column of each table, that column null; all in one batch."""
    tables = {n: [] for n in SCHEMAS}
    want, key = {}, 10
    for hole in [None, *((n, f.split()[0]) for n in SCHEMAS for f in SCHEMAS[n].split(", "))]:
        key += 1
        for n, row in ALONE.items():
            names = [f.split()[0] for f in SCHEMAS[n].split(", ")]
            made = [key if c in ("company", "txn_id") else x for c, x in zip(names, row)]
            tables[n].append(tuple(None if hole == (n, c) else x for c, x in zip(names, made)))
        want[None if hole == ("transactions", "txn_id") else key] = "ALLOWED" if hole is None or hole in OPEN else "DENIED"
    got = {r[0]: r[1] for r in decided(spark, tables)}
    assert got == want


@pytest.mark.parametrize("signers, mine, other, verdict", [
    (["s1", "s2"], "s1", "s2", "PENDING_COSIGN"), ([None, "s2"], "s1", "s2", "DENIED"), (None, "s1", "s2", "DENIED"),
    (["s1", None], "s1", None, "DENIED"), (["s1", "s2"], None, "s2", "DENIED"), ([], "s1", "s2", "DENIED"),
])
def test_null_signers_are_nobody(spark, signers, mine, other, verdict):
    tables = {n: [r] for n, r in ALONE.items()}
    tables["persons"] = [(1, "a", mine, "JOINT", None), (1, "b", other, "JOINT", None)]
    tables["rules"] = [(1, "general", None, "JOINT", None, 0, signers)]
    tables["reps"].append((1, "b", "ACTIVE"))
    assert [r[1] for r in decided(spark, tables)] == [verdict]


def test_no_rows(spark):
    for empty in itertools.chain(["none"], SCHEMAS):
        tables = {n: [] if empty in ("none", n) else [r] for n, r in ALONE.items()}
        assert [r[1] for r in decided(spark, tables)] in ([], ["DENIED"])


def test_instants_are_utc_in_any_session(spark):
    at = spark.sql("select timestamp_seconds(1767225600) as at")
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in ("UTC", "Europe/Istanbul", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", other)
            assert at.select(T.instant(at.at)).first()[0] == "2026-01-01T00:00:00Z"
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_codes_are_drawn_again_where_they_collide(spark, monkeypatch):
    plain = {r.id: r.code for r in A.with_codes(spark.range(200), "id").collect()}
    assert plain == {r.id: r.code for r in spark.range(200).select("id", T.authorization_code(F.col("id").cast("string")).alias("code")).collect()}
    monkeypatch.setattr(T, "CODE_LETTERS", "AB" * 16)  # 256 codes only
    first = {r.id: r.code for r in spark.range(120).select("id", T.authorization_code(F.col("id").cast("string")).alias("code")).collect()}
    got = {r.id: r.code for r in A.with_codes(spark.range(120).repartition(5), "id").collect()}
    assert len(set(first.values())) < 120 == len(set(got.values()))
    assert got == {r.id: r.code for r in A.with_codes(spark.range(120), "id").collect()}
    with pytest.raises(RuntimeError):
        A.with_codes(spark.range(300), "id", tries=3)


def test_codes_of_the_query_are_drawn_again(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(T, "CODE_LETTERS", "ABCD" * 8)  # 65 536 codes for 1091 rows
    spark.range(1200).select(F.col("id").alias("o_orderkey"), F.col("id").alias("o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    assert [tuple(r) for r in decision_queries.authorization_codes(spark, str(tmp_path)).select("width", "n", "codes").collect()] == [(12, 1, 1090)]
