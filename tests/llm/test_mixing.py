import random

import duckdb
import pytest
from pyspark.sql import functions as F

from signet.llm import common as C
from signet.llm import mixing as M


def plain_targets(sizes):
    """Water level by bisection."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, low, high = sum(sizes.values()), 0.0, 1e12
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(3 * n, level * weight[s]) for s, n in sizes.items()) < total else (low, level)
    return {s: min(3 * n, high * weight[s]) for s, n in sizes.items()}


def make_docs(rng, n):
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 5, 40, 300])), rng.choice(["a", "b", "B", "é", "z", None] + ["hot"] * 5)) for i in range(n)]
    return rows + [(n, None, "a"), (None, "x y", None), (5, "again and again", "a"), (5, "again and again", "a")]


@pytest.mark.parametrize("n", [3, 40, 600])
def test_targets_budget_and_limits(spark, n):
    rows = make_docs(random.Random(n), n)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash"))
    got = M.mix(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want, taken = plain_targets(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-6)
        assert 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    largest = max(r.size for r in got)
    assert all(abs(taken[s] - want[s]) <= 2 * largest + 1 for s in sizes)
    again = M.mix(docs.orderBy(F.rand(3))).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    mixed = M.mixed(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.copies for r in got)


def test_finish_times_are_kept_within_the_budget(spark):
    """Taken copies are exactly those that stand first in the queue."""
    rows = make_docs(random.Random(9), 200)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = M.mix(docs).collect()
    total = sum(r.size for r in got)
    assert sum(r.copies * r.size for r in got) <= total


def test_no_rows_and_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert M.mix(empty).count() == 0 and M.mixed(empty).count() == 0
    rows = M.mix(spark.createDataFrame([(1, "", "a"), (2, None, "b")], "doc_id long, text string, source string")).collect()
    assert {(r.doc_id, r.size, r.target) for r in rows} == {(1, 0, 0.0), (2, 0, 0.0)}


def equal_rows():
    """Sources whose rows have no ids or one id and text, null and '' sources with equal rows, and rows that differ in their text only."""
    rows = [(None, "a b c", "x")] * 900 + [(i, "w " * 50, "y") for i in range(40)] + [(7, "one two", "z")] * 500
    rows += [(5, "same words", None)] * 30 + [(5, "same words", "")] * 30 + [(6, f"t{i} two", "q") for i in range(60)] + [(None, None, "x"), (None, "", "x")]
    return rows


@pytest.mark.parametrize("per", [4096, 16])
def test_equal_rows_are_taken_by_rows(spark, monkeypatch, per):
    monkeypatch.setattr(M, "repeated", lambda df, n, place: C.repeated(df, n, place, per))
    rows = equal_rows()
    docs = spark.createDataFrame([(*r, i % 2) for i, r in enumerate(rows)], "doc_id long, text string, source string, key int").repartition(7)
    got = M.mix(docs.drop("key")).collect()
    assert len(got) == len(rows)
    sizes, taken, largest = {}, {}, {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
        largest[r.source] = max(largest.get(r.source, 0), r.size)
    want = plain_targets(sizes)
    assert want["x"] > 500
    assert all(abs(taken[s] - want[s]) <= 2 * max(largest.values()) + 1 for s in sizes)
    for kept in (docs, docs.drop("key")):
        plan, found = {}, {}
        for r in M.mix(kept).collect():
            plan[r.source] = plan.get(r.source, 0) + r.copies
        for r in M.mixed(kept).groupBy("source").count().collect():
            found[r.source] = r["count"]
        assert found == {s: n for s, n in plan.items() if n}
    one, two = (sorted(map(str, M.mixed(d).collect())) for d in (docs, docs.repartition(3)))
    assert one == two


def test_query_equals_sql_on_equal_rows(spark, tmp_path):
    docs = spark.createDataFrame(equal_rows(), "doc_id long, text string, source string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    found = con.execute(M.SQL)
    df = M.op8_mixing(spark, str(tmp_path))
    assert df.columns == [c[0] for c in found.description]
    shown = lambda rows: sorted(str((*r[:3], round(r[3], 6), r[4])) for r in rows)
    assert shown(df.collect()) == shown(found.fetchall())
