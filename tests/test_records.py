"""What SQL can't express, or the driver's tables don't have: fuzzy ratios, registry files, rosters with gaps."""

import random

import duckdb
from pyspark.sql import functions as F

from signet import decision_queries
from signet.operators import history, matching, roster
from signet.sources import results


def plain_ratio(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return 200 * best[-1][-1] / (len(a) + len(b)) if a or b else 100.0


def test_ratio_and_best_match(spark):
    rng = random.Random(1)
    texts = ["", *("".join(rng.choice("abcdç") for _ in range(rng.randrange(1, 40))) for _ in range(60))]
    for a in texts:
        for b in texts[:20]:
            assert matching.indel_ratio(a, b) == plain_ratio(a, b)
    left = spark.createDataFrame([(i % 3, i, t) for i, t in enumerate(texts)], "k int, left_id int, left_text string")
    right = spark.createDataFrame([(i % 3, i, t) for i, t in enumerate(texts[::-1])], "k int, right_id int, right_text string")
    got = {r.left_id: (r.right_id, r.score) for r in matching.best(left, right, ["k"], 55.0).collect()}
    want = {}
    for i, a in enumerate(texts):
        found = [(-plain_ratio(a, b), j) for j, b in enumerate(texts[::-1]) if i % 3 == j % 3 and plain_ratio(a, b) >= 55]
        if found:
            want[i] = (min(found)[1], -min(found)[0])
    assert got == want and want


def test_numbered_texts_have_the_pairs_of_all_and_build_few(spark):
    rng = random.Random(2)
    words = ["Ali", "veli", "alo", "", "Çiçek", "12", "a1b"]
    texts = [None, "", "7", *(rng.choice(words) + " " + "".join(rng.choice("0123") for _ in range(rng.randrange(6))) + rng.choice(["", "x"]) for _ in range(150))]
    left = spark.createDataFrame([(i % 2, i, t) for i, t in enumerate(texts)], "k int, left_id int, left_text string")
    right = spark.createDataFrame([(i % 2, i, t) for i, t in enumerate(texts[::-1])], "k int, right_id int, right_text string")
    for threshold in (40.0, 70.0, 90.0, 100.0):
        want = sorted(map(tuple, matching.within(left, right, ["k"], threshold).collect()))
        assert sorted(map(tuple, matching.numbered(left, right, ["k"], threshold).collect())) == want and want
    many = spark.range(30_000).select(F.lit(1).alias("k"), F.col("id").alias("left_id"), F.format_string("customer %09d", "id").alias("left_text"))
    other = spark.range(30_000).select(F.lit(1).alias("k"), (F.col("id") * 2).alias("right_id"), F.format_string("supplier %09d", F.col("id") * 2).alias("right_text"))
    got = matching.best(many, other, ["k"], 70.0, matching.numbered)  # 900 million pairs in the block
    assert got.filter("left_id = right_id").count() == got.count() == 15_000


def test_sizes_of_prices_round_as_in_sql(spark, tmp_path):
    prices = [66427.29, 131543.86, 134165.3, 263035.29, 1.0245, 1023.4995]  # times 1000 just below a whole number, at a border of what is shown
    con = duckdb.connect()
    con.execute(f"COPY (SELECT i AS o_orderkey, CAST(i AS BIGINT) AS o_custkey, CAST({prices}[i] AS DOUBLE) AS o_totalprice FROM range(1, {len(prices) + 1}) t(i)) TO '{tmp_path}/orders.parquet'")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    df = decision_queries.form_texts(spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({decision_queries.oracle_sql()['form_texts']}) ORDER BY id").fetchall()
    assert [tuple(r) for r in df.orderBy("id").collect()] == want


def test_inputs_without_a_result(spark):
    keys = spark.createDataFrame([("k",), ("k",), ("m",)], "key string")
    assert [r.key for r in results.missing(keys, keys.filter("key = 'k'")).collect()] == ["m"]


def test_one_registry_row_by_mask_or_name(spark):
    people = [(1, 1, "123***45", "Öz"), (1, 2, "123*45", "x"), (1, 3, None, "OZ "), (1, 4, "999***99", "çift"), (1, 5, "", ""), (1, 6, "77", None), (1, 7, "555***55", "y"), (2, 1, "123***45", "Öz"), (1, 1, "123***45", "öz"), (1, 8, "555***55", "Öz"), (None, 9, "123***45", "Öz")]
    reps = [(1, 10, "123*****45", "oz", "ACTIVE"), (1, 11, None, "Çift", "ACTIVE"), (1, 12, None, "cift", "ACTIVE"), (1, 13, "555**55", "", "REMOVED"), (1, 14, "666**66", "", "ACTIVE"), (1, None, None, "x", "ACTIVE"), (None, 15, "123**45", "oz", "ACTIVE")]
    people = spark.createDataFrame(people, "company int, person int, tckn string, name string")
    reps = spark.createDataFrame(reps, "company int, rep int, tckn string, name string, status string")
    found = roster.unique_active(people, reps)
    assert found.count() == people.count()
    assert {(r.company, r.person, r.rep) for r in found.filter("rep is not null").collect()} == {(1, 1, 10), (1, 2, 10), (1, 3, 10)}


def test_registry_of_equal_names_builds_no_pairs(spark):
    people = spark.range(20_000).select(F.lit(1).alias("company"), F.col("id").alias("person"), F.lit("123***45").alias("tckn"), F.lit("Ad").alias("name"))
    reps = people.select("company", F.col("person").alias("rep"), "tckn", "name", F.lit("ACTIVE").alias("status"))  # 400 million pairs
    assert roster.unique_active(people, reps).filter("rep is null").count() == 20_000


def test_no_rows_and_terminal_states(spark):
    rows = spark.createDataFrame([("t", 1, "REQUESTED"), ("t", 2, "ALLOWED"), ("t", 3, "DENIED"), ("u", 1, None)], "id string, seq int, state string")
    got = {(r.id, r.seq): r.legal for r in history.steps(rows, "id", ["seq"], "state", history.TRANSACTION).collect()}
    assert got == {("t", 1): True, ("t", 2): True, ("t", 3): False, ("u", 1): True}
    people = spark.createDataFrame([(1, 1, None, "a"), (1, 2, "", None), (1, 3, "UNREADABLE", None), (1, 4, "Öz", None)], "doc int, ordinal int, name string, title string")
    merged = roster.merge_roster(people, people.withColumn("title", F.lit("b"))).collect()
    assert len(merged) == 7 and [r.title for r in merged if r.name == "Öz"] == ["b"]
    assert roster.merge_roster(people.limit(0), people.limit(0)).count() == 0
