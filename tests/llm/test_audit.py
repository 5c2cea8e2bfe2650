import hashlib
import random
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from signet.llm import audit as A

SCHEMA = "doc_id long, text string, lang string, source string, part string, mask string, digest string"


def make(rng, n):
    """Sources, copies, labels and texts near each limit; a third of the rows share one text."""
    texts = ["w " * 199, "w " * 200, " ".join(f"x{i}" for i in range(200)), " ".join(f"x{i % 100}" for i in range(200)), " ".join(f"x{i % 101}" for i in range(202)), "A" * 2 + "b" * 98, "A" * 3 + "b" * 97, "a#b", "", None, "ÄÖ é b", "x y " * 300 + "|"]
    rows = [(rng.randrange(2 * n), "copied" if i % 3 == 0 else rng.choice(texts), "en", rng.choice(["a", "b", None, "", "hot", "hot", "hot"]), "p", "m", "d") for i in range(n)]
    rows += [(None, "copied", "en", "a", "p", "m", "d"), (None, "copied", "en", "a", "p", "m", "d"), (7, "twice", "en", "a", "p", "m", "d"), (7, "twice", "en", "a", "p", "m", "d"), (8, "twice", "en", "b", "p", "m", "d")]
    labels = [(rng.randrange(2 * n), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(n)]
    return rows, labels + [(None, 1, 1), (8, 1, 1), (8, 0, None)]


def plain(rows, labels):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    found = {}
    for i, t, _, source, *_ in rows:
        text = t or ""
        words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\v", " ").replace("\f", " ").split(" ") if w]
        fails = {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text),
            "D": any(c in "#$%&*|" for c in text), "E": i is not None and least[text] < i,
        }
        good, toxic = (i is not None and any(l[0] == i and l[at] == 1 for l in labels) for at in (1, 2))
        found.setdefault(source or "", []).append(({k for k, v in fails.items() if v}, good, toxic))
    out, removed = [], {}
    for part, docs in found.items():
        for order in map("".join, permutations("ABCDE")):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d in left if f in d[0]]
                left = [d for d in left if f not in d[0]]
                fails = [d for d in docs if f in d[0]]
                removed[part, f] = removed.get((part, f), 0) + len(gone)
                out.append([part, order, step, len(left), len(gone), len(fails) - len(gone), sum(d[0] == {f} for d in docs), sum(d[1] for d in gone), sum(d[2] for d in gone)])
    return sorted((*r, removed[r[0], r[1][r[2] - 1]]) for r in out)


@pytest.mark.parametrize("n, parts", [(400, A.PARTS), (60, 1)])
def test_equals_filters_applied_one_by_one(spark, monkeypatch, n, parts):
    monkeypatch.setattr(A, "PARTS", parts)
    rows, labels = make(random.Random(n), n)
    docs, marks = spark.createDataFrame(rows, SCHEMA).repartition(5), spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("good", F.lit("clash"))
    got = A.audit(docs, marks)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert sorted(map(tuple, got.collect())) == plain(rows, labels)


def test_equals_sql(spark, tmp_path):
    rows, labels = make(random.Random(5), 200)
    docs, marks = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.register(name, spark.read.parquet(f"{tmp_path}/{name}.parquet").toArrow())
    assert sorted(map(tuple, A.op11_audit(spark, str(tmp_path)).collect())) == sorted(con.execute(A.SQL).fetchall())


def test_table_of_first_failures():
    first = A.first_failures(5)
    assert first.shape == (32, 120)
    for order, p in enumerate(permutations(range(5))):
        for mask in range(32):
            assert first[mask, order] == next((s for s, f in enumerate(p) if mask >> f & 1), 5)


def test_frequent_and_rare_copies_are_marked_alike(spark):
    rows = [(i, "hot" if i % 3 else f"pair{i // 6}") for i in range(3000)]
    df = spark.createDataFrame([(i, hashlib.sha256(t.encode()).digest(), 3) for i, t in rows], "doc_id long, digest binary, mask int")
    least = {}
    for i, t in rows:
        least[t] = min(i, least.get(t, i))
    for heavy in (1, 1024, 10**9):
        got = {r.doc_id: r["mask"] for r in A.with_copies(df, 4, heavy).collect()}
        assert got == {i: 3 | (least[t] < i) << 4 for i, t in rows}


def test_no_rows_and_no_labels(spark):
    docs, labels = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert A.audit(docs, labels).count() == 0
    one = spark.createDataFrame([(1, "a b", "en", "s", "", "", "")], SCHEMA)
    rows = A.audit(one, labels).collect()
    assert len(rows) == 600 and all(r.kept + r.removed in (0, 1) and r.good_lost == 0 for r in rows)
