import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from signet.llm import infill as I

TEXTS = ["one line", "a\nb\nc", "a\nb\n", "\n\n\n", "\n", "", None, "x<P>y\nz", "ends in <S", "a <M", "<\n<\n<P\n>", "é\U0001f600\nñ\r\n z", "long " * 40_000, "l\n" * 50_000, "tab\tand  spaces \n x"]


def plain(i, text, seed="7", rate=100, spm=50, pattern=r"[^\n]*\n|[^\n]+"):
    text = text or ""
    units = re.findall(pattern, text)
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def make(n):
    rng = random.Random(n)
    rows = [(i, rng.choice(TEXTS[:12]) if i % 2 else "\n".join("w" * rng.randrange(5) for _ in range(rng.randrange(9)))) for i in range(n)]
    return rows + [(None, t) for t in TEXTS] + [(5, "same\ntext"), (5, "same\ntext")] + [(10**15 + i, t) for i, t in enumerate(TEXTS)]


@pytest.mark.parametrize("settings, pattern", [
    (I.Settings(), r"[^\n]*\n|[^\n]+"), (I.Settings(seed="other", rate=40, spm=80), r"[^\n]*\n|[^\n]+"), (I.Settings(unit="word"), r"[^ \t-\r]*[ \t-\r]+|[^ \t-\r]+"),
])
def test_equals_plain_loop_and_comes_back(spark, settings, pattern):
    rows = make(300)
    docs = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, output string, n int")
    found = I.infill(docs, settings).withColumn("back", I.restored(settings=settings))
    assert found.columns == ["doc_id", "text", *I.ADDED, "back"]
    got = [tuple(r) for r in found.collect()]
    assert [r[-1] for r in got] == [r[1] or "" for r in got]
    key = lambda r: (str(r[0]), str(r[1]))
    want = sorted(((i, t, *plain(i, t, settings.seed, settings.rate, settings.spm, pattern)) for i, t in rows), key=key)
    assert sorted((r[:-1] for r in got), key=key) == want
    assert {r[3] for r in want} == {"plain", "psm", "spm"}


def test_query_equals_sql_and_digests(spark, tmp_path):
    rows = make(200)
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.register("documents", spark.read.parquet(f"{tmp_path}/documents.parquet").toArrow())
    found = con.execute(I.SQL)
    names = [c[0] for c in found.description]
    df = I.op13_infill(spark, str(tmp_path))
    assert df.columns == names
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, found.fetchall()))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = [(i, *(made := plain(i, t))[:4], sha(made[4]), sha(t or "")) for i, t in rows]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))


def test_marks_that_overlap_are_refused():
    for marks in (("<P>", "<P>", "<M>"), ("aba", "x", "y"), ("ab", "bc", "z"), ("", "x", "y"), ("a", "xay", "z")):
        with pytest.raises(ValueError):
            I.Settings(marks=marks)


def test_no_rows(spark):
    assert I.infill(spark.createDataFrame([], "doc_id long, text string").withColumn("extra", F.lit(1))).count() == 0
