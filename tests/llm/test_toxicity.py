import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from signet.llm import toxicity as X

CALM = [a + b for a in ("ser", "mel", "tor", "vin", "lau", "der", "pol") for b in ("an", "io", "est", "ul", "ment", "ity", "ane")]
HARSH = ["vilegrub", "vilegrubs", "vilegrubbed", "snarkoid", "snarkoids"]


def make(rng, n):
    rows, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        words = [rng.choice(CALM) for _ in range(rng.choice([20, 60, 300]))]
        if toxic:
            for _ in range(1 + len(words) // 20):
                words[rng.randrange(len(words))] = rng.choice(HARSH).title()
        rows.append((i, " ".join(words), "s", "en"))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_calibration_and_evidence(spark):
    rows, labels = make(random.Random(3), 1500)
    rows += [(9001, None, "s", "en"), (9002, "", "s", "en"), (9003, "calm " * 200_000 + "snarkoids", "s", "en"), (9004, "x" * 500_000, "s", "en"), (None, "melan torio", "s", "en"), (9005, "vilegrub vilegrub melan", "s", "en"), (9006, "vilegrub vilegrub melan", "s", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, terms string").repartition(6)
    marks = spark.createDataFrame(labels + [(3, None), (None, 1)], "doc_id long, toxic int")
    model = X.learned(docs, marks)
    found = X.score(docs, model)
    assert found.columns == ["doc_id", "text", "score", "neighbours", "terms"]
    got = {r.doc_id: r for r in found.collect()}
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    test = [(got[i].score, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    score, y = map(np.array, zip(*test, strict=True))
    assert ((score >= X.ACCEPT) == y).mean() > 0.97
    assert abs(score.mean() - y.mean()) < 0.03
    assert got[9001].score == got[9002].score == got[9004].score < 0.1
    assert got[9005].score == got[9006].score
    label = dict(labels)
    for r in got.values():
        near = [(-n.similarity, n.doc_id) for n in r.neighbours]
        assert near == sorted(near) and len(near) <= X.NEAREST
        assert all(n.label == label[n.doc_id] and zlib.crc32(str(n.doc_id).encode()) % 3 != 1 for n in r.neighbours)
    assert any("vile" in t or "snark" in t for t in got[9005].terms)


def test_labels_held_out_are_not_used(spark):
    rows, labels = make(random.Random(4), 400)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, y in labels]
    a, b = (X.score(docs, X.learned(docs, spark.createDataFrame(x, "doc_id long, toxic int"))).select("doc_id", "score").collect() for x in (labels, flipped))
    assert sorted(a) == sorted(b)


@pytest.mark.parametrize("n, terms, same", [(1, 5, False), (63, 12, False), (700, 40, False), (500, 6, True)])
def test_block_max_search_equals_brute_force(n, terms, same):
    rng = np.random.default_rng(n)
    vectors = []
    for _ in range(n):
        own = np.sort(rng.choice(terms, rng.integers(0, min(terms, 6)), replace=False))
        w = np.ones(len(own)) if same else rng.random(len(own)) + 0.1  # alike vectors make ties
        vectors.append((own, w / np.sqrt((w**2).sum()) if len(own) else w))
    ids = rng.permutation(10 * n)[:n]
    index = X.Index(vectors, ids, np.zeros(n, np.int64), terms)
    dense = np.zeros((n, terms))
    for i, (t, w) in enumerate(vectors):
        dense[i, t] = w
    for _ in range(60):
        own = np.sort(rng.choice(terms, rng.integers(1, min(terms, 7)), replace=False))
        q = rng.random(len(own)) + 0.1
        q /= np.sqrt((q**2).sum())
        full = np.zeros(terms)
        full[own] = q
        near = (dense @ full).round(9)
        want = sorted((-s, i) for s, i in zip(near, ids) if s > 0)[: X.NEAREST]
        places, scores = index.nearest(own, q, X.NEAREST)
        assert [(-s, index.ids[p]) for p, s in zip(places, scores)] == want


def test_blocks_that_cannot_win_are_left_out(monkeypatch):
    """With alike examples side by side, a query looks at few of the blocks."""
    n, seen = 6400, []
    index = X.Index([(np.array([i % 100]), np.array([1.0])) for i in range(n)], np.arange(n), np.zeros(n, np.int64), 100)
    spans = X._spans
    monkeypatch.setattr(X, "_spans", lambda a, b: seen.append(len(found := spans(a, b))) or found)
    index.nearest(np.array([7]), np.array([1.0]), 15)
    assert sum(seen) < n / 20


def test_terms_counts_and_frequencies(spark):
    assert X.forms("idiots") == ["idiots", "idi*", "idio*", "idiot*"]
    assert X.forms("ab") == ["ab"] and X.forms("y" * 70) == ["yyy*", "yyyy*", "yyyyy*", "yyyyyy*"]
    number = {"ab": 0, "abc*": 1, "abcd": 2}
    terms, counts, words = X.Counted(number).of("Ab ABCD, abcd! abcde ab")
    assert (terms.tolist(), counts.tolist(), words) == ([0, 1, 2], [2, 3, 2], 5)
    texts = ["ab ab", "abcd", "AB abcdef", None, "", "none"]
    docs = spark.createDataFrame([(t,) for t in texts * 3], "text string").repartition(4)
    n, every = X.document_frequencies(docs, number)
    assert (n.tolist(), every) == ([6, 6, 3], 18)


def test_g2_against_a_plain_sum(spark):
    for a, b, na, nb in ((0, 5, 10, 20), (10, 0, 10, 20), (3, 4, 10, 20), (10, 20, 10, 20), (5, 10, 10, 20)):
        plain = 0.0
        for seen, n in ((a, na), (b, nb)):
            for x, p in ((seen, (a + b) / (na + nb)), (n - seen, 1 - (a + b) / (na + nb))):
                plain += 2 * x * math.log(x / (n * p)) if x else 0
        got = spark.range(1).select(X._g2(F.lit(a), F.lit(b), na, nb).alias("g")).first().g
        assert got == pytest.approx(plain, abs=1e-9)


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in X.score(docs, X.learned(docs, none)).collect()} == {0.5}
    assert X.score(docs.limit(0), X.learned(docs.limit(0), none)).count() == 0
    one = spark.createDataFrame([(1, 0), (2, 0)], "doc_id long, toxic int")
    assert all(r.score < 1e-6 for r in X.score(docs, X.learned(docs, one)).collect())
    both = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    few = spark.createDataFrame([(i, "same text") for i in range(12)], "doc_id long, text string")
    assert len({r.score for r in X.score(few, X.learned(few, both)).collect()}) == 1
