import math
import random
import zlib

import numpy as np
import pytest
import zstandard

from signet.llm import quality as Q

GOOD = "the measured result of this careful study shows that most readers agree with its conclusion".split()
BAD = "buy cheap pills now click here win free $$$ !!! casino bonus xxx offer limited".split()


def make(rng, n):
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.6
        words = [rng.choice(GOOD if rng.random() < (0.85 if good else 0.15) else BAD) for _ in range(rng.choice([8, 40, 200]))]
        rows.append((i, " ".join(words), "src", "en"))
        labels.append((i, int(good)))
    return rows, labels


def auc(score, y):
    rank = np.argsort(np.argsort(score)) + 1
    p = y.sum()
    return (rank[y == 1].sum() - p * (p + 1) / 2) / (p * (len(y) - p))


def test_held_out_accuracy_and_range(spark):
    rows, labels = make(random.Random(2), 1500)
    rows += [(9001, None, "src", "en"), (9002, "", "src", "en"), (9003, "x" * 300_000, "src", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, score string")
    marks = spark.createDataFrame(labels + [(3, None), (None, 1)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in Q.score(docs.drop("source"), Q.learned(docs, marks)).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    test = [(got[i], y) for i, y in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    score, y = map(np.array, zip(*test, strict=True))
    assert auc(score, y) > 0.95
    assert abs(score.mean() - y.mean()) < 0.1
    kept = Q.keep_good(docs, marks)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, s in got.items() if s >= Q.ACCEPT)


def test_held_out_labels_are_not_used(spark):
    rows, labels = make(random.Random(4), 300)
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, y in labels]
    a, b = (Q.score(docs, Q.learned(docs, spark.createDataFrame(x, "doc_id long, quality int"))).collect() for x in (labels, flipped))
    assert sorted(a) == sorted(b)


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert Q.score(docs, Q.learned(docs, none)).first().score == 0.5
    assert Q.score(docs.limit(0), Q.learned(docs.limit(0), none)).count() == 0
    one = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    assert Q.score(docs, Q.learned(docs, one)).first().score > 0.99


def test_scores_are_those_of_both_dictionaries_by_plain_means(spark):
    rows, labels = make(random.Random(6), 500)
    rows += [(700, "the study " * 900, "src", "en"), (701, "é日 \U0001f600" * 50, "src", "en"), (702, None, "src", "en"), (0, rows[0][1], "src", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    model = Q.learned(docs, spark.createDataFrame(labels, "doc_id long, quality int"))
    train = [i for i, _ in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    first = {label: [i for i, y in labels if y == label and i in set(train)] for label in (1, 0)}
    assert min(map(len, first.values())) > 50 and model.good != model.bad
    sizes = {}
    for name, dictionary in (("good", model.good), ("bad", model.bad)):
        squeeze = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
        for i, text, *_ in rows:
            data = (text or "").encode()
            sizes[name, i] = sum(len(squeeze.compress(data[k : k + 2048])) for k in range(0, len(data), 2048))
    got = {r.doc_id: r.score for r in Q.score(docs, model).collect()}
    for i, text, *_ in rows:
        n = len((text or "").encode())
        difference, ratio, length = ((sizes["bad", i] - sizes["good", i]) / n, min(sizes["bad", i], sizes["good", i]) / n, math.log(1 + n)) if n else (0, 1, 0)
        row = [difference, difference * length, difference * abs(difference), ratio, ratio**2, length, ratio * length]
        x = model.weights[0] + sum(w * (v - m) / s for w, v, m, s in zip(model.weights[1:], row, model.mean, model.spread, strict=True))
        assert got[i] == pytest.approx(1 / (1 + math.exp(-x)), abs=1e-9)


def test_the_sample_is_bounded_by_bytes_and_long_texts_count(spark):
    rows = [(i, ("good words here " if i % 2 else "bad spam now ") * (4000 if i < 4 else 20), "s", "en") for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, label int")
    small, whole = Q.fit(docs, marks, fit_bytes=3000), Q.fit(docs, marks)
    assert len(small.good) <= 3000 and b"good words" in small.good and b"bad spam" in whole.bad
    assert {r.doc_id: r.score > 0.5 for r in Q.score(docs, whole).collect() if r.doc_id > 3} == {i: bool(i % 2) for i in range(4, 80)}
