import random
from itertools import combinations

import numpy as np
import pytest

from signet.llm import similar as S


def plain(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(a, b):
    return len(a & b) >= 0.8 * len(a | b)


def leads(rows):
    """Least id of each row's component, over all pairs."""
    root, marks = {i: i for i, _ in rows}, {i: plain(t) for i, t in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(marks, 2):
        if near(marks[a], marks[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def corpus(seed=2):
    """Texts and edited copies, many of them near the threshold."""
    rng, words = random.Random(seed), [f"w{i}" for i in range(5000)]
    texts = [None, "", " \n", "one two", "One  two", "one two three"]
    for _ in range(120):
        base = [rng.choice(words) for _ in range(rng.choice([60, 200, 900]))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 1, 4])):
            other = list(base)
            for _ in range(rng.randrange(len(base) // 20)):
                other[rng.randrange(len(other))] = rng.choice(words)
            texts.append(" ".join(other))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("node_rows", "cell_bytes"), [(20_000, 16 << 20), (30, 16 << 20), (20_000, 9000), (5, 3000)])
def test_groups_equal_brute_force(spark, node_rows, cell_bytes):
    rows = corpus()
    truth = leads(rows)
    got = {r.doc_id: r.lead_id for r in S.groups(spark.createDataFrame(rows, "doc_id long, text string"), node_rows=node_rows, cell_bytes=cell_bytes).collect()}
    assert got == truth and len(set(truth.values())) < len(rows) - 50


def family(rng, n, step=1, length=60, vocabulary=3000):
    """Copies of one text with one word replaced in each: all are near each other, some are similar."""
    base = [f"w{rng.randrange(vocabulary)}" for _ in range(length)]
    return [" ".join([*base[:k], f"x{i}", *base[k + 1 :]]) for i in range(n) for k in [rng.randrange(6, length - 6, step)]]


@pytest.mark.parametrize("cell_bytes", [16 << 20, 40_000])
def test_no_link_hides_behind_near_texts_that_are_not_similar(spark, cell_bytes):
    rows = list(enumerate(family(random.Random(7), 400, 3)))
    truth = leads(rows)
    assert 10 < len(set(truth.values())) < 30
    got = {r.doc_id: r.lead_id for r in S.groups(spark.createDataFrame(rows, "doc_id long, text string"), node_rows=150, cell_bytes=cell_bytes).collect()}
    assert got == truth


def test_edges_of_many_near_copies_stay_few(spark):
    rows = list(enumerate(family(random.Random(8), 5000)))
    texts = spark.createDataFrame(rows, "fp long, text string")
    marks = texts.mapInArrow(lambda batches: S._sketched(batches, 5), ", ".join(f"{c} long" for c in ("fp", *S.SKETCH, *S.MARKS)))
    cells = S.F.array(*(S.F.shiftleft(S.F.col(c), 3).bitwiseOR(S.F.lit(i)) for i, c in enumerate(S.MARKS)))
    near = S.joined(marks.select(S.F.explode(cells).alias("cell"), "fp", S.F.lit(1).alias("weight")), marks.select("fp", *S.SKETCH), 1000, S._near)
    assert near.count() <= 2 * S.BANDS * len(rows)
    cell = texts.select(S.F.lit(1).cast("long").alias("cell"), "fp", S.F.lit(500).alias("weight"))
    found = S.joined(cell, texts, 400_000, lambda batches: S._similar(batches, 5, 0.8))
    assert found.count() <= 5 * len(rows)


def test_a_group_of_many_near_copies(spark):
    rng = random.Random(9)
    base = [f"w{rng.randrange(3000)}" for _ in range(400)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k:])) for i in range(800) for k in [rng.randrange(400)]] + [(5000 + i, f"{i} is a text that stands alone among all of them {i} {i}") for i in range(20)]
    kept = S.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(r.doc_id for r in kept) == [0, *range(5000, 5020)]


def test_sketches_estimate_similarity():
    rng = random.Random(4)
    for cut in (30, 100, 300):
        a = [f"w{rng.randrange(9000)}" for _ in range(900)]
        b = a[cut:] + [f"v{i}" for i in range(cut)]
        bits = np.bitwise_count((S.sketch(" ".join(a)) ^ S.sketch(" ".join(b)))[:8].view(np.uint64)).sum()
        assert abs(1 - bits / 256 - S.jaccard(" ".join(a), " ".join(b))) < 0.12
    long = " ".join(f"w{i % 70_000}" for i in range(200_000))
    assert (S.sketch(long) == S.sketch(long + " w0"))[:8].mean() >= 0.7


def test_repeated_and_missing_ids_clashing_columns_and_no_rows(spark):
    rows = [(1, "a b c d e f", 0), (1, "a b c d e f", 0), (None, "A b c d e f", 1), (None, "lone words of no id at all", 2), (None, "lone words of no id at all", 2), (2, "other text, told apart", 3), (2, "a  b c d e f", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in kept.collect()) == [(0, "lone words of no id at all"), (1, "a b c d e f"), (2, "other text, told apart")]
    assert S.keep_one(docs.limit(0)).count() == 0


def test_texts_that_share_a_hash_are_told_apart(spark, monkeypatch):
    """With hashes of six bits all of 300 texts share one; each stays, and so do the groups."""
    rows = [(i, f"text number {i} of its own words w{i} v{i} u{i} t{i}", 0) for i in range(300)] + [(1000 + i, f"text number {i} of its own words w{i} v{i} u{i} t{i}", 1) for i in range(0, 300, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long")
    assert S.colliding(docs) is None
    for few in (S.FEW, 3):
        monkeypatch.setattr(S, "FEW", few)
        assert S.colliding(docs, 6).count() > 50
        assert sorted(r.doc_id for r in S.keep_one(docs, bits=6).collect()) == list(range(300))
