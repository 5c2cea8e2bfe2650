import numpy as np
import pytest
from pyspark.sql import functions as F

from signet.llm import forest as A

KINDS = "vec_id long, embedding array<float>, rank int"


def brute(rows, shown, every):
    own = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    for q in own:
        if q % every == 0:
            near = sorted((-float((own[q] * v).sum()), i) for i, v in own.items() if i != q)[:shown]
            for rank, (score, i) in enumerate(near, 1):
                yield q, rank, i, -score


def rows_of(rng, n, dim):
    v = rng.standard_normal((n, dim)) * rng.choice([0.5, 1, 3], n)[:, None]
    return [(i, [float(x) for x in row], 0) for i, row in enumerate(v)]


def ask(spark, rows, **how):
    df = spark.createDataFrame(rows, KINDS)
    return A.search(df.select("vec_id", "embedding"), df.filter(F.col("vec_id") % 5 == 0), 20, **how).collect()


def test_leaves_of_a_full_sample_fit_the_driver():
    import tracemalloc

    sample = np.random.default_rng(3).standard_normal((1 << 15, 8))
    forest = A.Forest.of(sample, 6.0, 2.0, 1 << 20, trees=1)  # 12 levels, 4096 leaves
    tracemalloc.start()
    leaves = forest.leaves(sample)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20 and len(np.unique(leaves)) > 4000


@pytest.mark.parametrize(("part_rows", "query_rows"), [(5, 1000), (60, 20), (10_000, 1000)])
def test_all_leaves_give_the_exact_result(spark, part_rows, query_rows):
    rows = rows_of(np.random.default_rng(1), 300, 8)
    same = [0.5] * 8
    rows += [(1000 + i, same, 0) for i in range(90)] + [(5000, None, 0), (5005, [0.0] * 8, 0), (5010, [1.0] * 7 + [float("nan")], 0), (5015, [float("inf")] + [1.0] * 7, 0), (5020, [None] + [1.0] * 7, 0), (None, same, 0), (5025, [], 0)]
    rows += rows[:7]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ask(spark, rows, leaf=8, part_rows=part_rows, query_rows=query_rows, candidates=10**6)}
    want = {(q, rank): (i, s) for q, rank, i, s in brute(rows, 20, 5)}
    assert got.keys() == want.keys()
    for k, (i, s) in want.items():
        assert got[k][0] == i and got[k][1] == pytest.approx(s, rel=1e-12), k


@pytest.mark.parametrize("n", [3000, 9000])
def test_recall_of_a_partial_search(spark, n):
    rows = rows_of(np.random.default_rng(n), n, 24)
    got = ask(spark, rows, candidates=0)
    found = {(r.query_id, r.vec_id) for r in got}
    v = np.array([r[1] for r in rows], np.float32).astype(float)
    queries = np.arange(0, n, 5)
    near = v[queries] @ v.T
    near[np.arange(len(queries)), queries] = -np.inf
    truth = {(int(q), int(i)) for q, best in zip(queries, np.argsort(-near, axis=1)[:, :20], strict=True) for i in best}
    assert len(got) == len(truth) and len(found & truth) / len(truth) >= 0.9


def test_few_and_no_rows(spark):
    assert [(r.query_id, r["rank"], r.vec_id) for r in ask(spark, [(5, [1.0, 2.0], 0), (6, [1.0, 0.0], 0), (7, [9.0], 0)])] == [(5, 1, 6)]
    assert ask(spark, [(5, [1.0], 0)]) == [] and ask(spark, []) == [] and ask(spark, [(5, [0.0], 0)]) == []


def test_ties_of_different_vectors_go_to_the_smaller_ids(spark):
    rng = np.random.default_rng(4)
    bits = rng.permutation([[float(n >> b & 1) for b in range(10)] for n in range(1, 1024) if n.bit_count() in (3, 4)])
    rows = [(i, list(map(float, v)), 0) for i, v in enumerate(bits)]
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ask(spark, rows, leaf=512, candidates=10**6)}
    assert got == {(q, rank): (i, s) for q, rank, i, s in brute(rows, 20, 5)}


def test_the_share_is_measured_and_walks_meet_no_more():
    rng = np.random.default_rng(7)
    plain = rng.standard_normal((4000, 32))
    centres = rng.standard_normal((200, 32))
    grouped = centres[rng.integers(0, 200, 4000)] + 0.1 * rng.standard_normal((4000, 32))
    shares = {}
    for name, points in (("plain", plain), ("grouped", grouped)):
        scale = np.abs(points).max()
        forest = A.Forest.of(points, scale, float(np.linalg.norm(points / scale, axis=1).max()), len(points))
        shares[name] = forest.share(points)
        leaves = forest.leaves(points)
        forest.counts = np.stack([np.bincount(leaves[:, t], minlength=1 << forest.depth) for t in range(A.TREES)])
        asked, want, hit, seen = range(3, 4000, 80), int(shares[name] * len(points)), 0, []
        for q, met in zip(asked, forest.walk(points[list(asked)], want), strict=True):
            near = points @ points[q]
            near[q] = -np.inf
            candidates = np.unique(np.concatenate([np.flatnonzero(leaves[:, t] == leaf) for t, leaf in met]))
            seen.append(len(candidates) / len(points))
            hit += len(set(np.argsort(-near)[:20].tolist()) & set(candidates.tolist()))
        assert hit >= 0.9 * 20 * len(asked) and np.mean(seen) < 0.55
    assert shares["grouped"] < 0.3 * shares["plain"]


def test_huge_and_tiny_components(spark):
    rng = np.random.default_rng(9)
    for factor in (1e200, 1e-200, 1e30):
        rows = [(i, [float(x) * factor for x in v], 0) for i, v in enumerate(rng.standard_normal((60, 6)))]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
        got = A.search(df.select("vec_id", "embedding"), df.filter("vec_id = 0"), 5, leaf=8, candidates=10**6).collect()
        v = np.array([r[1] for r in rows]) / factor
        want = [int(i) for i in np.argsort(-(v @ v[0])) if i][:5]
        if factor == 1e200:  # products leave the range of doubles
            assert got and all(r.score == float("inf") for r in got)
        else:  # or all are zero, and tie
            assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"])] == (want if factor == 1e30 else [1, 2, 3, 4, 5])
