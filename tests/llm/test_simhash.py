import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from signet.llm import simhash as S
from signet.llm.components import components


def plain_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, edges):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def test_fingerprint_is_that_of_the_definition():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 40, 400):
        text = "".join(rng.choice(["Ab", "é", "ÀX", "q"]) + rng.choice([" ", "\t", "\n\x0b "]) for _ in range(n))
        assert S.simhash(text) == plain_fingerprint(text)
    assert S.simhash(None) == 0


@pytest.mark.parametrize("node_rows", [20_000, 5])
def test_trie_join_finds_every_link(spark, node_rows):
    rng = random.Random(node_rows)
    marks = {rng.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1}
    for base in list(marks)[:40]:
        at = base
        for _ in range(6):
            at ^= sum(1 << rng.randrange(64) for _ in range(rng.choice([1, 2, 3])))
            marks.add(at & (1 << 64) - 1)
    marks |= {0b1011 << 50 | 1 << i for i in range(64)} | {0b1011 << 50 | 1 << i | 1 << (i * 7) % 64 for i in range(64)}
    near = [(a, b) for a, b in combinations(sorted(marks), 2) if (a ^ b).bit_count() <= 2]
    truth = plain_components(marks, near)
    found = S.links(spark.createDataFrame([(signed(m),) for m in marks], "fp long"), 2, node_rows).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1) for r in found)
    mask = (1 << 64) - 1
    assert plain_components(marks, [(r.a & mask, r.b & mask) for r in found]) == truth


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 140)] + [(500, 500 + i) for i in range(1, 60)] + [(7, 7), (9, 8), (8, 9)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(80)]
    nodes = {n for e in edges for n in e if e[0] != e[1]}
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == plain_components(nodes, [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def make_docs():
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 5, 80, 300]))) for _ in range(60)]
    near = [t.replace("w1", "W1") for t in base] + [t + " tail" for t in base[:30]]
    texts = [None, "", " \n", *base, *near]
    return [(i, t, "x") for i, t in enumerate(texts)]


def test_query_equals_brute_force(spark):
    rows = make_docs()
    marks = {i: plain_fingerprint(t) for i, t, _ in rows}
    truth = plain_components([i for i, *_ in rows], [(a, b) for a, b in combinations(marks, 2) if (marks[a] ^ marks[b]).bit_count() <= 2])
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in S.near_duplicates(docs).collect()}
    assert got == {i: (marks[i], truth[i]) for i in marks}


def test_repeated_and_missing_ids_and_no_rows(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "lone words of no id at all"), (None, "lone words of no id at all"), (2, "other text, told apart"), (2, "A b c d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert S.near_duplicates(docs).count() == len(rows)
    got = Counter((r.doc_id, r.component_id) for r in S.near_duplicates(docs).collect())
    assert got == {(1, 1): 2, (None, 1): 1, (2, 1): 1, (None, None): 2, (2, 2): 1}
    assert S.near_duplicates(docs.limit(0)).count() == 0


def test_trie_memory_is_folded(spark):
    keys = np.sort(np.array([signed(1 << i | 1 << j) for i in range(40) for j in range(i)], np.int64).view(np.uint64))
    forest = S.Forest({"fp": np.arange(len(keys))})
    S.trie_links(keys, np.empty((0, 5), np.int64), np.array([[0, len(keys)]]), 0, 2, forest)
    assert len(set(forest.find(np.arange(len(keys))).tolist())) == 1
    assert spark.range(1).select(F.lit(1)).count() == 1
