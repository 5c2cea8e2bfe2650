import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from signet.llm import suffix_tree as S


def tokens(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^ \t-\r]+", text or "")] + [None]


def out(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 7 == 2


def brute_tree(texts, depth, p_min, divergence):
    """Counts of contexts by plain loops; the contexts that are kept."""
    counts, total = defaultdict(Counter), 0
    for t in texts:
        line = bytes(depth) + " ".join(tokens(t)[:-1]).encode() + b"\0"
        for i in range(depth, len(line)):
            total += 1
            for d in range(depth + 1):
                counts[line[i - d : i]][line[i]] += 1
    kept = {b""}
    for c, nexts in counts.items():
        n = sum(nexts.values())
        if c and n >= max(2, p_min * total):
            short = counts[c[1:]]
            m = sum(short.values())
            if 2 * sum(k * math.log(k / n / (short[s] / m)) for s, k in nexts.items()) / len(nexts) > divergence:
                kept.add(c)
    return counts, kept


def brute_log10(counts, kept, context, symbol):
    while context not in kept:
        context = context[1:]
    nexts = counts[context]
    n, kinds = sum(nexts.values()), len(nexts)
    shorter = 10 ** brute_log10(counts, kept, context[1:], symbol) if context else 1 / 256
    return math.log10((nexts[symbol] + kinds * shorter) / (n + kinds))


def make(rng, n):
    parts = ["the ", "And ", "th", "er", "an ", "é", "日本 ", "\n", "x\t"]
    return [(i, "".join(rng.choice(parts) for _ in range(rng.choice([0, 1, 5, 60])))) for i in range(n)]


@pytest.fixture(scope="module")
def case(spark):
    rows = make(random.Random(5), 120) + [(500, None), (501, ""), (None, "the an"), (3, "the er again"), (3, "the er again"), (502, "q" * 5000 + " \0z")]
    docs = spark.createDataFrame([(*r, 0.0) for r in rows], "doc_id long, text string, score double")
    train = [t for i, t in rows if not out(i)]
    tree = S.fit(spark.createDataFrame([(t,) for t in train], "text string"), 3, 1e-3, 3.0)
    return rows, docs, train, tree, brute_tree([(t or "").replace("\0", "\1") for t in train], 3, 1e-3, 3.0)


def test_retained_contexts_and_probabilities(case):
    *_, tree, (counts, kept) = case
    got = {int(c).to_bytes(d, "little") for d, level in enumerate(tree.contexts, 1) for c in level}
    assert got == kept - {b""} and len(got) > 20
    rng = random.Random(1)
    for context in [b"\0\0\0", b"the", b"zzz", *(bytes(rng.choice(b"the anr\0") for _ in range(3)) for _ in range(20))]:
        found = np.array([int.from_bytes(context[::-1] + bytes([s]), "big") for s in range(256)], np.uint64)
        logs = tree.log10(found)
        assert sum(10**logs) == pytest.approx(1, abs=1e-9)
        assert logs == pytest.approx([brute_log10(counts, kept, context, s) for s in range(256)], abs=1e-9)


def test_scores_equal_brute_force(case):
    rows, docs, train, tree, (counts, kept) = case
    got = sorted(S.score(docs, tree).collect(), key=str)
    c = Counter(w for t in train for w in tokens(t))
    n, v = sum(c.values()), len(c)
    want = []
    for i, t in rows:
        found, line = tokens(t), bytes(3) + " ".join(tokens(t)[:-1]).replace("\0", "\1").encode() + b"\0"
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in found)
        score = sum(brute_log10(counts, kept, line[k - 3 : k], line[k]) for k in range(3, len(line)))
        want.append((i, out(i), len(found), sum(c[w] > 0 for w in found), n, base, score))
    assert len(got) == len(want)
    order = lambda r: (r[0] is None, r[0] or 0)
    for a, b in zip(sorted(map(tuple, got), key=order), sorted(want, key=order), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_cut_texts_score_alike(case, monkeypatch):
    *_, tree, _ = case
    texts = [S.symbols(S.words("the er " * k + "an")) for k in (0, 1, 30, 200)]
    whole = tree.scores(texts)
    monkeypatch.setattr(S, "SCORED", 50)
    assert tree.scores(texts) == pytest.approx(whole, rel=1e-12)


def test_nothing_to_learn_or_score(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    tree = S.fit(none)
    assert S.score(none, tree).count() == 0
    only = next(i for i in range(99) if out(i))
    row = S.score(spark.createDataFrame([(only, "ab")], "doc_id long, text string"), tree).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (2, 0, 0, 0.0) and row.score == pytest.approx(-3 * math.log10(256))


def test_rare_contexts_are_kept_whatever_the_size_of_the_corpus(spark):
    # 'qe' occurs twice; under a floor by share of all symbols it goes as the corpus grows
    def has(times, **floor):
        texts = [("mm qek",), ("nn qek",), *[("the an er " * 200,)] * times]
        return int.from_bytes(b"eq", "big") in S.fit(spark.createDataFrame(texts, "text string"), **floor).contexts[1]

    assert has(1) and has(600) and not has(600, p_min=1e-5)


def test_default_depth_and_that_the_own_model_is_that_of_fit(spark, case):
    rows, docs, train, *_ = case
    own = S.score(docs).collect()
    fitted = S.score(docs, S.fit(spark.createDataFrame([(t,) for t in train], "text string"))).collect()
    key = lambda r: (str(r.doc_id), r.n_tokens, r.score)
    for a, b in zip(sorted(own, key=key), sorted(fitted, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    counts, kept = brute_tree([(t or "").replace("\0", "\1") for t in train], 6, 0.0, 3.0)
    for r in own[:40]:
        text = {i: t for i, t in rows}.get(r.doc_id)
        line = bytes(6) + " ".join(tokens(text)[:-1]).replace("\0", "\1").encode() + b"\0"
        assert r.score == pytest.approx(sum(brute_log10(counts, kept, line[k - 6 : k], line[k]) for k in range(6, len(line))), rel=1e-9)
