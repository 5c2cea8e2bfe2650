import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from signet.llm import syncmers as S


def signed(x, bits):
    return x - (1 << bits) if x >> (bits - 1) else x


def chain(values):
    """Spark's xxhash64 of longs: each hash seeds the next."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest((v & (1 << 64) - 1).to_bytes(8, "little"), seed)
    return signed(seed, 64)


def murmur(values):
    """Spark's hash() of longs."""
    m, seed = 0xFFFFFFFF, 42
    rot = lambda x, r: (x << r | x >> (32 - r)) & m
    for v in values:
        for k in (v & m, v >> 32 & m):
            seed ^= rot(k * 0xCC9E2D51 & m, 15) * 0x1B873593 & m
            seed = (rot(seed, 13) * 5 + 0xE6546B64) & m
        seed ^= 8
        for r, f in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
            seed = (seed ^ seed >> r) * f & m
    return seed


def plain(text):
    pieces = re.findall(r"[^ \t-\r]{1,16}", text or "")
    h = [signed(xxhash.xxh64_intdigest(p.encode(), 42), 64) for p in pieces]
    if len(h) < 5:
        return [murmur([x]) for x in h]
    r = [chain(h[i : i + 2]) for i in range(len(h) - 1)]
    return [murmur([r[i], r[i + 2], h[i + 4]]) for i in range(len(h) - 4) if min(r[i : i + 4]) in (r[i], r[i + 3])]


def hexed(marks):
    return "".join(f"{x:08x}" for x in marks)


def near(a, b):
    return len(set(a) & set(b)) / len(set(a) | set(b)) if a or b else 1.0


def brute(rows):
    texts = [(i, t or "") for i, t in sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))]
    for at, (i, text) in enumerate(texts):
        after = texts[(at + 1) % len(texts)][1]
        m = len(text) // 3
        edited = text[: len(text) - m] + after[:m]
        a, b, c = plain(text), plain(edited), plain(after)
        yield (i, len(text), hashlib.sha256(edited.encode()).hexdigest(), hexed(a), hexed(b), near(a, b), near(a, c))


def as_rows(found):
    like = S.likeness
    return found.select("doc_id", "n_chars", F.sha2(F.encode("edited", "utf-8"), 256), S.as_text(F.col("marks")), S.as_text(F.col("edited_marks")), like("marks", "edited_marks"), like("marks", "next_marks")).collect()


def test_equals_brute_force(spark):
    rng = random.Random(3)
    words = ["a", "the", "Ünï", "日本語のテキスト", "x" * 40, "of", "𝔘x"] + [f"w{i}" for i in range(50)]
    rows = [(i * 7 if i % 3 else i * 900 - 5, "".join(rng.choice(words) + rng.choice([" ", "\n", "\t "]) for _ in range(rng.choice([0, 1, 3, 4, 5, 6, 30, 200])))) for i in range(1, 150)]
    rows = list(dict(rows).items()) + [(10**12, None), (None, "no id here at all, though words"), (-4, "x" * 50_000)]
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, marks int")
    assert sorted(map(str, map(tuple, as_rows(S.fingerprints(docs))))) == sorted(map(str, brute(rows)))


def test_edit_is_nearer_than_stranger_and_copies_agree(spark):
    rng = random.Random(8)
    text = lambda: " ".join(f"w{rng.randrange(4000)}" for _ in range(300))
    rows = [(i, text()) for i in range(20)] + [(20, "same text here for two rows of it"), (21, "same text here for two rows of it")]
    got = {r.doc_id: r for r in S.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", S.likeness("marks", "edited_marks").alias("e"), S.likeness("marks", "next_marks").alias("n"), "marks").collect()}
    assert all(0.35 < got[i].e < 0.65 and got[i].n < 0.1 for i in range(1, 20))
    assert got[21].n == 1 and got[20].marks == got[21].marks


def test_one_row_repeats_and_no_rows(spark):
    one = spark.createDataFrame([(3, "lone words")], "doc_id long, text string")
    assert [tuple(r)[-1] for r in as_rows(S.fingerprints(one))] == [1.0]
    same = spark.createDataFrame([(3, "a b c"), (3, "a b c"), (3, "d e"), (None, None), (None, None)], "doc_id long, text string")
    assert S.fingerprints(same).count() == 5
    assert S.fingerprints(one.limit(0)).count() == 0


@pytest.mark.parametrize("cuts", [4, 1024])
def test_neighbours_of_skewed_ids(spark, cuts):
    """An id far from all others, one that a third of all rows share, rows without any."""
    rng = random.Random(5)
    ids = [rng.randrange(5000) for _ in range(600)] + [777] * 400 + [None] * 150 + [1 << 62, -(1 << 62), 777]
    rows = [(i, rng.getrandbits(63) - (1 << 62), k) for k, i in enumerate(ids)]
    df = spark.createDataFrame(rows, "doc_id long, mark long, k int")
    found = S.followed(df, ["k"], df.select("doc_id", "mark"), cuts, 4)
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -r[1]))
    want = {a[2]: b[2] for a, b in zip(order, order[1:] + order[:1], strict=True)}
    assert {r.k: r.next_k for r in found.collect()} == want


def test_no_bucket_is_large(spark):
    rng = random.Random(6)
    ids = [rng.randrange(10**5) for _ in range(3000)] + [777] * 2000 + [None] * 1000 + [1 << 62]
    df = spark.createDataFrame([(i, rng.getrandbits(64) - (1 << 63), 0) for i in ids], "doc_id long, mark long, k int")
    windows = []
    S.followed(df, ["k"], df.select("doc_id", "mark")).createOrReplaceTempView("followed_rows")
    plan = spark.table("followed_rows")
    keys = plan._jdf.queryExecution().analyzed().toString()
    assert "one" in keys and "three" in keys
    target = len(ids) // (S.SPREAD * 8)
    first = df.agg(S._quantiles("doc_id", S.CUTS)).first()[0]
    placed = df.filter("doc_id is not null").withColumn("one", S._place(F.col("doc_id"), F.array(*map(F.lit, first)), 11))
    for r in placed.groupBy("one").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("kinds")).collect():
        windows.append(r.n)
        assert r.n <= 2 * target or r.kinds == 1
    assert sum(windows) == 5001
