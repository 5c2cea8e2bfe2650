import random
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline as P
from signet.llm import bpe, mixing, quality, similar

GOOD = "the measured result of this careful study shows that most readers agree with its conclusion".split()
BAD = "buy cheap pills now click here win free $$$ !!! casino bonus xxx offer limited".split()


def test_stages_against_brute_force(spark, tmp_path):
    rng, rows, labels = random.Random(6), [], []
    for i in range(600):
        good = i % 3 > 0
        rows.append((i, " ".join(f"{rng.choice(GOOD if good else BAD)}{rng.randrange(30)}" for _ in range(rng.choice([120, 250]))), "en", rng.choice(["a", "a", "a", "b", None]), 0))
        labels.append((i, int(good), 0))
    rows += [(1000 + i, rows[i][1], "en", "b", 0) for i in range(0, 120, 2)]
    rows += [(2000 + i, rows[i][1].replace(" ", " edited ", 1) + " anew", "en", "b", 0) for i in range(0, 300, 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    marks = spark.read.parquet(f"{tmp_path}/labels.parquet")
    scored = quality.score(docs, quality.learned(docs, marks)).collect()
    good = {r.doc_id: r for r in scored if r.score >= quality.ACCEPT}
    marks = {r.doc_id: set(similar.shingles(r.text).tolist()) for r in docs.collect() if r.doc_id in good}
    root = {i: i for i in marks}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in marks:
        for b in marks:
            if a < b and len(marks[a] & marks[b]) >= 0.8 * len(marks[a] | marks[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    kept = {i for i in marks if find(i) == i}
    stays = docs.filter(docs.doc_id.isin(kept))
    copies = Counter({r.doc_id: r.copies for r in mixing.mix(stays).collect() if r.copies})
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(bpe.VOCABULARY)), special_tokens={})
    got = P.run(spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got) == copies and copies
    assert all(r.n_tokens == len(library.encode_ordinary(good[r.doc_id].text)) for r in got)


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
