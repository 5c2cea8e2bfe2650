import hashlib
import random
from array import array

import public_tokenizers
import pytest
import tiktoken

from signet.llm import bpe

PATH, PATTERN = public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN
ODD = ["", " ", "  ", "a  b", " \n x  y", "'s it's\t\tq  ", "x" * 3000, "日本語 テスト 123 456", " lead", "trail ", "a  b", "\x1c a", "a \x85b", "!?" * 700, "<|endoftext|>", "é" * 40 + " naïve"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_perfect_hash_is_minimal_and_knows_strangers():
    words = [f"w{i}".encode() for i in range(3000)]
    table = bpe.PerfectHash(words)
    assert sorted(map(table.slot, words)) == list(range(3000))
    assert all(table.slot(f"x{i}".encode()) == -1 for i in range(500))
    assert bpe.PerfectHash([]).slot(b"a") == -1


def test_same_ids_as_the_library(library):
    own, rng = bpe.codec(PATH, PATTERN), random.Random(7)
    texts = ODD + ["".join(rng.choice("ab cdé\n'ſ 1.! 漢") for _ in range(rng.randrange(60))) for _ in range(500)]
    for text in texts:
        ids = own.encode(text)
        assert ids == array("I", library.encode_ordinary(text)).tobytes(), repr(text)
        assert own.decode(ids) == text.encode()


def test_query_over_nulls_repeats_and_clashing_columns(spark, library):
    texts = [None, *ODD, "again", "again"]
    docs = spark.createDataFrame([(i or None, t, -1) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    rows = bpe.encode(docs, PATH, PATTERN, keep_ids=True).collect()
    assert len(rows) == len(texts)
    for row in rows:
        ids = library.encode_ordinary(row.text or "")
        assert (row.n_tokens, row.ids) == (len(ids), ids)
        assert row.ids_sha256 == hashlib.sha256(array("I", ids)).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((row.text or "").encode()).hexdigest()
    assert bpe.encode(docs.limit(0), PATH, PATTERN).collect() == []
