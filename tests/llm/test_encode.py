import random
from pathlib import Path

import pytest

from quillon.llm import encode as E

PATH = f"{E.VOCABULARY_DIR}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not Path(PATH).exists(), reason="no vocabulary files")


@pytest.fixture(scope="module")
def other():
    """A second, independent implementation of the same vocabulary."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{E.VOCABULARY_DIR}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


PARTS = ["a", "b", "ab", "the", "ing", "  ", " ", "\n", "\r\n", "\t", "é", "𝒳", "中", "1", "23", "'s", "'t", "'", "_", "<|endoftext|>", "==", "́", "\x00", "　", "\x1c", "\x85", "​", "\xa0"]


def test_joins_on_random_texts(other):
    enc, rng = E.encoder(PATH), random.Random(11)
    for _ in range(700):
        some = rng.sample(PARTS, rng.choice([2, 5, 20]))
        s = "".join(rng.choice(some) * rng.choice([1, 1, 2, 7, 40]) for _ in range(rng.choice([3, 30, 120])))
        want = other(s)
        for cut in (5, 33):
            assert E.encode_text(enc, s, cut) == want
            assert E.fold(enc, [(p, E.encode_text(enc, p, 50)) for p in E.halves(s, cut + 7)]) == want


@pytest.mark.parametrize("s", ["a" * 30_000, "ab" * 20_000, "=" * 29_999, "the" * 9000 + " b" * 500, "中" * 9000, "x" * 5000 + "\n" * 5000 + "y"])
def test_long_runs(other, s):
    assert E.encode_text(E.encoder(PATH), s, 4096) == other(s)


def test_corpus(spark, other):
    long = "word and more " * 3000 + "q" * 9000
    rows = [(1, "plain text", 0), (2, "", 0), (3, None, 0), (4, " \n ", 0), (5, "<|endoftext|>", 0), (6, long, 0), (7, long[::-1], 0), (1, "plain text", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(3)
    got = [(r.doc_id, list(r.ids)) for r in E.encode_corpus(df, text_cut=2000, run_cut=256).collect()]
    assert sorted(got) == sorted((d, other(t) if t else []) for d, t, _ in rows)
    assert E.encode_corpus(spark.createDataFrame([], "doc_id long, text string")).count() == 0
