import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from loadweave.llm import bpe
from tests.llm import edges

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
LIBRARY = tiktoken.Encoding(
    "test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={}
)


def texts():
    rng = random.Random(5)
    alphabet = "aeinrst lh'dT  \n\t  　\x85\x1céß漢字\U0001f600Σ́ 0123.,!<|>"
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(200)]
    return [t or "" for _, t, *_ in edges.TEXTS] + made + ["<|endoftext|>", "ab" * 5000, " " * 3000 + "x"]


def test_codec_agrees_with_the_library():
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN, {})
    for text in texts():
        ids = codec.encode(text)
        assert ids == LIBRARY.encode_ordinary(text)
        assert codec.decode(ids) == text.encode()


def test_cache_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "_CACHED_WORDS", 5)
    codec = bpe.Codec(RANKS, public_tokenizers.PATTERN, {"known": LIBRARY.encode_ordinary("known")})
    text = " ".join(f"word{i}" for i in range(50)) + "known"
    assert codec.encode(text) == LIBRARY.encode_ordinary(text)
    assert len(codec.words) <= 7 and "known" in codec.words


def test_fold_in_spark(spark):
    words = sorted({w for t in texts() for w in bpe.regex.findall(bpe.portable(public_tokenizers.PATTERN), t) if len(w) < 40})
    frame = spark.createDataFrame([(w,) for w in words], "word string")
    literal = bpe._rank_literal(RANKS)
    found = {r.word: r.ids for r in frame.select("word", bpe.folded(F.col("word"), literal).alias("ids")).collect()}
    assert found == {w: list(bpe.fold(w.encode(), RANKS)) for w in words}


def test_a_rank_that_merges_do_not_reach():
    # the whole word has a rank, though no pair of its bytes does
    ranks = {bytes([b]): b for b in range(256)} | {b"xyz": 256}
    assert bpe.fold(b"xyz", ranks) == (256,)
    assert bpe.fold(b"xyza", ranks) == (120, 121, 122, 97)


@pytest.mark.parametrize("most", [0, 3, 1 << 18])
def test_dictionary_is_bounded(spark, most):
    docs = edges.documents(spark)
    found = bpe.dictionary(docs, RANKS, public_tokenizers.PATTERN, most).collect()
    assert len(found) <= most
    assert all(r.ids == LIBRARY.encode_ordinary(r.word) for r in found)


def test_documents(spark):
    rows = [*edges.TEXTS, *[(100 + i, t, None, None) for i, t in enumerate(texts())]]
    docs = edges.clashing(edges.documents(spark, rows))
    found = bpe.encoded(docs, PATH, public_tokenizers.PATTERN).collect()
    expected = []
    for doc_id, text, *_ in rows:
        ids = LIBRARY.encode_ordinary(text or "")
        listed = " ".join(map(str, ids)).encode()
        expected.append(
            (
                doc_id,
                len(ids),
                hashlib.sha256(listed).hexdigest(),
                hashlib.sha256((text or "").encode()).hexdigest(),
                ids,
            )
        )
    assert sorted(map(tuple, found), key=repr) == sorted(expected, key=repr)


def test_empty_table(spark):
    assert bpe.encoded(edges.empty(spark), PATH, public_tokenizers.PATTERN).count() == 0
