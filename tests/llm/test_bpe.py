import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from siftwire.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={}
    )


def awkward():
    rng = random.Random(3)
    texts = [
        "", "Hello world's  best\n\n  text\t!", "x" * 3000, "ab" * 700 + " " * 200, "naïve Ünïcode 日本語 🙂🙂 १२३",
        "   a​\x1c\x1d\x85b 　", "<|endoftext|> don't I'LL they've", "\r\n \r\n", "aaaa " * 500,
    ]
    alphabet = "ab cdé'\n\t 12ß中\x1c  !?-"
    return texts + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 80))) for _ in range(400)]


def test_words_as_the_library(reference):
    ranks = bpe.load_ranks(PATH)
    for text in awkward():
        got = [i for w in bpe._pattern(public_tokenizers.PATTERN).findall(text) for i in bpe.encode_word(w.encode(), ranks)]
        assert got == reference.encode_ordinary(text), text


def test_long_words_merge_alike(reference):
    ranks = bpe.load_ranks(PATH)
    for n in range(200):
        rng = random.Random(n)
        word = bytes(rng.choice(b"abcdethe nr") for _ in range(rng.randrange(2, 120)))
        parts = lambda: [word[i : i + 1] for i in range(len(word))]  # noqa: E731, B023
        assert bpe._merge_short(parts(), ranks) == bpe._merge_long(parts(), ranks)


@pytest.mark.parametrize("block", [24 << 20, 300])
def test_whole_table(spark, small, reference, block):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").limit(80)
    extra = spark.createDataFrame(
        [(None, None), (900001, ""), (900002, "x" * 20000), (900003, "same"), (900003, "same")], docs.schema
    )
    docs = docs.union(extra).cache()
    out = bpe.encode(docs, PATH, public_tokenizers.PATTERN, block_bytes=block)
    want = sorted((r.doc_id or -1, reference.encode_ordinary(r.text or "")) for r in docs.collect())
    assert sorted((r.doc_id or -1, list(r.ids)) for r in out.collect()) == want
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert all(bytes(r.decoded) == texts[r.doc_id] for r in bpe.decode(out, PATH).collect())


def test_digest(spark, reference):
    rows = [(1, "A text."), (2, None)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, ids string, word int")
    got = {r.doc_id: r for r in bpe.round_trip_digest(docs, PATH, public_tokenizers.PATTERN).collect()}
    for key, text in rows:
        ids = reference.encode_ordinary(text or "")
        assert got[key].n_tokens == len(ids)
        assert got[key].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[key].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.round_trip_digest(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
