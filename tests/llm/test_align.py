import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from siftwire.llm import align, queries

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def loaded():
    a = Tokenizer.from_file(queries.BYTE_BPE)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=queries.PIECE_BPE)


def plain_tokens(text, a, b):
    """Lists of (id, first byte, last byte + 1) of both, or None."""
    if not text:
        return None
    whole, out = (" " + text).encode(), []
    encoded = a.encode(" " + text, add_special_tokens=False)
    letters = align._byte_letters()
    pieces = [(i, bytes(letters.index(x) for x in t)) for i, t in zip(encoded.ids, encoded.tokens)]
    others = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        others.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
    for tokens in (pieces, others):
        at, spans = 0, []
        for i, t in tokens:
            spans.append((i, at, at + len(t)))
            at += len(t)
        if b"".join(t for _, t in tokens) != whole:
            return None
        out.append(spans)
    return out


def plain_alignment(rows, a, b):
    found = [(key, plain_tokens(text, a, b)) for key, text in rows]
    links = [[(x[0], y[0]) for x in t[0] for y in t[1] if x[1] < y[2] and y[1] < x[2]] if t else [] for _, t in found]
    count = Counter(p for some in links for p in some)
    top = {}
    for (_, y), n in count.items():
        top[y] = max(top.get(y, 0), n)
    out = []
    for (key, tokens), own in zip(found, links):
        if not tokens:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
            continue
        cuts = sorted({e for _, _, e in tokens[0]} & {e for _, _, e in tokens[1]})
        parts = []
        for first, last in zip([0, *cuts], cuts):
            parts.append("|".join(",".join(str(i) for i, s, _ in side if first <= s < last) for side in tokens))
        sha = hashlib.sha256(";".join(parts).encode()).hexdigest()
        best = sum(count[p] == top[p[1]] for p in own)
        out.append((key, len(tokens[0]), len(tokens[1]), len(cuts), len(own), best, sum(count[p] for p in own), sha))
    return out


def key(row):
    return tuple((x is None, x) for x in row)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "a"), (5, "<s> <|endoftext|> </s> <unk> <0x41>"), (6, "naïve 漢字 ☃ 🙂  x"), (7, "tabs\tand\nlines\r\n  two  spaces "),
    (8, "▁literal mark"), (9, "ﬁ ligature ² ﷺ"), (None, "no id"), (None, None), (4, "a"), (10, "x" * 3000), (11, "\u0000 zero"), (12, "é ​"), (13, "1234567890" * 40),
]


def test_odd_texts(spark, loaded):
    rows = ODD + [(100 + i, f"the token {i} over the tokens{i * 7}, e.g. Überraschungen!") for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 as id", "'x' as block", "1 as pair")
    for size in (align.BLOCK_BYTES, 200):
        out = align.align(frame, queries.BYTE_BPE, queries.PIECE_BPE, public_tokenizers.PATTERN, block_bytes=size)
        assert out.columns == COLUMNS
        assert sorted((tuple(r) for r in out.collect()), key=key) == sorted(plain_alignment(rows, *loaded), key=key)


def test_given_table(spark, small, loaded):
    docs = spark.read.parquet(f"{small}/documents.parquet").filter("length(text) < 1500")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    out = align.align(docs, queries.BYTE_BPE, queries.PIECE_BPE, public_tokenizers.PATTERN, block_bytes=20_000)
    assert sorted(tuple(r) for r in out.collect()) == sorted(plain_alignment(rows, *loaded))


def test_empty(spark):
    out = align.align(spark.createDataFrame([], "doc_id long, text string"), queries.BYTE_BPE, queries.PIECE_BPE)
    assert out.columns == COLUMNS and out.count() == 0


def test_intervals():
    rng = np.random.default_rng(3)
    for _ in range(50):
        total = int(rng.integers(1, 40))
        a, b = (np.unique(np.append(rng.integers(1, total + 1, 12), total)) for _ in "ab")
        order, group = align.groups(a, b)
        assert group[-1] + 1 == len(set(a.tolist()) & set(b.tolist()))
        assert sorted(order.tolist()) == list(range(len(a) + len(b)))
        i, j = align.overlaps(a, b)
        sa, sb = np.append(0, a[:-1]), np.append(0, b[:-1])
        assert set(zip(i.tolist(), j.tolist())) == {(x, y) for x in range(len(a)) for y in range(len(b)) if sa[x] < b[y] and sb[y] < a[x]}


def test_ranks_give_the_ids_of_the_file(loaded):
    """Also with every tame character, runs of spaces at all places, endless words, and characters that are not tame."""
    rng = np.random.default_rng(5)
    tame = [chr(c) for c in (9, 10, 13, *range(32, 127), *range(0xA1, 0x250), *range(0x2010, 0x2028), 0x20AC)]
    wild = tame + list("\u3000漢字\u0600\x1c\x85\xa0▁\u200b🙂\u0301")
    tokenizers = align.Tokenizers(queries.BYTE_BPE, queries.PIECE_BPE, public_tokenizers.PATTERN)
    assert tokenizers.ranked is not None and align.Tokenizers(queries.BYTE_BPE, queries.PIECE_BPE).ranked is None
    texts = ["".join(rng.choice(alphabet, rng.integers(1, 60))) for alphabet in (tame, wild) for _ in range(400)]
    texts += ["".join(rng.choice(list("ab'st 1.\n  "), rng.integers(1, 40))) for _ in range(400)] + tame + [" " * n for n in range(9)]
    texts += ["ab" * 100_000, " " * 50_000 + "x"]
    spaced = [" " + t for t in texts]
    assert [x.tolist() for x in tokenizers.encode_a(spaced)] == [loaded[0].encode(t, add_special_tokens=False).ids for t in spaced]
