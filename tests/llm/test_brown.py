import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwire.llm import brown


def plain_base(rows):
    """id, text -> n_tokens, n_known, train_tokens, base score, by the contract."""
    cut = lambda t: [w for w in (t or "").encode().lower().split()] + [b"<end>"]
    learn = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 10 != 0
    counts = Counter(w for i, t in rows if learn(i) for w in cut(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        words = cut(t)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        out.append((i, not learn(i), len(words), sum(counts[w] > 0 for w in words), n, round(base, 6)))
    return sorted(out, key=str)


def texts(n=400):
    """Two grammars whose words never meet: classes should tell them apart."""
    rng, rows = random.Random(4), []
    for i in range(n):
        side = rng.choice("ab")
        rows.append((i, " ".join(f"{side}{int(rng.paretovariate(0.6)) % 300}" for _ in range(rng.randrange(1, 40)))))
    return rows


@pytest.fixture(scope="module")
def scored(spark):
    rows = texts() + [(None, None), (7000, ""), (7001, "Naïve\x0bWORDS\tnaïve"), (7001, "Naïve\x0bWORDS\tnaïve"), (7002, "a1 " * 60_000)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, score string").repartition(3)
    return rows, brown.brown_digest(docs).collect()


def test_counts_and_base(scored):
    rows, out = scored
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out), key=str)
    assert got == plain_base(rows)


def test_classes_beat_the_base_on_held_out_texts(scored):
    _, out = scored
    held = [r for r in out if r.held_out and r.doc_id and r.doc_id < 7000]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.2 * sum(r.n_tokens for r in held)
    assert all(r.score < 0 and r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens)) for r in out)


def test_probabilities_add_up():
    rng = np.random.default_rng(1)
    words = np.array([3, 5, 0, 1])
    uses = [[4, 2, 1], [9, 1, 1, 1, 6], [], [2]]
    pairs = np.zeros((4, 4))
    flat = rng.permutation([c for c, u in enumerate(uses) for _ in range(sum(u))])
    np.add.at(pairs, (np.roll(flat, 1), flat), 1)
    model = brown.ClassModel.of(pairs, words, 0.4)
    assert np.allclose((10**model.steps).sum(axis=1), 1)
    for c, u in enumerate(uses):
        if u:
            assert 10 ** model.unknown[c] + sum(10 ** (math.log10(n - 0.4) + model.known[c]) for n in u) == pytest.approx(1)


def test_exchange_raises_the_likelihood(spark):
    docs = spark.createDataFrame(texts(), "doc_id long, text string")
    total = lambda on: brown.score_texts(docs, F.lit(True), classes=12, exchanges=on).agg(F.sum("score")).first()[0]
    assert total(True) > total(False) + 100


def plain_class_score(rows, learned, of, classes, least):
    """Score of every text, class by class, for given classes of the units."""
    cut = lambda t: [*(t or "").encode().lower().split(), b""]
    counts = Counter(w for i, t in rows if learned(i) for w in cut(t))
    once, twice = (sum(n == k for n in counts.values()) for k in (1, 2))
    d = once / (once + 2 * twice) if once and twice else 0.5
    unit = lambda w: brown.ENDINGS + zlib.crc32(w) % brown.HASHES if w and counts[w] >= least else brown.ending_unit(w)
    cls = lambda w: int(of[unit(w)])
    pairs, kinds = Counter(), Counter(cls(w) for w in counts)
    for i, t in rows:
        if learned(i):
            path = [0, *map(cls, cut(t))]
            pairs.update(zip(path, path[1:]))
    uses, before, after = Counter(), Counter(), Counter()
    for (a, b), n in pairs.items():
        uses[b] += n
        before[a] += n
        after[a] += 1
    total = sum(uses.values())
    share = lambda b: (uses[b] + 0.1) / (total + 0.1 * classes)
    out = {}
    for i, t in rows:
        score, last = 0.0, 0
        for w in cut(t):
            c = cls(w)
            step = (max(pairs[last, c] - 0.5, 0) + 0.5 * after[last] * share(c)) / before[last] if before[last] else share(c)
            if counts[w]:
                emit = (counts[w] - d) / uses[c]
            else:
                emit = d * kinds[c] / uses[c] if uses[c] * kinds[c] else 1.0
            score += math.log10(step) + math.log10(emit)
            last = c
        out[i] = score
    return out


def test_class_score_equals_brute_force(spark, monkeypatch):
    rows = texts(150) + [(900, "zz new words a1"), (901, "é x"), (902, "")]
    learned = lambda i: i % 7 != 0 and i < 900
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = []
    own = brown.ClassModel.of
    real = brown.class_pairs
    monkeypatch.setattr(brown, "class_pairs", lambda coded, of, *rest: seen.append((of, real(coded, of, *rest))) or seen[-1][1])
    monkeypatch.setattr(brown.ClassModel, "of", classmethod(lambda cls, pairs, *rest: seen.append(pairs) or own(pairs, *rest)))
    out = brown.score_texts(docs, (F.col("doc_id") % 7 != 0) & (F.col("doc_id") < 900), classes=9, least=3)
    got = {r.doc_id: r.score for r in out.collect()}
    used = seen.pop()
    of = next(of for of, pairs in reversed(seen) if pairs is used)
    want = plain_class_score(rows, learned, of, 9, 3)
    assert got == pytest.approx(want)


def test_units(spark):
    words = [b"", b"a", b"ab", b"xyz", "\u00fc".encode(), b"\xff\x00q", b"long word"]
    frame = spark.createDataFrame([(bytearray(w), f) for w in words for f in (True, False)], "word binary, f boolean")
    for r in frame.select("word", "f", brown._unit("word", F.col("f")).alias("unit")).collect():
        w = bytes(r.word)
        assert r.unit == (brown.ENDINGS + zlib.crc32(w) % brown.HASHES if r.f and w else brown.ending_unit(w))
    assert max(brown.ending_unit(bytes([a, b])) for a in (0, 255) for b in (0, 255)) == brown.ENDINGS - 1


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    out = brown.score_texts(docs, F.lit(False)).collect()
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in out} == {(1, 3, 0, 0), (2, 1, 0, 0)}
    assert all(np.isfinite(r.score) for r in out)
    assert brown.brown_digest(docs.limit(0)).count() == 0
