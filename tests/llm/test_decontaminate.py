import re

import numpy as np
import pytest

from siftwire.llm import decontaminate as D
from siftwire.llm.fm_index import FmIndex, suffix_array


def plain(docs, items, width=13):
    """The contract, word by word."""
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for key, text in docs:
        words, hit, held = cut(text), set(), set()
        for item, phrase in items:
            p = cut(phrase)
            for i in range(max(1, len(p) - width + 1)) if p else ():
                w = p[i : i + width]
                for j in range(len(words) - len(w) + 1):
                    if words[j : j + len(w)] == w:
                        hit.update(range(j, j + len(w)))
                        held.add(str(item))
        out.append((key, len(words), len(hit), sorted(held)))
    return out


def test_index():
    rng = np.random.default_rng(4)
    for n, top in ((1, 2), (50, 3), (3000, 4), (3000, 900), (500, 1 << 22)):
        text = np.concatenate((rng.integers(1, top, n), [0]))
        want = sorted(range(len(text)), key=lambda i: text[i:].tolist())
        assert suffix_array(text).tolist() == want
        index = FmIndex(text)
        assert index.locate(np.arange(len(text))).tolist() == want
        for m in (1, 2, 5):
            start = rng.integers(0, n, 20)
            rows = np.array([text[s : s + m] for s in start if s + m <= n])
            if not len(rows):
                continue
            low, high = index.search(rows, np.full(len(rows), m))
            for row, a, b in zip(rows, low, high, strict=True):
                places = [i for i in range(n) if text[i : i + m].tolist() == row.tolist()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == places


@pytest.mark.parametrize(("shard", "block"), [(8 << 20, 8 << 20), (2000, 8 << 20), (3000, 400)])
def test_passages_equal_brute_force(spark, small, shard, block):
    items = spark.read.parquet(f"{small}/benchmark.parquet")
    known = [(r.item_id, r.text) for r in items.collect()]
    a, b = known[0][1], known[1][1]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(10_001, f"{a} {a} {b}"), (10_002, f"before {a.upper()} after"), (10_003, " ".join(a.split()[:-1])), (10_004, None)]
    docs += [(10_005, ""), (10_006, "x " * 30_000 + b), (10_001, f"{a} {a} {b}"), (10_007, "short  Phrase"), (10_008, a.replace(" ", ", "))]
    known += [(501, None), (502, ""), (503, "short phrase"), (504, "short phrase"), (None, "x x x")]
    frame = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, n_words int").repartition(3)
    out = D.find_passages(frame, spark.createDataFrame(known, "item_id long, text string"), shard_bytes=shard, block_bytes=block)
    assert out.columns == ["doc_id", "n_words", "n_hit", "spans", "items"]
    want = plain(docs, [("" if k is None else k, t) for k, t in known])
    got = sorted((r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in out.collect())
    assert got == sorted(want)
    assert any(x[2] for x in want)


def test_no_benchmark_and_no_documents(spark):
    docs = spark.createDataFrame([(1, "some text here")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert [tuple(r)[:3] for r in D.find_passages(docs, items.limit(0)).collect()] == [(1, 3, 0)]
    assert D.passage_digest(docs.limit(0), items).count() == 0


def test_removal(spark):
    text = "Keep this. One two THREE four, and this."
    assert D.cut_spans(text, [{"first": 2, "end": 6}]) == "Keep this. , and this."
    assert D.cut_spans(None, []) is None
    docs = spark.createDataFrame([(1, text), (2, "clean words only"), (None, text), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four")], "item_id long, text string")
    assert sorted(r.doc_id or -1 for r in D.drop_contaminated(docs, items).collect()) == [-1, 2, 3]
