"""Counting inside rows: against counting by hand, with ids that repeat, are null or have very many texts."""

import io
from collections import Counter
from contextlib import redirect_stdout

import pytest

from siftwire.operators import features as X

ROWS = [
    (1, "One fish two fish, one fish"),
    (1, "two fish"),
    (2, "a"),
    (3, None),
    (None, "red fish blue fish"),
    (None, "blue fish"),
    (4, "x\U0001f600y\U0001f600y  z\x00z"),
    (5, ""),
]
WORDS, CHARS = X.CLEANED, X.TfidfOptions(analyzer="char", ngrams=(2, 4), strip_accents=False)


def by_hand(options):
    out = Counter()
    for doc_id, text in ROWS:
        text = (text or "").lower()
        if options is WORDS:
            import re

            units, join = re.findall(r"\w{2,}", text), " ".join
        else:
            units, join = list(" ".join(text.split("  "))), "".join
        for n in range(options.ngrams[0], options.ngrams[1] + 1):
            for i in range(len(units) - n + 1):
                out[doc_id, join(units[i : i + n])] += 1
    return out


@pytest.mark.parametrize("together", [64, 1])
@pytest.mark.parametrize("options", [WORDS, CHARS])
def test_counts(spark, monkeypatch, together, options):
    monkeypatch.setattr(X, "TOGETHER", together)
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    found = X.term_counts(df, options=options)
    assert Counter({(r.doc_id, r.term): r.tf for r in found.collect()}) == by_hand(options)
    outer = X.term_counts(df, options=options, outer=True).groupBy("doc_id").count()
    assert outer.count() == 6


def test_nothing_is_grouped_by_document_and_term(spark):
    df = spark.createDataFrame([(1, "a fish"), (2, "two fish")], "doc_id long, text string")
    with redirect_stdout(io.StringIO()) as out:
        X.term_counts(df, options=WORDS).explain()
    assert "Aggregate" not in out.getvalue()


@pytest.mark.parametrize("together", [64, 1])
def test_packed_weights(spark, monkeypatch, together):
    monkeypatch.setattr(X, "TOGETHER", together)
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    options = X.TfidfOptions(min_df=1, max_df=1.0, strip_accents=False)
    vocabulary = X.fit_tfidf(df, "text", options=options)
    packed = X.term_counts(df, options=options, packed=True)
    with redirect_stdout(io.StringIO()) as out:
        X.tfidf(packed, vocabulary, options=options).explain()
    assert ("Window" in out.getvalue()) == (together == 1)

    def told(rows):
        return {(r.doc_id, r.term, r.tf, r.idx, round(r.tfidf, 9)) for r in rows.collect()}

    long = X.tfidf(X.term_counts(df, options=options), vocabulary, options=options)
    assert told(X.tfidf(packed, vocabulary, options=options)) == told(long) and long.count() > 10

    def vectors(counts):
        found = X.tfidf_vectors(counts, vocabulary, options=options).collect()
        return {r.doc_id: (r.features.size, {int(i): round(float(v), 9) for i, v in zip(r.features.indices, r.features.values)}) for r in found}

    known = vectors(packed)
    assert known == vectors(X.term_counts(df, options=options, outer=True)) and len(known) == 6 and known[5][1] == {}


def test_tasks_grow_with_the_texts(spark, monkeypatch):
    monkeypatch.setattr(X, "TASK_TEXTS", 10)
    df = spark.range(200).selectExpr("id as doc_id", "concat('word', id % 7, ' fish') as text")
    counts = X.term_counts(df, options=WORDS)
    assert counts.rdd.getNumPartitions() == 21 and counts.count() == 600
