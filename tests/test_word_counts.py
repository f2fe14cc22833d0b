"""Words counted, scored and put into vectors inside rows: against counting by hand."""

import io
import math
import re
from collections import Counter
from contextlib import redirect_stdout

import pytest

from siftwire.operators import classifiers as G
from siftwire.operators import features as X

ROWS = [
    (1, "One fish two fish, one fish"),
    (1, "two fish"),
    (2, "a"),
    (3, None),
    (None, "red fish blue fish"),
    (None, "blue fish"),
    (4, "x\U0001f600y z\x00z"),
    (5, ""),
]


def by_hand(low, high):
    out = Counter()
    for doc_id, text in ROWS:
        words = re.findall(r"\w{2,}", (text or "").lower())
        for n in range(low, high + 1):
            for i in range(len(words) - n + 1):
                out[doc_id, " ".join(words[i : i + n])] += 1
    return out


@pytest.mark.parametrize("piece", [1, 5, 1 << 20])
@pytest.mark.parametrize("ngrams", [(1, 3), (2, 2)])
def test_word_counts_in_pieces(spark, monkeypatch, piece, ngrams):
    monkeypatch.setattr(X, "PIECE_WORDS", piece)
    options = X.TfidfOptions(ngrams=ngrams, strip_accents=False)
    df = spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1)
    found = X.term_counts(df, options=options).collect()
    assert Counter({(r.doc_id, r.term): r.tf for r in found}) == by_hand(*ngrams) and len(found) == len(by_hand(*ngrams))


@pytest.mark.parametrize("together", [64, 1])
def test_scores_are_summed_inside_rows(spark, monkeypatch, together):
    monkeypatch.setattr(X, "TOGETHER", together)
    texts = spark.createDataFrame(ROWS, "doc_id long, final_text string")
    terms = spark.createDataFrame([("fish", 0, 1.5, -1.0, -2.0), ("one", 1, 2.0, -3.0, -0.5)], "term string, idx int, idf double, ham_logp double, spam_logp double")
    model = G.NaiveBayes(terms, spark.createDataFrame([(-0.5, -1.0)], "ham_prior double, spam_prior double"))
    scored = G.score_naive_bayes(model, texts)
    with redirect_stdout(io.StringIO()) as out:
        scored.explain()
    assert ("Generate" in out.getvalue()) == (together == 1)  # before, terms were exploded and joined in any case

    def spam(counts):
        weight = {t: (1 + math.log(n)) * {"fish": 1.5, "one": 2.0}[t] for t, n in counts.items()}
        dot = sum(w * {"fish": -1.0, "one": 2.5}[t] for t, w in weight.items()) / (math.sqrt(sum(w * w for w in weight.values())) or 1.0)
        return round(1 / (1 + math.exp(0.5 - dot)), 9)

    want = {1: {"fish": 4, "one": 2}, 2: {}, 3: {}, None: {"fish": 3}, 4: {}, 5: {}}
    got = [(r.doc_id, round(r.spam_probability, 9)) for r in scored.collect()]
    assert len(got) == 6 and dict(got) == {k: spam(v) for k, v in want.items()}


def test_vectors_are_not_read_from_text(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    options = X.TfidfOptions(min_df=1, max_df=1.0, strip_accents=False)
    vectors = X.tfidf_vectors(X.term_counts(df, options=options, packed=True), X.fit_tfidf(df, options=options), options=options)
    with redirect_stdout(io.StringIO()) as out:
        vectors.explain()
    assert "from_json" not in out.getvalue()
