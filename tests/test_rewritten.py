"""Tokens are rewritten inside their rows: the same words as a join gives, and no token moves."""

import pytest
from pyspark.sql import functions as F

from siftwire.operators import lexicon as L

WORDS = """relational conditional valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator
feudalism decisiveness hopefulness callousness formaliti sensitiviti sensibiliti triplicate formative formalize electriciti electrical hopeful goodness
revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou communism activate
angulariti homologous effective bowdlerize probate rate cease controll roll caresses ponies ties caress cats feed agreed plastered bled motoring sing
conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky say dying died spied cry yyy yay oayy enjoyed news inning
proceed geologi analogi theologi trolli nationalli totalli be I Was İS straße ΣΑΣ naïve Y ay a running geese winners claimed""".split()


def plain(rows):
    return sorted((r.doc_id is None, r.doc_id or 0, r.tokens or ["-"]) for r in rows.collect())


@pytest.fixture(scope="module")
def lists(spark):
    rows = [(i, WORDS[i:] + WORDS[:3]) for i in range(0, len(WORDS), 7)]
    rows += [(1000, []), (1001, None), (1002, [None]), (1003, [None, "cats", None, "was"]), (None, ["geese", "cats"]), (1, ["cats", "was", "cats"]), (1, ["geese"]), (2, ["ties"]), (2, ["ties"]), (3, [])]
    return spark.createDataFrame(rows, "doc_id long, tokens array<string>")


def test_stems_in_rows_equal_the_expression(spark, lists):
    made = [a + b for a in WORDS for b in ("", "s", "ed", "ing", "ly", "ational", "y", "ees")]
    table = L.stem_vocabulary(spark.createDataFrame([(w,) for w in made], "form string"))
    assert {r.form: r.word for r in table.collect()} == {w: L.stem_word(w) for w in made}
    words = L.stem_vocabulary(lists.select(F.explode("tokens").alias("form")).filter("form is not null"))
    assert plain(L.stem(lists)) == plain(L._joined(lists, words, "tokens", "doc_id"))


@pytest.mark.parametrize("most", [None, 3])
def test_tables_in_rows_equal_the_join(spark, lists, most, monkeypatch):
    if most:
        monkeypatch.setattr(L, "TABLE_WORDS", most)
    table = spark.createDataFrame([("cats", "cat"), ("was", "be"), ("geese", "goose"), ("Was", None), (None, "x"), ("ties", "tie")], "form string, word string")
    assert plain(L.apply_word_table(lists, table, "tokens", "doc_id")) == plain(L._joined(lists, table, "tokens", "doc_id"))
    twice = table.union(spark.createDataFrame([("cats", "kitty")], table.schema))
    assert plain(L.apply_word_table(lists, twice, "tokens", "doc_id")) == plain(L._joined(lists, twice, "tokens", "doc_id"))


def test_no_token_moves(spark, lists):
    df = lists.filter("doc_id >= 7 and doc_id < 1000")
    forms = df.select(F.explode("tokens").alias("form"))
    for done in (L.stem(df), L.lemmatize(df, L.default_lemmas(forms))):
        plan = done._jdf.queryExecution().toString()
        assert "Exchange" not in plan and "Generate" not in plan and done.columns == df.columns
