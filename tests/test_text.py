"""Hand-computed cleaning, token and feature cases."""

import io
import unicodedata
from contextlib import redirect_stdout

import pytest
from pyspark.sql import functions as F

from siftwire.functions import cleaning as C
from siftwire.functions import patterns as P
from siftwire.functions import profile as R
from siftwire.functions import tokens as K
from siftwire.functions import vectors as V
from siftwire.operators import lexicon as L
from siftwire.plans.preprocess import PreprocessOptions, preprocess

CLEAN = [
    ("FREE!!! Visit http://spam.com/x?y now", "free!! visit url now"),
    ("user@example.com", "user url"),
    ("mail bob@site.de now", "mail email now"),
    ("12345 and 123456 and 123456789", "num and phone and phone"),
    ("12.34a 1,234.5", "num .34a num"),
    ("win $1,000.50 or 500 usd", "win currency or currency"),
    ("漢字かな 😀😀 hi", "emoji emoji hi"),
    ("a <b>&amp;</b> café ﬁ", "a cafe fi"),
    ("<p title='&lt;'>x</p>", "x"),
    ("x y z", "x y z"),
    ("soooo co__ool", "soo co ool"),
    ("end.Into b.info", "url url"),
    (None, ""),
    ("", ""),
]


def test_clean_text(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CLEAN)], "doc_id int, text string")
    got = {r["doc_id"]: r["cleaned_text"] for r in C.clean_text(df).collect()}
    assert [got[i] for i in range(len(CLEAN))] == [want for _, want in CLEAN]


def test_flags_off_leave_the_text(spark):
    off = C.CleanOptions(*([False] * 12))
    df = spark.createDataFrame([(1, " A <b>  1 ")], "doc_id int, text string")
    assert C.clean_text(df, options=off).first()["cleaned_text"] == " A <b>  1 "


def test_emoji_modes(spark):
    df = spark.createDataFrame([("a😀b",)], "text string")
    row = df.select(
        C.handle_emoji(F.col("text"), "remove").alias("r"), C.handle_emoji(F.col("text"), "keep").alias("k")
    ).first()
    assert (row["r"], row["k"]) == ("ab", "a😀b")


def test_hostile_text_is_linear(spark):
    text = "1," * 60_000 + " " + "a." * 60_000 + "x" * 100_000 + "@" * 1000
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    assert C.clean_text(df).first()["cleaned_text"]


def test_tokens_and_normalization(spark):
    df = spark.createDataFrame([("don't u ya ur k txt the free_x abhi é",)], "text string")
    row = df.select(
        K.tokenize(F.col("text")).alias("t"),
        K.normalize_tokens(K.tokenize(F.col("text"))).alias("n"),
        K.tokenize(F.lit(None).cast("string"), "whitespace").alias("e"),
    ).first()
    assert row["t"] == ["don't", "u", "ya", "ur", "k", "txt", "the", "free_x", "abhi", "é"]
    # u -> you and ur -> your are stop words, ya -> or as well.
    assert row["n"] == ["okay", "text", "free_x"]
    assert row["e"] == []
    with pytest.raises(ValueError):
        K.tokenize(F.col("text"), "other")


def test_keywords_keep_order_and_repeats(spark):
    df = spark.createDataFrame([(["free", "x", "Prize", "free"],)], "t array<string>")
    assert df.select(K.spam_keywords(F.col("t")).alias("k")).first()["k"] == ["free", "Prize", "free"]


def test_profile(spark):
    df = spark.createDataFrame([("AB c1² !",), ("",)], "text string")
    rows = df.select(*[c.alias(k) for k, c in R.ratios(F.col("text")).items()]).collect()
    assert rows[0]["uppercase_ratio"] == pytest.approx(2 / 3)
    assert rows[0]["digit_ratio"] == pytest.approx(2 / 8)
    assert rows[0]["special_char_ratio"] == pytest.approx(1 / 8)
    assert tuple(rows[1]) == (0.0, 0.0, 0.0)


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"],), (["a"],), ([],)], "t array<string>")
    rows = [r["g"] for r in df.select(K.word_ngrams(F.col("t"), 1, 3).alias("g")).collect()]
    assert rows == [["a", "b", "c", "a b", "b c", "a b c"], ["a"], []]


def test_softmax_argmax(spark):
    df = spark.createDataFrame([([1000.0, 1001.0, 1001.0],)], "x array<double>")
    row = df.select(V.softmax(F.col("x")).alias("p"), V.argmax(F.col("x")).alias("a")).first()
    assert sum(row["p"]) == pytest.approx(1.0) and row["a"] == 1


def test_lemmas(spark):
    words = ["running", "boxes", "was", "geese", "free"]
    forms = spark.createDataFrame([(w,) for w in words], "form string")
    lexicon = spark.createDataFrame(
        [("run", "v"), ("runn", "v"), ("box", "n"), ("box", "v"), ("goose", "n"), ("be", "v"), ("free", "v")],
        "lemma string, pos string",
    )
    irregular = spark.createDataFrame(
        [("geese", "n", "goose"), ("was", "v", "be"), ("running", "v", "run")], "form string, pos string, lemma string"
    )
    lemmas = L.lemma_table(forms, lexicon, irregular)
    df = spark.createDataFrame([(1, words), (2, [])], "doc_id int, tokens array<string>")
    got = {r["doc_id"]: r["tokens"] for r in L.lemmatize(df, lemmas).collect()}
    assert got == {1: ["run", "box", "be", "goose", "free"], 2: []}


def test_stems(spark):
    # Published examples of the algorithm.
    pairs = {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre",
        "plastered": "plaster", "motoring": "motor", "conflated": "conflat", "hopping": "hop", "falling": "fall",
        "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit",
        "triplicate": "triplic", "hopeful": "hope", "goodness": "good", "revival": "reviv", "adjustable": "adjust",
        "adoption": "adopt", "probate": "probat", "rate": "rate", "controll": "control", "roll": "roll",
    }
    words = spark.createDataFrame([(w,) for w in pairs], "form string")
    assert {r["form"]: r["word"] for r in L.stem_vocabulary(words).collect()} == pairs


def test_preprocess_stages(spark):
    df = spark.createDataFrame([(1, "Claim ur FREE prize at http://x.com")], "doc_id int, text string")
    row = preprocess(df).first()
    assert row["final_text"] == "claim free prize url" and row["spam_keywords"] == ["claim", "free", "prize"]
    assert row["has_url"] and not row["has_email"] and row["original_length"] == 35
    plain = preprocess(
        df,
        options=PreprocessOptions(
            enable_cleaning=False, enable_tokenization=False, enable_normalization=False, extract_metadata=False
        ),
    ).first()
    assert plain["tokens"] == ["Claim", "ur", "FREE", "prize", "at", "http://x.com"] and not plain["has_url"]


@pytest.mark.parametrize("fold", ["nonspacing", "combining"])
def test_folds_of_single_characters_stay_in_the_jvm(spark, monkeypatch, fold):
    def by_hand(text):
        left = (c for c in unicodedata.normalize("NFKD", text) if not (unicodedata.combining(c) if fold == "combining" else unicodedata.category(c) == "Mn"))
        return "".join(left)

    texts = [f"a{chr(c)}́b" for c in range(1, 0x3100)] + [f"a{chr(c)}{chr(c + 1)}b" for c in range(1, 0x3100)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    found = df.select("text", C.decode_text(F.col("text"), unescape=False, fold=fold).alias("folded")).collect()
    assert len(found) == len(texts) and all(r.folded == by_hand(r.text) for r in found)
    monkeypatch.setattr(C, "_decoder", lambda unescape, fold: lambda col: F.when(col.isNotNull(), "sent"))
    df = spark.createDataFrame([("déjà vu, Größe ñ",), ("½",), ("á",), ("plain",)], "text string")
    assert [r[0] for r in df.select(C.decode_text(F.col("text"), unescape=False, fold=fold)).collect()] == ["deja vu, Große n", "sent", "sent", "plain"]


def test_cheap_test_finds_every_link(spark):
    links = ["http://x", "HTTPS://x", "ftp://y", "httpſ://x", "WWW.x", "wWw.", "a.com", "b.IO", "c.İn d.ın", "x.uK", "é.de.xyz"]
    df = spark.createDataFrame([(t,) for t in [*links, "no link. here", "w.x"]], "text string")
    rows = df.select("text", F.col("text").rlike(P.URL).alias("url"), C.may_hold_url(F.col("text")).alias("may"), R.has_url(F.col("text")).alias("has")).collect()
    assert all(r.has == r.url and r.may >= r.url for r in rows) and sum(r.url for r in rows) >= 9
    assert not rows[-2].may


def test_preprocessing_strips_no_token(spark):
    df = spark.createDataFrame([(1, "One  fish two")], "doc_id long, text string")
    for backend in K.TOKENIZERS:
        done = preprocess(df, options=PreprocessOptions(tokenizer=backend)).select("normalized_tokens")
        with redirect_stdout(io.StringIO()) as out:
            done.explain(True)
        assert "trim(lower" not in out.getvalue() and done.first()[0] == ["one", "fish", "two"]
