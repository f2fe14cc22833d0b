import hashlib

import pytest

from siftwire.functions import tokens as K
from siftwire.operators import explain as E
from siftwire.operators import lexicon as L
from siftwire.operators import scoring as S
from siftwire.plans.preprocess import PreprocessOptions, preprocess
from siftwire.sources import corpus as SC


def test_checksums_in_pieces(spark, tmp_path):
    contents = {"empty": b"", "one": b"x", "odd": bytes(range(256)) * 37 + b"tail"}
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)
    for whole, piece in ((64 << 20, 1 << 20), (0, 3), (1, 9473)):
        got = {r.path.rsplit("/", 1)[1]: (r.length, r.sha256) for r in SC.file_checksums(spark, str(tmp_path), whole_bytes=whole, piece_bytes=piece).collect()}
        assert got == {name: (len(data), hashlib.sha256(data).hexdigest()) for name, data in contents.items()}


def test_checksum_of_a_file_above_two_gib(spark, tmp_path):
    size, piece = (1 << 31) + 5, bytes(1 << 24)
    with open(tmp_path / "sparse", "wb") as out:
        out.truncate(size)
    want = hashlib.sha256()
    for _ in range(size // len(piece)):
        want.update(piece)
    want.update(bytes(size % len(piece)))
    row = SC.file_checksums(spark, str(tmp_path)).first()
    assert (row.length, row.sha256) == (size, want.hexdigest())


def failing_model():
    def model(texts):
        if any("boom" in t for t in texts):
            raise RuntimeError("boom")
        return [[1.0 * t.count("a"), 1.0 * t.count("b")] for t in texts]

    return model


def test_one_bad_text_is_one_error_row(spark):
    rows = spark.createDataFrame([(i, f"{'a ' * (i % 3)}{'b ' * (i % 5)}word{i}") for i in range(40)] + [(99, "a boom b"), (98, "boom")], "doc_id long, text string")
    scorer = S.batch_scorer(failing_model, batch_size=8)
    out = {r.doc_id: r for r in S.score_messages(rows, scorer, "m", raw_text=True).collect()}
    assert {i for i, r in out.items() if r.prediction == "error"} == {98, 99} and out[99].spam_probability is None
    assert all(0 < r.spam_probability < 1 for i, r in out.items() if i < 90)
    for method, extra in (("lime", {"num_samples": 12}), ("shap", {"max_evals": 12})):
        told = {r.doc_id: r for r in E.explain(rows, lambda t, key, keep: scorer(t, key, keep), method, **extra).collect()}
        assert {i for i, r in told.items() if r.prediction == "error"} == {98, 99} and len(told) == 42
        assert all(r.word_importances for i, r in told.items() if i < 90) and not told[99].word_importances


def test_lemmas(spark):
    words = "was went children feet stopping messages replies parties boxes running claimed the winner watches qualified data xyzs being lives".split()
    forms = spark.createDataFrame([(w,) for w in words], "form string")
    rows = spark.createDataFrame([(1, words + ["was"]), (2, []), (3, None)], "doc_id long, tokens array<string>")
    got = {r.doc_id: r.tokens for r in L.lemmatize(rows, L.default_lemmas(forms)).collect()}
    want = "be go child foot stop message reply party box run claim the winner watch qualify datum xyzs be live be".split()
    assert got == {1: want, 2: [], 3: None}
    texts = spark.createDataFrame([(1, "Winners claimed prizes")], "doc_id long, text string")
    asked = PreprocessOptions(normalize=K.NormalizeOptions(lemmatize=True))
    with pytest.raises(ValueError):
        preprocess(texts, options=asked)
    some = spark.createDataFrame([("winners",), ("claimed",), ("prizes",)], "form string")
    for options in (asked, PreprocessOptions()):
        assert preprocess(texts, options=options, lemmas=L.default_lemmas(some)).first().final_text == "winner claim prize"
    off = PreprocessOptions(normalize=K.NormalizeOptions(lemmatize=False))
    assert preprocess(texts, options=off, lemmas=L.default_lemmas(some)).first().final_text == "winners claimed prizes"


def test_default_lexicon_is_consistent():
    lexicon, exceptions = L.lexicon_rows()
    assert {(lemma, pos) for _, pos, lemma in exceptions} <= set(lexicon)
    assert len(exceptions) == len({(form, pos) for form, pos, _ in exceptions})
