import os

import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline as C
from siftwire.llm import bpe, decontaminate, pii, simhash, toxicity
from tests.llm.test_decontaminate import plain as plain_passages
from tests.llm.test_simhash import plain_components, plain_fingerprint


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """Output of every stage, each read back as the next one's input."""
    docs, out = spark.read.parquet(f"{small}/documents.parquet"), {}
    out["documents"] = docs
    for name, stage in C.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, small).write.parquet(path)
        docs = out[name] = spark.read.parquet(path)
    return out


def rows(frame):
    return [tuple(r) for r in frame.select("doc_id", "text").collect()]


def test_columns(stages):
    for name in ("toxicity", "near_duplicates", "decontamination", "personal_data"):
        assert stages[name].dtypes == stages["documents"].dtypes


def test_toxicity_stage(spark, small, stages):
    docs, labels = stages["documents"], spark.read.parquet(f"{small}/labels.parquet")
    scores = toxicity.toxicity_digest(docs, labels)
    assert {i for i, _ in rows(stages["toxicity"])} == {r.doc_id for r in scores.filter("predicted = 0").collect()}


def test_near_duplicate_stage(stages):
    before = rows(stages["toxicity"])
    low = plain_components([(i, plain_fingerprint(t)) for i, t in before], 4)
    assert {i for i, _ in rows(stages["near_duplicates"])} == set(low.values()) and len(set(low.values())) < len(before)


def test_passage_stage(spark, small, stages):
    before = rows(stages["near_duplicates"])
    items = [tuple(r) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    clean = {i for i, words, hit, _ in plain_passages(before, items) if not (hit and 20 * hit >= words)}
    assert {i for i, _ in rows(stages["decontamination"])} == clean and len(clean) < len(before)


def test_personal_data_stage(spark, stages):
    cipher = pii.Cipher(pii.key_of(spark))
    want = {i: pii.replace_values(t, cipher)[0] for i, t in rows(stages["decontamination"])}
    assert dict(rows(stages["personal_data"])) == want
    assert all(r.n_chars == len(r.text) for r in stages["personal_data"].collect())


def test_token_stage(spark, small, stages):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(C.RANKS), special_tokens={})
    want = {i: own.encode_ordinary(t) for i, t in rows(stages["personal_data"])}
    assert {r.doc_id: list(r.ids) for r in stages["tokens"].collect()} == want
    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder))
    assert C.run(spark, small).count() == len(want)
    left = set(os.listdir(folder)) - before
    assert len(left) == 1 and left.pop().startswith("pipeline-tokens")  # nothing but the result stays


def test_brute_force_helpers_agree():
    assert simhash.fingerprint("a b c d e f", 5) % 2**64 == plain_fingerprint("a b c d e f", 5)
    assert decontaminate.words_of("A-b") == [b"a", b"b"]


def test_stages_on_odd_rows(spark, small, tmp_path):
    """Every stage takes nulls, empty and long texts, repeated rows and columns named like its own."""
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(f"word{i % 997}" for i in range(60_000))
    item = spark.read.parquet(f"{small}/benchmark.parquet").first().text
    mail = "write to someone@example.com or call the office please"
    given = [
        (1, None, None, None, None), (2, "", "en", "", 0), (None, None, None, None, None), (None, "a row without an id stands here", "en", "s", 31),
        (3, long, "en", "s", len(long)), (4, mail, "en", "s", 7), (4, mail, "en", "s", 7), (5, item, "en", "s", 9),
        (6, "six plain words are in here", None, None, None), (7, "six plain words are in here", "fr", "t", 1),
    ]
    extra = ["fp", "row", "score", "id", "kept", "__toxic", "component_id"]
    frame = spark.createDataFrame(given, columns).selectExpr("*", *(f"'{c}' as `{c}`" for c in extra))
    docs, left = frame, {}
    for name, stage in C.STAGES[:-1]:
        path = str(tmp_path / name)
        stage(spark, docs, small).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == frame.columns and docs.filter(" or ".join(f"`{c}` <> '{c}'" for c in extra)).count() == 0
        left[name] = sorted((r.doc_id or -1, len(r.text or "")) for r in docs.collect())
    assert len(left["toxicity"]) == len(given)  # nothing here is toxic
    # One row without words, one of the equal texts, one of the rows that repeat an id and a text.
    assert [i for i, _ in left["near_duplicates"]] == [-1, 1, 3, 4, 5, 6]
    assert [i for i, _ in left["decontamination"]] == [-1, 1, 3, 4, 6]
    masked = {r.doc_id: r for r in docs.collect()}
    assert "someone@" not in masked[4].text and masked[4].n_chars == len(masked[4].text) and masked[1].n_chars is None
    tokens = {r.doc_id: r for r in C.STAGES[-1][1](spark, docs, small).collect()}
    assert tokens[1].n_tokens == 0 and tokens[1].ids == [] and tokens[3].n_tokens > 60_000 and len(tokens) == 5
    empty = frame.limit(0)
    for name, stage in C.STAGES:
        assert stage(spark, empty, small).count() == 0
