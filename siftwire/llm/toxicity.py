"""Toxicity scores: boosted trees over dense text features, calibrated by isotonic regression."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log, log1p

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwire.llm.common import crc32_of_id, stored
from siftwire.llm.decontaminate import words_of

#: Labelled rows that fit the lexicon and the model at most, picked by a hash of the id.
FIT_ROWS = 200_000
#: A lexicon entry is as many standard errors from no evidence. Entries stand in a 500th of the toxic texts of the fit at
#: least, so a text of the fit adds 500 times its words at most, a hundred bytes each in a task; FIT_ROWS bounds their texts.
CERTAIN = 3.0
PREFIXES = (4, 5, 6)
FEATURES = (
    "weight_density", "hit_density", "hits", "distinct_hits", "strongest", "second_person", "second_person_near",
    "capitals", "capital_runs", "punctuation", "marks", "digits", "letter_runs", "obfuscated", "obfuscated_hits", "words",
)
#: Second-person words (fixed values).
SECOND_PERSON = frozenset(
    w.encode()
    for w in """
    you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine deiner deinen
    ihr euch euer eure tú ti tuyo tuya usted ustedes vosotros vuestro vuestra
    """.split()
)
NEAR = 5
_DISGUISED = re.compile(rb"[A-Za-z][0-9@$!*|]+[A-Za-z]")
_PLAIN = bytes.maketrans(b"@4301!|$57", b"aaeoiiisst")
_SPACE, _UPPER, _LOWER, _DIGIT, _MARK, _PUNCT, _OTHER = range(7)
_CLASS = np.full(256, _PUNCT, dtype=np.uint8)
_CLASS[128:] = _OTHER
for _chars, _kind in ((b" \t\n\r\x0b\x0c", _SPACE), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), (b"!?", _MARK)):
    _CLASS[list(_chars)] = _kind
_CLASS[ord("a") : ord("z") + 1] = _LOWER
_CLASS[ord("0") : ord("9") + 1] = _DIGIT


class Lexicon(dict):
    """Weight of a word: that of the word or of its heaviest beginning, -1 for the second person, else 0.

    Words met are remembered up to a bound, so a word costs one look-up.
    """

    def __init__(self, entries: dict[bytes, float]):
        super().__init__()
        self.entries = entries

    def __missing__(self, word: bytes) -> float:
        found = [self.entries.get(word, 0.0), *(self.entries.get(word[:n] + b"*", 0.0) for n in PREFIXES)]
        weight = max(found) or (-1.0 if word in SECOND_PERSON else 0.0)
        if len(self) > 500_000:
            self.clear()
        self[word] = weight
        return weight


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The numbers named in ``FEATURES``; zeros for a null or empty text."""
    data = (text or "").encode("utf-8", "replace")
    words = words_of(text)
    if not words:
        return [0.0] * len(FEATURES)
    weight = np.array([lexicon[w] for w in words])
    hit, person = np.nonzero(weight > 0)[0], np.nonzero(weight < 0)[0]
    total, n = float(weight[hit].sum()), len(words)
    near = 0
    if len(hit) and len(person):
        after = np.searchsorted(hit, person)
        gap = np.minimum(
            np.abs(hit[np.minimum(after, len(hit) - 1)] - person), np.abs(hit[np.maximum(after - 1, 0)] - person)
        )
        near = int((gap <= NEAR).sum())
    chars = np.frombuffer(data, dtype=np.uint8)
    kinds = _CLASS[chars]
    count = np.bincount(kinds, minlength=7)
    letters = max(1, int(count[_UPPER] + count[_LOWER] + count[_OTHER]))
    upper = kinds == _UPPER
    same = (chars[1:] == chars[:-1]) & (kinds[1:] >= _UPPER) & (kinds[1:] <= _LOWER)
    disguised, disguised_hits = 0, 0
    for m in _DISGUISED.finditer(data):
        disguised += 1
        token = data[max(data.rfind(b" ", 0, m.start()), data.rfind(b"\n", 0, m.start())) + 1 : m.end()]
        token += re.match(rb"\S*", data[m.end() : m.end() + 40])[0]
        plain = token.lower().translate(_PLAIN, b"*").strip(b".,;:?\"'()")
        disguised_hits += lexicon[plain] > 0
    return [
        total / n,
        len(hit) / n,
        log1p(len(hit)),
        log1p(len({words[i] for i in hit})),
        float(weight.max(initial=0.0)),
        len(person) / n,
        near / n,
        count[_UPPER] / letters,
        float((upper[2:] & upper[1:-1] & upper[:-2]).sum()) / letters,
        count[_PUNCT] / len(data),
        count[_MARK] / len(data),
        count[_DIGIT] / len(data),
        float((same[1:] & same[:-1]).sum()) / letters,
        disguised / n,
        log1p(disguised_hits),
        log1p(n),
    ]


def mine_lexicon(labelled: DataFrame, certain: float = CERTAIN) -> dict[bytes, float]:
    """Words and word beginnings (``abcd*``) whose share of toxic texts is far above that of others.

    ``labelled`` has text and label (0 or 1). Counts are of texts, not uses, and shuffle pre-added. Every entry whose
    log odds are ``certain`` standard errors above zero is taken.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for text, label in zip(batch.column(0), batch.column(1), strict=True):
                words = set(words_of(text.as_py()))
                words |= {w[:k] + b"*" for w in words if len(w) >= PREFIXES[0] for k in PREFIXES if len(w) >= k}
                seen[label.as_py()].update(words)
            entries = list(seen[0].keys() | seen[1].keys())
            columns = [pa.array(entries, pa.binary()), *(pa.array([c[e] for e in entries], pa.int64()) for c in seen)]
            yield pa.RecordBatch.from_arrays(columns, ["entry", "clean", "toxic"])

    n_clean, n_toxic = (labelled.filter(F.col("label") == k).count() for k in (0, 1))
    weight = F.log((F.col("toxic") + 0.5) / (n_toxic + 1)) - F.log((F.col("clean") + 0.5) / (n_clean + 1))
    rows = (
        labelled.select("text", "label")
        .mapInArrow(count, "entry binary, clean long, toxic long")
        .groupBy("entry")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .filter(F.col("toxic") >= max(3, n_toxic // 500))
        .withColumn("weight", weight)
        .filter(F.col("weight") > log(4))
        .filter(F.col("weight") >= certain * F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5)))
        .select("entry", "weight")
        .collect()
    )
    return {bytes(r.entry): r.weight for r in rows}


@dataclass
class ToxicityModel:
    lexicon: dict[bytes, float]
    prior: float
    trees: GBTClassificationModel | None = None
    calibration: IsotonicRegressionModel | None = None

    def score(self, docs: DataFrame, text: str = "text", name: str = "score") -> DataFrame:
        """Rows of ``docs`` with ``name``, from 0 to 1; one pass, no shuffle, texts stay where they are."""
        if self.trees is None:
            return docs.withColumn(name, F.lit(self.prior))
        rows = _with_features(docs, self.lexicon, text, "__features")
        rows = rows.withColumn("__features", array_to_vector("__features"))
        rows = self.calibration.transform(rows_with_raw(self.trees, rows))
        return rows.withColumn(name, F.greatest(F.lit(0.0), F.least(F.lit(1.0), "__score"))).select(
            *[c for c in docs.columns if c != name], name
        )


def rows_with_raw(trees: GBTClassificationModel, rows: DataFrame) -> DataFrame:
    """Rows with ``__raw``, the trees' margin for the toxic class."""
    return trees.transform(rows).withColumn("__raw", vector_to_array("__margins")[1])


def _with_features(docs: DataFrame, lexicon: dict[bytes, float], text: str, name: str) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)  # bounded by FIT_ROWS, see CERTAIN

    @F.pandas_udf("array<double>")
    def build(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Lexicon(sent.value)
        for texts in batches:
            yield pd.Series([features(t, own) for t in texts], dtype=object)

    return docs.withColumn(name, build(text))


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, text: str = "text", row_id: str = "doc_id",
    label: str = "toxic", fit_rows: int = FIT_ROWS, rounds: int = 20, depth: int = 3, seed: int = 11,
) -> ToxicityModel:
    """Model learned from the labelled rows that ``learn`` (over the id) admits, at most about ``fit_rows``.

    A quarter of them, by a hash of the id, is kept from the trees and calibrates them. Labels that
    are null or neither 0 nor 1 are left out; of repeated labels of an id the larger counts. Without
    rows of both classes in both parts the score is the share of toxic rows (0 without any).
    """
    known = (
        labels.filter(F.col(label).isin(0, 1) & F.col(row_id).isNotNull() & learn)
        .groupBy(row_id).agg(F.max(label).cast("int").alias("label"))
    )
    n = known.count()
    if n > fit_rows:
        known = known.filter(F.pmod(F.xxhash64(F.lit(seed), row_id), F.lit(n)) < fit_rows)
    known = stored(known, "tox-labels")
    # Bounded by fit_rows: texts stay where they are.
    rows = docs.select(row_id, F.col(text).alias("text")).join(F.broadcast(known), row_id)
    part = F.pmod(F.xxhash64(F.lit(seed + 1), row_id), F.lit(4))
    lexicon = mine_lexicon(rows.filter(part != 0))
    seen = stored(
        _with_features(rows, lexicon, "text", "__features").select(
            (part == 0).alias("held"), F.col("label").cast("double"), "__features"
        ),
        "tox-features",
    )
    share = {(r.held, r.label): r["count"] for r in seen.groupBy("held", "label").count().collect()}
    total = sum(share.values())
    prior = sum(v for (_, y), v in share.items() if y) / total if total else 0.0
    if any((held, y) not in share for held in (False, True) for y in (0.0, 1.0)):
        return ToxicityModel(lexicon, prior)
    seen = seen.withColumn("__features", array_to_vector("__features"))
    boosting = GBTClassifier(
        featuresCol="__features", labelCol="label", predictionCol="__prediction", maxIter=rounds, maxDepth=depth,
        stepSize=0.3, seed=seed, maxBins=64,
    )
    boosting = boosting.setRawPredictionCol("__margins").setProbabilityCol("__probability")
    trees = boosting.fit(seen.filter(~F.col("held")))
    calibration = IsotonicRegression(featuresCol="__raw", labelCol="label", predictionCol="__score").fit(
        rows_with_raw(trees, seen.filter("held"))
    )
    return ToxicityModel(lexicon, prior, trees, calibration)


def _learns(row_id: str = "doc_id") -> Column:
    return F.pmod(crc32_of_id(row_id), F.lit(5)) != 0


def toxicity_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model that never saw the labels of the held-out ones."""
    scored = fit(docs, labels, _learns()).score(docs.select("doc_id", "text"))
    return scored.select(
        "doc_id", (~_learns()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``; each row is judged on its own text, and keeps its columns whatever their names."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(text).alias("text"))
    scored = fit(docs, labels, _learns(), text).score(whole, "text", "score")
    return scored.filter(F.col("score") < threshold).select("row.*")
