"""Language-model scores by Brown classes: exchange clustering, class transitions, word emission.

The exchange is the distributed kind: all workers weigh moves against the same counts of a pass.
It runs over units: words of at least ``least`` training uses are units by a hash, and all rarer words
that share their last two bytes are one, so that rare and unknown words have a class, too. A unit is a
number that follows from the word alone, whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwire.llm.blocks import by_bucket, pack_lists, read_texts, reassemble, unpack_lists, unpack_words, write_blocks
from siftwire.llm.common import crc32_of_id, stored

CLASSES = 120  # twice as many must fit a byte
#: Numbers of units: 0 is the end, then endings of one and of two bytes, then hashes of words. It bounds what is
#: broadcast and held by the driver, at every size of corpus: a byte a unit.
ENDINGS, HASHES = 1 + 256 + 65_536, 1 << 20
UNITS = ENDINGS + HASHES
LEAST_USES = 5
#: Passes go on while two of them, over even and odd units, raise the likelihood by this part of it.
LEAST_GAIN = 1e-3
END = b""  # no word is empty
_FLUSH = 2_000_000
_PACK = np.dtype([("c", "u1"), ("n", "<u4")])
CODED = "id long, counted boolean, n_tokens long, n_known long, base_score double, known double, units binary"


def tokens(text: str) -> list[bytes]:
    return [*text.encode("utf-8", "replace").lower().split(), END]


@dataclass
class ClassModel:
    """Log10 probabilities of classes and of words in them."""

    steps: np.ndarray  # class of the word before x class
    known: np.ndarray  # added to log10(uses - discount) of a word
    unknown: np.ndarray

    @classmethod
    def of(cls, pairs: np.ndarray, words: np.ndarray, discount: float) -> ClassModel:
        """From counts of class pairs and of distinct words a class, by absolute discounting."""
        uses = pairs.sum(axis=0)
        share = (uses + 0.1) / (uses.sum() + 0.1 * len(uses))
        before = pairs.sum(axis=1, keepdims=True)
        kinds = (pairs > 0).sum(axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            steps = (np.maximum(pairs - 0.5, 0) + 0.5 * kinds * share) / before
            steps = np.where(before > 0, steps, share)
            known = -np.log10(np.maximum(uses, 1))
            unknown = np.log10(np.where(uses * words > 0, discount * words / np.maximum(uses, 1), 1.0))
        return cls(np.log10(steps), known, unknown)


def _vocabulary(words: DataFrame) -> DataFrame:
    """(bucket, word, n) of all words with uses; a bucket's words are added up by one task."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, uses = None, {}

        def flush() -> pa.RecordBatch:
            found = {w: n for w, n in uses.items() if n}
            columns = [pa.array([bucket] * len(found), pa.int32()), pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["bucket", "word", "n"])

        for batch in batches:
            for number, packed in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist(), strict=True):
                if number != bucket:
                    if uses:
                        yield flush()
                    bucket, uses = number, {}
                for word, n in zip(*(x if isinstance(x, list) else x.tolist() for x in unpack_words(packed)), strict=True):
                    uses[word] = uses.get(word, 0) + n
        if uses:
            yield flush()

    return by_bucket(words).mapInArrow(add_up, "bucket int, word binary, n long")


def ending_unit(word: bytes) -> int:
    """The unit of a rare or unknown word: that of its last two bytes."""
    last = word[-2:]
    return 1 + last[0] if len(last) == 1 else 257 + (last[0] << 8) + last[1] if last else 0


def _unit(word: str, frequent: Column) -> Column:
    """The unit of a word of the vocabulary; the same numbers as ``ending_unit`` where it is not frequent."""
    last = F.conv(F.hex(F.substring(word, -2, 2)), 16, 10).cast("int")
    ending = F.when(F.octet_length(word) == 0, 0).when(F.octet_length(word) == 1, 1 + last).otherwise(257 + last)
    hashed = ENDINGS + F.pmod(F.crc32(word), F.lit(HASHES)).cast("int")
    return F.when(frequent & (F.octet_length(word) > 0), hashed).otherwise(ending)


def likelihood(pairs: np.ndarray) -> float:
    """What class transitions and class sizes add to the log likelihood of the training texts."""
    parts = [x[x > 0] for x in (pairs.ravel(), pairs.sum(axis=0), pairs.sum(axis=1))]
    whole, uses, before = (float((x * np.log(x)).sum()) for x in parts)
    return whole - uses - before


def _sequences(batch: pa.RecordBatch, column: str) -> list[np.ndarray]:
    return [np.frombuffer(p, dtype="<i4").astype(np.int64) for p in batch.column(column).to_pylist()]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Sequences of all rows, some million units at a time."""
    held, size = [], 0
    for batch in batches:
        for packed in batch.column("units"):
            held.append(np.frombuffer(packed.as_buffer(), dtype="<i4").astype(np.int64))
            size += len(held[-1])
            if size >= _FLUSH:
                yield held
                held, size = [], 0
    if held:
        yield held


def _pairs(sequences: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray]:
    """Neighbouring units of all texts; each begins after an end."""
    joined = np.concatenate(sequences)
    joined = np.where(joined < 0, -joined - 1, joined)
    before = np.concatenate(([end], joined[:-1]))  # every text ends with the end, so the next one begins after it
    return before, joined


def class_pairs(coded: DataFrame, classes: np.ndarray, n: int, end: int) -> np.ndarray:
    """Counts of neighbouring classes over all training texts."""
    sent = coded.sparkSession.sparkContext.broadcast(classes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n * n, dtype=np.int64)
        for sequences in _slices(batches):
            before, unit = _pairs(sequences, end)
            total += np.bincount(sent.value[before].astype(np.int64) * n + sent.value[unit], minlength=n * n)
        seen = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["pair", "n"])

    rows = coded.filter("counted").select("units").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    out = np.zeros(n * n)
    for r in rows.collect():  # at most n * n
        out[r.pair] = r.n
    sent.destroy()
    return out.reshape(n, n)


def _packed(keys: np.ndarray, n: int) -> pa.RecordBatch:
    """Contexts of units, a row each: keys are unit * 2n + class before, or + n + class after."""
    keys, uses = np.unique(keys, return_counts=True)
    pack = np.empty(len(keys), dtype=_PACK)
    pack["c"], pack["n"] = keys % (2 * n), uses
    unit = (keys // (2 * n)).astype(np.int32)
    first = np.concatenate(([0], np.nonzero(unit[1:] != unit[:-1])[0] + 1)) if len(unit) else np.zeros(0, dtype=np.int64)
    offsets = np.concatenate((first, [len(keys)])).astype(np.int32) * _PACK.itemsize
    column = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(pack.tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(unit[first]), column], ["unit", "pack"])


def exchange(coded: DataFrame, classes: np.ndarray, pairs: np.ndarray, moves: np.ndarray, end: int) -> np.ndarray:
    """Classes after one pass: each unit that ``moves`` goes where its neighbours make it likeliest.

    Contexts are added up in the tasks that read them, then per unit; what comes back is one class
    for each unit, of which there are ``UNITS``.
    """
    n = len(pairs)
    context = coded.sparkSession.sparkContext.broadcast((classes, moves))
    uses = np.maximum(pairs.sum(axis=0), 1)
    after_class = np.log((pairs + 0.05) / uses[None, :])  # [class before, own class]
    before_class = np.log((pairs + 0.05) / uses[:, None]).T  # [class after, own class]
    weights = np.concatenate((after_class, before_class))
    weights[:, classes[end]] = -np.inf  # the end stays alone in its class

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, may = context.value
        for sequences in _slices(batches):
            before, unit = _pairs(sequences, end)
            left, right = may[unit], may[before]
            keys = (unit[left] * (2 * n) + of[before[left]], before[right] * (2 * n) + n + of[unit[right]])
            yield _packed(np.concatenate(keys).astype(np.uint32), n)  # UNITS * 2n is below 2^32

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_unit, open_sum = None, np.zeros(2 * n)

        def choose(units: np.ndarray, sums: np.ndarray) -> pa.RecordBatch:
            allowed = np.where(np.isinf(weights), 0, weights)
            score = np.where(np.isinf(weights[0]), -np.inf, sums @ allowed)
            return pa.RecordBatch.from_arrays(
                [pa.array(units, pa.int32()), pa.array(score.argmax(axis=1), pa.int32())], ["unit", "class"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            unit = batch.column("unit").to_numpy()
            packs = batch.column("pack").to_pylist()
            pack = np.frombuffer(b"".join(packs), dtype=_PACK)
            units, index = np.unique(unit, return_inverse=True)
            rows = np.repeat(index, [len(p) // _PACK.itemsize for p in packs])
            sums = np.bincount(rows * (2 * n) + pack["c"], weights=pack["n"], minlength=len(units) * 2 * n).reshape(-1, 2 * n)
            if open_unit is not None:
                if units[0] == open_unit:
                    sums[0] += open_sum
                else:
                    yield choose(np.array([open_unit]), open_sum[None, :])
            open_unit, open_sum = int(units[-1]), sums[-1]
            if len(units) > 1:
                yield choose(units[:-1], sums[:-1])
        if open_unit is not None:
            yield choose(np.array([open_unit]), open_sum[None, :])

    decided = (
        coded.filter("counted").select("units").mapInArrow(contexts, "unit int, pack binary")
        .repartition("unit").sortWithinPartitions("unit").mapInArrow(decide, "unit int, class int")
    )
    found = decided.toPandas()
    context.destroy()
    out = classes.copy()
    out[found["unit"].to_numpy()] = found["class"].to_numpy().astype(np.uint8)
    return out


def score_texts(
    docs: DataFrame, learn: Column, text: str = "text", row_id: str = "doc_id", classes: int = CLASSES,
    least: int = LEAST_USES, least_gain: float = LEAST_GAIN, exchanges: bool = True,
) -> DataFrame:
    """(row_id, learned, n_tokens, n_known, train_tokens, base_score, score) of every text.

    The model learns from the rows that ``learn`` admits, and scores all. Words are told apart by
    A-Z lower-cased bytes between white space; each text has an end, which is a token. A null or
    empty text is its end alone. Repeated rows count and are scored each; without any row to learn
    from, every class and word is as likely as the rest allows and the scores are those of an empty
    count table. Frequent words whose hashes are equal share a class, not their uses.
    """
    rows = docs.select(F.col(row_id).cast("long").alias("id"), F.col(text).alias("text"), learn.alias("counted"))
    blocks = write_blocks(rows, tokens, "lm-blocks")
    vocabulary = stored(_vocabulary(blocks.words), "lm-words")
    stats = vocabulary.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("N"), F.count("*").alias("V"), F.count_if(F.col("n") == 1).alias("n1"),
        F.count_if(F.col("n") == 2).alias("n2"),
    ).first()
    n_all, n_words = stats.N, stats.V
    discount = stats.n1 / (stats.n1 + 2 * stats.n2) if stats.n1 and stats.n2 else 0.5
    vocabulary = vocabulary.withColumn("unit", _unit("word", F.col("n") >= least))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A bucket's vocabulary comes first, then its words block by block: only the vocabulary is held."""
        bucket, facts = None, {}
        for batch in batches:
            out = []
            for number, word, n, unit, block, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number != bucket:
                    bucket, facts = number, {}
                if block is None:
                    facts[word] = (n, unit)
                    continue
                names, _ = unpack_words(packed)
                found = [facts.get(w) or (0, ending_unit(w)) for w in names]
                out.append((block, number, pack_lists([np.array([n for n, _ in found]), np.array([u for _, u in found])])))
            if out:
                kinds = (pa.string(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["block", "bucket", "facts"])

    told = vocabulary.select("bucket", "word", "n", "unit", F.lit(None).cast("string").alias("block"), F.lit(None).cast("binary").alias("words"))
    both = told.unionByName(blocks.words, allowMissingColumns=True).repartition("bucket").sortWithinPartitions("bucket", F.asc_nulls_first("block"))
    values = both.mapInArrow(look_up, "block string, bucket int, facts binary")

    def code(values: pa.Table, texts: pa.Table) -> pa.Table:
        parts = [np.split(unpack_lists(x)[1], 2) for x in values["facts"].to_pylist()]
        ranks, documents = read_texts(texts, sum(len(p[0]) for p in parts))
        uses, unit = np.empty_like(ranks), np.empty_like(ranks)
        uses[ranks], unit[ranks] = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        base = np.log10((uses + 0.1) / (n_all + 0.1 * (n_words + 1)))
        known = np.where(uses > 0, np.log10(np.maximum(uses - discount, 1e-9)), 0.0)
        packed = np.where(uses > 0, unit, -unit - 1).astype("<i4")
        out = []
        for key, counted, codes in documents:
            sums = (len(codes), int((uses[codes] > 0).sum()), float(base[codes].sum()), float(known[codes].sum()))
            out.append((key, counted, *sums, packed[codes].tobytes()))
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())
        return pa.table([pa.array([o[i] for o in out], kind) for i, kind in enumerate(kinds)], names=[c.split()[0] for c in CODED.split(", ")])

    coded = stored(reassemble(values, blocks.texts, code, CODED), "lm-coded")

    # Every frequent unit starts a class of its own, all others share one; the end keeps class 0.
    end = 0
    by_uses = vocabulary.filter(F.col("unit") != end).groupBy("unit").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "unit")
    heads = [r.unit for r in by_uses.limit(classes - 2).collect()]
    of = np.full(UNITS, classes - 1, dtype=np.uint8)
    of[end] = 0
    of[heads] = np.arange(1, len(heads) + 1)
    pairs = class_pairs(coded, of, classes, end)
    even = np.arange(UNITS) % 2 == 0
    others = np.ones(UNITS, dtype=bool)
    others[heads] = False
    steps, best = [others], likelihood(pairs)
    while exchanges and best < 0:
        before, kept = best, (of, pairs)
        for moves in steps:
            moves = moves & (np.arange(UNITS) != end)
            of = exchange(coded, of, pairs, moves, end)
            pairs = class_pairs(coded, of, classes, end)
        best = likelihood(pairs)
        if best < before:
            best, (of, pairs) = before, kept
        if len(steps) > 1 and best - before < least_gain * abs(before):
            break
        steps = [even, ~even]
    sent = rows.sparkSession.sparkContext.broadcast(of)

    def count_kinds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes, dtype=np.int64)
        for batch in batches:
            total += np.bincount(sent.value[batch.column(0).to_numpy()], minlength=classes)
        yield pa.RecordBatch.from_arrays([pa.array(range(classes), pa.int32()), pa.array(total)], ["class", "words"])

    kinds = np.zeros(classes)
    for r in vocabulary.select("unit").mapInArrow(count_kinds, "class int, words long").groupBy("class").agg(F.sum("words").alias("words")).collect():
        kinds[r["class"]] = r.words
    model = ClassModel.of(pairs, kinds, discount)
    modelled = rows.sparkSession.sparkContext.broadcast((of, model))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, model = modelled.value
        for batch in batches:
            out = []
            for known, seq in zip(batch.column("known").to_pylist(), _sequences(batch, "units"), strict=True):
                new = seq < 0
                cls = of[np.where(new, -seq - 1, seq)]
                steps = model.steps[np.concatenate(([of[end]], cls[:-1])), cls].sum()
                out.append(known + steps + np.where(new, model.unknown[cls], model.known[cls]).sum())
            kept = [batch.column(c) for c in ("id", "counted", "n_tokens", "n_known", "base_score")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.float64())], ["id", "counted", "n_tokens", "n_known", "base_score", "score"])

    scored = coded.mapInArrow(score, "id long, counted boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(
        F.col("id").alias(row_id), F.col("counted").alias("learned"), "n_tokens", "n_known",
        F.lit(n_all).cast("long").alias("train_tokens"), "base_score", "score",
    )


def perplexity(scored: DataFrame, score: str = "score") -> F.Column:
    """Perplexity of a text from its log10 probability and number of tokens."""
    return F.pow(F.lit(10.0), -F.col(score) / F.col("n_tokens"))


def brown_digest(docs: DataFrame) -> DataFrame:
    learn = F.pmod(crc32_of_id("doc_id"), F.lit(10)) != 0
    scored = score_texts(docs, learn)
    return scored.select(
        "doc_id", (~F.col("learned")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score",
        perplexity(scored).alias("perplexity"),
    )
