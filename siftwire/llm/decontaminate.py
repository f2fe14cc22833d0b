"""Benchmark passages in training text, found with one FM-index per shard of documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwire.llm.fm_index import FmIndex

WINDOW = 13
SHARD_BYTES = 8 << 20
#: Benchmark text searched for at a time, and so what is broadcast; a larger benchmark takes more passes.
BLOCK_BYTES = 8 << 20
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_KEPT = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_TO_SPACE = bytes(b if b in _KEPT else 32 for b in range(256))
SCHEMA = "id long, text_hash long, n_words long, n_hit long, spans array<struct<first:int,end:int>>, items array<string>"
SPAN = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as the contract cuts them, A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").lower().translate(_TO_SPACE).split()


def windows_of(words: list[bytes], width: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]


class Phrases:
    """The distinct windows of a block of benchmark items, and the items that have each."""

    def __init__(self, items: list[tuple[str, str | None]], width: int = WINDOW):
        self.width = width
        holders: dict[tuple[bytes, ...], list[str]] = {}
        for item, text in items:
            for window in dict.fromkeys(windows_of(words_of(text), width)):
                holders.setdefault(window, []).append(item)
        self.windows, self.holders = list(holders), list(holders.values())

    def numbered(self, numbers: dict[bytes, int], shift: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows whose words all occur in a shard: their numbers, word numbers (right-aligned), lengths."""
        which, rows, lengths = [], [], []
        for n, window in enumerate(self.windows):
            found = [numbers.get(w, -1) for w in window]
            if min(found) >= 0:
                which.append(n)
                rows.append([0] * (self.width - len(found)) + [f + shift for f in found])
                lengths.append(len(found))
        return np.array(which, dtype=np.int64), np.array(rows, dtype=np.int64).reshape(-1, self.width), np.array(lengths)


def search_shard(texts: list[str | None], phrases: Phrases) -> list[tuple[int, list, list[str]]]:
    """For each text: its number of words, merged hit spans (word numbers) and items with windows in it."""
    numbers: dict[bytes, int] = {}
    parts = [[numbers.setdefault(w, len(numbers)) for w in words_of(t)] for t in texts]
    counts = np.array([len(p) for p in parts], dtype=np.int64)
    which, rows, lengths = phrases.numbered(numbers, len(texts))
    out: list[tuple[int, list, list[str]]] = [(int(n), [], []) for n in counts]
    if not len(which):
        return out
    # Every text ends in a symbol of its own, so no phrase and no tie of suffixes runs on into the next text.
    ends = np.cumsum(counts + 1) - 1
    starts = ends - counts
    text = np.empty(int(ends[-1]) + 1, dtype=np.int64)
    for n, part in enumerate(parts):
        text[starts[n] : ends[n]] = part
        text[starts[n] : ends[n]] += len(texts)
        text[ends[n]] = n
    del parts
    index = FmIndex(text)
    low, high = index.search(rows, lengths)
    uses = high - low
    total = int(uses.sum())
    if not total:
        return out
    phrase = np.repeat(np.arange(len(which)), uses)
    place = index.locate(np.repeat(low - (np.cumsum(uses) - uses), uses) + np.arange(total))
    change = np.zeros(len(text) + 1, dtype=np.int64)
    np.add.at(change, place, 1)
    np.add.at(change, place + lengths[phrase], -1)
    edge = np.diff((np.cumsum(change) > 0).astype(np.int8), prepend=0)
    first, end = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    owner = np.searchsorted(ends, first)
    for doc, a, b in zip(owner.tolist(), (first - starts[owner]).tolist(), (end - starts[owner]).tolist(), strict=True):
        out[doc][1].append({"first": a, "end": b})
    pairs = np.unique(np.searchsorted(ends, place) * len(which) + phrase)
    held: dict[int, set[str]] = {}
    for doc, p in zip((pairs // len(which)).tolist(), (pairs % len(which)).tolist(), strict=True):
        held.setdefault(doc, set()).update(phrases.holders[which[p]])
    for doc, items in held.items():
        out[doc][2].extend(sorted(items))
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of bounded text; a null id is the empty text."""
    block, size = [], 0
    item = F.coalesce(F.col(item_id).cast("string"), F.lit(""))
    for row in benchmark.select(item.alias("item"), F.col(text).alias("text")).toLocalIterator():
        block.append((row.item, row.text))
        size += len(row.text or "")
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def _search(rows: DataFrame, items: list[tuple[str, str]], width: int, shard_bytes: int) -> DataFrame:
    sent = rows.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = Phrases(sent.value, width)
        ids, hashes, texts, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            found = search_shard(texts, phrases)
            columns = [
                pa.array(ids, pa.int64()),
                pa.array(hashes, pa.int64()),
                pa.array([n for n, _, _ in found], pa.int64()),
                pa.array([sum(s["end"] - s["first"] for s in spans) for _, spans, _ in found], pa.int64()),
                pa.array([spans for _, spans, _ in found], SPAN),
                pa.array([held for _, _, held in found], pa.list_(pa.string())),
            ]
            return pa.RecordBatch.from_arrays(columns, ["id", "text_hash", "n_words", "n_hit", "spans", "items"])

        for batch in batches:
            for i in range(batch.num_rows):
                ids.append(batch.column(0)[i].as_py())
                texts.append(batch.column(1)[i].as_py())
                hashes.append(batch.column(2)[i].as_py())
                size += len(texts[-1] or "")
                if size >= shard_bytes:
                    yield flush()
                    ids, hashes, texts, size = [], [], [], 0
        if ids:
            yield flush()

    return rows.select("id", "text", "text_hash").mapInArrow(run, SCHEMA)


def find_passages(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", row_id: str = "doc_id", item_id: str = "item_id",
    item_text: str = "text", width: int = WINDOW, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(row_id, n_words, n_hit, spans, items) of every document: merged spans of words inside benchmark windows.

    Documents are indexed where they lie, in shards of about ``shard_bytes``; nothing shuffles. The
    benchmark is a stated query set, searched for in blocks of ``block_bytes``; with more than one
    block the spans of a document are merged afterwards. A null or empty text has no words, a null
    item text no windows; repeated rows stay, a null id is a row like any other. ``items`` are ids
    as text, sorted.
    """
    rows = docs.select(
        F.col(row_id).cast("long").alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash")
    )
    found = [_search(rows, block, width, shard_bytes) for block in _blocks(benchmark, item_id, item_text, block_bytes)]
    if len(found) <= 1:
        out = found[0] if found else _search(rows, [], width, shard_bytes)
        return out.drop("text_hash").withColumnRenamed("id", row_id)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    # Rows of equal id and text have equal results, so one of them stands for all.
    merged = every.groupBy("id", "text_hash").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    joined = F.expr(
        """aggregate(spans, cast(array() as array<struct<first:int,end:int>>), (done, s) ->
             if(size(done) > 0 and element_at(done, -1).end >= s.first,
                concat(slice(done, 1, size(done) - 1), array(named_struct('first', element_at(done, -1).first,
                       'end', greatest(element_at(done, -1).end, s.end)))),
                concat(done, array(s))))"""
    )
    merged = merged.withColumn("spans", joined).withColumn(
        "n_hit", F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.first)")
    )
    same = merged["id"].eqNullSafe(rows["id"]) & (merged["text_hash"] == rows["text_hash"])
    return rows.join(merged, same).select(rows["id"].alias(row_id), "n_words", "n_hit", "spans", "items")


def contaminated() -> F.Column:
    """A document is contaminated when a twentieth of its words or more are hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))


def cut_spans(text: str | None, spans) -> str | None:
    """``text`` without the words of ``spans`` and what stands between them."""
    if text is None or not len(spans):
        return text
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    places = [m.span() for m in _WORD.finditer(lowered)]
    kept, at = [], 0
    for s in spans:
        kept.append(text[at : places[s["first"]][0]])
        at = places[s["end"] - 1][1]
    return "".join([*kept, text[at:]])


def passage_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return find_passages(docs, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", row_id: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` that are not contaminated. Rows that share an id go together; rows without an id stay."""
    found = find_passages(docs, benchmark, text, row_id)
    bad = found.filter(contaminated()).select(row_id)
    keyless = docs.filter(F.col(row_id).isNull())
    return docs.filter(F.col(row_id).isNotNull()).join(bad, row_id, "left_anti").unionByName(keyless)
