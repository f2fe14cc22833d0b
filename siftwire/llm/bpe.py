"""Byte-level BPE: every distinct pre-token of the corpus is encoded once, ids come back by a join."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwire.llm.blocks import BLOCK_BYTES, by_bucket, pack_runs, read_texts, reassemble, release, unpack_runs, unpack_words, write_blocks

#: Bound of a rank file: what is sent to every executor and held by each task.
MAX_RANKS = 1_000_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Rank file: one line per token, base64 of its bytes and its rank."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    if len(ranks) > MAX_RANKS:
        raise ValueError(f"{path} has {len(ranks)} ranks; at most {MAX_RANKS} are broadcast")
    return ranks


@cache
def _pattern(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def encode_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of lowest rank merges first, the leftmost among equals."""
    if (whole := ranks.get(word)) is not None:
        return [whole]
    parts = [word[i : i + 1] for i in range(len(word))]
    return _merge_short(parts, ranks) if len(parts) <= 64 else _merge_long(parts, ranks)


def _merge_short(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    none = MAX_RANKS + 1
    pairs = [ranks.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while pairs and (low := min(pairs)) < none:
        i = pairs.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same for long pre-tokens in n log n: a heap of pairs over a linked list of parts."""
    n = len(parts)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, bytes]] = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] < n:
            pair = parts[i] + parts[after[i]]
            if (rank := ranks.get(pair)) is not None:
                heapq.heappush(heap, (rank, i, pair))

    for i in range(n):
        offer(i)
    while heap:
        _, i, pair = heapq.heappop(heap)
        if not parts[i] or after[i] >= n or parts[i] + parts[after[i]] != pair:
            continue  # a part of it has merged meanwhile
        gone = after[i]
        parts[i], parts[gone] = pair, b""
        after[i] = after[gone]
        if after[i] < n:
            before[after[i]] = i
        offer(before[i])
        offer(i)
    return [ranks[p] for p in parts if p]


def encode(
    docs: DataFrame, ranks_path: str, pattern: str, text: str = "text", row_id: str = "doc_id",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(row_id, ids array<int>) of every row: each match of ``pattern`` encoded on its own, no special tokens.

    Pre-tokens are exploded into the distinct words of a block of documents and their positions. The
    words of all blocks meet in buckets, where each distinct one is encoded once; the ids go back to
    their blocks and every text is put together by position. A null or empty text has no ids; repeated
    rows and null ids stay rows of their own.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(ranks_path))

    def split(value: str) -> list[bytes]:
        return [w.encode("utf-8", "replace") for w in _pattern(pattern).findall(value)]

    class Encoded(dict):
        """Ids of the words of a bucket, found at the first use."""

        def __missing__(self, word: bytes) -> list[int]:
            self[word] = ids = encode_word(word, ranks.value)
            return ids

    def encode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, known = None, Encoded()
        for batch in batches:
            out = []
            for number, packed in zip(batch.column("bucket").to_pylist(), batch.column("words").to_pylist(), strict=True):
                if number != bucket:
                    bucket, known = number, Encoded()
                found = [known[w] for w in unpack_words(packed)[0]]
                out.append(pack_runs([len(x) for x in found], list(chain.from_iterable(found))))
            yield pa.RecordBatch.from_arrays(
                [batch.column("block"), batch.column("bucket"), pa.array(out, pa.binary())], ["block", "bucket", "ids"]
            )
        known.clear()
        release()

    def put_together(values: pa.Table, texts: pa.Table) -> pa.Table:
        found = [unpack_runs(x) for x in values["ids"].to_pylist()]
        lengths = np.concatenate([np.zeros(0, dtype=np.int64), *(x[0] for x in found)])
        flat = np.concatenate([np.zeros(0, dtype=np.int32), *(x[1] for x in found)])
        del found
        ranks_of, documents = read_texts(texts, len(lengths))
        length, start = np.empty_like(lengths), np.empty_like(lengths)
        length[ranks_of], start[ranks_of] = lengths, np.cumsum(lengths) - lengths
        keys, parts, offsets = [], [], [0]
        for key, _, codes in documents:
            own = length[codes]
            ends = np.cumsum(own)
            total = int(ends[-1]) if len(ends) else 0
            keys.append(key)
            parts.append(flat[np.repeat(start[codes] - (ends - own), own) + np.arange(total)])
            offsets.append(offsets[-1] + total)
        whole = np.empty(offsets[-1], dtype=np.int32)
        for first, last, part in zip(offsets, offsets[1:], parts, strict=False):
            whole[first:last] = part
        del parts
        ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(whole))
        return pa.table([pa.array(keys, pa.int64()), ids], names=["id", "ids"])

    rows = docs.select(F.col(row_id).cast("long").alias("id"), F.col(text).alias("text"), F.lit(False).alias("counted"))
    blocks = write_blocks(rows, split, "bpe-blocks", block_bytes)
    values = by_bucket(blocks.words).mapInArrow(encode_words, "block string, bucket int, ids binary")
    return reassemble(values, blocks.texts, put_together, "id long, ids array<int>").withColumnRenamed("id", row_id)


def decode(encoded: DataFrame, ranks_path: str, ids: str = "ids", name: str = "decoded") -> DataFrame:
    """Rows with ``name``, the bytes that their ids stand for; a null list gives no bytes, an unknown id fails.

    The token table is bounded by its file, so the join is map-side: every task looks ids up in order.
    """
    tokens = {rank: token for token, rank in load_ranks(ranks_path).items()}
    table = encoded.sparkSession.sparkContext.broadcast([tokens.get(i) for i in range(max(tokens) + 1)])

    @F.arrow_udf("binary")
    def look_up(column: pa.Array) -> pa.Array:
        own, out = table.value, []
        for row in column:
            found = row.values  # None for a null list
            out.append(b"" if found is None else b"".join([own[i] for i in found.to_pylist()]))
        return pa.array(out, pa.binary())

    return encoded.withColumn(name, look_up(ids))


def round_trip_digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Token counts and digests of the ids and of the bytes that they decode to."""
    ids = encode(docs, ranks_path, pattern)
    return decode(ids, ranks_path).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
