"""Texts as blocks of documents with a dictionary each: words cross the cluster once a block, not once a use.

A block is a stretch of documents of one task. Its distinct words are dealt into buckets by a hash
and packed, a row for each bucket; its texts are packed sequences of word numbers, that is, the
positions. Buckets bring equal words of all blocks together, so each distinct word is worked on
once; what was found goes back, packed likewise, and a cogroup on the block puts values and
positions together.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwire.llm.common import bytes_of, stored

BLOCK_BYTES = 12 << 20
#: Text for each bucket of words, about, up to the most buckets. A task streams a bucket and holds its distinct
#: words, a 4,096th of the vocabulary at most, which grows far slower than the text; more buckets would make packs of single words.
BUCKET_BYTES, MOST_BUCKETS = 16 << 20, 4096
CHUNK_WORDS = 1 << 18
#: Words of a block that are numbered by frequency; the others follow by bucket and spelling, which needs no table.
FREQUENT = 1 << 13
SCHEMA = "block string, bucket int, words binary, ids array<long>, counted array<boolean>, codes binary"


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=9).compress(data)


def _expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_numbers(values: np.ndarray) -> bytes:
    """Non-negative numbers below 2^32: a byte each, and what exceeds it in byte planes of its own.

    Small numbers, which are most, so keep a stream whose bytes are all alike in kind.
    """
    small = np.minimum(values, 255).astype(np.uint8)
    large = (values[small == 255] - 255).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return len(small).to_bytes(8, "little") + _squeeze(small.tobytes() + np.ascontiguousarray(large).tobytes())


def unpack_numbers(data: bytes) -> np.ndarray:
    n, plain = int.from_bytes(data[:8], "little"), _expand(data[8:])
    small = np.frombuffer(plain, dtype=np.uint8, count=n)
    large = np.ascontiguousarray(np.frombuffer(plain, dtype=np.uint8, offset=n).reshape(4, -1).T).view("<u4").reshape(-1)
    out = small.astype(np.uint32)
    out[small == 255] += large
    return out


def pack_ragged(lengths: list[int], values: np.ndarray | list[int]) -> bytes:
    """Lists of numbers: how many, their lengths, their values one after the other."""
    return pack_numbers(np.concatenate(([len(lengths)], np.array(lengths, dtype=np.int64), np.array(values, dtype=np.int64))))


def pack_lists(lists: list[np.ndarray]) -> bytes:
    return pack_ragged([len(x) for x in lists], np.concatenate(lists) if lists else [])


def unpack_lists(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values)"""
    numbers = unpack_numbers(data)
    return numbers[1 : numbers[0] + 1].astype(np.int64), numbers[numbers[0] + 1 :].astype(np.int64)


def pack_runs(lengths: list[int], values: list[int]) -> bytes:
    """Lists of numbers whose neighbours are alike: values stay whole, so that repeats of several compress away."""
    wide = max(values, default=0) >= 1 << 16
    head = pack_numbers(np.array([int(wide), *lengths], dtype=np.int64))
    return len(head).to_bytes(4, "little") + head + _squeeze(np.array(values, dtype="<u4" if wide else "<u2").tobytes())


def unpack_runs(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values)"""
    n = int.from_bytes(data[:4], "little")
    wide, *_ = head = unpack_numbers(data[4 : 4 + n])
    return head[1:].astype(np.int64), np.frombuffer(_expand(data[4 + n :]), dtype="<u4" if wide else "<u2").astype(np.int32)


def release() -> None:
    """Give the memory that Arrow keeps for reuse back: workers live on after their task."""
    pa.default_memory_pool().release_unused()


def pack_words(words: list[bytes], uses: list[int]) -> bytes:
    lengths = np.array([len(w) for w in words])
    numbers = pack_lists([lengths, np.array(uses)])
    return len(numbers).to_bytes(4, "little") + numbers + _squeeze(b"".join(words))


def unpack_words(data: bytes) -> tuple[list[bytes], np.ndarray]:
    """(words, uses of each)"""
    n = int.from_bytes(data[:4], "little")
    _, numbers = unpack_lists(data[4 : 4 + n])
    lengths, uses = np.split(numbers, 2)
    ends, text = np.cumsum(lengths).tolist(), _expand(data[4 + n :])
    return [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else [], uses


class _Block:
    """Documents that share a dictionary. Words are numbered as met, and in the end by bucket and spelling."""

    def __init__(self, name: str, buckets: int):
        self.name, self.buckets = name, buckets
        self.numbers: dict[bytes, int] = {}
        self.texts: list[tuple[int | None, bool, np.ndarray]] = []
        self.size = 0

    def add(self, key: int | None, counted: bool, words: list[bytes]) -> None:
        numbers = self.numbers
        found = [numbers.setdefault(w, len(numbers)) for w in words]
        self.texts.append((key, counted, np.array(found, dtype=np.uint32)))
        self.size += sum(map(len, words)) + 1

    def rows(self) -> Iterator[pa.RecordBatch]:
        n = len(self.numbers)
        none = np.zeros(0, dtype=np.uint32)
        every = np.bincount(np.concatenate([none, *(t[2] for t in self.texts)]), minlength=n)
        uses = np.bincount(np.concatenate([none, *(t[2] for t in self.texts if t[1])]), minlength=n)
        words = list(self.numbers)
        bucket = np.array([zlib.crc32(w) % self.buckets for w in words], dtype=np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        edges = np.nonzero(np.diff(bucket[by_bucket], prepend=-1, append=-1))[0] if n else []
        spelled: list[int] = []
        for first, last in zip(edges[:-1], edges[1:], strict=True) if n else ():
            part = sorted(by_bucket[first:last].tolist(), key=words.__getitem__)
            spelled += part
            packed = pack_words([words[i] for i in part], uses[part].tolist())
            yield _row(self.name, int(bucket[part[0]]), packed, None, None, None)
        order = np.array(spelled, dtype=np.int64)
        frequent = np.argsort(-every[order], kind="stable")[:FREQUENT]
        rank = np.empty(n, dtype=np.uint32)
        rank[order] = numbers_of(frequent, n)
        # Where the frequent words stand in the order in which the buckets' values will come back.
        yield _row(self.name, -1, None, None, None, pack_numbers(frequent))
        at, held = 0, 0
        for end, text in enumerate(self.texts, 1):
            held += len(text[2])
            if held >= CHUNK_WORDS or end == len(self.texts):
                part = self.texts[at:end]
                codes = pack_lists([rank[t[2]] for t in part])
                yield _row(self.name, -2, None, [t[0] for t in part], [t[1] for t in part], codes)
                at, held = end, 0


def _row(block: str, bucket: int, words: bytes | None, ids: list | None, counted: list | None, codes: bytes | None):
    kinds = (pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary())
    values = (block, bucket, words, ids, counted, codes)
    return pa.RecordBatch.from_arrays(
        [pa.array([v], k) for v, k in zip(values, kinds, strict=True)], ["block", "bucket", "words", "ids", "counted", "codes"]
    )


def numbers_of(frequent: np.ndarray, n: int) -> np.ndarray:
    """Numbers of ``n`` words in their order by bucket and spelling: the frequent ones first, in their own order."""
    numbers = np.empty(n, dtype=np.int64)
    rare = np.ones(n, dtype=bool)
    rare[frequent] = False
    numbers[frequent] = np.arange(len(frequent))
    numbers[rare] = np.arange(len(frequent), n)
    return numbers


@dataclass
class Blocks:
    words: DataFrame  # block, bucket, words
    texts: DataFrame  # of, ids, counted, codes; also the ranks of the block's words
    buckets: int


def write_blocks(docs: DataFrame, split: Callable[[str], list[bytes]], name: str, block_bytes: int = BLOCK_BYTES) -> Blocks:
    """Blocks of ``docs`` (id long, text, counted boolean), written once.

    ``uses`` of a word count documents that are ``counted`` only. A block ends once its words reach
    ``block_bytes``; a single longer text is a block of its own.
    """
    buckets = max(16, min(MOST_BUCKETS, bytes_of(docs, "text") // BUCKET_BYTES))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        block = _Block(f"{part}-{made}", buckets)
        for batch in batches:
            for key, text, counted in zip(*(batch.column(i) for i in range(3)), strict=True):
                block.add(key.as_py(), bool(counted.as_py()), split(text.as_py() or ""))
                if block.size >= block_bytes:
                    yield from block.rows()
                    made += 1
                    block = _Block(f"{part}-{made}", buckets)
                    release()
        if block.texts:
            yield from block.rows()
        del block
        release()

    out = stored(docs.select("id", "text", "counted").mapInArrow(build, SCHEMA), name)
    words = out.filter("bucket >= 0").select("block", "bucket", "words")
    texts = out.filter("bucket < 0").select(F.col("block").alias("of"), "ids", "counted", "codes")
    return Blocks(words, texts, buckets)


def by_bucket(words: DataFrame) -> DataFrame:
    """Word rows with those of a bucket together in one task, one bucket after the other."""
    return words.repartition("bucket").sortWithinPartitions("bucket")


def read_texts(texts: pa.Table, n: int) -> tuple[np.ndarray, Iterator[tuple[int | None, bool, np.ndarray]]]:
    """Of the document rows of a block: numbers of its ``n`` words in the order of their values, and its documents."""
    rows = list(zip(texts["ids"].to_pylist(), texts["counted"].to_pylist(), texts["codes"].to_pylist(), strict=True))
    ranks = numbers_of(next(unpack_numbers(c).astype(np.int64) for i, _, c in rows if i is None), n)

    def documents() -> Iterator[tuple[int | None, bool, np.ndarray]]:
        for ids, counted, codes in rows:
            if ids is not None:
                lengths, values = unpack_lists(codes)
                parts = np.split(values, np.cumsum(lengths)[:-1]) if len(lengths) else []
                yield from zip(ids, counted, parts, strict=True)

    return ranks, documents()


def reassemble(
    values: DataFrame, texts: DataFrame, build: Callable[[pa.Table, pa.Table], pa.Table], schema: str
) -> DataFrame:
    """``build(value rows of a block by bucket, its document rows)`` for every block, which bounds a call's memory."""

    def ordered(found: pa.Table, own: pa.Table) -> pa.Table:
        release()
        return build(found.sort_by("bucket"), own)

    return values.groupBy("block").cogroup(texts.groupBy("of")).applyInArrow(ordered, schema)
