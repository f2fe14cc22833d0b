"""Two tokenizers over the same bytes: groups of tokens that end together, and corpus-wide counts of overlapping ids.

Tokens of both are intervals of bytes. Sorted by start, a group breaks where a start reaches the
running maximum of the ends; inside a group every pair that overlaps is a link. Documents are
worked on in blocks: the distinct id pairs of a block cross the cluster once, are counted over the
corpus, and come back to their block, where each document's links look their counts up.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator
from functools import cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwire.llm.blocks import pack_lists, release, unpack_lists
from siftwire.llm.common import stored

#: Text of a block, about; what a cogroup holds grows with it, not with the corpus.
BLOCK_BYTES = 8 << 20
#: Texts that are handed to a tokenizer at once, about.
BATCH_BYTES = 1 << 18
#: Ids of A and B share one number: A's above, B's below this many bits.
B_BITS = 24
_SPACE = "▁"
#: Characters that all engines sort into letters, numbers and white space alike.
_TAME = re.compile(r"[\t\n\r -~\u00A1-\u024F\u2010-\u2027\u20AC]*+")
#: Runs that may be a single word too long for an engine that looks at all pairs of a word at each merge.
_LONG = re.compile(r"\S{4096}|\s{4096}")


class Tokenizers:
    """A (byte-level, of the tokenizers library) and B (pieces, of sentencepiece), with the bytes of their tokens.

    Where every merge of A makes the next id, its ids are ranks, and tiktoken gives the same tokens in
    a quarter of the time, for texts cut by ``pattern``; texts with unusual characters or endless words
    stay with the library of the file.
    """

    def __init__(self, path_a: str, path_b: str, pattern: str | None = None):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        own = {letter: byte for byte, letter in enumerate(_byte_letters())}
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, number in vocabulary.items():
            if all(letter in own for letter in token):
                self.bytes_a[number] = bytes(own[letter] for letter in token)
        self.bytes_b = [_piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.length_a, self.length_b = (np.array([len(t) for t in x], dtype=np.int64) for x in (self.bytes_a, self.bytes_b))
        self.width = max(len(self.bytes_a), len(self.bytes_b))
        self.written = [f"{i}{sign}" for sign in (",", "|", ";", "") for i in range(self.width)]
        self.ranked = None
        if pattern and _merges_make_ranks(path_a):
            ranks = {token: i for i, token in enumerate(self.bytes_a) if token}
            self.ranked = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode_a(self, spaced: list[str]) -> list[np.ndarray]:
        fast = [self.ranked is not None and _TAME.fullmatch(t) is not None and not _LONG.search(t) for t in spaced]
        others = iter(self.a.encode_batch_fast([t for t, f in zip(spaced, fast, strict=True) if not f], add_special_tokens=False))
        return [(self.ranked.encode_to_numpy(t) if f else np.array(next(others).ids)).astype(np.int64) for t, f in zip(spaced, fast, strict=True)]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """Ids of each text by A (with a space before it) and B; None where the tokens' bytes are not those of the text."""
        spaced = [" " + t for t in texts]
        of_b = self.b.encode(texts, num_threads=1)
        for text, a, b in zip(spaced, self.encode_a(spaced), of_b, strict=True):
            whole = text.encode()
            same = b"".join(map(self.bytes_b.__getitem__, b)) == whole and b"".join(map(self.bytes_a.__getitem__, a.tolist())) == whole
            yield (a, np.array(b, dtype=np.int64)) if same and len(whole) > 1 else None


def _merges_make_ranks(path: str) -> bool:
    """Whether a file's n-th merge makes the n-th id after the bytes, and nothing but merges decides."""
    with open(path, encoding="utf-8") as text:
        told = json.load(text)
    model, before = told["model"], told.get("pre_tokenizer") or {}
    if told.get("normalizer") or model["type"] != "BPE" or model.get("ignore_merges") or model.get("dropout"):
        return False
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
        return False
    merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
    return all(model["vocab"].get(a + b) == 256 + i for i, (a, b) in enumerate(merges))


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def _piece_bytes(piece: str) -> bytes:
    if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace(_SPACE, " ").encode()


@cache
def _tokenizers(path_a: str, path_b: str, pattern: str | None) -> Tokenizers:
    return Tokenizers(path_a, path_b, pattern)


def groups(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, group): all tokens, A's then B's by number, sorted by start, and the group of each in that order.

    A group breaks where a start reaches the running maximum of the ends before it.
    """
    starts = np.concatenate((ends_a, ends_b))
    ends = starts.copy()
    for part in (starts[: len(ends_a)], starts[len(ends_a) :]):
        if len(part):
            part[1:] = part[:-1].copy()
            part[0] = 0
    side = np.repeat([0, 1], [len(ends_a), len(ends_b)])
    order = np.lexsort((side, starts))
    reach = np.maximum.accumulate(ends[order])
    new = np.ones(len(order), dtype=bool)
    new[1:] = starts[order][1:] >= reach[:-1]
    return order, np.cumsum(new) - 1


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (a, b) of all pairs of tokens whose byte ranges overlap; both cover the same bytes."""
    starts_a = np.concatenate(([0], ends_a[:-1])) if len(ends_a) else ends_a
    first = np.searchsorted(ends_b, starts_a, side="right")
    last = np.searchsorted(ends_b, ends_a, side="left")
    n = last - first + 1
    a = np.repeat(np.arange(len(ends_a)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


def written_groups(a: np.ndarray, b: np.ndarray, order: np.ndarray, group: np.ndarray, tokenizers: Tokenizers) -> str:
    """`a1,a2|b1;a3|b2,b3`: ids of A and B of every group in order."""
    side = (order >= len(a)).astype(np.int64)
    by_side = np.lexsort((side, group))  # stable: order of starts inside a side
    order, group, side = order[by_side], group[by_side], side[by_side]
    sign = np.full(len(order), 3)
    sign[:-1] = np.where(group[1:] != group[:-1], 2, np.where(side[1:] != side[:-1], 1, 0))
    codes = sign * tokenizers.width + np.concatenate((a, b))[order]
    return "".join(map(tokenizers.written.__getitem__, codes.tolist()))


_OUT = ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
_BLOCK = "block string, pair long, uses long, docs binary, ids array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, groups array<string>"
_NAMES = [c.split()[0] for c in _BLOCK.split(", ")]
_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.binary(), *[pa.list_(pa.int64())] * 4, pa.list_(pa.string())]


def _rows(*columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS, strict=True)], _NAMES)


class _Block:
    """Documents whose distinct pairs travel together."""

    def __init__(self, name: str):
        self.name, self.size = name, 0
        self.docs: list[tuple] = []
        self.pairs: list[np.ndarray] = []
        self.uses: list[np.ndarray] = []

    def add(self, key: int | None, found: tuple[np.ndarray, np.ndarray] | None, tokenizers: Tokenizers, size: int) -> None:
        self.size += size + 64
        if found is None:
            self.docs.append((key, 0, 0, 0, ""))
            pairs, uses = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        else:
            a, b = found
            ends_a, ends_b = np.cumsum(tokenizers.length_a[a]), np.cumsum(tokenizers.length_b[b])
            order, group = groups(ends_a, ends_b)
            digest = hashlib.sha256(written_groups(a, b, order, group, tokenizers).encode()).hexdigest()
            self.docs.append((key, len(a), len(b), int(group[-1]) + 1, digest))
            i, j = overlaps(ends_a, ends_b)
            pairs, uses = np.unique((a[i] << B_BITS) | b[j], return_counts=True)
        self.pairs.append(pairs)
        self.uses.append(uses)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """One row for each distinct pair, in ascending order, and one with the documents."""
        lengths = np.array([len(p) for p in self.pairs])
        flat, uses = np.concatenate(self.pairs), np.concatenate(self.uses)
        pairs, number = np.unique(flat, return_inverse=True)
        total = np.bincount(number, weights=uses, minlength=len(pairs)).astype(np.int64)
        often = np.argsort(-total, kind="stable")
        rank = np.empty(len(pairs), dtype=np.int64)
        rank[often] = np.arange(len(pairs))
        del flat
        cuts = np.cumsum(lengths)[:-1]
        packed = pack_lists([*np.split(rank[number], cuts), often])
        packed = len(packed).to_bytes(8, "little") + packed + pack_lists(np.split(uses, cuts))
        for i in range(0, len(pairs), 1 << 16):
            n = min(1 << 16, len(pairs) - i)
            none = [None] * n
            yield _rows([self.name] * n, pairs[i : i + n], total[i : i + n], *[none] * 6)
        yield _rows([self.name], [None], [None], [packed], *([list(c)] for c in zip(*self.docs, strict=True)))


def _write_blocks(docs: DataFrame, path_a: str, path_b: str, pattern: str | None, block_bytes: int) -> DataFrame:
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizers, part, made = _tokenizers(path_a, path_b, pattern), TaskContext.get().partitionId(), 0
        block = _Block(f"{part}-{made}")
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            sizes = [len(t) for t in texts]
            starts = list(accumulate(sizes, initial=0))
            at = 0
            while at < len(texts):
                end = at + 1
                while end < len(texts) and starts[end + 1] - starts[at] <= BATCH_BYTES:
                    end += 1
                for n, found in zip(range(at, end), tokenizers.encode(texts[at:end]), strict=True):
                    block.add(keys[n], found, tokenizers, sizes[n])
                    if block.size >= block_bytes:
                        yield from block.rows()
                        made += 1
                        block = _Block(f"{part}-{made}")
                        release()
                at = end
        if block.docs:
            yield from block.rows()
        del block
        release()

    return stored(docs.mapInArrow(build, _BLOCK), "aligned-blocks")


def align(
    docs: DataFrame, path_a: str, path_b: str, pattern: str | None = None, text: str = "text", row_id: str = "doc_id",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row for each row of ``docs``: its tokens by A and B, groups, links, and how common the links are.

    A encodes a space and the text, B the text, which it puts a space before. Where the bytes of
    either's tokens are not those of space and text, and for a null or empty text, there are no tokens:
    zeros and an empty ``groups_sha256``. ``n_best`` counts links whose pair is, over all rows, the
    most frequent of its B id, ties included; ``count_sum`` adds up the frequencies of the pairs of
    all links. ``pattern``, if given, is what A cuts texts by. Null ids and repeated rows are rows like any other. Both tokenizers are files that every executor has.
    """
    rows = docs.select(F.col(row_id).cast("long").alias("id"), F.col(text).alias("text"))
    blocks = _write_blocks(rows, path_a, path_b, pattern, block_bytes)
    pairs = blocks.filter("pair is not null").select("block", "pair", "uses")
    b_id = F.col("pair").bitwiseAND((1 << B_BITS) - 1).alias("b")
    counts = stored(pairs.groupBy("pair").agg(F.sum("uses").alias("count")), "pair-counts")
    highest = counts.groupBy(b_id).agg(F.max("count").alias("top"))
    counts = counts.withColumn("b", b_id).join(highest, "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best"))
    values = pairs.select("block", "pair").join(counts, "pair").select("block", "pair", "count", "best")
    texts = blocks.filter("docs is not null").select(F.col("block").alias("of"), *_NAMES[3:])

    def look_up(found: pa.Table, own: pa.Table) -> pa.Table:
        held = np.argsort(found["pair"].to_numpy())
        count, best = found["count"].to_numpy()[held], found["best"].to_numpy()[held]
        row = {name: own[name][0].as_py() for name in own.column_names}
        n = int.from_bytes(row["docs"][:8], "little")
        lengths, codes = unpack_lists(row["docs"][8 : 8 + n])
        _, uses = unpack_lists(row["docs"][8 + n :])
        of_docs = len(codes) - lengths[-1]
        at = codes[of_docs:][codes[:of_docs]]
        edges = np.concatenate(([0], np.cumsum(lengths[:-1])))

        def per_doc(values: np.ndarray) -> pa.Array:
            return pa.array(np.diff(np.concatenate(([0], np.cumsum(values, dtype=np.int64)))[edges]))

        columns = [pa.array(row[c], pa.int64()) for c in ("ids", "n_a", "n_b", "n_groups")]
        columns += [per_doc(uses), per_doc(uses * best[at]), per_doc(uses * count[at]), pa.array(row["groups"], pa.string())]
        release()
        return pa.table(columns, names=_OUT)

    schema = ", ".join(f"{c} long" for c in _OUT[:-1]) + f", {_OUT[-1]} string"
    joined = values.groupBy("block").cogroup(texts.groupBy("of")).applyInArrow(look_up, schema)
    return joined.withColumnRenamed("id", row_id)
