"""Byte-balanced shards by histogram sort: count below candidate boundaries, refine, exchange once.

Only DataFrame and SQL functions run on the data. The driver sees counts per candidate
boundary (at most ``shards * probes`` rows a round), never rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwire.llm.common import stored

#: Keys are non-negative 63-bit numbers, so differences of two keys never overflow.
KEY_END = 1 << 63
#: Low bits of the second key that tell rows apart which repeat id and text.
TIE_BITS = 16


@dataclass(frozen=True)
class Span:
    """A stretch of keys that holds an unplaced boundary: ``h`` in [low, high], or one ``h`` and ``k`` in [k_low, k_high]."""

    low: int
    high: int
    k_low: int
    k_high: int
    below: int  # bytes before the stretch

    @property
    def by_id(self) -> bool:
        return self.low == self.high

    @property
    def single(self) -> bool:
        return self.by_id and self.k_low == self.k_high

    def step(self, probes: int) -> int:
        low, high = (self.k_low, self.k_high) if self.by_id else (self.low, self.high)
        return max(1, math.ceil((high - low + 1) / probes))

    def start(self, i: int, probes: int) -> tuple[int, int]:
        """Boundary before the ``i``-th probe cell."""
        if self.by_id:
            return self.low, self.k_low + i * self.step(probes)
        return self.low + i * self.step(probes), 0


def _key(text: Column, row_id: Column) -> tuple[Column, Column]:
    """Equal texts are neighbours in key order; the id splits a group that is larger than a shard.

    Rows that repeat both are split by where they stand, which holds once the keys are stored.
    """
    tie = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND((1 << TIE_BITS) - 1)
    by_id = F.shiftleft(F.shiftrightunsigned(F.xxhash64(row_id), 1 + TIE_BITS), TIE_BITS)
    return F.shiftrightunsigned(F.xxhash64(text), 1), by_id.bitwiseOR(tie)


def _count(keys: DataFrame, spans: list[Span], probes: int, shift: int) -> dict[int, list]:
    """Bytes and key range of each probe cell of each span, counted over all partitions.

    ``shift`` leaves the bits of ``h`` that all keys of a span share; rows meet spans by them.
    """
    rows = ", ".join(
        f"({n}, {s.low >> shift}L, {s.low}L, {s.high}L, {s.k_low}L, {s.k_high}L, {str(s.by_id).lower()}, {s.step(probes)}L)"
        for n, s in enumerate(spans)
    )
    probe = keys.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(n, top, low, high, k_low, k_high, by_id, step)")
    inside = F.expr(f"shiftright(h, {shift}) = top AND h BETWEEN low AND high AND k BETWEEN k_low AND k_high")
    cell = F.expr("IF(by_id, (k - k_low) DIV step, (h - low) DIV step)")
    # One row for each boundary still sought, below the number of shards: a bounded broadcast.
    found = (
        keys.join(F.broadcast(probe), inside)
        .groupBy("n", cell.alias("cell"))
        .agg(
            F.sum("size").alias("bytes"), F.min("h").alias("h0"), F.max("h").alias("h1"),
            F.min("k").alias("k0"), F.max("k").alias("k1"),
        )
        .orderBy("n", "cell")
        .collect()
    )
    cells: dict[int, list] = {}
    for r in found:
        cells.setdefault(r.n, []).append(r)
    return cells


def splitters(keys: DataFrame, shards: int, tolerance: float = 0.001, probes: int = 64) -> list[tuple[int, int]]:
    """Boundaries (h, k) that cut ``keys`` (h, k, size) into ``shards`` stretches of near equal bytes.

    A boundary is final when the bytes below it are within ``tolerance`` of a shard's share from
    their target, or when a single key is left to place it at.
    """
    total = keys.agg(F.sum("size")).first()[0] or 0
    slack = tolerance * total / shards
    start = Span(0, KEY_END - 1, 0, KEY_END - 1, 0)
    open_, done = {j: start for j in range(1, shards)} if total else {}, {}
    bits = min(20, (probes * shards - 1).bit_length())
    width, shift = 1 << bits, 63
    while open_:
        spans = sorted(set(open_.values()), key=lambda s: (s.low, s.k_low))
        cells = _count(keys, spans, width, shift)
        for j, span in list(open_.items()):
            target, below = total * j / shards, span.below
            for r in cells[spans.index(span)]:
                edge, after = span.start(r.cell, width), span.start(r.cell + 1, width)
                if below + r.bytes <= target and below + r.bytes < target - slack:
                    below += r.bytes
                    continue
                one = Span(r.h0, r.h1, r.k0, r.k1, below)
                if target - below <= slack or one.single and target - below <= below + r.bytes - target:
                    done[j] = edge
                elif below + r.bytes - target <= slack or one.single:
                    done[j] = after
                else:
                    open_[j] = one
                break
            else:
                done[j] = (KEY_END - 1, KEY_END - 1)
            if j in done:
                del open_[j]
        width, shift = probes, 63 - bits
    return [done.get(j, (KEY_END - 1, KEY_END - 1)) for j in range(1, shards)]


def histogram_shards(
    rows: DataFrame, text: str = "text", row_id: str = "doc_id", shards: int = 40, overhead: int = 16,
    tolerance: float = 0.001, probes: int = 64, piece_bytes: int = 64 << 20,
) -> DataFrame:
    """Rows with their ``size``, ``shard`` (0 to shards - 1) and ``slot`` (gapless from 0 in each shard).

    Rows are ordered by (hash of text, hash of id) and cut into stretches of near equal bytes; a
    text's copies share a stretch unless a boundary has to fall inside the group. A row's size is
    the UTF-8 bytes of its text (null: none) plus ``overhead``. Shards are worked on in pieces of
    about ``piece_bytes``, so no task holds a whole shard. Null ids and rows that repeat id and text are
    rows like any other, and may lie in several shards; an empty table gives an empty result. Input columns named like a
    result are replaced.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + overhead
    h, k = _key(F.col(text), F.col(row_id))
    # Stored with its keys: a row keeps its place between counting and the exchange.
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in ("size", "shard", "slot")]
    held = stored(rows.select(*kept, h.alias("__h"), k.alias("__k"), size.alias("size")), "shard-rows")
    keys = held.select(F.col("__h").alias("h"), F.col("__k").alias("k"), "size")
    cuts = splitters(keys, shards, tolerance, probes)
    listed = ", ".join(f"named_struct('h', {a}L, 'k', {b}L)" for a, b in cuts)
    shard = "0" if not cuts else f"size(filter(array({listed}), b -> b <= named_struct('h', __h, 'k', __k)))"
    pieces = max(1, math.ceil((keys.agg(F.sum("size")).first()[0] or 0) / shards / piece_bytes))

    def placed(df: DataFrame) -> DataFrame:
        return df.withColumn("shard", F.expr(shard)).withColumn("__piece", F.col("__k") % pieces)

    counts = placed(held.select("__h", "__k")).groupBy("shard", "__piece").count()
    earlier = Window.partitionBy("shard").orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    # shards * pieces rows
    offsets = counts.select("shard", "__piece", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("__before"))
    ordered = Window.partitionBy("shard", "__piece").orderBy("__h", "__k")
    return (
        placed(held)
        .repartition(2 * shards * pieces, "shard", "__piece")
        .withColumn("__place", F.row_number().over(ordered) - 1)
        .join(offsets, ["shard", "__piece"])
        .withColumn("slot", (F.col("__before") + F.col("__place")).cast("bigint"))
        .drop("__h", "__k", "__piece", "__before", "__place")
    )


def shard_digest(docs: DataFrame, shards: int = 40) -> DataFrame:
    """Where each document went, with the checksum of the text that went there."""
    return histogram_shards(docs.select("doc_id", "text"), shards=shards).select(
        "doc_id",
        "size",
        F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
