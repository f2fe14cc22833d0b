"""Near duplicates by SimHash: fingerprints meet at the words of a covering code.

A 64-bit fingerprint is cut into three blocks. Two fingerprints that differ in at most ``t`` bits
differ in at most ``t // 3`` bits of some block. Per block the anchors are the words of a perfect
code: every block value has one anchor within the covering radius (its home), and is copied to
every anchor within radius plus ``t // 3``. A home row then meets all rows that may link to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwire.llm.common import stored
from siftwire.llm.components import components

SEED = 42
#: First bit and width of each block.
BLOCKS = ((0, 21), (21, 21), (42, 22))
#: Distinct fingerprints up to which each code serves: 2^12, 2^18 and 2^22 words a block. The more words, the fewer
#: fingerprints meet at one, and the more anchors each is copied to; all codes give the same links.
CODE_ROWS = (("golay", 1 << 22), ("hamming", 1 << 26), ("whole", 1 << 62))
#: Generator polynomial of the binary Golay code of length 23 (fixed value).
GOLAY_POLYNOMIAL = 0b101011100011
_CHUNK = 1 << 15


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of the word shingles of ``text``, as a signed 64-bit number; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    spans = zip(starts[:n].tolist(), ends[len(words) - n :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[a:b], SEED) for a, b in spans], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, _CHUNK):
        part = hashes[i : i + _CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, text: str = "text", width: int = 4, name: str = "fp") -> DataFrame:
    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, width) for t in texts], dtype="int64")

    return docs.withColumn(name, prints(text))


@cache
def _golay() -> np.ndarray:
    """Anchor number of every 22-bit block value: decoding of the perfect [23, 12] code, radius 3."""
    words = np.zeros(1, dtype=np.int64)
    for bit in range(12):
        words = np.concatenate((words, words ^ (GOLAY_POLYNOMIAL << bit)))
    table = np.zeros(1 << 23, dtype=np.int32)
    for weight in range(4):
        for bits in combinations(range(23), weight):
            table[words ^ sum(1 << b for b in bits)] = np.arange(len(words), dtype=np.int32)
    return table[: 1 << 22].copy()


@cache
def _hamming() -> np.ndarray:
    """The same for the perfect [15, 11] code on the low 15 bits (radius 1), the other bits as they are."""
    value = np.arange(1 << 22, dtype=np.int64)
    syndrome = np.zeros_like(value)
    for bit in range(15):
        syndrome ^= ((value >> bit) & 1) * (bit + 1)
    fixed = np.where(syndrome > 0, value ^ (1 << np.maximum(syndrome - 1, 0)), value)
    words, number = np.unique(fixed & 0x7FFF, return_inverse=True)
    return (number + (value >> 15) * len(words)).astype(np.int32)


@cache
def _whole() -> np.ndarray:
    """The code of all words (radius 0): a value is its own anchor, and is copied to those within the threshold."""
    return np.arange(1 << 22, dtype=np.int32)


CODES = {"golay": (_golay, 1 << 12), "hamming": (_hamming, 1 << 18), "whole": (_whole, 1 << 22)}


def anchors(prints: np.ndarray, code: str, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows (row number, anchor, home) of each fingerprint at each anchor that it belongs to."""
    decode, size = CODES[code]
    decode = decode()
    rows, places, homes = [], [], []
    for n, (first, width) in enumerate(BLOCKS):
        value = (prints.view(np.uint64) >> np.uint64(first)).astype(np.int64) & ((1 << width) - 1)
        flips = [sum(1 << b for b in bits) for w in range(threshold // 3 + 1) for bits in combinations(range(width), w)]
        for i in range(0, len(value), 4096):
            part = value[i : i + 4096]
            home = decode[part]
            near = np.sort(decode[part[:, None] ^ np.array(flips)[None, :]], axis=1)
            new = np.ones(near.shape, dtype=bool)
            new[:, 1:] = near[:, 1:] != near[:, :-1]
            r, c = np.nonzero(new)
            rows.append(r + i)
            places.append(near[r, c].astype(np.int64) + n * size)
            homes.append(near[r, c] == home[r])
    return np.concatenate(rows), np.concatenate(places), np.concatenate(homes)


def _replicas(prints: DataFrame, code: str, threshold: int) -> DataFrame:
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            if len(values):
                r, place, home = anchors(values, code, threshold)
                yield pa.RecordBatch.from_arrays([pa.array(place), pa.array(home), pa.array(values[r])], ["anchor", "home", "fp"])

    return prints.select("fp").mapInArrow(spread, "anchor long, home boolean, fp long")


def spanning_links(homes: np.ndarray, others: np.ndarray, threshold: int) -> tuple[list[int], list[int]]:
    """Links within ``threshold`` bits between two lists of fingerprints, thinned to those that join parts.

    Comparing is complete; of a densely linked crowd only a chain that keeps it connected is given.
    """
    values = np.unique(np.concatenate((homes, others)))
    here, there = np.searchsorted(values, homes), np.searchsorted(values, others)
    part = np.arange(len(values))
    bits, a, b = values.view(np.uint64), [], []
    step = max(1, (1 << 20) // max(1, len(there)))
    for i in range(0, len(here), step):
        rows = here[i : i + step]
        near = np.bitwise_count(bits[rows][:, None] ^ bits[there][None, :]) <= threshold
        near &= rows[:, None] != there[None, :]
        for n in np.nonzero(near.any(axis=1))[0]:
            row = rows[n]
            found = there[near[n]]
            found = found[part[found] != part[row]]
            if not len(found):
                continue
            parts, first = np.unique(part[found], return_index=True)
            chain = np.concatenate(([row], found[first]))
            a.extend(values[chain[:-1]].tolist())
            b.extend(values[chain[1:]].tolist())
            part[np.isin(part, parts)] = part[row]
    return a, b


def links(prints: DataFrame, threshold: int = 4, code: str | None = None, cell: int = 4096) -> DataFrame:
    """Links (a, b) between the distinct fingerprints ``fp`` that keep all those within ``threshold`` bits joined.

    A crowded anchor is cut into chunks of about ``cell`` rows, and each pair of chunks is compared
    on its own, so no task holds a whole anchor. Chained links replace the pairs of a crowd; the
    components are those of all pairs.
    """
    if code is None:
        rows = prints.count()
        code = next(name for name, most in CODE_ROWS if rows <= most)
    copies = _replicas(prints, code, threshold)
    crowded = stored(
        copies.groupBy("anchor").agg(F.count("*").alias("n")).filter(F.col("n") > cell)
        .select("anchor", F.ceil(F.col("n") / cell).cast("int").alias("chunks")),
        "crowded",
    )
    chunk = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    every = F.expr("sequence(0, chunks - 1)")
    # role: 1 looks for links, 2 is looked at, 3 both
    alone = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.when(F.col("home"), 3).otherwise(2).alias("role")))
    seen = F.transform(every, lambda x: F.struct(x.alias("i"), chunk.alias("j"), F.lit(2).alias("role")))
    looks = F.transform(every, lambda x: F.struct(chunk.alias("i"), x.alias("j"), F.lit(1).alias("role")))
    split = F.when(F.col("home"), F.concat(seen, looks)).otherwise(seen)
    cells = copies.join(crowded, "anchor", "left").select(
        "anchor", "fp", F.explode(F.when(F.col("chunks").isNull(), alone).otherwise(split)).alias("c")
    )

    def compare(rows: pa.Table) -> pa.Table:
        role = rows["role"].to_numpy()
        fp = rows["fp"].to_numpy()
        a, b = spanning_links(fp[role != 2], fp[role != 1], threshold)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return (
        cells.select("anchor", "c.i", "c.j", "fp", "c.role")
        .groupBy("anchor", "i", "j")
        .applyInArrow(compare, "a long, b long")
    )


def _print_groups(prints: DataFrame, threshold: int) -> DataFrame:
    """(fp, root) for every distinct fingerprint of ``prints``: equal roots exactly where links join them."""
    distinct = stored(prints.select("fp").distinct(), "distinct-prints")
    roots = components(links(distinct, threshold)).withColumnRenamed("node", "fp")
    return stored(distinct.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")), "print-roots")


def near_duplicates(
    docs: DataFrame, text: str = "text", row_id: str = "doc_id", width: int = 4, threshold: int = 4
) -> DataFrame:
    """(row_id, fp, component_id): the smallest id reachable over links of at most ``threshold`` bits.

    A null or empty text has fingerprint zero and is linked like any other. Repeated rows stay; a
    null id is never the smallest, and a component of null ids has a null id. Exact copies meet in
    one aggregate and are never compared with each other.
    """
    named = docs.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"))
    prints = stored(with_fingerprint(named, "text", width).select("row_id", "fp"), "prints")
    lows = prints.groupBy("fp").agg(F.min("row_id").alias("low")).join(_print_groups(prints, threshold), "fp")
    lows = stored(lows, "print-lows")
    ids = lows.groupBy("root").agg(F.min("low").alias("component_id"))
    of_print = stored(lows.join(stored(ids, "root-ids"), "root").select("fp", "component_id"), "print-ids")
    return prints.join(of_print, "fp").select(F.col("row_id").alias(row_id), "fp", "component_id")


def fingerprint_digest(docs: DataFrame) -> DataFrame:
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(
    docs: DataFrame, text: str = "text", row_id: str = "doc_id", width: int = 4, threshold: int = 4
) -> DataFrame:
    """Rows of ``docs``, one of each group of ``near_duplicates``: that with the smallest id.

    Ids sort before a missing one, so a group of rows without ids keeps one of them; texts without
    words are one group. Rows that repeat the kept id and fingerprint are kept once. Columns stay
    as they are, whatever their names.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    named = docs.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"), whole)
    held = stored(with_fingerprint(named, "text", width).select("row_id", "fp", "row"), "fingerprinted")
    rows = held.groupBy("row_id", "fp").agg(F.count("*").alias("n"))
    best = F.min(F.struct(F.col("row_id").isNull().alias("missing"), "row_id", "fp", "n")).alias("best")
    groups = _print_groups(held, threshold)
    kept = stored(rows.join(groups, "fp").groupBy("root").agg(best).select("best.row_id", "best.fp", "best.n"), "kept")

    def rows_of(some: DataFrame) -> DataFrame:
        some = some.select(F.col("row_id").alias("id"), F.col("fp").alias("print"))
        return held.join(some, F.col("row_id").eqNullSafe(F.col("id")) & (F.col("fp") == F.col("print")), "left_semi")

    once = rows_of(kept.filter("n = 1"))
    repeated = rows_of(kept.filter("n > 1")).dropDuplicates(["row_id", "fp"])
    return once.union(repeated).select("row.*")
