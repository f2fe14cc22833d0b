"""Nearest vectors by inner product over shifted Hilbert orderings.

Distinct vectors are projected, shifted and ordered along several Hilbert curves. A query looks at
the vectors whose places on a curve are near its own; what the curves find is merged and reranked
on the original vectors. How near is measured, not guessed: a bounded sample of queries is
answered exactly, and the window is the distance that holds the wanted share of their neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwire.llm.common import stored

CURVES, DIMS, BITS = 8, 4, 8
#: Queries answered exactly to set the window, and vectors that set the scale of a projection.
SAMPLE_QUERIES, SAMPLE_VECTORS = 256, 10_000
#: Share of the sample's true neighbours that the window must hold.
RECALL = 0.96
#: Places of a curve that one task searches at once, and queries that it searches for, about: at every size of table. Each
#: block gives a query a list of its own, so larger blocks mean fewer rows to merge.
BLOCK, ASKERS = 8192, 8192


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of ``cells`` (rows x dimensions, ``bits`` bits each)."""
    x = cells.astype(np.int64).T.copy()
    n, top = len(x), 1 << (bits - 1)
    level = top
    while level > 1:
        low = level - 1
        for i in range(n):
            flip = (x[i] & level) > 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(flip, low, swap)
            x[i] ^= swap if i else 0
        level >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn, level = np.zeros_like(x[0]), top
    while level > 1:
        turn ^= np.where(x[n - 1] & level, level - 1, 0)
        level >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for b in reversed(range(bits)):
        for i in range(n):
            key = key << 1 | (x[i] >> b & 1)
    return key


class Curves:
    """Projections, shifts and scales of the curves, from a seed and a sample."""

    def __init__(self, sample: np.ndarray, curves: int = CURVES, dims: int = DIMS, bits: int = BITS, seed: int = 7):
        rng, self.bits = np.random.default_rng(seed), bits
        width = sample.shape[1]
        dims = min(dims, width)
        self.maps = [np.linalg.qr(rng.normal(size=(width, dims)))[0] for _ in range(curves)]
        self.shifts = [rng.uniform(0, 1, dims) for _ in range(curves)]
        spread = [sample @ m for m in self.maps]
        self.middle = [p.mean(axis=0) for p in spread]
        self.scale = [np.maximum(p.std(axis=0), 1e-12) for p in spread]

    def keys(self, vectors: np.ndarray) -> Iterator[np.ndarray]:
        for m, shift, middle, scale in zip(self.maps, self.shifts, self.middle, self.scale, strict=True):
            place = ((vectors @ m - middle) / scale + shift + 4) / 9 * (1 << self.bits)
            yield hilbert(np.clip(place, 0, (1 << self.bits) - 1), self.bits)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def top_rows(queries: np.ndarray, base: np.ndarray, base_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, base id, score) of the ``k`` largest inner products of each query, ties to smaller ids.

    Scores are summed pair by pair, so a pair has the same score wherever it is met.
    """
    order = np.argsort(base_ids, kind="stable")
    base, base_ids = base[order], base_ids[order]
    rows, ids, scores = [], [], []
    step = max(1, (1 << 22) // max(1, len(base)))
    for i in range(0, len(queries), step):
        near = queries[i : i + step] @ base.T
        k_here = min(k, len(base))
        least = np.partition(near, len(base) - k_here, axis=1)[:, len(base) - k_here]
        # Rounding differs between the product and the pairwise sum: take all that may be among the best.
        slack = 1e-9 * (1 + np.abs(least))
        r, c = np.nonzero(near >= (least - slack)[:, None])
        exact = np.einsum("ij,ij->i", queries[i + r], base[c])
        best = np.lexsort((c, -exact, r))
        r, c, exact = r[best], c[best], exact[best]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        kept = place < k_here
        rows.append(r[kept] + i)
        ids.append(base_ids[c[kept]])
        scores.append(exact[kept])
    if not rows:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    return np.concatenate(rows), np.concatenate(ids), np.concatenate(scores)


def _distinct(vectors: DataFrame, vec_id: str, embedding: str, k: int) -> DataFrame:
    """(rep, vector, members): every usable vector once, under its smallest id, with its k + 1 smallest ids."""
    v = F.col(embedding)
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), v.cast("array<double>").alias("vector"))
    usable = F.expr(
        "id IS NOT NULL AND vector IS NOT NULL AND forall(vector, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
        " AND exists(vector, x -> x <> 0)"
    )
    rows = rows.filter(usable)
    lengths = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    rows = rows.filter(F.size("vector") == (lengths[0].n if lengths else 0)).distinct()
    # Spark keeps only the first rows of a window before the exchange, so copies without number stay where they are.
    same = Window.partitionBy("vector").orderBy("id")
    kept = rows.withColumn("place", F.row_number().over(same)).filter(F.col("place") <= k + 1)
    return kept.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("members")).select(
        F.element_at("members", 1).alias("rep"), "vector", "members"
    )


def nearest(
    vectors: DataFrame, is_query: F.Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 20,
    recall: float = RECALL, curves: int = CURVES, seed: int = 7,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` (over ``vec_id``) its ``k`` nearest found.

    Nearness is the inner product in double precision; ties go to the smaller id; a row is never its
    own neighbour. Vectors that are null, zero, hold a null or non-finite number or are not as long
    as most take no part, nor do null ids; repeated rows count once. Copies of a vector are searched
    for as one and counted out by id afterwards, which is exact.
    """
    spark = vectors.sparkSession
    reps = stored(_distinct(vectors, vec_id, embedding, k), "ann-vectors")
    usable = vectors.select(F.col(vec_id).cast("long").alias("query_id"), F.col(embedding).cast("array<double>").alias("vector")).filter(
        F.col("query_id").isNotNull() & is_query
    ).distinct()
    queries = stored(usable.join(reps.select("vector", "rep"), "vector").select("query_id", "rep"), "ann-queries")
    asked = queries.select("rep").distinct()
    base = stored(reps.join(asked.withColumn("asks", F.lit(True)), "rep", "left").select("rep", "vector", F.coalesce("asks", F.lit(False)).alias("asks")), "ann-base")
    total = base.count()
    sample = base.select("vector").orderBy(F.xxhash64("rep", F.lit(seed))).limit(SAMPLE_VECTORS).collect()
    if not sample or asked.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = spark.sparkContext.broadcast(Curves(np.array([r.vector for r in sample]), curves, seed=seed))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                for curve, keys in enumerate(order.value.keys(_matrix(batch.column("vector")))):
                    columns = [pa.array([curve] * len(keys), pa.int32()), pa.array(keys), *batch.columns]
                    yield pa.RecordBatch.from_arrays(columns, ["curve", "key", "rep", "vector", "asks"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            columns = [pa.array([part] * n, pa.int32()), pa.array(np.arange(seen, seen + n), pa.int64()), *batch.columns]
            seen += n
            yield pa.RecordBatch.from_arrays(columns, ["part", "place", *batch.schema.names])

    shape = "curve int, key long, rep long, vector array<double>, asks boolean"
    parts = max(1, total * curves // 50_000)
    ordered = (
        base.mapInArrow(place, shape).repartitionByRange(parts, "curve", "key", "rep")
        .sortWithinPartitions("curve", "key", "rep").mapInArrow(number, "part int, place long, " + shape)
    )
    ordered = stored(ordered, "ann-ordered")
    sizes = ordered.groupBy("part").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    # Every curve holds all distinct vectors, so a place on the whole order is curve * total + place on the curve.
    ordered = ordered.join(offsets, "part").withColumn("rank", F.col("before") + F.col("place") - F.col("curve").cast("long") * total)
    ordered = ordered.drop("part", "place", "key", "before")

    window = _window(base, ordered, total, k, recall)
    # A query goes to every block that its window meets. Where very many queries meet a block, they are dealt into
    # groups, each with a copy of the block, so what a task holds does not grow with the table or the window.
    reach = -(-window // BLOCK)
    block = F.floor(F.col("rank") / BLOCK).cast("int")
    groups = max(1, round(asked.count() / total * (2 * reach + 1) * BLOCK / ASKERS))
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group")
    searched = ordered.select("curve", block.alias("block"), every, "rep", "vector", F.lit(False).alias("asks"))
    last = (total - 1) // BLOCK
    around = F.sequence(F.greatest(F.lit(0), block - reach), F.least(F.lit(last), block + reach))
    asking = ordered.filter("asks").select(
        "curve", F.explode(around).alias("block"), F.pmod(F.xxhash64("rep"), F.lit(groups)).cast("int").alias("group"), "rep", "vector", "asks"
    )

    def search(rows: pa.Table) -> pa.Table:
        asks, vectors, ids = rows["asks"].to_numpy(), _matrix(rows["vector"]), rows["rep"].to_numpy()
        q, found, score = top_rows(vectors[asks], vectors[~asks], ids[~asks], k + 1)
        return pa.table({"query": ids[asks][q], "rep": found, "score": score})

    found = (
        searched.unionByName(asking).groupBy("curve", "block", "group").applyInArrow(search, "query long, rep long, score double")
        .distinct()
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    found = found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k + 1).drop("n")
    pairs = (
        found.join(reps.select("rep", "members"), "rep")
        .join(queries.select("query_id", F.col("rep").alias("query")), "query")
        .select("query_id", F.explode("members").alias("vec_id"), "score")
        .filter("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    )
    last_order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        pairs.withColumn("rank", F.row_number().over(last_order)).filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int"), "vec_id", "score")
    )


def exact_neighbours(base: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """(query, rep, score): the true ``k`` nearest of a bounded list of queries, all vectors looked at in batches."""
    sent = base.sparkSession.sparkContext.broadcast((np.array([q for q, _ in queries]), np.array([v for _, v in queries])))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, vectors = sent.value
        for batch in batches:
            if batch.num_rows:
                q, found, score = top_rows(vectors, _matrix(batch.column("vector")), batch.column("rep").to_numpy(), k + 1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(found), pa.array(score)], ["query", "rep", "score"])

    near = base.select("rep", "vector").mapInArrow(scan, "query long, rep long, score double").filter("query <> rep")
    best = Window.partitionBy("query").orderBy(F.desc("score"), "rep")
    return near.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).drop("n")


def _window(base: DataFrame, ordered: DataFrame, total: int, k: int, recall: float) -> int:
    """Places to either side that hold ``recall`` of the true neighbours of a sample of queries."""
    rows = base.filter("asks").orderBy(F.xxhash64("rep", F.lit(3))).limit(SAMPLE_QUERIES).select("rep", "vector").collect()
    pairs = [(r.query, r.rep) for r in exact_neighbours(base, [(r.rep, r.vector) for r in rows], k).select("query", "rep").collect()]
    if not pairs:
        return 1
    wanted = sorted({x for p in pairs for x in p})  # at most SAMPLE_QUERIES * (k + 1)
    known = base.sparkSession.createDataFrame([(x,) for x in wanted], "rep long")
    places: dict[int, dict[int, int]] = {}
    for r in ordered.select("curve", "rep", "rank").join(F.broadcast(known), "rep").collect():
        places.setdefault(r.rep, {})[r.curve] = r.rank
    gaps = [min(abs(places[a][c] - places[b][c]) for c in places[a]) for a, b in pairs]
    return min(total, max(1, int(np.quantile(gaps, recall, method="higher"))))


def ann_digest(vectors: DataFrame) -> DataFrame:
    return nearest(vectors, F.col("query_id") % 20 == 0)
