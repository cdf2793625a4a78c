"""Nearest neighbours by inner product: a block matrix join of int8 tiles with exact error bounds.

Vectors are packed into blocks of rows, as float32 where that is exact. A task takes a large block of queries through a
lane of candidate blocks, one at a time, in tiles of a part of the queries; every candidate is sent once for each block
of queries, 8192 of them. Inside a tile both sides are quantised to int8 with one scale a vector; the integer product is exact (float32 sums of integers
below 2^24, or float64 beyond), and |x.y - X.Y| <= |X||e_y| + |e_x||Y| + |e_x||e_y| bounds its error, X and Y being the
quantised vectors and e the remainders. Only pairs whose upper bound reaches the k-th id's lower bound, and the k-th
best id so far, are computed again, from the original floats in double precision. Each lane keeps a heap of k ids a query, and
the lanes' heaps are merged.

The rows shuffled are blocks, not pairs; every query meets every candidate once, and nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone.llm.common import keep, table

#: vectors in a block of candidates, in a block of queries, and of these in a tile
CANDIDATES, QUERIES, TILE = 2048, 8192, 512


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows (ids, dimension, data) of up to `size` usable vectors of one dimension: ids as int64, data as float32 if that is exact, else float64."""
    held: dict[int, list[tuple[int, np.ndarray]]] = {}
    part, at = TaskContext.get().partitionId() << 33, 0

    def packed(dimension: int) -> pa.RecordBatch:
        nonlocal at
        rows = held.pop(dimension)
        at += 1
        ids = np.array([i for i, _ in rows], "<i8").tobytes()
        data = np.stack([v for _, v in rows])
        with np.errstate(over="ignore"):
            short = data.astype("<f4")
        data = (short if (short == data).all() else data.astype("<f8")).tobytes()
        return pa.record_batch([pa.array([part + at]), pa.array([dimension]), pa.array([ids], pa.binary()), pa.array([data], pa.binary())], names=["block", "dimension", "ids", "data"])

    for batch in batches:
        for vec_id, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if vec_id is None or not vector.is_valid or not len(vector.values) or vector.values.null_count:
                continue
            v = vector.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if not np.isfinite(v).all() or not v.any():
                continue
            held.setdefault(len(v), []).append((vec_id, v))
            if len(held[len(v)]) == size:
                yield packed(len(v))
    for dimension in sorted(held):
        yield packed(dimension)


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 rows, scales, and the norms of the quantised rows and of what they miss."""
    scale = np.abs(x).max(axis=1) / 127
    scale[scale == 0] = 1  # so small that the division underflows: all is remainder
    q = np.clip(np.rint(x / scale[:, None]), -127, 127).astype(np.int8)
    back = q * scale[:, None]
    with np.errstate(over="ignore"):
        return q, scale, np.linalg.norm(back, axis=1), np.linalg.norm(x - back, axis=1)


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products row by row, in an order of summation that doesn't depend on the other rows."""
    with np.errstate(all="ignore"):
        return (x * y).sum(axis=1)


def tile(q_ids: np.ndarray, q: tuple, c_ids: np.ndarray, c: tuple, k: int, so_far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """rows of q and of c that may be among each query's k best, its own id aside.

    q, c: what quantised() gives; c_ids are sorted. so_far: the score of each query's k-th best id from earlier tiles.
    Bounds that overflow say nothing: such pairs are computed again.
    """
    (qq, qs, qn, qe), (cq, cs, cn, ce) = q, c
    kind = np.float32 if qq.shape[1] * 127 * 127 < 2**24 else np.float64
    with np.errstate(all="ignore"):
        near = (qq.astype(kind) @ cq.astype(kind).T).astype(np.float64) * qs[:, None] * cs[None, :]
        slack = qn[:, None] * ce[None, :] + qe[:, None] * (cn + ce)[None, :]
        slack += 1e-12 * (qn + qe)[:, None] * (cn + ce)[None, :]  # rounding of the sums themselves
        low, high = near - slack, near + slack
    own = q_ids[:, None] == c_ids[None, :]
    low[own | ~np.isfinite(low)] = -np.inf
    high[np.isnan(high)] = np.inf
    # bounds count ids, not rows: rows of one id are one candidate
    first = np.flatnonzero(np.concatenate([[True], c_ids[1:] != c_ids[:-1]]))
    n = len(first)
    if n < len(c_ids):
        low = np.maximum.reduceat(low, first, axis=1)
    least = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(q_ids), -np.inf)
    least = np.maximum(least, so_far)
    return np.nonzero((high >= least[:, None]) & ~own)


def _best(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The k best ids of each row, best first, ties to smaller ids; and each row's k-th score (-inf with fewer)."""
    order = np.lexsort((-scores, ids, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    if len(rows):  # an id's best row stands for it
        own = np.concatenate([[True], (rows[1:] != rows[:-1]) | (ids[1:] != ids[:-1])])
        rows, ids, scores = rows[own], ids[own], scores[own]
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    place = np.arange(len(rows)) - np.searchsorted(rows, np.arange(n))[rows]
    kept = place < k
    last = np.full(n, -np.inf)
    last[rows[place == k - 1]] = scores[place == k - 1]
    return rows[kept], ids[kept], scores[kept], last


def _lanes(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (lane, asked, kind): a block of queries (kind 0), then its lane of candidate blocks."""
    state: tuple | None = None

    def finished() -> pa.RecordBatch:
        q_ids, _, (rows, ids, scores, _) = state
        return pa.record_batch([pa.array(q_ids[rows]), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])

    for batch in batches:
        for kind, d, i, x in zip(*(batch.column(c).to_pylist() for c in ("kind", "dimension", "ids", "data")), strict=True):
            ids = np.frombuffer(i, "<i8")
            data = np.frombuffer(x, "<f4" if len(x) == 4 * d * len(ids) else "<f8").reshape(-1, d).astype(np.float64)
            if kind == 0:
                if state is not None:
                    yield finished()
                none = np.zeros(0, np.int64)
                state = ids, (data, quantised(data)), (none, none, np.zeros(0), np.full(len(ids), -np.inf))
                continue
            q_ids, (q, short), held = state
            order = np.argsort(ids, kind="stable")
            ids, data = ids[order], data[order]
            c, found = quantised(data), [held[:3]]
            for at in range(0, len(q_ids), TILE):
                here = slice(at, at + TILE)
                rows, columns = tile(q_ids[here], tuple(y[here] for y in short), ids, c, k, held[3][here])
                found.append((rows + at, ids[columns], _exact(q[rows + at], data[columns])))
            state = q_ids, (q, short), _best(*(np.concatenate(parts) for parts in zip(*found, strict=True)), len(q_ids), k)
    if state is not None:
        yield finished()


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of vectors(vec_id, embedding, ...) nearest to each query row.

    Nearness is the largest inner product in double precision; ties go to the smaller vec_id; a query isn't its own
    candidate, nor is another row of the same id. Null ids, and vectors that are null, empty, zero or hold null or
    non-finite components take no part. Vectors of different dimension never meet. Rows repeated under one id are one
    query and one candidate, scored by the best of its rows. Scores may overflow to an infinity; what is no number then
    comes last. Long vectors are read whole; other columns are ignored. Fewer than k candidates: all. No vectors: no rows.
    """
    spark = vectors.sparkSession
    usable = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"), is_query.alias("is_query")).distinct()
    schema = "block long, dimension long, ids binary, data binary"
    usable = keep(usable, "vectors")
    blocks = usable.select("vec_id", "embedding").mapInArrow(partial(_blocks, size=CANDIDATES), schema)
    asked = usable.where("is_query").select("vec_id", "embedding").mapInArrow(partial(_blocks, size=QUERIES), schema)
    blocks = keep(blocks, "candidates")
    asked = keep(asked, "queries")
    # so many lanes that all cores have work; with many blocks of queries one lane is enough
    place = Window.partitionBy("dimension").orderBy("block")
    sizes = {r.dimension: r.n for r in asked.groupBy("dimension").agg(F.count("*").alias("n")).collect()}  # a count a dimension
    known = F.create_map(*[F.lit(x) for pair in sizes.items() for x in pair]) if sizes else F.create_map().cast("map<bigint,bigint>")
    n_asked = F.coalesce(F.try_element_at(known, F.col("dimension")), F.lit(0).cast("long"))
    n_lanes = F.ceil(2 * spark.sparkContext.defaultParallelism / n_asked)
    numbers = asked.select("dimension", "block").withColumn("asked", F.row_number().over(place).cast("long") - 1)
    asked = asked.join(numbers, ["dimension", "block"]).withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), n_lanes - 1)))
    met = blocks.where(n_asked > 0).withColumn("lane", F.pmod(F.xxhash64("block"), n_lanes)).withColumn("asked", F.explode(F.sequence(F.lit(0).cast("long"), n_asked - 1)))
    rows = [x.select("dimension", "lane", "asked", F.lit(kind).alias("kind"), "ids", "data") for kind, x in enumerate((asked, met))]
    order = ["dimension", "lane", "asked"]
    tiles = rows[0].unionByName(rows[1]).repartition(*order).sortWithinPartitions(*order, "kind")
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(batch)
    spark.conf.set(batch, "4")  # a row is a block of a megabyte or so
    try:
        found = keep(tiles.select("kind", "dimension", "ids", "data").mapInArrow(partial(_lanes, k=k), "query_id long, vec_id long, score double"), "heaps")
    finally:
        spark.conf.set(batch, before)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.isnan("score"), F.desc("score"), "vec_id")).cast("int")
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of all embeddings to those whose vec_id is divisible by 20; nulls, ties and so on: see nearest."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
