"""Exact top-k search by columnar branch and bound.

Vectors are scaled to integers and laid out in blocks, dimension by dimension. For a query, a block's
scores grow by one group of dimensions at a time; what the remaining dimensions can still add is bounded
by the remaining mass of both sides (Cauchy-Schwarz). Candidates whose bound is under the k-th best
score known are dropped and the survivors compacted, so later dimensions touch few columns.

The stated queries meet all rows in blocks: query blocks are copied to groups of candidate blocks, and
each pair of blocks returns at most k rows a query; a ranking by query ends it.

Edge cases: vectors that are null or hold null or non-finite components take no part; an empty one scores 0.
Shorter vectors count as padded with zeros. Rows with the query's id are its own. Rows that repeat in id and
vector are candidates each, and ask once; queries that share an id are ranked as one. Ties go to the smaller
id; null ids take no part. Scores are exact at any size: blocks whose scores could leave 64 bits are
counted in whole numbers without limit. A score beyond 64 bits comes out as the nearest long, in the rank
of its exact value. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GROUP = 8  # dimensions added at once
BLOCK = 8192  # candidates in a block
QUERIES = 256  # queries in a block
LONG = (1 << 63) - 1
KEY = 600  # bytes that hold any score of finite doubles


def scaled(grid: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) of every x, as 64-bit integers where they fit and as whole numbers without limit elsewhere."""
    with np.errstate(over="ignore"):
        whole = np.floor(scale * grid)
    if np.abs(whole).max(initial=0) < 2**62:
        return whole.astype(np.int64)
    exact = [int(x) if np.isfinite(x) else math.floor(Fraction(float(y)) * Fraction(scale)) for x, y in zip(whole.ravel(), grid.ravel())]
    return np.array(exact, object).reshape(grid.shape)


def _stored(whole: np.ndarray) -> tuple[int, bytes]:
    """Bytes a number (0: decimal text) and the numbers, dimension by dimension."""
    columns = np.ascontiguousarray(whole.T)
    if columns.dtype == object:
        return 0, ",".join(map(str, columns.ravel())).encode()
    narrow = columns.astype(np.int32)
    return (4, narrow.tobytes()) if (narrow == columns).all() else (8, columns.tobytes())


def _read(size: int, data: bytes, n: int) -> np.ndarray:
    if size:
        return np.frombuffer(data, np.int32 if size == 4 else np.int64).reshape(-1, n).astype(np.int64)
    return np.array([int(x) for x in data.split(b",")], object).reshape(-1, n)


def _pack(scale: float, size: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                ids = batch.column(0).slice(at, size).to_numpy(zero_copy_only=False)
                vectors = batch.column(1).slice(at, size)
                lengths = np.diff(np.asarray(vectors.offsets))
                grid = np.zeros((len(ids), int(lengths.max(initial=1))))
                grid[np.arange(grid.shape[1]) < lengths[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
                width, columns = _stored(scaled(grid, scale))
                yield pa.RecordBatch.from_arrays([pa.array([part << 32 | made], pa.int64()), pa.array([len(ids)], pa.int32()), pa.array([width], pa.int32()), pa.array([ids.astype(np.int64).tobytes()], pa.binary()), pa.array([columns], pa.binary())], ["block", "n", "width", "ids", "columns"])
                made += 1

    return pack


def masses(columns: np.ndarray) -> np.ndarray:
    """Of each column: the length of what is left before each group of dimensions."""
    squares = np.add.reduceat(columns.astype(np.float64) ** 2, np.arange(0, len(columns), GROUP), axis=0)
    return np.sqrt(np.concatenate([np.cumsum(squares[::-1], axis=0)[::-1], np.zeros((1, columns.shape[1]))]))


def best(query: np.ndarray, own: int, columns: np.ndarray, mass: np.ndarray, ids: np.ndarray, k: int, units: tuple[int, int] = (1, 1)) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the k best columns. mass: ``masses`` of the columns, in the second of ``units``; bounds are floats in units of query and columns."""
    dims = min(len(query), len(columns))
    query, alive = query[:dims], np.flatnonzero(ids != own)
    left = np.sqrt(np.append(np.cumsum(((query / units[0]).astype(np.float64) ** 2)[::-1])[::-1], 0.0))
    real = lambda x: (x / (units[0] * units[1])).astype(np.float64)
    floor = None
    score = np.zeros(len(alive), query.dtype)
    for g, at in enumerate(range(0, dims, GROUP)):
        part = columns[at : min(at + GROUP, dims)]
        score = score + query[at : at + GROUP] @ (part if len(alive) == columns.shape[1] else part[:, alive])
        if len(alive) <= k:
            continue
        if floor is None:  # whole scores of the k that lead so far bound the rest
            lead = alive[np.argsort(-score, kind="stable")[:k] if score.dtype == object else np.argpartition(-score, k - 1)[:k]]
            floor = real(np.sort(query @ columns[:dims, lead])[:1])[0]
        rest, now = left[min(at + GROUP, dims)] * mass[g + 1, alive], real(score)
        # floats are off by parts in 10**16
        keep = now + rest * (1 + 1e-9) + (np.abs(now) + abs(floor)) * 1e-12 + 1e-300 >= floor
        if keep.sum() < 0.9 * len(alive):
            alive, score = alive[keep], score[keep]
    order = np.lexsort((ids[alive], -score))[:k]
    return ids[alive[order]], score[order]


def _unit(x: np.ndarray) -> int:
    """A power of two that brings large numbers into the range of floats; 1 for numbers within 64 bits."""
    return 1 << max(int(v).bit_length() for v in x.ravel()) if x.dtype == object else 1


def _search(k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, width, ids, columns, m, query_width, query_ids, queries in zip(*(batch.column(i).to_pylist() for i in range(8))):
                ids, columns = np.frombuffer(ids, np.int64), _read(width, columns, n)
                query_ids, queries = np.frombuffer(query_ids, np.int64), _read(query_width, queries, m)
                most = int(np.abs(columns).max(initial=0)) * int(np.abs(queries).max(initial=0)) * min(len(columns), len(queries))
                if most > LONG:
                    columns, queries = columns.astype(object), queries.astype(object)
                units = _unit(queries), _unit(columns)
                mass = masses(columns / units[1])
                found = [best(queries[:, j], int(query_ids[j]), columns, mass, ids, k, units) for j in range(m)]
                scores = np.concatenate([f[1] for f in found])
                # order within scores that no long holds
                exact = [(int(x) + (1 << 8 * KEY - 1)).to_bytes(KEY, "big") if abs(int(x)) >= LONG else b"" for x in scores] if most > LONG else [b""] * len(scores)
                held = [max(min(int(x), LONG), -LONG - 1) for x in scores] if most > LONG else scores
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(query_ids, [len(f[0]) for f in found])), pa.array(np.concatenate([f[0] for f in found])), pa.array(held, pa.int64()), pa.array(exact, pa.binary())], ["query_id", "vec_id", "score", "exact"])

    return search


def topk(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of ``vectors`` with the highest inner products.

    Both sides have vec_id and embedding (an array of numbers).
    """

    def clean(df: DataFrame) -> DataFrame:
        # the decimal text of a number tells a finite one from the rest
        finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        rows = df.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
        return rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))

    packed = "block long, n int, width int, ids binary, columns binary"
    spark = vectors.sparkSession
    groups = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = clean(vectors).mapInArrow(_pack(scale, BLOCK), packed).withColumn("group", F.pmod(F.xxhash64("block"), F.lit(groups)))
    asked = clean(queries).dropDuplicates().mapInArrow(_pack(scale, QUERIES), packed).select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"), F.col("n").alias("m"), F.col("width").alias("query_width"), F.col("ids").alias("query_ids"), F.col("columns").alias("queries"))
    # copies are more than Spark's estimate knows of: without the hint it may broadcast them, all through the driver
    pairs = blocks.join(asked.hint("merge"), "group").select("n", "width", "ids", "columns", "m", "query_width", "query_ids", "queries")
    found = pairs.mapInArrow(_search(k), "query_id long, vec_id long, score long, exact binary")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("exact"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
