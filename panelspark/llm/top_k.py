"""Exact top-k search by inner product, with a pivot table.

The Euclidean distances of every vector to a set of pivots are computed once. For a query and a
candidate the largest difference of their distances to a pivot is a lower bound of their distance,
which bounds their inner product from above. A query evaluates candidates in the order of that
bound and stops when the bound of the next one is below its k-th score, so results are exact.

Queries and candidates meet in blocks of bounded size: each candidate shard with each block of
queries, by an equality join on (shard, block); the best of each pair of blocks are merged at the end.

Defined results: vectors that are null or hold a null or non-finite component take no part; shorter
vectors count as padded with zeros; a null id takes no part; candidates of a query's own id are left
out; a query id that repeats counts once, with its smallest vector, a candidate that repeats counts
each time; ties go to the smaller id; fewer candidates give fewer rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelspark.llm.common import bounded_sample
from panelspark.session import stage

PIVOTS = 32
SHARD_ROWS = 8_192
BLOCK_QUERIES = 8_192
SCALE = 256.0


def quantised(vector: Column, scale: float = SCALE) -> Column:
    """floor(scale * x) of every component, as doubles that hold integers."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def usable(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite."""
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(
        ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")), F.lit(False)))


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, padded with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.list_(pa.float64()))
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    size = np.diff(offsets)
    out = np.zeros((len(size), width))
    out[np.repeat(np.arange(len(size)), size),
        np.arange(len(flat)) - np.repeat(offsets[:-1] - offsets[0], size)] = flat
    return out


def pivot_table(vectors: DataFrame, width: int, pivots: np.ndarray) -> DataFrame:
    """(vec_id, v, d): the vectors with their distances to the pivots."""
    shared = vectors.sparkSession.sparkContext.broadcast(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = _matrix(batch.column("v"), width)
            d = np.stack([np.sqrt(((m - p) ** 2).sum(axis=1)) for p in shared.value], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("v"),
                 pa.FixedSizeListArray.from_arrays(pa.array(d.reshape(-1)), d.shape[1]).cast(pa.list_(pa.float64()))],
                names=["vec_id", "v", "d"])
    return vectors.mapInArrow(run, "vec_id long, v array<double>, d array<double>")


def best_of(query: np.ndarray, own: int, ids: np.ndarray, rows: np.ndarray, upper: np.ndarray,
            k: int) -> list[tuple[int, int]]:
    """(score, id) of the k best candidates, evaluated in the order of their upper bounds."""
    order = np.argsort(-upper, kind="stable")
    found: list[tuple[int, int]] = []
    at, step = 0, 256
    while at < len(order):
        if len(found) == k and upper[order[at]] < found[-1][0]:
            break
        take = order[at:at + step]
        take = take[ids[take] != own]
        score = rows[take] @ query
        if len(score):
            if len(score) > k:  # ties with the k-th stay
                cut = np.partition(score, len(score) - k)[len(score) - k]
                take, score = take[score >= cut], score[score >= cut]
            found = sorted(found + list(zip(score.astype(np.int64).tolist(), ids[take].tolist())),
                           key=lambda x: (-x[0], x[1]))[:k]
        at, step = at + step, 2 * step
    return found


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id",
           vector_col: str = "embedding", pivots: int = PIVOTS, scale: float = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates of every row where `is_query` holds."""
    v = F.col(vector_col)
    rows = vectors.where(usable(v) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("vec_id"), quantised(v, scale).alias("v"), is_query.alias("q"))
    width, n, n_queries, top = rows.agg(
        F.max(F.size("v")), F.count("*"), F.sum(F.col("q").cast("long")),
        F.max(F.array_max(F.transform("v", F.abs)))).first()
    width = max(1, width or 0)
    # Doubles add products of integers exactly up to 2^53; beyond it integers of 64 bits are used.
    kind = np.float64 if (top or 0.0) ** 2 * width < 2.0 ** 53 else np.int64
    picked = bounded_sample(rows.select("vec_id", "v"), "vec_id", pivots).select("v").collect()
    centre = np.zeros((max(1, len(picked)), width))
    for i, r in enumerate(picked):
        centre[i, :len(r[0])] = r[0]
    table = stage(pivot_table(rows.select("vec_id", "v"), width, centre), "pivot-table")
    shards, blocks = max(1, -(-n // SHARD_ROWS)), max(1, -(-(n_queries or 0) // BLOCK_QUERIES))
    asked = rows.where("q").groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = pivot_table(asked, width, centre)

    def part(c: str, count: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(5), c), F.lit(count)).cast("int")

    def every(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = table.withColumn("s", part("vec_id", shards)).withColumn("b", every(blocks))
    right = asked.withColumn("b", part("vec_id", blocks)).withColumn("s", every(shards))

    def meet(cands: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if cands.num_rows and queries.num_rows:
            ids, own = cands.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
            c, q = _matrix(cands.column("v"), width), _matrix(queries.column("v"), width)
            dc = np.ascontiguousarray(_matrix(cands.column("d"), len(centre)).T)
            dq = _matrix(queries.column("d"), len(centre))
            cc, qq = (c * c).sum(axis=1), (q * q).sum(axis=1)
            exact_c, exact_q = c.astype(kind), q.astype(kind)
            low = np.empty(len(ids))
            gap = np.empty(len(ids))
            for i in range(len(own)):
                low[:] = 0
                for p in range(len(centre)):
                    np.subtract(dc[p], dq[i, p], out=gap)
                    np.abs(gap, out=gap)
                    np.maximum(low, gap, out=low)
                upper = (qq[i] + cc - low * low) / 2
                upper += 1e-9 * (qq[i] + cc) + 1  # room for rounding
                out += [(int(own[i]), s, j) for s, j in best_of(exact_q[i], int(own[i]), ids, exact_c, upper, k)]
        cols = list(zip(*out)) or [(), (), ()]
        return pa.table([pa.array(x, pa.int64()) for x in cols], names=["query_id", "score", "vec_id"])

    near = left.groupBy("s", "b").cogroup(right.groupBy("s", "b")).applyInArrow(
        meet, "query_id long, score long, vec_id long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
