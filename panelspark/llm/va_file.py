"""Centroid clustering over a vector approximation file.

Vectors are integers (component times SCALE, floored) and lie in a table of their own. Beside it stands the
approximation: BITS bits a dimension that name the cell a component falls in. In a round only the
approximation is scanned. A table of (dimension, cell, centroid) gives each component's least and greatest
part of the distance to each centroid; their sums are an interval per centroid. Centroids whose
interval begins beyond the end of another's are out. Where one is left, the vector is assigned unseen; only where intervals overlap,
or the cluster changed and its sums must follow, is the full vector fetched, by a join on its row number, and its
exact distances to the centroids left are taken.

All distances of one vector share the term |x - m|^2 for any point m; the intervals leave it out, with the
centroids' mean as m, which makes them narrow once the centroids are close together. Sums of clusters are kept from
round to round, vectors that moved are added and subtracted. The first pass, which sums every vector, and the
last, which reports every distance, read all vectors; there the intervals only spare distances.

The cells' borders are quantiles of a sample of at most SAMPLE vectors, the outer ones the extremes of all; any borders give the
same clusters. What is collected are the sample, k sums and k centroids.

Defined results: a vector that is null, has another number of components, or a component that is
null, not finite or, scaled, 2^27 or more in magnitude takes no part (beyond it squared distances leave a long);
repeated ids and rows are vectors of their own; ids that are null are no first centroids while others are there;
fewer vectors than k give so many centroids; sums of distances beyond a long are null; an empty table gives no rows; extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import BROADCAST_BYTES, bounded_sample, pieces
from panelspark.session import stage

SCALE = 256
BITS = 6
SAMPLE = 4_096
MOST = 1 << 27
ROWS = 1_024


def quantised(rows: DataFrame, dim: int, id_col: str = "vec_id", vector_col: str = "embedding",
              scale: int = SCALE) -> DataFrame:
    """(row, id, v): the vectors that take part, as integers, numbered."""
    x, limit = F.col(vector_col), float(MOST)
    scaled = F.transform(x, lambda c: c.cast("double") * scale)
    fits = F.forall(scaled, lambda c: F.coalesce((c > -limit) & (c < limit) & ~F.isnan(c), F.lit(False)))
    kept = rows.where(x.isNotNull()).where(F.size(x) == dim).where(fits)
    return kept.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"),
                       F.transform(scaled, lambda c: F.floor(c).cast("int")).alias("v"))


def _matrix(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.int64)


# ── cells and intervals ─────────────────────────────────────────────────────
@dataclass
class Cells:
    """Borders of the cells of each dimension, and the least and greatest value in each cell."""

    borders: np.ndarray  # dim x (cells - 1): a cell starts at its lower border
    low: np.ndarray      # dim x cells
    high: np.ndarray
    bits: int

    @classmethod
    def of(cls, sample: np.ndarray, low: np.ndarray, high: np.ndarray, bits: int) -> Cells:
        share = np.linspace(0, 1, (1 << bits) + 1)[1:-1]
        borders = np.ceil(np.quantile(sample, share, axis=0).T).astype(np.int64)
        return cls(borders, np.column_stack([low, borders]), np.column_stack([borders - 1, high]), bits)

    def find(self, v: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(b, v[:, d], "right") for d, b in enumerate(self.borders)]).astype(np.uint8)

    def pack(self, cells: np.ndarray) -> list[bytes]:
        spread = np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - self.bits:]
        return [r.tobytes() for r in np.packbits(spread.reshape(len(cells), -1), axis=1)]

    def unpack(self, packed: list[bytes]) -> np.ndarray:
        dim, size = len(self.borders), len(self.borders) * self.bits
        rows = np.frombuffer(b"".join(packed), dtype=np.uint8).reshape(len(packed), -1)
        spread = np.unpackbits(rows, axis=1)[:, :size].reshape(-1, dim, self.bits)
        return np.packbits(spread, axis=2)[:, :, 0] >> (8 - self.bits)


class Intervals:
    """Tables of the least and greatest part of each centroid's distance, less what all share, by dimension and cell."""

    def __init__(self, cells: Cells, centroids: np.ndarray):
        self.centroids = centroids
        off = centroids - np.round(centroids.mean(axis=0)).astype(np.int64)
        ends = [-2 * edge[:, :, None] * off.T[:, None, :] for edge in (cells.low, cells.high)]
        self.least, self.most = np.minimum(*ends), np.maximum(*ends)
        self.own = (centroids * centroids).sum(axis=1)

    def left(self, cells: np.ndarray) -> np.ndarray:
        """Vectors x centroids: whether the centroid may be the nearest."""
        low = np.tile(self.own, (len(cells), 1))
        high = low.copy()
        for d in range(cells.shape[1]):
            low += self.least[d][cells[:, d]]
            high += self.most[d][cells[:, d]]
        return low <= high.min(axis=1)[:, None]

    def nearest(self, v: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest of the centroids left, the first of equals, and its squared distance."""
        row, c = np.nonzero(left)
        off = v[row] - self.centroids[c]
        found = np.full(left.shape, np.iinfo(np.int64).max)
        found[row, c] = np.einsum("ij,ij->i", off, off)
        best = found.argmin(axis=1)
        return best, found[np.arange(len(v)), best]


# ── passes ──────────────────────────────────────────────────────────────────
_STATE = "row long, id long, cells binary, cluster int, sums array<long>"
_NAMES = ["row", "id", "cells", "cluster", "sums"]


class _Sums:
    """Sums and, in the last column, counts of the clusters' vectors in one partition."""

    def __init__(self, k: int, dim: int):
        self.of = np.zeros((k, dim + 1), dtype=np.int64)

    def add(self, cluster: np.ndarray, v: np.ndarray, sign: int) -> None:
        for j in np.unique(cluster):
            mine = cluster == j
            self.of[j] += sign * np.append(v[mine].sum(axis=0), mine.sum())

    def rows(self) -> pa.RecordBatch:
        some = np.flatnonzero(self.of.any(axis=1))
        none = pa.nulls(len(some))
        return pa.RecordBatch.from_arrays(
            [none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), pa.array(some, pa.int32()),
             pa.array(list(self.of[some]), pa.list_(pa.int64()))], names=_NAMES)


def _settled(row: pa.Array, ids: pa.Array, cells: pa.Array, cluster: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([row, ids, cells, pa.array(cluster, pa.int32()),
                                       pa.nulls(len(cluster)).cast(pa.list_(pa.int64()))], names=_NAMES)


def _first_pass(vectors: DataFrame, cells: Cells, centroids: np.ndarray) -> DataFrame:
    """The approximation and first clusters of all vectors, and their sums (rows without a number)."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, sums = Intervals(cells, centroids), _Sums(k, dim)
        for batch in batches:
            for b in pieces(batch, ROWS):
                v = _matrix(b, dim)
                found = cells.find(v)
                cluster, _ = near.nearest(v, near.left(found))
                sums.add(cluster, v, 1)
                yield _settled(b.column("row"), b.column("id"), pa.array(cells.pack(found), pa.binary()), cluster)
        yield sums.rows()
    return vectors.mapInArrow(run, _STATE)


def _scan(state: DataFrame, cells: Cells, centroids: np.ndarray) -> DataFrame:
    """The state with `left`: the centroids left for a vector, null where only its own is."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Intervals(cells, centroids)
        for batch in batches:
            for b in pieces(batch, ROWS):
                left = near.left(cells.unpack(b.column("cells").to_pylist()))
                old = b.column("cluster").to_numpy()
                stays = (left.sum(axis=1) == 1) & left[np.arange(len(old)), old]
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in ("row", "id", "cells", "cluster")),
                     pa.array([None if s else np.flatnonzero(r) for s, r in zip(stays, left)], pa.list_(pa.int32()))],
                    names=["row", "id", "cells", "cluster", "left"])
    return state.mapInArrow(run, "row long, id long, cells binary, cluster int, left array<int>")


def _fetch(scanned: DataFrame, vectors: DataFrame, cells: Cells, centroids: np.ndarray) -> tuple[DataFrame, int]:
    """Vectors whose intervals overlap or whose cluster changed: the new state, and what the sums gain; and their number."""
    k, dim = centroids.shape
    open_ = scanned.where("left is not null")
    n = open_.count()
    if n * (dim + 40) <= BROADCAST_BYTES:
        open_ = F.broadcast(open_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, sums = Intervals(cells, centroids), _Sums(k, dim)
        for batch in batches:
            for b in pieces(batch, ROWS):
                v, old = _matrix(b, dim), b.column("cluster").to_numpy()
                few = b.column("left")
                left = np.zeros((len(old), k), dtype=bool)
                size = np.array([len(x) for x in few.to_pylist()])
                left[np.repeat(np.arange(len(old)), size), few.flatten().to_numpy()] = True
                new, _ = near.nearest(v, left)
                moved = new != old
                sums.add(new[moved], v[moved], 1)
                sums.add(old[moved], v[moved], -1)
                yield _settled(b.column("row"), b.column("id"), b.column("cells"), new)
        yield sums.rows()
    return vectors.select("row", "v").join(open_, "row").mapInArrow(run, _STATE), n


def _gathered(state: DataFrame, k: int, dim: int) -> np.ndarray:
    """k x (dim + 1): the partitions' sums and counts together."""
    cells = (state.where("row is null").select("cluster", F.posexplode("sums")).groupBy("cluster", "pos")
             .agg(F.sum("col").alias("total")).collect())
    out = np.zeros((k, dim + 1), dtype=np.int64)
    for r in cells:
        out[r.cluster, r.pos] = r.total
    return out


def _extremes(vectors: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for b in batches:
            if b.num_rows:
                v = _matrix(b, dim)
                low = v.min(axis=0) if low is None else np.minimum(low, v.min(axis=0))
                high = v.max(axis=0) if high is None else np.maximum(high, v.max(axis=0))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), pa.array(low), pa.array(high)],
                                             names=["d", "low", "high"])
    found = vectors.select("v").mapInArrow(run, "d int, low long, high long").groupBy("d").agg(
        F.min("low").alias("low"), F.max("high").alias("high")).orderBy("d").collect()
    return np.array([r.low for r in found]), np.array([r.high for r in found])


@dataclass
class Clusters:
    """(id, cluster, distance) of every vector, the final centroids and the number of vectors fetched in each round."""

    members: DataFrame
    centroids: np.ndarray
    fetched: list[int] = field(default_factory=list)


def cluster(vectors: DataFrame, first: np.ndarray, rounds: int, bits: int = BITS) -> Clusters:
    """`rounds` rounds of assignment and update from the first centroids, then one more assignment.

    `vectors` is a written table (row, id, v); new centroids are the floored means, an empty cluster keeps its own.
    """
    (k, dim), centroids, fetched = first.shape, first.astype(np.int64), []
    sample = bounded_sample(vectors.select("row", "v"), "row", SAMPLE).collect()
    cells = Cells.of(np.array([r.v for r in sample]), *_extremes(vectors, dim), bits)
    sums = np.zeros((k, dim + 1), dtype=np.int64)
    state = None
    for n in range(rounds):
        if state is None:
            fresh = stage(_first_pass(vectors, cells, centroids), "approximation")
            state = fresh.where("row is not null").drop("sums")
        else:
            scanned = stage(_scan(state, cells, centroids), "scanned")
            found, many = _fetch(scanned, vectors, cells, centroids)
            fetched.append(many)
            fresh = stage(found, "fetched")
            state = scanned.where("left is null").drop("left").unionByName(
                fresh.where("row is not null").drop("sums"))
        sums += _gathered(fresh, k, dim)
        some = sums[:, dim] > 0
        centroids = centroids.copy()
        centroids[some] = sums[some, :dim] // sums[some, dim:]

    final = centroids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Intervals(cells, final)
        for batch in batches:
            for b in pieces(batch, ROWS):
                v = _matrix(b, dim)
                best, far = near.nearest(v, near.left(cells.find(v)))
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(best, pa.int32()), pa.array(far)],
                                                 names=["id", "cluster", "distance"])
    return Clusters(vectors.mapInArrow(run, "id long, cluster int, distance long"), final, fetched)


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors whose `seed` and id have the smallest sha256, in that order; ties by id, then vector."""
    h = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")).cast("binary"), 256)
    picked = vectors.orderBy(h.asc_nulls_last(), "id", "v").limit(k).select("v").collect()
    return np.array([r.v for r in picked], dtype=np.int64)


def inertia(found: Clusters, id_col: str = "vec_id") -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector."""
    spark = found.members.sparkSession
    members = stage(found.members, "members")
    total = {r.cluster: int(r.total) for r in members.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}

    def fits(n: int) -> int | None:
        return n if n < 1 << 63 else None
    rows = [(c, fits(n), fits(sum(total.values())), hashlib.sha256(",".join(map(str, found.centroids[c])).encode()).hexdigest())
            for c, n in total.items()]
    table = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return members.join(F.broadcast(table), "cluster").select(
        F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def clustered(rows: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, seed: str = "2:", id_col: str = "vec_id",
              vector_col: str = "embedding", bits: int = BITS) -> Clusters:
    """Clusters of a table of vectors, from centroids that hashes of the ids choose."""
    vectors = stage(quantised(rows, dim, id_col, vector_col), "vectors")
    first = first_centroids(vectors, k, seed)
    if not len(first):
        return Clusters(rows.sparkSession.createDataFrame([], "id long, cluster int, distance long"), np.zeros((0, dim), np.int64))
    return cluster(vectors, first, rounds, bits)


def oracle(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    parts = [f"""v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor({SCALE} * cast(x as double)) as bigint)) v from embeddings
  where len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dim}),
c0 as (select row_number() over (order by h) - 1 c, v from (
  select v, sha256('2:' || cast(vec_id as varchar)) h from v order by h limit {k}))"""]
    for r in range(rounds + 1):
        parts.append(f"""a{r} as materialized (
  select vec_id, any_value(v) v, arg_min(c, (d, c)) c, min(d) d from (
    select v.vec_id, v.v, c{r}.c, list_sum(list_transform(list_zip(v.v, c{r}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) d
    from v cross join c{r}) group by vec_id)""")
        if r < rounds:
            parts.append(f"""m{r} as (
  select c, list(cast((s - ((s % n) + n) % n) // n as bigint) order by i) v from (
    select c, i, cast(sum(x) as bigint) s, count(*) n
    from (select c, unnest(v) x, unnest(range({dim})) i from a{r}) group by c, i) group by c),
c{r + 1} as materialized (select c{r}.c, coalesce(m{r}.v, c{r}.v) v from c{r} left join m{r} using (c))""")
    return "with " + ",\n".join(parts) + f"""
select vec_id, cast(c as int) as cluster, cast(d as bigint) distance,
  cast(sum(d) over (partition by c) as bigint) cluster_inertia, cast(sum(d) over () as bigint) inertia,
  sha256(array_to_string(c{rounds}.v, ',')) centroid_sha256
from a{rounds} join c{rounds} using (c)"""
