"""Helpers shared by the corpus operators: reading, bounded samples, small-side joins, batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20
SALTS = 16


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def held_out(doc_id: str | Column) -> Column:
    """Rows kept out of every fit: crc32 of the id as text leaves 2 when divided by 4."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def bounded_sample(rows: DataFrame, key: str, n: int, seed: int = 7) -> DataFrame:
    """At most n rows, the same ones however the table is partitioned.

    Rows are chosen by a hash of their key, first by a threshold that the row count gives, so that
    no task sorts more than about n rows.
    """
    total = rows.count()
    h = F.xxhash64(F.lit(seed), F.col(key))
    share = min(1.0, 1.2 * n / total) if total else 1.0
    picked = rows if share >= 1.0 else rows.where(F.pmod(h, F.lit(1 << 20)) < int(share * (1 << 20)) + 1)
    return picked.orderBy(h, key).limit(n)


def join_small(big: DataFrame, small: DataFrame, on: str, small_bytes: int, salt_by: str,
               how: str = "inner") -> DataFrame:
    """Join a big table with a usually small one on a key that may be hot.

    The small side is broadcast when its measured size is within BROADCAST_BYTES. Beyond that the
    key is salted: the big side spreads each key over SALTS parts by `salt_by`, the small side is
    repeated once per part.
    """
    if small_bytes <= BROADCAST_BYTES:
        return big.join(F.broadcast(small), on, how)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(salt_by), F.lit(SALTS)).cast("int"))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.join(right, [on, "_salt"], how).drop("_salt")


def join_counted(big: DataFrame, small: DataFrame, key: str, salt_by: str, hot: int = 1 << 17) -> DataFrame:
    """Join a big table with one row per key, whose `_n` is the number of the key's rows in the big table.

    Keys of more than `hot` rows are split: their rows are spread over ceil(_n / hot) salts and the small row
    is repeated once for each. There are at most (rows / hot) such keys.
    """
    split = small.where(F.col("_n") > hot).select(key, F.ceil(F.col("_n") / hot).cast("int").alias("_parts"))
    n = split.count()
    if not n:
        return big.join(small.drop("_n"), key)
    if 24 * n <= BROADCAST_BYTES:
        split = F.broadcast(split)
    salt = F.coalesce(F.pmod(F.xxhash64(salt_by), F.col("_parts")).cast("int"), F.lit(0))
    left = big.join(split, key, "left").withColumn("_salt", salt).drop("_parts")
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_n") / hot), F.lit(1)).cast("int") - 1)))
    return left.join(right.drop("_n"), [key, "_salt"]).drop("_salt")


def pieces(batch: pa.RecordBatch, rows: int, text_col: str | None = None,
           size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most `rows` rows and, but for a single longer row, `size` bytes of a text column."""
    if text_col is None:
        ends = range(rows, batch.num_rows + rows, rows)
    else:
        total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False))
        ends, at = [], 0
        while at < batch.num_rows:
            before = total[at - 1] if at else 0
            at = min(at + rows, max(at + 1, int(np.searchsorted(total, before + size, "right"))))
            ends.append(at)
    start = 0
    for end in ends:
        yield batch.slice(start, end - start)
        start = end


def map_rows(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema: str,
             rows: int = 256, text_col: str | None = None) -> DataFrame:
    """Apply fn to small slices of the Arrow batches; bounds memory with long texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for piece in pieces(b, rows, text_col):
                out = fn(piece)
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]
    return df.mapInArrow(run, schema)


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """A text column as Python strings, null as empty."""
    return ["" if t is None else t for t in batch.column(name).to_pylist()]
