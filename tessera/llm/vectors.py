"""Vectors that take part in a search, and blocks of them: a stated query set against all rows, block by block."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pack

#: Numbers in a block: its rows are so many by the dimension, whatever the cluster's settings.
NUMBERS = 1 << 18


def usable(df: DataFrame, key: str, vector: str, zero: bool) -> DataFrame:
    """(vec_id, v, dim) of the rows that take part: of rows with equal ids the one with the smallest vector.

    Null ids, null vectors, vectors with null or non-finite components and, unless zero, zero vectors take no part.
    """
    v = F.col(vector).cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = df.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null").where(fine)
    if not zero:
        rows = rows.where(F.exists("v", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))


def matrix(column, dim: int) -> np.ndarray:
    """The rows of an Arrow list column of vectors of dim components."""
    import pyarrow as pa

    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def packed(rows: DataFrame, key: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """rows (key, dim, vec_id, v, extra) to (key, dim, raw): one row a block."""
    import pyarrow as pa

    def work(t):
        dim = t.column("dim")[0].as_py()
        order = np.argsort(t.column("vec_id").to_numpy())
        flat = matrix(t.column("v"), dim)
        blob = pack({"id": t.column("vec_id").to_numpy()[order], "v": flat[order]} | {c: t.column(c).to_numpy()[order] for c in extra})
        return pa.table({key: pa.array([t.column(key)[0].as_py()], pa.int32()), "dim": pa.array([dim], pa.int32()), "raw": pa.array([blob], pa.binary())})

    return rows.groupBy(key, "dim").applyInArrow(work, f"{key} int, dim int, raw binary")


def blocks(rows: DataFrame) -> int:
    """How many blocks hold rows (dim, ...)."""
    return max(1, -(-int(rows.agg(F.sum("dim")).first()[0] or 0) // NUMBERS))


def block_of(column: str, n: int):
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def meet(rows: DataFrame, queries: DataFrame, n_rows: int, n_queries: int) -> DataFrame:
    """(q, r) blobs of every query block with every row block of its dimension, as an equi-join on both numbers."""
    left = queries.select("qb", F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("rb"), "dim", F.col("raw").alias("q"))
    right = rows.select("rb", F.explode(F.sequence(F.lit(0), F.lit(n_queries - 1))).alias("qb"), "dim", F.col("raw").alias("r"))
    return left.join(right.hint("shuffle_hash"), ["qb", "rb", "dim"]).select("q", "r")
