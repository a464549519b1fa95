"""Exact top-k search by distributed histogram selection.

Every query is scored against all rows, block by block. The k-th score of each query is located with
global histograms: a round counts scores in BINS equal bins of the query's current range, the bin that
holds the k-th score becomes the next range, until it holds a single integer. Histograms are sparse: a
block reports the bins that it fills, and counts only what is no smaller than its own k-th score, as the
global one cannot be smaller. At last scores above the k-th are kept, and of those equal to it the k
smallest ids of each block, and ties go to the smaller id.

The first range starts at the k-th score among FIRST rows, below which the k-th of all cannot lie, and
ends at the largest norms' product. A block whose largest norm can't reach a query's range is skipped.

Edge cases: see vectors.usable(); with fewer than k candidates all are returned; rows of other
dimension are no candidates; zero vectors take part; empty tables give empty results. Components must
stay below 2**53 and inner products below 2**62 after scaling: beyond that an error is raised, as no
exact integer score could be given.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectors
from .common import stage, table, unpack

#: Bins of a histogram.
BINS = 65_536
#: Rows whose scores bound the first range from below.
FIRST = 16_384
#: Scores that are held at once.
HELD = 2_000_000
_LEAST = np.iinfo(np.int64).min


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products, exact: doubles hold them below 2**53, 64-bit integers otherwise."""
    if a.shape[1] * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _pairs(batches):
    """(queries, row ids, scores, whether it is the query itself) of all blocks that meet, in parts of bounded size."""
    for batch in batches:
        for q, r in zip(batch.column("q"), batch.column("r"), strict=True):
            q, r = unpack(q.as_py()), unpack(r.as_py())
            norm = lambda v: np.sqrt((v * v).sum(1))
            reach = norm(q["v"]) * norm(r["v"]).max(initial=0) * (1 + 1e-9) + 1
            q = {c: x[reach >= q["lo"]] for c, x in q.items()}
            step = max(1, HELD // max(1, len(r["id"])))
            for at in range(0, len(q["id"]), step):
                part = {c: x[at : at + step] for c, x in q.items()}
                yield part, r["id"], scores(part["v"], r["v"]), part["id"][:, None] == r["id"][None, :]


def _local(s: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """Each query's k-th score in the block, or the least integer if there are fewer."""
    s = np.where(own, _LEAST, s)
    return np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(s), _LEAST)


def count_bins(pairs: DataFrame, k: int, bins: int) -> DataFrame:
    """(vec_id, lo, hi, above, bin, n): bins count from the top of the range."""

    def run(batches):
        import pyarrow as pa

        for q, _, s, own in _pairs(batches):
            lo, hi = q["lo"], q["hi"]
            width = -(-(hi - lo + 1) // bins)
            use = (s >= np.maximum(lo, _local(s, own, k))[:, None]) & (s <= hi[:, None]) & ~own
            i, j = np.nonzero(use)
            at = (hi[i] - s[i, j]) // width[i]
            code, n = np.unique(i * np.int64(bins) + at, return_counts=True)
            i, at = code // bins, code % bins
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q["id"][i], lo[i], hi[i], q["above"][i], at, n.astype(np.int64))], names=["vec_id", "lo", "hi", "above", "bin", "n"])

    return pairs.mapInArrow(run, "vec_id long, lo long, hi long, above long, bin long, n long").groupBy("vec_id", "lo", "hi", "above", "bin").agg(F.sum("n").alias("n"))


def narrow(state: DataFrame, counted: DataFrame, k: int, bins: int) -> DataFrame:
    """state (vec_id, v, dim, qb, lo, hi, above) with the range of the bin that holds the k-th score; all is kept where there are fewer."""
    by = Window.partitionBy("vec_id").orderBy("bin")
    width = F.ceil((F.col("hi") - F.col("lo") + 1) / F.lit(bins))
    found = counted.withColumn("to", F.sum("n").over(by) + F.col("above")).where((F.col("to") >= k) & (F.col("to") - F.col("n") < k))
    found = found.select("vec_id", F.greatest("lo", F.col("hi") - (F.col("bin") + 1) * width + 1).alias("l"), (F.col("hi") - F.col("bin") * width).alias("h"), (F.col("to") - F.col("n")).alias("a"))
    return state.join(found, "vec_id", "left").select("vec_id", "v", "dim", "qb", F.coalesce("l", "lo").alias("lo"), F.coalesce("h", "lo").alias("hi"), F.coalesce("a", "above").alias("above"))


def select(pairs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for q, ids, s, own in _pairs(batches):
            qi, ri = np.nonzero((s > q["lo"][:, None]) & ~own)
            ti, tj = np.nonzero((s == q["lo"][:, None]) & ~own)  # ids ascend in a block
            first = np.arange(len(ti)) - np.searchsorted(ti, ti) < k
            i, j = np.concatenate([qi, ti[first]]), np.concatenate([ri, tj[first]])
            yield pa.RecordBatch.from_arrays([pa.array(q["id"][i]), pa.array(ids[j]), pa.array(s[i, j])], names=["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, "query_id long, vec_id long, score long")


def lower_bounds(pairs: DataFrame, k: int) -> DataFrame:
    """(vec_id, lo): each query's k-th score among the rows it meets, if there are so many."""

    def run(batches):
        import pyarrow as pa

        for q, _, s, own in _pairs(batches):
            least = _local(s, own, k)
            yield pa.RecordBatch.from_arrays([pa.array(q["id"]), pa.array(least)], names=["vec_id", "lo"])

    # the best of several blocks' k-th scores bounds the k-th of all as well
    return pairs.mapInArrow(run, "vec_id long, lo long").groupBy("vec_id").agg(F.max("lo").alias("first"))


def search(df: DataFrame, is_query, k: int, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0, bins: int = BINS) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest integer inner products of floor(scale * vector)."""
    rows = vectors.usable(df, key, vector, zero=True).withColumn("v", F.transform("v", lambda x: F.floor(x * scale).cast("double")))
    rows = rows.withColumn("norm", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    rows = stage(rows.withColumn("top", F.aggregate("v", F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x)))), "vectors")
    most, top = rows.agg(F.max("norm"), F.max("top")).first()
    if (top or 0) >= 2**53 or (most or 0) ** 2 >= 2**62:
        raise OverflowError(f"scaled components reach {top:g} and norms {most:g}: inner products would not be exact 64-bit integers")
    queries = rows.where(is_query)
    n_rows, n_queries = vectors.blocks(rows), vectors.blocks(queries)
    blocks = stage(vectors.packed(rows.withColumn("rb", vectors.block_of("vec_id", n_rows)), "rb"), "blocks")
    bound = F.ceil(F.col("norm") * F.lit(float(most or 0)) + 1).cast("long")
    state = queries.select("vec_id", "v", "dim", vectors.block_of("vec_id", n_queries).alias("qb"), (-bound).alias("lo"), bound.alias("hi"), F.lit(0).cast("long").alias("above"))
    some = -(-FIRST * n_rows // max(1, rows.count()))  # row blocks that hold FIRST rows
    asked = vectors.packed(state, "qb", ("lo", "hi", "above"))
    first = lower_bounds(vectors.meet(blocks.where(F.col("rb") < min(some, n_rows)), asked, min(some, n_rows), n_queries), k)
    state = stage(state.join(first, "vec_id", "left").withColumn("lo", F.greatest("lo", F.coalesce("first", "lo"))).drop("first"), "state")
    while True:
        pairs = vectors.meet(blocks, vectors.packed(state, "qb", ("lo", "hi", "above")), n_rows, n_queries)
        if state.where("lo < hi").isEmpty():
            break
        state = stage(narrow(state, count_bins(pairs, k, bins), k, bins), "state")
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return select(pairs, k).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", 5)
