"""Approximate nearest neighbours with a hash-prefix forest.

Each of TREES trees gives a vector a string of BITS bits: bit l tells the side of the tree's l-th random
hyperplane. The hyperplane's offset is, for each prefix of the first bits, the median of a bounded sample
of rows with that prefix (SAMPLE rows and NUMBERS numbers at most), so prefixes divide dense regions as
evenly as sparse ones and no prefix is hot; bits after the fitted ones use the sample's mean. The whole
table is one sorted array of strings for each tree, dealt by (tree, prefix) into buckets.

A query descends each tree to its longest matching prefix and then ascends all trees together: level by
level, and within a level tree by tree, until the ranges of equal prefix hold WORK * rows ** POWER
entries, and TREES * (k + 1) at least. Where it stops is found on counts of prefixes alone, before any vector moves. Then vectors meet
the queries of their buckets, each bucket gives the nearest of a query's range, and the final ones are
compared exactly. All rows are indexed; more trees or more work raise recall. If a query's buckets hold
too little, they are made larger by shorter prefixes, down to the whole table.

Copies of a vector beyond the k + 1 of smallest id can be in no result, so they stay out of the index;
equal queries search once and share what they find. Neither is a loss, and a vector that a third of all
rows have is no hot spot.

Edge cases: see vectors.usable(); zero vectors take no part; with fewer than k candidates all are
returned, as the ascent ends at the empty prefix; rows of other dimension are no candidates; ties go to
the smaller id; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import vectors
from .common import U64, drop_staged, stage, table

TREES, BITS = 100, 48
#: Entries of all trees together at which the ascent ends: WORK * rows ** POWER.
WORK, POWER = 6.0, 0.75
#: Rows of the sample that the offsets are fitted to, numbers in it, and rows for each fitted prefix.
SAMPLE, NUMBERS, LEAF = 16_384, 1 << 21, 8
#: Rows of a bucket, on average.
ROWS = 16_384
#: Levels below the expected end of the ascent from which it starts.
BELOW = 6


@functools.lru_cache(maxsize=4)
def planes(dim: int, trees: int) -> np.ndarray:
    """(dim, trees * BITS): the normals of each tree's hyperplanes, orthogonal as far as the dimension allows."""
    rng = np.random.default_rng(20_000 + dim)
    out = rng.standard_normal((trees, dim, BITS))
    n = min(dim, BITS)
    out[:, :, :n] = np.linalg.qr(out[:, :, :n])[0]
    return out.transpose(1, 0, 2).reshape(dim, trees * BITS)


class Forest:
    """Offsets of one dimension's hyperplanes, and how far strings are followed."""

    def __init__(self, sample: np.ndarray, rows: int, trees: int, work: float, k: int) -> None:
        dim = sample.shape[1]
        self.trees, self.dim = trees, dim
        self.mean = sample.mean(0)
        #: Vectors are scaled so that neither squares overflow nor single precision loses them.
        self.scale = float(np.abs(sample - self.mean).max()) or 1.0
        #: Where the ascent ends; so many entries hold k + 1 rows, as each is in a tree once.
        self.least = min(trees * rows, max(trees * (k + 1), math.ceil(work * rows**POWER)))
        end = max(0.0, math.log2(trees * rows / self.least))
        self.length = min(BITS, math.ceil(end) + BELOW)
        self.prefix = max(0, min(math.floor(math.log2(max(1, rows / ROWS))), math.floor(end) - 2))
        self.depth = max(0, min(self.length, int(math.log2(max(1, len(sample) / LEAF)))))
        self.offsets = [np.zeros((trees, 1 << level)) for level in range(self.depth)]
        normals = planes(dim, trees).reshape(dim, trees, BITS)
        near = (sample - self.mean) / self.scale
        for t in range(trees):
            side, code = near @ normals[:, t, : self.depth], np.zeros(len(sample), np.int64)
            for level in range(self.depth):
                order = np.lexsort((side[:, level], code))
                edge = np.searchsorted(code[order], np.arange((1 << level) + 1))
                held = edge[1:] > edge[:-1]
                self.offsets[level][t, held] = side[order, level][(edge[:-1] + edge[1:])[held] // 2]
                code = code * 2 + (side[:, level] >= self.offsets[level][t, code])

    def _sides(self, v: np.ndarray) -> np.ndarray:
        """(trees, rows, BITS) signed distances to hyperplanes through the mean."""
        return ((v - self.mean) / self.scale @ planes(self.dim, self.trees)).reshape(len(v), self.trees, BITS).transpose(1, 0, 2)

    def small(self, v: np.ndarray) -> np.ndarray:
        """Vectors in single precision, about the mean."""
        return np.clip((v - self.mean) / self.scale, -1e15, 1e15).astype(np.float32)

    def strings(self, v: np.ndarray) -> np.ndarray:
        """(trees, rows) strings as integers, the first bit highest."""
        out = np.empty((self.trees, len(v)), np.int64)
        for at in range(0, len(v), 512):
            side = self._sides(v[at : at + 512])
            code = np.zeros(side.shape[:2], np.int64)
            for level in range(BITS):
                cut = np.take_along_axis(self.offsets[level], code, 1) if level < self.depth else 0.0
                code = code * 2 + (side[:, :, level] >= cut)
            out[:, at : at + 512] = code
        return out


def fit(rows: DataFrame, trees: int, work: float, k: int) -> dict[int, Forest]:
    """A forest for each dimension among rows (vec_id, v, dim)."""
    forests = {}
    for r in rows.groupBy("dim").agg(F.count("*").alias("n")).collect():  # a row for each dimension
        most = min(SAMPLE, max(LEAF, NUMBERS // r["dim"]))
        share = min(1.0, 1.3 * most / r["n"] + 0.01)
        chosen = rows.where(F.col("dim") == r["dim"]).where(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 30)) < int(share * (1 << 30)))
        sample = chosen.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(most).select("v").toArrow()
        forests[r["dim"]] = Forest(vectors.matrix(sample.column("v"), r["dim"]), r["n"], trees, work, k)
    return forests


def by_dimension(batch):
    """(dim, row numbers, vectors) of a batch's rows (dim, v)."""
    import pyarrow as pa

    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        at = np.flatnonzero(dims == dim)
        yield dim, at, vectors.matrix(batch.column("v").take(pa.array(at)), dim)


def entries(rows: DataFrame, forests: dict[int, Forest], kept: tuple[str, ...], small: bool) -> DataFrame:
    """rows to (dim, tree, bucket, code, kept[, small]): a row for each tree."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for dim, at, v in by_dimension(batch):
                f = forests[dim]
                step = max(1, NUMBERS // (f.trees * dim))
                for lo in range(0, len(at), step):
                    i = at[lo : lo + step]
                    code = f.strings(v[lo : lo + step])
                    n = len(i)
                    who = pa.array(np.tile(i, f.trees))
                    columns = [pa.array(np.full(n * f.trees, dim, np.int32)), pa.array(np.repeat(np.arange(f.trees, dtype=np.int32), n)), pa.array((code >> (BITS - f.prefix)).ravel()), pa.array(code.ravel())]
                    columns += [batch.column(c).take(who) for c in kept]
                    if small:
                        body = np.tile(f.small(v[lo : lo + step]), (f.trees, 1))
                        ends = np.arange(n * f.trees + 1, dtype=np.int32) * (4 * dim)
                        columns.append(pa.Array.from_buffers(pa.binary(), n * f.trees, [None, pa.py_buffer(ends), pa.py_buffer(body)]))
                    yield pa.RecordBatch.from_arrays(columns, names=["dim", "tree", "bucket", "code", *kept, *["small"] * small])

    types = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in kept) + ", small binary" * small
    return rows.select("dim", "v", *kept).mapInArrow(run, "dim int, tree int, bucket long, code long" + types)


def cells(rows: DataFrame, forests: dict[int, Forest]) -> DataFrame:
    """(dim, tree, bucket, cell, n): how many rows have each prefix of the length at which ascents start."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for dim, _, v in by_dimension(batch):
                f = forests[dim]
                for t, code in enumerate(f.strings(v)):
                    cell, n = np.unique(code >> (BITS - f.length), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), dim, np.int32)), pa.array(np.full(len(cell), t, np.int32)), pa.array(cell >> (f.length - f.prefix)), pa.array(cell), pa.array(n.astype(np.int64))], names=["dim", "tree", "bucket", "cell", "n"])

    return rows.select("dim", "v").mapInArrow(run, "dim int, tree int, bucket long, cell long, n long").groupBy("dim", "tree", "bucket", "cell").agg(F.sum("n").alias("n"))


def counted(counts: DataFrame, asked: DataFrame, forests: dict[int, Forest]) -> DataFrame:
    """(query_id, dim, tree, held): entries in a tree that share the query's prefix, from the longest to the bucket's."""
    import pyarrow as pa

    def work(have, want):
        f = forests[want.column("dim")[0].as_py()] if want.num_rows else None
        if f is None:
            return pa.table({"query_id": pa.array([], pa.int64()), "dim": pa.array([], pa.int32()), "tree": pa.array([], pa.int32()), "held": pa.array([], pa.list_(pa.int64()))})
        cell, n = have.column("cell").to_numpy(), have.column("n").to_numpy()
        order = np.argsort(cell)
        cell, total = cell[order], np.concatenate([[0], np.cumsum(n[order])])
        own = want.column("code").to_numpy() >> (BITS - f.length)
        held = np.empty((len(own), f.length - f.prefix + 1), np.int64)
        for up in range(held.shape[1]):
            low = own >> up << up
            held[:, up] = total[np.searchsorted(cell, low + (1 << up))] - total[np.searchsorted(cell, low)]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * held.shape[1]), pa.array(held.ravel()))
        return pa.table([want.column("query_id"), want.column("dim"), want.column("tree"), lists], names=["query_id", "dim", "tree", "held"])

    on = ["dim", "tree", "bucket"]
    return counts.groupBy(*on).cogroup(asked.groupBy(*on)).applyInArrow(work, "query_id long, dim int, tree int, held array<long>")


def ascend(held: DataFrame, forests: dict[int, Forest]) -> DataFrame:
    """(query_id, level, trees, enough): prefix length at which the first trees stop; the others stop one bit deeper."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            rows = []
            for q, dim, trees in zip(*(batch.column(c).to_pylist() for c in ("query_id", "dim", "all")), strict=True):
                f = forests[dim]
                n = np.array([t["held"] for t in sorted(trees, key=lambda t: t["tree"])])
                total = n.sum(0)  # grows with every bit given up
                up = int(np.searchsorted(total, f.least))
                if up >= len(total):
                    rows.append((q, f.prefix, f.trees, False))
                elif up == 0:
                    rows.append((q, f.length, f.trees, True))
                else:
                    grown = total[up - 1] + np.cumsum(n[:, up] - n[:, up - 1])
                    rows.append((q, f.length - up, int(np.searchsorted(grown, f.least)) + 1, True))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.bool_()), strict=True)], names=["query_id", "level", "trees", "enough"])

    gathered = held.groupBy("query_id", "dim").agg(F.collect_list(F.struct("tree", "held")).alias("all"))  # a number for each tree and level
    return gathered.mapInArrow(run, "query_id long, level int, trees int, enough boolean")


def nearest(held: DataFrame, asked: DataFrame, forests: dict[int, Forest], keep: int) -> DataFrame:
    """(query_id, vec_id, near) of the keep nearest in each bucket, of those in the query's range."""
    import pyarrow as pa

    def work(have, want):
        out: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]]
        if have.num_rows and want.num_rows:
            dim = want.column("dim")[0].as_py()
            vec = lambda t: np.frombuffer(b"".join(t.column("small").to_pylist()), np.float32).reshape(t.num_rows, dim)
            code, ids = have.column("code").to_numpy(), have.column("vec_id").to_numpy()
            order = np.argsort(code, kind="stable")
            code, ids, v = code[order], ids[order], vec(have)[order]
            q, qid, own = vec(want).astype(np.float64), want.column("query_id").to_numpy(), want.column("code").to_numpy()
            up = BITS - (want.column("level").to_numpy() + (want.column("tree").to_numpy() >= want.column("trees").to_numpy()))
            low = own >> up << up
            lo, hi = np.searchsorted(code, low), np.searchsorted(code, low + (np.int64(1) << up))
            order = np.lexsort((hi, lo))  # queries of equal ranges go together
            cut = np.flatnonzero((lo[order][1:] != lo[order][:-1]) | (hi[order][1:] != hi[order][:-1])) + 1
            for same in np.split(order, cut):
                a, b = lo[same[0]], hi[same[0]]
                if a == b:
                    continue
                r = v[a:b].astype(np.float64)
                norm, step = (r * r).sum(1), max(1, 2_000_000 // (b - a))
                for at in range(0, len(same), step):
                    i = same[at : at + step]
                    near = norm[None] - 2 * q[i] @ r.T + (q[i] * q[i]).sum(1)[:, None]
                    if b - a > keep:
                        edge = np.partition(near, keep - 1, axis=1)[:, keep - 1]
                        x, y = np.nonzero(near <= edge[:, None])
                        first = np.lexsort((ids[a + y], near[x, y], x))
                        x, y = x[first], y[first]
                        few = np.arange(len(x)) - np.searchsorted(x, x) < keep
                        x, y = x[few], y[few]
                    else:
                        x, y = (z.ravel() for z in np.indices(near.shape))
                    out[0].append(qid[i][x]), out[1].append(ids[a + y]), out[2].append(near[x, y])
        return pa.table([pa.array(np.concatenate(c)) for c in out], names=["query_id", "vec_id", "near"])

    on = ["dim", "tree", "bucket"]
    return held.groupBy(*on).cogroup(asked.groupBy(*on)).applyInArrow(work, "query_id long, vec_id long, near double")


def search(df: DataFrame, is_query, k: int, key: str = "vec_id", vector: str = "embedding", trees: int = TREES, work: float = WORK) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest found by Euclidean distance."""
    rows = stage(vectors.usable(df, key, vector, zero=False), "vectors")
    equal = Window.partitionBy("dim", "v").orderBy("vec_id")
    indexed = rows.withColumn("copy", F.row_number().over(equal)).where(F.col("copy") <= k + 1).drop("copy")
    asking = rows.where(is_query)
    classes = asking.join(asking.groupBy("dim", "v").agg(F.min("vec_id").alias("query_id")), ["dim", "v"]).select("query_id", F.col("vec_id").alias("asker"))
    asked = asking.groupBy("dim", "v").agg(F.min("vec_id").alias("query_id"))
    indexed, asked, classes = stage(indexed, "indexed"), stage(asked, "asked"), stage(classes, "classes")
    forests = fit(indexed, trees, work, k)
    counts = stage(cells(indexed, forests).select("dim", "tree", "cell", "n"), "cells")
    while True:
        shift = F.create_map(*[F.lit(x) for d, f in forests.items() for x in (d, f.length - f.prefix)]) if forests else F.create_map(F.lit(0), F.lit(0))
        bucketed = counts.withColumn("bucket", F.call_function("shiftright", "cell", shift[F.col("dim")]))
        levels = stage(ascend(counted(bucketed, entries(asked, forests, ("query_id",), False), forests), forests), "levels")
        if not any(f.prefix for f in forests.values()) or levels.where("not enough").isEmpty():
            break
        for f in forests.values():
            f.prefix = max(0, f.prefix - 2)
        drop_staged(levels)
    keep = 2 * k + 2  # single precision ranks no worse than this
    found = nearest(entries(indexed, forests, ("vec_id",), True), entries(asked.join(levels, "query_id"), forests, ("query_id", "level", "trees"), True), forests, keep)
    by = Window.partitionBy("query_id").orderBy("near", "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.min("near").alias("near")).withColumn("r", F.row_number().over(by)).where(F.col("r") <= keep).select("query_id", "vec_id")
    exact = found.join(rows.select("vec_id", "v"), "vec_id").join(asked.select("query_id", F.col("v").alias("q")), "query_id")
    square = F.aggregate(F.zip_with("v", "q", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda a, x: a + x)
    exact = exact.select("query_id", "vec_id", F.sqrt(square).alias("score"))
    found = classes.join(exact, "query_id").where("asker <> vec_id")
    by = Window.partitionBy("asker").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select(F.col("asker").alias("query_id"), "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), "vec_id % 100 = 0", 10)
