"""Exact Jaccard self-join on word shingles by universe partitioning and the pigeonhole principle.

A document's set is its distinct shingles of SHINGLE words (lower-cased A-Z; with fewer words the whole
sequence), as 64-bit identifiers. Two documents link when 100 * |A & B| >= PERCENT * |A | B|, so that at
most H = (|A| + |B|) * (100 - PERCENT) / (100 + PERCENT) elements differ. Sizes are in bands whose bounds
grow by 100/PERCENT, so partners are in the same band or in neighbours. For each band the universe is
hashed into segments; each segment has an allocation: 1 (the subsets must be equal) or 2 (they may differ
by one element: the subset and its one-deletion neighbourhood are indexed). Allocations that add up to
more than H make sure that linked documents share a signature. Which allocation a band uses is chosen by
cost: signatures written against subsets too small to select anything, weighted by the band's population.

Some segments more than needed (SPARE of H) are cut, so linked documents share more than `spare`
segments: a document with at most `spare` empty or hot ones (signatures that more than HOT distinct sets
share) has a partner's signature elsewhere too, and needs no look at those. No partner is dropped.

Sets that are equal are one node. Members of a signature's group are compared by parity sketches, whose
distance is never above the number of elements that differ, so a pair that it rules out has no link.
First each node gives its closest partner; the closest pair of any two components follows; at
last all remaining pairs of nodes in different components. These are verified on the whole sets.
Groups of more than BLOCK members are compared in pairs of blocks, by several tasks. Components come
from large-star/small-star rounds.

Edge cases: a text that is null, empty or white space has no shingles and links with nothing; rows with
a null id take part, a component's id is its smallest non-null id; repeated rows are equal sets; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, by_bytes, drop_staged, free_shuffles, keeps, mix, pack, partitions, release, room_for, split_by, stage, table, unpack, utf8_column

SHINGLE, PERCENT = 5, 80
#: Share of H by which segments exceed what the pigeonhole principle needs.
SPARE = 0.1
#: Distinct sets with a signature from which on it is hot.
HOT = 12
#: Members of a block; larger groups are compared in pairs of blocks.
BLOCK = 2048
#: Members of a part, in which a large group is joined with what is known of it.
PART = 256
#: Bits of a sketch at least, and at most.
BITS, MOST = 1024, 1 << 17
#: Bits of the filter that tells which documents' sets are needed: at most 8 MB, however many are.
FILTER = 1 << 26
#: Signatures that a task holds before it writes them out.
FLUSH = 750_000
#: Bytes of text whose sets are made together, but for longer texts.
PIECE = 1 << 20
#: Bits of a signature that decide its bucket.
LOW = U64(0xFFFFFF)
#: Shingles for each bucket, and buckets at least; they depend on the data alone.
BUCKET, BUCKETS = 2_500_000, 64
_SEED, _STEP = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x5851F42D4C957F2D
    back = pow(base, -1, 1 << 64)
    up, down = np.full(n, base, U64), np.full(n, back, U64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = mix(np.arange(1, 257, dtype=U64) * _SEED)


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, identifier) of every word, in order."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    low = _LOWER[data]
    solid = ~_SPACE[low]
    edge = np.zeros(n + 1, bool)
    edge[off[:-1]] = edge[n] = True
    before = np.concatenate([[False], solid[:-1]]) & ~edge[:n]
    start = np.flatnonzero(solid & ~before)
    after = np.concatenate([solid[1:], [False]]) & ~edge[1:]
    end = np.flatnonzero(solid & ~after) + 1
    size = 1 << max(PIECE.bit_length(), (n - 1).bit_length())
    up, down = _powers(size)
    total = np.concatenate([np.zeros(1, U64), np.cumsum(_BYTE[low] * up[:n], dtype=U64)])
    h = mix((total[end] - total[start]) * down[start] + (end - start).astype(U64) * _SEED)
    return np.searchsorted(off, start, "right") - 1, h


def sets(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle identifiers of all texts, offsets of each text's)."""
    docs = len(off) - 1
    text, h = words(data, off)
    first = np.searchsorted(text, np.arange(docs + 1))
    if len(h) >= SHINGLE:
        c = h[: len(h) - SHINGLE + 1].copy()
        for k in range(1, SHINGLE):
            c = c * _STEP + h[k : len(h) - SHINGLE + 1 + k]
        c = mix(c)
    out, sizes = [], np.zeros(docs, np.int64)
    for i in range(docs):
        a, b = first[i], first[i + 1]
        if b - a >= SHINGLE:
            s = np.sort(c[a : b - SHINGLE + 1])
            new = np.empty(len(s), bool)
            new[0] = True
            np.not_equal(s[1:], s[:-1], out=new[1:])
            s = s[new]
        elif b > a:
            v = U64(b - a)
            for x in h[a:b]:
                v = mix(np.array([v], U64) * _STEP + x)[0]
            s = np.array([v], U64)
        else:
            continue
        out.append(s)
        sizes[i] = len(s)
    return np.concatenate(out) if out else np.zeros(0, U64), np.concatenate([[0], np.cumsum(sizes)])


def batch_sets(column):
    """sets() of an Arrow column, in parts of bounded size: (first row, data, offsets)."""
    for at, part in by_bytes(column, PIECE):
        yield at, *sets(*utf8_column(part))


def node_ids(s: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A 64-bit identifier of each set; 0 for the empty one."""
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(s * _SEED), dtype=U64)])
    n = np.diff(off).astype(U64)
    return np.where(n > 0, mix(total[off[1:]] - total[off[:-1]] + n * _STEP), U64(0))


@functools.lru_cache(maxsize=1)
def bounds() -> np.ndarray:
    b = [1]
    while b[-1] < 1 << 40:
        b.append(max(b[-1] + 1, -(-b[-1] * 100 // PERCENT)))
    return np.array(b, np.int64)


def most_apart(band: int) -> int:
    """H for partners of which the smaller is in the band."""
    top = int(bounds()[band + 1]) - 1
    return max(2 * top * (100 - PERCENT) // (100 + PERCENT), (top + top * 100 // PERCENT) * (100 - PERCENT) // (100 + PERCENT))


@functools.lru_cache(maxsize=4096)
def allocation(band: int, population: int) -> tuple[int, int, int]:
    """(segments, how many of them have allocation 2, spare): the cheaper way for the band."""
    need, top = most_apart(band) + 1, float(bounds()[band + 1])
    spare = math.ceil(SPARE * (need - 1))

    def cost(ones: int, twos: int) -> float:
        mean = top / (ones + twos)
        weak = math.exp(-mean) * (1 + mean)  # subsets of one or none select nothing
        weak2 = weak + math.exp(-mean) * mean * mean / 2
        return ones + twos * (1 + mean) + math.log2(2 + population) * (ones * weak + twos * weak2)

    ways = [(need + spare, 0, spare)]
    if need > 1:
        twos = need // 2
        extra = math.ceil(spare / 2)
        ways.append((twos + need % 2 + extra, twos + extra, extra))
    return min(ways, key=lambda w: cost(w[0] - w[1], w[1]))


def signatures(s: np.ndarray, off: np.ndarray, band: int, population: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, signature) pairs of sets under the band's partition, and for each set how many more segments it can spare."""
    m, twos, spare = allocation(band, population)
    n = len(off) - 1
    of = np.repeat(np.arange(n), np.diff(off))
    seg = ((s >> U64(32)) * U64(m) >> U64(32)).astype(np.int64)  # ascends with s, so segments are runs
    element = mix(s ^ _STEP)
    key = of * m + seg
    total = np.zeros(n * m, U64)
    size = np.zeros(n * m, np.int64)
    if len(key):
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        total[key[first]] = np.add.reduceat(element, first)
        size[key[first]] = np.diff(np.append(first, len(key)))
    salt = mix(np.arange(m, dtype=U64) + (U64(band + 1) << U64(40)))
    sig = mix(total.reshape(n, m) + salt)
    size = size.reshape(n, m)
    weak = np.where(np.arange(m) < twos, size <= 1, size == 0)
    blank = weak.sum(1)
    rich = blank <= spare  # then signatures of nothing are not needed
    use = ~((size == 0) & rich[:, None])
    rows, cols = np.nonzero(use)
    out_set, out_sig = [rows], [sig[rows, cols]]
    if twos:
        d = (seg < twos) & ~((size[of, seg] == 1) & rich[of])
        out_set.append(of[d])
        out_sig.append(mix(total[key[d]] - element[d] + salt[seg[d]]))
    return np.concatenate(out_set), np.concatenate(out_sig), np.where(rich, spare - blank, 0)


def sketches(s: np.ndarray, off: np.ndarray) -> list[bytes]:
    """For each set and each of its sketch's bits whether an odd number of elements hash to it.

    A sketch has BITS bits at least and as many as there are elements, as a power of two up to MOST: with fewer, sets
    that have nothing in common would look close.
    """
    size = np.diff(off)
    bits = np.clip(1 << np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64), BITS, MOST)
    out: list[bytes] = [b""] * len(size)
    for b, same in split_by(bits):
        step = max(1, (1 << 20) // b)
        for at in range(0, len(same), step):
            some = same[at : at + step]
            of = np.repeat(np.arange(len(some)), size[some])
            part = np.concatenate([s[off[k] : off[k + 1]] for k in some]) if len(of) else s[:0]
            hits = np.bincount(of * b + (part & U64(b - 1)).astype(np.int64), minlength=len(some) * b) & 1
            for k, row in zip(some.tolist(), np.packbits(hits.astype(np.uint8).reshape(len(some), b), axis=1), strict=True):
                out[k] = row.tobytes()
    return out


def even(marks: list[bytes]) -> np.ndarray:
    """Sketches as rows of 64-bit words, folded to the shortest one's length."""
    least = min(map(len, marks))
    if max(map(len, marks)) == least:
        return np.frombuffer(b"".join(marks), U64).reshape(len(marks), least // 8)
    return np.stack([np.bitwise_xor.reduce(np.frombuffer(m, U64).reshape(-1, least // 8), axis=0) for m in marks])


def describe(docs: DataFrame) -> DataFrame:
    """docs (id, body) to (id, n_shingles, node, sketch)."""

    def run(batches):
        import pyarrow as pa

        room_for("sets")
        keeps("sets", _powers.cache_clear)
        for batch in batches:
            n, node = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, U64)
            marks: list[bytes] = []
            for at, s, off in batch_sets(batch.column("body")):
                n[at : at + len(off) - 1], node[at : at + len(off) - 1] = np.diff(off), node_ids(s, off)
                marks += sketches(s, off)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n), pa.array(node.view(np.int64)), pa.array(marks, pa.binary())], names=["id", "n_shingles", "node", "sketch"])
        release()

    return docs.select("id", "body").mapInArrow(run, "id long, n_shingles long, node long, sketch binary")


def find_signatures(docs: DataFrame, buckets: int, population: dict[int, int]) -> DataFrame:
    """docs (body) to (bucket, raw): signatures, one row a bucket and flush.

    Of a signature the bucket, which LOW decides, and the bits above LOW are kept: more than tell sets of one bucket apart.
    """

    def flush(held):
        for role in (0, 1):
            mine = [h for h in held if h[0] == role]
            if not mine:
                continue
            base = np.concatenate([[0], np.cumsum([len(h[1]) for h in mine])])
            node, band, spare = (np.concatenate([h[k] for h in mine]) for k in (1, 2, 3))
            doc = np.concatenate([h[4] + b for h, b in zip(mine, base, strict=False)])
            sig = np.concatenate([h[5] for h in mine])
            rows = []
            for b, i in split_by((sig & LOW).astype(np.int64) % buckets):
                used, count = np.unique(doc[i], return_counts=True)  # doc ascends, and so the runs of a set need no index
                x = sig[i]
                rows.append((b, pack({"role": role, "node": node[used], "band": band[used].astype(np.uint8), "spare": np.minimum(spare[used], 255).astype(np.uint8), "count": count.astype(np.uint32 if count.max() > 65535 else np.uint16 if count.max() > 255 else np.uint8), "high": (x >> U64(32)).astype(np.uint32), "mid": (x >> U64(24)).astype(np.uint8)})))
            import pyarrow as pa

            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "raw"])

    def run(batches):
        room_for("sets")
        keeps("sets", _powers.cache_clear)
        held, n, seen = [], 0, set()
        for batch in batches:
            for _, s, off in batch_sets(batch.column("body")):
                node, size = node_ids(s, off), np.diff(off)
                fresh = []
                for i, v in enumerate(node.tolist()):
                    if v and v not in seen:
                        seen.add(v)
                        fresh.append(i)
                if not fresh:
                    continue
                fresh = np.array(fresh)
                own = np.searchsorted(bounds(), size[fresh], "right") - 1
                for band in np.unique(own):
                    i = fresh[own == band]
                    part = np.concatenate([s[off[k] : off[k + 1]] for k in i])
                    o = np.concatenate([[0], np.cumsum(size[i])])
                    for role, b in ((0, band), (1, band - 1)):
                        if b >= 0:
                            doc, sig, spare = signatures(part, o, int(b), population.get(int(b), 0))
                            order = np.argsort(doc, kind="stable")
                            held.append((role, node[i], np.full(len(i), band), spare, doc[order], sig[order]))
                            n += len(sig)
                if n > FLUSH:
                    yield from flush(held)
                    held, n, seen = [], 0, set()
        if n:
            yield from flush(held)
        held, seen = [], set()
        release()

    return docs.select("body").mapInArrow(run, "bucket int, raw binary")


def groups(found: DataFrame) -> DataFrame:
    """Groups of distinct sets with a signature in common: (grp, n, node, band * 2 + role, spare, hot); equal groups once.

    n is the number of members, a set in either role being one each.
    """
    import pyarrow as pa

    names = ["grp", "n", "node", "band", "spare", "hot"]
    kinds = [pa.int64(), pa.int32(), pa.int64()] + [pa.int32()] * 2 + [pa.bool_()]

    def reduce(tables):
        room_for("sets")
        parts = [unpack(x.as_py()) for x in tables.column("raw")]
        raw_node = np.concatenate([p["node"] for p in parts])
        own, spare = (np.concatenate([p[k] for p in parts]).astype(np.int32) for k in ("band", "spare"))
        role = np.concatenate([np.full(len(p["node"]), p["role"], np.int32) for p in parts])
        # a set under its other role is another entry; tasks that saw the same set share one
        _, entry, same = np.unique(raw_node ^ mix(role.astype(U64) + U64(7)), return_index=True, return_inverse=True)
        count = np.concatenate([p["count"] for p in parts]).astype(np.int64)
        doc = np.repeat(same, count).astype(np.int32)
        sig = np.concatenate([(p["high"].astype(U64) << U64(32)) | (p["mid"].astype(U64) << U64(24)) for p in parts]) | U64(tables.column("bucket")[0].as_py() & int(LOW))
        del parts
        order = np.argsort(sig)
        sig, doc = sig[order], doc[order]
        many = np.concatenate([[False], sig[1:] == sig[:-1]])
        many[:-1] |= many[1:]
        sig, doc = sig[many], doc[many]
        order = np.lexsort((doc, sig))
        sig, doc = sig[order], doc[order]
        keep = np.concatenate([[True], (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1])]) if len(sig) else np.zeros(0, bool)
        sig, doc = sig[keep], doc[keep]
        if not len(sig):
            return pa.Table.from_arrays([pa.array([], k) for k in kinds], names=names)
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        count = np.diff(np.append(first, len(sig)))
        node, role, spare = raw_node[entry], role[entry], spare[entry]
        band = own[entry] - role
        # the same members with another signature: the group is needed once, unless hot signatures are counted
        ids = np.add.reduceat(mix(node[doc] ^ (role[doc].astype(U64) << U64(63))), first)
        inner = np.add.reduceat((role[doc] == 0).astype(np.int64), first)
        hot = count > HOT
        group = np.where(hot, mix(sig[first]), ids)
        _, once = np.unique(group, return_index=True)
        chosen = np.zeros(len(first), bool)
        chosen[once] = True
        chosen &= (count > 1) & (inner > 0)
        of = np.repeat(np.arange(len(first)), count)
        pick = chosen[of]
        of, doc = of[pick], doc[pick]
        del sig, order, many, keep
        release()
        columns = [group[of].view(np.int64), count[of].astype(np.int32), node[doc].view(np.int64), band[doc] * 2 + role[doc], spare[doc], hot[of]]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return found.groupBy("bucket").applyInArrow(reduce, "grp long, n int, node long, band int, spare int, hot boolean")


def bit_filter(keys: DataFrame) -> np.ndarray:
    """FILTER bits, of which those are set that a row's h (0 <= h < FILTER) names."""
    rows = keys.groupBy(F.bitmap_bucket_number("h").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("h")).alias("bits")).collect()
    out = np.zeros(FILTER // 8 + 4096, np.uint8)
    for r in rows:  # 4096 bytes each
        out[(r["k"] - 1) * 4096 : r["k"] * 4096] = np.frombuffer(r["bits"], np.uint8)
    return out


def among(df: DataFrame, column: str, keys: DataFrame, work=None, to: str | None = None) -> DataFrame:
    """df without most of the rows whose column is none of the keys (its only column): a filter of bounded size, no shuffle of df.

    work maps the batches that are left, to the schema `to`, in the same worker: a second Python step in a task would take a
    second process, and executors keep those.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER)) + 1  # noqa: E731 - buckets and positions count from 1
    needed, names, schema = bit_filter(keys.select(slot(keys.columns[0]).alias("h"))), df.columns, df.schema

    def left(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            h = batch.column("__h").to_numpy() - 1
            kept = pa.array((needed[h >> 3] >> (h & 7).astype(np.uint8)) & 1 == 1)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names], schema=arrow).filter(kept)

    def run(batches):
        yield from work(left(batches)) if work else left(batches)
        release()

    return df.withColumn("__h", slot(column)).mapInArrow(run, to or schema)


def node_sets(docs: DataFrame, first: DataFrame) -> DataFrame:
    """(id, node, elements) of the documents (node, id) in first, and of a few more that the filter lets through. Texts stay where they are."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            node, raw = [], []
            for _, s, off in batch_sets(batch.column("body")):
                node += node_ids(s, off).view(np.int64).tolist()
                raw += [s[off[k] : off[k + 1]].tobytes() for k in range(len(off) - 1)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(node, pa.int64()), pa.array(raw, pa.binary())], names=["id", "node", "elements"])

    return among(docs.select("id", "body"), "id", first.select("id"), run, "id long, node long, elements binary")


def verify(pairs: DataFrame, elements: DataFrame, first: DataFrame) -> DataFrame:
    """Those of the distinct pairs (a, b) that link; each node's set is that of the document that first (node, id) names."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                both = np.concatenate([p, q])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                good.append(100 * common >= PERCENT * (len(p) + len(q) - common))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    held = among(elements, "node", pairs.select(F.explode(F.array("a", "b")).alias("node")))
    rows = pairs
    for node, x in (("a", "x"), ("b", "y")):
        who = first.select(F.col("node").alias(node), F.col("id").alias("i"))
        sets_ = held.select(F.col("node").alias("n"), F.col("id").alias("j"), F.col("elements").alias(x))
        rows = rows.join(who, node).join(sets_, (F.col(node) == F.col("n")) & F.col("i").eqNullSafe(F.col("j"))).drop("i", "j", "n")
    return rows.select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes with edges (a, b), by alternating large-star and small-star rounds."""
    edges = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        new = stage(small.where("a <> b").distinct(), "edges")
        same = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() == edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_staged(edges)
        edges = new
        if same:
            break
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out.staged_at = edges.staged_at
    return out


def members(found: DataFrame) -> DataFrame:
    """(grp, n, node, inner) of the groups that must be looked at, each member once; n bounds their members."""
    # who has more hot signatures than segments to spare must be looked for there
    busy = found.where("hot").groupBy("node", "band").agg(F.count_distinct("grp").alias("n"), F.first("spare").alias("s")).where("n > s").select("node", "band")
    kept = found.where("not hot").unionByName(found.where("hot").join(busy, ["node", "band"], "left_semi"))
    return kept.groupBy("grp", "node").agg(F.first("n").alias("n"), F.max(F.col("band") % 2 == 0).alias("inner"))


def compare(rows: dict[str, np.ndarray], how: str) -> tuple[list[np.ndarray], list[np.ndarray], list[np.ndarray]]:
    """Pairs (a, b) of one group or pair of blocks that sketches and sizes leave, as places in rows, and how far apart the sketches are."""
    node, size, inner, root, sketch = (rows[k] for k in ("node", "size", "inner", "root", "sketch"))
    block = rows["block"]
    left = np.flatnonzero(block == block.min())
    right = np.flatnonzero(block == block.max())
    out_a, out_b, out_d = [], [], []
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    step = max(1, 4_000_000 // (sketch.shape[1] * len(right)))
    for at in range(0, len(left), step):
        i = left[at : at + step]
        d = np.bitwise_count(sketch[i][:, None, :] ^ sketch[right][None, :, :]).sum(2, dtype=np.int32)
        a, b = size[i][:, None].astype(np.int64), size[right][None, :].astype(np.int64)
        fine = ((100 + PERCENT) * d <= (100 - PERCENT) * (a + b)) & (100 * np.minimum(a, b) >= PERCENT * np.maximum(a, b))
        fine &= (inner[i][:, None] | inner[right][None, :]) & (node[i][:, None] != node[right][None, :])
        if how != "first":
            fine &= root[i][:, None] != root[right][None, :]
        p, q = np.nonzero(fine)
        if not len(p):
            continue
        x, y = i[p], right[q]
        if how == "best":
            for u, v, n in zip(x.tolist(), y.tolist(), d[p, q].tolist(), strict=True):
                key = (int(min(root[u], root[v])), int(max(root[u], root[v])))
                if key not in best or n < best[key][0]:
                    best[key] = (n, u, v)
        else:
            out_a.append(x), out_b.append(y), out_d.append(d[p, q])
    if how == "best":
        return [np.array([v[1] for v in best.values()], np.int64)], [np.array([v[2] for v in best.values()], np.int64)], [np.array([v[0] for v in best.values()], np.int32)]
    if how == "first" and out_a:
        x, y, n = np.concatenate(out_a), np.concatenate(out_b), np.concatenate(out_d)
        x, y, n = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([n, n])
        order = np.lexsort((node[y], n, x))  # each one's closest partner
        x, y, n = x[order], y[order], n[order]
        new = np.concatenate([[True], x[1:] != x[:-1]])
        return [x[new]], [y[new]], [n[new]]
    return out_a, out_b, out_d


def candidates(member: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """Distinct pairs (a > b) of a group's members (grp, n, node, inner, root), a staged table, that may link; marks is (node, size, sketch).

    how: "first" gives each node one partner, "best" any two components one pair, "all" every pair of nodes in different components.
    """
    import pyarrow as pa

    spark = member.sparkSession
    sized = member.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    full = sized.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(marks, "node")
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    full = full.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    buckets = max(partitions(spark), member.count() // 100_000)
    full = full.withColumn("bucket", F.pmod(F.xxhash64("grp", "i", "j"), F.lit(buckets)).cast("int"))

    def work(t):
        n = t.num_rows
        rows = {c: t.column(c).to_numpy() for c in ("node", "size", "root", "block", "grp", "i", "j")}
        rows["inner"] = t.column("inner").to_numpy(zero_copy_only=False)
        marks = t.column("sketch").to_pylist()
        order = np.lexsort((rows["j"], rows["i"], rows["grp"]))
        rows, marks = {k: v[order] for k, v in rows.items()}, [marks[k] for k in order]
        key = [rows[k] for k in ("grp", "i", "j")]
        cut = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in key])) + 1 if n else np.zeros(0, np.int64)
        a, b, d = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for s, e in zip(np.append(0, cut), np.append(cut, n), strict=True):
            if e - s > 1:
                x, y, z = compare({k: v[s:e] for k, v in rows.items()} | {"sketch": even(marks[s:e])}, how)
                a += [rows["node"][s + v] for v in x]
                b += [rows["node"][s + v] for v in y]
                d += z
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b), "d": np.concatenate(d).astype(np.int32)})

    found = full.select("bucket", "grp", "i", "j", "block", "node", "size", "inner", "root", "sketch").groupBy("bucket").applyInArrow(work, "a long, b long, d int")
    if how == "first":  # groups told each node's closest partner in them
        found = found.groupBy("a").agg(F.min(F.struct("d", "b")).alias("p")).select("a", "p.b")
    return found.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def with_roots(member: DataFrame, roots: DataFrame) -> DataFrame:
    """member of the groups that span components, with each one's root. Large groups are told by parts, so that none is one task's."""
    rooted = member.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    parts = F.ceil(F.col("n") / PART).cast("int")
    mixed = rooted.groupBy("grp").agg(F.first("n").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi")
    mixed = mixed.select("grp", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    return rooted.withColumn("part", F.pmod(F.xxhash64("node"), parts).cast("int")).join(mixed, ["grp", "part"], "left_semi").drop("part")


def link(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_shingles, component_id) of every row."""
    spark = docs.sparkSession
    docs = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("body"))
    done: list[DataFrame] = []  # tables that only the rounds below read

    def aside(df: DataFrame, label: str) -> DataFrame:
        done.append(stage(df, label))
        del df
        free_shuffles(spark)
        return done[-1]

    held = stage(describe(docs), "sets")
    total = held.agg(F.sum("n_shingles")).first()[0] or 0
    sizes = held.where("n_shingles > 0").groupBy(F.floor(F.log2("n_shingles") * 8).alias("b")).agg(F.count("*").alias("n"), F.min("n_shingles").alias("s"))  # at most 8 rows a doubling
    population: dict[int, int] = {}
    for r in sizes.collect():
        band = int(np.searchsorted(bounds(), r["s"], "right")) - 1
        population[band] = population.get(band, 0) + r["n"]
    buckets = max(BUCKETS, total // BUCKET)
    found = aside(members(aside(groups(find_signatures(docs, buckets, population)), "groups")), "members")
    drop_staged(done.pop(0))
    marks = held.join(found.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.first("n_shingles").cast("int").alias("size"), F.first("sketch").alias("sketch"))
    marks = aside(marks, "sketches")
    pairs = aside(candidates(found.withColumn("root", F.col("node")), marks, "first"), "pairs")
    # every node that any other may link with is in one of these pairs, so these sets suffice for all rounds
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    first = aside(held.select("id", "node").join(wanted, "node", "left_semi").groupBy("node").agg(F.min("id").alias("id")), "first")
    elements = aside(node_sets(docs, first), "elements")
    links, tried = aside(verify(pairs, elements, first), "links"), pairs
    roots = components(links)
    found = found.join(wanted, "node", "left_semi")
    for how in ("best", "all"):
        mixed = aside(with_roots(found, roots), "mixed")
        pairs = aside(candidates(mixed, marks, how).join(tried, ["a", "b"], "left_anti"), "pairs")
        more = aside(verify(pairs, elements, first), "links")
        tried = tried.unionByName(pairs)
        if not more.isEmpty():
            links = links.unionByName(more)
            drop_staged(roots)
            roots = components(links)
    drop_staged(*done)
    named = held.drop("sketch").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    # sets without shingles link with nothing: spread them instead of gathering them under one root
    named = named.withColumn("root", F.when(F.col("n_shingles") == 0, F.xxhash64("id")).otherwise(F.col("root")))
    least = named.where("n_shingles > 0").groupBy("root").agg(F.min("id").alias("least"))
    named = named.join(least, "root", "left")
    return named.select("id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("least")).alias("component_id"))


def sort_out(docs: DataFrame, key: str, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that may be among gone (key), all others): by a filter of FILTER bits, broadcast as 64-bit words, so the rows stay where they are."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER))
    bits = gone.select(slot(key).alias("h")).groupBy(F.shiftright("h", 6).alias("__w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("h") % 64).cast("int"))).alias("__bits"))
    bits = stage(bits, "filter")  # FILTER / 64 rows at most
    marked = docs.withColumn("__w", F.shiftright(slot(key), 6)).join(F.broadcast(bits), "__w", "left")
    hit = F.call_function("shiftright", F.coalesce("__bits", F.lit(0).cast("long")), (slot(key) % 64).cast("int")) % 2 != 0
    return marked.where(hit).select(*docs.columns), marked.where(~hit).select(*docs.columns)


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the rows that another of their component represents.

    The row of smallest id stays; a row with a null id only if its component has no other id, and of several such
    texts one. Of repeated rows, equal in id and text, the one of smallest other columns stays; an id of several texts
    stays with all of them if it does with one. Ids are below 2**62.
    """
    # null ids stand behind all others, the same for equal texts
    spare = F.lit(1 << 62).cast("long") + F.pmod(F.xxhash64(text), F.lit(1 << 61))
    keyed = docs.withColumn("__key", F.coalesce(F.col(key).cast("long"), spare))
    found = stage(link(keyed, "__key", text).select(F.col("id").alias("__key"), "component_id"), "kept")
    gone = found.groupBy("__key").agg(F.max(F.col("component_id") == F.col("__key")).alias("stays")).where("not stays").select("__key")
    unsure, sure = sort_out(keyed, "__key", gone)
    kept = sure.unionByName(unsure.join(gone, "__key", "left_anti"))
    twice = stage(found.groupBy("__key").count().where("count > 1").select("__key"), "twice")
    if not twice.isEmpty():
        unsure, sure = sort_out(kept, "__key", twice)
        others = [c for c in docs.columns if c not in (key, text)]
        again = unsure.groupBy(key, text).agg(F.min(F.struct(*others, "__key")).alias("__o")).select(key, text, *(F.col("__o")[c].alias(c) for c in [*others, "__key"]))
        kept = sure.unionByName(again.select(*sure.columns))
    return kept.select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
