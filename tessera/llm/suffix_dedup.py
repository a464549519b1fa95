"""Removal of repeated byte strings by bucket-pointer refinement of suffixes.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a document that comes
before, or earlier in the same document. Strings are judged on the input.

Suffixes need ordering to LENGTH bytes only, and only where a string can repeat at all. So the initial
q-gram buckets are those of anchors: in each window of LENGTH bytes the q-gram of least hash, leftmost
of equals, which depends on the window's content alone. Windows of equal content thus have anchors in
the same bucket, at the same offset. Buckets with one member end there. The members of the others, with
the text around them, are refined together: windows are sorted by the bucket identifiers of their
25-grams at offsets 0 and 25, buckets of one are dropped, the identifiers of 50 bytes so won are used
again at offset 50, and the last sort yields buckets of 100 bytes. The earliest window of a bucket
stays, the others are marked. Anchors of which there are more than HOT (passages that a large share of
documents quote) aren't gathered by anchor: their windows are dealt by their own identifiers, after
each chunk has reduced windows of equal content to its earliest.

Of equal texts only the one with the smallest id is refined; the others go whole (if as long as LENGTH).
Identifiers are 64-bit hashes; a false match needs a collision within one anchor's bucket.

Edge cases: a null text counts as empty; texts shorter than LENGTH lose nothing; rows with a null id
come after all others; rows of equal id and text get the same result, rows of equal id and other text
are ordered by their SHA-256; empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, by_bytes, drop_staged, mix, pack, partitions, release, room_for, split_by, stage, table, unpack, utf8_column

#: Bytes of the strings that count as repeated.
LENGTH = 100
#: Bytes of the q-grams that open the buckets.
Q = 16
#: Members of an anchor's bucket from which on its windows are dealt by their own identifiers.
HOT = 200
#: Bytes of text that a group of documents holds, and that a chunk holds, about.
GROUP, CHUNK = 4 << 20, 2 << 20
#: Bytes of text for each bucket of anchors.
BUCKET = 16 << 20
#: Bytes of contexts that are refined at a time.
SLICE = 512 << 10
#: Anchors that a task holds before it writes them out.
ANCHORS = 500_000
_WINDOW = LENGTH - Q + 1
#: Bytes of text whose anchors are sought at a time: each takes arrays of 8 bytes a byte, about ten at once.
_BLOCK = 128 << 10


def words8(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as an integer."""
    return np.ndarray((max(len(data) - 7, 0),), "<u8", np.ascontiguousarray(data).data if len(data) > 7 else b"", 0, (1,)).astype(U64)


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit identifier of the `size` bytes (8 or more) from each place on."""
    x = words8(data)
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.full(n, size, U64)
    for k in [*range(0, size - 7, 8), *([size - 8] if size % 8 else [])]:
        out = (out ^ x[k : k + n]) * U64(0x9E3779B97F4A7C15)
        out ^= out >> U64(29)
    return mix(out)


def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, identifier, place, first window, last window) of all anchors; places count from the start of data."""
    found = []
    docs = np.arange(len(off) - 1)
    long = docs[np.diff(off) >= LENGTH]
    at = 0
    while at < len(long):  # blocks, so that places fit in 24 bits
        end = max(at + 1, int(np.searchsorted(off[long + 1] - off[long[at]], _BLOCK, "right")))
        first, last = long[at], long[end - 1]
        lo, hi = int(off[first]), int(off[last + 1])
        for s in range(lo, hi, _BLOCK) if hi - lo > _BLOCK else [lo]:  # a longer text, in overlapping parts
            found.append(_block(data[s : min(hi, s + _BLOCK + LENGTH - 1)], np.clip(off[first : last + 2] - s, 0, min(hi, s + _BLOCK + LENGTH - 1) - s), first, s))
        at = end
    if not found:
        e = np.zeros(0, np.int64)
        return e, e.astype(U64), e, e, e
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _block(data: np.ndarray, off: np.ndarray, first: int, base: int) -> tuple[np.ndarray, ...]:
    if len(data) < LENGTH:
        e = np.zeros(0, np.int64)
        return e, e.astype(U64), e, e, e
    h = grams(data, Q)
    least = (h & ~U64((1 << 24) - 1)) | np.arange(len(h), dtype=U64)
    width = 1
    while 2 * width <= _WINDOW:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (_WINDOW - width)], least[_WINDOW - width :])
    place = (least & U64((1 << 24) - 1)).astype(np.int64)
    start = np.arange(len(place))
    end = np.repeat(off[1:], np.diff(off))[: len(place)]
    fits = np.flatnonzero(start + LENGTH <= end)
    if not len(fits):
        e = np.zeros(0, np.int64)
        return e, e.astype(U64), e, e, e
    p = place[fits]
    new = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (fits[1:] != fits[:-1] + 1)]))
    a = p[new]
    text = np.searchsorted(off, a, "right") - 1
    return text + first, h[a], a + base, fits[new] + base, fits[np.append(new[1:], len(fits)) - 1] + base


def _emit(rows: list[tuple], schema):
    import pyarrow as pa

    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _schema(*fields: str):
    import pyarrow as pa

    kinds = {"k": pa.int32(), "raw": pa.binary()}
    return pa.schema([(f, kinds.get(f[:1] if f != "raw" else f, pa.int32())) for f in fields])


def find_anchors(docs: DataFrame, buckets: int) -> DataFrame:
    """docs (grp, body) to (bucket, raw): identifiers, groups and counts of the anchors, one row a bucket and flush."""

    def flush(held):
        h, g = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((g, h))
        h, g = h[order], g[order]
        new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])])) if len(h) else np.zeros(0, np.int64)
        n = np.minimum(np.diff(np.append(new, len(h))), 255).astype(np.uint8)
        h, g = h[new], g[new]
        return _emit([(b, pack({"h": h[i], "g": g[i], "n": n[i]})) for b, i in split_by((h % U64(buckets)).astype(np.int32))], schema)

    schema = _schema("bucket", "raw")

    def run(batches):
        room_for("suffixes")
        held, n = [], 0
        for batch in batches:
            grp = batch.column("grp").to_numpy()
            for at, part in by_bytes(batch.column("body"), _BLOCK):
                text, h, *_ = anchors(*utf8_column(part))
                held.append((h, grp[at + text].astype(np.uint32)))
                n += len(h)
                if n > ANCHORS:
                    yield flush(held)
                    held, n = [], 0
        if n:
            yield flush(held)
        held = []
        release()

    return docs.select("grp", "body").mapInArrow(run, "bucket int, raw binary")


def repeated(found: DataFrame) -> DataFrame:
    """Identifiers of anchors that occur twice or more, with whether they are HOT, as lists for the groups that have them."""

    def reduce(tables):
        parts = [unpack(x.as_py()) for x in tables.column("raw")]
        h, g, n = (np.concatenate([p[k] for p in parts]) for k in "hgn")
        order = np.argsort(h)
        h, g, n = h[order], g[order], n[order].astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        total = np.repeat(np.add.reduceat(n, new), np.diff(np.append(new, len(h))))
        keep = total > 1
        h, g, hot = h[keep], g[keep], total[keep] > HOT
        import pyarrow as pa

        return pa.Table.from_batches([_emit([(k, pack({"h": np.unique(h[i]), "hot": np.unique(h[i][hot[i]])})) for k, i in split_by(g.astype(np.int32))], schema)])

    schema = _schema("grp", "raw")
    return found.groupBy("bucket").applyInArrow(reduce, "grp int, raw binary")


def gather(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """Of each group: the first copies of texts that have a repeated anchor, in compressed chunks with what is known of their anchors."""

    def work(left, right):
        import pyarrow as pa

        room_for("suffixes")
        rows, grp = [], None
        if left.num_rows:
            grp = left.column("grp")[0].as_py()
            mine = {"h": [np.zeros(0, U64)], "hot": [np.zeros(0, U64)]}
            first = set()
            for kind, raw in zip(right.column("kind"), right.column("raw"), strict=True):
                raw = raw.as_py()
                if kind.as_py():
                    first.add(raw)
                else:
                    for k, v in unpack(raw).items():
                        mine[k].append(v)
            rep, hot = (np.unique(np.concatenate(mine[k])) for k in ("h", "hot"))
            data, off = utf8_column(left.column("body"))
            ids = left.column("id").combine_chunks().fill_null(np.iinfo(np.int64).max).to_numpy() if left.num_rows else []
            sha = [hashlib.sha256(data[off[i] : off[i + 1]]).digest() for i in range(len(off) - 1)]
            text, h, _, _, _ = anchors(data, off)
            known = np.isin(h, rep)
            some = np.zeros(len(sha), bool)
            some[text[known]] = True
            seen, kept = set(), []
            for i in np.flatnonzero(some):
                key = int(ids[i]).to_bytes(8, "big", signed=True) + sha[i]
                if key in first and key not in seen:
                    seen.add(key)
                    kept.append(i)
            size = 0
            part: list[int] = []
            for i in kept:
                part.append(i)
                size += int(off[i + 1] - off[i])
                if size >= CHUNK or i == kept[-1]:
                    body = np.concatenate([data[off[j] : off[j + 1]] for j in part])
                    new = np.concatenate([[0], np.cumsum([off[j + 1] - off[j] for j in part])]).astype(np.int64)
                    _, again, *_ = anchors(body, new)
                    rows.append((grp, pack({"id": ids[part], "sha": [sha[j] for j in part], "off": new, "data": body, "known": np.packbits(np.isin(again, rep)), "hot": np.packbits(np.isin(again, hot))}, True)))
                    part, size = [], 0
        left = right = data = None
        release()
        return pa.Table.from_batches([_emit(rows, schema)])

    schema = _schema("grp", "raw")
    return docs.groupBy("grp").cogroup(lists.groupBy("grp")).applyInArrow(work, "grp int, raw binary")


def _tie(sha: list[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(s[:8], "big") for s in sha], U64)


def ranges_of(start: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted, marked windows of each text as disjoint byte ranges (text, from, to)."""
    order = np.lexsort((start, text))
    start, text = start[order], text[order]
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (start[1:] > start[:-1] + LENGTH)]) if len(start) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    return text[first], start[first], start[np.append(first[1:], len(start)) - 1] + LENGTH if len(first) else start


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All integers from lo to hi inclusive of each pair, and the pair each belongs to."""
    n = hi - lo + 1
    of = np.repeat(np.arange(len(n)), n)
    return np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + lo[of], of


def window_ids(g25: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Identifiers of LENGTH bytes from those of 25-grams: pairs at 0 and 25 name 50 bytes, pairs at 0 and 50 name 100."""
    half = lambda x: mix(g25[x] * U64(0xD6E8FEB86659FD93) ^ g25[x + 25])
    return mix(half(at) * U64(0xA0761D6478BD642F) ^ half(at + 50))


def contexts(chunks: DataFrame, buckets: int) -> DataFrame:
    """The repeated anchors of each chunk with the text around them, dealt by anchor; hot ones as windows, dealt by content."""

    def run(batches):
        room_for("suffixes")
        for batch in batches:
            for grp, raw in zip(batch.column("grp"), batch.column("raw"), strict=True):
                yield from chunk(grp.as_py(), unpack(raw.as_py(), True))
        release()

    def chunk(grp, c):
        data, off = c["data"], c["off"]
        text, h, place, lo, hi = anchors(data, off)
        known = np.unpackbits(c["known"], count=len(h)).astype(bool)
        hot = np.unpackbits(c["hot"], count=len(h)).astype(bool)
        tie, ids = _tie(c["sha"]), c["id"]
        cold = np.flatnonzero(known & ~hot)
        rows = []
        for b, i in split_by((h[cold] % U64(buckets)).astype(np.int32)):
            i = cold[i]
            docs, mine = np.unique(text[i], return_inverse=True)
            at, _ = _spread(lo[i], hi[i] + LENGTH - 1)
            rows.append((b, pack({"grp": grp, "id": ids[docs], "tie": tie[docs], "doc": mine.astype(np.uint16 if len(docs) < 65536 else np.uint32), "h": h[i], "place": (place[i] - off[text[i]]).astype(np.uint32), "before": (place[i] - lo[i]).astype(np.uint8), "n": (hi[i] - lo[i]).astype(np.uint8), "data": data[at]}, True)))
        much = np.flatnonzero(known & hot)
        if len(much):
            at, of = _spread(lo[much], hi[much])
            doc = text[much][of]
            order = np.lexsort((at, tie[doc], ids[doc]))
            at, doc = at[order], doc[order]
            w = window_ids(grams(data, 25), at)
            _, first = np.unique(w, return_index=True)  # the earliest of each content
            again = np.ones(len(w), bool)
            again[first] = False
            d, s, e = ranges_of(at[again], doc[again])
            if len(d):
                rows.append((int(grp) % buckets, pack({"grp": grp, "id": ids[d], "tie": tie[d], "from": s - off[d], "to": e - off[d]}, True)))
            w, at, doc = w[first], at[first], doc[first]
            for b, i in split_by((w % U64(buckets)).astype(np.int32)):
                docs, mine = np.unique(doc[i], return_inverse=True)
                rows.append((b, pack({"grp": grp, "id": ids[docs], "tie": tie[docs], "doc": mine.astype(np.uint32), "w": w[i], "start": (at[i] - off[doc[i]]).astype(np.uint32)}, True)))
        yield _emit(rows, schema)

    schema = _schema("bucket", "raw")
    return chunks.mapInArrow(run, "bucket int, raw binary")


def refine(dealt: DataFrame) -> DataFrame:
    """Windows that also start earlier, as byte ranges, in lists for the groups of their documents."""

    def reduce(tables):
        import pyarrow as pa

        room_for("suffixes")
        out, cold, hot, data = [], [], [], bytearray()
        for x in tables.column("raw"):
            p = unpack(x.as_py(), True)
            if "from" in p:
                out.append((np.full(len(p["id"]), p["grp"]), p["id"], p["tie"], p["from"], p["to"]))
            elif "h" in p:
                data += memoryview(p.pop("data"))  # one copy of the contexts is held, not a second in parts
                cold.append(p)
            else:
                hot.append(p)
        if cold:
            ranks = ranked(cold)
            out += [marked(*ranks, *part) for part in _refined(cold, np.frombuffer(data, np.uint8))]
        if hot:
            n = [len(p["w"]) for p in hot]
            w, start = (np.concatenate([p[k] for p in hot]) for k in ("w", "start"))
            part = np.repeat(np.arange(len(hot)), n)
            doc = np.concatenate([p["doc"] for p in hot]).astype(np.int64)
            out.append(marked(*ranked(hot), part, doc, start.astype(np.int64), w))
        rows = []
        if out:
            g, i, t, s, e = (np.concatenate(x) for x in zip(*out, strict=True))
            rows = [(k, pack({"id": i[x], "tie": t[x], "from": s[x], "to": e[x]}, True)) for k, x in split_by(g)]
        out = cold = hot = data = None
        release()
        return pa.Table.from_batches([_emit(rows, schema)])

    def ranked(parts):
        """Of all documents of the parts: group, id, tie, rank; and where each part's begin."""
        n = [len(p["id"]) for p in parts]
        ids, tie = (np.concatenate([p[k] for p in parts]) for k in ("id", "tie"))
        rank = np.empty(len(ids), np.int64)
        order = np.lexsort((tie, ids))
        new = np.concatenate([[False], (ids[order][1:] != ids[order][:-1]) | (tie[order][1:] != tie[order][:-1])])
        rank[order] = np.cumsum(new)
        return np.repeat([p["grp"] for p in parts], n), ids, tie, rank, np.cumsum([0, *n])[:-1]

    def marked(grp, ids, tie, rank, base, part, doc, start, w):
        """Sort by identifier, then by document and place; all but the first of each bucket are marked."""
        doc = base[part] + doc
        where = (rank[doc] << 32) + start
        order = np.lexsort((where, w))
        same = np.flatnonzero(w[order][1:] == w[order][:-1]) + 1
        again = order[same]
        d, s, e = ranges_of(start[again], doc[again])
        return grp[d], ids[d], tie[d], s, e

    def _refined(parts, data):
        """Refine in slices of the bucket: equal strings have the same anchor, so a slice has all or none of them."""
        n = np.concatenate([p["n"] for p in parts]).astype(np.int64)
        before, place, h, doc = (np.concatenate([p[k].astype(t) for p in parts]) for k, t in (("before", np.int64), ("place", np.int64), ("h", U64), ("doc", np.int64)))
        part = np.repeat(np.arange(len(parts)), [len(p["n"]) for p in parts])
        first = np.cumsum(n + LENGTH) - (n + LENGTH)  # of each context in data
        slices = -(-len(data) // SLICE)
        for _, own in split_by((h >> U64(40)).astype(np.int64) % slices):
            at, _ = _spread(first[own], first[own] + n[own] + LENGTH - 1)
            yield _slice(data[at], n[own], before[own], place[own], h[own], doc[own], part[own])

    def _slice(data, n, before, place, h, doc, part):
        first = np.cumsum(n + LENGTH) - (n + LENGTH)
        step, of = _spread(np.zeros(len(n), np.int64), n)
        at = first[of] + step
        g25 = grams(data, 25)
        # the anchor's bucket and the offset to it, refined by the identifiers of 25-grams at 0 and 25
        open_ = mix(h[of] + (step - before[of]).astype(U64) * U64(0x9E3779B97F4A7C15))
        half = mix((open_ ^ g25[at]) * U64(0xD6E8FEB86659FD93) ^ g25[at + 25])
        order = np.argsort(half)
        same = half[order][1:] == half[order][:-1]
        keep = order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
        # buckets of one are done; the rest reuse the identifiers of 50 bytes at offset 50
        at, of, step = at[keep], of[keep], step[keep]
        later = mix(g25[at + 50] * U64(0xD6E8FEB86659FD93) ^ g25[at + 75])
        whole = mix(half[keep] * U64(0xA0761D6478BD642F) ^ later)
        return part[of], doc[of], place[of] - before[of] + step, whole

    schema = _schema("grp", "raw")
    return dealt.groupBy("bucket").applyInArrow(reduce, "grp int, raw binary")


def results(chunks: DataFrame, marks: DataFrame, with_text: bool = False) -> DataFrame:
    """sha (of the text), n_removed, n_spans, kept_sha256 [, kept] of the texts that lose something."""

    def work(left, right):
        import pyarrow as pa

        rows = []
        by: dict[tuple[int, int], list] = {}
        for raw in right.column("raw"):
            m = unpack(raw.as_py(), True)
            for i, t, s, e in zip(m["id"].tolist(), m["tie"].tolist(), m["from"].tolist(), m["to"].tolist(), strict=True):
                by.setdefault((i, t), []).append((s, e))
        for raw in left.column("raw") if by else []:
            c = unpack(raw.as_py(), True)
            tie = _tie(c["sha"])
            for k, key in enumerate(zip(c["id"].tolist(), tie.tolist(), strict=True)):
                if key not in by:
                    continue
                text = c["data"][c["off"][k] : c["off"][k + 1]]
                kept, spans, last = [], 0, -1
                at = 0
                for s, e in sorted(by[key]):
                    if s > last:
                        spans += 1
                    if s > at:
                        kept.append(text[at:s])
                    at = last = max(e, last)
                kept = b"".join([x.tobytes() for x in [*kept, text[at:]]])
                rows.append((c["sha"][k].hex(), len(text) - len(kept), spans, hashlib.sha256(kept).hexdigest(), *([kept.decode("utf-8", "ignore")] if with_text else [])))
        columns = list(zip(*rows, strict=True)) if rows else [[] for _ in schema]
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    import pyarrow as pa

    schema = pa.schema([("sha", pa.string()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), *([("kept", pa.string())] if with_text else [])])
    return chunks.groupBy("grp").cogroup(marks.groupBy("grp")).applyInArrow(work, "sha string, n_removed long, n_spans long, kept_sha256 string" + ", kept string" * with_text)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", with_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """(held: id, sha, n_bytes, first of every row; results() of the first copies that lose something)."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    docs = docs.select(F.col(key).alias("id"), body.alias("body"))
    held = stage(docs.select("id", F.sha2(F.col("body").cast("binary"), 256).alias("sha"), F.octet_length("body").cast("long").alias("n_bytes")), "texts")
    size = int(held.agg(F.sum("n_bytes")).first()[0] or 0)
    groups = max(partitions(spark), size // GROUP)
    group = lambda sha: F.pmod(F.xxhash64(F.col("id"), sha), F.lit(groups)).cast("int").alias("grp")
    grouped = docs.select(group(F.sha2(F.col("body").cast("binary"), 256)), "id", "body")
    firsts = held.groupBy("sha").agg(F.min("id").alias("first_id"))
    rep = firsts.select(F.col("first_id").alias("id"), "sha")
    last = F.lit(np.iinfo(np.int64).max)
    names = rep.select(group(F.col("sha")), F.lit(1).alias("kind"), F.concat(F.unhex(F.lpad(F.hex(F.coalesce("id", last)), 16, "0")), F.unhex("sha")).alias("raw"))
    lists = stage(repeated(find_anchors(grouped, max(partitions(spark), size // BUCKET))), "repeated")
    chunks = stage(gather(grouped, lists.select("grp", F.lit(0).alias("kind"), "raw").unionByName(names)), "chunks")
    drop_staged(lists)
    marks = stage(refine(contexts(chunks, max(partitions(spark), size // BUCKET))), "marks")
    done = results(chunks, marks, with_text)
    # the first copy is known by id and text together, which no other row has, so a text that many rows have is no hot key
    mark = firsts.select("first_id", F.col("sha").alias("__sha"))
    held = held.join(mark, F.col("id").eqNullSafe(F.col("first_id")) & (F.col("sha") == F.col("__sha")), "left")
    return held.withColumn("first", F.col("__sha").isNotNull()).drop("first_id", "__sha"), done


def query(spark, sf_dir: str) -> DataFrame:
    held, done = find(table(spark, sf_dir, "documents"))
    whole = ~F.col("first") & (F.col("n_bytes") >= LENGTH)
    mine = F.col("first") & F.col("n_removed").isNotNull()
    # only first copies have results to meet; the others are dealt by their ids
    held = held.withColumn("__at", F.when(F.col("first"), F.col("sha")).otherwise(F.concat(F.lit("-"), F.col("id").cast("string"))))
    return held.join(done.withColumnRenamed("sha", "__at"), "__at", "left").select(
        F.col("id").alias("doc_id"), "n_bytes",
        F.when(whole, F.col("n_bytes")).when(mine, F.col("n_removed")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
        F.when(whole, F.lit(1)).when(mine, F.col("n_spans")).otherwise(F.lit(0)).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit("").cast("binary"), 256)).when(mine, F.col("kept_sha256")).otherwise(F.col("sha")).alias("kept_sha256"),
    )


def remove(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without repeated strings, else as they were; of a character cut through nothing stays. Rows of which no more than white space is left go."""
    held, done = find(docs, key, text, with_text=True)
    gone = held.where(~F.col("first") & (F.col("n_bytes") >= LENGTH)).select("id", "sha").distinct()
    change = held.where("first").select("id", "sha").distinct().join(done.select("sha", "kept"), "sha")
    change = change.unionByName(gone.withColumn("kept", F.lit("")))
    change = change.select(F.col("id").alias("__id"), F.col("sha").alias("__sha"), F.col("kept").alias("__kept"))
    sha = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    both = docs.withColumn("__own", sha).join(change, F.col(key).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__sha")), "left")
    both = both.where(F.col("__kept").isNull() | F.col("__kept").rlike(r"\S"))
    return both.withColumn(text, F.coalesce("__kept", text)).select(*docs.columns)
