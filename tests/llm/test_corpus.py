"""Joins, repeated passages, searches, the classifier and the pipeline against plain versions."""

import hashlib
import random
import re
import tracemalloc
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import histogram_topk, jaccard_join, lsh_forest, quality_gam, suffix_dedup

UP = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
SF = "/root/testdata/sf0.001"


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UP))
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def plain_components(rows):
    sets = [shingles(t) for _, t in rows]
    distinct = list({s for s in sets if s})
    at = {s: i for i, s in enumerate(distinct)}
    parent = list(range(len(distinct)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = {}
    for i, s in enumerate(distinct):
        common = {}
        for x in s:
            for j in where.setdefault(x, []):
                common[j] = common.get(j, 0) + 1
            where[x].append(i)
        for j, n in common.items():
            if 100 * n >= 80 * (len(s) + len(distinct[j]) - n) and root(i) != root(j):
                parent[root(i)] = root(j)
    least = {}
    for (d, _), s in zip(rows, sets, strict=True):
        if s and d is not None:
            r = root(at[s])
            least[r] = min(least.get(r, d), d)
    return sorted(((d, len(s), least.get(root(at[s])) if s else d) for (d, _), s in zip(rows, sets, strict=True)), key=str)


def corpus():
    rng = random.Random(1)
    w = [f"w{i}" for i in range(3000)]
    rows = [(5000, "a b c"), (5001, "A b C"), (None, "a b c"), (5002, None), (5003, "  \n"), (5001, "x y z w"), (5003, " "), (4000, "é É ü w z"), (4001, "é é ü w z"), (5004, ""), (5004, "")]
    for _ in range(40):
        n = rng.choice([5, 7, 9, 12, 16, 20, 30, 60, 120, 300])
        base = rng.choices(w, k=n)
        for _ in range(rng.randint(2, 6)):
            t = list(base)
            for _ in range(rng.randint(0, max(1, n // 60))):
                t[rng.randrange(n)] = rng.choice(w)
            rows.append((6000 + len(rows), " ".join(t)))
    base, passage = rng.choices(w, k=200), rng.choices(w, k=56)
    for j in range(90):  # a group in which not all are linked to the first, and documents that share a passage only
        t = list(base)
        t[rng.randrange(200)] = rng.choice(w)
        rows.append((9000 + j, " ".join(t[: 200 - rng.randint(0, 40)])))
        rows.append((10000 + j, " ".join(rng.choices(w, k=50) + passage + rng.choices(w, k=50))))
    return rows


def test_jaccard_join(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()] + corpus()
    got = jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == plain_components(rows)


def test_jaccard_join_in_pairs_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 16)
    rows = corpus()
    got = jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert sorted(map(tuple, got), key=str) == plain_components(rows)


def test_jaccard_edges(spark):
    none = spark.createDataFrame([], "doc_id long, text string, node string")
    assert jaccard_join.link(none).collect() == []
    docs = spark.createDataFrame([(2, "a b c d e f", "n"), (1, "A b c d e f", "n"), (3, None, None), (None, "q", None), (1, "A b c d e f", "n")], none.schema)
    assert sorted((r["doc_id"], r["node"]) for r in jaccard_join.keep_one(docs).where("doc_id is not null").collect()) == [(1, "n"), (3, None)]


def test_sets_take_one_python_step(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (2, None)], "id long, body string")
    got = jaccard_join.node_sets(docs, docs.select(F.lit(0).cast("long").alias("node"), "id"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted((r["id"], len(r["elements"])) for r in got.collect()) == [(1, 16), (2, 0)]


@pytest.mark.parametrize("population", [0, 10**12])
@pytest.mark.parametrize("band", [0, 3, 8, 14, 20])
def test_partners_share_a_signature(band, population):
    rng = np.random.default_rng(band)
    low, high = jaccard_join.bounds()[band : band + 2]
    for _ in range(60):
        n = int(rng.integers(low, high))
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = a.copy()
        while True:
            c = np.unique(np.append(np.delete(b, rng.integers(len(b))), rng.integers(0, 2**63, 1).astype(np.uint64)) if rng.random() < 0.5 else np.append(b, rng.integers(0, 2**63, 1).astype(np.uint64)))
            common = len(np.intersect1d(a, c))
            if 100 * common < 80 * (len(a) + len(c) - common) or len(c) >= 1.25 * high:
                break
            b = c
        sig = [jaccard_join.signatures(x, np.array([0, len(x)]), band, population)[1] for x in (a, b)]
        assert np.intersect1d(*sig).size or (len(a) == len(b) and (a == b).all())


def plain_removal(rows):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).digest())):
        b = (t or "").encode()
        mark = bytearray(len(b))
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                mark[p : p + 100] = b"\1" * 100
            else:
                seen.add(b[p : p + 100])
        kept = bytes(x for x, m in zip(b, mark, strict=True) if not m)
        runs = sum(1 for k in range(len(mark)) if mark[k] and (k == 0 or not mark[k - 1]))
        out.setdefault((i, t), (i, len(b), sum(mark), runs, hashlib.sha256(kept).hexdigest()))
    return sorted((out[(i, t)] for i, t in rows), key=str)


def test_repeated_strings(spark, tmp_path):
    rng = random.Random(2)
    passage = "".join(rng.choices("abcdefgh ", k=180))
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(5000, "abc " * 200), (5001, "a" * 500), (None, "a" * 300), (5002, None), (5003, "é" * 120), (5001, "x" * 150), (5003, "é" * 120), (5004, ""), (5005, "b" * 99)]
    # more quotes of one passage than HOT
    rows += [(7000 + k, "".join(rng.choices("ijklmn ", k=rng.randint(20, 150))) + passage + "".join(rng.choices("opqrst ", k=rng.randint(0, 150)))) for k in range(suffix_dedup.HOT + 60)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.query(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == plain_removal(rows)


def test_long_texts_are_cut_into_overlapping_parts(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_BLOCK", 1000)
    rng = np.random.default_rng(3)
    data = rng.integers(97, 101, 5000).astype(np.uint8)
    _, _, place, lo, hi = suffix_dedup.anchors(data, np.array([0, 4300, 4350, 5000]))
    windows = np.concatenate([np.arange(a, b + 1) for a, b in zip(lo, hi, strict=True)])
    assert sorted(windows.tolist()) == [*range(0, 4201), *range(4350, 4901)]
    assert ((place >= lo) & (place <= hi + 84)).all() and (place >= hi).all()


def test_anchors_take_little_memory():
    data = np.random.default_rng(5).integers(97, 123, 4 << 20).astype(np.uint8)
    tracemalloc.start()
    suffix_dedup.anchors(data, np.arange(0, len(data) + 1, 4096))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 48 << 20


def test_removal_from_texts(spark):
    e = "".join(chr(0x100 + k) for k in range(60))
    docs = spark.createDataFrame([(1, "k " + e, "s"), (2, "x" + e + " tail", "s"), (3, None, None), (4, "k " + e, "t")], "doc_id long, text string, sha string")
    got = {(r["doc_id"], r["text"], r["sha"]) for r in suffix_dedup.remove(docs).collect()}
    assert got == {(1, "k " + e, "s"), (2, "x tail", "s"), (3, None, None)}
    assert suffix_dedup.remove(docs.limit(0)).collect() == []


VECTORS = "vec_id long, embedding array<float>, score string"


def vectors():
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)], None) for i in range(900)]
    rows += [(1000 + i, rows[0][1], None) for i in range(30)]  # ties
    rows += [(2000, None, None), (2100, [1.0, None] + [0.0] * 6, None), (2200, [float("nan")] + [0.0] * 7, None), (2300, [0.0] * 8, None), (None, [1.0] * 8, None), (2400, [1.0, 2.0], None), (2500, [float("inf")] * 8, None), (rows[5][0], rows[5][1], "again")]
    return rows


def usable(rows, zero):
    return {i: np.array(v, float) for i, v, _ in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and (zero or any(v))}


def test_exact_top_k(spark):
    rows = vectors()
    v = {i: np.floor(256 * x).astype(int) for i, x in usable(rows, True).items()}
    want = []
    for q in v:
        if q % 50 == 0:
            best = sorted((-int(v[q] @ x), i) for i, x in v.items() if i != q and len(x) == len(v[q]))[:5]
            want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    got = histogram_topk.search(spark.createDataFrame(rows, VECTORS), "vec_id % 50 = 0", 5, bins=7)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    few = spark.createDataFrame(rows[:3], VECTORS)
    assert histogram_topk.search(few, "vec_id = 0", 5).count() == 2
    assert histogram_topk.search(few.limit(0), "vec_id = 0", 5).collect() == []


def test_nearest_neighbours(spark):
    rows = vectors()
    v = usable(rows, False)
    want = {}
    for q in v:
        if q % 100 == 0:
            best = sorted((float(np.sqrt(((v[q] - x) ** 2).sum())), i) for i, x in v.items() if i != q and len(x) == len(v[q]))[:10]
            want[q] = best
    got = {}
    for r in lsh_forest.search(spark.createDataFrame(rows, VECTORS), "vec_id % 100 = 0", 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["score"], r["vec_id"]))
        assert r["rank"] == len(got[r["query_id"]])
    assert set(got) == {q for q in want if want[q]}
    hit = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in got)
    assert hit >= 0.9 * sum(map(len, want.values()))
    assert all(x == sorted(x) for x in got.values())
    whole = lsh_forest.search(spark.createDataFrame(rows, VECTORS), "vec_id % 100 = 0", 10, work=1e9)  # everything is compared
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in whole.collect()} == {(q, k + 1, i) for q in want for k, (_, i) in enumerate(want[q])}


def test_nearest_neighbours_of_few_and_none(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0], "x"), (100, [1.0, 0.0], None), (7, [0.0, 1.0], "y"), (200, [5.0], None)], VECTORS)
    got = {tuple(r) for r in lsh_forest.search(rows, "vec_id % 100 = 0", 10).collect()}
    far = float(np.sqrt(2.0))
    assert got == {(0, 1, 100, 0.0), (0, 2, 7, far), (100, 1, 0, 0.0), (100, 2, 7, far)}
    assert lsh_forest.search(rows.limit(0), "vec_id % 100 = 0", 10).collect() == []


def test_many_copies_of_a_vector(spark):
    copies = [(i, [0.5, 0.25, 1.0], None) for i in range(700)] + [(1000 + i, [float(i), 1.0, 0.0], None) for i in range(50)]
    got = lsh_forest.search(spark.createDataFrame(copies, VECTORS), "vec_id % 100 = 0", 3).collect()
    near = {q: sorted((r["rank"], r["vec_id"]) for r in got if r["query_id"] == q) for q in (0, 100, 600)}
    assert near == {0: [(1, 1), (2, 2), (3, 3)], 100: [(1, 0), (2, 1), (3, 2)], 600: [(1, 0), (2, 1), (3, 2)]}


def test_ascent_stops_where_a_plain_one_does(spark, monkeypatch):
    monkeypatch.setattr(lsh_forest, "ROWS", 64)  # several buckets for each tree
    rows = spark.createDataFrame([(i, v, None) for i, v, _ in vectors()[:900]], VECTORS).select("vec_id", F.col("embedding").cast("array<double>").alias("v"), F.lit(8).alias("dim"))
    forests = lsh_forest.fit(rows, 12, 2.0, 3)
    f = forests[8]
    assert f.prefix > 0
    asked = rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    counts = lsh_forest.cells(rows, forests)
    got = {r["query_id"]: (r["level"], r["trees"]) for r in lsh_forest.ascend(lsh_forest.counted(counts, lsh_forest.entries(asked, forests, ("query_id",), False), forests), forests).collect()}
    ids = [r["vec_id"] for r in rows.collect()]
    strings = [[format(x, f"0{lsh_forest.BITS}b") for x in tree] for tree in f.strings(np.array([r["v"] for r in rows.collect()])).tolist()]
    for q in got:
        at = ids.index(q)
        held = [0] * 12
        for level in range(f.length, -1, -1):
            for t in range(12):
                held[t] = sum(x.startswith(strings[t][at][:level]) for x in strings[t])
                if sum(held) >= f.least:
                    break
            if sum(held) >= f.least:
                break
        assert got[q] == (level, 12 if level == f.length else t + 1)


def test_scores_beyond_64_bits_are_refused(spark):
    with pytest.raises(OverflowError):
        histogram_topk.search(spark.createDataFrame([(0, [1e30], None), (1, [1e30], None)], VECTORS), "vec_id = 0", 5)


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in quality_gam.query(spark, sf).collect()}
    assert len(got) == 1000
    truth = [(r["quality"], got[r["doc_id"]]) for r in labels.collect()]
    held = [(y, r) for y, r in truth if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    assert sum(y == r["predicted"] for y, r in held) >= 0.93 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got.values())
    model = quality_gam.train(docs.limit(0), labels)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (2, "", "y"), (None, "z " * 10**6, None)], "doc_id long, text string, score string")
    assert [r["score"] for r in quality_gam.score(odd, model).collect()] == [0.5] * 4
    swapped = labels.withColumn("quality", 1 - labels["quality"]).where("crc32(cast(doc_id as string)) % 5 = 0")
    again = quality_gam.train(docs, labels.where("crc32(cast(doc_id as string)) % 5 <> 0").unionByName(swapped))
    first = quality_gam.train(docs, labels)
    assert all((a == b).all() for a, b in zip(first.tables, again.tables, strict=True))  # held-out labels teach nothing


def test_features_do_not_depend_on_neighbours():
    texts = [b"", "Ab! é, x|y\nAb! é, x|y".encode(), b"a" * 70000, b"THE!! END!!", b" "]
    off = np.cumsum([0] + [len(t) for t in texts])
    whole = quality_gam.features(np.frombuffer(b"".join(texts), np.uint8), off)
    for k, t in enumerate(texts):
        assert np.allclose(whole[k], quality_gam.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0])


def plain_pieces(rows, before):
    """Each document's pieces are all of its ids, in order, and sequences have neither gaps nor more than 2048 ids."""
    from tokenizers import Tokenizer

    from tessera.llm import bpe

    tok = Tokenizer.from_file(bpe.vocabulary("word_bpe_49k.json"))
    tok.no_truncation()
    by, sequences = {}, {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert set(by) == {r["doc_id"] for r in before}
    for d in before:
        ids = np.array(tok.encode(d["text"] or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for r in sorted(by[d["doc_id"]], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids[at : at + r["length"]].tobytes()))
            at += r["length"]
        assert at == len(ids)
    for pieces in sequences.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 2048


def test_keep_one_of_rows_without_ids(spark):
    rows = [(1, "a b c d e f g", "x"), (None, "a b c d e f g", "y"), (None, "A b c d e f g", "z"), (None, "p q r s t u v", "1"), (None, "P q r s t u v", "2"), (None, None, "n"), (None, None, "m"), (None, "", "e"), (3, "k l", "b"), (3, "k l", "a"), (3, "other words of it", "c"), (2, "A b c d e f g", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, sketch string")
    got = sorted(((r["doc_id"], r["text"], r["sketch"]) for r in jaccard_join.keep_one(docs).collect()), key=str)
    null = [r for r in got if r[0] is None]
    assert [r for r in got if r[0] is not None] == [(1, "a b c d e f g", "x"), (3, "k l", "a"), (3, "other words of it", "c")]
    assert len(null) == 3 and {r[1] and r[1].lower() for r in null} == {"p q r s t u v", None, ""} and (None, None, "m") in null
    assert jaccard_join.keep_one(docs.limit(0)).collect() == []


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.collect()
    for k, (_, work) in enumerate(corpus_pipeline.STAGES):
        out = work(spark, docs, sf)
        if k < 4:
            assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"] and dict(out.dtypes) == dict(docs.dtypes)
        rows = out.collect()
        if k == 0:
            scored = {r["doc_id"]: r["predicted"] for r in quality_gam.query(spark, sf).collect()}
            assert {r["doc_id"] for r in rows} == {i for i, p in scored.items() if p == 1}
        elif k == 1:
            parts = plain_components([(r["doc_id"], r["text"]) for r in before])
            assert {r["doc_id"] for r in rows} == {c for _, _, c in parts}
        elif k == 2:
            plain = {i: (n, gone) for i, n, gone, _, _ in plain_removal([(r["doc_id"], r["text"]) for r in before])}
            assert {r["doc_id"] for r in rows} >= {i for i, (n, gone) in plain.items() if gone == 0}
            texts = {r["doc_id"]: r["text"] for r in before}
            assert all((texts[r["doc_id"]] == r["text"]) == (plain[r["doc_id"]][1] == 0) and r["n_chars"] == len(r["text"]) for r in rows)
            kept = {i: sha for i, _, _, _, sha in plain_removal([(r["doc_id"], r["text"]) for r in before])}
            whole = [r for r in rows if plain[r["doc_id"]][0] - plain[r["doc_id"]][1] == len(r["text"].encode())]  # no character was cut through
            assert len(whole) > 0.9 * len(rows) and all(hashlib.sha256(r["text"].encode()).hexdigest() == kept[r["doc_id"]] for r in whole)
        elif k == 3:
            from tests.llm.test_text import plain_secrets

            assert len(rows) == len(before)
            assert all(not plain_secrets(r["text"]) for r in rows)
        else:
            plain_pieces(rows, before)
        if k < 4:
            docs, before = spark.createDataFrame(rows, out.schema), rows
