"""Tokenising, packing, secrets, archives and pages against plain versions."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, html_cut, packing, secret_scan, warc

DOCS = "doc_id long, text string, source string, n_tokens string, score string"
ODD = [
    (1, "The a   b  c\n  d \n\n e<|endoftext|> x<|endoftext|>", "s", None, None), (2, None, None, None, None), (3, "", "s", "x", "y"),
    (None, "don't 12345 ½ ✓✓ é ﷽ 　x ​ 😀", "s", None, None), (4, "\x1c \x1d x\x85 y\xa0z", "s", None, None), (4, "\x1c \x1d x\x85 y\xa0z", "s", None, None),
    (5, "aab" * 3000, "s", None, None), (6, "ΣΑΣ İstanbul <|startoftext|> Éa", None, None, None), (7, " \n\t ", "s", None, None), (8, "word " * 5000, "s", None, None),
]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ODD, DOCS)


def test_merges_take_the_leftmost_lowest_rank():
    merges = {1 << 20 | 1: 5 << 20 | 2, 2 << 20 | 2: 3 << 20 | 3, 2 << 20 | 1: 1 << 20 | 4}
    for n in range(1, 200):
        want, ids = [1] * n, None
        while want != ids:
            ids = want
            ranked = [(merges[a << 20 | b], i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if a << 20 | b in merges]
            if ranked:
                m, i = min(ranked)
                want = [*ids[:i], m & 0xFFFFF, *ids[i + 2 :]]
        assert bpe.merge_all([1] * n, merges) == want


def test_many_trees_equal_one_by_one():
    rng = random.Random(6)
    merges, ids = {}, 256
    for rank in range(400):
        merges.setdefault(rng.randrange(97, 97 + 4 + rank // 8) << 20 | rng.randrange(97, 97 + 4), rank << 20 | ids)
        merges.setdefault(rng.randrange(256, ids + 1) << 20 | rng.randrange(256, ids + 1), (rank + 400) << 20 | ids + 400)
        ids += 1
    forest = bpe.Forest(list(range(256)), merges)
    for n in range(2, 18):
        words = [bytes(rng.choices(range(97, 101), k=n)) for _ in range(200)] + [b"z" * n]
        assert forest.merge(words) == [bpe.merge_all(list(w), merges) for w in words]
    assert bpe.Forest(list(range(256)), {}).merge([b"ab"]) == [[97, 98]]


def test_new_words_are_merged_together(monkeypatch):
    one_by_one, plain = [], bpe.merge_all
    monkeypatch.setattr(bpe, "merge_all", lambda ids, merges: one_by_one.append(len(ids)) or plain(ids, merges))
    rng = random.Random(7)
    texts = [" ".join("".join(rng.choices("abcdefgé,\n", k=rng.randint(1, 14))) for _ in range(200)) for _ in range(5)] + ["", "<|endoftext|> a  b\n c", "x" * 100]
    known = bpe.ByteBPE(bpe.vocabulary("byte_bpe_50k.json"))
    if hasattr(known, "learn"):
        known.learn(texts)
    got = [known.digest(t) for t in texts]
    assert sum(2 <= n <= 17 for n in one_by_one) < 20
    for size in (4, 60):  # memories that are emptied on the way
        small = bpe.ByteBPE(bpe.vocabulary("byte_bpe_50k.json"))
        small.tokens.size = small.spaced.size = small.whole.size = size
        for t, want in zip(texts, got, strict=True):
            small.learn([t])
            assert small.digest(t) == want and small.decode(small.encode(t)) == t


def test_bpe_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    path = bpe.vocabulary("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    more = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = docs.select("doc_id", "text").unionByName(more)
    got = bpe.digests(rows, path).collect()
    assert len(got) == len(ODD) + 200
    for r in got:
        ids = tok.encode(r["text"] or "", add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False)))
    back = bpe.decode(bpe.encode(docs.select("doc_id", "text"), path), path).collect()
    assert all((r["text"] or "") == r["decoded"] for r in back)
    clash = bpe.digests(docs, path)
    assert clash.columns == ["doc_id", "text", "source", "score", "n_tokens", "ids_sha256", "decoded_sha256"] and clash.count() == len(ODD)
    assert bpe.digests(docs.limit(0), path).collect() == []


def least_sequences(demand, length):
    """A lower bound by duality: the worth of all pieces at prices at which no pattern, found here by a plain knapsack, is worth over 1."""
    sizes = sorted((s for s, n in demand.items() if n), reverse=True)
    _, prices = packing.solve(np.array(sizes), np.array([demand[s] for s in sizes], float), length)
    worth = [0.0] * (length + 1)
    for w in range(1, length + 1):
        worth[w] = max([worth[w - 1]] + [worth[w - s] + p for s, p in zip(sizes, prices, strict=True) if s <= w])
    assert (prices >= 0).all() and worth[length] <= 1 + 1e-6
    return sum(demand[s] * p for s, p in zip(sizes, prices, strict=True))


def test_plan_uses_each_piece_once():
    rng = np.random.default_rng(0)
    for _ in range(5):
        demand = {int(s): int(n) for s, n in zip(rng.choice(np.arange(1, 129), 40, replace=False), rng.integers(0, 300, 40), strict=True)}
        plan = packing.plan(demand, 128)
        used = {}
        for times, pattern in plan:
            assert times > 0 and sum(s * n for s, n in pattern.items()) <= 128
            for s, n in pattern.items():
                used[s] = used.get(s, 0) + times * n
        assert used == {s: n for s, n in demand.items() if n}
        least = least_sequences(demand, 128)
        assert least - 1e-3 <= sum(t for t, _ in plan) <= least + len(demand)
    assert packing.plan({}, 128) == []


def test_packing(spark, docs):
    from tokenizers import Tokenizer

    path = bpe.vocabulary("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    rows = docs.select("doc_id", "text").unionByName(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text"))
    got = packing.pack(rows, path, with_ids=True).toPandas()
    want = sorted((tuple(tok.encode(t or "", add_special_tokens=False).ids + [1]) for _, t in rows.collect()), key=str)
    for _, p in got.iterrows():
        ids = np.frombuffer(p["ids"], "<u4")
        assert len(ids) == p["length"] and zlib.crc32(p["ids"]) == p["ids_crc32"]
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert list(s["offset"]) == [0, *np.cumsum(s["length"])[:-1]] and s["length"].sum() <= 2048
    assert sorted(got["sequence_id"].unique()) == list(range(got["sequence_id"].nunique()))
    whole = got[got["doc_id"].notna() & (got["doc_id"] != 4)].sort_values(["doc_id", "start"])
    mine = {d: tuple(np.frombuffer(b"".join(x["ids"]), "<u4").tolist()) for d, x in whole.groupby("doc_id")}
    by = {}
    for d, t in rows.collect():
        by.setdefault(d, []).append(tuple(tok.encode(t or "", add_special_tokens=False).ids + [1]))
    assert all(mine[d] in by[d] for d in mine if len(by[d]) == 1)
    assert got["length"].sum() == sum(map(len, want))
    assert got["sequence_id"].nunique() <= got["length"].sum() / 2048 + 6
    assert packing.pack(docs.limit(0), path).collect() == []


def plain_secrets(text):
    """(kind, start, end), by a scan of its own: character by character for the runs, by name and sign for assignments."""
    found, digits, upper = [], "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    value = set(digits + upper + upper.lower() + "+/_.=-")
    low = "".join(c.lower() if c.isascii() else c for c in text)

    def run(at, allowed):
        end = at
        while end < len(text) and text[end] in allowed:
            end += 1
        return end

    at = 0
    while at < len(text):
        name = next((n for n in ("password", "passwd", "secret", "token", "api_key", "apikey") if low.startswith(n, at)), None)
        end = at + 1
        if name:
            p = at + len(name)
            p += text[p : p + 1] in ('"', "'") and p < len(text)
            p = run(p, " ")
            if text[p : p + 1] in (":", "=") and p < len(text):
                p = run(p + 1, " ")
                p += text[p : p + 1] in ('"', "'") and p < len(text)
                stop = run(p, value)
                if stop > p:
                    found += [("assign", at, stop)] * (stop - p >= 12)
                    end = stop
        at = end
    for kind, start, allowed, least in (("access", "AKIA", upper + digits, 18), ("hex", "", digits + "abcdef", 16)):
        at = 0
        while at < len(text):
            end = run(at + len(start), allowed) if text.startswith(start, at) else at
            if end > at + len(start):
                found += [(kind, at, end)] * (end - at >= least)
                at = end
            else:
                at += 1
    return sorted(found, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def spans_text(found):
    return ",".join(f"{k}:{a}:{z}" for k, a, z in found)


SECRETS = [
    (1, 1, "password = 'abcdefghijkl' x"), (2, 1, "API_KEY: abcdefghijk token=abc/+=-_.12345"), (3, 1, "AKIA" + "A" * 14 + " AKIA123 é AKIA" + "0" * 16),
    (4, 1, "deadbeef" * 2 + " deadbeef" + "0" * 40), (5, 1, None), (6, 1, ""), (7, 1, "paßword ſecret: abcdefghijklmn toKen: abcdefghijklmn"), (7, 2, "password = 'abcdefghijkl' x"),
    (None, 1, "secret:passwd=0123456789abcdef0123"), (8, 1, "-----BEGIN RSA PRIVATE KEY-----"), (8, 1, "-----BEGIN RSA PRIVATE KEY-----"),
]


MORE_SECRETS = {"-----BEGIN RSA PRIVATE KEY-----": "pem:0:31"}


def test_secrets(spark, tmp_path):
    ledger = f"file://{tmp_path}/ledger"
    versions = spark.createDataFrame(SECRETS, "path long, version long, content string")
    got = secret_scan.scan(versions, ledger).collect()
    assert len(got) == len(SECRETS)
    by = {(p, v): c or "" for p, v, c in SECRETS}
    for r in got:
        text = by[(r["path"], r["version"])]
        want = plain_secrets(text)
        assert r["spans"] == ",".join(filter(None, [spans_text(want), MORE_SECRETS.get(text)])) and r["base_sha256"] == sha(spans_text(want))
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(x[0] == k for x in want) for k in ("assign", "access", "hex")]
    known = spark.read.parquet(ledger).count()
    assert known == len({c or "" for _, _, c in SECRETS})
    secret_scan.scan(versions.unionByName(spark.createDataFrame([(9, 1, "new token=123456789012345")], versions.schema)), ledger).collect()
    assert spark.read.parquet(ledger).count() == known + 1  # only the unseen blob
    spark.read.parquet(ledger).write.mode("append").parquet(f"{ledger}-twice")
    spark.read.parquet(ledger).write.mode("append").parquet(f"{ledger}-twice")
    assert sorted(map(tuple, secret_scan.scan(versions, f"{ledger}-twice").collect()), key=str) == sorted(map(tuple, got), key=str)
    other = (*secret_scan.BASE, secret_scan.Rule("key", re.compile("KEY")))
    found = {r["path"]: r["spans"] for r in secret_scan.scan(versions.where("path = 8"), ledger, rules=other).collect()}
    assert found == {8: "key:23:26"} and secret_scan.version(other) != secret_scan.version(secret_scan.RULES)
    assert spark.read.parquet(ledger).where(F.col("rules") == secret_scan.version(other)).count() == 1
    assert secret_scan.scan(versions.limit(0), f"file://{tmp_path}/none").collect() == []
    docs = spark.createDataFrame([(1, "a token=123456789012345 b", "x"), (2, None, "y")], "doc_id long, text string, blob string")
    clean = {r["doc_id"]: r["text"] for r in secret_scan.clean(docs, f"file://{tmp_path}/clean").collect()}
    assert clean == {1: "a <assign> b", 2: None}


def test_secrets_of_documents(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in secret_scan.scan(docs, f"file://{tmp_path}/ledger", "text", ("doc_id",)).collect():
        assert r["base_sha256"] == sha(spans_text(plain_secrets(texts[r["doc_id"]])))


PAGES = [(3, "u3", "<p>a"), (1, "u1", None), (2, None, ""), (4, "u4", "<p>a"), (5, "u5\r\nx", "é" * 70000), (None, "u", "<p>a"), (6, "u6", "é" * 70000), (7, "u7", "x"), (7, "u7", "x")]


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = f"file://{tmp_path}/warc"
    warc.write(pages, path)
    full = warc.read(spark, path)
    got = {(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.verified(full).select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to").collect()}
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    first = {}
    for i, _, t in sorted(PAGES, key=lambda r: (r[0] is None, r[0])):
        first.setdefault(t or "", i)
    want = set()
    for i, _, t in PAGES:
        lead = i is None or first[t or ""] == i
        want.add((None if i is None else str(i), len((t or "").encode()), digest(t), "response" if lead else "revisit", None if lead else str(first[t or ""])))
    assert got == want and full.count() == len(PAGES)
    only = full.where("record_type = 'revisit'")
    assert "PushedFilters" in only._jdf.queryExecution().toString() or only.count() == 3
    assert {r["record_id"] for r in only.collect()} == {"2", "4", "6"}
    heads = warc.read(spark, path, payload=False).collect()
    assert len(heads) == len(PAGES) and all(r["payload"] is None for r in heads)
    bodies = {r["record_id"]: bytes(r["payload"]).decode() for r in full.where("record_type = 'response'").collect()}
    assert bodies["5"] == "é" * 70000 and bodies["1"] == ""
    import gzip

    names = [p for p in (tmp_path / "warc").iterdir() if p.suffix == ".gz"]
    assert all(gzip.decompress(p.read_bytes()).startswith(b"WARC/1.1\r\n") for p in names)
    large = f"file://{tmp_path}/large"
    warc.write(pages, large, least=2)
    assert warc.read(spark, large).where("record_type = 'revisit'").count() == 2
    empty = f"file://{tmp_path}/empty"
    warc.write(pages.limit(0), empty)
    assert warc.read(spark, empty).count() == 0


def test_foreign_archives(spark, tmp_path):
    import gzip
    import io

    one = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:7>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    long = one.replace(b"Length: 3", b"Length: 3000000").replace(b"abc", b"x" * 3_000_000)
    head = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nX: " + b"y" * 9000 + b"\r\nContent-Length: 0\r\n\r\n\r\n\r\n"

    class Pipe(io.RawIOBase):  # without seek
        def __init__(self, raw):
            self.raw = io.BytesIO(raw)

        def read(self, n=-1):
            return self.raw.read(n)

    packed = lambda *members: b"".join(map(gzip.compress, members))
    for raw in (one + long + head + one, packed(one, long, head, one), packed(one + long, head) + one):
        for stream in (io.BytesIO, Pipe):
            if raw[:2] == b"\x1f\x8b" and raw.count(b"\x1f\x8b\x08") < 3:
                continue  # several records in a member are read as one
            got = list(warc.records(stream(raw)))
            assert [(h["warc-type"], len(b)) for h, b in got] == [("response", 3), ("response", 3_000_000), ("warcinfo", 0), ("response", 3)]
            assert [b for _, b in warc.records(stream(raw), payload=False)] == [None] * 4
            assert [len(b) for _, b in warc.records(stream(raw), lambda h: h["warc-type"] == "warcinfo")] == [0]
    folder = tmp_path / "others"
    (folder / "deep").mkdir(parents=True)
    (folder / "a.warc").write_bytes(one + long)
    (folder / "deep/b.warc.gz").write_bytes(packed(one, head))
    (folder / "c.txt").write_text("no archive")
    rows = warc.read(spark, f"file://{folder}")
    assert rows.count() == 4 and rows.where("record_id = '7'").count() == 3


def test_pages_with_clashing_columns(spark, tmp_path):
    rows = [(1, "u", "x", 5, "s", 9, "b", 3), (2, "u", "x", 5, "s", 9, "b", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, id int, sha string, first int, body string, share int")
    warc.write(pages, f"file://{tmp_path}/w")
    assert {(r["record_id"], r["record_type"], r["refers_to"]) for r in warc.read(spark, f"file://{tmp_path}/w").collect()} == {("1", "response", None), ("2", "revisit", "1")}


def least_cut(n, source, sink, edges):
    best = None
    for side in range(1 << n):
        on = [side >> i & 1 for i in range(n)]
        cost = sum(sink[i] if on[i] else source[i] for i in range(n)) + sum(c for i, j, c in edges if on[i] != on[j])
        best = cost if best is None else min(best, cost)
    return best


def test_max_flow_is_the_least_cut():
    rng = np.random.default_rng(1)
    for _ in range(150):
        n = int(rng.integers(1, 9))
        source, sink = rng.integers(0, 20, n).tolist(), rng.integers(0, 20, n).tolist()
        edges = [(int(i), int(j), int(rng.integers(0, 12))) for i in range(n) for j in range(i) if rng.random() < 0.5]
        on = html_cut.max_flow(n, source, sink, edges)
        cost = sum(sink[i] if on[i] else source[i] for i in range(n)) + sum(c for i, j, c in edges if on[i] != on[j])
        assert cost == least_cut(n, source, sink, edges)


PAGE = """<html><head><title>T</title><style>p{}</style></head><body><header class="site"><a href=/>Home</a> My Site</header><nav><ul><li><a href="a>b">One</a></li></ul></nav>
<div id="sidebar"><p>Related stories you will love to read today and tomorrow.</p></div><div class="content"><h1>Title here</h1><p>First paragraph with
some text, that is <b>long</b> enough.<p>Ok.</p><script>var t="</p>";</script><div class="ad-slot">Buy now cheap!</div><p>Second one &amp; more&nbsp;text &#233;.</p></div>
<div class="cookie-notice"><p>We use cookies to improve the site and your experience.</p></div><form><label>Mail</label><input></form>
<section class="comments"><p>Great article, I like it very much indeed!</p></section><!-- x --><footer>(c)</footer></body>"""


def test_html(spark):
    assert html_cut.main_text(PAGE) == "Title here First paragraph with some text, that is long enough. Ok. Second one & more text é."
    for page in (None, "", "<", "<p", "<div><div></p></span></div></div></div>", "<script>", "<!-- never closed <p>x", "<p a='x>y"):
        assert isinstance(html_cut.main_text(page), str)
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").unionByName(spark.createDataFrame([(1000, None, None), (1000, None, None)], "page_id long, url string, html string"))
    got = html_cut.extract(rows.withColumn("text", F.lit("clash")))
    assert got.columns == ["page_id", "url", "text"]
    by = {r["page_id"]: r["text"] for r in got.collect()}
    import html

    for r in rows.collect():
        a = re.search("<article>(.*?)</article>", r["html"] or "", re.S)
        assert by[r["page_id"]] == (" ".join(html.unescape(re.sub("<[^>]*>", " ", a[1])).split()) if a else "")
    assert html_cut.extract(rows.limit(0)).collect() == []
    deep = "<article>" + "<div>" * 3000 + "<p>" + "long text here. " * 200000 + "</article>"
    assert len(html_cut.main_text(deep)) == 16 * 200000 - 1


ARTICLE = "<article><p>One sentence of the article, long enough to be read.</p><p>Another sentence of it, which is also long enough.</p></article>"
ARTICLE_TEXT = "One sentence of the article, long enough to be read. Another sentence of it, which is also long enough."


def test_html_raw_elements():
    nav = lambda x: html_cut.main_text(f"<body><nav>{x}</nav>{ARTICLE}</body>")
    for x in ('<svg-icon name="m"></svg-icon>', "<title-bar></title-bar>", "<object-x>", "<svg class=i/>", "<math/>", "<svg><path d=x>", "<svg><style/></svg>", "<template>", "<object data=x>", "<canvas>"):
        assert nav(x) == ARTICLE_TEXT, x
        assert html_cut.main_text(f"<body><nav>{x}</nav>{ARTICLE}<svg></svg><object></object><canvas></canvas><template></template></body>") == ARTICLE_TEXT, x
    inside = lambda x: html_cut.main_text(f"<article><p>It is known that {x} holds for all of these numbers.</p></article>")
    assert inside("<math><mi>a</mi><mo>=</mo><mi>b</mi></math>") == "It is known that a=b holds for all of these numbers."
    for x in ("<svg><g><svg><text>in</text></svg><text>out</text></g></svg>", "<SCRIPT>if (a</b) x='<p>'</script >", "<style>p{}</style>", "<template><p>not yet</p></template>", "<canvas><p>old</p></canvas>", "<iframe src=x><p>old</iframe>"):
        assert inside(x) == "It is known that holds for all of these numbers.", x
    assert html_cut.main_text(f"{ARTICLE}<script>never closed <p>x</p>") == ARTICLE_TEXT
    assert html_cut.main_text("<article>" + "<svg><template>" * 100000 + "<p>One sentence, long enough to be read.</p></article>") == "One sentence, long enough to be read."


def test_html_wrapped_articles():
    side = '<div class="sidebar"><article><p>Teaser of some other story, long enough to be read.</p></article></div>'
    for wrap in ('<div class="page has-sidebar">{}</div>', '<div class="wrapper no-header">{}</div>', '<div class="sidebar-layout">{}</div>', '<form id=form1><header>Site</header>{}</form>', "<form id=aspnetForm><div>{}</div></form>", '<div class="top"><div id="footer-pushed">{}</div></div>'):
        for text in (ARTICLE, ARTICLE.replace("article>", "main>"), f"<main>{ARTICLE}</main>"):
            assert html_cut.main_text("<body>" + wrap.format(text + side) + "</body>") == ARTICLE_TEXT, wrap
    assert html_cut.main_text(f'<form id=form1><nav>Home</nav><div class="content">{ARTICLE[9:-10]}</div></form>') == ARTICLE_TEXT
    assert html_cut.main_text(f'<div class="with-sidebar"><div class="content">{ARTICLE[9:-10]}</div></div>') == ARTICLE_TEXT
    two = f'<div class="has-sidebar">{ARTICLE}</div><div class="has-sidebar">{ARTICLE}</div>'
    assert html_cut.main_text(two) == f"{ARTICLE_TEXT} {ARTICLE_TEXT}"
    for name in ("read-more", "warning", "notice"):
        assert html_cut.main_text(f'<article><div class="{name}">{ARTICLE[9:-10]}</div></article>') == ARTICLE_TEXT, name
    for x in (side, side.replace('div class="sidebar"', "aside").replace("/div", "/aside"), side.replace("sidebar", "related-posts"), '<section class="comments"><article><p>Great, I like this very much indeed, thank you!</p></article></section>', "<form><label>Name</label><p>Write to us, we will answer as soon as we can.</p></form>"):
        assert html_cut.main_text(f"<body>{ARTICLE}{x}</body>") == ARTICLE_TEXT, x
    assert html_cut.main_text(f'<body><div class="cookie-notice"><p>We use cookies to improve the site and your experience.</p></div>{ARTICLE}</body>') == ARTICLE_TEXT
    deep = "<div>" * 20000 + "<form><main>" * 2000 + "<p>One sentence, long enough to be read.</p>"
    assert html_cut.main_text(deep) == "One sentence, long enough to be read."


def test_html_short_pages_keep_their_text():
    for page, text in {"<p>Hi</p>": "Hi", "plain text page": "plain text page", "<nav><a href=1>Home</a></nav><p>Hi there</p>": "Hi there", "a < b and c > d": "a < b and c > d", "<nav>menu</nav>": "", "<footer>(c)</footer><script>x</script>": ""}.items():
        assert html_cut.main_text(page) == text
    tips = '<article><p>One two three, and more of it.</p><div class="search-tips"><p>How to search well.</p></div><div class="related-posts"><a href=x>More</a></div></article>'
    assert html_cut.main_text(tips) == "One two three, and more of it. How to search well."


def test_html_broken_pages_take_linear_time():
    import time

    for piece in ("<a ", '<a x="', "<div>text", "</script ", "<script></script ", "<a '>", "<!", "<svg>", "<p>a</p>", "<div></table>"):
        began = time.process_time()
        html_cut.main_text(piece * (400_000 // len(piece)))
        assert time.process_time() - began < 10, piece
    deep = "<div>" * 60_000 + "</table>" * 60_000 + "<p>One sentence, long enough to be read.</p>"
    assert html_cut.main_text(deep) == "One sentence, long enough to be read."
