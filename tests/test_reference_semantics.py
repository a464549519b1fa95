"""Operators against small cases worked out by hand or by plain Python."""

import json
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import jsontext, scoring, text
from tessera.operators import allocation, curation, evaluation, events, execution, graph
from tessera.sources import files, sinks
from tessera.streaming import logs


def values(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema)
    return [tuple(r) for r in df.select(*(c.alias(k) for k, c in columns.items())).collect()]


def test_norm_key(spark):
    cases = ["Äpfel  & Birnen!", "a_b--c", "  x ", "", "日本 語", "q" * 300, None]
    want = [(None if s is None else re.sub(r"\W+", " ", s.lower()).strip()[:160],) for s in cases]
    assert values(spark, [(c,) for c in cases], "s string", k=text.norm_key(F.col("s"))) == want


def test_check_answer(spark):
    rows = [('{"a": 1}', True), ('```json\n{"a": 1}\n```', True), ('<think>hmm</think>\n{"a": 1}', True), ('Sure! Here it is: {"a": 1}', True), ('{"a": 1', True), ('{"a": 1}', False), ("", True), (None, True)]
    got = values(spark, rows, "t string, f boolean", r=curation.check_answer(F.col("t"), F.col("f"), F.lit(True), F.lit(False)))
    assert [(r[0]["answer"], r[0]["reason"]) for r in got] == [('{"a": 1}', "")] * 4 + [(None, "invalid_json"), (None, "truncated"), (None, "empty"), (None, "empty")]


def test_code_blocks(spark):
    rows = [("One way:\n```c\nint a;\n```\nor\n```c\nint a;\nint b;\n```",), ("x = 1",), ("```py\nab\n```\n```py\ncd\n```",), ("```\n  keep\n```",)]
    got = values(spark, rows, "t string", c=text.code_of(F.col("t")), p=text.program_of(F.col("t")))
    assert [g[0] for g in got] == ["int a;\nint b;", "x = 1", "ab", "keep"]
    assert got[3][1] == "  keep"


def test_parse_array(spark):
    rows = [('```json\n["this is the first", "and the second"]\n```',), ('[{"input": "out of an object"}, "a plain string", "tiny", 5]',), ("nothing listed",), ("[broken",), (None,)]
    got = values(spark, rows, "t string", a=jsontext.parse_array(F.col("t")))
    assert [g[0] for g in got] == [["this is the first", "and the second"], ["out of an object", "a plain string"], [], [], []]
    code = [('[{"input": "write a function", "tests": "assert f()"}, {"input": "x", "tests": "y"}, {"input": "no tests given here"}]',)]
    assert [tuple(r) for r in values(spark, code, "t string", a=jsontext.parse_inputs(F.col("t")))[0][0]] == [("write a function", "assert f()")]


def plain_f1(a, b):
    x, y = (Counter(re.findall(r"\w+", s.lower())) for s in (a, b))
    common = sum((x & y).values())
    if not x or not y:
        return float(x == y)
    if not common:
        return 0.0
    p, r = common / sum(x.values()), common / sum(y.values())
    return 2 * p * r / (p + r)


def test_token_f1(spark):
    rng = random.Random(0)
    rows = [("", ""), ("a", ""), ("rain in the night", "rain in the night again"), ("a a b", "a b b")] + [(" ".join(rng.choices("abcdé", k=rng.randint(0, 9))), " ".join(rng.choices("abcdé", k=rng.randint(0, 9)))) for _ in range(60)]
    got = values(spark, rows, "a string, b string", f=scoring.token_f1(F.col("a"), F.col("b")))
    assert [g[0] for g in got] == pytest.approx([plain_f1(*r) for r in rows])


def test_agreement(spark):
    ref = json.dumps({"kind": "parcel", "size": "small", "note": "left with a neighbour at noon", "state": "delivered"})
    one = json.dumps(json.loads(ref) | {"size": "large"})
    rows = [(ref, ref), (f"```json\n{one}\n```", ref), ("not an object", ref), ("rain in the night", "rain in the night again"), ('{"a": true}', '{"a": true, "b": null}'), ('{"a": 1}', '{"a": 1.0}')]
    got = [g[0] for g in values(spark, rows, "a string, r string", s=scoring.agreement(F.col("a"), F.col("r")))]
    assert got[:3] == [1.0, 0.75, 0.0] and got[3] == pytest.approx(plain_f1(*rows[3])) and got[4] == 1.0


def test_pass_at_k(spark):
    cases = [(1, 1, 1), (1, 0, 1), (10, 3, 1), (10, 3, 5), (4, 2, 3), (7, 0, 7), (7, 7, 7), (9, 4, 2)]
    for n, c, k in cases:
        want = 1.0 if n - c < k else 1 - math.comb(n - c, k) / math.comb(n, k)
        assert values(spark, [(n, c)], "n int, c int", p=scoring.pass_at_k(F.col("n"), F.col("c"), k))[0][0] == pytest.approx(want)
    with pytest.raises(Exception, match="at least 5"):
        values(spark, [(1, 1)], "n int, c int", p=scoring.pass_at_k(F.col("n"), F.col("c"), 5))


def test_summary_and_share(spark):
    rows = [("a", "c", "1", True, ""), ("a", "c", "1", False, "test_failed"), ("a", "cpp", "2", False, "timeout"), ("a", "cpp", "2", False, "timeout"), ("b", "c", "1", False, "unsupported_language"), ("b", "c", "1", False, "missing_toolchain")]
    results = spark.createDataFrame(rows, "suite string, language string, id string, passed boolean, reason string")
    got = {r["suite"]: r for r in evaluation.summarize(results, [1, 2]).collect()}
    assert (got["a"]["pass_at_1"], got["a"]["pass_at_2"], got["a"]["skipped"], got["a"]["language"]) == (0.25, 0.5, None, "mixed")
    assert got["a"]["status"] == {"pass": 1, "test_failed": 1, "timeout": 2}
    assert (got["b"]["skipped"], got["b"]["pass_at_1"], got["b"]["language"]) == ("missing_toolchain, unsupported_language", None, "c")
    assert [tuple(r) for r in evaluation.broken_suites(results).collect()] == [("b", 2, 2)]
    assert evaluation.pass_rate(results).first()[0] == 0.167 and evaluation.pass_rate(results.limit(0)).first()[0] == 0.0
    mine = spark.createDataFrame([("a", 0.4), ("c", 0.9), ("d", 0.5), ("e", 0.2)], "suite string, pass_at_1 double")
    ref = spark.createDataFrame([("a", 0.5), ("c", 0.9), ("e", 0.0)], "suite string, pass_at_1 double")
    assert {tuple(r) for r in evaluation.share_of_ref(mine, ref).collect()} == {("a", 0.8), ("c", 1.0)}
    assert tuple(evaluation.ref_shares(mine, ref).first()) == (0.9, 0.8)


def test_winner(spark):
    schema = "name string, ord int, score double, meets_target boolean"
    pick = lambda rows, prefer=None: evaluation.winner(spark.createDataFrame(rows, schema), "score", "ord", prefer).first()["name"]
    assert pick([("a", 1, 0.9, False), ("b", 2, 0.5, True), ("c", 3, 0.5, True)]) == "b"
    assert pick([("a", 1, 0.9, False), ("b", 2, None, False)]) == "a"
    near = [("a", 1, 0.90, True), ("b", 2, 0.89, True), ("c", 3, 0.7, True)]
    assert pick(near, F.col("name") == "b") == "b" and pick(near, F.col("name") == "c") == "a"
    c = spark.createDataFrame([(0.5, 0.4, None), (0.5, None, 0.1)], "pass_at_1 double, judge_score double, agreement double")
    assert evaluation.score_method(c).first()[0] == "pass_at_1"


def test_normalised_and_keep(spark):
    df = spark.createDataFrame([(0.0,), (float("nan"),), (2.0,), (2.0,)], "x double")
    assert [r["y"] for r in evaluation.normalised(df, "x", "y").collect()] == [1.0] * 4
    assert values(spark, [(5,), (128,)], "e int", k=evaluation.keep_count(F.col("e"), 0.5, 1)) == [(3,), (64,)]


def test_moving_loss_does_not_depend_on_chunks(spark):
    rng = random.Random(1)
    rows = [("a", i * 3, rng.random()) for i in range(500)]
    want = rows[0][2]
    for _, _, x in rows[1:]:
        want = want * 0.9 + x * 0.1
    df = spark.createDataFrame(rows, "k string, i long, x double")
    for chunk in (7, 100, 10**6):
        assert evaluation.moving_loss(df, "k", "i", "x", chunk=chunk).first()["ema"] == pytest.approx(want)


CONFIG = {"num_hidden_layers": 24, "hidden_size": 1024, "moe_intermediate_size": 512, "num_experts": 32, "num_experts_per_tok": 4, "vocab_size": 50_000, "num_attention_heads": 16, "num_key_value_heads": 4, "head_dim": 64}


def test_allocation(spark):
    model = allocation.tensors(spark, CONFIG)
    rows = model.collect()
    attention, experts, words = 2 * 1024 * (16 + 4) * 64, 3 * 32 * 1024 * 512, 50_000 * 1024
    assert sum(r["weights"] for r in rows) == 24 * (attention + experts) + 2 * words
    gains = {(i, kind): (1 + math.sin(i / 5) ** 2) * each for i in range(24) for kind, each in (("gate_up", 2), ("down", 1.5))}
    for budget in (0.6, 0.7, 0.8):
        got = allocation.allocate(rows, gains, budget)
        level = {(i, kind): allocation.LADDER.index(t) for i, kind, t in got}
        assert all(level[i, "gate_up"] <= level[i, "down"] <= level[i, "gate_up"] + 2 for i in range(24))
        chosen = spark.createDataFrame(got, "layer int, kind string, type string")
        r = allocation.report(allocation.typed(model, chosen)).first()
        size = sum(x["weights"] * allocation.BITS[{(i, k): t for i, k, t in got}.get((x["layer"], x["kind"])) or allocation.STATIC[x["kind"]]] / 8e9 for x in rows)
        assert budget - 0.02 < size <= budget and r["size_gb"] == pytest.approx(size) and r["tok_s"] == pytest.approx(78 / r["gb_per_token"])
    with pytest.raises(ValueError):
        allocation.allocate(rows, gains, 0.1)
    arguments = allocation.quantize_arguments(chosen).first()["arguments"]
    assert arguments[:4] == ["--output-tensor-type", "q6_k", "--token-embedding-type", "q4_k"] and len(arguments) == 6 + 2 * 48
    assert arguments[6:10:2] == ["--tensor-type"] * 2 and arguments[7].startswith(r"blk\.0\.ffn_(gate|up)_exps=") and arguments[9].startswith(r"blk\.0\.ffn_down_exps=")
    bits = allocation.bit_widths(chosen).collect()
    assert len(bits) == 72 and [(r["layer"], r["tensor"]) for r in bits] == sorted((r["layer"], r["tensor"]) for r in bits)


def plain_allocation(rows, gains, budget):
    """As allocate() is defined: again and again the best upgrade of all that fit."""
    size = lambda level: sum(r["weights"] * allocation.BITS[allocation.LADDER[level[r["layer"], r["kind"]]] if (r["layer"], r["kind"]) in level else allocation.STATIC[r["kind"]]] / 8e9 for r in rows)
    level = {(r["layer"], r["kind"]): 0 for r in rows if r["kind"] in allocation.EXPERTS}
    weights = {(r["layer"], r["kind"]): r["weights"] for r in rows}
    while True:
        ways = []
        for (i, kind), n in level.items():
            top = level[i, "gate_up"] + 2 if kind == "down" else level[i, "down"]
            if n < min(4, top):
                extra = weights[i, kind] * (allocation.BITS[allocation.LADDER[n + 1]] - allocation.BITS[allocation.LADDER[n]])
                ways.append((gains[i, kind] * (allocation.ERROR[allocation.LADDER[n]] - allocation.ERROR[allocation.LADDER[n + 1]]) / extra, i, kind == "gate_up", kind))
        for _, i, _, kind in sorted(ways, reverse=True):
            if size(level | {(i, kind): level[i, kind] + 1}) <= budget:
                level[i, kind] += 1
                break
        else:
            return [(i, kind, allocation.LADDER[n]) for (i, kind), n in sorted(level.items())]


def test_allocation_takes_the_best_upgrade_that_fits(spark):
    rows = allocation.tensors(spark, CONFIG | {"num_hidden_layers": 6}).collect()
    rng = random.Random(5)
    for budget in (0.2, 0.22, 0.25):
        gains = {(i, kind): rng.random() for i in range(6) for kind in ("gate_up", "down")}
        assert allocation.allocate(rows, gains, budget) == plain_allocation(rows, gains, budget)


def test_split_and_oversample(spark):
    df = spark.range(1000).withColumnRenamed("id", "doc_id")
    got = {}
    for r in curation.hash_split(df, "doc_id", "7", 100, 500).collect():
        got.setdefault(r["part"], set()).add(r["doc_id"])
    import hashlib

    order = sorted(range(1000), key=lambda i: (hashlib.md5(f"7{i}".encode()).hexdigest(), i))
    assert got == {"heldout": set(order[:100]), "train": set(order[100:600]), "unused": set(order[600:])}
    again = curation.hash_split(df.repartition(7), "doc_id", "7", 100, 500).where("part = 'heldout'")
    assert {r["doc_id"] for r in again.collect()} == got["heldout"]
    assert curation.oversample(df.limit(5), df.limit(2)).count() == 9
    assert curation.split_sizes(100, 30) == 20 and curation.split_sizes(100, 10) == 10 and curation.split_sizes(100, 30, 15) == 15


def test_dedupe_keeps_the_first_and_ignores_long_rows(spark):
    rows = [(1, "x" * 7000), (3, "Hello, world"), (2, "hello  WORLD!"), (4, "other")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in curation.dedupe_inputs(docs).collect()} == {2, 4}
    once = curation.dedupe_inputs(docs)
    assert curation.dedupe_inputs(once).count() == once.count()
    assert [r["doc_id"] for r in curation.unseen(docs, text.norm_key(F.col("text")), docs.where("doc_id = 3"), text.norm_key(F.col("text"))).orderBy("doc_id").collect()] == [1, 4]


def test_loose_rows(spark):
    schema = "messages array<struct<role:string,content:string>>, prompt string, response string, question string, answer string, system string"
    rows = [([("user", "q"), ("assistant", "a")], None, None, None, None, None), ([("user", "q")], None, None, None, None, None), ([("assistant", ""), ("user", "q")], "p", "r", None, None, None), (None, "p", "r", None, None, "s"), (None, None, None, "q", "a", None), (None, "p", None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    got = [None if r[0] is None else [tuple(m) for m in r[0]] for r in df.select(curation.to_messages(df.columns)).collect()]
    assert got == [[("user", "q"), ("assistant", "a")], None, None, [("system", "s"), ("user", "p"), ("assistant", "r")], [("user", "q"), ("assistant", "a")], None]


TICKET = "id string, role string, image string, priority int, depends_on array<string>, owns array<string>, budget struct<attempts:int,max_tokens:int>"


def ticket(i, deps=(), owns=("f",), role="implement", priority=3):
    return (i, role, "node", priority, list(deps), list(owns), (2, 100))


def test_plans(spark):
    good = [ticket("a", owns=["a.js"]), ticket("b", ["a"], ["b.js"]), ticket("c", ["b"], ["a.js"]), ticket("r", [], [], "review")]
    assert graph.plan_violations(spark.createDataFrame(good, TICKET)).collect() == []
    bad = [ticket("a", ["zz"], ["../etc/passwd"]), ticket("b", ["d"], ["src/*.js"]), ticket("d", ["b"], ["x"]), ticket("e", [], ["same"]), ticket("f", [], ["same"]), ticket("g", [], []), ticket("h", priority=9), ticket("h")]
    got = {tuple(r) for r in graph.plan_violations(spark.createDataFrame(bad, TICKET)).collect()}
    assert got >= {("a", "unknown_dependency"), ("a", "owns_path"), ("b", "owns_path"), ("b", "cycle"), ("d", "cycle"), ("e", "shared_file"), ("g", "owns_empty"), ("h", "priority"), ("h", "duplicate_id")}
    edge = graph.edges(spark.createDataFrame(bad, TICKET))
    assert [r["path"] for r in graph.cycle_paths(edge).collect()] == [["b", "d", "b"]]


def test_topological_order():
    rows = [("b", 1, ["z"]), ("a", 2, []), ("z", 3, []), ("c", 1, ["a"])]
    left, done, want = sorted(rows, key=lambda r: (r[1], r[0])), set(), []
    while left:
        pick = next(r for r in left if set(r[2]) <= done)
        left.remove(pick)
        done.add(pick[0])
        want.append(pick[0])
    assert graph.topological_order(rows) == want
    with pytest.raises(ValueError):
        graph.topological_order([("a", 1, ["b"]), ("b", 1, ["a"])])


def test_ready_and_skipped(spark):
    t = spark.createDataFrame([("a", 1, [], ["1"]), ("b", 2, ["a"], ["2"]), ("c", 1, [], ["3"]), ("d", 1, [], ["3"]), ("e", 2, [], ["9"]), ("f", 1, ["c"], ["4"])], "id string, priority int, depends_on array<string>, owns array<string>")
    s = spark.createDataFrame([("a", "done"), ("b", "waiting"), ("c", "waiting"), ("d", "waiting"), ("e", "running"), ("f", "waiting")], "id string, state string")
    assert [r["id"] for r in graph.ready(t, s, 3).collect()] == ["c", "b"]
    assert [r["id"] for r in graph.ready(t, s, 2).collect()] == ["c"]
    x = spark.createDataFrame([("y", "x"), ("z", "y"), ("w", "v")], "id string, dep string")
    assert {r["id"] for r in graph.skipped(graph.ancestors(x), spark.createDataFrame([("x",)], "id string")).collect()} == {"y", "z"}


def test_globs(spark):
    p = spark.createDataFrame([("t", "src/**/*.js"), ("t", "*.md"), ("u", "src/a?.py")], "id string, pattern string")
    f = spark.createDataFrame([("src/x/a.js",), ("src/x/y/b.js",), ("readme.md",), ("docs/readme.md",), ("src/ab.py",), ("src/abc.py",)], "path string")
    assert {tuple(r) for r in graph.glob_matches(p, f).collect()} == {("t", "src/x/a.js"), ("t", "src/x/y/b.js"), ("t", "readme.md"), ("u", "src/ab.py")}


LOG = [
    ("j", 1, "pipeline", "running", None), ("j", 2, "data", "running", None), ("j", 3, "data", "error", "boom"), ("j", 4, "pipeline", "running", None), ("j", 5, "data", "running", None), ("j", 6, "data", "done", None), ("j", 7, "pipeline", "done", None),
    ("k", 1, "pipeline", "running", None), ("k", 2, "data", "error", None), ("k", 3, "pipeline", "error", "failed late"), ("l", 1, "data", "running", None),
]


def test_job_states(spark):
    df = spark.createDataFrame(LOG, "job string, seq long, stage string, status string, msg string")
    assert {tuple(r) for r in events.job_states(df).collect()} == {("j", "done", None), ("k", "error", "failed late"), ("l", "running", None)}
    got = {(r["job"], r["stage"]): (r["started"], r["ended"]) for r in events.stage_times(df, ["job", "stage"], "seq", "seq").collect()}
    assert got[("j", "data")] == (5, 6) and got[("l", "data")] == (1, None)


def test_parse_lines_in_batch_and_stream(spark, tmp_path):
    lines = ['{"stage": "data", "status": "running", "pct": 12.34, "ts": 1.5}', '{"stage": "data", "status": "odd"}', "plain text", "[1]", '{"stage": "data", "status": "done", "msg": "ok", "ts": 2.5}']
    got = values(spark, [(x,) for x in lines], "l string", e=events.parse_line(F.col("l")))
    assert [g[0] is not None for g in got] == [True, False, False, False, True]
    folder = tmp_path / "log"
    folder.mkdir()
    (folder / "1.jsonl").write_text("\n".join(lines) + "\n")
    stream, other = logs.protocol(logs.lines(spark, f"file://{folder}"))
    q = logs.board(stream).writeStream.outputMode("complete").format("memory").queryName("board").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.sql("select stage, status, msg, events from board").collect()] == [("data", "done", "ok", 2)]
    seen = []
    logs.fan_out(other, [lambda df, i: seen.extend(r["line"] for r in df.collect())], f"file://{tmp_path}/ck").awaitTermination()
    assert sorted(seen) == sorted(lines[1:4])


def test_windows_in_stream(spark):
    sf = "/root/testdata/sf0.001/events.parquet"
    schema = spark.read.parquet(sf).schema
    stream = logs.windowed(spark.readStream.schema(schema).parquet("/root/testdata/sf0.001/events.parq*"), "ts", ["event_type"])
    q = stream.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = spark.read.parquet(sf).groupBy(F.window(F.col("ts").cast("timestamp"), "1 day"), "event_type").count()
    assert spark.table("windows").count() == batch.count() and spark.table("windows").agg(F.sum("n")).first()[0] == 1000


def test_peak_and_names(spark):
    spans = spark.createDataFrame([(0, 10), (5, 15), (10, 20), (12, 13)], "a long, b long")
    for chunk in (3, 10**9):
        assert events.peak_concurrency(spans, "a", "b", chunk=chunk).first()["peak"] == 3
    names = spark.createDataFrame([(1, "a.c"), (2, "a.c"), (3, "b"), (4, "a.c"), (5, "b")], "i int, name string").withColumn("k", F.lit(1))
    assert [r["unique_name"] for r in events.number_names(names, ["k"], "name", "i").orderBy("i").collect()] == ["a.c", "a_2.c", "b", "a_3.c", "b_2"]


def test_segments_drop_the_last(spark):
    lines = ["intro", "# one", "a b c", "# two", "d", "# three", "e f g"]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(lines)], "f int, n int, line string")
    got = events.segments(df, ["f"], "n", F.col("line").startswith("#"), words=4)
    assert [r["text"] for r in got.collect()] == ["# one\na b c"]


def test_batches(spark):
    rng = random.Random(2)
    rows = [(i, rng.randint(1, 60)) for i in range(300)]
    got = execution.length_batches(spark.createDataFrame(rows, "id long, n long"), "id", "n", 200, 8, shards=1).collect()
    want, cur, longest = [], [], 0
    for i, n in sorted(rows, key=lambda r: (r[1], r[0])):
        if cur and (max(longest, n) * (len(cur) + 1) > 200 or len(cur) >= 8):
            want.append(cur)
            cur, longest = [], 0
        cur.append(i)
        longest = max(longest, n)
    want.append(cur)
    mine = {}
    for r in got:
        mine.setdefault(r["batch"], []).append(r["id"])
    assert [mine[k] for k in sorted(mine)] == want


def test_sandbox(spark):
    code = ["assert 1 + 1 == 2", "assert False", "def f(:", "while True: pass", "x"]
    rows = [(i, "python" if i < 4 else "cobol", c) for i, c in enumerate(code)]
    got = {r["id"]: (r["passed"], r["reason"]) for r in execution.run_tests(spark.createDataFrame(rows, "id int, lang string, code string"), "id", "lang", "code", timeout=3).collect()}
    assert got == {0: (True, ""), 1: (False, "test_failed"), 2: (False, "compile_error"), 3: (False, "timeout"), 4: (False, "unsupported_language")}


def test_sources_and_manifest(spark, tmp_path):
    problems = [{"id": "9", "language": "py", "prompt": "p"}, {"id": "2", "language": "C", "prompt": "p", "date": "2026-05-01"}, {"id": "3", "language": "c", "prompt": "p", "date": "2025-12-01"}]
    (tmp_path / "s.jsonl").write_text("\n".join(map(json.dumps, problems)) + "\n\n")
    got = files.suite(spark, f"file://{tmp_path}/s.jsonl", "s", since="2026-01-01")
    assert [(r["id"], r["language"], r["suite"]) for r in got.collect()] == [("9", "python", "s"), ("2", "c", "s")]
    with pytest.raises(Exception, match="unsupported language"):
        values(spark, [("cobol",)], "l string", x=text.language(F.col("l")))
    (tmp_path / "t.txt").write_text("one\n\ntwo\nlines\n\n\n three \n\n")
    assert sorted(r["text"] for r in files.paragraphs(spark, f"file://{tmp_path}/t.txt").collect()) == ["one", "three", "two\nlines"]
    m = sinks.Manifest(spark, f"file://{tmp_path}/job", ["data", "eval"])
    calls = []
    for _ in range(2):
        assert m.run("data", lambda: calls.append(1) or spark.range(3)).count() == 3
    assert calls == [1] and m.pending() == ["eval"]
    m.mark("eval")
    m.clear_from("data")
    assert m.pending() == ["data", "eval"]


def test_task_rules(spark):
    seeds = [("i", "o", "t")] * 3
    base = dict(version=1, task_name="n", description="d", seed_examples=seeds, target=(7.0, 40.0, 16), task_type="code", language="python")
    bad = [dict(language=None), dict(language="cobol"), dict(seed_examples=[*seeds, ("i", "o", " ")]), dict(task_type="poem", language=None), dict(task_type="text"), dict(seed_examples=seeds[1:]), dict(target=(65.0, 1.0, 1), description=" "), {}]
    rows = [(k, *(base | b).values()) for k, b in enumerate(bad)]
    df = spark.createDataFrame(rows, "k int, version int, task_name string, description string, seed_examples array<struct<input:string,output:string,tests:string>>, target struct<max_size_gb:double,min_tok_s:double,laptop_ram_gb:int>, task_type string, language string")
    assert {tuple(r) for r in graph.violations(df, "k", graph.task_rules()).collect()} == {(0, "language_of_code"), (1, "language_of_code"), (2, "tests"), (3, "task_type"), (4, "language_of_text"), (5, "seed_examples"), (6, "max_size"), (6, "description")}


def test_overlays_and_routes(spark):
    m = spark.createDataFrame([({"a": 1, "b": 2}, {"b": 3}, {"c": 4})], "x map<string,int>, y map<string,int>, z map<string,int>")
    assert m.select(evaluation.overlay(F.col("x"), F.col("y"), F.col("z"))).first()[0] == {"a": 1, "b": 3, "c": 4}
    ask, routes = spark.createDataFrame([("m@2",), ("m",), ("q",)], "model string"), spark.createDataFrame([("m", "here"), ("m@2", "there")], "name string, target string")
    assert {tuple(r) for r in evaluation.model_route(ask, routes, "model", "else").collect()} == {("m@2", "there"), ("m", "here"), ("q", "else")}


def test_entry_without_llm(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_stored_cases(spark):
    import base64
    import pickle
    import zlib

    from tessera.operators import answers

    cases = json.dumps([{"input": "1", "output": "2", "testtype": "stdin"}])
    hidden = base64.b64encode(zlib.compress(pickle.dumps(cases))).decode()
    evil = base64.b64encode(zlib.compress(pickle.dumps(print))).decode()
    rows = [(1, cases), (2, hidden), (3, evil), (4, None), (5, "junk")]
    got = {r["i"]: r["cases"] for r in answers.decode_cases(spark.createDataFrame(rows, "i int, s string"), "s").collect()}
    assert [got[1][0]["output"], got[2][0]["output"], got[3], got[4], got[5]] == ["2", "2", None, None, None]


def test_assembly_and_fields(spark):
    from tessera.operators import answers

    cols = [F.col(c) for c in ("a", "l", "s", "e", "t")]
    rows = [
        ("```python\ndef f():\n    return 1\nif __name__ == '__main__':\n    f()\n```", "python", "import os\ndef f():\n", "f", "assert f() == 1"),
        ("    return 1;", "c", "int f(void) {", "f", "int main(void) { return f() - 1; }"),
    ]
    got = [r[0] for r in values(spark, rows, "a string, l string, s string, e string, t string", p=answers.assembled(*cols))]
    assert got[0] == "import os\ndef f():\n    return 1\n\nassert f() == 1\n"
    assert got[1].startswith("int f(void) {\n    return 1;\n}") and got[1].endswith("int main(void) { return f() - 1; }\n")
    doc = json.dumps({"header": "#ifndef OBS_H\n#define OBS_H\n#endif", "source": '#include "obs.h"\nint x;\n', "notes": "one\ntwo", "short": "x"})
    found = {r["field"]: r["unique_name"] for r in answers.code_fields(spark.createDataFrame([(1, doc)], "k int, d string"), "k", "d").collect()}
    assert found == {"header": "obs.h", "source": "obs.c", "notes": "notes.txt"}
    shown = values(spark, [('{"v": true}',), ('{"v": null}',), ('{"v": ["a", "b"]}',), ('{"v": {"x": 1}}',), ('{"v": 3}',)], "j string", s=answers.shown(F.try_variant_get(F.try_parse_json("j"), "$.v", "variant")))
    assert [s[0] for s in shown] == ["yes", "-", "a, b", '{"x":1}', "3"]


def test_experts(spark):
    from tessera.operators import models

    stats = spark.createDataFrame([(0, 0, 0.5, 3), (0, 1, 0.9, 1), (0, 2, 0.5, 4), (0, 3, 0.0, 0)], "layer int, expert int, saliency double, freq int")
    kept = models.choose_keep(stats, 2)
    assert [r["expert"] for r in kept.collect()] == [1, 2]
    assert tuple(models.kept_and_pruned(stats, kept).first()) == (0, 1.4, 0.5, 1)
    times = spark.createDataFrame([("data", 0, 149), ("reap", 149, 668), ("x", 5, None)], "stage string, start long, end long")
    assert {tuple(r) for r in models.stage_seconds(times).collect()} == {("data", 149), ("reap", 519), (None, 668)}
