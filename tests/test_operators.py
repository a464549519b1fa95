"""Operators over files, drafts, programs, runs and texts against cases worked out by hand."""

import base64
import json
import shutil
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.functions import jsontext, text
from tessera.operators import answers, curation, evaluation, events, execution, graph
from tessera.sources import files, sinks
from tessera.streaming import logs


def one(spark, value, schema, expr):
    return spark.createDataFrame([(value,)], schema).select(expr).first()[0]


def test_suites_as_they_are(spark, tmp_path):
    rows = [
        {"id": "z/1", "language": "c", "prompt": "int f(void)\n", "stub": "int f(void)\n", "entry": "f", "tests": "int main(void) { return f(); }"},
        {"id": "a/2", "language": "PY", "prompt": "add two numbers", "tests": [{"input": "1 2\n", "output": "3\n"}], "date": "2025-03-04T10:00:00"},
        {"id": "b/3", "language": "ts", "prompt": "p", "tests": "x", "date": None},
    ]
    (tmp_path / "own.jsonl").write_text("\n\n".join(map(json.dumps, rows)) + "\n")
    path = files.suite_path("own", f"file://{tmp_path}/", {})
    got = files.suite(spark, path, "own").collect()
    assert [(r["id"], r["language"]) for r in got] == [("z/1", "c"), ("a/2", "python"), ("b/3", "typescript")]  # file order
    assert got[0]["tests_code"].startswith("int main") and got[0]["tests_io"] is None
    assert got[1]["tests_code"] is None and [tuple(c) for c in got[1]["tests_io"]] == [("1 2\n", "3\n")]
    assert [r["id"] for r in files.suite(spark, path, "own", since="2025-04-01").collect()] == ["z/1", "b/3"]
    assert [r["id"] for r in files.suite(spark, path, "own", limit=2).collect()] == ["z/1", "a/2"]
    assert files.suite_path("own", "x", {"own": "y"}) == "y"
    (tmp_path / "none.jsonl").write_text("\n")
    every, empty = files.suites(spark, {"own": path, "none": f"file://{tmp_path}/none.jsonl"})
    assert every.count() == 3 and empty == ["none"]
    (tmp_path / "bad.jsonl").write_text("{]\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        files.suite(spark, f"file://{tmp_path}/bad.jsonl", "bad").collect()


def test_task_specifications_as_they_are(spark, tmp_path):
    seed = {"input": "i", "output": "o"}
    (tmp_path / "t.json").write_text(json.dumps({"task_name": "n", "description": "d", "seed_examples": [seed] * 3, "target": {"max_size_gb": 5}}, indent=1))
    t = files.task(spark, f"file://{tmp_path}/t.json")
    r = t.first()
    assert (r["version"], r["task_type"], r["input_format"]) == (1, "text", "") and tuple(r["target"]) == (5.0, 40.0, 16) and r["seed_examples"][0]["tests"] == ""
    assert graph.violations(t, "task_name", graph.task_rules()).collect() == []


def test_drafts(spark):
    seeds = [{"input": "i", "output": {"a": 1}}] * 3
    full = {"task_name": "My Task!", "description": {"x": 1}, "seed_examples": seeds, "target": {"max_size_gb": 9, "more": 1}, "version": 0, "junk": 1}
    replies = [json.dumps(full), "Sure:\n```json\n" + json.dumps({"taskspec": full}) + "\n```", json.dumps(full | {"seed_examples": [{"input": "x"}]}), "no object"]
    d = spark.createDataFrame(list(enumerate(replies)), "k int, t string").select("k", jsontext.draft(F.col("t")).alias("d"))
    got = [r["d"] for r in d.orderBy("k").collect()]
    for g in got[:2]:
        assert (g["version"], g["task_name"], g["description"], g["input_format"]) == (1, "my-task", '{"x":1}', None) and tuple(g["target"]) == (9.0, 40.0, 16)
        assert [tuple(e) for e in g["seed_examples"]] == [("i", '{"a":1}', "")] * 3 and not g["bad_seeds"]
    assert got[2]["bad_seeds"] and got[3] is None
    fine = d.where("d is not null").select("k", "d.*")
    assert {tuple(r) for r in graph.violations(fine, "k", graph.task_rules() | {"seeds": ~F.col("bad_seeds")}).collect()} == {(2, "seed_examples"), (2, "seeds")}


def test_prompts(spark):
    df = spark.createDataFrame([("code", "c", "sort", "a list", "code")], "t string, l string, d string, i string, o string")
    system = df.select(text.system_prompt(*(F.col(c) for c in "tldio")).alias("s"))
    assert "no main()" in system.first()[0] and "Task: sort" in system.first()[0]
    shots = F.array(F.struct(F.lit("q").alias("input"), F.lit("a").alias("output")))
    chat = system.select(text.answer_messages(F.col("s"), F.lit("short"), shots, F.lit("now"))).first()[0]
    assert [m["role"] for m in chat] == ["system", "user", "assistant", "user"] and chat[0]["content"].endswith("A good answer satisfies: short") and chat[3]["content"] == "now"
    ask = lambda stub, reads, raw: df.select(text.problem_prompt(F.col("l"), F.lit("do it\n"), F.lit(stub), F.lit(reads), F.lit(raw))).first()[0]
    assert "```c\ndo it\n```" in ask("int f", False, False) and "stdin" in ask("", True, False) and ask("", False, True) == "do it\n"


def test_templates(spark):
    cases = [("..<|turn>..", "x", "gemma4"), ("<start_of_turn>", "", "gemma3"), ("a<|im_start|>", "gemma", "chatml"), ("other", "gemma", None), ("", "org/Gemma-4-9b", "gemma4"), ("", "org/gemma-2", "gemma3"), (None, None, "chatml")]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, t string, m string, w string").orderBy("i")
    assert [r[0] for r in df.select(text.template_family(F.col("t"), F.col("m"))).collect()] == [c[2] for c in cases]
    made = df.select(text.model_file(F.lit("be brief"), F.col("t"), F.col("m"), {"gemma3": "T3"})).collect()
    assert 'TEMPLATE """T3"""\nPARAMETER stop "<end_of_turn>"' in made[1][0] and "TEMPLATE" not in made[3][0] and made[3][0].endswith('SYSTEM """be brief"""\n')


def test_figures_and_lines(spark):
    v = spark.createDataFrame([(0.4,), (59.6,), (61.0,), (3725.0,)], "s double")
    assert [r[0] for r in v.select(text.duration(F.col("s"))).collect()] == ["0s", "1m00s", "1m01s", "1h02m"]
    assert [r[0] for r in v.select(text.duration(F.col("s"), True)).collect()] == ["0m00s", "0m59s", "1m01s", "1h02m"]
    assert [r[0] for r in v.select(text.milliseconds(F.col("s") * 1000)).collect()] == ["400ms", "59.6s", "1m01s", "1h02m"]
    assert [one(spark, x, "x double", text.milliseconds(F.col("x"))) for x in (None, -1.0, float("nan"))] == ["-"] * 3
    assert [one(spark, x, "x long", text.token_count(F.col("x"))) for x in (999, 9500, 12_400, 1_250_001)] == ["999", "9.5k", "12k", "1.3M"]
    assert [one(spark, x, "x double", text.ago(F.col("x"))) for x in (-5.0, 89.0, 600.0, 7200.0)] == ["0s ago", "89s ago", "10m ago", "2.0h ago"]
    assert [one(spark, x, "x double", text.score_shown(F.col("x"), F.lit(m))) for x, m in ((None, "judge"), (0.87, "judge"), (0.87, "agreement"))] == ["–", "8.7/10", "87%"]
    assert one(spark, "a  b\nc d", "x string", text.clip(F.col("x"), 5)) == "a b …" and one(spark, "\x1b[31mred\x1b[0m", "x string", text.padded(F.col("x"), 5, True)) == "  \x1b[31mred\x1b[0m"
    words = "one two three four five six seven"
    assert one(spark, words, "x string", text.wrapped(F.col("x"), 9)) == ["one two", "three", "four five", "six seven"]
    assert one(spark, words, "x string", text.wrapped(F.col("x"), 9, 3)) == ["one two", "three", "four fiv…"]
    assert one(spark, "x" * 12, "x string", text.file_block(F.lit("p"), F.col("x"), 10)) == "--- p\n" + "x" * 10 + "\n…(truncated)"
    assert [one(spark, x, "x string", text.job_id(F.col("x"), loose)) for x, loose in (("ab1", False), ("a-b", False), ("a-b_", True), ("-", True), ("", False))] == [True, False, True, False, False]
    assert one(spark, "JSON please", "x string", text.expects_json(F.lit("text"), F.col("x"), F.lit(""))) and not one(spark, "JSON", "x string", text.expects_json(F.lit("code"), F.col("x"), F.lit("")))


def test_programs_run_as_they_should(spark):
    cases = [("2\n", "4"), ("5\n", "10\n")]
    functional = base64.b64encode(zlib.compress(__import__("pickle").dumps(json.dumps([{"input": "[1, 2]\n3", "output": "[1, 2, 3]", "testtype": "functional"}])))).decode()
    raw = spark.createDataFrame(
        [("p", "1", "Append.", "class Solution: pass", '{"func_name": "add"}', "2025-01-02", functional), ("p", "2", "Double.", "", None, "2025-01-03", json.dumps([{"input": i, "output": o, "testtype": "stdin"} for i, o in cases])), ("p", "3", "x", "", "{}", None, functional), ("p", "4", "x", "", "{}", None, "[]")],
        "platform string, question_id string, question_content string, starter_code string, metadata string, contest_date string, stored string",
    )
    made = answers.problems(answers.decode_cases(raw, "stored"))
    rows = {r["id"]: r for r in made.collect()}
    assert set(rows) == {"p/1", "p/2"} and rows["p/1"]["entry"] == "add" and "Start from this code" in rows["p/1"]["prompt"] and rows["p/2"]["tests_code"] is None
    replies = {"p/1": ["class Solution:\n    def add(self, a, b):\n        return (*a, b)", "class Solution:\n    def add(self, a, b):\n        return a"], "p/2": ["import sys\nprint(2 * int(sys.stdin.read()), end='  ')", "print(4)", "raise SystemExit(0)"]}
    said = spark.createDataFrame([(f"{i}#{k}", i, f"```python\n{a}\n```") for i, x in replies.items() for k, a in enumerate(x)], "key string, id string, answer string")
    ready = answers.programs(said.join(made.select("id", "language", "entry", "tests_code", "tests_io").withColumn("stub", F.lit("")), "id"))
    got = {r["key"]: (r["passed"], r["reason"]) for r in execution.run_tests(ready, "key", "language", "program", timeout=20).collect()}
    bad = (False, "test_failed")
    assert got == {"p/1#0": (True, ""), "p/1#1": bad, "p/2#0": (True, ""), "p/2#1": bad, "p/2#2": bad}


def test_toolchains(spark):
    code = {"c": "int main(void) { return 0; }", "cpp": "#include <vector>\nint main() { return std::vector<int>{1}.size() - 1; }", "javascript": "if (1 + 1 !== 2) throw 1;", "cobol": "x"}
    broken = {"c": "int main(void) { return }", "javascript": "throw new Error('no')"}
    rows = [(f"{k}+", k, v) for k, v in code.items()] + [(f"{k}-", k, v) for k, v in broken.items()]
    df = spark.createDataFrame(rows, "key string, lang string, code string")
    got = {r["key"]: (r["passed"], r["reason"]) for r in execution.run_tests(df, "key", "lang", "code", timeout=20).collect()}
    for lang in ("c", "cpp", "javascript"):
        assert got[f"{lang}+"] == ((False, "missing_toolchain") if execution.toolchain_lacks(lang) else (True, ""))
    assert got["cobol+"] == (False, "unsupported_language")
    if not execution.toolchain_lacks("c"):
        assert got["c-"] == (False, "compile_error")
    built = {r["key"]: r["passed"] for r in execution.compile_check(df.where("lang = 'javascript'"), "key", "lang", "code").collect()}
    assert all(built.values()) or not shutil.which("node")


def test_fields_of_answers_as_files(spark):
    doc = {"pattern_name": "Ring Buffer", "header_code": "#pragma once\nint a;\n", "impl": "#include <stdio.h>\nint a;\n", "script": "#!/bin/sh\nls\n", "query": "select 1\nwhere true\n", "notes": "a\nb", "notes2": "c\nd"}
    two = {"a": "#ifndef OBS_H\n#define OBS_H\n#endif\n", "b": "#ifndef LOG_H\n#define LOG_H\n#endif\n", "c": "int f(int x) {\n return x;\n}\n"}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, json.dumps(two))], "k int, d string")
    got = {(r["k"], r["field"]): r["unique_name"] for r in answers.code_fields(df, "k", "d").collect()}
    assert got == {(1, "header_code"): "ring_buffer.h", (1, "impl"): "ring_buffer.c", (1, "script"): "ring_buffer.sh", (1, "query"): "ring_buffer.sql", (1, "notes"): "ring_buffer.txt", (1, "notes2"): "ring_buffer_2.txt", (2, "a"): "obs.h", (2, "b"): "log.h", (2, "c"): "c.c"}
    kinds = {"import os\nx": ".py", "const a = 1\nlet b": ".js", '{"a":\n1}': ".json", "typedef int t;\n": ".c", "echo hi\n": ".sh", "plain\ntext": ".txt"}
    rows = spark.createDataFrame(list(kinds.items()), "t string, w string")
    assert [r for r in rows.withColumn("g", text.extension(F.lit("f"), F.col("t"))).collect() if r["g"] != r["w"]] == []


def test_gathering_inputs(spark):
    seeds = spark.createDataFrame([("Known one",)], "input string")
    written = {1: ["known ONE", "first", "First!", "second"], 2: ["second", "third"], 3: ["third"]}
    ask = []

    def write(n, wanted):
        ask.append(wanted)
        return spark.createDataFrame([(n * 100 + k, x) for k, x in enumerate(written[n])], "ord long, input string")

    kept, rounds = curation.gather_inputs(write, seeds, 20, 4)
    assert [r["input"] for r in kept.collect()] == ["first", "second", "third"] and rounds == 3 and ask == [31, 29, 28]
    kept, rounds = curation.gather_inputs(write, seeds, 1, 1)
    assert [r["input"] for r in kept.collect()] == ["first", "second"] and rounds == 1
    results = spark.createDataFrame([(0, True, "", ""), (2, False, "timeout", "late"), (1, False, "test_failed", "no")], "ord int, passed boolean, reason string, output string")
    with pytest.raises(ValueError, match="2 seed examples.*seed 1: test_failed"):
        curation.seed_gate(results)
    curation.seed_gate(results.where("passed"))
    checked = spark.createDataFrame([(1, ""), (2, "empty"), (3, "empty"), (4, "truncated")], "i int, reason string")
    assert json.loads(curation.stats_document(checked, {"rounds": 3}).first()[0]) == {"rounds": 3, "answered": 1, "dropped": {"empty": 2, "truncated": 1}}
    seen, told = curation.statistics(checked, "answers")
    seen.count()
    assert told.get == {"rows": 4, "kept": 1, "dropped": 3}
    prompts = spark.range(2000).withColumnRenamed("id", "k")
    replies = curation.dry_replies(prompts, "k", [{"output": "a"}, {"output": "b"}], "7")
    n = replies.agg(F.count_if(F.col("text") == "{broken"), F.count_if(~F.col("finished"))).first()
    assert 30 < n[0] < 100 and 5 < n[1] < 50 and replies.collect() == curation.dry_replies(prompts.repartition(3), "k", [{"output": "a"}, {"output": "b"}], "7").orderBy("k").collect()


def test_outputs(spark, tmp_path):
    m = lambda k: [("system", "s"), ("user", f"q{k}"), ("assistant", f"a{k}")]
    train = spark.createDataFrame([(k, m(k)) for k in (2, 0, 1)], "ord int, messages array<struct<role:string,content:string>>")
    base = f"file://{tmp_path}"
    sinks.training_files(train, spark.createDataFrame([("i", "r")], "input string, reference string"), spark.createDataFrame([(1,)], "rows int"), f"{base}/data", most=2)
    assert sorted(r["text"] for r in files.paragraphs(spark, f"{base}/data/calib.txt").collect()) == ["q0\na0", "q1\na1"]
    assert files.json_lines(spark, f"{base}/data/train.jsonl", files.LOOSE).count() == 3
    report = sinks.evaluation_report(spark.createDataFrame([(1, "b", 0.5), (0, "a", None)], "ord int, name string, score double"), spark.createDataFrame([("a",)], "winner string")).first()[0]
    assert json.loads(report) == {"winner": "a", "candidates": [{"name": "a"}, {"name": "b", "score": 0.5}]}
    sinks.answers_by_candidate(spark.createDataFrame([("x", 1), ("y", 2)], "candidate string, n int"), f"{base}/answers")
    assert sorted(p.name for p in (tmp_path / "answers").iterdir() if p.is_dir()) == ["candidate=x", "candidate=y"]
    wrote = sinks.write_files(spark.createDataFrame([("../a.c", "int a;"), ("b.txt", None)], "unique_name string, text string"), f"{base}/code").collect()
    assert {r["bytes"] for r in wrote} == {0, 6} and (tmp_path / "code/a.c").read_text() == "int a;"
    import hashlib

    sha = hashlib.sha256(b"int a;").hexdigest()
    kept = sinks.verified_files(spark, f"{base}/code", spark.createDataFrame([("a.c", sha.upper()), ("b.txt", sha), ("none", sha)], "name string, sha256 string"))
    assert {(r["name"], r["intact"]) for r in kept.collect()} == {("a.c", True), ("b.txt", False), ("none", False)}
    s = lambda *rows: spark.createDataFrame(list(rows), "name string, sha256 string")
    assert [r["name"] for r in sinks.local_copy(s(("a", "1"), ("b", "2"), ("c", "3")), s(("a", "1"), ("b", "2"), ("c", "0")), s(("b", "9"))).collect()] == ["a"]
    one_, two = (sinks.Manifest(spark, f"{base}/{j}", ["data", "eval"]) for j in ("one", "two"))
    one_.run("data", lambda: spark.range(4))
    assert two.shared_from(one_, "data") and not two.shared_from(one_, "data") and two.run("data", lambda: spark.range(9)).count() == 4
    one_.mark("eval", n=1)
    one_.mark("eval", n=2)
    assert one_.facts("eval") == {"n": 2}
    sinks.append_log(spark.createDataFrame([("x",)], "value string"), f"{base}/log")
    sinks.append_log(spark.createDataFrame([("y",)], "value string"), f"{base}/log")
    assert sorted(r[0] for r in spark.read.text(f"{base}/log").collect()) == ["x", "y"]


def test_folders_and_settings(spark, tmp_path):
    for name in ("a/x.py", "a/.git/h", "node_modules/m.js", "b.safetensors", "s-00001-of-00002.gguf", "s-00002-of-00002.gguf"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("12345")
    base = f"file://{tmp_path}"
    assert sorted(r["path"] for r in files.walk(spark, base).collect()) == ["a/x.py", "b.safetensors", "s-00001-of-00002.gguf", "s-00002-of-00002.gguf"]
    sizes = files.file_sizes(spark, base)
    assert files.teacher_gigabytes(sizes).first()[0] == 5e-9 and files.teacher_gigabytes(sizes.limit(0)).first()[0] == 61.0
    assert {tuple(r) for r in files.candidates(sizes, {"q": "s.gguf", "none": "x.gguf"}).collect()} == {("q", "s.gguf", 10), ("none", "x.gguf", None)}
    (tmp_path / "docs").mkdir()
    for k in (1, 2):
        (tmp_path / f"docs/d{k}.json").write_text(json.dumps({"n": k}))
    assert {tuple(r) for r in files.by_stem(spark, f"{base}/docs", "n int").collect()} == {("d1", 1), ("d2", 2)}
    assert files.optional_json(spark, f"{base}/none.json", "n int").collect() == [] and files.code_reference(spark, base, "docs/d1.json", "n int").first()[0] == 1
    (tmp_path / "c.jsonl").write_text('{"text": "one"}\n{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]}\n{"text": " "}\n')
    assert sorted(r[0] for r in files.calibration_texts(spark, f"{base}/c.jsonl").collect()) == ["one", "q\na"]
    lines = spark.createDataFrame([("j|data,reap,junk,|0|1",), ("k||1",), ("l|data,reap,heal,quantize,eval,package|0|1",), ("m",)], "line string")
    assert [(r["job"], r["label"], r["model"]) for r in files.disk_lines(lines).collect()] == [("j", "stopped*:reap", True), ("k", "running*", False), ("l", "done*", True), ("m", "queued", False)]
    jobs = spark.createDataFrame([("a", None, 5), ("b", 9, 1), ("c", None, None)], "id string, opened int, created int")
    assert [r["id"] for r in files.newest_first(jobs, "opened", "created").collect()] == ["b", "a", "c"]
    assert files.overrides({"n": 1, "s": "x", "l": []}, {"n": 2}, ["s=text", "l=[1]"], {"n": 3}) == {"n": 3, "s": "text", "l": [1]}
    for bad in ("x=1", "n"):
        with pytest.raises(ValueError):
            files.overrides({"n": 1}, {}, [bad])
    assert files.settings({"a": 1, "junk": 2}, {"a": 0, "b": 0}, "P_", {"P_B": "7"}) == {"a": 1, "b": "7"}
    facts = files.job_facts(spark.createDataFrame([("j", "eval", "{}")], "job string, name string, body string"), spark.createDataFrame([("j", "t", "x"), ("j", "t", " "), ("k", "t", "y")], "job string, name string, line string"), spark.createDataFrame([("j", "m", 9)], "job string, name string, bytes long"))
    assert {r["job"]: (r["documents"], r["lines"], r["sizes"]) for r in facts.collect()} == {"j": ({"eval": "{}"}, {"t": 1}, {"m": 9}), "k": (None, {"t": 1}, None)}


def test_choice_and_listing(spark):
    c = spark.createDataFrame([("ref", 0.1), ("moe", 0.2), ("win", 0.3)], "name string, score double")
    pick = lambda names, w=None: [r["name"] for r in evaluation.first_named(c, "name", names, None if w is None else F.lit(w)).collect()]
    assert pick(["x", "moe"]) == ["moe"] and pick(["x"], "win") == ["win"] and pick(["x"]) == []
    rows = [("a", 0, 0.9, 9.0, 50.0, False), ("b", 1, 0.8, 5.0, 60.0, True), ("c", 2, 0.79, 4.0, 80.0, True)]
    cands = lambda rows: spark.createDataFrame(rows, "name string, ord int, score double, size_gb double, tok_s double, meets_target boolean")
    why = lambda rows, chosen: evaluation.why(cands(rows), chosen, "judge", 7, 40).first()[0]
    assert why(rows, "b") == "best judge score among candidates that meet the target of 7 GB and 40 tokens a second; a scores 9.0/10 but misses it (9.0 GB)"
    assert why(rows, "c") == "within 2 points of b (8.0/10), and preferred for its speed"
    assert why(rows[1:2], "b").startswith("the only candidate") and why(rows[:1], "a").startswith("no candidate met")
    d = evaluation.difference(spark.createDataFrame([("a",), ("b",), ("b",)], "x string"), spark.createDataFrame([("b",), ("c",)], "y string"))
    assert {tuple(r) for r in d.collect()} == {("a", "two"), ("c", "one")}
    m = spark.createDataFrame([("x", float(v)) for v in (5, 1, 4, 4, 2)] + [("y", 1.0), ("y", 2.0), ("z", None)], "k string, v double")
    for bins in (2, 4096):
        assert {tuple(r) for r in evaluation.exact_median(m, "k", "v", bins).collect()} == {("x", 4.0), ("y", 1.5)}


def test_runs(spark):
    logs_ = [("j", "data", 0, "===== old"), ("j", "data", 1, '{"stage": "data", "status": "error"}'), ("j", "data", 2, "===== new"), ("j", "data", 3, '{"stage": "data", "status": "running", "pct": 40, "msg": "m"}'), ("j", "data", 4, "text"), ("j", "heal", 0, "text"), ("j", "reap", 0, '{"stage": "reap", "status": "running"}')]
    lines = spark.createDataFrame(logs_, "job string, stage string, n int, line string")
    states = events.stage_states(lines, spark.createDataFrame([("j", "reap"), ("j", "eval")], "job string, stage string"))
    assert {(r["stage"], r["status"], r["pct"]) for r in states.collect()} == {("data", "running", 40.0), ("heal", "pending", None), ("reap", "done", 100.0), ("eval", "done", 100.0)}
    assert {(r["stage"], r["sections"], r["filled"]) for r in events.log_sections(lines, ["stage"], "n").collect()} == {("data", 2, 5), ("heal", 0, 1), ("reap", 0, 1)}
    assert [r["n"] for r in events.newest_lines(lines.where("stage = 'data'"), "job", "n", 2).orderBy("n").collect()] == [3, 4]
    tickets = spark.createDataFrame([(0, "a", "m1", "c", ["f"], ["r"], ["make"], "done", 1), (1, "b", "m2", "node", ["g", "f"], ["r"], ["npm t"], "failed", 2), (2, "d", "m", "c", [], [], ["x"], "running", 1)], "ord int, id string, model string, image string, owns array<string>, reads array<string>, acceptance array<string>, state string, attempts int")
    fix = events.fix_ticket(tickets, spark.createDataFrame([("b",), ("a",)], "id string")).first()
    assert (fix["title"], fix["model"], fix["owns"], fix["reads"], fix["acceptance"]) == ("Fix integration of a, b", "m1", ["f", "g"], ["r"], ["make", "npm t"])
    checks = spark.createDataFrame([("a", 0, "x", True, ""), ("a", 2, "z", False, "late"), ("a", 1, "y", False, "long output"), ("b", 0, "x", True, None)], "t string, n int, command string, passed boolean, out string")
    assert [tuple(r) for r in events.check_failures(checks, "t", "n", 6).collect()] == [("a", "y", "$ y\noutput\n")]
    meter = events.run_meter(tickets, 0).first()
    assert (meter["progress"], meter["agents"], meter["failed"]) == ("1/3 done", "1/-", 1)
    spans = spark.createDataFrame([(0, 100), (50, 150)], "start long, end long")
    figures = events.run_figures(tickets, spark.createDataFrame([(10, 5)], "tokens int, ms int"), spans).first()
    assert (figures["speed_up"], figures["peak"], figures["first_try"]) == ("1.3x", 2, 1)
    assert events.decode_speed(spark.createDataFrame([(10, 500_000_000), (20, 500_000_000)], "tokens int, ns long")).first()[0] == 30.0
    assert tuple(events.job_counts(spark.createDataFrame([("running", ["a", "b"]), ("done", ["c"])], "state string, candidates array<string>")).first()) == (2, 1, 3)
    assert events.part_progress(spark.createDataFrame([("a", 1, 10.0), ("a", 2, 50.0), ("b", 1, 0.0)], "p string, n int, pct double"), "p", "n").first()[0] == 25.0
    assert events.with_ticket(spark.createDataFrame([("a", 1), ("q", 2)], "ticket string, n int"), spark.createDataFrame([("a", "t")], "ticket string, title string")).orderBy("n").collect()[1]["title"] is None


def test_plans_in_context(spark):
    t = spark.createDataFrame([("a", "A", "implement", "do a", ["src/a.js"], ["src/*.js", "api.md"], ["npm t"]), ("b", "B", "test", "do b", ["api.md"], ["none/*"], [])], "id string, title string, role string, context string, owns array<string>, reads array<string>, acceptance array<string>")
    contents = spark.createDataFrame([("src/a.js", "A"), ("src/b.js", "B"), ("api.md", "api")], "path string, text string")
    shown = graph.context_files(t, contents.select("path"), spark.createDataFrame([("api.md",)], "path string"))
    assert {tuple(r) for r in shown.collect()} == {("a", "interface", "api.md"), ("a", "read", "src/b.js"), ("a", "owned", "src/a.js"), ("b", "owned", "api.md")}
    packs = {r["id"]: r["prompt"] for r in graph.prompt_pack(t, shown, contents).collect()}
    assert "## Interfaces\n--- api.md\napi\n\n## Files to read\n--- src/b.js\nB" in packs["a"] and packs["b"].endswith("## Files as they are now\n--- api.md\napi")
    parts = spark.createDataFrame([(0, "core", "C", "src", "all", [("api.h", "calls")])], "ord int, name string, language string, path string, responsibility string, interfaces array<struct<path:string,description:string>>")
    page = graph.architecture(parts, spark.createDataFrame([(0, "C", "speed")], "ord int, decision string, why string"), "sum", "flow").first()[0]
    assert "| core | C | `src` | all |" in page and "- `api.h` (core): calls" in page and page.endswith("- **C.** speed\n")
    assert graph.merge_plan([("a", 1, []), ("b", 1, ["a"]), ("c", 2, [])], {"a"}) == [("a", True), ("b", True), ("c", False)]
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "b"), ("x", "x"), ("y", "a"), ("m", "n"), ("n", "o"), ("o", "m"), ("n", "m")], "id string, dep string")
    assert sorted(r["path"] for r in graph.cycle_paths(ring).collect()) == [["a", "b", "c", "a"], ["m", "n", "m"], ["x", "x"]]


def test_streams_of_runs(spark, tmp_path):
    schema = "job string, seq long, stage string, status string"
    rows = [("j", 1, "pipeline", "running"), ("j", 2, "pipeline", "error"), ("j", 3, "pipeline", "running"), ("j", 4, "data", "running"), ("k", 1, "pipeline", "running")]
    log = spark.createDataFrame(rows, schema)
    past, rest = logs.replay_live(log, log.unionByName(spark.createDataFrame([("j", 5, "pipeline", "done")], schema)), "j")
    assert sorted(r["seq"] for r in past.collect()) == [3, 4] and [r["seq"] for r in rest.collect()] == [5]
    exits = spark.createDataFrame([("j", 3, False), ("k", 0, True), ("n", 1, False)], "job string, code int, stopped boolean")
    assert {(r["job"], r["status"], r["msg"], r["seq"]) for r in logs.closing_event(log, exits).collect()} == {("j", "error", "exited with 3", 5), ("k", "stopped", "stopped; resume to continue", 2), ("n", "error", "exited with 1", 1)}
    assert [logs.back_off(n) for n in (1, 15, 20, 21)] == [2.0, 30.0, 30.0, None]
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "1.jsonl").write_text('{"stage": "data", "status": "running", "ts": 1}\n{"stage": "pipeline", "status": "done", "ts": 2}\n')
    found, _ = logs.protocol(logs.lines(spark, f"file://{folder}"))
    out = f"file://{tmp_path}/out"
    assert logs.until_terminal(spark, sinks.append_events(found, out, f"file://{tmp_path}/ck"), out, give_up=60)
    assert spark.read.json(out).count() == 2
    sink = logs.once_per_batch(lambda df, path: df.write.mode("overwrite").parquet(path), f"file://{tmp_path}/batches")
    sink(log, 7)
    sink(log, 7)
    assert spark.read.parquet(f"file://{tmp_path}/batches").count() == 5


def test_small_expressions(spark, tmp_path):
    assert [one(spark, x, "x string", text.tail(F.col("x"), 3)) for x in ("abcdef", "ab", None)] == ["def", "ab", None]
    assert [one(spark, x, "x string", text.judge_score(F.col("x"))) for x in ("I give 7.5 of 10", "12", "none", None)] == [0.75, 1.0, None, None]
    assert [one(spark, x, "x double", events.progress(F.col("x"))) for x in (-3.0, 12.345, 250.0)] == [0.0, 12.3, 100.0]
    log = spark.createDataFrame([("j", 1, "ValueError: first"), ("j", 2, "  KeyError: indented"), ("j", 3, "RuntimeError: " + "x" * 500), ("j", 4, "bye"), ("k", 1, "one"), ("k", 2, "two"), ("k", 3, " ")], "job string, n int, line string")
    said = {r["job"]: r["message"] for r in events.error_message(log, ["job"], "n").collect()}
    assert said["j"] == ("RuntimeError: " + "x" * 500)[:400] and said["k"] == "two"
    from tessera.operators import models

    words = models.compression(spark.createDataFrame([("a b  c", "a"), (" d", "d e")], "x string, y string"), "x", "y").first()
    assert tuple(words) == (4, 3, 0.75)
    files_ = spark.createDataFrame([({"a": "1", "b": "2", "c": "3"}, ["a"])], "w map<string,string>, o array<string>")
    assert sorted(files_.select(graph.refused_paths(F.col("w"), F.col("o"))).first()[0]) == ["b", "c"]
    inputs = spark.createDataFrame([("p", "t1"), ("q", ""), ("r", None)], "input string, tests string")
    assert [r["input"] for r in curation.usable_inputs(inputs, True).collect()] == ["p"] and curation.usable_inputs(inputs, False).count() == 3
    answered = spark.createDataFrame([("p", "a"), ("z", "b")], "input string, answer string")
    assert [tuple(r) for r in curation.with_tests_of(answered, inputs).collect()] == [("p", "a", "t1")]
    assert sorted(r["external"] for r in curation.with_provenance(inputs.limit(2), inputs.limit(1)).collect()) == [False, False, True]
    assert tuple(curation.cut_rows(spark.createDataFrame([([1, 2, 3],), ([1],)], "input_ids array<int>"), 3).first()) == (2, 1)
    tries = spark.createDataFrame([("a", 5), ("a", 9), ("b", 1)], "t string, n int")
    assert {(r["t"], r["n"], r["attempt"]) for r in events.attempts(tries, "t", "n").collect()} == {("a", 5, 1), ("a", 9, 2), ("b", 1, 1)}
    assert [r["n"] for r in events.replay(tries, 5, "n").collect()] == [9]
    shown = spark.createDataFrame([(0, "done"), (1, "running"), (2, "failed"), (3, "waiting"), (4, "odd")], "ord int, state string")
    assert [r["ord"] for r in answers.in_view(shown.where("ord < 4"), 2).collect()] == [1, 2]
    held = spark.createDataFrame([(0, "i", "c", "t"), (1, "j", None, "t"), (2, "k", "py", ""), (3, "l", "js", "t")], "idx int, input string, language string, tests string")
    assert [(r["id"], r["language"]) for r in files.held_out_problems(held).orderBy("id").collect()] == [("heldout/0", "c"), ("heldout/3", "javascript")]
    sinks.json_document(spark.createDataFrame([(1, "x")], "n int, s string"), f"file://{tmp_path}/doc")
    assert spark.read.json(f"file://{tmp_path}/doc").first()["s"] == "x"


def test_replayed_events_count_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for k in (1, 2):
        (folder / f"{k}.json").write_text('{"id": 1, "ts": "2026-01-01 00:00:00"}\n{"id": %d, "ts": "2026-01-01 00:00:01"}\n' % (k + 1))
    stream = spark.readStream.schema("id long, ts timestamp").json(f"file://{folder}")
    q = logs.once(stream, "id", "ts").writeStream.format("memory").queryName("seen_once").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(r["id"] for r in spark.table("seen_once").collect()) == [1, 2, 3]
