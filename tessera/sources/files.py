"""Readers: Parquet tables, JSON lines, blank-line text, benchmark suites, task specifications, logs, job folders, file sizes."""

from __future__ import annotations

import json
import os
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import language

#: A benchmark problem; tests are code, or input/output pairs.
PROBLEM = "id string, language string, prompt string, stub string, entry string, canonical string, tests variant, date string, difficulty string"
PAIRS = "array<struct<input:string,output:string>>"
TASK = (
    "version int, task_name string, description string, input_format string, output_format string, seed_examples array<struct<input:string,output:string,tests:string>>, "
    "eval_criteria string, target struct<max_size_gb:double,min_tok_s:double,laptop_ram_gb:int>, task_type string, language string"
)
#: The stages of a job, in order, and the size of a teacher that isn't at hand.
STAGES = ("data", "reap", "heal", "quantize", "eval", "package")
TEACHER_GB = 61.0
LOOSE = "messages array<struct<role:string,content:string>>, prompt string, response string, input string, output string, instruction string, question string, answer string, system string, text string"


def parquet_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped, a malformed one is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, n, line) of text files in order; a file is one row first, so this is for logs and not for corpora."""
    whole = spark.read.option("wholetext", "true").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value"))
    return whole.select("file", F.posexplode(F.split("value", "\n")).alias("n", "line"))


def paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed, non-empty stretches between blank lines."""
    rows = spark.read.option("lineSep", "\n\n").text(path)
    return rows.select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("text")).where("text <> ''")


def json_lines_in_order(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines with `file` and `n`, their place in it; blank lines are skipped, a malformed one is an error. For files that fit one row each."""
    lines = numbered_lines(spark, path).where("trim(line) <> ''")
    return lines.select("file", "n", F.from_json("line", schema, {"mode": "FAILFAST"}).alias("r")).select("file", "n", "r.*")


def suite_path(name: str, folder: str, bundled: dict[str, str]) -> str:
    """Where a suite is: a bundled one beats the folder."""
    return bundled.get(name) or f"{folder.rstrip('/')}/{name}.jsonl"


def suite(spark: SparkSession, path: str, name: str, since: str | None = None, limit: int | None = None) -> DataFrame:
    """Problems of a suite in file order (n); rows without a date pass the date filter; a limit of 0 is none.

    tests is a string of code (tests_code) or a list of cases (tests_io), as each row has it.
    """
    rows = json_lines_in_order(spark, path, PROBLEM).drop("file")
    kind = F.schema_of_variant("tests")
    code, pairs = F.when(kind == "STRING", F.try_variant_get(F.col("tests"), "$", "string")), F.when(kind.startswith("ARRAY"), F.try_variant_get(F.col("tests"), "$", PAIRS))
    rows = rows.withColumn("tests_code", code).withColumn("tests_io", pairs).drop("tests")
    if since:
        rows = rows.where(F.col("date").isNull() | (F.col("date") == "") | (F.substring("date", 1, 10) >= since))
    rows = rows.withColumn("language", language(F.col("language"))).withColumn("suite", F.lit(name)).orderBy("n")
    return rows.limit(limit) if limit else rows


def suites(spark: SparkSession, paths: dict[str, str], since: str | None = None, limit: int | None = None) -> tuple[DataFrame, list[str]]:
    """(all problems, names of the suites without any)."""
    read = {name: suite(spark, path, name, since, limit) for name, path in paths.items()}
    return reduce(DataFrame.unionByName, read.values()), [name for name, rows in read.items() if rows.isEmpty()]


def held_out_problems(held: DataFrame, order: str = "idx") -> DataFrame:
    """Held-out rows with language and tests as problems, numbered by their own index."""
    fine = (F.coalesce("language", F.lit("")) != "") & (F.coalesce("tests", F.lit("")) != "")
    return held.where(fine).select(F.concat(F.lit("heldout/"), F.col(order).cast("string")).alias("id"), F.lit("heldout").alias("suite"), language(F.col("language")).alias("language"), F.col("input").alias("prompt"), F.col("tests").alias("tests_code"))


def task(spark: SparkSession, path: str) -> DataFrame:
    """Task specifications with their defaults; a field that is missing where it is needed stays null, for graph.task_rules()."""
    rows = spark.read.schema(TASK).option("multiLine", "true").json(path)
    filled = {"version": 1, "task_type": "text", "input_format": "", "output_format": "", "eval_criteria": ""}
    rows = rows.withColumns({c: F.coalesce(c, F.lit(x)) for c, x in filled.items()})
    seeds = F.transform("seed_examples", lambda e: F.struct(e["input"].alias("input"), e["output"].alias("output"), F.coalesce(e["tests"], F.lit("")).alias("tests")))
    target = F.struct(*(F.coalesce(F.col(f"target.{k}"), F.lit(x)).alias(k) for k, x in {"max_size_gb": 7.0, "min_tok_s": 40.0, "laptop_ram_gb": 16}.items()))
    return rows.withColumn("seed_examples", seeds).withColumn("target", target)


#: Folders whose files are nobody's work.
LEFT_OUT = (".git", "node_modules", "build", "__pycache__")


def walk(spark: SparkSession, path: str, left_out: tuple[str, ...] = LEFT_OUT) -> DataFrame:
    """(path, bytes) of the files under a folder, relative to it and without those in folders left out; nothing is read."""
    root = re.sub("^[a-z0-9]+:/+", "/", path).rstrip("/")
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    rows = rows.select(F.substring(F.regexp_replace("path", "^[a-z0-9]+:/+", "/"), len(root) + 2, 1 << 30).alias("path"), F.col("length").alias("bytes"))
    return rows.where(~F.arrays_overlap(F.split("path", "/"), F.array(*map(F.lit, left_out))))


def file_sizes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(name, bytes): sizes of the files under a folder, without reading them."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return rows.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.col("length").alias("bytes"))


def multi_part_sizes(sizes: DataFrame) -> DataFrame:
    """Sizes of artefacts whose parts are named x-00001-of-00003.ext."""
    return sizes.groupBy(F.regexp_replace("name", r"-\d+-of-\d+", "").alias("name")).agg(F.sum("bytes").alias("bytes"))


def teacher_gigabytes(sizes: DataFrame) -> DataFrame:
    """One row: gigabytes of the weight files among sizes (name, bytes), the known size where there is none."""
    of = F.sum(F.when(F.col("name").endswith(".safetensors"), F.col("bytes"))) / 1e9
    return sizes.agg(F.coalesce(of, F.lit(TEACHER_GB)).alias("gigabytes"))


def candidates(sizes: DataFrame, named: dict[str, str] | None = None, listed: DataFrame | None = None) -> DataFrame:
    """(candidate, file, bytes) to evaluate: a map of names to files, or else rows (candidate, file); files in parts count whole, missing ones have null bytes."""
    spark = sizes.sparkSession
    rows = spark.createDataFrame(sorted(named.items()), "candidate string, file string") if named else listed
    return rows.join(multi_part_sizes(sizes).withColumnRenamed("name", "file"), "file", "left").select("candidate", "file", "bytes")


def calibration_texts(spark: SparkSession, path: str) -> DataFrame:
    """Texts (text) of a calibration file: of JSON lines the text, else the contents of the messages; of any other file what blank lines part. Empty ones go."""
    if not path.endswith(".jsonl"):
        return paragraphs(spark, path)
    rows = json_lines(spark, path, LOOSE)
    said = F.array_join(F.transform("messages", lambda m: m["content"]), "\n")
    return rows.select(F.coalesce(F.nullif("text", F.lit("")), said).alias("text")).where("trim(text) <> ''")


def by_stem(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(stem, fields) of a folder of JSON documents, by the names of their files."""
    rows = spark.read.schema(schema).option("multiLine", "true").option("pathGlobFilter", "*.json").json(path)
    return rows.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("stem"), *rows.columns)


def optional_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document, or no row where there is none."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", "true").json(path)


def code_reference(spark: SparkSession, base: str, reference: str, schema: str) -> DataFrame:
    """Another job's report: a file, or a folder's out/eval.json, relative to the folder that holds the jobs; no row where there is none."""
    at = reference if "://" in reference or reference.startswith("/") else f"{base.rstrip('/')}/{reference}"
    return optional_json(spark, at if at.endswith(".json") else f"{at.rstrip('/')}/out/eval.json", schema)


def newest_first(rows: DataFrame, *moments: str) -> DataFrame:
    """Rows by the first of their moments that isn't null, newest first; those without any come last."""
    return rows.orderBy(F.coalesce(*moments).desc_nulls_last())


def disk_lines(lines: DataFrame, column: str = "line") -> DataFrame:
    """(job, done, running, model, label) of lines job|stage,stage,|0 or 1|0 or 1; unknown stages go, missing parts are empty."""
    part = F.split(column, r"\|")
    at = lambda k: F.coalesce(F.try_element_at(part, F.lit(k)), F.lit(""))
    done = F.filter(F.split(at(2), ","), lambda x: x.isin(*STAGES))
    rows = lines.select(at(1).alias("job"), done.alias("done"), (at(3) == "1").alias("running"), (at(4) == "1").alias("model"))
    return rows.withColumn("label", disk_label(F.col("done"), F.col("running")))


def disk_label(done: Column, running: Column) -> Column:
    """What a job's folder says of it: running, done, where it stopped, or queued."""
    last = F.element_at(F.filter(F.array(*map(F.lit, STAGES)), lambda x: F.array_contains(done, x)), -1)
    return F.when(running, "running*").when(F.size(done) == len(STAGES), "done*").when(F.size(done) > 0, F.concat(F.lit("stopped*:"), last)).otherwise("queued")


def job_facts(documents: DataFrame, lines: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row a job: its documents by name, how many filled lines its files have, and their bytes.

    documents is (job, name, body), lines (job, name, line), sizes (job, name, bytes); each side is aggregated before they meet.
    """
    gather = lambda df, value, into: df.groupBy("job").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", value)))).alias(into))  # noqa: E731 - a few files a job
    counts = lines.where("trim(line) <> ''").groupBy("job", "name").agg(F.count("*").alias("n"))
    facts = gather(documents, "body", "documents").join(gather(counts, "n", "lines"), "job", "full")
    return facts.join(gather(sizes, "bytes", "sizes"), "job", "full")


def overrides(known: dict, preset: dict, pairs: list[str], long: dict | None = None) -> dict:
    """A job's settings: a preset, what long jobs change, then key=value pairs, whose values are JSON if they parse; unknown keys are an error."""
    out = {**preset, **(long or {})}
    for pair in pairs:
        key, sign, value = pair.partition("=")
        if not sign:
            raise ValueError(f"expected key=value, got {pair!r}")
        if key not in known:
            raise ValueError(f"unknown key {key!r}; known: {', '.join(sorted(known))}")
        try:
            out[key] = json.loads(value)
        except ValueError:
            out[key] = value
    return out


def settings(stored: dict, known: dict, prefix: str, environment: dict | None = None) -> dict:
    """Settings with their defaults (known): stored ones that are known, over which variables of the environment go."""
    environment = os.environ if environment is None else environment
    stored = {k: v for k, v in stored.items() if k in known}
    named = {k: environment[prefix + k.upper()] for k in known if prefix + k.upper() in environment}
    return {**known, **stored, **named}


def calibration(rows: DataFrame, key: str, seed: str, n: int, tokens: int) -> DataFrame:
    """n rows in seeded order with at most `tokens` ids each (column ids)."""
    from ..operators.curation import seeded

    return rows.orderBy(seeded(seed, key), key).limit(n).withColumn("ids", F.slice("ids", 1, tokens))
