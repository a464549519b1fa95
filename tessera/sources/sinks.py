"""Writers, and the manifest of finished stages."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def training_files(train: DataFrame, held_out: DataFrame, stats: DataFrame, folder: str, order: str = "ord", most: int = 1000) -> None:
    """What a data stage leaves: rows to train on, held-out rows, statistics, and a calibration text of the first rows' questions and answers, blank lines between them."""
    json_lines(train.drop(order), f"{folder}/train.jsonl")
    json_lines(held_out, f"{folder}/heldout.jsonl")
    json_lines(stats, f"{folder}/stats.json")
    said = F.transform(F.filter("messages", lambda m: m["role"] != "system"), lambda m: m["content"])
    first = train.orderBy(order).limit(most)  # the feature: the first rows
    first.select(F.array_join(said, "\n").alias("value")).coalesce(1).write.mode("overwrite").option("lineSep", "\n\n").text(f"{folder}/calib.txt")


def answers_by_candidate(rows: DataFrame, folder: str) -> None:
    """Per-answer rows, a folder for each candidate."""
    rows.write.mode("overwrite").partitionBy("candidate").json(folder)


def evaluation_report(candidates: DataFrame, facts: DataFrame, order: str = "ord") -> DataFrame:
    """One row with the column `report`: a document of facts (one row) and all candidates in their order."""
    listed = candidates.agg(F.transform(F.sort_array(F.collect_list(F.struct(order, F.struct(*[c for c in candidates.columns if c != order]).alias("c")))), lambda x: x["c"]).alias("candidates"))  # a handful
    return facts.crossJoin(listed).select(F.to_json(F.struct(*facts.columns, "candidates")).alias("report"))


def append_events(events: DataFrame, folder: str, checkpoint: str):
    """A running query that appends a stream's events to a log of JSON lines."""
    return events.writeStream.format("json").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(folder)


def append_log(lines: DataFrame, folder: str) -> None:
    """Lines after those that a log has."""
    lines.write.mode("append").text(folder)


def verified_files(spark: SparkSession, folder: str, expected: DataFrame) -> DataFrame:
    """(name, sha256, intact): files of a folder against expected (name, sha256); missing ones aren't intact."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    found = found.select(F.regexp_extract("path", "[^/]+$", 0).alias("name"), F.sha2("content", 256).alias("found"))
    return expected.join(found, "name", "left").select("name", "sha256", F.coalesce(F.col("found") == F.lower("sha256"), F.lit(False)).alias("intact"))


def local_copy(saved: DataFrame, local: DataFrame, remote: DataFrame) -> DataFrame:
    """saved manifests (name, sha256) whose local file (name, sha256) is the one saved, and the remote one too where it is known."""
    same = lambda df, into: df.select("name", F.lower("sha256").alias(into))
    rows = saved.join(same(local, "__here"), "name").where("__here = lower(sha256)").join(same(remote, "__there"), "name", "left")
    return rows.where("__there is null or __there = __here").select(*saved.columns)


def write_files(fields: DataFrame, folder: str, name: str = "unique_name", body: str = "text") -> DataFrame:
    """(file, bytes) of texts written as files of their own by the executors, into any file system that Arrow knows; names are reduced to their last part."""
    uri = folder if "://" in folder else folder.replace("file:", "file://", 1) if folder.startswith("file:") else f"file://{folder}"

    def run(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        for b in batches:
            rows = []
            for n, t in zip(b.column("name").to_pylist(), b.column("body").to_pylist(), strict=True):
                raw, n = (t or "").encode(), (n or "").rsplit("/", 1)[-1] or "unnamed"
                with store.open_output_stream(f"{root}/{n}") as out:
                    out.write(raw)
                rows.append((f"{root}/{n}", len(raw)))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], names=["file", "bytes"])

    return fields.select(F.col(name).alias("name"), F.col(body).alias("body")).mapInArrow(run, "file string, bytes long")


def json_document(df: DataFrame, path: str) -> None:
    """A frame of one row as one JSON document."""
    df.coalesce(1).write.mode("overwrite").json(path)


class Manifest:
    """Markers of finished stages in a folder of any file system that Spark knows; clearing one clears those after it."""

    def __init__(self, spark: SparkSession, folder: str, stages: list[str]) -> None:
        self.spark, self.folder, self.stages = spark, folder.rstrip("/"), stages
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, stage: str):
        return self._path(f"{self.folder}/.done/{stage}.json")

    def done(self, stage: str) -> bool:
        return self._fs.exists(self._at(stage))

    def mark(self, stage: str, **facts) -> None:
        """Written aside and renamed over the old one, so a marker is whole, old or new, at any time."""
        tmp = self._path(f"{self.folder}/.done/.{stage}.tmp")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(facts, sort_keys=True).encode()))
        out.close()
        jvm = self.spark._jvm
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri()).rename(tmp, self._at(stage), options)

    def clear_from(self, stage: str) -> None:
        for s in self.stages[self.stages.index(stage) :]:
            self._fs.delete(self._at(s), False)

    def pending(self) -> list[str]:
        return [s for s in self.stages if not self.done(s)]

    def run(self, stage: str, work) -> DataFrame:
        """The stage's table: read if done, else made by work(), written and marked."""
        path = f"{self.folder}/{stage}.parquet"
        if not self.done(stage):
            work().write.mode("overwrite").parquet(path)
            self.mark(stage)
        return self.spark.read.parquet(self.table(stage))

    def shared_from(self, other: Manifest, stage: str) -> bool:
        """Take over a stage that another job has finished, unless this one has: its table is read where it is. Tells whether it was."""
        if self.done(stage) or not other.done(stage):
            return False
        self.mark(stage, table=other.table(stage))
        return True

    def facts(self, stage: str) -> dict:
        row = self.spark.read.text(str(self._at(stage).toString()), wholetext=True).first()
        return json.loads(row[0]) if row else {}

    def table(self, stage: str) -> str:
        """Where a finished stage's table is."""
        return self.facts(stage).get("table") or f"{self.folder}/{stage}.parquet"
