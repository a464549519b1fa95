"""Event logs as streams: parsing, folding into a board, windows with a watermark."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.events import WHOLE, latest_run, parse_line


def lines(spark: SparkSession, path: str, separator: str = "\n") -> DataFrame:
    """Lines that are appended to files of a folder; a blank-line separator gives server-sent events."""
    return spark.readStream.option("lineSep", separator).text(path).select(F.col("value").alias("line"))


def protocol(stream: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, other lines) of a stream of lines."""
    parsed = stream.withColumn("e", parse_line(F.col("line")))
    return parsed.where("e is not null").select("e.*"), parsed.where("e is null").select("line")


def board(stream: DataFrame, key: str = "stage", order: str = "ts") -> DataFrame:
    """The last status of each stage; for complete or update mode."""
    return stream.groupBy(key).agg(F.max_by(F.struct("status", "pct", "msg"), order).alias("__r"), F.count("*").alias("events")).select(key, "__r.*", "events")


def once(stream: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """Events without those seen before, for replays."""
    return stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, at: str, keys: list[str], size: str = "1 day", late: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by window; append mode emits closed windows only. at may be without a zone: it is read as UTC."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return timed.groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("started"), *keys, "n", "total")


def replay_live(log: DataFrame, stream: DataFrame, job: str, order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(events of a job's latest run so far, those that a stream of the same log brings after them).

    A client shows the first and follows the second; both have the order that the log gives its events.
    """
    past = latest_run(log.where(F.col("job") == job), (F.col("stage") == WHOLE) & (F.col("status") == "running"), order, ["job"])
    last = past.agg(F.max(order)).first()[0]
    return past, stream.where((F.col("job") == job) & (F.col(order) > F.lit(last if last is not None else -1)))


def is_terminal() -> Column:
    """Whether an event ends a run, and with it the stream of its events."""
    return (F.col("stage") == WHOLE) & (F.col("status") != "running")


def until_terminal(spark: SparkSession, query, folder: str, poll: float = 0.5, give_up: float = 3600.0) -> bool:
    """Wait until a running query has appended an event that ends the run to its folder, then stop it; False if none came in time."""
    began, path = time.monotonic(), spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/_spark_metadata")
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    try:
        while True:
            over = not query.isActive or time.monotonic() - began > give_up  # what came meanwhile is looked at once more
            if store.exists(path) and not spark.read.schema("stage string, status string").json(folder).where(is_terminal()).isEmpty():
                return True
            if over:
                return False
            time.sleep(poll)
    finally:
        query.stop()


def closing_event(events: DataFrame, exits: DataFrame, order: str = "seq") -> DataFrame:
    """The event that each run lacks at its end: exits is (job, code, stopped), events (job, stage, status, seq).

    A run that was stopped ends so; one whose last event isn't the whole run's ended by an error.
    """
    last = events.groupBy("job").agg(F.max_by("stage", order).alias("__stage"), F.max(order).alias("__n"))
    rows = exits.join(last, "job", "left").where(F.col("stopped") | ~F.col("__stage").eqNullSafe(WHOLE))
    message = F.when(F.col("stopped"), "stopped; resume to continue").otherwise(F.concat(F.lit("exited with "), F.col("code").cast("string")))
    return rows.select("job", F.lit(WHOLE).alias("stage"), F.when(F.col("stopped"), "stopped").otherwise("error").alias("status"), message.alias("msg"), (F.coalesce("__n", F.lit(0)) + 1).alias(order))


def back_off(failures: int, most: int = 20) -> float | None:
    """Seconds until a client that failed so often in a row tries again; None when it gives up."""
    return None if failures > most else min(30.0, 2.0 * failures)


def fan_out(stream: DataFrame, sinks: list, checkpoint: str):
    """Every micro-batch to each sink(df, batch id). A batch that failed comes again with its id, so sinks must do nothing for an id that they have had."""

    def each(df: DataFrame, batch: int) -> None:
        df.persist()
        for s in sinks:
            s(df, batch)
        df.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once_per_batch(write, folder: str):
    """A sink that runs write(df, path) once for each batch id: into a folder of the id, over what a failed attempt left."""
    return lambda df, batch: write(df, f"{folder.rstrip('/')}/batch={batch}")
