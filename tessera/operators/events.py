"""Folding logs of events into states, durations and summaries, in batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a stage can report.
STATUSES = ("running", "done", "error", "stopped")
#: The stage whose running event starts a run.
WHOLE = "pipeline"


def parse_line(line: Column) -> Column:
    """struct(stage, status, pct, msg, ts) of a protocol line, null for any other line."""
    v = F.try_parse_json(line)
    get = lambda name, kind: F.try_variant_get(v, f"$.{name}", kind)
    fine = F.schema_of_variant(v).startswith("OBJECT") & get("stage", "string").isNotNull() & get("status", "string").isin(*STATUSES)
    return F.when(F.coalesce(fine, F.lit(False)), F.struct(get("stage", "string").alias("stage"), get("status", "string").alias("status"), get("pct", "double").alias("pct"), get("msg", "string").alias("msg"), get("ts", "double").alias("ts")))


def progress(pct: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(100.0), pct)), 1)


def latest_run(events: DataFrame, marker: Column, order: str, by: list[str]) -> DataFrame:
    """Rows from the last marker of each log on; all of a log without one.

    The last marker is an aggregate that is combined before the shuffle, joined back by log.
    """
    last = events.where(marker).groupBy(*by).agg(F.max(order).alias("__last"))
    return events.join(last, by, "left").where(F.col("__last").isNull() | (F.col(order) >= F.col("__last"))).drop("__last")


def last_per_key(events: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """The last row of each key."""
    return events.groupBy(*keys).agg(F.max_by(F.struct(*columns), order).alias("__r")).select(*keys, "__r.*")


def job_states(events: DataFrame, job: str = "job", order: str = "seq") -> DataFrame:
    """State and error of each job from its latest run: queued, running, done, stopped or error."""
    run = latest_run(events, (F.col("stage") == WHOLE) & (F.col("status") == "running"), order, [job])
    whole = F.col("stage") == WHOLE
    last = F.max_by(F.when(whole & (F.col("status") != "running"), F.col("status")).otherwise("running"), order)
    message = F.max_by(F.when(F.col("status") == "error", F.coalesce("msg", F.concat("stage", F.lit(" failed")))), F.when(F.col("status") == "error", F.col(order)))
    return run.groupBy(job).agg(last.alias("state"), message.alias("__error")).select(job, "state", F.when(F.col("state") == "error", F.col("__error")).alias("error"))


def stage_times(events: DataFrame, keys: list[str], order: str, ts: str, status: str = "status") -> DataFrame:
    """Start and end of each stage: the last change into running, the last terminal event after it."""
    by = Window.partitionBy(*keys).orderBy(order)
    into = (F.col(status) == "running") & ~F.lag(status).over(by).eqNullSafe("running")
    marked = events.withColumn("__start", F.when(into, F.col(ts)))
    out = marked.groupBy(*keys).agg(F.max("__start").alias("started"), F.max(F.when(F.col(status) != "running", F.col(ts))).alias("ended"))
    return out.withColumn("seconds", F.when(F.col("ended") >= F.col("started"), F.col("ended") - F.col("started")))


def peak_concurrency(spans: DataFrame, start: str, end: str, by: list[str] | None = None, chunk: int = 86_400_000_000) -> DataFrame:
    """The most spans open at once, from numeric moments: +1 at each start, -1 at each end, at equal moments together.

    Moments are summed first; levels run within chunks of time, to which the sums of earlier chunks (a row each) are added.
    """
    by = by or []
    steps = spans.select(*by, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(end).alias("at"), F.lit(-1).alias("d")))).alias("__s")).select(*by, "__s.*")
    moments = steps.groupBy(*by, "at").agg(F.sum("d").alias("d")).withColumn("__chunk", F.floor(F.col("at") / chunk))
    level = F.sum("d").over(Window.partitionBy(*by, "__chunk").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    chunks = moments.withColumn("__l", level).groupBy(*by, "__chunk").agg(F.max("__l").alias("__top"), F.sum("d").alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy(*by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1))
    return chunks.withColumn("__b", F.coalesce(before, F.lit(0))).groupBy(*by).agg(F.max(F.col("__b") + F.col("__top")).alias("peak"))


def number_names(df: DataFrame, by: list[str], name: str, order: str) -> DataFrame:
    """name, and name_2, name_3 ... for its repetitions, before any extension."""
    n = F.row_number().over(Window.partitionBy(*by, name).orderBy(order))
    stem, ext = F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 1), F.regexp_extract(name, r"^(.*?)(\.[^.]*)?$", 2)
    return df.withColumn("unique_name", F.when(n == 1, F.col(name)).otherwise(F.concat(stem, F.lit("_"), n.cast("string"), ext)))


def attempts(events: DataFrame, ticket: str, order: str) -> DataFrame:
    """attempt numbers of each ticket."""
    return events.withColumn("attempt", F.row_number().over(Window.partitionBy(ticket).orderBy(order)))


def run_summary(tickets: DataFrame, calls: DataFrame) -> DataFrame:
    """One row of counts and ratios; tickets (ticket, state, attempts), calls (ticket, tokens, ms)."""
    t = tickets.agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("done", "failed", "skipped")), F.count_if((F.col("state") == "done") & (F.col("attempts") == 1)).alias("first_try"))
    c = calls.agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"), F.sum("ms").alias("ms"))
    per = F.greatest(F.lit(1), F.col("done"))
    return t.crossJoin(c).withColumn("first_try_share", F.col("first_try") / per).withColumn("calls_per_done", F.col("calls") / per).withColumn("tokens_per_done", F.col("tokens") / per)


def run_figures(tickets: DataFrame, calls: DataFrame, spans: DataFrame) -> DataFrame:
    """run_summary() with the peak of parallel calls, and the speed-up of the run over one call after the other; spans is (start, end) in milliseconds."""
    wall = spans.agg((F.max("end") - F.min("start")).alias("wall_ms"), F.sum(F.col("end") - F.col("start")).alias("serial_ms"))
    one = run_summary(tickets, calls).crossJoin(F.broadcast(wall)).crossJoin(F.broadcast(peak_concurrency(spans, "start", "end", chunk=3_600_000)))  # one row each
    return one.withColumn("speed_up", speed_up(F.col("serial_ms"), F.col("wall_ms")))


def run_meter(tickets: DataFrame, concurrency: int) -> DataFrame:
    """One row for the head of a run's view: tickets of each state, done of all, running of the slots."""
    counts = [F.count_if(F.col("state") == s).alias(s) for s in ("waiting", "running", "done", "failed", "skipped")]
    t = tickets.agg(F.count("*").alias("tickets"), *counts)
    slots = F.lit(str(concurrency) if concurrency else "-")
    return t.withColumn("progress", F.format_string("%d/%d done", "done", "tickets")).withColumn("agents", F.concat(F.col("running").cast("string"), F.lit("/"), slots))


def speed_up(serial_ms: Column, wall_ms: Column) -> Column:
    """How many times as fast as one after the other, a dash without wall time."""
    return F.when(wall_ms > 0, F.format_string("%.1fx", serial_ms / wall_ms)).otherwise("-")


def decode_speed(calls: DataFrame) -> DataFrame:
    """One row: tokens a second over all calls (tokens, ns)."""
    return calls.agg(F.try_divide(F.sum("tokens"), F.sum("ns") / 1e9).alias("tok_s"))


def part_progress(events: DataFrame, part: str, order: str) -> DataFrame:
    """One row: the mean of the parts' last percentages."""
    return last_per_key(events, [part], order, ["pct"]).agg(F.avg("pct").alias("pct"))


def job_counts(jobs: DataFrame) -> DataFrame:
    """One row: jobs, those that run, and candidates over all."""
    return jobs.agg(F.count("*").alias("jobs"), F.count_if(F.col("state") == "running").alias("running"), F.sum(F.size("candidates")).alias("candidates"))


def log_sections(lines: DataFrame, by: list[str], order: str, line: str = "line") -> DataFrame:
    """(by, sections, filled): headed sections of each log, and its lines that aren't blank."""
    return lines.groupBy(*by).agg(F.count_if(F.col(line).startswith("===== ")).alias("sections"), F.count_if(F.trim(line) != "").alias("filled"))


def last_section(lines: DataFrame, by: list[str], order: str, line: str = "line") -> DataFrame:
    """The lines of each log from its last heading on; all of a log without one."""
    return latest_run(lines, F.col(line).startswith("===== "), order, by)


def stage_states(logs: DataFrame, markers: DataFrame, order: str = "n") -> DataFrame:
    """(job, stage, status, pct, msg): done where a marker says so, else what the last protocol line of the log's last section says, else pending.

    logs is (job, stage, n, line), markers (job, stage).
    """
    parsed = last_section(logs, ["job", "stage"], order).withColumn("e", parse_line(F.col("line"))).where("e is not null")
    last = last_per_key(parsed.select("job", "stage", order, "e.status", "e.pct", "e.msg"), ["job", "stage"], order, ["status", "pct", "msg"])
    known = logs.select("job", "stage").unionByName(markers.select("job", "stage")).distinct()
    rows = known.join(last, ["job", "stage"], "left").join(markers.select("job", "stage", F.lit(True).alias("__done")), ["job", "stage"], "left")
    done = F.coalesce("__done", F.lit(False))
    return rows.select("job", "stage", F.when(done, "done").otherwise(F.coalesce("status", F.lit("pending"))).alias("status"), F.when(done, 100.0).otherwise(F.col("pct")).alias("pct"), "msg")


def newest_lines(lines: DataFrame, by: str, order: str, n: int = 200) -> DataFrame:
    """The last n lines of each log."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    return lines.withColumn("rank", rank).where(F.col("rank") <= n).drop("rank")


def check_failures(checks: DataFrame, ticket: str, order: str, tail: int = 1500) -> DataFrame:
    """(ticket, command, log): the first command of each ticket that failed, with the end of what it said."""
    out = F.coalesce("out", F.lit(""))
    said = F.concat(F.lit("$ "), F.col("command"), F.lit("\n"), F.when(F.length(out) <= tail, out).otherwise(F.right(out, F.lit(tail))), F.lit("\n"))
    return checks.where("not passed").groupBy(ticket).agg(F.min_by(F.struct("command", said.alias("log")), order).alias("__r")).select(ticket, "__r.*")


def fix_ticket(tickets: DataFrame, failed: DataFrame) -> DataFrame:
    """One row for the ticket that mends failed ones (id): their files and reads once each, and all of their acceptance commands, in plan order."""
    involved = tickets.join(failed.select("id"), "id", "left_semi").agg(F.sort_array(F.collect_list(F.struct("ord", "id", "model", "image", "owns", "reads", "acceptance"))).alias("t"))  # a plan's tickets
    flat = lambda c: F.flatten(F.transform("t", lambda x: x[c]))
    first = lambda c, default: F.coalesce(F.try_element_at("t", F.lit(1))[c], F.lit(default)).alias(c)
    ids = F.array_join(F.transform("t", lambda x: x["id"]), ", ")
    return involved.select(F.lit("integrate-fix").alias("id"), F.concat(F.lit("Fix integration of "), ids).alias("title"), first("model", "coder"), first("image", "node"), F.array_distinct(flat("owns")).alias("owns"), F.array_distinct(flat("reads")).alias("reads"), flat("acceptance").alias("acceptance"))


def with_ticket(events: DataFrame, tickets: DataFrame) -> DataFrame:
    """events with their ticket's columns, null where none is known."""
    return events.join(tickets, "ticket", "left")


def first_failure(checks: DataFrame, ticket: str, order: str) -> DataFrame:
    """The first command of each ticket that failed."""
    return checks.where("not passed").groupBy(ticket).agg(F.min_by("command", order).alias("command"))


def replay(events: DataFrame, seen: int, order: str) -> DataFrame:
    """Events that a client which has seen the first `seen` of a log still needs."""
    return events.where(F.col(order) > seen)


def error_message(lines: DataFrame, by: list[str], order: str, line: str = "line", size: int = 400) -> DataFrame:
    """The last unindented line that names an error, else the last line, cut."""
    names = F.col(line).rlike(r"^\S.*(Error|Exception)") | F.col(line).rlike(r"^\S*(Error|Exception)")
    last = F.max_by(F.col(line), F.struct(names, F.col(order)))
    return lines.where(F.trim(line) != "").groupBy(*by).agg(F.substring(last, 1, size).alias("message"))


def segments(lines: DataFrame, by: list[str], order: str, head: Column, line: str = "line", words: int = 200, drop_last: bool = True) -> DataFrame:
    """Articles that begin at head lines and have `words` words; lines before the first head belong to none, the last one stays out."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    numbered = lines.withColumn("segment", F.sum(head.cast("int")).over(w)).where("segment > 0")
    joined = numbered.groupBy(*by, "segment").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, line))), lambda r: r[line]), "\n").alias("text"))
    if drop_last:
        last = F.max("segment").over(Window.partitionBy(*by))
        joined = joined.withColumn("__last", last).where("segment < __last").drop("__last")
    return joined.where(F.size(F.filter(F.split("text", r"\s+"), lambda x: x != "")) >= words)
