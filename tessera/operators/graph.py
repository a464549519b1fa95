"""Graphs of tickets: closure, cycles, conflicts, propagation, order and plan checks.

Plans are tables (id, priority, depends_on array<string>, owns array<string>, ...). Closures are
iterative distinct joins, so diamonds don't multiply rows, and each round is a join on the dependency;
nothing but a bounded plan is ever ordered on the driver (topological_order).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import glob_pattern, safe_path

#: Fixed values of tickets.
ROLES = ("architect", "scaffold", "implement", "test", "review", "integrate")
IMAGES = ("node", "python", "c")
TICKET_ID = "^[A-Za-z0-9][A-Za-z0-9._-]{0,63}$"


def edges(tickets: DataFrame) -> DataFrame:
    return tickets.select("id", F.explode("depends_on").alias("dep")).distinct()


def _cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint, or keep the rows where no folder for one is set (a single machine)."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.persist()


def ancestors(edge: DataFrame) -> DataFrame:
    """(id, anc): everything an id depends on, directly or not. Each round doubles the path length and cuts the lineage, until none is new."""
    reach = _cut(edge.select("id", F.col("dep").alias("anc")).distinct())
    known = reach.count()
    while True:
        step = reach.select(F.col("id").alias("__mid"), F.col("anc").alias("__far"))
        reach = _cut(reach.unionByName(reach.join(step, F.col("anc") == F.col("__mid")).select("id", F.col("__far").alias("anc"))).distinct())
        if (grown := reach.count()) == known:
            return reach
        known = grown


def ancestors_sql(view: str) -> str:
    """As SQL, for acyclic graphs of bounded depth: UNION (distinct) recursion over (id, dep)."""
    return f"WITH RECURSIVE r(id, anc) AS (SELECT id, dep FROM {view} UNION ALL SELECT r.id, e.dep FROM r JOIN {view} e ON r.anc = e.id) SELECT DISTINCT id, anc FROM r"


def in_cycles(closure: DataFrame) -> DataFrame:
    """Ids that depend on themselves."""
    return closure.where("id = anc").select("id").distinct()


def distances(edge: DataFrame) -> DataFrame:
    """(id, anc, d): how many steps each id is from what it depends on, at least. Each round doubles the path length."""
    reach = _cut(edge.select("id", F.col("dep").alias("anc"), F.lit(1).cast("long").alias("d")).distinct())
    known = reach.agg(F.count("*"), F.sum("d")).first()
    while True:
        step = reach.select(F.col("id").alias("anc"), F.col("anc").alias("__far"), F.col("d").alias("__d"))
        longer = reach.join(step, "anc").select("id", F.col("__far").alias("anc"), (F.col("d") + F.col("__d")).alias("d"))
        reach = _cut(reach.unionByName(longer).groupBy("id", "anc").agg(F.min("d").alias("d")))
        if (grown := reach.agg(F.count("*"), F.sum("d")).first()) == known:
            return reach
        known = grown


def cycle_paths(edge: DataFrame) -> DataFrame:
    """A path id -> ... -> id for each strongly connected part of the graph: a shortest cycle through its smallest id, the least of equals.

    Distances tell which ids are on such a cycle, and where; each has a least successor, and stretches of the path are
    joined end to end, so a cycle of any length takes a logarithmic number of rounds.
    """
    d = distances(edge)
    back = d.select(F.col("anc").alias("id"), F.col("id").alias("anc"), F.col("d").alias("home"))
    both = d.join(back, ["id", "anc"])  # ids that reach each other
    first = both.groupBy("id").agg(F.min("anc").alias("start")).where("id = start").select("start")
    whole = d.where("id = anc").select(F.col("id").alias("start"), F.col("d").alias("size"))
    on = both.withColumnRenamed("id", "start").join(first, "start").join(whole, "start")
    on = on.where("anc <> start and d + home = size").select("start", F.col("anc").alias("id"), F.col("d").alias("at"), "size")
    on = _cut(on.unionByName(first.join(whole, "start").select("start", F.col("start").alias("id"), F.lit(0).cast("long").alias("at"), "size")))
    after = on.select("start", F.col("id").alias("to"), F.when(F.col("at") == 0, F.col("size")).otherwise(F.col("at")).alias("end"))
    e = edge.select("id", F.col("dep").alias("to")).distinct()
    part = on.join(e, "id").join(after, ["start", "to"]).where("end = at + 1").groupBy("start", "id", "at", "size").agg(F.min("to").alias("to"))
    part = _cut(part.select("start", "id", "at", "size", "to", (F.col("at") + 1).alias("end"), F.array("to").alias("path")))
    while not part.where("at = 0 and end < size").isEmpty():
        rest = part.select("start", F.col("at").alias("end"), F.col("id").alias("to"), F.col("to").alias("__to"), F.col("end").alias("__end"), F.col("path").alias("__path"))
        joined = part.join(rest, ["start", "to", "end"], "left")
        part = _cut(joined.select("start", "id", "at", "size", F.coalesce("__to", "to").alias("to"), F.coalesce("__end", "end").alias("end"), F.when(F.col("__path").isNull(), F.col("path")).otherwise(F.concat("path", "__path")).alias("path")))
    return part.where("at = 0").select(F.concat(F.array("start"), "path").alias("path"))


def unknown_dependencies(tickets: DataFrame) -> DataFrame:
    return edges(tickets).join(tickets.select(F.col("id").alias("dep")), "dep", "left_anti").select("id", "dep")


def ownership_conflicts(owned: DataFrame, closure: DataFrame) -> DataFrame:
    """(a, b, shared): pairs a < b that own a file in common while neither depends on the other; owned is (id, path).

    An equi-join on the file: pairs only arise where there is a conflict to report.
    """
    left, right = owned.select(F.col("id").alias("a"), "path").distinct(), owned.select(F.col("id").alias("b"), "path").distinct()
    pairs = left.join(right, "path").where("a < b").groupBy("a", "b").agg(F.concat_ws(", ", F.sort_array(F.collect_set("path"))).alias("shared"))
    for one, two in (("a", "b"), ("b", "a")):
        known = closure.select(F.col("id").alias(one), F.col("anc").alias(two))
        pairs = pairs.join(known, ["a", "b"], "left_anti")
    return pairs.select("a", "b", "shared")


def skipped(closure: DataFrame, failed: DataFrame) -> DataFrame:
    """Ids that depend on one that failed."""
    return closure.join(failed.select(F.col("id").alias("anc")), "anc", "left_semi").select("id").distinct().join(failed.select("id"), "id", "left_anti")


def ready(tickets: DataFrame, states: DataFrame, slots: int) -> DataFrame:
    """Waiting tickets whose dependencies are done and whose files no running one owns: the first by (priority, id), up to the free slots.

    Of those that share a file among themselves the first is taken.
    """
    t = tickets.join(states, "id")
    done = states.where("state = 'done'").select(F.col("id").alias("dep"))
    blocked = edges(t.where("state = 'waiting'")).join(done, "dep", "left_anti").select("id").distinct()
    busy = t.where("state = 'running'").select(F.explode("owns").alias("path")).distinct()
    free = t.where("state = 'waiting'").join(blocked, "id", "left_anti")
    held = free.select("id", F.explode("owns").alias("path")).join(busy, "path", "left_semi").select("id").distinct()
    free = free.join(held, "id", "left_anti")
    paths = free.select("id", "priority", F.explode("owns").alias("path"))
    first = paths.groupBy("path").agg(F.min(F.struct("priority", "id")).alias("__first"))
    late = paths.join(first, "path").where("struct(priority, id) <> __first").select("id").distinct()
    running = states.where("state = 'running'").count()
    return free.join(late, "id", "left_anti").orderBy("priority", "id").limit(max(0, slots - running)).select("id", "priority")


def topological_order(rows: list[tuple[str, int, list[str]]]) -> list[str]:
    """Ids so that each comes after what it depends on; always the eligible one of least (priority, id).

    A plan is bounded, so this runs on the driver: a heap of eligible ids, with the counts of open dependencies.
    """
    import heapq

    priority = {i: p for i, p, _ in rows}
    open_ = {i: len(set(d)) for i, _, d in rows}
    users: dict[str, list[str]] = {}
    for i, _, deps in rows:
        for d in set(deps):
            users.setdefault(d, []).append(i)
    heap = [(priority[i], i) for i, n in open_.items() if not n]
    heapq.heapify(heap)
    out = []
    while heap:
        _, i = heapq.heappop(heap)
        out.append(i)
        for u in users.get(i, []):
            open_[u] -= 1
            if not open_[u]:
                heapq.heappush(heap, (priority[u], u))
    if len(out) < len(rows):
        raise ValueError("dependency cycle")
    return out


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) of every rule a row breaks; rules are conditions that must hold, and null breaks them."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))
    return df.select(F.col(key), F.explode(broken).alias("rule"))


def ticket_rules() -> dict[str, Column]:
    owns = F.col("owns")
    return {
        "id": F.col("id").rlike(TICKET_ID), "role": F.col("role").isin(*ROLES), "image": F.col("image").isin(*IMAGES), "priority": F.col("priority").between(1, 5),
        "owns_empty": F.col("role").isin("review", "architect") | (F.size(owns) > 0), "owns_path": F.forall(owns, safe_path),
        "attempts": F.col("budget.attempts") >= 1, "max_tokens": F.col("budget.max_tokens") >= 1,
    }


def task_rules() -> dict[str, Column]:
    """What a task specification must satisfy."""
    from ..functions.text import LANGUAGES

    code = F.col("task_type") == "code"
    filled = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) != ""
    return {
        "version": F.col("version") == 1, "task_name": filled("task_name"), "description": filled("description"), "task_type": F.col("task_type").isin("text", "code"),
        "seed_examples": F.size("seed_examples").between(3, 50), "max_size": F.col("target.max_size_gb").between(1, 64), "language_of_code": ~code | F.coalesce(F.col("language").isin(*LANGUAGES), F.lit(False)), "language_of_text": code | F.col("language").isNull(),
        "tests": ~code | F.forall("seed_examples", lambda e: F.trim(F.coalesce(e["tests"], F.lit(""))) != ""),
    }


def plan_violations(tickets: DataFrame) -> DataFrame:
    """All problems of a plan as (id, rule): fields, repeated ids, unknown and own dependencies, cycles, conflicts."""
    found = violations(tickets, "id", ticket_rules())
    found = found.unionByName(tickets.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate_id").alias("rule")))
    found = found.unionByName(unknown_dependencies(tickets).select("id", F.lit("unknown_dependency").alias("rule")).distinct())
    closure = ancestors(edges(tickets))
    found = found.unionByName(in_cycles(closure).select("id", F.lit("cycle").alias("rule")))
    clash = ownership_conflicts(tickets.select("id", F.explode("owns").alias("path")), closure)
    return found.unionByName(clash.select(F.col("a").alias("id"), F.lit("shared_file").alias("rule")).distinct())


def glob_matches(patterns: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path) of the files that a ticket's read patterns match, in the pattern's folder only.

    The part of a pattern before its first wildcard is a prefix of what it matches: patterns and files
    meet on their first folder, and those that begin with a wildcard on a key of their own.
    """
    p = patterns.withColumn("__re", glob_pattern(F.col("pattern"))).withColumn("__top", F.when(F.regexp_extract("pattern", "^[^*?/]+/", 0) != "", F.regexp_extract("pattern", "^[^*?/]+/", 0)).otherwise(""))
    f = files.withColumn("__tops", F.array_distinct(F.array(F.lit(""), F.regexp_extract("path", "^[^/]+/", 0)))).select("path", F.explode("__tops").alias("__top"))
    return p.join(f, "__top").where("path rlike __re").select("id", "path").distinct()


def context_files(tickets: DataFrame, files: DataFrame, interfaces: DataFrame) -> DataFrame:
    """(id, kind, path): what a ticket's prompt shows: interfaces and files it reads (its reads, matched), neither of which it owns, no file twice."""
    owned = tickets.select("id", F.explode("owns").alias("path"))
    shared = tickets.select("id").crossJoin(F.broadcast(interfaces.select("path"))).join(owned, ["id", "path"], "left_anti")  # a plan's interfaces
    reads = glob_matches(tickets.select("id", F.explode("reads").alias("pattern")), files).join(owned, ["id", "path"], "left_anti").join(shared, ["id", "path"], "left_anti")
    return shared.select("id", F.lit("interface").alias("kind"), "path").unionByName(reads.select("id", F.lit("read").alias("kind"), "path")).unionByName(owned.select("id", F.lit("owned").alias("kind"), "path"))


def prompt_pack(tickets: DataFrame, shown: DataFrame, contents: DataFrame) -> DataFrame:
    """(id, prompt): a ticket's text with its files: shown is of context_files(), contents (path, text)."""
    from ..functions.text import file_block

    blocks = shown.join(contents, "path", "left").groupBy("id").agg(*(F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct("path", file_block(F.col("path"), F.col("text")).alias("b"))))), lambda x: x["b"]), "\n").alias(kind) for kind in ("interface", "read", "owned")))  # a prompt's files
    part = lambda title, c: F.concat(F.lit(f"## {title}\n"), F.coalesce(F.col(c), F.lit("")))
    head = F.concat_ws("\n", F.concat(F.lit("Ticket: "), F.col("id")), F.concat(F.lit("Title: "), F.col("title")), F.concat(F.lit("Role: "), F.col("role")), F.lit(""), F.col("context"), F.lit(""), F.concat(F.lit("Files to write, each in full: "), F.array_join("owns", ", ")), F.concat(F.lit("Done when these commands pass: "), F.array_join("acceptance", " ; ")))
    return tickets.join(blocks, "id", "left").select("id", F.concat_ws("\n\n", head, part("Interfaces", "interface"), part("Files to read", "read"), part("Files as they are now", "owned")).alias("prompt"))


def architecture(components: DataFrame, decisions: DataFrame, summary: str, data_flow: str) -> DataFrame:
    """One row with the column `markdown`: components (ord, name, language, path, responsibility, interfaces array<struct<path,description>>) and decisions (ord, decision, why) as a document."""
    listed = lambda df, line: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), "\n")
    row = F.concat(F.lit("| "), F.concat_ws(" | ", "name", "language", F.concat(F.lit("`"), F.col("path"), F.lit("`")), "responsibility"), F.lit(" |"))
    parts = F.array_join(F.transform("interfaces", lambda i: F.concat(F.lit("- `"), i["path"], F.lit("` ("), F.col("name"), F.lit("): "), i["description"])), "\n")
    c = components.agg(listed(components, row).alias("rows"), listed(components, F.nullif(parts, F.lit(""))).alias("uses"))  # a design's parts
    d = decisions.agg(listed(decisions, F.concat(F.lit("- **"), F.col("decision"), F.lit(".** "), F.col("why"))).alias("why"))
    text = F.concat(
        F.lit(f"# Architecture\n\n{summary}\n\n## Components\n\n| Component | Language | Path | Responsibility |\n|---|---|---|---|\n"), F.col("rows"), F.lit("\n\n## Interfaces\n\n"), F.col("uses"),
        F.lit(f"\n\n## Data flow\n\n{data_flow}\n\n## Decisions\n\n"), F.col("why"), F.lit("\n"),
    )
    return c.crossJoin(d).select(text.alias("markdown"))


def merge_plan(rows: list[tuple[str, int, list[str]]], failed: set[str]) -> list[tuple[str, bool]]:
    """(id, whether it is checked again) in the order in which finished tickets are merged: those that failed, and what depends on them, are."""
    deps = {i: d for i, _, d in rows}
    again: set[str] = set()
    out = []
    for i in topological_order(rows):
        if i in failed or again.intersection(deps[i]):
            again.add(i)
        out.append((i, i in again))
    return out


def refused_paths(written: Column, owned: Column) -> Column:
    """Files an attempt wrote without owning them."""
    return F.array_except(F.map_keys(written), owned)
