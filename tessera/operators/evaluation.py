"""Roll-ups of scores, choice of winners, ranking and weights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import pass_at_k
from ..functions.text import score_shown

#: Groups whose medians are refined together.
GROUPS = 10_000
#: Reasons that say nothing about an answer.
CANNOT_RUN = ("missing_toolchain", "unsupported_language")


def per_problem(results: DataFrame) -> DataFrame:
    """(suite, id, passed, reason) to samples n and passes c of each problem."""
    return results.groupBy("suite", "id").agg(F.count("*").cast("int").alias("n"), F.sum(F.col("passed").cast("int")).cast("int").alias("c"))


def summarize(results: DataFrame, ks: list[int]) -> DataFrame:
    """Per suite of (suite, language, id, passed, reason): language or "mixed", problems, mean pass@k to four places, and how often each status came.

    A suite of which no answer could run is skipped: it has the statuses that say why, and no scores.
    """
    problems = per_problem(results)
    means = problems.groupBy("suite").agg(F.count("*").alias("problems"), *(F.round(F.avg(pass_at_k(F.col("n"), F.col("c"), k)), 4).alias(f"pass_at_{k}") for k in ks))
    counts = status_counts(results).groupBy("suite").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("status", "n")))).alias("status"))  # a few kinds
    spoken = results.groupBy("suite").agg(F.when(F.min("language").eqNullSafe(F.max("language")), F.min("language")).otherwise("mixed").alias("language"))
    reasons = F.map_keys("status")
    skipped = F.when(F.forall(reasons, lambda x: x.isin(*CANNOT_RUN)), F.array_join(reasons, ", "))
    joined = means.join(counts, "suite").join(spoken, "suite").withColumn("skipped", skipped)
    return joined.select("suite", "language", "problems", "status", "skipped", *(F.when(F.col("skipped").isNull(), F.col(f"pass_at_{k}")).alias(f"pass_at_{k}") for k in ks))


def broken_suites(results: DataFrame) -> DataFrame:
    """(suite, answers, could_not_run): totals of the suites with answers that could not run."""
    counts = status_counts(results).groupBy("suite").agg(F.sum("n").alias("answers"), F.sum(F.when(F.col("status").isin(*CANNOT_RUN), F.col("n")).otherwise(0)).alias("could_not_run"))
    return counts.where("could_not_run > 0")


def pass_rate(results: DataFrame) -> DataFrame:
    """One row: the share of programs that passed, to three places; 0 without any."""
    return results.agg(F.coalesce(F.round(F.avg(F.col("passed").cast("int")), 3), F.lit(0.0)).alias("pass_rate"))


def mean_scores(rows: DataFrame) -> DataFrame:
    """One row of rows (agreement, judge): their means to three places; the judge's over what it scored, null if nothing."""
    return rows.agg(F.round(F.avg("agreement"), 3).alias("agreement"), F.round(F.avg("judge"), 3).alias("judge"))


def status_counts(results: DataFrame) -> DataFrame:
    status = F.when(F.col("passed"), "pass").otherwise(F.coalesce(F.nullif("reason", F.lit("")), F.lit("test_failed")))
    return results.groupBy("suite", status.alias("status")).agg(F.count("*").alias("n"))


def macro_mean(suites: DataFrame, column: str = "pass_at_1") -> DataFrame:
    """Unweighted mean over suites of the rounded values."""
    return suites.agg(F.round(F.avg(column), 4).alias(f"mean_{column}"))


def share_of_ref(suites: DataFrame, ref: DataFrame, column: str = "pass_at_1") -> DataFrame:
    """Per suite the share of the reference's score; suites that it lacks or scores 0 on are left out."""
    r = ref.select("suite", F.col(column).alias("__ref")).where("__ref is not null and __ref <> 0")
    return suites.where(F.col(column).isNotNull()).join(r, "suite").select("suite", F.round(F.col(column) / F.col("__ref"), 4).alias("share"))


def ref_shares(suites: DataFrame, ref: DataFrame, column: str = "pass_at_1") -> DataFrame:
    """One row: mean and least of the shares to four places, null without any."""
    return share_of_ref(suites, ref, column).agg(F.round(F.avg("share"), 4).alias("mean"), F.round(F.min("share"), 4).alias("least"))


def first_named(rows: DataFrame, name: str, names: list, winner_: Column | None = None) -> DataFrame:
    """The row whose name comes first in names, else the winner's: at most one."""
    rank = F.array_position(F.array(*map(F.lit, names)), F.col(name))
    rank = F.when(rank > 0, rank)
    if winner_ is not None:
        rank = F.coalesce(rank, F.when(F.col(name) == winner_, F.lit(len(names) + 1)))
    return rows.withColumn("__rank", rank).where("__rank is not null").orderBy("__rank").limit(1).drop("__rank")


def why(candidates: DataFrame, chosen: str, method: str, max_size: float, min_speed: float) -> DataFrame:
    """One row: why a candidate was chosen among (name, ord, score, size_gb, tok_s, meets_target), and which better ones missed the target."""
    what = {"judge": "judge score", "pass_at_1": "pass rate on the code tests"}.get(method, "agreement with the teacher")
    goal = f"target of {max_size:g} GB and {min_speed:g} tokens a second"
    shown = lambda c: score_shown(c, F.lit(method))
    reasons = F.array_compact(F.array(F.when(F.col("size_gb") > max_size, F.format_string("%.1f GB", F.col("size_gb"))), F.when(F.coalesce("tok_s", F.lit(0.0)) < min_speed, F.format_string("%.0f tokens a second", F.coalesce("tok_s", F.lit(0.0))))))
    note = F.when((F.col("name") != chosen) & ~F.col("meets_target"), F.concat("name", F.lit(" scores "), shown(F.col("score")), F.lit(" but misses it ("), F.concat_ws(", ", reasons), F.lit(")")))
    value = F.struct(F.coalesce("score", F.lit(-1.0)), -F.col("ord"))
    best = F.max_by(F.struct("name", "score"), F.when(F.col("meets_target"), value))
    facts = candidates.agg(F.count("*").alias("n"), best.alias("best"), F.array_join(F.transform(F.sort_array(F.collect_list(F.when(note.isNotNull(), F.struct("ord", note.alias("note"))))), lambda x: x["note"]), "; ").alias("notes"))  # a handful
    lead = F.lit(f"best {what} among candidates that meet the {goal}")
    text = F.when(F.col("best").isNull(), f"no candidate met the {goal}, so the best {what} was taken").when((F.col("best.name") == chosen) & (F.col("n") == 1), f"the only candidate, and it meets the {goal}")
    text = text.when(F.col("best.name") == chosen, F.when(F.col("notes") == "", lead).otherwise(F.concat(lead, F.lit("; "), F.col("notes"))))
    return facts.select(text.otherwise(F.concat(F.lit("within 2 points of "), F.col("best.name"), F.lit(" ("), shown(F.col("best.score")), F.lit("), and preferred for its speed"))).alias("why"))


def zipped(left: DataFrame, right: DataFrame, order: str = "ord") -> DataFrame:
    """Rows of both sides at the same place, which both have as a column; rows without a partner go, as the shorter side ends."""
    return left.join(right, order)


def status_listing(api: DataFrame, disk: DataFrame) -> DataFrame:
    """api (job, state, ...) with the state that disk (job, label) tells of jobs that the service only has as queued."""
    told = F.when(F.col("state") == "queued", F.coalesce("label", "state")).otherwise(F.col("state"))
    return api.join(disk.select("job", "label"), "job", "left").withColumn("state", told).drop("label")


def difference(one: DataFrame, two: DataFrame) -> DataFrame:
    """(value, missing_in): values of one column that only one of two frames has, once each."""
    a, b = (df.select(F.col(df.columns[0]).alias("value")).distinct() for df in (one, two))
    return a.exceptAll(b).withColumn("missing_in", F.lit("two")).unionByName(b.exceptAll(a).withColumn("missing_in", F.lit("one")))


def score_method(candidates: DataFrame, by: list[str] | None = None) -> DataFrame:
    """pass@1 if all candidates have it, else the judge's score, else agreement; over all, or for each group."""
    every = lambda c: F.bool_and(F.col(c).isNotNull())
    return candidates.groupBy(*(by or [])).agg(F.when(every("pass_at_1"), "pass_at_1").when(every("judge_score"), "judge_score").otherwise("agreement").alias("method"))


def meets_target(size: Column, speed: Column, max_size: float, min_speed: float) -> Column:
    return (size <= max_size) & (F.coalesce(speed, F.lit(0.0)) >= min_speed)


def missed(size: Column, speed: Column, max_size: float, min_speed: float) -> Column:
    """Why a candidate misses its target."""
    reasons = F.array(F.when(size > max_size, F.lit("too large")), F.when(F.coalesce(speed, F.lit(0.0)) < min_speed, F.lit("too slow")))
    return F.concat_ws(", ", F.array_compact(reasons))


def winner(candidates: DataFrame, score: str, order: str, prefer: Column | None = None, within: float = 0.02) -> DataFrame:
    """The best score among those that meet the target (among all if none does), the first of equals; a preferred one close to it wins."""
    value = F.coalesce(score, F.lit(-1.0))
    known = candidates.agg(F.max("meets_target").alias("__any"), F.max(F.when(F.col("meets_target"), value)).alias("__of_fit"), F.max(value).alias("__of_all"))  # one row
    able = candidates.crossJoin(F.broadcast(known)).where(F.col("meets_target") | ~F.col("__any")).withColumn("__value", value)
    best = F.when(F.col("__any"), F.col("__of_fit")).otherwise(F.col("__of_all"))
    close = (prefer if prefer is not None else F.lit(False)) & (F.col("__value") >= best - within)
    return able.withColumn("__close", close).orderBy(F.desc("__close"), F.desc("__value"), order).limit(1).select(*candidates.columns)


def top_k(df: DataFrame, by: str, order: list, k: int | Column) -> DataFrame:
    """The first k rows of each group; a partial top-k runs before the shuffle (window group limit)."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def keep_count(experts: Column, sparsity: float, at_least: int) -> Column:
    """How many are kept; halves round to even."""
    return F.greatest(F.lit(at_least), (experts - F.bround(experts * F.lit(sparsity))).cast("int"))


def saliency(routed: DataFrame, keys: list[str], weight: str, norm: str) -> DataFrame:
    """Mean of weight * norm of what reached each expert, and how often."""
    return routed.groupBy(*keys).agg((F.sum(F.col(weight) * F.col(norm)) / F.greatest(F.count("*"), F.lit(1))).alias("saliency"), F.count("*").alias("freq"))


def fill_layers(means: DataFrame, layers: DataFrame, key: str, value: str) -> DataFrame:
    """A value for every layer; missing ones get the mean of the others."""
    full = layers.join(means, key, "left")
    total = means.agg(F.avg(value).alias("__mean"))  # one row
    return full.crossJoin(F.broadcast(total)).withColumn(value, F.coalesce(value, "__mean")).drop("__mean")


def normalised(df: DataFrame, value: str, into: str) -> DataFrame:
    """df with value scaled to mean 1; what is not finite or not positive counts as the mean. The mean is one row."""
    x = F.col(value)
    good = F.when(~F.isnan(x) & (x > 0) & (x < float("inf")), x)
    mean = F.coalesce("__mean", F.lit(1.0))
    return df.crossJoin(F.broadcast(df.agg(F.avg(good).alias("__mean")))).withColumn(into, F.coalesce(good, mean) / mean).drop("__mean")


def sensitivities(layers: DataFrame, importance: str, energy: str, power: float = 0.25, low: float = 0.25, high: float = 4.0, weight: float = 1.0) -> DataFrame:
    """Product of both signals, each scaled to mean 1, rescaled and clipped."""
    one = normalised(normalised(layers, importance, "__i"), energy, "__e")
    raw = normalised(one.withColumn("__raw", F.col("__i") * F.pow("__e", F.lit(power))), "__raw", "__w")
    return raw.withColumn("sensitivity", F.lit(weight) * F.least(F.lit(high), F.greatest(F.lit(low), "__w"))).drop("__i", "__e", "__raw", "__w")


def moving_loss(df: DataFrame, by: str, order: str, value: str, keep: float = 0.9, chunk: int = 10_000) -> DataFrame:
    """Exponential moving average in order of an integer, started with the first value.

    Its weights are powers of `keep` by how many steps follow, so it is a sum: places are counted within stretches of
    `chunk` orders and shifted by the sizes of the stretches after them, and no key's steps come together.
    """
    first = df.groupBy(by).agg(F.min(order).alias("__first"))
    rows = df.select(by, order, value).join(first, by).withColumn("__chunk", F.floor(F.col(order) / chunk))
    sizes = rows.groupBy(by, "__chunk").agg(F.count("*").alias("__n"))
    later = F.coalesce(F.sum("__n").over(Window.partitionBy(by).orderBy(F.desc("__chunk")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy(by, "__chunk").orderBy(F.desc(order))) - 1
    own = F.when(F.col(order) == F.col("__first"), F.lit(1.0)).otherwise(1 - keep)
    folded = rows.withColumn("__w", own * F.pow(F.lit(keep), place)).groupBy(by, "__chunk").agg(F.sum(F.col(value) * F.col("__w")).alias("__x"))
    parts = folded.join(sizes.withColumn("__later", later), [by, "__chunk"])
    return parts.groupBy(by).agg(F.sum(F.col("__x") * F.pow(F.lit(keep), "__later")).alias("ema"))


def exact_median(df: DataFrame, by: str, value: str, bins: int = 4096) -> DataFrame:
    """(by, median) of the non-null values of each group, interpolated as usual.

    Histograms of a group's range are refined until the bins of both middle ranks hold one value each, so only counts
    are gathered; each round is an aggregation that combines before its shuffle. The ranges, two rows a group, are on
    the driver; with more than GROUPS groups the built-in median takes over.
    """
    spark = df.sparkSession
    v = df.select(by, F.col(value).cast("double").alias("__v")).where("__v is not null")
    state = v.groupBy(by).agg(F.count("*").alias("n"), F.min("__v").alias("lo"), F.max("__v").alias("hi"))
    if len(state.select(by).head(GROUPS + 1)) > GROUPS:
        return v.groupBy(by).agg(F.median("__v").alias("median"))
    ranks = F.array(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1)
    state = state.select(by, F.explode(F.array_distinct(ranks)).alias("rank"), "lo", "hi", F.lit(0).cast("long").alias("below"))
    rows = {tuple(r[:2]): r for r in state.collect()}  # two rows a group
    while any(r["lo"] < r["hi"] for r in rows.values()):
        state = spark.createDataFrame([tuple(r) for r in rows.values()], state.schema)
        width = (F.col("hi") - F.col("lo")) / bins
        bin_ = F.least(F.floor((F.col("__v") - F.col("lo")) / width), F.lit(bins - 1))
        inside = v.join(F.broadcast(state), by).where("lo < hi and __v between lo and hi").groupBy(by, "rank", "below", bin_.alias("b"))
        counts = inside.agg(F.count("*").alias("c"), F.min("__v").alias("l"), F.max("__v").alias("h"))
        to = F.sum("c").over(Window.partitionBy(by, "rank").orderBy("b")) + F.col("below")
        found = counts.withColumn("to", to).where((F.col("to") >= F.col("rank")) & (F.col("to") - F.col("c") < F.col("rank")))
        for r in found.select(by, "rank", F.col("l").alias("lo"), F.col("h").alias("hi"), (F.col("to") - F.col("c")).alias("below")).collect():
            rows[tuple(r[:2])] = r
    state = spark.createDataFrame([tuple(r) for r in rows.values()], state.schema)
    return state.groupBy(by).agg(F.avg("lo").alias("median"))


def shares(df: DataFrame, value: str, n: int = 4) -> DataFrame:
    """The n most frequent values with their counts and shares."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("__total"))
    return counts.orderBy(F.desc("n"), value).limit(n).crossJoin(F.broadcast(total)).select(value, "n", (F.col("n") / F.col("__total")).alias("share"))


def matrix(df: DataFrame, row: str, column: str, values: list, cell: Column) -> DataFrame:
    """A row for each candidate and a column for each suite; missing cells are null."""
    return df.groupBy(row).pivot(column, values).agg(cell)


def field_diff(df: DataFrame, one: str, two: str, key: str) -> DataFrame:
    """For each field of the first JSON object whether the second has the same value."""
    entries = lambda c: F.try_variant_get(F.try_parse_json(c), "$", "map<string,variant>")
    rows = df.select(key, F.explode(F.map_entries(entries(F.col(one)))).alias("e"), entries(F.col(two)).alias("__other"))
    a, b = F.to_json(F.col("e.value")), F.to_json(F.element_at("__other", F.col("e.key")))
    return rows.select(key, F.col("e.key").alias("field"), a.alias("expected"), b.alias("found"), F.coalesce(a == b, F.lit(False)).alias("same"))


def overlay(*layers: Column) -> Column:
    """Maps laid over each other; the right-most value of a key wins."""
    return reduce(lambda a, b: F.map_concat(F.map_filter(a, lambda k, v: ~F.coalesce(F.map_contains_key(b, k), F.lit(False))), b), layers)


def model_route(requests: DataFrame, routes: DataFrame, name: str, default: str) -> DataFrame:
    """The route of a model's name: exact, without its @version, or the default."""
    r = routes.select(F.col("name").alias("__n"), F.col("target").alias("__t"))
    bare = F.regexp_replace(F.col(name), "@.*$", "")
    exact = requests.join(r, F.col(name) == F.col("__n"), "left").withColumnRenamed("__t", "__exact").drop("__n")
    both = exact.join(r, bare == F.col("__n"), "left").drop("__n")
    return both.withColumn("target", F.coalesce("__exact", "__t", F.lit(default))).drop("__exact", "__t")
