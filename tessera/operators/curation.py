"""Deduplication, splits, answer filters and chat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import jsontext, text

#: Longest input that may claim a key.
LONGEST_INPUT = 6000


def first_wins(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The first row of each key by `order`; what is combined before the shuffle is one row a key."""
    first = df.withColumn("__key", key)
    least = first.groupBy("__key").agg(F.min_by(F.struct(*df.columns), order).alias("__row"))
    return least.select("__row.*")


def first_keys(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order) of the first row of each key; both are plain columns, so a hash aggregation of fixed width does it."""
    return df.groupBy(key).agg(F.min(order).alias(order))


def dedupe_inputs(df: DataFrame, column: str = "text", order: str = "doc_id", longest: int = LONGEST_INPUT, tests: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """Rows up to `longest` characters (with their tests), the first of each normalised key, which comes with them as norm_key; longer rows never claim one.

    keep names the columns wanted, all by default. `order` is one of them and tells rows apart: the winners are found on
    keys alone, and the other columns join them by it.
    """
    size = F.length(column) + (F.coalesce(F.length(tests), F.lit(0)) if tests else F.lit(0))
    keyed = df.where(size <= longest).withColumn("norm_key", text.norm_key(F.col(column)))
    winners = first_keys(keyed, "norm_key", order)
    others = [c for c in (keep or df.columns) if c != order]
    return winners.join(df.where(size <= longest).select(order, *others), order) if others else winners


def usable_inputs(df: DataFrame, code: bool) -> DataFrame:
    """Stored inputs that can be used again: those of code tasks need their tests."""
    return df.where(F.coalesce("tests", F.lit("")) != "") if code else df


def with_tests_of(answers: DataFrame, inputs: DataFrame) -> DataFrame:
    """answers (input, ...) with the tests of their input; inputs (input, tests) have each input once."""
    return answers.join(inputs.select("input", "tests"), "input")


def with_provenance(inputs: DataFrame, external: DataFrame) -> DataFrame:
    """All inputs, and whether they come from outside."""
    return inputs.withColumn("external", F.lit(False)).unionByName(external.withColumn("external", F.lit(True)))


def gather_inputs(write, seeds: DataFrame, rows: int, held_out: int, rounds: int = 6, column: str = "input"):
    """Ask write(round, how many are wanted) for inputs until there are 1.3 times what is needed, a round adds none, or the rounds are over.

    New inputs are those whose normalised key is neither a seed's nor an earlier round's; the first of equals stays.
    write() gives (ord, column, ...) with ascending ord; what is kept so far is checkpointed by each round. Returns
    (inputs, rounds taken).
    """
    target, tries = overshoot(rows, held_out, rounds)
    kept, have, taken = None, 0, 0
    for taken in (t + 1 for t in tries):
        if have >= target:
            return kept.orderBy("ord").limit(target), taken - 1
        known = seeds.select(column) if kept is None else seeds.select(column).unionByName(kept.select(column))
        fresh = unseen(dedupe_inputs(write(taken, target - have), column, "ord"), F.col("norm_key"), known, text.norm_key(F.col(column))).drop("norm_key")
        fresh = fresh.checkpoint() if fresh.sparkSession.sparkContext.getCheckpointDir() else fresh
        added = fresh.count()
        kept, have = fresh if kept is None else kept.unionByName(fresh), have + added
        if not added:
            break
    return kept.orderBy("ord").limit(target), taken


def seed_gate(results: DataFrame, order: str = "ord") -> None:
    """Raise with the first seed whose answer fails its own tests: results (ord, passed, reason, output)."""
    bad = results.where("not passed")
    first = bad.orderBy(order).first()
    if first is not None:
        raise ValueError(f"{bad.count()} seed examples fail their own tests; seed {first[order]}: {first['reason']}\n{first['output']}")


def statistics(df: DataFrame, name: str, reason: str = "reason"):
    """(df, observation): counts of all, kept and dropped rows, told once df has been written; a row is kept if its reason is empty."""
    from pyspark.sql import Observation

    seen = Observation(name)
    kept = F.coalesce(F.col(reason), F.lit("")) == ""
    return df.observe(seen, F.count("*").alias("rows"), F.count_if(kept).alias("kept"), F.count_if(~kept).alias("dropped")), seen


def stats_document(checked: DataFrame, facts: dict, reason: str = "reason") -> DataFrame:
    """One row with the column `stats`: how many answers were kept, how many dropped for each reason, and the facts given."""
    by = checked.groupBy(F.coalesce(reason, F.lit("")).alias("r")).agg(F.count("*").alias("n"))
    one = by.agg(F.coalesce(F.sum(F.when(F.col("r") == "", F.col("n"))), F.lit(0)).alias("answered"), F.map_from_entries(F.sort_array(F.collect_list(F.when(F.col("r") != "", F.struct("r", "n"))))).alias("dropped"))  # a few reasons
    return one.select(F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in facts.items()), "answered", "dropped")).alias("stats"))


def dry_replies(prompts: DataFrame, key: str, seeds: list[dict], seed: str, code: bool = False) -> DataFrame:
    """prompts with text and finished as a stand-in for a model gives them: seed answers, a few of them broken, wrong or cut off.

    What a prompt gets depends on the seed and its key alone: a share between 0 and 1 from their md5.
    """
    share = F.conv(F.substring(seeded(seed, key), 1, 8), 16, 10).cast("double") / float(1 << 32)
    answers = F.array(*(F.lit(e["output"]) for e in seeds))
    pick = (F.pmod(F.xxhash64(key), F.lit(len(seeds))) + 1).cast("int")
    own, other = F.element_at(answers, pick), F.element_at(answers, (F.pmod(pick, F.lit(len(seeds))) + 1).cast("int"))
    fenced = F.concat(F.lit("Here is the code:\n```\n"), own, F.lit("\n```"))
    said = F.when(share < 0.05, "{broken").when(share < 0.15, other).otherwise(fenced) if code else F.when(share < 0.03, "{broken").otherwise(own)
    return prompts.withColumn("text", said).withColumn("finished", F.lit(True) if code else share < 0.99)


def cut_rows(tokenised: DataFrame, max_len: int, ids: str = "input_ids") -> DataFrame:
    """One row: how many rows there are, and how many reach max_len."""
    return tokenised.agg(F.count("*").alias("rows"), F.count_if(F.size(ids) >= max_len).alias("n_cut"))


def unseen(df: DataFrame, key: Column, seen: DataFrame, seen_key: Column) -> DataFrame:
    """Rows whose key is not among the seen ones."""
    known = seen.select(seen_key.alias("__key")).distinct()
    return df.withColumn("__key", key).join(known, "__key", "left_anti").drop("__key")


def ordered_distinct(df: DataFrame, value: str, order: str) -> DataFrame:
    return df.groupBy(value).agg(F.min(order).alias("first_seen")).orderBy("first_seen")


def seeded(seed: str, key: str) -> Column:
    """An order that looks random and is the same in every engine: md5 of seed and key."""
    return F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary"))


def split_sizes(rows: int, held_out: int, external: int = 0) -> int:
    """Held-out rows: external tests if there are half as many as asked for, else at most a fifth of the rows."""
    return external if external >= held_out / 2 and external else min(held_out, rows // 5)


def hash_split(df: DataFrame, key: str, seed: str, held_out: int, generate: int, by: list[str] | None = None) -> DataFrame:
    """df with part: the first rows in seeded order are held out, the next are for training, the rest unused; per group if `by`."""
    by = by or []
    ranked = seeded_rank(df, key, seed, by)
    held = F.least(F.lit(held_out), F.floor(F.col("__total") / 5))
    part = F.when(F.col("__rank") <= held, "heldout").when(F.col("__rank") <= held + generate, "train").otherwise("unused")
    return ranked.withColumn("part", part).drop("__rank", "__total")


def seeded_rank(df: DataFrame, key: str, seed: str, by: list[str], digits: int = 2) -> DataFrame:
    """df with __rank in seeded order within each group, and the group's __total.

    The first digits of the hash cut even a group with a large share of all rows into parts that keep the
    order: ranks are counted within the parts and shifted by the sizes of those before.
    """
    coded = df.withColumn("__code", seeded(seed, key)).withColumn("__part", F.substring("__code", 1, digits))
    sizes = coded.groupBy(*by, "__part").agg(F.count("*").alias("__n"))
    group = Window.partitionBy(*by)
    before = F.sum("__n").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.withColumn("__before", F.coalesce(before, F.lit(0))).withColumn("__total", F.sum("__n").over(group)).drop("__n")
    inner = F.row_number().over(Window.partitionBy(*by, "__part").orderBy("__code", key))
    return coded.join(sizes, [*by, "__part"]).withColumn("__rank", F.col("__before") + inner).drop("__code", "__part", "__before")


def oversample(train: DataFrame, seeds: DataFrame, times: int = 2) -> DataFrame:
    """train and every seed `times` over."""
    copies = seeds.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("__copy")
    return train.unionByName(copies, allowMissingColumns=True)


def few_shot(df: DataFrame, by: str, key: str, seed: str, k: int = 3) -> DataFrame:
    """k rows of each group in seeded order."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(seeded(seed, key), key))
    return df.withColumn("shot", rank).where(F.col("shot") <= k)


def overshoot(rows: int, held_out: int, rounds: int = 6):
    """(wanted rows, round numbers): ask for 1.3 times what is needed, in six rounds at most; the caller stops when one adds none."""
    return int((rows + held_out) * 1.3), range(rounds)


def check_answer(answer: Column, finished: Column, want_json: Column, want_code: Column) -> Column:
    """struct(answer, reason): cut off, empty or not JSON, in this order; JSON amid other text is salvaged."""
    body = F.when(want_code, text.code_of(answer)).otherwise(text.clean(answer))
    saved = jsontext.salvage(body)
    valid, rescued = F.try_parse_json(body).isNotNull(), F.try_parse_json(saved).isNotNull()
    reason = F.when(~finished, "truncated").when(F.coalesce(body, F.lit("")) == "", "empty").when(want_json & ~valid & ~F.coalesce(rescued, F.lit(False)), "invalid_json").otherwise("")
    return F.struct(F.when(reason == "", F.when(want_json & ~valid, saved).otherwise(body)).alias("answer"), reason.alias("reason"))


def drop_counts(df: DataFrame, reason: str = "reason") -> DataFrame:
    return df.groupBy(reason).agg(F.count("*").alias("n"))


def to_messages(columns: list[str]) -> Column:
    """messages of a loosely shaped row: of `messages` those with content, two at least and the last the assistant's; else question and answer."""
    turn = lambda role, c: F.struct(F.lit(role).alias("role"), c.cast("string").alias("content"))
    kind = "array<struct<role:string,content:string>>"
    out = F.lit(None).cast(kind)
    system = F.col("system") if "system" in columns else F.lit(None).cast("string")
    for ask, reply in (("question", "answer"), ("instruction", "output"), ("input", "output"), ("prompt", "response")):
        if ask in columns and reply in columns:
            pair = F.array(turn("user", F.col(ask)), turn("assistant", F.col(reply)))
            full = F.when(F.coalesce(system, F.lit("")) != "", F.concat(F.array(turn("system", system)), pair)).otherwise(pair)
            out = F.when(F.col(ask).isNotNull() & F.col(reply).isNotNull(), full.cast(kind)).otherwise(out)
    if "messages" in columns:
        kept = F.filter(F.col("messages"), lambda m: F.coalesce(m["content"], F.lit("")) != "").cast(kind)
        fine = (F.size(kept) >= 2) & (F.element_at(kept, -1)["role"] == "assistant")
        out = F.when(F.col("messages").isNotNull(), F.when(fine, kept)).otherwise(out)
    return out


def chat_rows(turns: DataFrame, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """One row a conversation with its messages in order."""
    rows = turns.groupBy(conv).agg(F.sort_array(F.collect_list(F.struct(order, "role", "text"))).alias("__m"))
    return rows.select(conv, F.transform("__m", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"))


def prompt_response_pairs(turns: DataFrame, conv: str = "conv_id", order: str = "turn") -> DataFrame:
    """Each user turn with the assistant turn right after it."""
    by = Window.partitionBy(conv).orderBy(order)
    pairs = turns.withColumn("next_role", F.lead("role").over(by)).withColumn("response", F.lead("text").over(by))
    return pairs.where("role = 'user' and next_role = 'assistant'").select(conv, order, F.col("text").alias("prompt"), "response")


def mask_prompt(prompt_ids: Column, answer_ids: Column, max_len: int) -> Column:
    """struct(input_ids, labels): labels of the prompt are -100, both cut to max_len."""
    ids = F.slice(F.concat(prompt_ids, answer_ids), 1, max_len)
    labels = F.slice(F.concat(F.transform(prompt_ids, lambda x: F.lit(-100)), answer_ids), 1, max_len)
    return F.struct(ids.alias("input_ids"), labels.alias("labels"))


def bears_loss(labels: Column) -> Column:
    """Whether a label after the first counts."""
    return F.exists(F.slice(labels, 2, 2**31 - 3), lambda x: x != -100)
