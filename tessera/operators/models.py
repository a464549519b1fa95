"""Statistics of experts and tensors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .evaluation import top_k


def choose_keep(stats: DataFrame, keep: int) -> DataFrame:
    """Experts that each layer keeps: by saliency, then frequency, then id; ids ascend."""
    kept = top_k(stats, "layer", [F.desc("saliency"), F.desc("freq"), "expert"], keep)
    return kept.select("layer", "expert").orderBy("layer", "expert")


def kept_and_pruned(stats: DataFrame, kept: DataFrame, layer: str = "layer", expert: str = "expert") -> DataFrame:
    """Saliency kept and pruned, and experts never used, by layer."""
    marked = stats.join(kept.select(layer, expert, F.lit(True).alias("__kept")), [layer, expert], "left").withColumn("__kept", F.coalesce("__kept", F.lit(False)))
    part = lambda on: F.coalesce(F.sum(F.when(F.col("__kept") == on, F.col("saliency"))), F.lit(0.0))
    return marked.groupBy(layer).agg(part(True).alias("kept"), part(False).alias("pruned"), F.count_if(F.col("freq") == 0).alias("unused"))


def layer_importance(given: DataFrame | None, kept_sums: DataFrame, layers: int) -> DataFrame:
    """(layer, importance): the given scores if there is one for each layer, else the kept saliency; none if that is not complete either."""
    for source in (given, kept_sums.select("layer", F.col("kept").alias("importance"))):
        if source is not None and source.select("layer").distinct().count() == layers:
            return source.orderBy("layer")
    return kept_sums.select("layer", F.col("kept").alias("importance")).limit(0)


def energy(tensors: DataFrame, statistics: DataFrame) -> DataFrame:
    """(layer, kind, energy): for each tensor the dot product of its input squares with its column squares, summed over experts; names meet by suffix."""
    s = statistics.select(F.regexp_replace("name", r"\.in_sum2$", "").alias("name"), "in_sum2")
    dot = F.aggregate(F.zip_with("in_sum2", "col_sq", lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)
    return tensors.join(s, "name").groupBy("layer", "kind").agg(F.sum(dot).alias("energy"))


def tensor_report(tensors: DataFrame, active_share: Column) -> DataFrame:
    """One row: bytes in all and bytes read for each token (experts by their active share, the embedding not at all)."""
    read = F.when(F.col("kind") == "expert", F.col("n_bytes") * active_share).when(F.col("kind") == "token_embd", 0).otherwise(F.col("n_bytes"))
    return tensors.agg(F.sum("n_bytes").alias("bytes"), F.sum(read).alias("bytes_per_token"))


def stage_seconds(times: DataFrame) -> DataFrame:
    """(stage, seconds) of (stage, start, end) rows that are whole, and their total under a null stage."""
    whole = times.where("start is not null and end is not null and end >= start")
    return whole.rollup("stage").agg(F.sum(F.col("end") - F.col("start")).alias("seconds"))


def compression(df: DataFrame, before: str, after: str) -> DataFrame:
    """One row: words before and after, and their ratio."""
    words = lambda c: F.sum(F.size(F.filter(F.split(c, r"\s+"), lambda w: w != "")))
    return df.agg(words(before).alias("words_before"), words(after).alias("words_after")).withColumn("ratio", F.try_divide("words_after", "words_before"))
