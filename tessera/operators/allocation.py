"""Sizes of quantised models from a table of their tensors, and the greedy allocation of bit widths to layers.

A model is a table (layer, kind, weights, read): a row for each group of tensors that is quantised alike, with the share
of it that one token reads. Sizes, counts and speeds are aggregates over it. A model has a few dozen layers, so the
allocation itself is a driver loop over its rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits per weight of each type, relative error, the types of the parts that never change, and the ladder of the others.
LADDER = ("q2_k", "q3_k", "q4_k", "q5_k", "q6_k")
BITS = {"q2_k": 2.625, "q3_k": 3.4375, "q4_k": 4.5, "q5_k": 5.5, "q6_k": 6.5625, "q8_0": 8.5}
ERROR = {"q2_k": 0.0876, "q3_k": 0.0227, "q4_k": 0.00507, "q5_k": 0.00130, "q6_k": 0.000314, "q8_0": 0.0000196}
STATIC = {"attention": "q5_k", "output": "q6_k", "embedding": "q4_k"}
#: Kinds of expert tensors, and how many projections each has.
EXPERTS = {"gate_up": 2, "down": 1}


def tensors(spark: SparkSession, config: dict) -> DataFrame:
    """The tensors that a mixture-of-experts model's published configuration describes."""
    width, heads = config["hidden_size"], config["num_attention_heads"]
    experts = config.get("num_experts") or config["num_local_experts"]
    queries = heads * (config.get("head_dim") or width // heads)
    keys = queries * config.get("num_key_value_heads", heads) // heads
    words = float(config["vocab_size"] * width)
    each = [("attention", float(2 * width * (queries + keys)), 1.0)]  # into and out of queries, and keys with values
    each += [(kind, float(n * experts * width * config["moe_intermediate_size"]), config["num_experts_per_tok"] / experts) for kind, n in EXPERTS.items()]
    layers = spark.range(config["num_hidden_layers"]).select(F.col("id").cast("int").alias("layer"))
    layers = layers.crossJoin(F.broadcast(spark.createDataFrame(each, "kind string, weights double, read double")))  # three rows
    return layers.unionByName(spark.createDataFrame([(None, "output", words, 1.0), (None, "embedding", words, 0.0)], "layer int, kind string, weights double, read double"))


def _lookup(table: dict, key: Column) -> Column:
    return F.create_map(*map(F.lit, chain.from_iterable(table.items())))[key]


def typed(model: DataFrame, allocation: DataFrame) -> DataFrame:
    """model with the type and gigabytes of each row; allocation is (layer, kind, type), other kinds have their static type."""
    rows = model.join(allocation, ["layer", "kind"], "left").withColumn("type", F.coalesce("type", _lookup(STATIC, F.col("kind"))))
    return rows.withColumn("gb", F.col("weights") * _lookup(BITS, F.col("type")) / 8e9)


def report(rows: DataFrame, bandwidth: float = 120.0, efficiency: float = 0.65) -> DataFrame:
    """One row: weights, gigabytes, gigabytes read for each token, and the tokens a second that a memory bandwidth allows."""
    per_token = F.sum(F.col("gb") * F.col("read"))
    return rows.agg(F.sum("weights").alias("weights"), F.sum("gb").alias("size_gb"), per_token.alias("gb_per_token"), (F.lit(bandwidth * efficiency) / per_token).alias("tok_s"))


def allocate(model: Iterable, gains: dict[tuple[int, str], float], budget: float, per_token: float | None = None, low: str = "q2_k", high: str = "q6_k") -> list[tuple[int, str, str]]:
    """[(layer, kind, type)] of the expert tensors among model's rows: from `low`, buy what lowers the weighted error most per byte while it fits.

    gains weighs the error of each (layer, kind). down may be up to two steps above gate and up, which are never above
    it. Upgrades wait in a heap; one that does not fit now never will, as sizes only grow, so it is dropped.
    """
    first, last = LADDER.index(low), LADDER.index(high)
    gigabytes = lambda weights, kind: weights * BITS[kind] / 8e9
    parts = {(r["layer"], r["kind"]): r for r in model if r["kind"] in EXPERTS}
    level = dict.fromkeys(parts, first)
    size = read = 0.0
    for r in model:
        gb = gigabytes(r["weights"], low if r["kind"] in EXPERTS else STATIC[r["kind"]])
        size, read = size + gb, read + gb * r["read"]
    if size > budget:
        raise ValueError(f"budget {budget:.2f} GB is below the floor size {size:.2f} GB")
    heap: list[tuple[float, int, bool, int, float]] = []

    def offer(layer: int) -> None:
        down, gate_up = level[layer, "down"], level[layer, "gate_up"]
        for kind, ceiling in (("down", min(last, gate_up + 2)), ("gate_up", min(last, down))):
            at = level[layer, kind]
            if at < ceiling:
                here, above = LADDER[at], LADDER[at + 1]
                weights = parts[layer, kind]["weights"]
                extra = gigabytes(weights, above) - gigabytes(weights, here)
                # of equal gains the later layer and gate and up come first
                heapq.heappush(heap, (-gains[layer, kind] * (ERROR[here] - ERROR[above]) / extra, -layer, kind == "down", at, extra))

    for layer in sorted({k[0] for k in parts}):
        offer(layer)
    while heap:
        _, layer, is_down, at, extra = heapq.heappop(heap)
        part = (-layer, "down" if is_down else "gate_up")
        more = extra * parts[part]["read"]
        if level[part] == at and size + extra <= budget and (per_token is None or read + more <= per_token):
            level[part] += 1
            size, read = size + extra, read + more
            offer(part[0])
    return [(*part, LADDER[n]) for part, n in sorted(level.items())]


def quantize_arguments(allocation: DataFrame) -> DataFrame:
    """One row: the arguments that make a quantiser write an allocation (layer, kind, type), in order of layers."""
    #: The tensors that a kind stands for.
    pattern = _lookup({"gate_up": "ffn_(gate|up)_exps", "down": "ffn_down_exps"}, F.col("kind"))
    one = F.concat(F.lit(r"blk\."), F.col("layer").cast("string"), F.lit(r"\."), pattern, F.lit("="), F.col("type"))
    rows = allocation.agg(F.sort_array(F.collect_list(F.struct("layer", (F.col("kind") == "down").alias("d"), one.alias("a")))).alias("rows"))  # two for each layer
    lead = ["--output-tensor-type", STATIC["output"], "--token-embedding-type", STATIC["embedding"], "--tensor-type", r"attn_(q|k|v|output)\.weight=" + STATIC["attention"]]
    return rows.select(F.concat(F.array(*map(F.lit, lead)), F.flatten(F.transform("rows", lambda r: F.array(F.lit("--tensor-type"), r["a"])))).alias("arguments"))


def bit_widths(allocation: DataFrame) -> DataFrame:
    """(layer, tensor, type, bits) of each expert tensor, by layer and tensor."""
    names = F.when(F.col("kind") == "down", F.array(F.lit("ffn_down_exps"))).otherwise(F.array(F.lit("ffn_gate_exps"), F.lit("ffn_up_exps")))
    return allocation.select("layer", F.explode(names).alias("tensor"), "type", _lookup(BITS, F.col("type")).alias("bits")).orderBy("layer", "tensor")
