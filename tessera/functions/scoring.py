"""Scores of answers, as expressions, and of texts against a set of bounded size."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .jsontext import as_json
from .text import strip, tokens


def overlap(a: Column, b: Column) -> Column:
    """Size of the intersection of two token arrays as multisets.

    Both are sorted and merged into runs, so the work is n log n and not a scan of b for each token of a.
    """
    tagged = F.array_sort(F.concat(F.transform(a, lambda x: F.struct(x.alias("t"), F.lit(0).alias("s"))), F.transform(b, lambda x: F.struct(x.alias("t"), F.lit(1).alias("s")))))
    start = F.struct(F.lit(None).cast("string").alias("t"), F.lit(0).alias("free"), F.lit(0).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        held = F.when(acc["t"].eqNullSafe(x["t"]), acc["free"]).otherwise(0)
        hit = (x["s"] == 1) & (held > 0)
        return F.struct(x["t"].alias("t"), F.when(x["s"] == 0, held + 1).when(hit, held - 1).otherwise(held).alias("free"), (acc["n"] + hit.cast("int")).alias("n"))

    return F.aggregate(tagged, start, step, lambda acc: acc["n"])


def token_f1(a: Column, b: Column) -> Column:
    """Multiset F1 of the words of two texts: 1 if both are empty, 0 if one is."""
    x, y = tokens(a), tokens(b)
    n, m, common = F.size(x), F.size(y), overlap(x, y).cast("double")
    p, r = common / n, common / m
    return F.when((n == 0) & (m == 0), 1.0).when((n == 0) | (m == 0) | (common == 0), 0.0).otherwise(2 * p * r / (p + r))


def agreement(answer: Column, reference: Column) -> Column:
    """Mean agreement over the fields of a JSON reference: texts of over three words by F1, others exactly; else F1 of the texts."""
    ref, got = as_json(reference), as_json(answer)
    fields = F.coalesce(F.map_entries(F.try_variant_get(ref, "$", "map<string,variant>")), F.array().cast("array<struct<key:string,value:variant>>"))
    mine = F.try_variant_get(got, "$", "map<string,variant>")
    shown = lambda v: F.when(v.isNull() | F.is_variant_null(v), F.lit("none")).otherwise(F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v)))

    def one(e: Column) -> Column:
        v, a = e["value"], F.element_at(mine, e["key"])
        text = F.try_variant_get(v, "$", "string")
        long = (F.schema_of_variant(v) == "STRING") & (F.size(F.split(strip(text), r"\s+")) > 3)
        return F.when(long, token_f1(F.when(shown(a) == "none", "").otherwise(shown(a)), text)).otherwise((F.lower(strip(shown(a))) == F.lower(strip(shown(v)))).cast("double"))

    scores = F.transform(fields, one)
    mean = F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / F.size(scores)
    return F.when(F.size(fields) > 0, F.when(mine.isNull(), 0.0).otherwise(mean)).otherwise(token_f1(answer, reference))


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """1 - C(n-c, k) / C(n, k): the chance that one of k of n samples, c of which pass, passes; n < k is an error."""
    miss = F.aggregate(F.sequence(F.lit(1), F.lit(k)), F.lit(1.0), lambda x, i: x * (n - c - k + i) / (n - k + i))
    short = F.raise_error(F.format_string(f"pass@{k} needs at least {k} samples, got %d", n)).cast("double")
    return F.when(n < k, short).when(n - c < k, 1.0).otherwise(1.0 - miss)


#: Distinct (item, word) pairs of a set that scoring by best_overlap() holds on every executor.
MOST_WORDS = 2_000_000


def best_overlap(docs: DataFrame, items: DataFrame, doc: str, item: str, text: str = "text") -> DataFrame:
    """(doc, item, f1): for each document the item whose words overlap most by multiset F1 (to six places, ties to the smaller item); documents without a common word are left out.

    Where the items' word counts are few (MOST_WORDS, checked) they go to all executors and documents are scored where
    they are; a larger set is joined by word, in which frequent words are hot.
    """
    count = lambda df, k: df.select(k, F.explode(tokens(F.col(text))).alias("w")).groupBy(k, "w").agg(F.count("*").alias("n"))
    b = count(items, item)
    known = b.limit(MOST_WORDS + 1).toArrow()
    if known.num_rows > MOST_WORDS:
        a = count(docs, doc)
        sizes = lambda df, k, into: df.groupBy(k).agg(F.sum("n").alias(into))
        common = a.join(b.withColumnRenamed("n", "m"), "w").groupBy(doc, item).agg(F.sum(F.least("n", "m")).alias("common"))
        near = common.join(sizes(a, doc, "sa"), doc).join(sizes(b, item, "sb"), item)
    else:
        near = _overlaps(docs.select(doc, tokens(F.col(text)).alias("__w")), known, doc, item)
    f1 = F.round(2.0 * F.col("common") / (F.col("sa") + F.col("sb")), 6)
    best = near.withColumn("f1", f1).groupBy(doc).agg(F.max_by(F.struct(item, "f1"), F.struct("f1", -F.col(item))).alias("r"))
    return best.select(doc, f"r.{item}", "r.f1")


def _overlaps(docs: DataFrame, known, doc: str, item: str) -> DataFrame:
    """(doc, item, common, sa, sb) of each document's items whose F1 is within rounding of its best; known is (item, w, n)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    vocabulary = pc.unique(known.column("w").combine_chunks()) if known.num_rows else pa.array([], pa.string())
    ids, at = np.unique(known.column(item).to_numpy(), return_inverse=True)
    word, n = pc.index_in(known.column("w").combine_chunks(), vocabulary).to_numpy() if known.num_rows else np.zeros(0, np.int32), known.column("n").to_numpy()
    total = np.bincount(at, n, len(ids)).astype(np.int64)
    order = np.argsort(word, kind="stable")
    word, at, n = word[order], at[order], n[order]
    first = np.searchsorted(word, np.arange(len(vocabulary) + 1))
    schema = docs.select(doc).schema
    kind = schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            lists = batch.column("__w")
            code = pc.fill_null(pc.index_in(lists.flatten(), vocabulary), -1).to_numpy()
            size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            end = np.cumsum(size)
            rows, found, common = [], [], []
            for r, (a, z) in enumerate(zip(end - size, end, strict=True)):
                w, m = np.unique(code[a:z][code[a:z] >= 0], return_counts=True)
                if not len(w):
                    continue
                span = first[w + 1] - first[w]
                entry = np.repeat(first[w + 1] - np.cumsum(span), span) + np.arange(span.sum())
                both = np.bincount(at[entry], np.minimum(n[entry], np.repeat(m, span)), len(ids))
                f1 = 2 * both / (total + (z - a))
                near = np.flatnonzero((both > 0) & (f1 >= f1.max() - 2e-6))
                rows.append(np.full(len(near), r)), found.append(near), common.append(both[near].astype(np.int64))
            rows, found, common = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, found, common))
            yield pa.RecordBatch.from_arrays([batch.column(doc).take(pa.array(rows, pa.int64())), pa.array(ids[found]), pa.array(common, pa.int64()), pa.array(size[rows].astype(np.int64)), pa.array(total[found])], names=[doc, item, "common", "sa", "sb"])

    return docs.mapInArrow(run, f"{doc} {kind}, {item} long, common long, sa long, sb long")
