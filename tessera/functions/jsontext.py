"""Expressions over JSON in text, by the variant type; what does not parse is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import clean, strip


def between(c: Column, first: str, last: str) -> Column:
    """From the first `first` to the last `last`, null if there is no such stretch."""
    a = F.instr(c, first)
    b = F.length(c) - F.instr(F.reverse(c), last) + 1
    return F.when((a > 0) & (F.instr(c, last) > 0) & (b > a), F.substring(c, a, b - a + 1))


def parse_array(c: Column) -> Column:
    """Trimmed strings of over ten characters of the JSON array in a reply; objects give their input, text or JSON."""
    items = F.try_variant_get(F.try_parse_json(between(clean(c), "[", "]")), "$", "array<variant>")

    def value(v: Column) -> Column:
        inner = F.coalesce(F.nullif(F.try_variant_get(v, "$.input", "string"), F.lit("")), F.nullif(F.try_variant_get(v, "$.text", "string"), F.lit("")))
        kind = F.schema_of_variant(v)
        return F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind.startswith("OBJECT"), F.coalesce(inner, F.to_json(v)))

    return F.coalesce(F.filter(F.transform(items, lambda v: strip(value(v))), lambda s: s.isNotNull() & (F.length(s) > 10)), F.array().cast("array<string>"))


def parse_inputs(c: Column) -> Column:
    """(input, tests) of the JSON array of objects in a reply; inputs of over ten characters with tests."""
    rows = F.from_json(between(clean(c), "[", "]"), "array<struct<input string, tests string>>")
    rows = F.transform(rows, lambda r: F.struct(strip(r["input"]).alias("input"), strip(r["tests"]).alias("tests")))
    return F.coalesce(F.filter(rows, lambda r: (F.length(r["input"]) > 10) & (r["tests"] != "")), F.array().cast("array<struct<input string, tests string>>"))


def as_json(c: Column) -> Column:
    """The variant in a text or in its first fence."""
    body = strip(c)
    inner = F.regexp_extract(body, r"(?s)```(?:json)?\s*(.*?)```", 1)
    return F.try_parse_json(F.when(body.rlike(r"(?s)```(?:json)?\s*.*?```"), strip(inner)).otherwise(body))


def first_object(c: Column) -> Column:
    """The first of fence, whole text and outermost braces that is a JSON object."""
    out = F.lit(None).cast("variant")
    for part in (between(c, "{", "}"), strip(c), F.nullif(F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))):
        v = F.try_parse_json(part)
        out = F.when(F.schema_of_variant(v).startswith("OBJECT"), v).otherwise(out)
    return out


def salvage(c: Column) -> Column:
    """The first greedy {..} or [..] of a text."""
    return F.nullif(F.regexp_extract(c, r"(?s)(\{.*\}|\[.*\])", 1), F.lit(""))


def same(a: Column, b: Column) -> Column:
    """Equal as JSON, else equal with white space collapsed."""
    flat = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    one, two = F.to_json(F.try_parse_json(a)), F.to_json(F.try_parse_json(b))
    return F.coalesce(one == two, F.lit(False)) | (flat(a) == flat(b))


def as_text(v: Column) -> Column:
    """A variant as text: a string as it is, anything else as JSON; null stays null."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.to_json(v))


#: The target of a task that names none.
TARGET = {"max_size_gb": 7.0, "min_tok_s": 40.0, "laptop_ram_gb": 16}


def draft(c: Column) -> Column:
    """A task specification from a model's reply, as struct; null if there is no JSON object in it.

    An object may sit under `taskspec`; texts may be any JSON, names become slugs, unknown fields go and missing
    ones get their defaults. bad_seeds tells of examples that aren't objects with input and output.
    """
    from .text import slug

    v = first_object(c)
    has = lambda v, k: F.try_variant_get(v, f"$.{k}", "variant").isNotNull()
    get = lambda k, kind="variant": F.try_variant_get(spec, f"$.{k}", kind)
    spec = F.when(F.schema_of_variant(F.try_variant_get(v, "$.taskspec", "variant")).startswith("OBJECT") & ~has(v, "seed_examples"), F.try_variant_get(v, "$.taskspec", "variant")).otherwise(v)
    seeds = get("seed_examples", "array<variant>")
    whole = lambda e: F.schema_of_variant(e).startswith("OBJECT") & has(e, "input") & has(e, "output")
    field = lambda e, k: as_text(F.try_variant_get(e, f"$.{k}", "variant"))
    target = F.struct(*(F.coalesce(get(f"target.{k}", "double"), F.lit(float(d))).cast("int" if k.endswith("ram_gb") else "double").alias(k) for k, d in TARGET.items()))
    out = F.struct(
        F.coalesce(F.nullif(get("version", "int"), F.lit(0)), F.lit(1)).alias("version"), slug(as_text(get("task_name"))).alias("task_name"),
        *(as_text(get(k)).alias(k) for k in ("description", "input_format", "output_format")),
        F.transform(F.filter(seeds, whole), lambda e: F.struct(field(e, "input").alias("input"), field(e, "output").alias("output"), F.lit("").alias("tests"))).alias("seed_examples"),
        as_text(get("eval_criteria")).alias("eval_criteria"), target.alias("target"), F.lit("text").alias("task_type"), F.lit(None).cast("string").alias("language"),
        F.coalesce(F.exists(seeds, lambda e: ~F.coalesce(whole(e), F.lit(False))), F.lit(False)).alias("bad_seeds"),
    )
    return F.when(v.isNotNull(), out)
