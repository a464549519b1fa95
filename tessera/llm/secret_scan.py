"""Secret scanning over versioned content with an incremental ledger.

Every version of every path is addressed by the SHA-256 of its content. The ledger is a folder of
Parquet files (blob, rules, spans): a scan finds the (blob, rule version) pairs that it lacks, scans
one copy of each such blob, appends the findings and joins them back to all paths and versions that
hold the blob. Unchanged history is never scanned again, and rules that differ in anything have
another version, which scans every blob once. A blob that is in the ledger twice counts once.

A finding is kind:start:end in code points, end exclusive. Kinds are in the order of RULES.

Edge cases: null content counts as empty, and empty content has no findings; a null path is carried
along; repeated rows each get their findings; an empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

import hashlib
import re
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, room_for, stage, table

class Rule(NamedTuple):
    """What to look for: a match counts if its group is `least` code points long; `hint` is a cheaper pattern that any match holds."""

    kind: str
    pattern: re.Pattern
    group: int = 0
    least: int = 1
    hint: re.Pattern | None = None


#: The base rules. Runs of hexadecimal digits are looked for from their least length on: they are maximal either way.
BASE = (
    Rule("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12, re.compile(r"pass(?:word|wd)|secret|token|api_?key", re.I | re.A)),
    Rule("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    Rule("hex", re.compile(r"[0-9a-f]{16,}")),
)
#: What is searched besides: private key blocks and signed web tokens.
MORE = (
    Rule("pem", re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----")),
    Rule("jwt", re.compile(r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}")),
)
RULES = BASE + MORE
LEDGER = "blob string, rules string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def version(rules: tuple[Rule, ...]) -> str:
    """What tells sets of rules apart: a digest of all that decides on their findings."""
    said = [(r.kind, r.pattern.pattern, r.pattern.flags, r.group, r.least) for r in rules]
    return hashlib.sha256(repr(said).encode()).hexdigest()[:16]


def find(text: str, rules: tuple[Rule, ...] = RULES) -> list[tuple[int, int, int]]:
    """(start, order of the rule, end) of all findings, sorted."""
    out = []
    for k, r in enumerate(rules):
        if r.hint is None or r.hint.search(text):
            out += [(m.start(), k, m.end()) for m in r.pattern.finditer(text) if m.end(r.group) - m.start(r.group) >= r.least]
    return sorted(out)


def joined(found: list[tuple[int, int, int]], rules: tuple[Rule, ...] = RULES) -> str:
    return ",".join(f"{rules[k].kind}:{s}:{e}" for s, k, e in found)


def spans(df: DataFrame, content: str = "content", keep: str = "blob", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """keep, n_assign, n_access, n_hex, base_sha256 and spans of each row's content."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    picked = df.select(keep, F.col(content).alias("__content"))
    named = [r.kind for r in BASE]
    schema = StructType([picked.schema[keep], *StructType.fromDDL("n_assign long, n_access long, n_hex long, base_sha256 string, spans string")])

    def run(batches):
        arrow = to_arrow_schema(schema)
        room_for("secrets")
        for batch in batches:
            rows = []
            for t in batch.column("__content"):
                found = find(t.as_py() or "", rules)
                kinds = [rules[k].kind for _, k, _ in found]
                base = [x for x, kind in zip(found, kinds, strict=True) if kind in named]
                rows.append((*(kinds.count(kind) for kind in named), hashlib.sha256(joined(base, rules).encode()).hexdigest(), joined(found, rules)))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(keep), *(pa.array(c, arrow.field(i + 1).type) for i, c in enumerate(columns))], schema=arrow)

    return picked.mapInArrow(run, schema)


def read_ledger(spark, ledger: str, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, findings) under these rules, each blob once, however often runs have appended it."""
    rows = spark.read.schema(LEDGER).parquet(ledger).where(F.col("rules") == version(rules)).drop("rules")
    return rows.dropDuplicates(["blob"])


def scan(versions: DataFrame, ledger: str, content: str = "content", keys: tuple[str, ...] = ("path", "version"), rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """keys, blob and findings of every row of versions; adds to the ledger folder what it lacked under these rules."""
    spark = versions.sparkSession
    held = versions.select(*keys, F.sha2(F.coalesce(F.col(content), F.lit("")).cast("binary"), 256).alias("blob"))
    held = stage(held, "blobs")
    at = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    known = read_ledger(spark, ledger, rules) if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at) else None
    # one row of keys for each blob; a struct's minimum is combined before the shuffle, however often a blob repeats
    unseen = held.groupBy("blob").agg(F.min(F.struct(*keys)).alias("__at"))
    if known is not None:
        unseen = unseen.join(known.select("blob"), "blob", "left_anti")
    unseen = unseen.select("blob", *(F.col("__at")[k].alias(f"__{k}") for k in keys))
    match = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    text = versions.select(*keys, F.coalesce(F.col(content), F.lit("")).alias("__c"))
    # keys may repeat with other content: the blob decides
    todo = text.join(unseen, match, "inner").where(F.sha2(F.col("__c").cast("binary"), 256) == F.col("blob")).select("blob", "__c")
    found = spans(todo, "__c", rules=rules).dropDuplicates(["blob"]).withColumn("rules", F.lit(version(rules)))
    found.select("blob", "rules", "n_assign", "n_access", "n_hex", "base_sha256", "spans").write.mode("append").parquet(ledger)
    return held.join(read_ledger(spark, ledger, rules), "blob")


def redact(text: str, found: str) -> str:
    """text with each span of `spans` replaced by <kind>; overlapping spans count as one, of the first kind."""
    out, last = [], 0
    for item in found.split(",") if found else []:
        kind, start, end = item.rsplit(":", 2)
        if int(start) >= last:
            out += [text[last : int(start)], f"<{kind}>"]
        last = max(last, int(end))
    return "".join([*out, text[last:]])


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, new_path(spark, "ledger"), "text", ("doc_id",)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def clean(docs: DataFrame, ledger: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """docs with the secrets of their texts replaced; a null text stays null, texts without findings stay as they are."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema

    found = scan(docs.select(key, text), ledger, text, (key,)).where("spans <> ''").select("blob", "spans").dropDuplicates(["blob"])
    blob = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    # a blob that many documents share is a hot key of this join, which adaptive execution splits
    marked = docs.withColumn("__blob", blob).join(found.withColumnsRenamed({"blob": "__blob", "spans": "__spans"}), "__blob", "left").drop("__blob")
    names, schema = docs.columns, docs.schema

    def run(batches):
        arrow = to_arrow_schema(schema)
        for batch in batches:
            spans = batch.column("__spans").to_pylist()
            done = [redact(t.as_py(), s) if s else t.as_py() for t, s in zip(batch.column(text), spans, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(done, arrow.field(c).type) if c == text else batch.column(c) for c in names], schema=arrow)

    return marked.select(*names, "__spans").mapInArrow(run, schema)
