"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import stages

#: (name, function); each takes (spark, docs, sf_dir), and its rows, written as Parquet, are the next one's docs.
STAGES = [
    ("quality classifier", stages.quality),
    ("n-gram Jaccard join", stages.near_duplicates),
    ("suffix-array dedup", stages.repeated_passages),
    ("secret scans", stages.secrets),
    ("packing", stages.packing),
]

#: None: trained scores, hashes of long strings and the linear program aren't expressible in SQL; tests/llm holds a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents; each result but the last is written to the shared folder and read again."""
    from tessera.llm.common import stage, table

    docs = table(spark, sf_dir, "documents")
    for k, (_, work) in enumerate(STAGES):
        docs = work(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"corpus-{k}")
    return docs
