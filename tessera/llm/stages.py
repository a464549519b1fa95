"""The stages of corpus_pipeline.py: each takes and returns documents, the last returns packed pieces.

A stage's decisions take effect: rejected documents and further copies go, repeated passages and
secrets leave the text, and n_chars follows the text. Rows with a null doc_id or text stay rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns) if "n_chars" in columns else docs.select(*columns)


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the classifier, trained on the labels, accepts."""
    from . import quality_gam as gam
    from .common import table

    model = gam.train(docs, table(spark, sf_dir, "labels"))
    return gam.score(docs, model).where("predicted = 1").select(*docs.columns)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of documents linked by word shingles."""
    from . import jaccard_join

    return jaccard_join.keep_one(docs)


def repeated_passages(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take passages of 100 bytes or more that occur earlier out of the texts; documents of which nothing is left go."""
    from . import suffix_dedup

    return with_length(suffix_dedup.remove(docs), docs.columns)


def secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret by its kind."""
    from . import secret_scan
    from .common import new_path

    return with_length(secret_scan.clean(docs, new_path(spark, "ledger")), docs.columns)


def packing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048 ids."""
    from . import packing as p
    from .bpe import vocabulary

    return p.pack(docs, vocabulary("word_bpe_49k.json"))
