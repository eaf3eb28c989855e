"""Corpus pipeline: classify, drop near duplicates, mask secrets, mix sources, pack.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; its
rows are written as Parquet and read again before the next.  All stages but the last
return the columns of ``documents``:

quality_classifier   documents with a score below 0.5 go
near_duplicates      of each group of like documents that of the smallest doc_id stays
secret_scan          every reported span becomes a mask
source_mix           each source's documents, as often as its target takes them
best_fit_packing     pieces of at most 2048 tokens, each with its place in a sequence

Decisions are made on narrow rows (place, fingerprint, size) and applied by place in a
second reading; texts shuffle nowhere but where a secret is masked.

Defined results: a null text is empty; it is scored by the bias alone, like any other text
without words, and all such texts are one near-duplicate group.  A null doc_id, source or
other column is kept as it is.  Very long texts are used whole.  Of alike documents the
smallest doc_id stays, rows without one come last, and ties leave one row.  Repeated rows
are exact copies of one another: one stays.  Extra columns are carried along, whatever
their names but for those that begin with two underscores.  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scopelake.llm import classifier, mixing, packing, secrets, simhash
from scopelake.llm.common import table, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return classifier.keep_predicted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(docs)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the classifier nor the fingerprints; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
