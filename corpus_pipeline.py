"""Training corpus pipeline over ``documents``: five stages of the llm operators, Parquet between them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from spendlens.llm import es_mixing, line_edit_dedup, quality_rules, simhash_golay, vector_packing
from spendlens.llm.shared import shared_folder

#: (name, function of spark, docs and sf_dir); each works on what its predecessor kept.
STAGES = [
    ("quality_rules", quality_rules.stage),
    ("line_dedup", line_edit_dedup.stage),
    ("simhash_dedup", simhash_golay.stage),
    ("mixing", es_mixing.stage),
    ("packing", vector_packing.stage),
]

#: Golay decoding and tokenisation are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage; each stage's result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{top}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
