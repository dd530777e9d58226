"""The corpus pipeline: documents through five operators, each stage written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitelens.llm.common import drop_written, materialize, scope, table
from sitelens.llm.jaccard import keep_one
from sitelens.llm.lines import drop_lines
from sitelens.llm.packing import pack_documents
from sitelens.llm.quality import keep_good
from sitelens.llm.secrets import mask_secrets

STAGES = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_lines),
    ("ngram_jaccard_join", keep_one),
    ("secret_scans", mask_secrets),
    ("packing", pack_documents),
]
#: Fitted scores and packing have no SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage. When a stage's table is written, the tables that it was made from are deleted."""
    docs = table(spark, sf_dir, "documents")
    with scope() as mine:
        for name, stage in STAGES:
            docs = materialize(stage(spark, docs, sf_dir), name)
            drop_written(spark, mine[:-1])
    return docs
