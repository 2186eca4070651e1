"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and works on all documents that the one
before it kept; the last gives the encoded form.  What a stage keeps is written
as Parquet and read again, so each stage runs once, however often the next one
reads its documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from palimpsest.llm import decontamination, language, near_dedup, pieces, pii
from palimpsest.llm.batches import written

STAGES = [
    ("language", language.stage),
    ("near_dedup", near_dedup.stage),
    ("decontamination", decontamination.stage),
    ("pii", pii.stage),
    ("pieces", pieces.stage),
]

#: Compression, edit matching and the encoder have no SQL form; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
