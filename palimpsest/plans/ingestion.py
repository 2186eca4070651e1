"""Ingestion: documents to sections and chunks, with revisions retired rather than replaced."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.hashing import chunk_key, retired_key
from palimpsest.functions.text import estimated_tokens
from palimpsest.operators.chunking import parse_chunks


def plan_sources(incoming: DataFrame, sources: DataFrame) -> DataFrame:
    """Incoming (system_id, source_key, text) with checksum and action: skip, retire or add.

    The same checksum under the key refreshes metadata only; another one
    retires the active revision.
    """
    own = incoming.withColumn("checksum", F.sha2(F.coalesce("text", F.lit("")), 256))
    held = sources.where("active").select("system_id", "source_key", F.col("checksum").alias("__held"))
    both = own.join(held, ["system_id", "source_key"], "left")
    action = F.when(F.col("__held") == F.col("checksum"), "skip").when(F.col("__held").isNotNull(), "retire").otherwise("add")
    return both.withColumn("action", action).drop("__held")


def retire(sources: DataFrame, planned: DataFrame) -> DataFrame:
    """Sources after a plan: retired revisions are inactive, under a key of their own; their chunks stay."""
    gone = planned.where("action = 'retire'").select("system_id", "source_key", F.lit(True).alias("__gone"))
    own = sources.join(gone, ["system_id", "source_key"], "left").withColumn("__gone", F.coalesce("__gone", F.lit(False)) & F.col("active"))
    key = F.when(F.col("__gone"), retired_key(F.col("source_key"), F.col("checksum"), F.lit(1))).otherwise(F.col("source_key"))
    return own.withColumns({"source_key": key, "active": F.col("active") & ~F.col("__gone")}).drop("__gone")


def chunk_table(planned: DataFrame) -> DataFrame:
    """Chunk rows of sources to add: key, path, text, offsets, tokens; chunks are made where their source is."""
    rows = planned.where("action <> 'skip'").select("source_key", "text")
    chunks = parse_chunks(rows, "source_key", "text")
    return chunks.withColumns({"chunk_key": chunk_key(F.col("source_key"), F.col("section"), F.col("ordinal"), F.col("content")), "tokens": estimated_tokens(F.col("content"))})


def scene_diff(old: DataFrame, new: DataFrame, progress: DataFrame) -> DataFrame:
    """stable_key, change and progress rows touched, of two revisions' scenes (stable_key, checksum)."""
    from palimpsest.operators.ledger import diff

    touched = progress.groupBy("stable_key").agg(F.count("*").alias("progress"))
    return diff(old, new, ["stable_key"], "checksum").join(touched, "stable_key", "left").withColumn("progress", F.coalesce("progress", F.lit(0)))
