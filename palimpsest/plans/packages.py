"""Portable packages: source bundles of offsets and slice hashes, and the checks of a package's references."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.hashing import chunk_key
from palimpsest.operators.contracts import SHA256, duplicates, missing, union, violations


def _slice(text: str, start: str, end: str) -> Column:
    return F.substring(F.col(text), F.col(start) + 1, F.col(end) - F.col(start))


def bundle_chunks(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks (source_key, section, ordinal, start, end) of sources (source_key, text) with key and content hash; text isn't copied."""
    own = chunks.join(sources.select("source_key", "text"), "source_key").withColumn("__slice", _slice("text", "start", "end"))
    return own.select(*chunks.columns, F.sha2("__slice", 256).alias("content_sha256"), chunk_key(F.col("source_key"), F.col("section"), F.col("ordinal"), F.col("__slice")).alias("chunk_key"))


def bundle_problems(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """subject (chunk key) and problem of chunks whose offsets or hashes don't hold for their sources."""
    own = chunks.join(sources.select("source_key", "text"), "source_key", "left")
    inside = (F.col("start") >= 0) & (F.col("end") >= F.col("start")) & (F.col("end") <= F.length("text"))
    return violations(own, "chunk_key", {"the source is missing": F.col("text").isNotNull(), "the offsets are outside": F.col("text").isNull() | inside, "the content differs": F.col("text").isNull() | ~inside | (F.sha2(_slice("text", "start", "end"), 256) == F.col("content_sha256"))})


def package_problems(packages: DataFrame, assets: DataFrame, sources: DataFrame, actors: DataFrame, references: DataFrame) -> DataFrame:
    """subject (package) and problem of whole packages.

    packages (package_id, kind, version, system_id); assets (package_id,
    asset_key, sha256, size); sources (package_id, source_key, asset_key);
    actors (package_id, actor_id, image_asset_key); references (package_id,
    kind, ref), where kind says what `ref` must be: asset, source or actor.
    """
    scoped = lambda df, c: df.select("package_id", F.concat_ws("|", "package_id", c).alias("ref"))
    known = {"asset": scoped(assets, "asset_key"), "source": scoped(sources, "source_key"), "actor": scoped(actors, "actor_id")}
    parts = [
        violations(packages, "package_id", {"the kind is unknown": F.col("kind").isin("rulebook", "module", "addon"), "the version isn't x.y.z": F.col("version").rlike(r"^\d+\.\d+\.\d+$"), "the system is missing": F.col("system_id") != ""}),
        violations(assets, "package_id", {"an asset's address is no SHA-256": F.col("sha256").rlike(SHA256), "an asset's size is negative": F.col("size") >= 0}),
        duplicates(assets, ["package_id", "asset_key"], "an asset is repeated"), duplicates(sources, ["package_id", "source_key"], "a source is repeated"), duplicates(actors, ["package_id", "actor_id"], "an actor is repeated"),
        missing(scoped(sources, "asset_key"), "ref", known["asset"], "ref", "package_id", "unknown asset "),
        missing(scoped(actors.where(F.col("image_asset_key").isNotNull()), "image_asset_key"), "ref", known["asset"], "ref", "package_id", "unknown asset "),
        *[missing(scoped(references.where(F.col("kind") == k), "ref"), "ref", df, "ref", "package_id", f"unknown {k} ") for k, df in known.items()],
    ]
    return union(parts).distinct()


def portable_tree(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """source_key and sections, each with its chunks in order, as one nested row a source."""
    own = chunks.groupBy("source_key", F.col("section").alias("ordinal")).agg(F.array_sort(F.collect_list(F.struct(F.col("ordinal"), "start", "end", "content_sha256"))).alias("chunks"))
    both = sections.join(own, ["source_key", "ordinal"], "left").withColumn("chunks", F.coalesce("chunks", F.array().cast(own.schema["chunks"].dataType)))
    return both.groupBy("source_key").agg(F.array_sort(F.collect_list(F.struct("ordinal", "level", "title", "parent", "start", "end", "chunks"))).alias("sections"))
