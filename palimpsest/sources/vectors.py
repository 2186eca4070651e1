"""Vector collections as tables: upsert, delete, filtered exact search and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.scoring import cosine_similarity


def scoped_name(namespace: str, name: str) -> str:
    return name if name.startswith(f"{namespace}_") else f"{namespace}_{name}"


def collection_name(base: str, profile: str) -> str:
    return f"{base}__{profile}"


def upsert(collection: DataFrame, rows: DataFrame, ordinal: str | None = None) -> DataFrame:
    """The collection after rows of (id, embedding, metadata, document); of one id in them the last by `ordinal` holds."""
    if ordinal:
        names = [c for c in rows.columns if c not in ("id", ordinal)]
        rows = rows.groupBy("id").agg(F.max_by(F.struct(*names), ordinal).alias("r")).select("id", "r.*")
    return collection.join(rows.select("id"), "id", "left_anti").unionByName(rows)


def delete(collection: DataFrame, ids: DataFrame | None = None, where: Column | None = None) -> DataFrame:
    if ids is None and where is None:
        raise ValueError("ids or a filter is needed")
    gone = collection
    if where is not None:
        gone = gone.where(where)
    if ids is not None:
        gone = gone.join(ids.select("id"), "id", "left_semi")
    return collection.join(gone.select("id"), "id", "left_anti")


def query(collection: DataFrame, embedding: list[float], limit: int, where: Column | None = None) -> DataFrame:
    """id and score of the nearest rows by cosine; filters come first, ties go to the smaller id."""
    own = collection if where is None else collection.where(where)
    score = cosine_similarity(F.col("embedding"), F.array(*[F.lit(float(x)) for x in embedding]))
    return own.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(max(1, limit))


def check_profile(properties: dict[str, str], profile: dict[str, str]) -> None:
    """ValueError where a collection was made with another embedding profile."""
    wrong = [k for k, v in profile.items() if k in properties and properties[k] != v]
    if wrong:
        raise ValueError(f"the collection has another {', '.join(sorted(wrong))}")


def stats(collection: DataFrame) -> DataFrame:
    return collection.agg(F.count("*").alias("count"), F.countDistinct(F.size("embedding")).alias("lengths"))
