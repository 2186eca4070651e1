"""Snapshots: capture, recap, verification and restoring of a branch's whole state, over the commit log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.hashing import encoded_document
from palimpsest.operators.ledger import diff


def capture(collections: dict[str, DataFrame], campaign: str) -> DataFrame:
    """One row a campaign and collection: campaign, collection, rows, and the digest of its rows in order.

    A collection is hashed row by row and its row digests in order, so a capture
    doesn't gather rows; the digests of one campaign's collection are.
    """
    out = None
    for name, rows in sorted(collections.items()):
        columns = sorted(c for c in rows.columns if c != campaign)
        row = F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)
        one = rows.groupBy(F.col(campaign).alias("campaign")).agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(row))), 256).alias("digest"))
        one = one.select("campaign", F.lit(name).alias("collection"), "rows", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def snapshot_documents(captured: DataFrame) -> DataFrame:
    """campaign and its snapshot as one compressed, content-addressed document."""
    parts = captured.groupBy("campaign").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("collection", F.struct("rows", "digest")))))).alias("json"))
    return parts.select("campaign", encoded_document(F.col("json")).alias("document"))


def dirty(live: DataFrame, head: DataFrame) -> DataFrame:
    """campaign and collection of what differs between the live capture and the head's."""
    return diff(live, head, ["campaign", "collection"], "digest").where("change <> 'unchanged'")


def restore(live: DataFrame, held: DataFrame, key: str, revision: str) -> DataFrame:
    """Rows of a capture as live rows; revisions only go forward: one more than the greater of both."""
    now = live.select(key, F.col(revision).alias("__live"))
    return held.join(now, key, "left").withColumn(revision, F.greatest(F.col(revision), F.coalesce("__live", F.lit(0))) + 1).drop("__live")


def deletable(snapshots: DataFrame, branches: DataFrame) -> DataFrame:
    """Snapshots without children that no branch refers to."""
    used = snapshots.where(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("id")).unionByName(branches.select(F.col("head_snapshot_id").alias("id")))
    return snapshots.join(used.distinct(), "id", "left_anti")


def retarget(activations: DataFrame, payload: DataFrame, key: str) -> DataFrame:
    """Activation rows with `active` as the payload's membership says."""
    return activations.drop("active").join(payload.select(key, F.lit(True).alias("active")).distinct(), key, "left").withColumn("active", F.coalesce("active", F.lit(False)))
