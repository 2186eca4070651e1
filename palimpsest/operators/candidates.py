"""Candidates of an import told apart by what they say, so that decisions follow unchanged content from one inspection to the next."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.operators.records import REVIEWS
from palimpsest.sources.tables import durable

#: Fields that an edit ledger adds to a candidate, at any depth.
LEDGER_FIELDS = ("edit_history", "original_fingerprint")


def _bare(value):
    """A JSON value without what edit ledgers add."""
    if isinstance(value, dict):
        return {k: _bare(v) for k, v in value.items() if k not in LEDGER_FIELDS}
    return [_bare(v) for v in value] if isinstance(value, list) else value


@F.pandas_udf(T.StringType())
def fingerprint(artifact: pd.Series) -> pd.Series:
    """SHA-256 of a JSON text's canonical form, keys sorted, without edit ledgers; null for null or what isn't JSON."""

    def one(text: str | None) -> str | None:
        try:
            return None if text is None else hashlib.sha256(json.dumps(_bare(json.loads(text)), ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode("utf-8", "surrogatepass")).hexdigest()
        except ValueError:
            return None

    return artifact.map(one, na_action="ignore").where(artifact.notna(), None)


def problems(candidates: DataFrame) -> DataFrame:
    """job_id and problem (the first by place) of jobs whose new candidates (job_id, id, artifact, review_status, ordinal) can't be taken."""
    own = candidates.withColumn("id", F.trim(F.coalesce("id", F.lit(""))))
    repeats = F.row_number().over(Window.partitionBy("job_id", "id").orderBy("ordinal"))
    own = own.withColumn("nth", repeats)
    status = F.coalesce("review_status", F.lit("pending"))
    problem = F.when(F.col("id") == "", "no id").when(F.col("nth") > 1, "repeated id").when(~status.isin(*REVIEWS), "unknown review status").when(F.col("content").isNull(), "not JSON")
    return own.withColumn("problem", problem).where("problem is not null").groupBy("job_id").agg(F.min_by("problem", "ordinal").alias("problem"))


def _numbered(df: DataFrame) -> DataFrame:
    """Equal contents of a job numbered in order, so that each is matched once."""
    return df.withColumn("k", F.row_number().over(Window.partitionBy("job_id", "content").orderBy("ordinal", "id")))


def set_candidates(held: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates after a new inspection, problems): job_id, id, ordinal, artifact, original_fingerprint, review_status and outcome.

    `held` has (job_id, id, ordinal, artifact, review_status,
    original_fingerprint), `new` (job_id, id, ordinal, artifact, review_status).
    A candidate of the same id and content keeps its decision and first
    fingerprint (outcome `kept`); of the rest, contents that stand under other
    ids take theirs along, the first with the first (`moved`); an id whose
    content changed needs revision if it had been decided, else it is pending
    (`changed`); all others come with their own status (`new`).  What held
    candidates nobody took over go.  A job with a problem keeps its candidates
    as they were (`refused`).  Null jobs are left out.
    """
    new = durable(new.where("job_id is not null").withColumn("content", fingerprint("artifact")))
    bad = durable(problems(new))
    held = durable(held.withColumn("content", fingerprint("artifact")))
    good = new.join(bad.select("job_id"), "job_id", "left_anti").withColumn("id", F.trim("id"))
    decided = held.select("job_id", "id", F.col("content").alias("old_content"), F.col("review_status").alias("old_status"), F.col("original_fingerprint").alias("old_first"))
    told = durable(good.join(decided, ["job_id", "id"], "left").withColumn("same", F.coalesce(F.col("content") == F.col("old_content"), F.lit(False))))
    kept = told.where("same")
    # What is left on both sides meets by content; equal contents are dealt one to one.
    left = _numbered(told.where("not same").select("job_id", "id", "ordinal", "content"))
    loose = _numbered(held.join(kept.select("job_id", "id"), ["job_id", "id"], "left_anti").select("job_id", "id", "ordinal", "content", "review_status", "original_fingerprint"))
    moved = left.join(loose.select("job_id", "content", "k", F.col("review_status").alias("moved_status"), F.col("original_fingerprint").alias("moved_first")), ["job_id", "content", "k"]).select("job_id", "id", "moved_status", "moved_first", F.lit(True).alias("moved"))
    told = told.join(moved, ["job_id", "id"], "left")
    outcome = F.when(F.col("same"), "kept").when(F.col("moved"), "moved").when(F.col("old_content").isNotNull(), "changed").otherwise("new")
    redone = F.when(F.col("old_status") == "pending", "pending").otherwise("needs_revision")
    status = F.when(outcome == "kept", F.col("old_status")).when(outcome == "moved", F.col("moved_status")).when(outcome == "changed", redone).otherwise(F.coalesce("review_status", F.lit("pending")))
    first = F.when(outcome == "kept", F.coalesce("old_first", "content")).when(outcome == "moved", F.coalesce("moved_first", "content")).when(outcome == "changed", F.coalesce("old_first", "old_content")).otherwise(F.col("content"))
    columns = ["job_id", "id", "ordinal", "artifact"]
    after = told.select(*columns, first.alias("original_fingerprint"), status.alias("review_status"), outcome.alias("outcome"))
    there = new.select("job_id").distinct().join(bad.select("job_id"), "job_id", "left_anti")
    refused = held.join(bad.select("job_id"), "job_id", "left_semi").select(*columns, "original_fingerprint", "review_status", F.lit("refused").alias("outcome"))
    others = held.join(there, "job_id", "left_anti").join(bad.select("job_id"), "job_id", "left_anti").select(*columns, "original_fingerprint", "review_status", F.lit("untouched").alias("outcome"))
    return after.unionByName(refused).unionByName(others), bad
