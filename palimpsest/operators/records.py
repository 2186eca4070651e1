"""Versioned records: conditional updates, templates, cascades and reviews, as tables of revisions.

A record table holds one row a revision; what is current is the row of the
greatest revision.  A conditional update names the revision that it expects and
appends the next, or is a conflict.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.contracts import TRANSITIONS
from palimpsest.operators.ledger import latest

#: What a candidate's review and disposition may be.
REVIEWS, DISPOSITIONS = ("pending", "accepted", "rejected", "needs_revision"), ("include", "exclude", "unresolved")


def compare_and_swap(records: DataFrame, changes: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Outcome of conditional changes: key, outcome (applied, conflict, missing), and the row to append.

    `changes` has key, expected (a revision, or null for any) and new values;
    null keeps what was.  Of several changes of one key only the first, by
    `ordinal`, can find the revision that it expects.
    """
    now = latest(records, [key], "revision")
    first = changes.groupBy(key).agg(F.min("ordinal").alias("__first"))
    both = changes.alias("c").join(first, key).join(now.alias("n"), key, "left")
    fits = (F.col("c.ordinal") == F.col("__first")) & (F.col("c.expected").isNull() | (F.col("c.expected") == F.col("n.revision")))
    outcome = F.when(F.col("n.revision").isNull(), "missing").when(fits, "applied").otherwise("conflict")
    row = {v: F.when(outcome == "applied", F.coalesce(F.col(f"c.{v}"), F.col(f"n.{v}"))).alias(v) for v in values}
    return both.select(key, F.col("c.ordinal").alias("ordinal"), outcome.alias("outcome"), F.when(outcome == "applied", F.col("n.revision") + 1).alias("revision"), *row.values())


def instantiate(templates: DataFrame, requests: DataFrame) -> DataFrame:
    """Copies of templates for campaigns: id, template_id, campaign_id, and name, player_name, sheet and notes where given."""
    own = templates.where(F.col("campaign_id").isNull()).select(F.col("id").alias("template_id"), *[F.col(c).alias(f"t_{c}") for c in ("name", "player_name", "sheet", "notes")])
    return requests.join(own, "template_id").select("id", "template_id", "campaign_id", *[F.coalesce(c, f"t_{c}").alias(c) for c in ("name", "player_name", "sheet", "notes")], F.lit(1).alias("revision"))


def cascade_delete(gone: DataFrame, tables: dict[str, tuple[DataFrame, str]], key: str) -> dict[str, DataFrame]:
    """Every child table without the rows of deleted parents; tables are given as (rows, foreign key)."""
    return {name: rows.join(gone.select(F.col(key).alias(foreign)).distinct(), foreign, "left_anti") for name, (rows, foreign) in tables.items()}


def set_progress(progress: DataFrame, change: DataFrame) -> DataFrame:
    """Progress rows (scope_id, scene_id, status, progress, version) after changes with `expected` versions.

    Progress is held to 0 to 100; a scene made current ends the scope's other
    current scene; a change that expects another version isn't applied.
    """
    keys = ["scope_id", "scene_id"]
    new = change.select(*keys, F.col("status").alias("c_status"), F.greatest(F.lit(0), F.least(F.lit(100), F.col("progress"))).alias("c_progress"), "expected")
    both = progress.join(new, keys, "full_outer").withColumn("__ok", F.coalesce((F.col("expected").isNull() | (F.col("expected") == F.coalesce("version", F.lit(0)))) & F.col("c_status").isNotNull(), F.lit(False)))
    both = both.where(F.col("version").isNotNull() | F.col("__ok"))
    taken = both.where(F.col("__ok") & (F.col("c_status") == "current")).select("scope_id", F.col("scene_id").alias("__current"))
    own = both.join(taken.groupBy("scope_id").agg(F.max("__current").alias("__current")), "scope_id", "left")
    status = F.when(F.col("__ok"), F.col("c_status")).when((F.col("status") == "current") & F.col("__current").isNotNull() & (F.col("__current") != F.col("scene_id")), "visited").otherwise(F.col("status"))
    moved = F.col("__ok") | (status != F.col("status"))
    return own.select(*keys, status.alias("status"), F.when(F.col("__ok"), F.col("c_progress")).otherwise(F.col("progress")).alias("progress"), (F.coalesce("version", F.lit(0)) + moved.cast("int")).alias("version"))


def review_candidates(candidates: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(candidates after review, problems): job_id, id, review_status, disposition, artifact, edits.

    A decision names a candidate that must be there, and values of known kinds;
    a job with a problem keeps all its candidates as they were.  Each edit adds
    the digests before and after it to the history.
    """
    keys = ["job_id", "id"]
    known = candidates.select(*keys, F.lit(True).alias("__there"))
    checked = decisions.join(known, keys, "left")
    problem = (
        F.when(F.col("__there").isNull(), "unknown candidate")
        .when(~F.coalesce(F.col("review_status").isin(*REVIEWS), F.lit(False)), "unknown review status")
        .when(F.col("disposition").isNotNull() & ~F.col("disposition").isin(*DISPOSITIONS), "unknown disposition")
    )
    problems = checked.withColumn("problem", problem).where("problem is not null").select(*keys, "problem")
    good = decisions.join(problems.select("job_id").distinct(), "job_id", "left_anti")
    new = good.select(*keys, F.col("review_status").alias("r"), F.col("disposition").alias("d"), F.col("artifact").alias("a"))
    digest = lambda *c: F.sha2(F.to_json(F.struct(*[F.col(x).alias(n) for x, n in zip(c, ("artifact", "disposition", "review_status"))]), {"ignoreNullFields": "false"}), 256)
    own = candidates.join(new, keys, "left").withColumns({"__before": digest("artifact", "disposition", "review_status"), "n_a": F.coalesce("a", "artifact"), "n_d": F.coalesce("d", "disposition"), "n_r": F.coalesce("r", "review_status")})
    edit = F.struct(F.col("__before").alias("before"), digest("n_a", "n_d", "n_r").alias("after"))
    edits = F.when(F.col("r").isNotNull(), F.concat("edits", F.array(edit))).otherwise(F.col("edits"))
    return own.select(*keys, F.col("n_r").alias("review_status"), F.col("n_d").alias("disposition"), F.col("n_a").alias("artifact"), edits.alias("edits")), problems


def finalizable(candidates: DataFrame) -> DataFrame:
    """job_id of the jobs whose candidates are all included or excluded, and none is pending."""
    done = F.col("disposition").isin("include", "exclude") & F.col("review_status").isin("accepted", "rejected")
    return candidates.groupBy("job_id").agg(F.bool_and(F.coalesce(done, F.lit(False))).alias("done")).where("done").select("job_id")


def step_jobs(jobs: DataFrame, steps: DataFrame) -> DataFrame:
    """Jobs (job_id, state, revision) after steps (job_id, target, expected): job_id, state, revision and error."""
    pairs = [f"{a}>{b}" for a, nexts in TRANSITIONS.items() for b in nexts]
    own = jobs.join(steps, "job_id")
    error = F.when(F.col("expected").isNotNull() & (F.col("expected") != F.col("revision")), "another revision").when(~F.concat("state", F.lit(">"), "target").isin(*pairs), "no such transition")
    ok = error.isNull()
    return own.select("job_id", F.when(ok, F.col("target")).otherwise(F.col("state")).alias("state"), (F.col("revision") + ok.cast("int")).alias("revision"), error.alias("error"))
