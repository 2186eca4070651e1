"""Whole transactions over the commit log: branches, checkout, continuity commits and audited replacement of state.

Each reads the tables at one version, judges all that it is asked for, and
makes every table's change visible in one commit or none.  A writer that comes
late gets StaleVersion and reads again; a request with any refused row raises
Refused with its outcomes and writes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import facts, ledger, records
from palimpsest.plans import snapshots
from palimpsest.sources.commits import CommitLog, StaleVersion, View
from palimpsest.sources.tables import durable


class Refused(ValueError):
    """Some rows of a request can't be done; `outcomes` counts them by reason."""

    def __init__(self, outcomes: dict[str, int]):
        super().__init__(", ".join(f"{n} {k}" for k, n in sorted(outcomes.items())))
        self.outcomes = outcomes


def _view(log: CommitLog, expected: int) -> View:
    """All tables at the version that a transaction expects, from one scan of the manifests."""
    if log.version() != expected:
        raise StaleVersion(f"version {log.version()}, not {expected}")
    return log.view(expected)


def _all(judged: DataFrame, good: tuple[str, ...]) -> None:
    bad = judged.where(~F.col("outcome").isin(*good)).groupBy("outcome").count().collect()  # one row an outcome
    if bad:
        raise Refused({r.outcome: r["count"] for r in bad})


BRANCHES = "campaign_id string, branch_id string, name string, head_snapshot_id string"
HEADS = "branch_id string, memory_id string, revision long"
FACTS = "campaign_id string, fact_key string, memory_id string, kind string, subject string, subject_ref string, predicate string"
FACT_REVISIONS = "branch_id string, memory_id string, revision long, content string"
KNOWLEDGE = "branch_id string, actor_id string, knowledge_key string, proposition string"
EVENTS = "event_id string, campaign_id string, branch_id string, sequence long, content string, committed_snapshot_id string"
LOCKS = "campaign_id string, branch_id string, pack_id string, version string, checksum string"
GROUPS = "branch_id string, group_id string, author string"


def create_branch(log: CommitLog, expected: int, campaign: str, source: str, branch: str, name: str) -> int:
    """A branch with the source's head, fact heads, their revisions and rule locks; Refused where it is there or the source isn't."""
    held = _view(log, expected)
    branches = held.read("branches", BRANCHES).where(F.col("campaign_id") == campaign)
    there = {r.branch_id for r in branches.where(F.col("branch_id").isin(source, branch)).select("branch_id").collect()}  # two rows at most
    if branch in there or source not in there:
        raise Refused({"exists" if branch in there else "missing": 1})
    own = branches.where(F.col("branch_id") == source).withColumns({"branch_id": F.lit(branch), "name": F.lit(name)})
    tables = {"branches": own}
    for table, schema in (("fact_heads", HEADS), ("fact_revisions", FACT_REVISIONS), ("knowledge", KNOWLEDGE), ("locks", LOCKS)):
        tables[table] = ledger.copy_heads(held.read(table, schema), source, branch)
    return log.commit(tables, expected=expected, note=f"branch {branch} from {source}")


def commit_continuity(log: CommitLog, expected: int, *, events: DataFrame, new_facts: DataFrame, knowledge: DataFrame) -> int:
    """Events, facts and beliefs in one commit, all or nothing.

    events (event_id, campaign_id, branch_id, content, and ordinal, the order
    they were given in) are numbered on from their branch's last; new_facts as in `facts.add_facts` with content;
    knowledge (ordinal, campaign_id, branch_id, actor_id, knowledge_key,
    proposition, event_id) may cite events of this commit.
    """
    held = _view(log, expected)
    held_events = held.read("events", EVENTS)
    numbered = ledger.next_sequence(events, held_events, "branch_id", ["ordinal", "event_id"]).withColumn("committed_snapshot_id", F.lit(None).cast("string"))
    numbered = durable(numbered.select("event_id", "campaign_id", "branch_id", "sequence", "content", "committed_snapshot_id"))
    repeated = numbered.groupBy("event_id").agg(F.count("*").alias("n")).where("n > 1").select("event_id").unionByName(numbered.join(held_events.select("event_id"), "event_id", "left_semi").select("event_id"))
    _all(repeated.withColumn("outcome", F.lit("repeated event")), ())
    added = durable(facts.add_facts(held.read("facts", FACTS), held.read("fact_heads", HEADS), new_facts))
    _all(added, ("created", "headed"))
    heads = held.read("branches", BRANCHES).select("campaign_id", "branch_id", "head_snapshot_id")
    bound = held.read("snapshot_events", "snapshot_id string, event_id string")
    cited = facts.citable(knowledge.join(heads, ["campaign_id", "branch_id"], "left"), held_events.select(*numbered.columns).unionByName(numbered), bound)
    believed = durable(facts.add_knowledge(held.read("knowledge", KNOWLEDGE), cited))
    _all(believed, ("created",))
    first = F.lit(1).cast("long").alias("revision")
    tables = {
        "events": numbered,
        "facts": added.where("outcome = 'created'").select("campaign_id", "fact_key", "memory_id", *facts.IDENTITY),
        "fact_heads": added.select("branch_id", "memory_id", first),
        "fact_revisions": added.select("branch_id", "memory_id", first, "content"),
        "knowledge": believed.select("branch_id", "actor_id", "knowledge_key", "proposition"),
    }
    return log.commit(tables, expected=expected, note="continuity")


def replace_state(log: CommitLog, expected: int, changes: DataFrame, *, branch: str, group: str, author: str) -> int:
    """States replaced by compare-and-swap, with a mutation group and reversible revisions that hold what was and is.

    changes (entity_id, ordinal, expected, state) against `states` (entity_id, revision, state).
    """
    held = _view(log, expected)
    states = held.read("states", "entity_id string, revision long, state string")
    judged = durable(records.compare_and_swap(states, changes, "entity_id", ["state"]))
    _all(judged, ("applied",))
    before = ledger.latest(states, ["entity_id"], "revision").select("entity_id", F.col("state").alias("before"))
    revisions = held.read("revisions", "branch_id string, sequence long, group_id string, entity_id string, before string, after string, status string, reversible boolean")
    rows = judged.join(before, "entity_id").select(F.lit(branch).alias("branch_id"), F.lit(group).alias("group_id"), "entity_id", "before", F.col("state").alias("after"), F.lit("applied").alias("status"), F.lit(True).alias("reversible"))
    rows = ledger.next_sequence(rows, revisions, "branch_id", ["entity_id"])
    one = log.spark.createDataFrame([(branch, group, author)], GROUPS)
    return log.commit({"states": judged.select("entity_id", F.col("revision").cast("long").alias("revision"), "state"), "revisions": rows, "groups": one}, expected=expected, note=f"group {group}")


def checkout(log: CommitLog, expected: int, campaign: str, branch: str) -> int:
    """A branch's captured states made live, where the live ones are those of the branch that is left; revisions go on.

    Tables: active (campaign_id, branch_id, n), of which the greatest n holds;
    captures (branch_id, entity_id, revision, state); states as in
    `replace_state`.  States that differ from the capture of the active branch
    are refused as dirty.
    """
    held = _view(log, expected)
    active = held.read("active", "campaign_id string, branch_id string, n long").where(F.col("campaign_id") == campaign)
    now = active.agg(F.max_by("branch_id", "n").alias("branch_id"), F.max("n").alias("n")).first()
    captures = held.read("captures", "branch_id string, entity_id string, revision long, state string")
    live = ledger.latest(held.read("states", "entity_id string, revision long, state string"), ["entity_id"], "revision")
    left, goal = captures.where(F.col("branch_id") == F.lit(now.branch_id)), captures.where(F.col("branch_id") == branch)
    dirty = ledger.diff(live.select("entity_id", "state"), left.select("entity_id", "state"), ["entity_id"], "state").where("change <> 'unchanged'")
    _all(dirty.withColumn("outcome", F.lit("dirty")), ())
    if goal.isEmpty():
        raise Refused({"missing": 1})
    restored = snapshots.restore(live, goal.drop("branch_id"), "entity_id", "revision").select("entity_id", "revision", "state")
    one = log.spark.createDataFrame([(campaign, branch, (now.n or 0) + 1)], "campaign_id string, branch_id string, n long")
    return log.commit({"states": restored, "active": one}, expected=expected, replace=("states",), note=f"checkout {branch}")
