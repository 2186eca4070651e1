"""Snapshots bound to the ledgers, and whole campaigns put back to one, over the commit log.

A snapshot holds no copies of events and facts: it binds the events that its
branch sees and the revision of each fact head; states and the rule profile,
which have no ledger of their own, are captured.  Every operation reads all
tables at one version and changes them in one commit, or raises Refused.

Tables beside those of `transactions`: snapshots (campaign_id, snapshot_id,
branch_id, parent_id, label), snapshot_events, snapshot_facts, snapshot_states,
snapshot_profiles, snapshot_digests, event_commits (event_id, snapshot_id: the
first snapshot that holds the event), profiles (campaign_id, n, profile).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import ledger
from palimpsest.plans.transactions import BRANCHES, EVENTS, FACT_REVISIONS, HEADS, Refused, _view
from palimpsest.sources.commits import CommitLog, View
from palimpsest.sources.tables import dealt, durable

SNAPSHOTS = "campaign_id string, snapshot_id string, branch_id string, parent_id string, label string"
SNAPSHOT_EVENTS = "snapshot_id string, event_id string"
SNAPSHOT_FACTS = "snapshot_id string, memory_id string, revision long"
SNAPSHOT_STATES = "snapshot_id string, entity_id string, state string"
SNAPSHOT_PROFILES = "snapshot_id string, profile string"
SNAPSHOT_DIGESTS = "snapshot_id string, collection string, rows long, digest string"
STATES = "entity_id string, revision long, state string"
PROFILES = "campaign_id string, n long, profile string"
ACTIVE = "campaign_id string, branch_id string, n long"
#: Fields of a rule profile that a snapshot holds, exactly these; fixed values.
PROFILE_FIELDS = ("system_id", "edition", "locale", "publications", "options")
COLLECTIONS = ("events", "facts", "profile", "states")


def digest(rows: DataFrame, columns: list[str]) -> DataFrame:
    """rows and digest of a multiset of rows: sums of parts of their hashes, so nothing is ordered or gathered."""
    sha = F.sha2(F.to_json(F.struct(*[F.col(c).cast("string").alias(c) for c in columns]), {"ignoreNullFields": "false"}), 256)
    parts = [F.coalesce(F.sum(F.conv(F.substring(sha, 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string") for k in range(4)]
    return rows.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(",", *parts), 256).alias("digest"))


def _rows(view: View, *tables: str) -> int:
    """Rows of tables, as their files tell."""
    return sum(view.read(t).count() for t in tables if view.files.get(t))


def _events(view: View) -> DataFrame:
    """Events with the first snapshot that holds each, dealt by event."""
    n = _rows(view, "events", "event_commits")
    stamps = dealt(view.read("event_commits", SNAPSHOT_EVENTS), "event_id", rows=n).groupBy("event_id").agg(F.min("snapshot_id").alias("stamp"))
    return dealt(view.read("events", EVENTS), "event_id", rows=n).join(stamps, "event_id", "left").withColumn("committed_snapshot_id", F.coalesce("committed_snapshot_id", "stamp")).drop("stamp")


def _branch(view: View, campaign: str, branch: str):
    found = view.read("branches", BRANCHES).where((F.col("campaign_id") == campaign) & (F.col("branch_id") == branch)).first()
    if found is None:
        raise Refused({"missing branch": 1})
    return found


def _profile(view: View, campaign: str) -> str | None:
    return view.read("profiles", PROFILES).where(F.col("campaign_id") == campaign).agg(F.max_by("profile", "n")).first()[0]


def live(view: View, campaign: str, branch: str) -> dict[str, DataFrame]:
    """What a snapshot of the branch would hold now, by collection."""
    head = _branch(view, campaign, branch).head_snapshot_id
    events = ledger.visible_events(_events(view).where(F.col("campaign_id") == campaign), view.read("snapshot_events", SNAPSHOT_EVENTS), branch, head)
    heads = ledger.latest(dealt(view.read("fact_heads", HEADS).where(F.col("branch_id") == branch), "memory_id", rows=_rows(view, "fact_heads")), ["memory_id"], "revision")
    states = dealt(view.read("states", STATES), "entity_id", rows=_rows(view, "states"))
    profile = view.spark.createDataFrame([(_profile(view, campaign),)], "profile string").where("profile is not null")
    return {
        "events": events.select("event_id", "branch_id", "committed_snapshot_id"),
        "facts": heads.select("memory_id", "revision"),
        "states": ledger.latest(states, ["entity_id"], "revision").select("entity_id", "state"),
        "profile": profile,
    }


#: Tables whose rows a branch and its snapshots have, by collection.
SIZES = {"events": ("events", "snapshot_events"), "facts": ("fact_heads", "snapshot_facts"), "states": ("states", "snapshot_states"), "profile": ("profiles",)}
COLUMNS = {"events": ["event_id"], "facts": ["memory_id", "revision"], "states": ["entity_id", "state"], "profile": ["profile"]}


def held(view: View, snapshot: str) -> dict[str, DataFrame]:
    """What a snapshot holds, by collection."""
    tables = {"events": ("snapshot_events", SNAPSHOT_EVENTS), "facts": ("snapshot_facts", SNAPSHOT_FACTS), "states": ("snapshot_states", SNAPSHOT_STATES), "profile": ("snapshot_profiles", SNAPSHOT_PROFILES)}
    return {c: view.read(t, s).where(F.col("snapshot_id") == snapshot).drop("snapshot_id") for c, (t, s) in tables.items()}


def digests(collections: dict[str, DataFrame]) -> DataFrame:
    """collection, rows and digest."""
    out = None
    for name in COLLECTIONS:
        one = digest(collections[name], COLUMNS[name]).select(F.lit(name).alias("collection"), "rows", "digest")
        out = one if out is None else out.unionByName(one)
    return out


def _bound(view: View, campaign: str, branch: str, snapshot: str, parent: str | None, label: str, own: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables that a new snapshot of these collections adds."""
    named = lambda df, *columns: df.select(F.lit(snapshot).alias("snapshot_id"), *columns)
    fresh = own["events"].where((F.col("branch_id") == branch) & F.col("committed_snapshot_id").isNull())
    return {
        "snapshots": view.spark.createDataFrame([(campaign, snapshot, branch, parent, label)], SNAPSHOTS),
        "snapshot_events": named(own["events"], "event_id"),
        "event_commits": fresh.select("event_id", F.lit(snapshot).alias("snapshot_id")),
        "snapshot_facts": named(own["facts"], "memory_id", F.col("revision").cast("long").alias("revision")),
        "snapshot_states": named(own["states"], "entity_id", "state"),
        "snapshot_profiles": named(own["profile"], "profile"),
        "snapshot_digests": named(digests(own), "collection", "rows", "digest"),
    }


def _heads(view: View, campaign: str, branch: str, head: Column) -> DataFrame:
    """All branches, one of them with another head."""
    own = (F.col("campaign_id") == campaign) & (F.col("branch_id") == branch)
    return durable(view.read("branches", BRANCHES).withColumn("head_snapshot_id", F.when(own, head).otherwise(F.col("head_snapshot_id"))))


def _new(view: View, snapshot: str) -> None:
    if not view.read("snapshots", SNAPSHOTS).where(F.col("snapshot_id") == snapshot).isEmpty():
        raise Refused({"snapshot exists": 1})


def create_snapshot(log: CommitLog, expected: int, campaign: str, branch: str, snapshot: str, label: str) -> int:
    """A snapshot of the branch as it is, a child of the branch's head, and its new head."""
    view = _view(log, expected)
    _new(view, snapshot)
    parent = _branch(view, campaign, branch).head_snapshot_id
    own = {c: durable(df) for c, df in live(view, campaign, branch).items()}
    tables = _bound(view, campaign, branch, snapshot, parent, label, own) | {"branches": _heads(view, campaign, branch, F.lit(snapshot))}
    return log.commit(tables, expected=expected, replace=("branches",), note=f"snapshot {snapshot}")


def dirty(view: View, campaign: str, branch: str) -> dict[str, int]:
    """Collections of the branch that aren't as its head holds them, with how many rows differ."""
    now, then = live(view, campaign, branch), held(view, _branch(view, campaign, branch).head_snapshot_id or "")
    counts = {}
    for name in COLLECTIONS:
        columns = COLUMNS[name]
        both = now[name].select(*columns, F.lit(1).alias("by")).unionByName(then[name].select(*columns, F.lit(-1).alias("by")))
        n = dealt(both, *columns, rows=_rows(view, *SIZES[name])).groupBy(*columns).agg(F.sum("by").alias("by")).where("by <> 0").count()
        if n:
            counts[f"dirty {name}"] = n
    return counts


def verify(log: CommitLog, snapshot: str, version: int | None = None) -> DataFrame:
    """collection and problem of what isn't as it was bound: digests, missing ledger rows, and ancestors that aren't there.

    A sound snapshot gives no rows; an unknown one gives the problem `missing`.
    """
    view = log.view(version)
    own, stored = held(view, snapshot), view.read("snapshot_digests", SNAPSHOT_DIGESTS).where(F.col("snapshot_id") == snapshot)
    now = digests(own)
    differs = now.join(stored.select("collection", F.col("digest").alias("stored"), F.col("rows").alias("n")), "collection", "left")
    problem = F.when(F.col("stored").isNull(), "missing").when((F.col("stored") != F.col("digest")) | (F.col("n") != F.col("rows")), "digest differs")
    found = differs.select("collection", problem.alias("problem")).where("problem is not null")
    events = dealt(own["events"], "event_id", rows=_rows(view, *SIZES["events"])).join(view.read("events", EVENTS).select("event_id"), "event_id", "left_anti")
    revision, n = ["memory_id", "revision"], _rows(view, "fact_revisions", "snapshot_facts")
    facts = dealt(own["facts"], *revision, rows=n).join(dealt(view.read("fact_revisions", FACT_REVISIONS).select(*revision), *revision, rows=n), revision, "left_anti")
    snapshots = view.read("snapshots", SNAPSHOTS)
    parents = snapshots.where((F.col("snapshot_id") == snapshot) & F.col("parent_id").isNotNull()).join(snapshots.select(F.col("snapshot_id").alias("parent_id")), "parent_id", "left_anti")
    for name, df, why in (("events", events, "no such event"), ("facts", facts, "no such revision"), ("snapshots", parents, "no such parent")):
        found = found.unionByName(df.select(F.lit(name).alias("collection"), F.lit(why).alias("problem")).distinct())
    return found


def _put_back(view: View, branch: str, goal: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """states and fact_heads that make the branch what `goal` holds; state revisions only go forward, other branches stay."""
    top = dealt(view.read("states", STATES), "entity_id", rows=_rows(view, "states")).groupBy("entity_id").agg(F.max("revision").alias("top"))
    states = goal["states"].join(top, "entity_id", "left").select("entity_id", (F.coalesce("top", F.lit(0)) + 1).cast("long").alias("revision"), "state")
    others = view.read("fact_heads", HEADS).where(F.col("branch_id") != branch)
    heads = others.unionByName(goal["facts"].select(F.lit(branch).alias("branch_id"), "memory_id", F.col("revision").cast("long").alias("revision")))
    return {"states": durable(states), "fact_heads": durable(heads)}


def restore(log: CommitLog, expected: int, campaign: str, branch: str, snapshot: str) -> int:
    """The branch as a snapshot of its campaign holds it: heads, states, profile and the events it sees.

    Refused where the branch has changes that no snapshot holds, or where the
    snapshot isn't there or isn't sound.  Later events and revisions stay in
    their ledgers; the branch just doesn't see them.
    """
    view = _view(log, expected)
    if view.read("snapshots", SNAPSHOTS).where((F.col("snapshot_id") == snapshot) & (F.col("campaign_id") == campaign)).isEmpty():
        raise Refused({"missing snapshot": 1})
    if unsaved := dirty(view, campaign, branch):
        raise Refused(unsaved)
    if bad := verify(log, snapshot, expected).groupBy("problem").count().collect():
        raise Refused({r.problem: r["count"] for r in bad})
    goal = {c: durable(df) for c, df in held(view, snapshot).items()}
    n = view.read("profiles", PROFILES).where(F.col("campaign_id") == campaign).agg(F.coalesce(F.max("n"), F.lit(0)) + 1).first()[0]
    tables = _put_back(view, branch, goal) | {
        "profiles": goal["profile"].select(F.lit(campaign).alias("campaign_id"), F.lit(n).cast("long").alias("n"), "profile"),
        "branches": _heads(view, campaign, branch, F.lit(snapshot)),
    }
    return log.commit(tables, expected=expected, replace=("states", "fact_heads", "branches"), note=f"restore {snapshot}")


def restore_converted(log: CommitLog, expected: int, campaign: str, snapshot: str, *, profile: dict[str, str], source: str, branch: str, name: str, child: str, label: str) -> int:
    """A new branch from a snapshot with another rule profile, captured at once as a child of the snapshot, which stays as it is.

    `profile` has exactly the fields of a snapshot's profile and the system of
    the one it replaces.  `source` is the active branch, which must be clean.
    Refused without a name or label, where the branch or the child is there
    already, or where the snapshot holds no profile.
    """
    view = _view(log, expected)
    if not name.strip() or not label.strip() or set(profile) != set(PROFILE_FIELDS):
        raise Refused({"malformed": 1})
    _new(view, child)
    branches = view.read("branches", BRANCHES)
    if not branches.where((F.col("campaign_id") == campaign) & (F.col("branch_id") == branch)).isEmpty():
        raise Refused({"branch exists": 1})
    if view.read("snapshots", SNAPSHOTS).where((F.col("snapshot_id") == snapshot) & (F.col("campaign_id") == campaign)).isEmpty():
        raise Refused({"missing snapshot": 1})
    if unsaved := dirty(view, campaign, source):
        raise Refused(unsaved)
    goal = {c: durable(df) for c, df in held(view, snapshot).items()}
    before = goal["profile"].select(F.get_json_object("profile", "$.system_id")).first()
    if before is None or before[0] != profile["system_id"]:
        raise Refused({"no profile" if before is None else "another system": 1})
    json = F.to_json(F.create_map(*[F.lit(x) for k in PROFILE_FIELDS for x in (k, profile[k])]))
    changed = goal | {"profile": durable(view.spark.range(1).select(json.alias("profile")))}
    changed["events"] = goal["events"].select("event_id", F.lit(None).cast("string").alias("branch_id"), F.lit(snapshot).alias("committed_snapshot_id"))
    n = view.read("profiles", PROFILES).where(F.col("campaign_id") == campaign).agg(F.coalesce(F.max("n"), F.lit(0)) + 1).first()[0]
    turn = view.read("active", ACTIVE).where(F.col("campaign_id") == campaign).agg(F.coalesce(F.max("n"), F.lit(0)) + 1).first()[0]
    spark = view.spark
    tables = _put_back(view, branch, goal) | _bound(view, campaign, branch, child, snapshot, label, changed) | {
        "profiles": changed["profile"].select(F.lit(campaign).alias("campaign_id"), F.lit(n).cast("long").alias("n"), "profile"),
        "branches": durable(branches.unionByName(spark.createDataFrame([(campaign, branch, name.strip(), child)], BRANCHES))),
        "active": spark.createDataFrame([(campaign, branch, turn)], ACTIVE),
    }
    return log.commit(tables, expected=expected, replace=("states", "fact_heads", "branches"), note=f"convert {snapshot}")
