"""Versioned ledgers: append-only revisions, branch heads, events and snapshots.

Mutable rows are revisions; what is current follows from a head table or from
the greatest version, by an aggregation that combines before it shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.scoring import lexical_score
from palimpsest.functions.text import terms
from palimpsest.sources.tables import durable

#: Vocabularies of visibility.
PLAYER_EVENTS = ("public", "party", "player")
PLAYER_FACTS = ("public", "party", "player")
PLAYER_KNOWLEDGE = ("owner", "party", "public", "player")
PLAYER_MODULES = ("group", "public")
INACTIVE_KNOWLEDGE = ("forgotten", "superseded")
#: Bounds of lists and budgets.
TAIL_MOST, SEARCH_MOST, BUDGET_LEAST, BUDGET_MOST, PINNED_MOST = 500, 100, 1_000, 100_000, 100_000


def latest(revisions: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the greatest version of each key; ties go to the greatest row."""
    rest = [c for c in revisions.columns if c not in keys]
    row = F.struct(version, *[c for c in rest if c != version])
    return revisions.groupBy(*keys).agg(F.max(row).alias("r")).select(*keys, *[F.col(f"r.{c}") for c in rest])


def at_head(heads: DataFrame, revisions: DataFrame, branch: str, *, revision_id: str = "revision_id") -> DataFrame:
    """Revisions that a branch's heads point to."""
    own = heads.where(F.col("branch_id") == branch).select(revision_id)
    return revisions.join(own, revision_id, "left_semi")


def visible_events(events: DataFrame, bindings: DataFrame, branch: str, head_snapshot: str | None, *, event_id: str = "event_id") -> DataFrame:
    """Events bound to the branch's head snapshot, and those of the branch that no snapshot holds yet; each once."""
    bound = bindings.where(F.col("snapshot_id").eqNullSafe(F.lit(head_snapshot))).select(F.col("event_id").alias(event_id), F.lit(True).alias("__bound"))
    fresh = (F.col("branch_id") == branch) & F.col("committed_snapshot_id").isNull()
    # One join and no union, so that copies are dropped where the join has brought them together.
    return events.join(bound, event_id, "left").where(F.col("__bound").isNotNull() | fresh).drop("__bound").dropDuplicates([event_id])


def tail(events: DataFrame, limit: int, order: list[str]) -> DataFrame:
    """The last rows of a ledger in ascending order; a bounded top-k, not a sort of all."""
    n = max(1, min(limit, TAIL_MOST))
    return events.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def audience_events(events: DataFrame, audience: str, known: DataFrame | None = None, *, event_id: str = "event_id") -> DataFrame:
    """Events an audience may see: all for dm; public scopes, and actor scope where `known` holds the event, for players."""
    if audience == "dm":
        return events
    if audience != "player":
        raise ValueError("audience is dm or player")
    if known is None:
        return events.where(F.col("audience_scope").isin(*PLAYER_EVENTS))
    marked = events.join(known.select(event_id).distinct().withColumn("__known", F.lit(True)), event_id, "left")
    seen = F.col("audience_scope").isin(*PLAYER_EVENTS) | ((F.col("audience_scope") == "actor") & F.coalesce("__known", F.lit(False)))
    return marked.where(seen).drop("__known")


def actor_known_events(knowledge: DataFrame, participants: DataFrame, actor: str) -> DataFrame:
    """Events an actor knows of: cited by their visible knowledge, or taken part in."""
    cited = knowledge.where((F.col("actor_id") == actor) & F.col("source_event_id").isNotNull() & F.col("disclosure_scope").isin(*PLAYER_KNOWLEDGE)).select(F.col("source_event_id").alias("event_id"))
    return cited.unionByName(participants.where(F.col("actor_id") == actor).select("event_id")).distinct()


def for_actor(events: DataFrame, participants: DataFrame, actor: str, roles: list[str]) -> DataFrame:
    return events.join(participants.where((F.col("actor_id") == actor) & F.col("role").isin(*roles)), "event_id", "left_semi")


def participant_map(participants: DataFrame, event_id: str, role: str, actor: str) -> DataFrame:
    """event_id and its distinct (role, actor), sorted."""
    return participants.groupBy(event_id).agg(F.array_sort(F.collect_set(F.struct(F.col(role).alias("role"), F.col(actor).alias("actor")))).alias("participants"))


def next_sequence(rows: DataFrame, ledger: DataFrame, partition: str, order: list[str]) -> DataFrame:
    """Number new rows of each partition on from its greatest sequence."""
    top = ledger.groupBy(partition).agg(F.max("sequence").alias("__top"))
    n = F.row_number().over(Window.partitionBy(partition).orderBy(*order))
    return rows.join(top, partition, "left").withColumn("sequence", F.coalesce("__top", F.lit(0)) + n).drop("__top")


def diff(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys and change: left_only, right_only, changed or unchanged."""
    a, b = left.select(*keys, F.col(value).alias("a"), F.lit(True).alias("in_a")), right.select(*keys, F.col(value).alias("b"), F.lit(True).alias("in_b"))
    change = F.when(F.col("in_b").isNull(), "left_only").when(F.col("in_a").isNull(), "right_only").when(F.col("a").eqNullSafe(F.col("b")), "unchanged").otherwise("changed")
    return a.join(b, keys, "full_outer").select(*keys, change.alias("change"))


def compare_branches(heads: dict[str, tuple[DataFrame, DataFrame, str, str]]) -> DataFrame:
    """ledger, key and change of every ledger's heads, given as (left, right, key, value); unchanged keys are left out."""
    out = None
    for ledger, (left, right, key, value) in heads.items():
        one = diff(left, right, [key], value).select(F.lit(ledger).alias("ledger"), F.col(key).cast("string").alias("key"), "change")
        out = one if out is None else out.unionByName(one)
    return out.where("change <> 'unchanged'")


def lineage(snapshots: DataFrame, start: str, *, node: str = "id", parent: str = "parent_id", owner: str | None = None) -> DataFrame:
    """node, depth (0 at the start) and error of the walk to the root.

    A parent seen before ends the walk with the error `cycle`, one that isn't
    there with `missing`, one of another owner with `foreign`.  Jumps are doubled
    round by round, and each round joins the nodes reached so far with the jumps
    of their length, so a walk of n nodes takes log2(n) rounds, however deep.
    """
    own = F.col(owner).cast("string") if owner else F.lit(None).cast("string")
    nodes = snapshots.select(F.col(node).cast("string").alias("id"), F.col(parent).cast("string").alias("parent"), own.alias("owner")).where("id is not null")
    above = nodes.select(F.col("id").alias("parent"), F.col("owner").alias("parents_owner"), F.lit(True).alias("there"))
    steps = nodes.join(above, "parent", "left").where("parent is not null")
    error = F.when(F.col("there").isNull(), "missing").when(~F.col("owner").eqNullSafe(F.col("parents_owner")), "foreign")
    steps = durable(steps.select("id", F.col("parent").alias("to"), error.alias("error")))
    most = steps.count() + 1
    # A jump leads `size` steps up; one that meets an error or passes the root before that is none.
    jumps, size = steps.where("error is null").select("id", "to"), 1
    walk = durable(nodes.where(F.col("id") == str(start)).select("id", F.lit(0).cast("long").alias("depth")).distinct())
    while size <= most:
        more = durable(walk.join(jumps, "id").select(F.col("to").alias("id"), (F.col("depth") + size).alias("depth")))
        if more.isEmpty() and size > 1:
            break
        walk = durable(walk.unionByName(more))
        further = jumps.select(F.col("id").alias("to"), F.col("to").alias("beyond"))
        jumps, size = durable(jumps.join(further, "to").select("id", F.col("beyond").alias("to"))), 2 * size
    # The first time that a node is met counts; a node met again ends the walk one step after the last new one.
    met = walk.groupBy("id").agg(F.min("depth").alias("depth"))
    last = met.orderBy(F.desc("depth")).limit(1)
    ended = last.join(steps, "id").select(F.col("to").alias("id"), (F.col("depth") + 1).cast("int").alias("depth"), F.coalesce("error", F.lit("cycle")).alias("error"))
    found = met.select("id", F.col("depth").cast("int").alias("depth"), F.lit(None).cast("string").alias("error"))
    return found.unionByName(ended).withColumnRenamed("id", node)


def scoped(progress: DataFrame, scope: str, keys: list[str], *, fallback: str | None = "party", order: list[str] | None = None) -> DataFrame:
    """One row of each key: that of the scope, else that of the fallback scope; then by `order`, latest first."""
    own = progress.where(F.col("scope_id").isin(*[s for s in (scope, fallback) if s]))
    place = [F.desc(F.col("scope_id") == scope), *[F.desc(c) for c in order or []]]
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*place))
    return own.withColumn("__n", n).where("__n = 1").drop("__n")


def current_scene(progress: DataFrame, scope: str, *, fallback: bool = True) -> DataFrame:
    """The current scene of a scope, else of the party; the latest by updated_at and id, as a greatest row, so no task sorts all."""
    own = progress.where((F.col("status") == "current") & F.col("scope_id").isin(*dict.fromkeys([scope, *(["party"] if fallback else [])])))
    best = F.max_by(F.struct(*[F.col(c) for c in own.columns]), F.struct(F.col("scope_id") == scope, "updated_at", "id"))
    return own.agg(best.alias("r")).where("r is not null").select("r.*")


def orphans(references: DataFrame, targets: DataFrame, reference: str, target: str) -> DataFrame:
    """References, each as often as it is there, to what isn't there."""
    return references.where(F.col(reference).isNotNull()).join(targets.select(F.col(target).alias(reference)).distinct(), reference, "left_anti")


def diagnostics(facts: DataFrame, knowledge: DataFrame, branch_events: DataFrame, all_events: DataFrame, snapshots: DataFrame) -> DataFrame:
    """One row of ledger health: totals, active and inactive rows, orphan references, sequence and snapshot heads."""
    ids = all_events.select(F.col("event_id").alias("ref")).distinct()
    refs = facts.select(F.explode("source_event_ids").alias("ref")).join(ids, "ref", "left_anti")
    cited = knowledge.where(F.col("source_event_id").isNotNull()).select(F.col("source_event_id").alias("ref")).join(ids, "ref", "left_anti")
    f = facts.agg(F.count("*").alias("facts_total"), F.count_if(F.col("status") == "active").alias("facts_active"))
    k = knowledge.agg(F.count("*").alias("knowledge_total"), F.count_if(F.col("epistemic_status").isin(*INACTIVE_KNOWLEDGE)).alias("knowledge_inactive"))
    e = branch_events.agg(F.count("*").alias("events_total"), F.count_if(F.col("committed_snapshot_id").isNull()).alias("events_unsnapshotted"), F.coalesce(F.max("sequence"), F.lit(0)).alias("latest_sequence"))
    s = snapshots.agg(F.count("*").alias("snapshots_total"), F.max_by("id", "slot").alias("latest_id"), F.max("slot").alias("latest_slot"))
    base = f.select("facts_total", "facts_active", (F.col("facts_total") - F.col("facts_active")).alias("facts_inactive"))
    return base.withColumns({
        "orphan_fact_refs": refs.select(F.count("*")).scalar(), "orphan_knowledge_refs": cited.select(F.count("*")).scalar(),
        **{c: k.select(c).scalar() for c in k.columns}, **{c: e.select(c).scalar() for c in e.columns}, **{c: s.select(c).scalar() for c in s.columns},
    })


def recap(before: DataFrame, after: DataFrame, key: str, value: str, scope: str | None = None) -> DataFrame:
    """What changed between two captures, for players: key, change, and both values; only disclosed rows count as added."""
    a = before.select(key, F.col(value).alias("before"), F.lit(True).alias("__had"))
    b = after.select(key, F.col(value).alias("after"), (F.col(scope) if scope else F.lit("public")).alias("scope"), F.lit(True).alias("__has"))
    both = a.join(b, key, "full_outer")
    # A null value is a value: only rows that weren't there are added, only those that are gone removed.
    change = F.when(F.col("__had").isNull(), "added").when(F.col("__has").isNull(), "removed").when(~F.col("before").eqNullSafe(F.col("after")), "changed")
    return both.withColumn("change", change).where(F.col("change").isNotNull() & (F.col("scope").isNull() | F.col("scope").isin(*PLAYER_FACTS))).select(key, "change", "before", "after")


def ledger_search(rows: DataFrame, query: str, limit: int, *, title: Column, content: Column, order: list[str]) -> DataFrame:
    """The best rows by lexical score, then by `order`; limits are held to 1 to 100."""
    k = max(1, min(limit, SEARCH_MOST))
    cols = [F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order]
    return rows.withColumn("score", F.round(lexical_score(terms(F.lit(query)), title, content), 6)).orderBy(F.desc("score"), *cols).limit(k)


def recency(position: Column, size: Column) -> Column:
    return (position + 1) / F.greatest(size, F.lit(1)) / 10


def budget_fold(candidates: DataFrame, keys: list[str], *, budget: int, reserved: int = 0, score: str = "score", ledger: str = "ledger", index: str = "index", size: str = "size", item: str = "item") -> DataFrame:
    """keys and picked, (ledger, index, item, size) in order: items by score that still fit; too large ones are passed over.

    The budget is held to 1,000 to 100,000 characters; what is reserved comes
    off it.  One request's candidates are gathered in one array: they are top-k
    lists, bounded by the caller's limits.
    """
    if reserved > PINNED_MOST:
        raise ValueError("pinned evidence exceeds its bound")
    room = max(0, max(BUDGET_LEAST, min(int(budget), BUDGET_MOST)) - max(0, reserved))
    row = F.struct((-F.col(score)).alias("s"), F.col(ledger).alias("ledger"), F.col(index).alias("index"), F.col(item).alias("item"), F.col(size).cast("long").alias("size"))
    gathered = candidates.groupBy(*keys).agg(F.array_sort(F.collect_list(row)).alias("all"))
    kind = gathered.schema["all"].dataType.simpleString()
    start = F.struct(F.lit(0).cast("long").alias("used"), F.expr(f"cast(array() as {kind})").alias("out"))
    step = lambda acc, x: F.when(acc["used"] + x["size"] <= room, F.struct((acc["used"] + x["size"]).alias("used"), F.concat(acc["out"], F.array(x)).alias("out"))).otherwise(acc)
    return gathered.select(*keys, F.aggregate("all", start, step).alias("r")).select(*keys, F.col("r.used").alias("used"), F.transform("r.out", lambda x: F.struct(x["ledger"], x["index"], x["item"], x["size"])).alias("picked"))


def undo_group(revisions: DataFrame, branch: str) -> DataFrame:
    """The revisions of the latest applied reversible group, last first: the order in which `before` is restored."""
    own = revisions.where((F.col("branch_id") == branch) & (F.col("status") == "applied") & F.col("reversible"))
    top = own.agg(F.max_by("group_id", "sequence").alias("g"))
    return own.where(F.col("group_id") == top.select("g").scalar()).orderBy(F.desc("sequence"))


def redo_group(revisions: DataFrame, branch: str) -> DataFrame:
    """The first undone group after the cursor, the latest applied revision, in order."""
    own = revisions.where(F.col("branch_id") == branch)
    cursor = own.where(F.col("status") == "applied").agg(F.coalesce(F.max("sequence"), F.lit(0)).alias("c"))
    groups = own.where(F.col("status") == "undone").groupBy("group_id").agg(F.min("sequence").alias("first"))
    first = groups.where(F.col("first") > cursor.select("c").scalar()).agg(F.min_by("group_id", F.struct("first", "group_id")).alias("g"))
    return own.where(F.col("group_id") == first.select("g").scalar()).orderBy("sequence")


def history(revisions: DataFrame, limit: int) -> DataFrame:
    return revisions.orderBy(F.desc("sequence")).limit(max(1, min(limit, TAIL_MOST)))


def merge_edges(base: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Edges (a, b, bidirectional, ordinal, ...) by undirected pair where both ways are open; reviewed ones and later ones win."""
    every = base.withColumn("__level", F.lit(0)).unionByName(reviewed.withColumn("__level", F.lit(1)))
    both = F.col("bidirectional")
    keyed = every.withColumns({"__x": F.when(both, F.least("a", "b")).otherwise(F.col("a")), "__y": F.when(both, F.greatest("a", "b")).otherwise(F.col("b"))})
    columns = base.columns
    return keyed.groupBy("__x", "__y", "bidirectional").agg(F.max_by(F.struct(*columns), F.struct("__level", "ordinal")).alias("e")).select("e.*")


def occurrence_keys(rows: DataFrame, by: list[str], key: str, order: list[str]) -> DataFrame:
    """Repeated keys get --2, --3 and so on, in order."""
    n = F.row_number().over(Window.partitionBy(*by, key).orderBy(*order))
    return rows.withColumn("stable_key", F.when(n == 1, F.col(key)).otherwise(F.concat(F.col(key), F.lit("--"), n.cast("string"))))


def copy_heads(heads: DataFrame, source: str, branch: str) -> DataFrame:
    """Heads of a new branch: those of the source."""
    return heads.where(F.col("branch_id") == source).withColumn("branch_id", F.lit(branch))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Number rows from 1 in an order of all of them: dealt out by range, each partition going on from those before it."""
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = durable(dealt.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))  # one row a partition
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.join(sizes.select("__part", before.alias("__before")), "__part").withColumn(name, F.col("__at") + F.col("__before") + 1).drop("__part", "__at", "__before")


def copy_revisions(revisions: DataFrame, branch: str, first: int) -> DataFrame:
    """A reversible cursor on a new branch: new ids, sequence on from `first`, parents among the copies."""
    own = numbered(revisions, ["sequence", "id"], "__n")
    own = own.withColumn("__new", F.concat(F.lit(f"{branch}:"), F.col("id"))).withColumn("sequence", F.col("__n") + first)
    ids = own.select(F.col("id").alias("parent_id"), F.col("__new").alias("__parent"))
    return own.join(ids, "parent_id", "left").withColumns({"id": F.col("__new"), "parent_id": F.col("__parent"), "branch_id": F.lit(branch)}).drop("__new", "__parent", "__n")


def player_scene(scene: DataFrame) -> DataFrame:
    """A scene as players see it: a restricted one loses its prose."""
    shown = F.col("visibility").isin(*PLAYER_MODULES)
    return scene.withColumns({c: F.when(shown, F.col(c)) for c in ("content", "summary") if c in scene.columns})


def migrate_progress(progress: DataFrame, old: DataFrame, new: DataFrame, remaps: DataFrame | None = None) -> DataFrame:
    """Progress of replaced scenes on the new revision's: by explicit ruling, else by stable key; `error` where neither holds.

    `old` and `new` have (scene_id, stable_key); `remaps` has (old_scene_id, new_scene_id).
    """
    keyed = progress.join(old.select("scene_id", "stable_key"), "scene_id", "left").join(new.select(F.col("scene_id").alias("by_key"), "stable_key"), "stable_key", "left")
    if remaps is not None:
        keyed = keyed.join(remaps.select(F.col("old_scene_id").alias("scene_id"), F.col("new_scene_id").alias("ruled")), "scene_id", "left")
    else:
        keyed = keyed.withColumn("ruled", F.lit(None).cast("string"))
    target = F.coalesce("ruled", "by_key")
    n = F.count(target).over(Window.partitionBy(target, "scope_id"))
    error = F.when(target.isNull(), "unmapped").when(n > 1, "conflict")
    return keyed.select("scope_id", F.col("scene_id").alias("old_scene_id"), target.alias("new_scene_id"), error.alias("error"))


def counts_per_parent(parents: DataFrame, children: dict[str, DataFrame], key: str) -> DataFrame:
    """Row counts of several child tables by parent, 0 where there are none."""
    out = parents
    for name, child in children.items():
        out = out.join(child.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def module_evidence(anchors: DataFrame, chunks: DataFrame, refs: list[str]) -> DataFrame:
    """chunk_id, excerpt and anchors: bound excerpts, still in their chunks, of anchors that share a reference with the active ones."""
    from palimpsest.functions.text import normalize_evidence

    active = anchors.where(F.arrays_overlap("related_refs", F.array(*map(F.lit, refs)))).select("anchor_id", F.explode("bindings").alias("b"))
    bound = active.select("anchor_id", "b.chunk_id", "b.excerpt").join(chunks.select("chunk_id", "content"), "chunk_id")
    held = bound.where(F.contains(normalize_evidence(F.col("content")), normalize_evidence(F.col("excerpt"))))
    return held.groupBy("chunk_id", "excerpt").agg(F.array_sort(F.collect_set("anchor_id")).alias("anchors"))


def snapshot_violations(payload: DataFrame, bindings: DataFrame, kind: str) -> DataFrame:
    """snapshot_id, kind, id and problem: what a snapshot's payload names and its bindings don't, and the other way round."""
    both = payload.select("snapshot_id", "id", F.lit(True).alias("p")).join(bindings.select("snapshot_id", "id", F.lit(True).alias("b")), ["snapshot_id", "id"], "full_outer")
    return both.where(F.col("p").isNull() | F.col("b").isNull()).select("snapshot_id", F.lit(kind).alias("kind"), "id", F.when(F.col("b").isNull(), "unbound").otherwise("not in payload").alias("problem"))
