"""Facts and beliefs: identities and heads, cited events, context anchors and the evidence bound to them.

Every operator takes tables of requests and gives each an outcome, so that many
requests are judged in a few joins.  Null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.text import clean_evidence, heading_path, normalize_evidence
from palimpsest.operators.contracts import SHA256, violations

#: Kinds whose facts belong to one kind of subject, references to entities, and bounds of an anchor.
KIND_OWNERS = {"actor_state": "actor", "faction_state": "faction", "faction_knowledge": "faction"}
ENTITY = r"(?U)^(?:actor|faction|item|location|module|quest|scene):[^\s:]\S{0,279}$"
MOST_KEY, MOST_PURPOSE, MOST_RELATED, MOST_BINDINGS, MOST_EXCERPT = 300, 200, 64, 16, 2_000
#: What a fact key stands for once and for all, and the fields that a binding must share with its chunk.
IDENTITY = ("kind", "subject", "subject_ref", "predicate")
BOUND = ("module_id", "scene_id", "page_start", "page_end", "heading_path", "content_sha256")


def stripped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")


def subject_fits(kind: Column, subject_ref: Column) -> Column:
    """Whether a fact's subject is of the kind that its own kind asks for; other kinds ask for nothing."""
    owner = F.lit(None).cast("string")
    for name, prefix in KIND_OWNERS.items():
        owner = F.when(stripped(kind) == name, prefix).otherwise(owner)
    ref = stripped(subject_ref)
    return owner.isNull() | (ref.rlike(ENTITY) & ref.startswith(F.concat(owner, F.lit(":"))))


def _identity(*prefix: str) -> Column:
    return F.struct(*[F.coalesce(F.col(f"{''.join(prefix)}{c}").cast("string"), F.lit("")).alias(c) for c in IDENTITY])


def identity_conflicts(facts: DataFrame, proposed: DataFrame) -> DataFrame:
    """campaign_id, fact_key and the fields in which a proposal differs from the fact that holds its key, in a fixed order."""
    keys = ["campaign_id", "fact_key"]
    held = facts.select(*keys, _identity().alias("__held"))
    fields = F.array(*[F.when(_identity()[c] != F.col("__held")[c], c) for c in IDENTITY])
    found = proposed.join(held, keys).select(*keys, F.filter(fields, lambda f: f.isNotNull()).alias("fields"))
    return found.where(F.size("fields") > 0)


def add_facts(facts: DataFrame, heads: DataFrame, new: DataFrame) -> DataFrame:
    """New facts with fact_key, memory_id and outcome.

    facts (campaign_id, fact_key, memory_id and the identity's fields), heads
    (branch_id, memory_id), new (ordinal, campaign_id, branch_id, fact_key,
    memory_id, the identity's fields, ..), ordinals all different.  Outcomes:
    created, a new identity; headed, a first revision on the branch of an
    identity that is there; exists, the branch has one already; identity,
    another identity holds the key; invalid, by key or subject.  Rows of one
    batch see those before them.  A null key becomes the row's own memory_id.
    Keys are grouped by partial aggregates, so that one key may have any number
    of requests.
    """
    key, branch = ["campaign_id", "fact_key"], ["campaign_id", "fact_key", "branch_id"]
    own = new.withColumn("fact_key", F.when(F.col("fact_key").isNull(), F.col("memory_id")).otherwise(stripped(F.col("fact_key"))))
    own = own.withColumns({"__who": _identity(), "__ok": F.coalesce(F.length("fact_key").between(1, MOST_KEY) & subject_fits(F.col("kind"), F.col("subject_ref")), F.lit(False))})
    held = facts.select(*key, F.col("memory_id").alias("__held"), _identity().alias("__held_who"))
    first = own.where("__ok").groupBy(*key).agg(F.min("ordinal").alias("__first"), F.min_by(F.struct("__who", "memory_id"), "ordinal").alias("__one"))
    own = own.join(held, key, "left").join(first, key, "left")
    own = own.withColumns({"__same": F.col("__ok") & (F.col("__who") == F.coalesce("__held_who", F.col("__one.__who"))), "__id": F.coalesce("__held", F.col("__one.memory_id"))})
    own = own.join(heads.select("branch_id", F.col("memory_id").alias("__id"), F.lit(True).alias("__head")).distinct(), ["branch_id", "__id"], "left")
    taken = own.where(F.col("__same") & F.col("__head").isNull()).groupBy(*branch).agg(F.min("ordinal").alias("__taken"))
    own = own.join(taken, branch, "left")
    outcome = (
        F.when(~F.col("__ok"), "invalid").when(~F.coalesce("__same", F.lit(False)), "identity")
        .when(F.col("__head").isNotNull() | (F.col("ordinal") != F.col("__taken")), "exists")
        .when(F.col("__held").isNull() & (F.col("ordinal") == F.col("__first")), "created").otherwise("headed")
    )
    done = own.withColumn("outcome", outcome).withColumn("memory_id", F.when(F.col("outcome").isin("created", "headed"), F.col("__id")))
    return done.select(*new.columns, "outcome")


def add_knowledge(heads: DataFrame, new: DataFrame) -> DataFrame:
    """New beliefs (ordinal, campaign_id, branch_id, actor_id, knowledge_key, event_visible, ..) with outcome.

    created; exists, where the branch's actor holds the key or an earlier row
    takes it; event, where the cited event can't be seen from the branch; invalid key.
    """
    key = ["branch_id", "actor_id", "knowledge_key"]
    own = new.withColumn("knowledge_key", stripped(F.col("knowledge_key")))
    own = own.withColumn("__ok", F.length("knowledge_key").between(1, MOST_KEY))
    own = own.withColumn("__seen", F.coalesce("event_visible", F.lit(True)))
    own = own.join(heads.select(*key, F.lit(True).alias("__head")).distinct(), key, "left")
    first = own.where(F.col("__ok") & F.col("__seen") & F.col("__head").isNull()).groupBy(*key).agg(F.min("ordinal").alias("__first"))
    outcome = F.when(~F.col("__ok"), "invalid").when(~F.col("__seen"), "event").when(F.col("__head").isNotNull(), "exists").when(F.col("ordinal") == F.col("__first"), "created").otherwise("exists")
    return own.join(first, key, "left").withColumn("outcome", outcome).select(*new.columns, "outcome")


def citable(citations: DataFrame, events: DataFrame, bindings: DataFrame) -> DataFrame:
    """Citations (campaign_id, branch_id, head_snapshot_id, event_id, ..) with event_visible: null where none is cited.

    An event of the campaign can be seen from the branch where it is its own
    and in no snapshot, or bound to the branch's head.
    """
    there = events.select("event_id", F.struct("campaign_id", "branch_id", "committed_snapshot_id").alias("__e"))
    bound = bindings.select(F.col("snapshot_id").alias("head_snapshot_id"), "event_id", F.lit(True).alias("__bound")).distinct()
    own = citations.join(there, "event_id", "left").join(bound, ["head_snapshot_id", "event_id"], "left")
    live = (F.col("__e.branch_id") == F.col("branch_id")) & F.col("__e.committed_snapshot_id").isNull()
    seen = (F.col("__e.campaign_id") == F.col("campaign_id")) & (F.coalesce(live, F.lit(False)) | F.col("__bound").isNotNull())
    return own.withColumn("event_visible", F.when(F.col("event_id").isNotNull(), F.coalesce(seen, F.lit(False)))).select(*citations.columns, "event_visible")


def related_refs(subject_ref: Column, refs: Column) -> Column:
    """The subject and what it is related to, once each, in order."""
    return F.array_distinct(F.concat(F.array(stripped(subject_ref)), F.transform(F.coalesce(refs, F.array().cast("array<string>")), stripped)))


def active_refs(*sources: Column) -> Column:
    """The references of actor, scene, module and caller as one set; nulls and what is no reference are left out."""
    every = F.flatten(F.array(*[F.transform(F.coalesce(s, F.array().cast("array<string>")), stripped) for s in sources]))
    return F.array_sort(F.array_distinct(F.filter(every, lambda r: r.rlike(ENTITY))))


def anchor_problems(anchors: DataFrame) -> DataFrame:
    """subject (anchor_id) and problem of anchors that could do more than find evidence.

    anchors (anchor_id, schema_version, purpose, subject_ref, predicate,
    disclosure_scope, related_refs, bindings); bindings is a number.
    """
    related = related_refs(F.col("subject_ref"), F.col("related_refs"))
    purpose = stripped(F.regexp_replace(F.coalesce("purpose", F.lit("")), r"(?U)\s+", " "))
    return violations(anchors, "anchor_id", {
        "the schema version is unknown": F.col("schema_version") == 1, "an anchor has a predicate": stripped(F.col("predicate")) == "",
        "an anchor is for the master only": F.col("disclosure_scope") == "dm", "the subject is no reference": stripped(F.col("subject_ref")).rlike(ENTITY),
        "the purpose needs 1 to 200 characters": F.length(purpose).between(1, MOST_PURPOSE), "related references are missing": F.col("related_refs").isNotNull(),
        "a related reference is invalid": F.forall(F.slice(related, 2, F.greatest(F.size(related) - 1, F.lit(0))), lambda r: r.rlike(ENTITY)),
        "too many related references": F.size(related) <= MOST_RELATED, "an anchor needs 1 to 16 bindings": F.col("bindings").between(1, MOST_BINDINGS),
    })


def binding_problems(bindings: DataFrame) -> DataFrame:
    """subject (binding_id) and problem of bindings (binding_id, chunk_id, the bound fields, source_excerpt) that aren't exact."""
    given = lambda c: stripped(F.col(c)) != ""
    pages = F.coalesce(F.col("page_end") >= F.col("page_start"), F.lit(True))
    positive = lambda c: F.coalesce(F.col(c) >= 1, F.lit(True))
    return violations(bindings, "binding_id", {
        "the module is missing": given("module_id"), "the scene is missing": given("scene_id"), "the chunk is missing": given("chunk_id"),
        "a page is below 1": positive("page_start") & positive("page_end"), "the pages are in the wrong order": pages, "the headings are missing": F.col("heading_path").isNotNull(),
        "the digest is no SHA-256": F.lower(stripped(F.col("content_sha256"))).rlike(SHA256), "the excerpt needs 1 to 2000 characters": F.length(clean_evidence(F.coalesce("source_excerpt", F.lit("")))).between(1, MOST_EXCERPT),
    })


def resolve_bindings(bindings: DataFrame, chunks: DataFrame) -> DataFrame:
    """Bindings (binding_id, campaign_id, chunk_id, the bound fields, source_excerpt) with outcome.

    chunks (chunk_id, campaign_id, the bound fields, content).  bound; unknown
    chunk; other campaign; moved, where a field differs; absent, where the
    cleaned, folded content doesn't hold the excerpt.
    """
    there = chunks.select("chunk_id", F.struct("campaign_id", "content", *BOUND).alias("__c"))
    same = F.lit(True)
    for c in BOUND:
        a, b = F.col(c), F.col(f"__c.{c}")
        same = same & (heading_path(a).eqNullSafe(heading_path(b)) if c == "heading_path" else F.lower(stripped(a)).eqNullSafe(b) if c == "content_sha256" else a.eqNullSafe(b))
    holds = F.contains(normalize_evidence(F.coalesce("__c.content", F.lit(""))), normalize_evidence(F.coalesce("source_excerpt", F.lit(""))))
    outcome = F.when(F.col("__c").isNull(), "unknown").when(~F.col("__c.campaign_id").eqNullSafe(F.col("campaign_id")), "other campaign").when(~same, "moved").when(~holds, "absent").otherwise("bound")
    return bindings.join(there, "chunk_id", "left").withColumn("outcome", outcome).drop("__c").select(*bindings.columns, "outcome")


def presentable(recaps: DataFrame, presentations: DataFrame) -> DataFrame:
    """recap_id and the cited events outside the recap's own evidence, in order; empty where the prose may be attached.

    recaps (recap_id, evidence_event_ids), presentations (recap_id,
    evidence_event_ids); a presentation without a list has null.
    """
    own = presentations.select("recap_id", F.col("evidence_event_ids").alias("__cited")).join(recaps.select("recap_id", "evidence_event_ids"), "recap_id")
    return own.select("recap_id", F.array_sort(F.array_except("__cited", "evidence_event_ids")).alias("unknown"))
