"""Contracts: validation as tables of violations, ruleset resolution, state machines and idempotent writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Grammars.
PACK_ID, VERSION, SHA256 = r"^[a-z0-9]+(?:[._-][a-z0-9]+)+$", r"^\d+\.\d+\.\d+$", r"^[0-9a-f]{64}$"
#: States of an import job and those that may follow each.
TRANSITIONS = {
    "staged": ("inspected", "failed"),
    "inspected": ("inspected", "extracted", "review_required", "validated", "failed"),
    "extracted": ("review_required", "reviewed", "failed"),
    "review_required": ("review_required", "reviewed", "failed"),
    "reviewed": ("compiled", "failed"),
    "compiled": ("extracted", "review_required", "installed", "failed"),
    "installed": ("activated", "failed"),
    "validated": ("imported", "failed"),
    "imported": ("inspected", "imported", "compiled", "activated", "failed"),
    "activated": (),
    "failed": ("inspected", "extracted", "validated", "compiled", "failed"),
}


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def violations(rows: DataFrame, subject: str, checks: dict[str, Column]) -> DataFrame:
    """subject and problem of every failed check of every row; one scan, no shuffle."""
    found = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(problem)) for problem, ok in checks.items()]), lambda p: p.isNotNull())
    return rows.select(F.col(subject).cast("string").alias("subject"), F.explode(found).alias("problem"))


def duplicates(rows: DataFrame, keys: list[str], problem: str) -> DataFrame:
    """subject (the keys, joined by /, nulls as ?) and problem of every combination of keys that is there twice; null equals null only."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("__n")).where("__n > 1")
    return found.select(F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("?")) for k in keys]).alias("subject"), F.lit(problem).alias("problem"))


def missing(rows: DataFrame, reference: str, targets: DataFrame, target: str, subject: str, problem: str) -> DataFrame:
    """subject and problem of every reference to what isn't there."""
    own = rows.where(F.col(reference).isNotNull()).select(F.col(subject).cast("string").alias("subject"), F.col(reference).alias("__ref"))
    return own.join(targets.select(F.col(target).alias("__ref")).distinct(), "__ref", "left_anti").select("subject", F.concat(F.lit(problem), F.col("__ref").cast("string")).alias("problem")).distinct()


def validate_packs(packs: DataFrame, dependencies: DataFrame, mechanics: DataFrame, artifacts: DataFrame) -> DataFrame:
    """All problems of pack definitions: subject (pack) and problem.

    packs (pack_id, version, system_id, namespace); dependencies (pack_id,
    depends_on, version, checksum); mechanics (pack_id, id, event, declared);
    artifacts (pack_id, id, kind, name, refs).
    """
    own = violations(packs, "pack_id", {
        "the id isn't a namespaced identifier": F.col("pack_id").rlike(PACK_ID), "the version isn't x.y.z": F.col("version").rlike(VERSION),
        "the system is missing": F.coalesce(F.col("system_id"), F.lit("")) != "", "the namespace isn't the id": F.coalesce(F.col("namespace"), F.col("pack_id")) == F.col("pack_id"),
    })
    needs = violations(dependencies, "pack_id", {
        "a dependency's id is invalid": F.col("depends_on").rlike(PACK_ID), "it depends on itself": F.col("depends_on") != F.col("pack_id"),
        "a dependency's version is invalid": F.col("version").isNull() | F.col("version").rlike(VERSION), "a dependency's checksum is invalid": F.col("checksum").isNull() | F.col("checksum").rlike(SHA256),
    })
    acts = violations(mechanics, "pack_id", {
        "a mechanic is outside the namespace": F.col("id").startswith(F.concat(F.col("pack_id"), F.lit("."))), "a mechanic has no event": F.coalesce(F.col("event"), F.lit("")) != "",
        "an event isn't declared": F.coalesce(F.col("declared"), F.lit(False)),
    })
    cards = violations(artifacts, "pack_id", {
        "an artifact is outside the namespace": F.col("id").startswith(F.concat(F.col("pack_id"), F.lit("."))), "an artifact has no kind": F.trim(F.coalesce(F.col("kind"), F.lit(""))) != "",
        "an artifact has no name": F.trim(F.coalesce(F.col("name"), F.lit(""))) != "",
    })
    refs = artifacts.select("pack_id", F.explode("refs").alias("ref")).withColumn("ref", F.concat_ws("|", "pack_id", "ref"))
    known = mechanics.select(F.concat_ws("|", "pack_id", "id").alias("known"))
    return union([
        own, needs, acts, cards,
        duplicates(dependencies, ["pack_id", "depends_on"], "a dependency is repeated"), duplicates(mechanics, ["pack_id", "id"], "a mechanic is repeated"),
        duplicates(artifacts, ["pack_id", "id"], "an artifact is repeated"), missing(refs, "ref", known, "known", "pack_id", "unknown mechanic "),
    ]).distinct()


def resolve_ruleset(active: DataFrame, versions: DataFrame, dependencies: DataFrame, conflicts: DataFrame, mechanics: DataFrame, edition: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(violations, mechanics in force) of the enabled packs.

    active (pack_id, version, checksum); versions (pack_id, version, checksum,
    status, editions); dependencies (pack_id, depends_on, version, checksum);
    conflicts (pack_id, conflicts_with); mechanics (pack_id, id, checksum,
    patch_target, patch_checksum).  A patched mechanic gives way to its patch.
    """
    locked = active.alias("a").join(versions.alias("v"), ["pack_id", "version"], "left")
    held = locked.select("pack_id", "version", F.col("a.checksum").alias("checksum"), F.col("v.checksum").alias("installed"), "status", "editions")
    ids = active.select("pack_id")
    bad = violations(held, "pack_id", {
        "the locked version is unavailable": (F.col("status") == "installed") & (F.col("installed") == F.col("checksum")),
        "the edition isn't supported": F.lit(edition is None) | (F.size("editions") <= 0) | F.array_contains("editions", F.lit(edition or "")),
    })
    needs = dependencies.join(ids, "pack_id", "left_semi")
    absent = missing(needs, "depends_on", ids, "pack_id", "pack_id", "missing dependency ")
    pinned = needs.alias("n").join(active.alias("d"), F.col("n.depends_on") == F.col("d.pack_id"))
    wrong = violations(pinned.select(F.col("n.pack_id").alias("pack_id"), F.col("n.version").alias("want"), F.col("d.version").alias("got"), F.col("n.checksum").alias("sum"), F.col("d.checksum").alias("own")), "pack_id", {
        "a dependency has another version": F.col("want").isNull() | (F.col("want") == F.col("got")),
        "a dependency has another checksum": F.col("sum").isNull() | (F.col("want").isNotNull() & (F.col("want") != F.col("got"))) | (F.col("sum") == F.col("own")),
    })
    clash = conflicts.join(ids, "pack_id", "left_semi").join(ids.select(F.col("pack_id").alias("conflicts_with")), "conflicts_with", "left_semi").select(F.col("pack_id").alias("subject"), F.concat(F.lit("conflicts with "), "conflicts_with").alias("problem"))
    own = mechanics.join(ids, "pack_id", "left_semi")
    twice = duplicates(own, ["id"], "a mechanic is active twice")
    patches = own.where(F.col("patch_target").isNotNull())
    many = duplicates(patches, ["patch_target"], "several packs patch it")
    goal = patches.alias("p").join(own.select(F.col("id").alias("target"), F.col("checksum").alias("now")), F.col("p.patch_target") == F.col("target"), "left")
    stale = violations(goal, "patch_target", {"the patch target is unavailable": F.col("target").isNotNull(), "the patch checksum differs": F.col("target").isNull() | (F.col("patch_checksum") == F.col("now"))})
    force = own.join(patches.select(F.col("patch_target").alias("id")), "id", "left_anti")
    return union([bad, absent, wrong, clash, twice, many, stale]).distinct(), force


def symmetric_conflicts(active: DataFrame, conflicts: DataFrame, addon: str) -> DataFrame:
    """Active addons that conflict with one, whichever of the two declares it."""
    there = conflicts.where(F.col("addon_id") == addon).select(F.col("conflicts_with").alias("addon_id"))
    back = conflicts.where(F.col("conflicts_with") == addon).select("addon_id")
    return active.join(there.unionByName(back).distinct(), "addon_id", "left_semi").select("addon_id")


def component_status(components: DataFrame, installed: DataFrame, proofs: DataFrame) -> DataFrame:
    """kind, id, version and status: match, unverified, conflict or missing."""
    keys = ["kind", "id", "version"]
    own = components.join(installed.select(*keys, F.col("checksum").alias("installed")), keys, "left").join(proofs.select(*keys, F.col("checksum").alias("proved")), keys, "left")
    status = F.when(F.col("installed").isNull() & F.col("proved").isNull(), "missing").when(F.coalesce("installed", "proved") == F.col("checksum"), "match").when(F.col("checksum").isNull(), "unverified").otherwise("conflict")
    return own.select(*keys, status.alias("status"))


def merged_options(options: DataFrame) -> DataFrame:
    """pack_id, key, value, owners and conflict of (pack_id, owner, key, value): equal values may share a key."""
    out = options.groupBy("pack_id", "key").agg(F.collect_set("value").alias("values"), F.array_sort(F.collect_set("owner")).alias("owners"))
    return out.select("pack_id", "key", F.when(F.size("values") == 1, F.element_at("values", 1)).alias("value"), "owners", (F.size("values") > 1).alias("conflict"))


def illegal_transitions(steps: DataFrame, current: str, target: str) -> DataFrame:
    """Steps that the import-job states don't allow."""
    pairs = [f"{a}>{b}" for a, nexts in TRANSITIONS.items() for b in nexts]
    step = F.concat(F.col(current), F.lit(">"), F.col(target))
    return steps.where(~F.coalesce(step.isin(*pairs), F.lit(False)))


def idempotent_write(requests: DataFrame, remembered: DataFrame, *, scope: str = "scope", key: str = "key", request: str = "request_sha256") -> DataFrame:
    """Requests with outcome: new, replay (same key, same hash), conflict (same key, another hash) or repeat (within this batch)."""
    old = remembered.select(scope, key, F.col(request).alias("__old"))
    # A repeat needs its batch's first request; the least hash stands for it in a deterministic way.
    first = requests.groupBy(scope, key).agg(F.min(F.struct("at", request)).alias("__first"))
    own = requests.join(old, [scope, key], "left").join(first, [scope, key])
    outcome = (
        F.when(F.col("__old").isNotNull(), F.when(F.col("__old") == F.col(request), "replay").otherwise("conflict"))
        .when(F.struct("at", request) == F.col("__first"), "new")
        .when(F.col(f"__first.{request}") == F.col(request), "repeat").otherwise("conflict")
    )
    return own.withColumn("outcome", outcome).drop("__old", "__first")


def persist_by_content(values: DataFrame, stored: DataFrame, address: str) -> DataFrame:
    """Values to append: each address once, if it isn't stored."""
    return values.dropDuplicates([address]).join(stored.select(address), address, "left_anti")


def unreferenced(stored: DataFrame, references: DataFrame, address: str) -> DataFrame:
    return stored.join(references.select(address), address, "left_anti")


def classify_jobs(jobs: DataFrame, entities: DataFrame) -> DataFrame:
    """Outbox jobs with outcome deliver or failed, and why.  jobs (job_id, entity_type, entity_id), entities (entity_id, embedding)."""
    own = jobs.join(entities.select("entity_id", F.lit(True).alias("__there"), "embedding"), "entity_id", "left")
    error = (
        F.when(~F.col("entity_type").isin("rule_chunk", "module_chunk"), F.concat(F.lit("unsupported entity type "), "entity_type"))
        .when(F.col("__there").isNull(), "the entity is gone").when(F.col("embedding").isNull() | (F.size("embedding") == 0), "the entity has no embedding")
    )
    return own.withColumn("error", error).withColumn("outcome", F.when(F.col("error").isNull(), "deliver").otherwise("failed")).drop("__there")


def due_jobs(jobs: DataFrame, *, system_id: str, collection: str, limit: int = 1_000, job_ids: list | None = None) -> DataFrame:
    """The oldest pending or failed upserts of one collection, at most `limit`: one batch of an outbox."""
    if limit < 1:
        raise ValueError("a batch needs a positive limit")
    own = jobs.where((F.col("system_id") == system_id) & (F.col("collection") == collection) & (F.col("operation") == "upsert") & F.col("status").isin("pending", "failed"))
    own = own.where(F.col("job_id").isin(*job_ids)) if job_ids else own
    return own.orderBy("created_at", "job_id").limit(limit)


def settle_jobs(jobs: DataFrame, tried: DataFrame, delivery_error: str | None = None) -> DataFrame:
    """Jobs after a batch: each one tried has one attempt more, and is completed or failed with its reason.

    tried (job_id, outcome, error) is what `classify_jobs` says of the batch;
    with a delivery error all that were to be delivered fail with it and stay due.
    """
    own = jobs.join(tried.select("job_id", F.struct("outcome", "error").alias("__t")), "job_id", "left")
    done = (F.col("__t.outcome") == "deliver") & F.lit(delivery_error is None)
    status = F.when(F.col("__t").isNull(), F.col("status")).when(done, "completed").otherwise("failed")
    error = F.when(F.col("__t").isNull(), F.col("error")).when(done, "").otherwise(F.coalesce("__t.error", F.lit(delivery_error or "vector delivery failed")))
    return own.withColumns({"status": status, "error": error, "attempts": F.col("attempts") + F.col("__t").isNotNull().cast("int")}).drop("__t")
