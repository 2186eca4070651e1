"""Rule packs, add-ons and rule profiles: drafts, installation, locks of branches and their shared ownership."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.contracts import PACK_ID, VERSION, component_status, union
from palimpsest.sources.tables import dealt


def save_drafts(packs: DataFrame, versions: DataFrame, drafts: DataFrame) -> DataFrame:
    """Drafts (pack_id, version, system_id, checksum, problems) with outcome; one draft a version.

    packs (pack_id, system_id), versions (pack_id, version, status, checksum).
    rejected without a row (bad id, version or system: `unstored`); other
    system; immutable, an installed version with another checksum; kept, an
    installed version once more; validated or rejected by its problems.
    """
    own = drafts.join(packs.select("pack_id", F.col("system_id").alias("__system")), "pack_id", "left")
    own = own.join(versions.select("pack_id", "version", F.col("status").alias("__status"), F.col("checksum").alias("__sum")), ["pack_id", "version"], "left")
    formed = F.coalesce(F.col("pack_id").rlike(PACK_ID) & F.col("version").rlike(VERSION) & (F.col("system_id") != ""), F.lit(False))
    outcome = (
        F.when(~formed, "unstored").when(F.col("__system").isNotNull() & (F.col("__system") != F.col("system_id")), "other system")
        .when(F.col("__status") == "installed", F.when(F.col("__sum") == F.col("checksum"), "kept").otherwise("immutable"))
        .when(F.coalesce("problems", F.lit(0)) == 0, "validated").otherwise("rejected")
    )
    return own.withColumn("outcome", outcome).drop("__system", "__status", "__sum")


def install_versions(versions: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (pack_id, version) with outcome: installed, refused (not validated) or missing."""
    own = requests.join(versions.select("pack_id", "version", F.col("status").alias("__status")), ["pack_id", "version"], "left")
    outcome = F.when(F.col("__status").isNull(), "missing").when(F.col("__status").isin("validated", "installed"), "installed").otherwise("refused")
    return own.withColumn("outcome", outcome).drop("__status")


def _supports(editions: Column, edition: Column) -> Column:
    return (F.size(F.coalesce(editions, F.array().cast("array<string>"))) == 0) | (F.coalesce(edition, F.lit("")) == "") | F.array_contains(editions, edition)


def _refusal(status: str, system: str) -> Column:
    return (
        F.when(F.coalesce("locked", F.lit(False)), "locked").when(~F.coalesce(F.col(status) == "installed", F.lit(False)), "not installed")
        .when(F.col(system) != F.col("system_id"), "other system").when(~_supports(F.col("__editions"), F.col("edition")), "other edition")
    )


def set_activations(requests: DataFrame, campaigns: DataFrame, versions: DataFrame, activations: DataFrame) -> DataFrame:
    """Requests (campaign_id, branch_id, pack_id, version, enabled, options) with outcome and the checksum to lock.

    campaigns (campaign_id, system_id, edition, locked), versions (pack_id,
    version, system_id, status, checksum, editions), activations (campaign_id,
    branch_id, pack_id, owners).  applied, or why not: locked, not installed,
    other system, other edition, owned by add-ons.  An unknown campaign is missing.
    """
    held = versions.select("pack_id", "version", F.struct(F.col("system_id"), "status", "checksum").alias("__v"), F.col("editions").alias("__editions"))
    own = requests.join(campaigns, "campaign_id", "left").join(held, ["pack_id", "version"], "left")
    own = own.join(activations.select("campaign_id", "branch_id", "pack_id", F.col("owners").alias("__owners")), ["campaign_id", "branch_id", "pack_id"], "left")
    why = F.coalesce(F.when(F.col("system_id").isNull(), "missing"), _refusal("__v.status", "__v.system_id"), F.when(F.size(F.coalesce("__owners", F.array().cast("array<string>"))) > 0, "owned"), F.lit("applied"))
    own = own.withColumn("outcome", why)
    return own.select(*requests.columns, "outcome", F.when(F.col("outcome") == "applied", F.col("__v.checksum")).alias("checksum"))


def remove_activations(activations: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(activations that stay, requests with outcome removed, owned or missing)."""
    key = ["campaign_id", "branch_id", "pack_id"]
    there = activations.select(*key, (F.size(F.coalesce("owners", F.array().cast("array<string>"))) > 0).alias("__owned"))
    outcome = F.when(F.col("__owned").isNull(), "missing").when(F.col("__owned"), "owned").otherwise("removed")
    judged = requests.select(*key).distinct().join(there, key, "left").withColumn("outcome", outcome).drop("__owned")
    return activations.join(judged.where("outcome = 'removed'").select(*key), key, "left_anti"), judged


def locks_of(activations: DataFrame, campaign, branch) -> DataFrame:
    """The locks of one branch, by pack."""
    return activations.where((F.col("campaign_id") == F.lit(campaign)) & (F.col("branch_id") == F.lit(branch))).orderBy("pack_id")


def versions_of(versions: DataFrame, pack=None) -> DataFrame:
    """All versions, or those of one pack, by pack and version."""
    rows = versions if pack is None else versions.where(F.col("pack_id") == F.lit(pack))
    return rows.orderBy("pack_id", "version")


def component_counts(components: DataFrame) -> DataFrame:
    """addon_id, version and how many components of each kind it has, as a map in the order of kinds."""
    n = components.groupBy("addon_id", "version", "kind").agg(F.count("*").alias("n"))
    return n.groupBy("addon_id", "version").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("counts"))


def installable(components: DataFrame, installed: DataFrame, proofs: DataFrame) -> DataFrame:
    """addon_id, addon_version, components, and how many of them are missing or in conflict; an add-on is installed where none is.

    components (addon_id, addon_version, kind, id, version, checksum); others as in `component_status`.
    """
    keys, n = ["kind", "id", "version"], components.count()
    needed = components.select(*keys, "checksum").distinct()
    states = component_status(needed, installed, proofs).withColumnRenamed("status", "__status")
    # A component without a checksum and one with it are two requirements of one key.
    states = needed.join(states.groupBy(*keys).agg(F.collect_set("__status").alias("__s")), keys).select(*keys, "checksum", "__s").distinct()
    bad = F.arrays_overlap("__s", F.array(F.lit("missing"), F.lit("conflict")))
    states = states.select(*keys, bad.alias("__bad")).groupBy(*keys).agg(F.bool_or("__bad").alias("__bad"))
    # Keys go as one struct, as a constant among several would drop out of the join and undo the dealing; merged, as Spark else
    # may broadcast the components, which are the large side.
    whole = dealt(components.dropna(subset=keys).select("addon_id", "addon_version", F.struct(*keys).alias("__k")), "__k", rows=n)
    own = whole.join(states.select(F.struct(*keys).alias("__k"), "__bad").hint("merge"), "__k").select(F.struct("addon_id", "addon_version").alias("__a"), "__bad")
    told = dealt(own, "__a", rows=n).groupBy("__a").agg(F.count("*").alias("components"), F.count_if("__bad").alias("wanting"))
    return told.select("__a.*", "components", "wanting")


def activation_requirements(requests: DataFrame, campaigns: DataFrame, addons: DataFrame, wanting: DataFrame, conflicts: DataFrame, active: DataFrame) -> DataFrame:
    """Requests (campaign_id, branch_id, addon_id, version) with outcome: ready, or the first thing that stands against it.

    campaigns as in `set_activations`; addons (addon_id, version, system_id,
    status, editions); wanting (addon_id, version, wanting); conflicts
    (addon_id, conflicts_with), which hold both ways; active (campaign_id,
    branch_id, addon_id).
    """
    held = addons.select("addon_id", "version", F.struct("system_id", "status").alias("__v"), F.col("editions").alias("__editions"))
    both = conflicts.select("addon_id", "conflicts_with").unionByName(conflicts.select(F.col("conflicts_with").alias("addon_id"), F.col("addon_id").alias("conflicts_with"))).distinct()
    other = active.select("campaign_id", "branch_id", F.col("addon_id").alias("conflicts_with"))
    clash = requests.select("campaign_id", "branch_id", "addon_id").distinct().join(both, "addon_id").join(other, ["campaign_id", "branch_id", "conflicts_with"], "left_semi")
    clash = clash.select("campaign_id", "branch_id", "addon_id").distinct().withColumn("__clash", F.lit(True))
    own = requests.join(campaigns, "campaign_id", "left").join(held, ["addon_id", "version"], "left").join(wanting.select("addon_id", "version", F.col("wanting").alias("__wanting")), ["addon_id", "version"], "left")
    own = own.join(clash, ["campaign_id", "branch_id", "addon_id"], "left")
    why = F.coalesce(F.when(F.col("system_id").isNull(), "missing"), _refusal("__v.status", "__v.system_id"), F.when(F.col("__wanting") > 0, "components wanting"), F.when(F.col("__clash"), "conflict"), F.lit("ready"))
    return own.select(*requests.columns, why.alias("outcome"))


def addon_locks(active: DataFrame, components: DataFrame) -> DataFrame:
    """campaign_id, branch_id, pack_id, version, checksum, owners and conflict: the rule packs that active add-ons lock.

    active (campaign_id, branch_id, addon_id, addon_version), components
    (addon_id, addon_version, kind, id, version, checksum).  Owners that agree
    share a lock; a pack wanted in two versions is a conflict.
    """
    own = active.join(components.where("kind = 'rule_pack'"), ["addon_id", "addon_version"])
    one = own.groupBy("campaign_id", "branch_id", F.col("id").alias("pack_id")).agg(F.min(F.struct("version", "checksum")).alias("a"), F.max(F.struct("version", "checksum")).alias("b"), F.array_sort(F.collect_set("addon_id")).alias("owners"))
    return one.select("campaign_id", "branch_id", "pack_id", F.col("a.version").alias("version"), F.col("a.checksum").alias("checksum"), "owners", (F.col("a") != F.col("b")).alias("conflict"))


def switch_addons(active: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(active add-ons after requests, requests with outcome).

    active (campaign_id, branch_id, addon_id, addon_version, checksum), requests
    the same and enabled, one for an add-on of a branch.  To enable replaces
    another version; to disable must name the exact one that is active:
    enabled, replaced, disabled, not active or other version.
    """
    key = ["campaign_id", "branch_id", "addon_id"]
    own = requests.join(active.select(*key, F.struct("addon_version", "checksum").alias("__now")), key, "left")
    same = F.struct("addon_version", "checksum") == F.col("__now")
    outcome = F.when(F.col("enabled"), F.when(F.col("__now").isNull() | same, "enabled").otherwise("replaced")).when(F.col("__now").isNull(), "not active").when(same, "disabled").otherwise("other version")
    judged = own.withColumn("outcome", outcome).drop("__now")
    moved = judged.where(F.col("outcome").isin("enabled", "replaced", "disabled"))
    kept = active.select(*key, "addon_version", "checksum").join(moved.select(*key), key, "left_anti")
    return union([kept, moved.where("enabled").select(*key, "addon_version", "checksum")]), judged


def set_profiles(profiles: DataFrame, campaigns: DataFrame, characters: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (campaign_id, edition, locale, publications, options) with outcome; one a campaign.

    profiles as requests; campaigns (campaign_id, locked, mutable_keys);
    characters (campaign_id).  While a campaign is locked only options among
    its mutable keys may change; the edition of a campaign with characters is
    frozen.  set, locked, outside the allow-list, edition frozen or missing.
    """
    held = profiles.select("campaign_id", F.struct("edition", "locale", "publications", "options").alias("__now"))
    peopled = characters.select("campaign_id").distinct().withColumn("__peopled", F.lit(True))
    own = requests.join(campaigns, "campaign_id", "left").join(held, "campaign_id", "left").join(peopled, "campaign_id", "left")
    none = F.create_map().cast("map<string,string>")
    new, old = F.coalesce("options", none), F.coalesce("__now.options", none)
    every = F.array_union(F.map_keys(new), F.map_keys(old))
    changed = F.filter(every, lambda k: ~F.try_element_at(new, k).eqNullSafe(F.try_element_at(old, k)))
    mutable = F.coalesce("mutable_keys", F.array().cast("array<string>"))
    fixed = F.lit(True)
    for c in ("edition", "locale", "publications"):
        fixed = fixed & F.col(c).eqNullSafe(F.col(f"__now.{c}"))
    outcome = (
        F.when(F.col("locked").isNull(), "missing").when(F.col("locked") & ((F.size(mutable) == 0) | F.col("__now").isNull() | ~fixed), "locked")
        .when(F.col("locked") & (F.size(F.array_except(changed, mutable)) > 0), "outside the allow-list")
        .when(F.col("__peopled") & (F.coalesce("__now.edition", F.lit("")) != "") & (F.col("__now.edition") != F.col("edition")), "edition frozen").otherwise("set")
    )
    return own.select(*requests.columns, outcome.alias("outcome"))
