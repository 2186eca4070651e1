"""Campaigns, characters, the cast of modules, assets and scene fields, as tables of requests and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.facts import stripped
from palimpsest.sources.tables import dealt

#: Kinds of bindings, and scene fields that only parsing may set.
BINDING_KINDS = ("cast", "encounter", "preset_pc")
CANONICAL_FIELDS = (
    "absolute_end", "absolute_start", "content_checksum", "end_line", "headings", "keywords", "line_count", "page_end", "page_start",
    "scene_level", "spatial", "stable_key", "start_line", "subsections", "tags", "visibility",
)
MOST_NAME = 200


def create_campaigns(requests: DataFrame) -> dict[str, DataFrame]:
    """Rows to append for new campaigns (campaign_id, system_id, name, principal_id, edition): campaigns, branches, memberships and profiles.

    Each gets a main branch and an owner; one with an edition gets a profile, which makes its revision 2.
    """
    profiled = F.coalesce("edition", F.lit("")) != ""
    branch = F.concat(F.col("campaign_id").cast("string"), F.lit(":main")).alias("branch_id")
    return {
        "campaigns": requests.select("campaign_id", "system_id", "name", branch.alias("active_branch_id"), F.when(profiled, 2).otherwise(1).alias("revision")),
        "branches": requests.select(branch, "campaign_id", F.lit("main").alias("name"), F.lit(None).cast("string").alias("head_snapshot_id")),
        "memberships": requests.where(F.col("principal_id").isNotNull()).select("campaign_id", "principal_id", F.lit("owner").alias("role")),
        "profiles": requests.where(profiled).select("campaign_id", "system_id", "edition"),
    }


def create_characters(requests: DataFrame) -> DataFrame:
    """Templates and their instances, of requests (character_id, system_id, campaign_id, name, sheet).

    A request for a campaign gives a template of the library and an instance
    that refers to it; one without gives a template.
    """
    template = requests.select("character_id", "system_id", F.lit(None).cast(requests.schema["campaign_id"].dataType).alias("campaign_id"), "name", "sheet", F.lit(None).cast("string").alias("template_id"), F.lit(1).alias("revision"))
    own = F.concat(F.col("character_id").cast("string"), F.lit(":instance"))
    instance = requests.where(F.col("campaign_id").isNotNull()).select(own.alias("character_id"), "system_id", "campaign_id", "name", "sheet", F.col("character_id").cast("string").alias("template_id"), F.lit(1).alias("revision"))
    return template.withColumn("character_id", F.col("character_id").cast("string")).unionByName(instance)


def move_characters(characters: DataFrame, requests: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Requests (character_id, target, expected) with outcome: a null target moves to the library.

    moved; missing character or campaign; other system; conflict, where the revision isn't the expected one.
    """
    now = characters.select("character_id", F.struct("system_id", "revision").alias("__c"))
    goal = campaigns.select(F.col("campaign_id").alias("target"), F.col("system_id").alias("__system"))
    own = requests.join(now, "character_id", "left").join(goal, "target", "left")
    outcome = (
        F.when(F.col("__c").isNull() | (F.col("target").isNotNull() & F.col("__system").isNull()), "missing").when(F.col("__system") != F.col("__c.system_id"), "other system")
        .when(F.col("expected").isNotNull() & (F.col("expected") != F.col("__c.revision")), "conflict").otherwise("moved")
    )
    return own.select(*requests.columns, outcome.alias("outcome"), F.when(outcome == "moved", F.col("__c.revision") + 1).alias("revision"))


def removable_actors(actors: DataFrame, references: dict[str, DataFrame]) -> DataFrame:
    """Actors (actor_id, ..) with the names of the tables (actor_id) that still refer to them; none may be undone but those without."""
    out = actors
    for name, rows in references.items():
        out = out.join(rows.select("actor_id", F.lit(True).alias(f"__{name}")).distinct(), "actor_id", "left")
    held = F.filter(F.array(*[F.when(F.col(f"__{name}"), name) for name in references]), lambda n: n.isNotNull())
    return out.select(*actors.columns, held.alias("held_by"))


def bind_actors(bindings: DataFrame, requests: DataFrame, modules: DataFrame, characters: DataFrame, scenes: DataFrame) -> DataFrame:
    """Requests to bind characters to modules, with the scene's key, outcome and merged metadata.

    requests (module_id, character_id, actor_card_id, binding_kind, role,
    scene_id, metadata), one for a binding; bindings (module_id, scene_key,
    character_id, binding_kind, role, actor_card_id, metadata); modules
    (module_id, system_id, campaign_id); characters (character_id, system_id,
    campaign_id); scenes (scene_id, module_id, stable_key).  created, merged,
    other card, other system, other campaign, no scene, missing or invalid.
    """
    own = requests.withColumns({"actor_card_id": stripped(F.col("actor_card_id")), "binding_kind": F.lower(stripped(F.col("binding_kind"))), "role": stripped(F.col("role"))})
    own = own.join(modules.select("module_id", F.struct("system_id", "campaign_id").alias("__m")), "module_id", "left").join(characters.select("character_id", F.struct("system_id", "campaign_id").alias("__c")), "character_id", "left")
    own = own.join(scenes.select("scene_id", "module_id", F.col("stable_key").alias("__key")), ["scene_id", "module_id"], "left").withColumn("scene_key", F.when(F.col("scene_id").isNull(), "").otherwise(F.col("__key")))
    key = ["module_id", "scene_key", "character_id", "binding_kind", "role"]
    own = own.join(bindings.select(*key, F.struct(F.col("actor_card_id").alias("card"), "metadata").alias("__b")), key, "left")
    outcome = (
        F.when(~F.length("actor_card_id").between(1, MOST_NAME) | ~F.col("binding_kind").isin(*BINDING_KINDS) | (F.length("role") > MOST_NAME), "invalid")
        .when(F.col("__m").isNull() | F.col("__c").isNull(), "missing").when(F.col("__m.system_id") != F.col("__c.system_id"), "other system")
        .when(F.col("__c.campaign_id").isNotNull() & ~F.col("__c.campaign_id").eqNullSafe(F.col("__m.campaign_id")), "other campaign")
        .when(F.col("scene_id").isNotNull() & (F.coalesce("scene_key", F.lit("")) == ""), "no scene").when(F.col("__b").isNull(), "created")
        .when(F.col("__b.card") != F.col("actor_card_id"), "other card").otherwise("merged")
    )
    none = F.create_map().cast("map<string,string>")
    new, old = F.coalesce("metadata", none), F.coalesce("__b.metadata", none)
    merged = F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new)
    return own.withColumn("outcome", outcome).select(*key, "scene_id", "actor_card_id", F.when(F.col("outcome").isin("created", "merged"), merged).alias("metadata"), "outcome")


def register_assets(assets: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (module_id, source_path, media_type, checksum) with outcome: created, kept, or different content.

    Repeats in a batch are one request; several contents of one new path are all refused.
    """
    key = ["module_id", "source_path"]
    own = requests.groupBy(*key).agg(F.min("checksum").alias("checksum"), F.max("checksum").alias("__other"), F.max_by("media_type", "checksum").alias("media_type"))
    own = own.join(assets.select(*key, F.col("checksum").alias("__held")), key, "left")
    wrong = ~F.col("checksum").eqNullSafe(F.col("__other")) | (F.col("__held") != F.col("checksum"))
    return own.select(*key, "media_type", "checksum", F.when(wrong, "different content").when(F.col("__held").isNull(), "created").otherwise("kept").alias("outcome"))


def set_scene_fields(scenes: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(scenes after changes, changes with outcome set, canonical, invalid or missing).

    scenes (scene_id, metadata: map of text), changes (scene_id, field, value,
    ordinal); of several changes of a field the last holds, of
    equal ordinals the greater value.  The fields that
    one scene may have are gathered in its map, as they are stored.
    """
    n = changes.count() + scenes.count()
    scenes, changes = dealt(scenes, "scene_id", rows=n), dealt(changes, "scene_id", rows=n)
    own = changes.withColumn("field", stripped(F.col("field"))).join(scenes.select("scene_id", F.lit(True).alias("__there")), "scene_id", "left")
    public = F.length("field").between(1, MOST_NAME) & ~F.col("field").startswith("_")
    judged = own.withColumn("outcome", F.when(~public, "invalid").when(F.col("field").isin(*CANONICAL_FIELDS), "canonical").when(F.col("__there").isNull(), "missing").otherwise("set")).drop("__there")
    last = judged.where("outcome = 'set'").groupBy("scene_id", "field").agg(F.max_by("value", F.struct("ordinal", "value")).alias("value"))
    new = last.groupBy("scene_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("__new"))
    none = F.create_map().cast("map<string,string>")
    held, fresh = F.coalesce("metadata", none), F.coalesce("__new", none)
    merged = F.map_concat(F.map_filter(held, lambda k, _: ~F.map_contains_key(fresh, k)), fresh)
    return scenes.join(new, "scene_id", "left").withColumn("metadata", merged).drop("__new"), judged
