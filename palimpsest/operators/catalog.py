"""Listings of rules and modules: chunks with what they belong to, citations, scenes, bindings and receipts.

Chunks, sections and scenes are the large side of every join; Spark broadcasts
sources, chapters and modules where their size allows.  Listings are ordered
only where a report asks for it, by `listed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The orders of listings.
SOURCE_ORDER, CHUNK_ORDER = ["edition", "locale", "title"], ["section_ordinal", "ordinal", "chunk_id"]
SCENE_ORDER, MODULE_ORDER, BRANCH_ORDER = ["chapter_ordinal", "scene_ordinal", "scene_id"], ["title", "id"], ["created_at", "id"]
#: Fixed value: receipts that one listing may have.
RECEIPTS_MOST = 1_000


def listed(rows: DataFrame, order: list[str], limit: int | None = None) -> DataFrame:
    """Rows in the order of a listing; with a limit a top-k, else a distributed sort."""
    out = rows.orderBy(*order)
    return out if limit is None else out.limit(limit)


def _is(column: str, value) -> Column:
    return F.lit(True) if value is None else F.col(column).eqNullSafe(F.lit(value))


def _among(column: str, values) -> Column:
    return F.lit(True) if values is None else F.col(column).isin(*values) if values else F.lit(False)


def sources(rows: DataFrame, *, system_id: str, edition: str | None = None, include_retired: bool = False) -> DataFrame:
    """Sources of a system, of one edition if given; retired ones only where they are asked for."""
    return rows.where(_is("system_id", system_id) & _is("edition", edition) & (F.lit(include_retired) | F.col("active")))


def searchable(rows: DataFrame, *, system_id: str | None = None, edition: str | None = None, locale: str | None = None, publications: list[str] | None = None, source_ids: list | None = None, source_keys: list[str] | None = None, module_ids: list | None = None, scene_ids: list | None = None) -> DataFrame:
    """What a search looks at, before any channel ranks it: a filter that isn't given holds for all rows, an empty list for none.

    Inactive rows are left out where rows say whether they are active.
    """
    given = {"system_id": system_id, "edition": edition, "locale": locale}
    lists = {"publication_id": publications, "source_id": source_ids, "source_key": source_keys, "module_id": module_ids, "scene_id": scene_ids}
    for column, value in given.items():
        rows = rows.where(_is(column, value)) if value is not None else rows
    for column, values in lists.items():
        rows = rows.where(_among(column, values)) if values is not None else rows
    return rows.where("active") if "active" in rows.columns else rows


def rule_chunks(chunks: DataFrame, sections: DataFrame, source_rows: DataFrame) -> DataFrame:
    """Chunks (chunk_id, section_id, ..) with section (section_id, source_id, ..) and source (source_id, ..)."""
    return chunks.join(sections, "section_id").join(source_rows, "source_id")


def source_chunks(chunks: DataFrame, sections: DataFrame, source_rows: DataFrame, source_id) -> DataFrame:
    """The chunks of one source; the filter reaches sections and sources before they are joined."""
    return rule_chunks(chunks, sections, source_rows).where(F.col("source_id") == source_id)


def expand_rule(chunks: DataFrame, sections: DataFrame, source_rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The whole section and the source of each chunk asked for, given as (chunk_id); unknown ids give no row."""
    return rule_chunks(chunks.join(asked.select("chunk_id").distinct(), "chunk_id", "left_semi"), sections, source_rows)


def citations(asked: DataFrame, chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Requests (chunk_id, asked_source, null for any) with the chunk's own source and outcome: bound, unknown or other source."""
    known = chunks.select("chunk_id", "section_id").join(sections.select("section_id", "source_id"), "section_id").select("chunk_id", "source_id")
    outcome = F.when(F.col("source_id").isNull(), "unknown").when(F.col("asked_source").isNull() | (F.col("asked_source") == F.col("source_id")), "bound").otherwise("other source")
    return asked.join(known, "chunk_id", "left").withColumn("outcome", outcome)


def module_chunks(chunks: DataFrame, scenes: DataFrame, chapters: DataFrame, modules: DataFrame) -> DataFrame:
    """Chunks (chunk_id, scene_id, ..) with scene, chapter and module."""
    return chunks.join(scene_index(scenes, chapters, modules), "scene_id")


def expand_module(chunks: DataFrame, scenes: DataFrame, chapters: DataFrame, modules: DataFrame, *, content: str = "content") -> DataFrame:
    """Chunks with all that they are in, and a reference with the content's own digest, not a stored one."""
    reference = F.concat_ws("/", F.lit("module"), F.col("module_id").cast("string"), F.col("scene_id").cast("string"), F.col("chunk_id").cast("string"))
    return module_chunks(chunks, scenes, chapters, modules).withColumns({"source_ref": reference, "content_sha256": F.sha2(F.col(content), 256)})


def scene_index(scenes: DataFrame, chapters: DataFrame, modules: DataFrame) -> DataFrame:
    """Scenes (scene_id, chapter_id, ..) with chapter (chapter_id, module_id, ..) and module (module_id, ..)."""
    return scenes.join(chapters, "chapter_id").join(modules, "module_id")


def progress_index(progress: DataFrame, scenes: DataFrame, chapters: DataFrame, modules: DataFrame) -> DataFrame:
    """Progress rows (scene_id, scope_id, status) of scenes that are still there."""
    return progress.join(scene_index(scenes, chapters, modules), "scene_id")


def actor_bindings(bindings: DataFrame, characters: DataFrame, *, scene_id=None, kind: str | None = None) -> DataFrame:
    """Bindings (character_id, scene_id, binding_kind, ..) and their characters, of one scene or kind if given."""
    return bindings.where(_is("scene_id", scene_id) & _is("binding_kind", kind)).join(characters, "character_id")


def receipts(rows: DataFrame, groups: DataFrame, *, branch_id=None, mechanic_id=None, limit: int = 100) -> DataFrame:
    """The newest receipts (receipt_id, group_id, mechanic_id, created_at) with their mutation group (group_id, branch_id, ..)."""
    n = max(1, min(limit, RECEIPTS_MOST))
    own = rows.where(_is("mechanic_id", mechanic_id)).join(groups.where(_is("branch_id", branch_id)), "group_id")
    return listed(own, [F.desc("created_at"), F.desc("receipt_id")], n)


def revision_groups(revisions: DataFrame, groups: DataFrame) -> DataFrame:
    """Revisions with the mutation group that made them, in which undo and redo move."""
    return revisions.join(groups, "group_id")
