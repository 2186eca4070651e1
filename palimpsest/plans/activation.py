"""A staged module revision made current, or taken back, as one transaction over the commit log.

The swap, the progress of the replaced revision's scenes, the bindings of its
cast and the answer under the request's key become visible together or not at
all.  A request that is sent again gets the answer that was kept.

Tables: modules (campaign_id, module_id, module_key, revision), activations
(campaign_id, module_key, module_id, n; the greatest n holds, a null module is
none), scenes (module_id, scene_id, stable_key), progress (scope_id, scene_id,
status), bindings (binding_id, module_id, actor_key, character_id), answers
(campaign_id, key, request_sha256, answer).
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators import ledger
from palimpsest.plans.transactions import Refused, _view
from palimpsest.sources.commits import CommitLog, View
from palimpsest.sources.tables import durable

MODULES = "campaign_id string, module_id string, module_key string, revision long"
ACTIVATIONS = "campaign_id string, module_key string, module_id string, n long"
SCENES = "module_id string, scene_id string, stable_key string"
PROGRESS = "scope_id string, scene_id string, status string"
BINDINGS = "binding_id string, module_id string, actor_key string, character_id string"
ANSWERS = "campaign_id string, key string, request_sha256 string, answer string"


def request_sha256(**request: object) -> str:
    return hashlib.sha256(json.dumps(request, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _answered(log: CommitLog, campaign: str, key: str | None, sha: str) -> str | None:
    """The answer kept for this very request, whatever has happened since; Refused where the key was used for another."""
    if key is None:
        return None
    held = log.view().read("answers", ANSWERS).where((F.col("campaign_id") == campaign) & (F.col("key") == key)).first()
    if held is not None and held.request_sha256 != sha:
        raise Refused({"key of another request": 1})
    return None if held is None else held.answer


def active(view: View, campaign: str) -> DataFrame:
    """module_key, module_id and n of the revisions in force, one a key."""
    own = view.read("activations", ACTIVATIONS).where(F.col("campaign_id") == campaign)
    return ledger.latest(own, ["module_key"], "n").select("module_key", "module_id", "n")


def _module(view: View, campaign: str, module: str):
    found = view.read("modules", MODULES).where((F.col("campaign_id") == campaign) & (F.col("module_id") == module)).first()
    if found is None:
        raise Refused({"missing module": 1})
    return found


def _kept(view: View, campaign: str, key: str | None, sha: str, answer: dict) -> tuple[str, dict[str, DataFrame]]:
    text = json.dumps(answer, sort_keys=True)
    return text, {} if key is None else {"answers": view.spark.createDataFrame([(campaign, key, sha, text)], ANSWERS)}


def activate(log: CommitLog, expected: int, campaign: str, module: str, *, remaps: dict[str, str] | None = None, key: str | None = None) -> str:
    """Make a revision current for its key; the answer tells what was replaced and how much moved.

    Progress on the replaced revision's scenes goes to the scenes that `remaps`
    names or that have the same stable key; a scene without a place, or two for
    one place in a scope, refuse the whole.  Bindings go to the same actors of
    the new revision.  Activating what is active changes nothing but is
    remembered.
    """
    sha = request_sha256(op="activate", campaign=campaign, module=module, remaps=remaps or {})
    if (answer := _answered(log, campaign, key, sha)) is not None:
        return answer
    view = _view(log, expected)
    row = _module(view, campaign, module)
    now = active(view, campaign).where(F.col("module_key") == row.module_key).first()
    old, n = (now.module_id, now.n) if now else (None, 0)
    tables, replace, moved, bound = {}, (), 0, 0
    if old != module:
        tables["activations"] = view.spark.createDataFrame([(campaign, row.module_key, module, n + 1)], ACTIVATIONS)
    if old not in (None, module):
        scenes, progress, bindings = view.read("scenes", SCENES), view.read("progress", PROGRESS), view.read("bindings", BINDINGS)
        before, after = (scenes.where(F.col("module_id") == m).select("scene_id", "stable_key") for m in (old, module))
        told = view.spark.createDataFrame(list((remaps or {}).items()), "old_scene_id string, new_scene_id string")
        if foreign := told.join(after, F.col("new_scene_id") == F.col("scene_id"), "left_anti").count() + told.join(before, F.col("old_scene_id") == F.col("scene_id"), "left_anti").count():
            raise Refused({"remap of another revision": foreign})
        own = progress.join(before.select("scene_id"), "scene_id", "left_semi")
        placed = durable(ledger.migrate_progress(own, before, after, told))
        if bad := placed.where("error is not null").groupBy("error").count().collect():  # two kinds at most
            raise Refused({r.error: r["count"] for r in bad})
        target = placed.select("scope_id", F.col("old_scene_id").alias("scene_id"), "new_scene_id")
        tables["progress"] = durable(progress.join(target, ["scope_id", "scene_id"], "left").select("scope_id", F.coalesce("new_scene_id", "scene_id").alias("scene_id"), "status"))
        tables["bindings"] = durable(bindings.withColumn("module_id", F.when(F.col("module_id") == old, module).otherwise(F.col("module_id"))))
        moved, bound = placed.count(), bindings.where(F.col("module_id") == old).count()
        replace = ("progress", "bindings")
    text, kept = _kept(view, campaign, key, sha, {"module_id": module, "replaced": None if old == module else old, "progress": moved, "bindings": bound})
    if tables or kept:
        log.commit(tables | kept, expected=expected, replace=replace, note=f"activate {module}")
    return text


def deactivate(log: CommitLog, expected: int, campaign: str, module: str, *, key: str | None = None) -> str:
    """Take an active revision back, so that its key has none; Refused where it isn't active or has progress that would be lost."""
    sha = request_sha256(op="deactivate", campaign=campaign, module=module)
    if (answer := _answered(log, campaign, key, sha)) is not None:
        return answer
    view = _view(log, expected)
    row = _module(view, campaign, module)
    now = active(view, campaign).where(F.col("module_key") == row.module_key).first()
    if now is None or now.module_id != module:
        raise Refused({"not active": 1})
    own = view.read("scenes", SCENES).where(F.col("module_id") == module).select("scene_id")
    if n := view.read("progress", PROGRESS).join(own, "scene_id", "left_semi").count():
        raise Refused({"progress": n})
    text, kept = _kept(view, campaign, key, sha, {"module_id": None, "replaced": module})
    log.commit({"activations": view.spark.createDataFrame([(campaign, row.module_key, None, now.n + 1)], ACTIVATIONS)} | kept, expected=expected, note=f"deactivate {module}")
    return text
