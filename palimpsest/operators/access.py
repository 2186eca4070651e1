"""Access: memberships, grants, locks and signed contexts."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.hashing import digest, sign, verify

#: Roles that stand above grants, and bounds of a signed context.
DM_ROLES = ("owner", "dm")
FIELDS = ("host", "channel", "actor_principal", "conversation_principal", "session_id", "tenant_id", "campaign_id", "authorization_epoch", "issued_at", "nonce")
FUTURE_SKEW = 30


def may_see_campaign(requests: DataFrame, memberships: DataFrame, roles: tuple[str, ...] | None = None) -> DataFrame:
    """Requests (campaign_id, principal_id) with `allowed`."""
    ok = memberships if roles is None else memberships.where(F.col("role").isin(*roles))
    own = ok.select("campaign_id", "principal_id", F.lit(True).alias("__ok")).distinct()
    return requests.join(own, ["campaign_id", "principal_id"], "left").withColumn("allowed", F.coalesce("__ok", F.lit(False))).drop("__ok")


def may_use_actor(requests: DataFrame, memberships: DataFrame, grants: DataFrame, actors: DataFrame) -> DataFrame:
    """Requests (campaign_id, principal_id, actor_id, control, private) with `allowed`.

    The actor must be in the campaign; owners and masters then pass, others need
    a grant with the rights asked for.
    """
    keys = ["campaign_id", "principal_id"]
    own = requests.join(memberships.select(*keys, "role"), keys, "left").join(actors.select("campaign_id", "actor_id", F.lit(True).alias("__there")), ["campaign_id", "actor_id"], "left")
    own = own.join(grants.select(*keys, "actor_id", "can_control", "can_view_private"), [*keys, "actor_id"], "left")
    granted = F.col("can_control").isNotNull() & (~F.col("control") | F.col("can_control")) & (~F.col("private") | F.col("can_view_private"))
    ok = F.col("__there") & F.col("role").isNotNull() & (F.col("role").isin(*DM_ROLES) | granted)
    return own.select(*requests.columns, F.coalesce(ok, F.lit(False)).alias("allowed"))


def upsert_grants(grants: DataFrame, changes: DataFrame) -> DataFrame:
    """Grants after changes of (campaign_id, principal_id, actor_id, can_control, can_view_private); null keeps what was."""
    keys = ["campaign_id", "principal_id", "actor_id"]
    both = grants.join(changes.select(*keys, F.col("can_control").alias("c"), F.col("can_view_private").alias("p")), keys, "full_outer")
    return both.select(*keys, F.coalesce("c", "can_control", F.lit(False)).alias("can_control"), F.coalesce("p", "can_view_private", F.lit(False)).alias("can_view_private"))


def revoke(memberships: DataFrame, grants: DataFrame, revoked: DataFrame) -> tuple[DataFrame, DataFrame]:
    keys = ["campaign_id", "principal_id"]
    return memberships.join(revoked, keys, "left_anti"), grants.join(revoked, keys, "left_anti")


def insert_absent(rows: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    return rows.unionByName(new.dropDuplicates(keys).join(rows.select(*keys), keys, "left_anti"))


def authority(memberships: DataFrame, grants: DataFrame) -> DataFrame:
    """campaign_id, principal_id and fingerprint of role and ordered grants."""
    keys = ["campaign_id", "principal_id"]
    own = grants.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("actor_id", "can_control", "can_view_private"))).alias("actor_grants"))
    both = memberships.select(*keys, "role").join(own, keys, "full_outer").withColumn("actor_grants", F.coalesce("actor_grants", F.expr("cast(array() as array<struct<actor_id:string,can_control:boolean,can_view_private:boolean>>)")))
    return both.select(*keys, F.sha2(F.to_json(F.struct("actor_grants", "campaign_id", "principal_id", "role"), {"ignoreNullFields": "false"}), 256).alias("fingerprint"))


def mutation_lock(locks: Column, domain: str) -> Column:
    """The first of an array of locks (id, domains) whose domains hold one; null if none does."""
    held = F.filter(locks, lambda x: F.array_contains(x["domains"], domain) | F.array_contains(x["domains"], "*"))
    return F.when(F.size(held) > 0, F.element_at(held, 1)["id"])


def sign_context(secret: bytes, **fields: str) -> dict:
    """A signed context of exactly the known fields."""
    if set(fields) != set(FIELDS):
        raise ValueError("a context has exactly its known fields")
    return sign(fields, secret)


def verify_context(envelope: dict, secret: bytes, *, max_age: int, now: float | None = None, **expected: str) -> dict:
    """The fields of a signed context that is fresh and has the expected values; ValueError otherwise."""
    from datetime import datetime

    fields = verify(envelope, secret)
    if set(fields) != set(FIELDS):
        raise ValueError("a context has exactly its known fields")
    issued = datetime.fromisoformat(fields["issued_at"])
    if issued.tzinfo is None:
        raise ValueError("issued_at needs a time zone")
    age = (time.time() if now is None else now) - issued.timestamp()
    if age < -FUTURE_SKEW or age > max_age:
        raise ValueError("the context is too old or from the future")
    for name, value in expected.items():
        if fields.get(name) != value:
            raise ValueError(f"{name} differs")
    return fields


class NonceGuard:
    """Refuses a nonce seen within a retention window; `dropDuplicatesWithinWatermark` does so for streams."""

    def __init__(self, retention: float, most: int = 100_000):
        self.retention, self.most, self.seen = retention, most, {}

    def remember(self, nonce: str, now: float) -> None:
        self.seen = {k: t for k, t in self.seen.items() if t > now - self.retention}
        if nonce in self.seen:
            raise ValueError("the nonce was used before")
        if len(self.seen) >= self.most:
            raise ValueError("too many nonces")
        self.seen[nonce] = now


def context_fingerprint(fields: dict) -> str:
    return digest(fields)


#: Fixed value: who may vouch for a principal.
TRUSTED = "trusted-host"


def context_problems(contexts: DataFrame, context_id: str) -> DataFrame:
    """subject and problem of stored contexts whose fields couldn't have been signed; signatures themselves are checked by `verify_context`."""
    from palimpsest.operators.contracts import SHA256, violations

    needed = ("host", "channel", "actor_principal", "conversation_principal", "session_id")
    checks = {f"{c} is missing": F.trim(F.coalesce(c, F.lit(""))) != "" for c in needed}
    zone = F.col("issued_at").rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$") & F.try_to_timestamp("issued_at").isNotNull()
    return violations(contexts, context_id, checks | {
        "the epoch is negative": F.col("authorization_epoch") >= 0, "the source isn't trusted": F.col("principal_source") == TRUSTED,
        "the nonce needs 1 to 128 characters": F.length(F.trim("nonce")).between(1, 128), "issued_at needs a time zone": zone, "the signature is no digest": F.lower(F.trim("signature")).rlike(SHA256),
    })


def audit_receipts(writes: DataFrame, contexts: DataFrame, context_id: str) -> DataFrame:
    """Writes (context id, tool, revision, ..) with who made them: the fields that every write keeps; without a context they are null."""
    kept = ("actor_principal", "conversation_principal", "tenant_id", "campaign_id", "session_id", "authorization_epoch", "nonce")
    return writes.join(contexts.select(context_id, *kept), context_id, "left")
