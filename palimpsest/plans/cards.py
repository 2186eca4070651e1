"""Portable descriptors: assets, citations, actor cards, packages and import-job documents, built and checked as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions.hashing import encoded_document, json_sha256
from palimpsest.operators.contracts import SHA256, missing, union, violations

#: Where content lies, the kind of asset that an actor's image is, and the parts of an import job's document.
BLOBS, IMAGE = "blobs/sha256/", "actor_image"
PARTS = {"payload": "{}", "inspection": "{}", "candidates": "[]", "validation": "{}", "result": "{}"}


def source_ref(source_key: Column, chunk_key: Column, page: Column | None = None, note: Column | None = None) -> Column:
    """A citation of a chunk; no page is null, no note is empty."""
    return F.struct(source_key.alias("source_key"), chunk_key.alias("chunk_key"), (F.lit(None) if page is None else page).cast("int").alias("page"), F.coalesce(F.lit("") if note is None else note, F.lit("")).alias("note"))


def blob_descriptors(assets: DataFrame, content: str = "content") -> DataFrame:
    """Assets with checksum, size in bytes and blob_key in place of their content; null content counts as empty."""
    raw = F.coalesce(F.col(content).cast("binary"), F.lit(b""))
    sum_ = F.sha2(raw, 256)
    return assets.withColumns({"checksum": sum_, "size": F.octet_length(raw).cast("long"), "blob_key": F.concat(F.lit(BLOBS), sum_)}).drop(content)


def _given(column: str, most: int) -> Column:
    return F.length(F.trim(F.coalesce(column, F.lit("")))).between(1, most)


def asset_problems(assets: DataFrame) -> DataFrame:
    """subject (asset_key) and problem of descriptors (asset_key, kind, name, media_type, checksum, size, blob_key, license, attribution)."""
    bounds = {"asset_key": 300, "kind": 100, "name": 500, "media_type": 100, "license": 300, "attribution": 3000}
    return violations(assets, "asset_key", {f"the {c.replace('_', ' ')} needs 1 to {n} characters": _given(c, n) for c, n in bounds.items()} | {
        "the checksum is no SHA-256": F.col("checksum").rlike(SHA256), "the blob key isn't the checksum's": F.col("blob_key") == F.concat(F.lit(BLOBS), "checksum"), "the size isn't positive": F.col("size") >= 1,
    })


def actor_cards(actors: DataFrame) -> DataFrame:
    """actor_id and card, a struct, of actors (actor_id, version, system_id, actor_type, name, player_name, summary, sheet, notes, image_asset_key, image_alt)."""
    image = F.when(F.col("image_asset_key").isNotNull(), F.struct(F.col("image_asset_key").alias("asset_key"), F.coalesce("image_alt", F.lit("")).alias("alt")))
    card = F.struct(F.col("actor_id").alias("id"), "version", "system_id", "actor_type", "name", "player_name", F.coalesce("summary", F.lit("")).alias("summary"), F.coalesce("sheet", F.lit("{}")).alias("sheet"), F.coalesce("notes", F.lit("{}")).alias("notes"), image.alias("image"))
    return actors.select("actor_id", card.alias("card"))


def card_problems(cards: DataFrame, assets: DataFrame, system_id: str | None = None) -> DataFrame:
    """subject (actor_id) and problem of cards; an image must be an asset (asset_key, kind) of its own kind."""
    own = cards.select("actor_id", "card.*")
    checks = {
        "the id isn't portable": F.col("id").rlike(r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,299}$"), "the version is missing": _given("version", 100), "another system is expected": F.lit(True) if system_id is None else F.col("system_id") == system_id,
        "the type is missing": _given("actor_type", 100), "the name is missing": _given("name", 300), "the player's name is empty": F.col("player_name").isNull() | _given("player_name", 300),
    }
    imaged = own.where(F.col("image").isNotNull()).select("actor_id", F.col("image.asset_key").alias("ref"))
    wrong = imaged.join(assets.where(F.col("kind") != IMAGE).select(F.col("asset_key").alias("ref")).distinct(), "ref", "left_semi").select(F.col("actor_id").cast("string").alias("subject"), F.lit("the image is another kind of asset").alias("problem"))
    return union([violations(own, "actor_id", checks), missing(imaged, "ref", assets, "asset_key", "actor_id", "unknown image "), wrong]).distinct()


def package_checksums(packages: DataFrame, body: str) -> DataFrame:
    """Packages with the digest of the canonical JSON of their body."""
    return packages.withColumn("checksum", json_sha256(F.col(body)))


def import_document(**parts: Column) -> Column:
    """An import job's document, encoded; parts are JSON texts, those not given or null are empty."""
    if set(parts) - set(PARTS):
        raise ValueError("an import document has exactly its known parts")
    pieces = [F.concat(F.lit(f'"{k}":'), F.coalesce(parts[k], F.lit(v)) if k in parts else F.lit(v)) for k, v in PARTS.items()]
    return encoded_document(F.concat(F.lit("{"), F.concat_ws(",", *pieces), F.lit("}")))


def with_import_document(jobs: DataFrame, **parts: Column) -> DataFrame:
    """Jobs with the document's columns: document_codec, document_uncompressed_size, document_checksum and compressed_document."""
    names = {"codec": "document_codec", "size": "document_uncompressed_size", "id": "document_checksum", "payload": "compressed_document"}
    own = jobs.withColumn("__document", import_document(**parts))
    return own.withColumns({v: F.col(f"__document.{k}") for k, v in names.items()}).drop("__document")
