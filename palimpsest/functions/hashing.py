"""Content addresses: canonical JSON, digests, signatures and bounded compression.

Spark has no canonical JSON, HMAC or zlib, so these are Arrow batches of the
standard library; digests are native.
"""

from __future__ import annotations

import hashlib
import hmac
import json
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bound of a document's size, and of what a stored response keeps uncompressed.
DOCUMENT_BYTES, RESPONSE_BYTES = 64 << 20, 64 << 10
DOCUMENT = "struct<id:string,codec:string,size:long,payload:binary>"


def canonical(value: object) -> str:
    """Sorted keys, no spaces, characters as they are."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def digest(value: object) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def sign(payload: dict, secret: bytes) -> dict:
    return payload | {"signature": hmac.new(secret, canonical(payload).encode(), hashlib.sha256).hexdigest()}


def verify(envelope: dict, secret: bytes) -> dict:
    """The payload of a signed envelope; ValueError where the signature is missing or wrong."""
    payload = {k: v for k, v in envelope.items() if k != "signature"}
    given = envelope.get("signature")
    if not isinstance(given, str) or not given:
        raise ValueError("the envelope has no signature")
    if not hmac.compare_digest(given, sign(payload, secret)["signature"]):
        raise ValueError("the signature is wrong")
    return payload


def encode_document(value: object) -> dict:
    raw = canonical(value).encode()
    if len(raw) > DOCUMENT_BYTES:
        raise ValueError("the document is too large")
    return {"id": hashlib.sha256(raw).hexdigest(), "codec": "zlib", "size": len(raw), "payload": zlib.compress(raw, 1)}


def decode_document(document: dict) -> object:
    """The value; ValueError on any difference: codec, size, canonical form or id."""
    if document["codec"] != "zlib" or not 0 <= document["size"] <= DOCUMENT_BYTES:
        raise ValueError("unknown codec or size")
    engine = zlib.decompressobj()
    try:
        raw = engine.decompress(document["payload"], document["size"] + 1)
    except zlib.error as e:
        raise ValueError("damaged payload") from e
    if len(raw) != document["size"] or not engine.eof or engine.unused_data:
        raise ValueError("the size differs")
    value = json.loads(raw)
    if canonical(value).encode() != raw or hashlib.sha256(raw).hexdigest() != document["id"]:
        raise ValueError("the content differs from its address")
    return value


def _canonical_batch(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else canonical(json.loads(t)))


def _encode_batch(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([encode_document(json.loads(t)) for t in text], columns=["id", "codec", "size", "payload"])


def _decode_batch(id: pd.Series, codec: pd.Series, size: pd.Series, payload: pd.Series) -> pd.DataFrame:
    rows = []
    for i, c, s, p in zip(id, codec, size, payload, strict=True):
        try:
            rows.append((canonical(decode_document({"id": i, "codec": c, "size": int(s), "payload": bytes(p)})), None))
        except (ValueError, TypeError, KeyError) as e:
            rows.append((None, str(e)))
    return pd.DataFrame(rows, columns=["value", "error"])


def canonical_json(text: Column) -> Column:
    """Canonical form of JSON text; null stays null."""
    return F.pandas_udf(_canonical_batch, "string")(text)


def json_sha256(text: Column) -> Column:
    return F.sha2(canonical_json(text), 256)


def encoded_document(text: Column) -> Column:
    return F.pandas_udf(_encode_batch, DOCUMENT)(text)


def decoded_document(id: Column, codec: Column, size: Column, payload: Column) -> Column:
    """Canonical JSON of each document, or why it fails; it fails closed."""
    return F.pandas_udf(_decode_batch, "struct<value:string,error:string>")(id, codec, size, payload)


def hmac_sha256(text: Column, secret: bytes) -> Column:
    def signed(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else hmac.new(secret, v.encode(), hashlib.sha256).hexdigest())

    return F.pandas_udf(signed, "string")(text)


def record_checksum(metadata_json: Column, payload: Column) -> Column:
    """SHA-256 of canonical metadata, a zero byte, and the compressed bytes."""
    return F.sha2(F.concat(F.encode(canonical_json(metadata_json), "utf-8"), F.lit(b"\x00"), payload), 256)


def chunk_key(source_key: Column, section: Column, chunk: Column, content: Column) -> Column:
    return F.concat(source_key, F.lit("/section-"), section.cast("string"), F.lit("/chunk-"), chunk.cast("string"), F.lit("-"), F.substring(F.sha2(content, 256), 1, 16))


def stored_response(response: dict) -> dict:
    """A response as it is kept: compressed in an envelope where it is large and that is smaller."""
    import base64

    raw = canonical(response).encode()
    if len(raw) < RESPONSE_BYTES:
        return response
    packed = {"encoding": "zlib+base64", "size": len(raw), "sha256": hashlib.sha256(raw).hexdigest(), "data": base64.b64encode(zlib.compress(raw)).decode()}
    return packed if len(canonical(packed).encode()) < len(raw) else response


def public_response(stored: dict) -> dict:
    """The response behind an envelope; ValueError where it is damaged."""
    import base64

    if stored.get("encoding") != "zlib+base64":
        return stored
    if not 0 <= stored["size"] <= DOCUMENT_BYTES:
        raise ValueError("unknown size")
    raw = zlib.decompressobj().decompress(base64.b64decode(stored["data"], validate=True), stored["size"] + 1)
    if len(raw) != stored["size"] or hashlib.sha256(raw).hexdigest() != stored["sha256"]:
        raise ValueError("the stored response is damaged")
    return json.loads(raw)


def retired_key(key: Column, checksum: Column, occurrence: Column, most: int = 300) -> Column:
    """stem@checksum12, with -2, -3 on repeats, cut to a length."""
    suffix = F.concat(F.lit("@"), F.substring(checksum, 1, 12), F.when(occurrence > 1, F.concat(F.lit("-"), occurrence.cast("string"))).otherwise(""))
    return F.concat(F.substring(key, F.lit(1), F.lit(most) - F.length(suffix)), suffix)
