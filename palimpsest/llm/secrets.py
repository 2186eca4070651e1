"""Secret scans: patterns, and novelty against dictionaries primed with code and identifiers.

Three patterns give the base spans.  Further candidates are long tokens that
follow a sensitive word, or a name with one and '='; each is compressed after its surroundings with a
dictionary of common code and identifiers, and is reported when the bytes it
adds come near its length, so that nothing known explains it.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from palimpsest.llm.batches import annotate, once, table

KINDS = ("assign", "access", "hex", "novel")
_ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_LONG = re.compile(r"[A-Za-z0-9+/_=.~-]{16,}")
#: A candidate up to the last '=' that ends a name and has a value after it.
_NAMED = re.compile(r"(?:.*[^A-Za-z0-9_.-])?[A-Za-z_][A-Za-z0-9_.-]*=+(?=[^=])")
#: Words and names put together from words: novel to the dictionaries, but no secrets, unless a name is given them or they
#: can't be spoken.
_WORDS = re.compile(r"(?:[A-Z]?[a-z]{2,}+|[A-Z]{2,}+|[-._/~+=])++")
_UNSPOKEN = re.compile(r"[bcdfghjklmnpqrstvwxz]{5}|[BCDFGHJKLMNPQRSTVWXZ]{5}")
_GIVEN = re.compile(r"""[=:]["'\s]*$""")
#: Words that make what follows sensitive.
_SENSITIVE = re.compile(r"(?i:password|passwd|pwd|secret|token|api[_-]?key|private[_-]?key|access[_-]?key|auth|bearer|credential|signature|client[_-]?id)")
#: Characters before a candidate that are its surroundings, and those of them where a sensitive word counts.
SURROUNDINGS, CONTEXT = 256, 48
#: Least bytes that compression must add for each byte of the candidate.
NOVELTY = 0.72

#: What is common in code and its settings.
CODE = """import os\nimport sys\nfrom collections import defaultdict\ndef main(args):\n    return None\nclass Client(object):\n    def __init__(self, host, port, username, password):\n        self.username = username\n        self.password = password
const config = { apiKey: process.env.API_KEY, token: process.env.TOKEN, secret: null };\nfunction getToken(request, response) { return request.headers.authorization; }\npublic static void main(String[] args) { System.out.println("Hello"); }
export AWS_ACCESS_KEY_ID=\nexport AWS_SECRET_ACCESS_KEY=\nAuthorization: Bearer \npassword: "changeme"\nsecret_key = "your-secret-key-here"\ntoken = "placeholder-token-value"\nDATABASE_URL=postgresql://user:password@localhost:5432/database
https://www.example.com/index.html http://localhost:8080/api/v1/ application/json text/html; charset=utf-8 user@example.com /usr/local/bin /home/user/.ssh/id_rsa.pub\nabcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 xxxxxxxxxxxxxxxx 0000000000000000"""
IDENTIFIERS = " ".join(a + b for a in ("get", "set", "is", "has", "to", "from", "create", "update", "delete", "find", "load", "save", "read", "write", "parse", "user_", "client_", "access_", "auth_", "session_", "config_", "default_") for b in ("Token", "Secret", "Password", "Key", "ApiKey", "Name", "Value", "Id", "Config", "Client", "Session", "Request", "Response", "String", "Number", "Url", "Path", "File", "Index", "Count", "token", "secret", "password", "key", "name", "value", "id", "config"))


def _compressor() -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict((IDENTIFIERS + "\n" + CODE).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=6, dict_data=primed, write_content_size=False)


def novelty(candidate: str, before: str, after: str, compressor: zstandard.ZstdCompressor) -> float:
    """Marginal compressed bytes of the candidate among its surroundings, for each of its bytes."""
    around = (before + "\n" + after + "\n").encode("utf-8", "replace")
    raw = candidate.encode()
    return (len(compressor.compress(around + raw)) - len(compressor.compress(around))) / len(raw)


def scan(text: str, compressor: zstandard.ZstdCompressor) -> list[tuple[int, int, str]]:
    """Spans (start, end, kind) in code points, end exclusive, sorted by start and then kind as in KINDS.

    Novel spans overlap no base span.
    """
    base = []
    if "=" in text or ":" in text:
        base += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        base += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    found, low, high = list(base), 0, -1
    base.sort()
    for m in _LONG.finditer(text):
        own, start, end = m.group(), m.start(), m.end()
        name = _NAMED.match(own) if "=" in own else None
        if name and _LONG.fullmatch(own, name.end()):
            own, start = own[name.end() :], start + name.end()
        # Base spans that begin before the candidate's end; the farthest end among them tells whether one reaches into it.
        while low < len(base) and base[low][0] < end:
            high, low = max(high, base[low][1]), low + 1
        if high > start or not _SENSITIVE.search(text[max(0, m.start() - CONTEXT) : start]):
            continue
        if _WORDS.fullmatch(own) and not _UNSPOKEN.search(own) and not _GIVEN.search(text[max(0, start - 4) : start]):
            continue
        if novelty(own, text[max(0, start - SURROUNDINGS) : start], text[end : end + SURROUNDINGS], compressor) >= NOVELTY:
            found.append((start, end, 3))
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda s: (s[0], s[2], s[1]))]


def find(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add n_assign, n_access, n_hex, n_novel, base_sha256 and spans of every whole text.

    A null text counts as empty: no spans, and the digest of the empty string.
    Repeated rows get the same answers; an empty table gives an empty table, and
    columns with the new names, in any case, give way.
    """

    def compute(piece: pa.RecordBatch, at: int) -> list[pa.Array]:
        compressor = once("secrets", _compressor)
        counts, digests, joined = [[], [], [], []], [], []
        for value in piece.column(at).to_pylist():
            spans = scan(value or "", compressor)
            for k, kind in enumerate(KINDS):
                counts[k].append(sum(s[2] == kind for s in spans))
            named = [(s[2], f"{s[2]}:{s[0]}:{s[1]}") for s in spans]
            digests.append(hashlib.sha256(",".join(n for k, n in named if k != "novel").encode()).hexdigest())
            joined.append(",".join(n for _, n in named))
        return [*(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(joined, pa.string())]

    fields = [*((f"n_{k}", T.LongType()) for k in KINDS), ("base_sha256", T.StringType()), ("spans", T.StringType())]
    return annotate(docs, text, fields, compute, keep, key="secrets")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the counts, base_sha256 and spans of every document."""
    return find(table(spark, sf_dir, "documents"), keep=["doc_id"])
