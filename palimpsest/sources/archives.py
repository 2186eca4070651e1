"""Content archives: a deterministic ZIP of a package descriptor and content-addressed blobs."""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile

import pandas as pd
from pyspark.sql import DataFrame

from palimpsest.functions.hashing import canonical, digest

#: When all entries were written, and the bound of an archive's contents.
WRITTEN, CONTENT_BYTES = (1980, 1, 1, 0, 0, 0), 512 << 20
DESCRIPTOR = "package.json"


def package_checksum(package: dict) -> str:
    return digest({k: v for k, v in package.items() if k != "checksum"})


def dumps(package: dict, blobs: dict[str, bytes]) -> bytes:
    """The same bytes for the same content: sorted entries, fixed times, the descriptor deflated, blobs stored."""
    for name, content in blobs.items():
        if hashlib.sha256(content).hexdigest() != name:
            raise ValueError(f"blob {name} differs from its address")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        entries = [(DESCRIPTOR, canonical(package | {"checksum": package_checksum(package)}).encode(), zipfile.ZIP_DEFLATED)]
        for path, content, method in [*entries, *((f"blobs/{n}", blobs[n], zipfile.ZIP_STORED) for n in sorted(blobs))]:
            info = zipfile.ZipInfo(path, WRITTEN)
            info.compress_type, info.external_attr, info.create_system = method, 0o600 << 16, 3
            archive.writestr(info, content)
    return out.getvalue()


def loads(content: bytes, most: int = CONTENT_BYTES) -> tuple[dict, dict[str, bytes]]:
    """Package and blobs; ValueError for anything that isn't as written: paths, sizes, encryption, addresses, checksum."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise ValueError("no archive") from e
    with archive:
        infos = archive.infolist()
        names = [i.filename for i in infos]
        if len(set(names)) != len(names):
            raise ValueError("a path is repeated")
        if any(n != DESCRIPTOR and not re.fullmatch(r"blobs/[0-9a-f]{64}", n) for n in names) or DESCRIPTOR not in names:
            raise ValueError("an unknown path")
        if any(i.flag_bits & 1 for i in infos):
            raise ValueError("an entry is encrypted")
        if sum(i.file_size for i in infos) > most:
            raise ValueError("the contents are too large")
        try:
            read = {i.filename: archive.read(i) for i in infos}
        except (zipfile.BadZipFile, RuntimeError) as e:
            raise ValueError("a damaged entry") from e
    package = json.loads(read.pop(DESCRIPTOR))
    blobs = {n.removeprefix("blobs/"): c for n, c in read.items()}
    if any(hashlib.sha256(c).hexdigest() != n for n, c in blobs.items()):
        raise ValueError("a blob differs from its address")
    if package.get("checksum") != package_checksum(package):
        raise ValueError("the package differs from its checksum")
    return package, blobs


def archive_entries(files: DataFrame, content: str = "content", path: str = "path") -> DataFrame:
    """path, entry, sha256, size and error of the archives of a binaryFile table; a bad archive is one row with its error."""

    def run(batches):
        for frame in batches:
            rows = []
            for p, c in zip(frame[path], frame[content], strict=True):
                try:
                    package, blobs = loads(bytes(c))
                    rows.append((p, DESCRIPTOR, package["checksum"], len(canonical(package)), None))
                    rows += [(p, n, n, len(b), None) for n, b in sorted(blobs.items())]
                except ValueError as e:
                    rows.append((p, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "entry", "sha256", "size", "error"]).astype({"size": "Int64"})

    return files.select(path, content).mapInPandas(run, "path string, entry string, sha256 string, size long, error string")
