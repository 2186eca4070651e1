"""Embedding profiles and encoders; a model runs in Arrow batches, once a distinct text."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Profile:
    key: str
    language: str
    size: int

    @property
    def model_id(self) -> str:
        return f"embedding-{self.key}"


def profile_for_language(profiles: list[Profile], language: str) -> Profile:
    """The profile of a normalised language, else a multilingual one, else the first."""
    if not profiles:
        raise ValueError("no profile is configured")
    for want in (language, "multi"):
        for p in profiles:
            if p.language == want:
                return p
    return profiles[0]


def hashed_encoder(size: int) -> Callable[[list[str]], np.ndarray]:
    """A deterministic stand-in for a model: signed word hashes, normalised, in float32."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=8).digest(), "big")
                out[i, h % size] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)

    return encode


def embed(rows: DataFrame, text: str, make: Callable[[], Callable[[list[str]], np.ndarray]], into: str = "embedding") -> DataFrame:
    """Add the embedding of each text; `make` builds the model once a task, and equal texts are encoded once."""

    @F.pandas_udf("array<float>")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for batch in batches:
            yield pd.Series([None if t is None else list(map(float, v)) for t, v in zip(batch, model([t or "" for t in batch]), strict=True)])

    unique = rows.select(text).where(F.col(text).isNotNull()).distinct().withColumn(into, encoded(F.col(text)))
    return rows.join(unique, text, "left")


def configured_profiles(setting: str | None, known: dict[str, Profile], aliases: dict[str, str] | None = None, default: str | None = None) -> list[Profile]:
    """The profiles that a comma-separated setting names, once each, in order; ValueError for an unknown name or none."""
    names = [n.strip().lower() for n in (default or "" if setting is None else setting).split(",") if n.strip()]
    keys = list(dict.fromkeys((aliases or {}).get(n, n) for n in names))
    unknown = [k for k in keys if k not in known]
    if unknown:
        raise ValueError(f"unknown profiles {unknown}; choose from {', '.join(known)}")
    if not keys:
        raise ValueError("no profile is configured")
    return [known[k] for k in keys]


def choose_profile(profiles: list[Profile], known: dict[str, Profile], *, key: str | None = None, language: str | None = None, aliases: dict[str, str] | None = None) -> Profile:
    """The profile of a key or alias, else that of a language among those configured."""
    if not key:
        return profile_for_language(profiles, language or "multi")
    found = known.get((aliases or {}).get(key.casefold(), key.casefold()))
    if found is None:
        raise ValueError(f"unknown profile {key!r}")
    return found
