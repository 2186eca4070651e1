"""Relevance scores as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions.text import fold, occurrences, term_count

#: Weights of the fields of a structured document.
FIELD_WEIGHTS = {
    "module_title": 8.0,
    "chapter_title": 6.0,
    "source_title": 5.0,
    "section_title": 5.0,
    "scene_title": 4.0,
    "heading_paths": 3.0,
    "keywords": 2.5,
    "tags": 2.0,
    "scene_type": 2.0,
    "chunk_type": 1.5,
    "content": 1.0,
}
#: A term's weight in a title, and how often it counts in the content.
TITLE_WEIGHT, CONTENT_CAP = 4.0, 8
RANK_CONSTANT = 60


def _summed(terms: Column, each) -> Column:
    return F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + each(t))


def lexical_score(terms: Column, title: Column, content: Column) -> Column:
    """Weighted occurrences of query terms as substrings, over the root of the content's terms.

    Terms count in the title without a cap and in the content up to a cap; a
    repeated query term counts again; no terms score 0; nulls count as empty.
    """
    title, body = fold(F.coalesce(title, F.lit(""))), fold(F.coalesce(content, F.lit("")))
    score = _summed(terms, lambda t: occurrences(title, t) * TITLE_WEIGHT + F.least(occurrences(body, t), F.lit(CONTENT_CAP)))
    return score / F.sqrt(F.greatest(term_count(content), F.lit(1)))


def structured_score(terms: Column, weights: dict[str, float] | None = None, **fields: Column) -> Column:
    """Occurrences in named fields by weight, without caps, over the root of the content's terms, 4 at least."""
    weights = FIELD_WEIGHTS if weights is None else weights
    folded = {name: fold(F.coalesce(value, F.lit(""))) for name, value in fields.items()}
    score = _summed(terms, lambda t: sum((occurrences(value, t) * weights.get(name, 1.0) for name, value in folded.items()), F.lit(0.0)))
    n = term_count(fields["content"]) if "content" in fields else F.lit(1)
    return score / F.sqrt(F.greatest(n, F.lit(4)))


def dot(left: Column, right: Column) -> Column:
    return F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine_similarity(left: Column, right: Column) -> Column:
    """0 where a vector is missing, empty or zero, or lengths differ."""
    norms = F.sqrt(dot(left, left)) * F.sqrt(dot(right, right))
    usable = (F.size(left) == F.size(right)) & (F.size(left) > 0) & (norms > 0)
    return F.when(F.coalesce(usable, F.lit(False)), dot(left, right) / norms).otherwise(F.lit(0.0))
