"""Benchmark decontamination by pigeonhole edit matching.

A benchmark item with an error budget of k is cut into k + 1 pieces; within k
edits at least one piece survives unchanged.  One automaton finds all pieces in
a text; around each hit Myers' bit-parallel distance decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.batches import annotate, filtered, fresh, named, once, table, without

#: Edits allowed for each character of a normalised item.
ERROR_RATE = 0.08
#: Characters of items that one automaton, and so one broadcast, holds; larger benchmarks are matched block by block.
BLOCK_CHARS = 8 << 20

_ALNUM = bytes(c if chr(c).isalnum() or c > 127 else 32 for c in range(256))


def normalised(text: str) -> str:
    """Lower case; ASCII signs and white space become single spaces."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_ALNUM).split()).decode()


def budget(item: str, rate: float) -> int:
    """Edits allowed: the rate's share of the length, fewer than its characters."""
    return min(max(1, int(len(item) * rate)), max(0, len(item) - 1)) if len(item) >= 16 else 0


def cut(item: str, k: int) -> Iterator[tuple[int, str]]:
    """k + 1 pieces of nearly equal length, with their offsets."""
    for j in range(k + 1):
        a, b = j * len(item) // (k + 1), (j + 1) * len(item) // (k + 1)
        yield a, item[a:b]


def best_match(masks: dict[str, int], m: int, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring, and the end of the first such."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, least, at = full, 0, m, m, 0
    for j, c in enumerate(text):
        eq = masks.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        if score < least:
            least, at = score, j + 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return least, at


def bordered(text: str, start: int, end: int) -> bool:
    """Whether a span begins and ends with a word; scripts that are written without spaces have borders everywhere."""
    return all(not c or c == " " or ord(c) > 0x2E7F for c in (text[max(0, start - 1) : start], text[end : end + 1]))


class Matcher:
    """All items of a block: the automaton of their pieces and the masks of each."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items: list[tuple[list[int], str, int, dict[str, int]]] = []
        self.automaton = ahocorasick.Automaton()
        same: dict[str, list[int]] = {}
        for item_id, text in items:
            if norm := normalised(text):
                same.setdefault(norm, []).append(item_id)
        pieces: dict[str, list[tuple[int, int]]] = {}
        for norm, ids in same.items():
            masks: dict[str, int] = {}
            for j, c in enumerate(norm):
                masks[c] = masks.get(c, 0) | 1 << j
            k = budget(norm, rate)
            for offset, piece in cut(norm, k):
                pieces.setdefault(piece, []).append((len(self.items), offset))
            self.items.append((sorted(set(ids)), norm, k, masks))
        for piece, places in pieces.items():
            self.automaton.add_word(piece, (len(piece), places))
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(item id, distance, end in the normalised text) of each item within its budget, by item id."""
        return sorted((i, d, at) for n, (d, at) in self.matches(text).items() for i in self.items[n][0])

    def holds(self, text: str) -> bool:
        """Whether any item is within its budget."""
        return bool(self.matches(text, first=True))

    def matches(self, text: str, first: bool = False) -> dict[int, tuple[int, int]]:
        """Distance and end by number of item; with `first`, of no more than one item."""
        if not self.items:
            return {}
        norm = normalised(text)
        found: dict[int, tuple[int, int]] = {}
        tried: dict[int, int] = {}
        for end, (size, places) in self.automaton.iter(norm):
            for n, offset in places:
                if n in found:
                    continue
                _, item, k, masks = self.items[n]
                start = end + 1 - size - offset
                if start < 0 - k or start + len(item) - k > len(norm):
                    continue
                # A start tried before was searched with k characters to spare on either side.
                if tried.get(n) == start:
                    continue
                if not k and not bordered(norm, start, start + len(item)):
                    continue
                tried[n] = start
                if norm.startswith(item, max(0, start)):
                    found[n] = (0, max(0, start) + len(item))
                else:
                    low = max(0, start - k)
                    distance, at = best_match(masks, len(item), norm[low : start + len(item) + k])
                    if distance <= k:
                        found[n] = (distance, low + at)
                if first and found:
                    return found
        return found


def blocks(items: DataFrame, item_id: str, text: str) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of a bounded number of characters; rows with a null id or text are left out."""
    own = items.select(F.col(f"`{item_id}`").cast("long").alias("item_id"), F.col(f"`{text}`").cast("string").alias("text")).where("item_id is not null and text is not null")
    n = 1 + (own.agg(F.sum(F.length("text"))).first()[0] or 0) // BLOCK_CHARS
    for b in range(n):
        yield [(r.item_id, r.text) for r in own.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).orderBy("item_id", "text").collect()]


def match(docs: DataFrame, items: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = ERROR_RATE, keep: list[str] | None = None) -> DataFrame:
    """Add `matches`, the benchmark items that a whole text holds within their budgets.

    Each match has item_id, distance and the end in the normalised text, at the
    first place found.  Null and empty texts, and empty benchmarks, match
    nothing.  Items with one normalised text match together; items of under 16
    normalised characters must be there unchanged, as whole words.  Repeated rows
    get the same matches; a column named matches, in any case, gives way.
    """
    kept = without(docs.select(*[F.col(f"`{c}`") for c in keep]) if keep is not None else docs, ["matches"]).columns
    kind = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("item_id", "distance", "end")]))
    out, found = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*kept, text])]), []
    own = blocks(items, item_id, item_text)
    block = next(own)
    while block is not None:
        later = next(own, None)
        sent, key = _sent(docs.sparkSession, block, rate)

        def compute(piece: pa.RecordBatch, at: int, sent=sent, key=key) -> list[pa.Array]:
            matcher = once(key, lambda: Matcher(sent.value, rate))
            rows = [matcher.find(v) if v else [] for v in piece.column(at).to_pylist()]
            return [pa.array([[dict(zip(("item_id", "distance", "end"), r, strict=True)) for r in found] for found in rows], pa.list_(pa.struct([(n, pa.int64()) for n in ("item_id", "distance", "end")])))]

        found.append(fresh(out, "__found"))
        out = annotate(out, text, [(found[-1], kind)], compute, [*kept, *found[:-1]] if later is None else None, key=key)
        block = later
    return out.select(*[F.col(f"`{c}`") for c in kept], F.array_sort(F.concat(*found)).alias("matches"))


def _sent(spark: SparkSession, block: list[tuple[int, str]], rate: float):
    """A block sent to the executors, and the name of its matcher."""
    return spark.sparkContext.broadcast(block), named("pieces", repr((rate, block)).encode("utf-8", "replace"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark item that it holds."""
    found = match(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.select("doc_id", F.explode("matches").alias("m")).select("doc_id", "m.item_id", "m.distance", "m.end")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that hold a benchmark item; all columns of the rest stay as they are.

    Null and empty texts, repeated rows and columns of any name are kept.
    """
    for block in blocks(table(spark, sf_dir, "benchmark"), "item_id", "text"):
        sent, key = _sent(spark, block, ERROR_RATE)

        def clean(piece: pa.RecordBatch, at: int, sent=sent, key=key) -> np.ndarray:
            matcher = once(key, lambda: Matcher(sent.value, ERROR_RATE))
            return np.array([not (v and matcher.holds(v)) for v in piece.column(at).to_pylist()], bool)

        docs = filtered(docs, "text", clean, key)
    return docs
