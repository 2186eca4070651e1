"""Fill-in-the-middle: a text's parts are put in another order, marked, and can be put back.

One numpy kernel handles the UTF-8 buffer of a whole batch: a table gives each
byte's class, a mask over adjacent bytes says where units begin, cumulative sums
that start anew with each document count them, and searchsorted finds the bytes
at which all rows are cut.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.batches import annotate, table, utf8

#: Marks of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Per cent of texts that are transformed, and of these, of those that begin with the suffix.
RATE, SUFFIX_FIRST = 100, 50
SEED = 7
#: Output bytes that are gathered at a time; eight bytes of places each.
GATHERED = 1 << 22
PLAIN, PSM, SPM = 0, 1, 2
FORMS = ("plain", "psm", "spm")

# Classes of bytes.
NEWLINE, BLANK, LETTER, LATER = range(4)


def byte_classes() -> np.ndarray:
    """The class of each byte: newline, other ASCII white space, the first byte of any other character, a later byte of one."""
    kind = np.full(256, LETTER, np.uint8)
    kind[[0x09, 0x0B, 0x0C, 0x0D, 0x20]] = BLANK
    kind[0x0A] = NEWLINE
    kind[0x80:0xC0] = LATER
    return kind


#: Whether a unit begins at a byte of the second class after one of the first, within a text.
BORDERS = {
    "line": np.array([[a == NEWLINE for _ in range(4)] for a in range(4)]),
    "word": np.array([[a <= BLANK < b for b in range(4)] for a in range(4)]),
    "character": np.array([[b != LATER for b in range(4)] for _ in range(4)]),
}


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """h1 to h4: the first four groups of eight hex digits of SHA-256 of `seed:doc_id`; a null id counts as the empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def begins(data: np.ndarray, offsets: np.ndarray, unit: str, kinds: np.ndarray) -> np.ndarray:
    """Whether a unit begins at each byte."""
    kind = kinds[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    first = first[:-1]
    if len(data):
        first[1:] |= BORDERS[unit][kind[:-1], kind[1:]]
    return first


def marked(data: np.ndarray, offsets: np.ndarray, marks: tuple[bytes, ...]) -> np.ndarray:
    """Whether each text holds any of the marks."""
    found = np.zeros(len(offsets) - 1, bool)
    for mark in marks:
        n = len(data) - len(mark) + 1
        if n <= 0:
            continue
        at = np.flatnonzero(data[:n] == mark[0])
        for k in range(1, len(mark)):
            at = at[data[at + k] == mark[k]]
        row = np.searchsorted(offsets, at, side="right") - 1
        found[row[at + len(mark) <= offsets[row + 1]]] = True
    return found


def gathered(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of spans, one after the other; places are held for a bounded number of bytes at a time."""
    total = np.concatenate(([0], np.cumsum(sizes)))
    out = np.empty(int(total[-1]), np.uint8)
    k = 0
    while k < len(starts):
        stop = max(int(np.searchsorted(total, total[k] + GATHERED, side="right")) - 1, k + 1)
        if stop == k + 1:
            out[total[k] : total[stop]] = data[starts[k] : starts[k] + sizes[k]]
        else:
            out[total[k] : total[stop]] = data[np.repeat(starts[k:stop] - total[k:stop], sizes[k:stop]) + np.arange(total[k], total[stop])]
        k = stop
    return out


def cut(data: np.ndarray, offsets: np.ndarray, h: np.ndarray, unit: str, marks: tuple[bytes, ...], rate: int, suffix_first: int, kinds: np.ndarray) -> tuple[np.ndarray, ...]:
    """n, form, bytes and characters of prefix and middle, and the output's bytes and bounds, of all rows together."""
    rows = len(offsets) - 1
    first = begins(data, offsets, unit, kinds)
    count = np.concatenate(([0], np.cumsum(first)))  # units that begin before each byte
    base = count[offsets[:-1]]
    n = count[offsets[1:]] - base
    ends = np.sort(h[:, :2] % (n + 1)[:, None], axis=1)
    # The byte at which unit k of a text begins is the first up to which k + 1 units have begun; the text's end for k = n.
    places = np.searchsorted(count, base[:, None] + ends + 1) - 1
    places = np.where(ends == n[:, None], offsets[1:, None], places)
    form = np.where(h[:, 3] % 100 < suffix_first, SPM, PSM)
    form[(np.diff(offsets) == 0) | (h[:, 2] % 100 >= rate) | marked(data, offsets, marks)] = PLAIN

    source = np.concatenate((data, np.frombuffer(b"".join(marks), np.uint8)))
    mark_size = np.array([len(m) for m in marks])
    mark_at = len(data) + np.concatenate(([0], np.cumsum(mark_size)[:-1]))
    part_at = np.column_stack((offsets[:-1], places[:, 1], places[:, 0]))  # prefix, suffix, middle
    part_size = np.column_stack((places[:, 0] - offsets[:-1], offsets[1:] - places[:, 1], places[:, 1] - places[:, 0]))
    starts, sizes = np.zeros((rows, 6), np.int64), np.zeros((rows, 6), np.int64)
    for f, order in ((PSM, (0, 1, 2)), (SPM, (1, 0, 2))):
        own = form == f
        for k, part in enumerate(order):
            starts[own, 2 * k], sizes[own, 2 * k] = mark_at[part], mark_size[part]
            starts[own, 2 * k + 1], sizes[own, 2 * k + 1] = part_at[own, part], part_size[own, part]
    plain = form == PLAIN
    starts[plain, 0], sizes[plain, 0] = offsets[:-1][plain], np.diff(offsets)[plain]
    out = gathered(source, starts.ravel(), sizes.ravel())
    characters = np.concatenate(([0], np.cumsum(kinds[data] != LATER)))
    return n, form, characters[places[:, 0]] - characters[offsets[:-1]], characters[places[:, 1]] - characters[places[:, 0]], out, np.concatenate(([0], np.cumsum(sizes.sum(axis=1))))


def transform(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", unit: str = "line", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: int = SEED, marks: tuple[str, str, str] = MARKS, keep: list[str] | None = None
) -> DataFrame:
    """Add n, form, prefix_chars, middle_chars and output of every whole text.

    Units are lines (with their newline), words (with the white space after
    them) or characters; what comes before a text's first word belongs to it.  A
    null or empty text, one that holds a mark, and those that aren't drawn stay
    plain; their lengths are null.  Equal ids draw alike, so repeated rows are
    transformed alike; a null id draws as the empty string.  An empty table gives
    an empty table; columns named as the new ones, in any case, give way.
    """
    if unit not in BORDERS:
        raise ValueError(f"unit must be one of {', '.join(BORDERS)}")
    if len({m[:1] for m in marks}) != 1 or any(m[:1] in m[1:] for m in marks) or any(a != b and b.startswith(a) for a in marks for b in marks) or len(set(marks)) < 3:
        raise ValueError("three marks that share a first character, don't hold it again, and don't begin each other")
    encoded = tuple(m.encode() for m in marks)
    fields = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output", T.StringType())]
    new = {x for x, _ in fields}
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in new]
    taken = {c.lower() for c in docs.columns}
    names = []
    for k in range(4):
        name = f"__h{k}"
        while name in taken:
            name += "_"
        names.append(name)
    drawn = docs.select("*", *[h.alias(x) for h, x in zip(draws(F.col(f"`{doc_id}`"), seed), names)])

    def compute(piece: pa.RecordBatch, at: int) -> list[pa.Array]:
        offsets, data = utf8(piece.column(at))
        h = np.column_stack([piece.column(piece.schema.get_field_index(x)).to_numpy() for x in names])
        n, form, prefix, middle, out, bounds = cut(data, offsets, h, unit, encoded, rate, suffix_first, byte_classes())
        plain = pa.array(form == PLAIN)
        lengths = [pc.if_else(plain, pa.scalar(None, pa.int64()), pa.array(x, pa.int64())) for x in (prefix, middle)]
        output = pa.Array.from_buffers(pa.large_string(), len(n), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(out)])
        return [pa.array(n, pa.int64()), pa.array(np.array(FORMS, object)[form], pa.string()), *lengths, output.cast(pa.string())]

    done = annotate(drawn, text, fields, compute, [*kept, *names])
    return done.select(*[F.col(f"`{c}`") for c in [*kept, *(x for x, _ in fields)]])


def restore(transformed: DataFrame, *, into: str = "restored", marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Add the exact text, rebuilt from output and form alone: the parts between the marks, put back in order."""
    any_mark = "|".join(rf"\Q{m}\E" for m in marks)
    parts = F.split("output", any_mark, -1)
    part = lambda k: F.get(parts, F.lit(k))
    text = F.when(F.col("form") == "psm", F.concat(part(1), part(3), part(2))).when(F.col("form") == "spm", F.concat(part(2), part(3), part(1))).otherwise(F.col("output"))
    kept = [c for c in transformed.columns if c.lower() != into.lower()]
    return transformed.select(*[F.col(f"`{c}`") for c in kept], text.alias(into))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n lines, form, lengths and the digests of the output and of the text rebuilt from it, of every document."""
    both = restore(transform(table(spark, sf_dir, "documents"), keep=["doc_id"]))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return both.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest("output").alias("output_sha256"), digest("restored").alias("restored_sha256"))


OP13_SQL = r"""
WITH own AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS lines,
         sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents),
drawn AS (
  SELECT doc_id, text, lines, len(lines) AS n,
         ('0x' || substr(h, 1, 8))::BIGINT % (len(lines) + 1) AS a, ('0x' || substr(h, 9, 8))::BIGINT % (len(lines) + 1) AS b,
         ('0x' || substr(h, 17, 8))::BIGINT % 100 AS c, ('0x' || substr(h, 25, 8))::BIGINT % 100 AS d
  FROM own),
parts AS (
  SELECT doc_id, text, n,
         CASE WHEN text = '' OR regexp_matches(text, '<P>|<S>|<M>') OR c >= 100 THEN 'plain' WHEN d < 50 THEN 'spm' ELSE 'psm' END AS form,
         coalesce(array_to_string(lines[1:least(a, b)], ''), '') AS prefix,
         coalesce(array_to_string(lines[least(a, b) + 1:greatest(a, b)], ''), '') AS middle,
         coalesce(array_to_string(lines[greatest(a, b) + 1:n], ''), '') AS suffix
  FROM drawn)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
              ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
