"""Byte-level BPE in Spark's higher-order functions.

A text is parted by the pre-tokenizer's pattern, and each part ("word") is
encoded for itself.  A word's merges are those whose token occurs in its bytes,
found in a literal map of ranks; a fold applies them, lowest rank first, each to
all places from left to right.  The pieces are kept as characters of a string,
one a piece, as Spark can replace within strings but not within arrays.  The
words that are most frequent in the whole table are encoded once and looked up,
a batch at a time; all others are encoded where they stand, so no word is
shuffled with its document and no result depends on which words are frequent.

Applying each rank once, in order, is what picking the lowest pair again and
again gives, if every token of the vocabulary is made from two tokens of lower
rank whenever it stands for itself; `read_ranks` refuses vocabularies in which
one isn't.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.batches import bounded_batches, durable, fresh, named, once, span_hashes, table, trim, utf8, without

DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"
#: A word is looked up if it makes up at least one in so many of all words, and has at most so many bytes; so at most
#: that many words are sent to the executors.
FREQUENT, LONGEST = 1 << 23, 48
#: Places of the literal rank map for each token, at least: the more, the fewer ranks are tried in vain.
SPARE = 2
#: The character of a token of more than one byte is its rank beyond this one; that of a byte is its own, of Latin 1.
FIRST = 0x10000
#: Unicode's White_Space, which the pattern's \s means; fixed values.
WHITE = r"\x09-\x0D\x20\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

#: Patterns by application: what its Java knows doesn't change.
_PATTERNS: dict[tuple[str, str], str] = {}


@dataclass(frozen=True)
class Ranks:
    """A vocabulary: the rank of each token, and the characters of the two pieces that each merge joins (none for a single byte)."""

    tokens: dict[bytes, int]
    find: list[str]


def parts_below(token: bytes, ranks: dict[bytes, int], limit: int) -> list[bytes]:
    """The pieces of `token` after all merges whose rank is below `limit`."""
    pieces = [token[i : i + 1] for i in range(len(token))]
    while len(pieces) > 1:
        rank, at = min((ranks.get(a + b, limit), i) for i, (a, b) in enumerate(zip(pieces, pieces[1:])))
        if rank >= limit:
            break
        pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]
    return pieces


def read_ranks(path: str) -> Ranks:
    """Read a file of lines `base64-token rank` (on the driver; some MB)."""
    with open(path, "rb") as f:
        tokens = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
    if sorted(tokens.values()) != list(range(len(tokens))) or any(bytes([b]) not in tokens for b in range(256)):
        raise ValueError("ranks must be 0, 1, 2 .. and hold all single bytes")
    find = [""] * len(tokens)
    mark = lambda t: chr(FIRST + tokens[t] if len(t) > 1 else t[0])
    for token, rank in tokens.items():
        if len(token) > 1:
            pair = parts_below(token, tokens, rank)
            if len(pair) != 2 or any(len(p) > 1 and tokens[p] >= rank for p in pair):
                raise ValueError(f"token {token!r} isn't made from two tokens of lower rank")
            find[rank] = "".join(map(mark, pair))
    return Ranks(tokens, find)


def _literal(values: list, kind: str) -> Column:
    """A literal array; folded by the optimizer, so it is made once a plan."""
    return F.from_json(F.lit(json.dumps(values, separators=(",", ":"))), f"array<{kind}>")


def _ranks_at(ranks: Ranks) -> Callable[[Column], Column]:
    """The literal rank map: the ranks of all tokens of more than one byte with the checksum of `x`."""
    size = 1 << (SPARE * len(ranks.tokens)).bit_length()
    held: list[list[int] | None] = [None] * size
    for token, rank in ranks.tokens.items():
        if len(token) > 1:
            at = zlib.crc32(token) % size
            held[at] = [*(held[at] or []), rank]
    literal = _literal(held, "array<int>")
    return lambda x: F.coalesce(F.get(literal, F.crc32(x).bitwiseAND(F.lit(size - 1))), F.array().cast("array<int>"))


def encoder(ranks: Ranks) -> Callable[[Column], Column]:
    """A function from a column of words, none of them empty, to one of their ids."""
    ranks_at, find = _ranks_at(ranks), _literal(ranks.find, "string")
    names = _literal([chr(FIRST + r) for r in range(len(ranks.tokens))], "string")
    single = F.array(*[F.lit(ranks.tokens[bytes([b])]) for b in range(256)])
    most = max(map(len, ranks.tokens))

    def encoded(raw: Column) -> Column:
        n = F.octet_length(raw)
        # Ranks of all tokens within the word, lengths one by one.  Ranks of other tokens with the same checksum are among
        # them; their pieces aren't side by side, so they join nothing.  For one byte the sequences run backwards and ask
        # for single bytes, which join nothing either.
        of_length = lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: ranks_at(F.substring(raw, i, k)))
        once_each = lambda k: F.array(F.array_distinct(F.flatten(of_length(k))))
        lengths = F.sequence(F.lit(2), F.least(n, F.lit(most)))
        # In a long word, each length's ranks are held once only, so at any time as many numbers as the word has bytes.
        found = F.when(n <= LONGEST, F.flatten(F.transform(lengths, of_length))).otherwise(F.flatten(F.transform(lengths, once_each)))
        found = F.sort_array(F.array_distinct(F.flatten(found)))
        merged = F.aggregate(found, F.decode(raw, "ISO-8859-1"), lambda m, r: F.replace(m, F.get(find, r), F.get(names, r)))
        points = F.transform(F.split(merged, ""), F.ascii)
        return F.transform(points, lambda c: F.when(c < FIRST, F.get(single, c)).otherwise(c - FIRST))

    # The bytes are bound to a name, or each mention of them would make them anew.
    return lambda word: F.element_at(F.transform(F.array(word.cast("binary")), encoded), 1)


def spelled(points: list[int]) -> str:
    """Code points as ranges of a character class."""
    out, i = [], 0
    while i < len(points):
        j = i
        while j + 1 < len(points) and points[j + 1] == points[j] + 1:
            j += 1
        out.append(f"\\x{{{points[i]:X}}}-\\x{{{points[j]:X}}}")
        i = j + 1
    return "".join(out)


def java_pattern(spark: SparkSession, pattern: str) -> str:
    r"""The pre-tokenizer's pattern for Java's expressions.

    \s becomes Unicode's white space, and \p{L} and \p{N} gain the letters and
    numbers that the `regex` library knows and this Java doesn't.
    """
    import regex

    held = (spark.sparkContext.applicationId, pattern)
    if held in _PATTERNS:
        return _PATTERNS[held]
    # Java's letters and numbers as runs, some hundreds: a run begins where the class of the code point before differs.
    at = lambda c: F.decode(F.unhex(F.lpad(F.hex(c), 8, "0")), "utf-32")
    usable = spark.range(0x110000).where("id < 55296 OR id > 57343")
    kinds = usable.select("id", *[f(at(F.col("id") - d).rlike(p)).alias(n) for p, k in ((r"\p{L}", "L"), (r"\p{N}", "N")) for d, n, f in ((0, k, lambda c: c), (1, f"b{k}", lambda c: F.when(~F.col("id").isin(0, 57344), c)))])
    edges = kinds.where("L IS DISTINCT FROM bL OR N IS DISTINCT FROM bN").orderBy("id").collect()
    java = {"L": set(), "N": set()}
    for edge, stop in zip(edges, [*(e.id for e in edges[1:]), 0x110000]):
        for kind in java:
            if edge[kind]:
                java[kind].update(range(edge.id, stop))
    classes = {r"\s": f"[{WHITE}]", r"\S": f"[^{WHITE}]"}
    for kind in java:
        name = f"\\p{{{kind}}}"
        test = regex.compile(name)
        more = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and c not in java[kind] and test.match(chr(c))]
        # What lies below the first is told apart by one comparison, before all ranges are tried.
        classes[name] = f"[{name}[[^\\x00-\\x{{{more[0] - 1:X}}}]&&[{spelled(more)}]]]" if more else name
    for name, own in classes.items():
        pattern = pattern.replace(name, own)
    _PATTERNS[held] = pattern
    return pattern


def words(text: str, pattern: str) -> Column:
    """The parts of a text; a null text has none."""
    return F.regexp_extract_all(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), F.lit(pattern), F.lit(0))


def frequent_words(docs: DataFrame, ranks: Ranks, pattern: str, *, text: str = "text") -> pa.Table:
    """The most frequent words of a table with their ids.

    Words are counted over the whole table.  Only those that make up one in
    FREQUENT of all words are kept, so there are FREQUENT at most.
    """
    counts = durable(docs.select(F.explode(words(text, pattern)).alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    often = counts.where((F.col("n") * FREQUENT >= total) & (F.octet_length("word") <= LONGEST))
    # Encoding is far more work than these few bytes suggest to the optimizer.
    dealt = often.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, often.count() // 20_000), "word")
    return dealt.select("word", encoder(ranks)(F.col("word")).alias("ids")).toArrow()


def hashes(array: pa.Array, step: int = 1 << 16) -> np.ndarray:
    """A hash of each string, some thousands at a time; see `span_hashes`."""
    out = [np.zeros(0, np.uint64)]
    for k in range(0, len(array), step):
        offsets, data = utf8(array.slice(k, step))
        out.append(span_hashes(data, offsets[:-1], offsets[1:]))
    return np.concatenate(out)


def looked_up(found: pa.ListArray, often: pa.Array, hashed: np.ndarray, known: pa.Array) -> pa.Array:
    """The parts of each row of words: the ids of known words up to the next word that isn't known, and that word.

    `often` are the known words in the order of their hashes, and `known` their
    ids.  A row's last part has no word.
    """
    all_words = found.flatten()
    distinct = all_words.dictionary_encode()
    place = np.full(len(distinct.dictionary), -1, np.int32)
    if len(often) and len(place):
        near = np.minimum(np.searchsorted(hashed, hashes(distinct.dictionary)), len(often) - 1)
        same = pc.equal(often.take(pa.array(near)), distinct.dictionary).to_numpy(zero_copy_only=False)
        place[same] = near[same]
    place = place[distinct.indices.to_numpy()]
    taken = known.take(pa.array(place, mask=place < 0))
    ends = np.asarray(found.offsets, np.int64)
    ends = ends[1:] - ends[0]
    # Parts in order: at each unknown word, and at each row's end, which comes after the word before it.
    rare = np.flatnonzero(place < 0)
    marks = np.sort(np.concatenate((2 * rare + 1, 2 * ends)), kind="stable")
    at = marks >> 1
    runs = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.asarray(taken.offsets)[at])), pa.int32()), taken.values)
    named = all_words.take(pa.array(at, mask=marks % 2 == 0))
    rows = np.concatenate(([0], np.searchsorted(rare, ends) + np.arange(1, len(ends) + 1)))
    return pa.ListArray.from_arrays(pa.array(rows, pa.int32()), pa.StructArray.from_arrays([runs, named], ["run", "word"]))


def encode(docs: DataFrame, ranks: Ranks, pattern: str, *, text: str = "text", into: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Add the ids of every whole text, as encoding each match of `pattern` (see `java_pattern`) for itself gives them.

    A null or empty text has no ids.  Repeated rows are encoded alike; an empty
    table gives an empty table; a column named as `into`, in any case, gives
    way.  A word of n bytes takes time in proportion to n times the longest
    token, and memory in proportion to n.
    """
    often, whole = frequent_words(docs, ranks, pattern, text=text), encoder(ranks)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, often.schema) as stream:
        stream.write_table(often)
    content = sink.getvalue().to_pybytes()
    sent, key = docs.sparkSession.sparkContext.broadcast(content), named("words", content)
    own = without(docs.select(*[F.col(f"`{c}`") for c in keep]) if keep is not None else docs, [into])
    kept, parts = own.columns, fresh(own, "__parts")
    source = docs.select(*[F.col(f"`{c}`") for c in kept], words(text, pattern).alias(parts))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField(parts, T.ArrayType(T.StructType([T.StructField("run", T.ArrayType(T.IntegerType())), T.StructField("word", T.StringType())])))])

    def read() -> tuple[pa.Array, np.ndarray, pa.Array]:
        held = pa.ipc.open_stream(sent.value).read_all().combine_chunks()
        hashed = hashes(held["word"].combine_chunks())
        order = np.argsort(hashed, kind="stable")
        held = held.take(pa.array(order))
        return held["word"].combine_chunks(), hashed[order], held["ids"].combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, hashed, known = once(key, read)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], looked_up(batch.column(len(kept)), often, hashed, known)], names=batch.schema.names)
        trim()

    bounded_batches(docs.sparkSession)
    ids = F.flatten(F.flatten(F.transform(F.col(f"`{parts}`"), lambda p: F.when(p["word"].isNull(), F.array(p["run"])).otherwise(F.array(p["run"], whole(p["word"]))))))
    return source.mapInArrow(run, schema).select(*[F.col(f"`{c}`") for c in kept], ids.alias(into))


def decode(encoded: DataFrame, ranks: Ranks, *, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the bytes that the ids stand for: the tokens' pieces, one after the other.

    Null or empty ids give no bytes; an id outside the vocabulary is an error.
    """
    sent = encoded.sparkSession.sparkContext.broadcast(pa.array(sorted(ranks.tokens, key=ranks.tokens.get), pa.binary()))

    def joined(ids: pa.Array) -> pa.Array:
        pieces = sent.value.take(ids.flatten())
        ends = np.concatenate(([0], np.cumsum(pc.binary_length(pieces).fill_null(0).to_numpy())))
        rows = np.concatenate(([0], np.cumsum(pc.list_value_length(ids).fill_null(0).to_numpy())))
        return pa.Array.from_buffers(pa.binary(), len(ids), [None, pa.py_buffer(ends[rows].astype(np.int32)), pieces.buffers()[2] or pa.py_buffer(b"")])

    kept = without(encoded, [into]).columns
    bounded_batches(encoded.sparkSession)
    return encoded.select(*[F.col(f"`{c}`") for c in kept], F.arrow_udf(joined, T.BinaryType())(F.col(f"`{ids}`").cast("array<int>")).alias(into))


def ids_digest(ids: Column) -> Column:
    """SHA-256 of the ids as little-endian unsigned 32-bit integers; null where they or one of them are null."""

    def digests(ids: pa.Array) -> pa.Array:
        flat = ids.flatten()
        rows = np.concatenate(([0], np.cumsum(pc.list_value_length(ids).fill_null(0).to_numpy())))
        nulls = np.concatenate(([0], np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))))[rows]
        lost = ids.is_null().to_numpy(zero_copy_only=False) | (nulls[1:] > nulls[:-1])
        data = memoryview(flat.fill_null(0).to_numpy().astype("<i4", copy=False)).cast("B") if len(flat) else memoryview(b"")
        return pa.array([None if gone else hashlib.sha256(data[4 * a : 4 * b]).hexdigest() for a, b, gone in zip(rows[:-1], rows[1:], lost)], pa.string())

    return F.arrow_udf(digests, T.StringType())(ids)


def op12_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the bytes they decode to, of every document."""
    import public_tokenizers

    ranks = read_ranks(vocabulary or public_tokenizers.path(DEFAULT_VOCABULARY))
    pattern = java_pattern(spark, public_tokenizers.PATTERN)
    both = decode(encode(table(spark, sf_dir, "documents"), ranks, pattern, keep=["doc_id"]), ranks)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
