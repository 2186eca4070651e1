"""Shared plumbing: bounded Arrow batches, byte-level words and hashes.

Texts are handled as the UTF-8 bytes of an Arrow column.  A batch is cut into
pieces of a bounded number of text bytes (one row at least), so memory follows
the longest single text, not the number of rows.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that one vectorised step handles.
PIECE_BYTES = 1 << 20
#: Rows that Spark puts in one Arrow batch; texts are a few KB, so some MB.
BATCH_ROWS = 1000
#: Bytes that Spark puts in one Arrow batch, one row at least.
BATCH_BYTES = 8 << 20


def _held() -> dict:
    """What a worker process keeps between tasks; functions arrive by value, so module globals would not last."""
    return sys.modules.setdefault("palimpsest_worker", types.ModuleType("palimpsest_worker")).__dict__


def once(key: str, make: Callable[[], object]) -> object:
    """Keep one value per worker process, that of the last key; keys name contents, so equal tools are made once."""
    held = _held()
    if held.get("key") != key:
        free(key)
        held["value"], held["key"] = make(), key
    return held["value"]


def free(key: str | None) -> None:
    """Let go of the value of any other key, so that no operator pays for the tools of the one before."""
    held = _held()
    if held.get("key") != key:
        held.pop("value", None)
        held["key"] = None
        trim()


def trim() -> None:
    """Give freed memory back to the system, as a worker waits for other tasks for a while."""
    pa.default_memory_pool().release_unused()
    try:  # glibc keeps what was freed until it is told to give it back
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:
        pass


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the plans that follow, in rows and in bytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def named(kind: str, *contents: bytes) -> str:
    """A key for `once`: the kind and a digest of what the value is made from."""
    return f"{kind} {hashlib.md5(b''.join(hashlib.md5(c).digest() for c in contents)).hexdigest()}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one of its own is set only on a local master, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder and not (context.master == "local" or context.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp("-checkpoints"))
    return context.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """Write rows to the shared folder as Parquet, and read them from there."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def durable(df: DataFrame) -> DataFrame:
    """Write an intermediate result to the cluster's checkpoint folder and cut its lineage."""
    spark = df.sparkSession
    shared_folder(spark)
    rows = df.checkpoint()._jdf.queryExecution().toRdd()
    # A plan of its own: the checkpoint's keeps constraints on columns that are gone, on which unions fail.
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(rows, spark._jsparkSession.parseDataType(df.schema.json()), False), spark)


def tidy(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files and checkpoints of steps that nothing refers to any more.

    It does so when the driver's memory is collected, which for a small plan
    over large data may be long after the disks are full.
    """
    gc.collect()
    spark._jvm.System.gc()


def without(df: DataFrame, names: list[str]) -> DataFrame:
    """Drop the columns whose names an operator is about to add, whatever their case."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def pieces(batch: pa.RecordBatch, column: int, limit: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece has about `limit` text bytes, or one row."""
    if not batch.num_rows:
        return
    offsets, _ = utf8(batch.column(column))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets from 0 and the bytes of a string column; a null counts as empty."""
    if array.null_count:
        array = array.fill_null("")
    wide = pa.types.is_large_string(array.type)
    _, ends, data = array.buffers()
    offsets = np.frombuffer(ends, np.int64 if wide else np.int32, len(array) + 1, array.offset * (8 if wide else 4)).astype(np.int64)
    if data is None:
        return offsets - offsets[0], np.zeros(0, np.uint8)
    return offsets - offsets[0], np.frombuffer(data, np.uint8, int(offsets[-1] - offsets[0]), int(offsets[0]))


def fresh(df: DataFrame, name: str) -> str:
    """A working name that no column of `df` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _source(df: DataFrame, text: str, kept: list[str]) -> tuple[DataFrame, int]:
    """The columns kept and the text, once, and its place among them."""
    own = df.select(*[F.col(f"`{c}`") for c in kept])
    for at, field in enumerate(own.schema.fields):
        if field.name == text and isinstance(field.dataType, T.StringType):
            return own, at
    return df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text}`").cast("string").alias(fresh(own, "__text"))), len(kept)


def annotate(
    df: DataFrame,
    text: str,
    fields: list[tuple[str, T.DataType]],
    compute: Callable[[pa.RecordBatch, int], list[pa.Array]],
    keep: list[str] | None = None,
    limit: int = PIECE_BYTES,
    key: str | None = None,
) -> DataFrame:
    """Add columns computed from whole texts, batch by batch, without a shuffle.

    `compute(piece, index of the text column)` gives one array per field.  A
    column of `df` with a new field's name is replaced.  The text column is
    read even when it is not kept, and sent to Python once.  `key` names the
    tools that `compute` keeps by `once`; a worker lets go of all others.
    """
    names = [n for n, _ in fields]
    kept = without(df.select(*[F.col(f"`{c}`") for c in keep]) if keep is not None else df, names).columns
    source, at = _source(df, text, kept)
    n = len(kept)
    schema = T.StructType([*source.schema.fields[:n], *(T.StructField(x, t) for x, t in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free(key)
        for batch in batches:
            for piece in pieces(batch, at, limit):
                yield pa.RecordBatch.from_arrays([*piece.columns[:n], *compute(piece, at)], names=[*kept, *names])
        trim()

    bounded_batches(df.sparkSession)
    return source.mapInArrow(run, schema)


def filtered(df: DataFrame, text: str, test: Callable[[pa.RecordBatch, int], np.ndarray], key: str | None = None, limit: int = PIECE_BYTES) -> DataFrame:
    """The rows whose whole text passes `test(piece, index of the text column)`, with all their columns, decided where they are read."""
    source, at = _source(df, text, df.columns)
    n = len(df.columns)
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        free(key)
        for batch in batches:
            for piece in pieces(batch, at, limit):
                mask = test(piece, at)
                if mask.any():
                    yield pa.RecordBatch.from_arrays(list(piece.columns[:n]), names=names).filter(pa.array(mask))
        trim()

    bounded_batches(df.sparkSession)
    return source.mapInArrow(run, df.schema)


# ---------------------------------------------------------------- hashes

#: Two primes under 2^31 and a base for each: unlike sums modulo 2^64, these don't collide on words of a regular build.
_PRIMES, _BASES = (2147483647, 2147483629), (1389796043, 1722830137)
#: Bytes whose terms, unreduced, can be added up in 64 bits.
_UNREDUCED = 1 << 24


def _powers(k: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of a base and of its inverse, modulo its prime."""
    held = _held().setdefault("powers", {})
    if k not in held or len(held[k][0]) < n:
        prime, size, made = np.uint64(_PRIMES[k]), 1 << max(10, int(n - 1).bit_length()), []
        for base in (_BASES[k], pow(_BASES[k], -1, _PRIMES[k])):
            powers, have = np.ones(size, np.uint32), 1
            while have < size:
                powers[have : 2 * have] = powers[:have].astype(np.uint64) * np.uint64(pow(base, have, _PRIMES[k])) % prime
                have *= 2
            made.append(powers)
        held[k] = tuple(made)
    return held[k]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, by differences of prefix sums; equal spans hash alike anywhere.

    Two given spans of n bytes collide with a chance of about (n / 2^31)^2,
    whatever their structure; where a result must not rest on that, compare the
    bytes too (`same_spans`).
    """
    sums, values = np.zeros(len(data) + 1, np.uint64), data.astype(np.uint64) + np.uint64(1)
    out = np.zeros(len(starts), np.uint64)
    for k, p in enumerate(_PRIMES):
        forth, back = _powers(k, len(data) + 1)
        terms, prime = values * forth[: len(data)], np.uint64(p)
        if len(data) > _UNREDUCED:
            terms %= prime
        np.cumsum(terms, out=sums[1:])
        out = out << np.uint64(32) | (sums[ends] - sums[starts]) % prime * back[starts] % prime
    return mix(mix(out) + (ends - starts).astype(np.uint64))


def same_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, other: np.ndarray, begins: np.ndarray) -> bool:
    """Whether each span equals the span of its size that begins there in the other buffer."""
    sizes = ends - starts
    cut = 0
    total = np.concatenate(([0], np.cumsum(sizes)))
    while cut < len(starts):
        stop = max(int(np.searchsorted(total, total[cut] + (1 << 21), side="right")) - 1, cut + 1)
        if stop == cut + 1:
            alike = np.array_equal(data[starts[cut] : ends[cut]], other[begins[cut] : begins[cut] + sizes[cut]])
        else:
            at = np.arange(total[cut], total[stop])
            alike = (data[np.repeat(starts[cut:stop] - total[cut:stop], sizes[cut:stop]) + at] == other[np.repeat(begins[cut:stop] - total[cut:stop], sizes[cut:stop]) + at]).all()
        if not alike:
            return False
        cut = stop
    return True


_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, all other bytes as they are."""
    return np.where((data >= 65) & (data <= 90), data | 32, data)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the maximal runs without ASCII white space; runs end with their row."""
    inside = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | first[: len(data)]))
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


# ---------------------------------------------------------------- labelled samples


def crc_mod(column: str, n: int) -> F.Column:
    return F.crc32(F.col(f"`{column}`").cast("string").cast("binary")) % n


def labelled_sample(labels: DataFrame, doc_id: str, label: str, train: F.Column, bound: int) -> DataFrame:
    """At most `bound` training ids of each class 0 and 1, those of least hash, with `weight`, the rows each stands for.

    Rows with a null id or another label are left out.  An id with both labels
    counts as 1.
    """
    ids = labels.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & train)
    parts = []
    for y in (0, 1):
        own = ids.where(F.col("y") == y)
        parts.append(own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound).withColumn("weight", F.lit(1.0) * own.count()))
    both = parts[0].unionByName(parts[1])
    sizes = both.groupBy("y").agg(F.count("*").alias("n"))
    both = both.join(F.broadcast(sizes), "y").withColumn("weight", F.col("weight") / F.col("n"))
    return both.groupBy("doc_id").agg(F.max("y").alias("y"), F.max_by("weight", "y").alias("weight"))


def labelled_texts(docs: DataFrame, chosen: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text, y, weight and a hash h of each chosen id; of several texts of one id, that of least hash, so rows stay bounded."""
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = own.join(F.broadcast(chosen), "doc_id").withColumn("h", F.xxhash64("doc_id", "text"))
    one = rows.groupBy("doc_id").agg(F.min(F.struct("h", "text", "y", "weight")).alias("r"))
    return one.select("doc_id", "r.text", "r.y", "r.weight", "r.h")
