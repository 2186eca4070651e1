"""Exact top-k search by pivot-table elimination.

The table has the distances of every vector to many pivots and to the origin.
Together they say where a vector lies within the space that the pivots span and
how far it is from that space, which gives the greatest lower bound on the
distance of two vectors that these distances allow, and so the least upper bound
on their inner product; no pivot by itself can say more.  Candidates are
evaluated in the order of that bound until it falls under the k-th best score.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.batches import durable, table

#: Pivots; rows of least id hash that they are chosen from, and that give each query a first threshold; queries that one broadcast holds.
PIVOTS, SAMPLE, BLOCK_QUERIES = 56, 4_096, 16_384
#: Candidates and queries bounded at a time, and candidates evaluated at a time.
TILE, QUERY_TILE, STEP = 4_096, 64, 128
_LEAST, _MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def vectors(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64) -> DataFrame:
    """Ids and vectors of floor(scale * x); null ids and vectors with null or non-finite components are left out."""
    x = F.transform(F.col(f"`{embedding}`"), lambda v: v.cast("double"))
    usable = F.forall(x, lambda v: F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    return df.where(F.col(f"`{vec_id}`").isNotNull() & F.col(f"`{embedding}`").isNotNull()).where(usable).select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * scale)).alias("v"))


def choose(sample: np.ndarray, pivots: int = PIVOTS) -> np.ndarray:
    """Pivots far apart: each is the sampled vector farthest from the space that those before it span."""
    rest = sample.astype(np.float64)
    scale = float(np.abs(rest).max(initial=0)) or 1.0
    rest, chosen = rest / scale, []
    for _ in range(min(pivots, *rest.shape)):
        far = np.einsum("ij,ij->i", rest, rest)
        k = int(far.argmax())
        if far[k] <= 1e-6:
            break
        chosen.append(k)
        unit = rest[k] / far[k] ** 0.5
        rest = rest - np.outer(rest @ unit, unit)
    return sample[chosen].astype(np.float64)


class PivotTable:
    """Vectors of one length, their norms and distances to the pivots, and what follows from these.

    `inside` has the coordinates within the pivots' space, `outside` the distance from it.
    """

    def __init__(self, x: np.ndarray, pivots: np.ndarray):
        self.x = x
        f = x.astype(np.float64)
        self.norm = np.sqrt(np.einsum("ij,ij->i", f, f))
        lengths = np.einsum("ij,ij->i", pivots, pivots)
        self.reach = max(float((self.norm**2).max(initial=0)), float(lengths.max(initial=0)))
        self.distance = np.sqrt(np.maximum(self.norm[:, None] ** 2 + lengths - 2 * (f @ pivots.T), 0))
        if len(pivots):
            # The law of cosines gives the products with the pivots; a triangular system turns them into coordinates.
            products = (self.norm[:, None] ** 2 + lengths - self.distance**2) / 2
            _, r = np.linalg.qr(pivots.T)
            self.inside = np.linalg.solve(r.T, products.T).T
        else:
            self.inside = np.zeros((len(x), 0))
        left = self.norm**2 - np.einsum("ij,ij->i", self.inside, self.inside)
        # Rounding may only make the bound weaker.
        self.outside = np.sqrt(np.maximum(left, 0) + 1e-6 * self.norm**2)


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products as int64, a row for each of x and a column for each of q; those beyond its range become its ends."""
    size = float(np.abs(x).max(initial=0).astype(np.float64)) * float(np.abs(q).max(initial=0).astype(np.float64)) * max(1, x.shape[1])
    if size < 2**53:
        return (x.astype(np.float64) @ q.T.astype(np.float64)).astype(np.int64)
    if size < 2**62:
        return x @ q.T
    exact = x.astype(object) @ q.T.astype(object)
    return np.array([min(max(int(v), _LEAST), _MOST) for v in exact.ravel()], np.int64).reshape(exact.shape)


class Best:
    """The k best (score, vec_id) of each query so far, of scores from a least one up; ties go to the smaller id."""

    def __init__(self, least: np.ndarray, k: int):
        self.least = least
        self.score, self.ids, self.some = np.full((len(least), k), _LEAST), np.full((len(least), k), _MOST), np.zeros(len(least), np.int64)
        self.evaluated = 0

    def threshold(self, q: int) -> int:
        """The least score that can still count."""
        k = self.score.shape[1]
        return max(int(self.least[q]), int(self.score[q, -1])) if self.some[q] == k else int(self.least[q])

    def add(self, q: int, score: np.ndarray, ids: np.ndarray) -> None:
        self.evaluated += len(score)
        good = score >= self.threshold(q)
        n = self.some[q]
        score, ids = np.concatenate((self.score[q, :n], score[good])), np.concatenate((self.ids[q, :n], ids[good]))
        order = np.lexsort((ids, ~score))[: self.score.shape[1]]  # ~ turns the order round without overflow
        self.some[q] = len(order)
        self.score[q, : len(order)], self.ids[q, : len(order)] = score[order], ids[order]


def search_tile(query: PivotTable, query_ids: np.ndarray, candidate: PivotTable, candidate_ids: np.ndarray, best: Best, rows: np.ndarray) -> None:
    """Bring the best of `rows` up to date with a tile of candidates; exact."""
    for a in range(0, len(query_ids), QUERY_TILE):
        q = slice(a, min(a + QUERY_TILE, len(query_ids)))
        high = query.inside[q] @ candidate.inside.T + np.outer(query.outside[q], candidate.outside)
        high += 1e-6 * np.outer(query.norm[q], candidate.norm) + 1e-9 * (1 + query.reach + candidate.reach)
        high[query_ids[q, None] == candidate_ids[None, :]] = -np.inf  # a row with the query's id is none of its candidates
        for i in range(q.stop - a):
            n = rows[a + i]
            left = np.flatnonzero(high[i] >= best.threshold(n))
            left = left[np.isfinite(high[i, left])]
            order = left[np.argsort(-high[i, left], kind="stable")]
            for b in range(0, len(order), STEP):
                part = order[b : b + STEP]
                part = part[high[i, part] >= best.threshold(n)]
                if not len(part):
                    break
                best.add(n, products(candidate.x[part], query.x[a + i, None])[:, 0], candidate_ids[part])


def first_thresholds(x: np.ndarray, ids: np.ndarray, sample: np.ndarray, sample_ids: np.ndarray, k: int) -> np.ndarray:
    """For each query the k-th best score among sampled candidates, which the k best of all reach too."""
    out = np.full(len(x), _LEAST)
    for a in range(0, len(x) if len(sample) >= k else 0, QUERY_TILE):
        own = products(x[a : a + QUERY_TILE], sample)
        own[ids[a : a + QUERY_TILE, None] == sample_ids[None, :]] = _LEAST
        out[a : a + QUERY_TILE] = np.partition(own, len(sample) - k, axis=1)[:, len(sample) - k]
    return out


def _matrix(vectors: list[list[int]], size: int) -> np.ndarray:
    return np.array(vectors, np.int64).reshape(len(vectors), size)


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best candidates by inner product.

    Both sides are (vec_id, v) as `vectors` gives them; other columns are left
    out, whatever their names.  A row with the query's own id is no candidate;
    vectors of another length have no product with it and take no part.  Ties go
    to the smaller vec_id; repeated candidates count as often as they are there,
    and repeated queries are answered each.  An empty side gives no rows; scores
    beyond 64 bits become the ends of their range.  Queries are sent in blocks
    of BLOCK_QUERIES against all candidates; of several blocks, each result is
    written before the next block is sent.
    """
    candidates, queries = candidates.select("vec_id", "v"), queries.select("vec_id", "v")
    drawn = candidates.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(SAMPLE).collect()
    sample = {}
    for size in {len(r.v) for r in drawn}:
        own = [r for r in drawn if len(r.v) == size]
        x = _matrix([r.v for r in own], size)
        sample[size] = (x, np.array([r.vec_id for r in own], np.int64), choose(x))
    stream = ((r.vec_id, r.v) for r in queries.toLocalIterator())
    found: DataFrame | None = None
    n, block = 0, list(islice(stream, BLOCK_QUERIES))
    while block or found is None:
        following = list(islice(stream, BLOCK_QUERIES))
        own = _search(candidates, block, sample, k, n)
        if following or n:
            own = durable(own)
        found = own if found is None else found.unionByName(own)
        n, block = n + len(block), following
    return found


def _search(candidates: DataFrame, block: list[tuple[int, list[int]]], sample: dict, k: int, start: int) -> DataFrame:
    sets, least = {}, np.full(len(block), _LEAST)
    for size in sorted({len(v) for _, v in block}):
        at = np.array([i for i, (_, v) in enumerate(block) if len(v) == size])
        ids, x = np.array([block[i][0] for i in at], np.int64), _matrix([block[i][1] for i in at], size)
        own, own_ids, pivots = sample.get(size, (np.zeros((0, size), np.int64), np.zeros(0, np.int64), np.zeros((0, size))))
        least[at] = first_thresholds(x, ids, own, own_ids, k)
        sets[size] = (at, ids, x, pivots)
    sent = candidates.sparkSession.sparkContext.broadcast((sets, least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, least = sent.value
        best = Best(least, k)
        side = {size: PivotTable(x, p) for size, (_, _, x, p) in known.items()}
        held: list[pa.RecordBatch] = []

        def flush() -> None:
            ids = np.concatenate([b.column(0).to_numpy() for b in held])
            lists = pa.concat_arrays([b.column(1) for b in held])
            held.clear()
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate(([0], np.cumsum(sizes)))
            for size, (rows, query_ids, _, p) in known.items():
                mine = np.flatnonzero(sizes == size)
                if len(mine):
                    x = flat[starts[mine][:, None] + np.arange(size)].astype(np.int64)
                    search_tile(side[size], query_ids, PivotTable(x, p), ids[mine], best, rows)

        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= TILE:
                flush()
        if held:
            flush()
        real = np.arange(k) < best.some[:, None]
        row, _ = np.nonzero(real)
        query_ids = np.zeros(len(least), np.int64)
        for at, own, _, _ in known.values():
            query_ids[at] = own
        yield pa.RecordBatch.from_arrays([pa.array(row + start, pa.int64()), pa.array(query_ids[row], pa.int64()), pa.array(best.ids[real], pa.int64()), pa.array(best.score[real], pa.int64())], names=["n", "query_id", "vec_id", "score"])

    near = candidates.mapInArrow(run, "n long, query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id and score of the 20 best of every row whose vec_id is divisible by 20."""
    own = vectors(table(spark, sf_dir, "embeddings"))
    return top_k(own, own.where(F.col("vec_id") % 20 == 0))


OP8_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
