"""MinHash near-dedup.

Each text becomes the set of its distinct five-word shingles.  One permutation
of the shingle hashes, cut into bins and densified, gives the signature; bands
of the signature name buckets.  Texts of one bucket are linked to one of them
as a star, links are confirmed on the full sets, and only pairs that the
confirmed links leave in different components are looked at again.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.batches import annotate, bounded_batches, durable, free, lowered, mix, span_hashes, table, tidy, trim, utf8, words

#: Words of a shingle, and the least similarity of a link, in hundredths.
SHINGLE_WORDS, SIMILARITY = 5, 75
#: Bands and bins of each: at similarity 0.75 a pair shares no bucket once in 200,000 pairs.
BANDS, ROWS = 32, 4
#: Texts of a bucket that are compared with as many others in one task, where stars don't settle it.
BLOCK = 256
#: Largest family compared as a whole.
FAMILY = 8_192
#: Keys with over this part of the rows are heavy, so there are fewer than so many; and the tasks that one of them is dealt to.
HEAVY, SALTS = 256, 32
#: Bits of the filter that keeps texts out of a shuffle; 4 MB, whatever the input.
FILTER_BITS = 1 << 24
_BINS = BANDS * ROWS
#: For each bin, the order in which it looks for a bin that isn't empty.
_ORDERS = np.stack([np.random.default_rng([20140622, b]).permutation(_BINS) for b in range(_BINS)])


def shingle_sets(offsets: np.ndarray, data: np.ndarray) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted."""
    low = lowered(data)
    starts, ends, row = words(low, offsets)
    hashes = span_hashes(low, starts, ends)
    texts = len(offsets) - 1
    cut = np.searchsorted(row, np.arange(texts + 1))
    n = np.diff(cut)
    if len(hashes) >= SHINGLE_WORDS:
        at = np.arange(len(hashes) - SHINGLE_WORDS + 1)
        rolled = np.zeros(len(at), np.uint64)
        for k in range(SHINGLE_WORDS):
            rolled = mix(rolled * np.uint64(3) + hashes[at + k])
    out = []
    for i in range(texts):
        if n[i] >= SHINGLE_WORDS:
            out.append(np.unique(rolled[cut[i] : cut[i + 1] - SHINGLE_WORDS + 1]))
        elif n[i]:
            h = np.array([n[i]], np.uint64)
            for word in hashes[cut[i] : cut[i + 1]]:
                h = mix(h * np.uint64(5) + word)
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """The bucket of each band, for sets that aren't empty.

    A bin's value is its least hash.  An empty bin takes the value of the first
    bin that isn't, in an order of its own, the same for all texts.
    """
    values, filled = np.zeros((len(sets), _BINS), np.uint64), np.zeros((len(sets), _BINS), bool)
    shift = np.uint64(64 - (_BINS - 1).bit_length())
    for i, s in enumerate(sets):
        own = (s >> shift).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        values[i, own[first]], filled[i, own[first]] = s[first], True
    empty, bins = np.nonzero(~filled)
    for a in range(0, len(empty), 65_536):
        r, b = empty[a : a + 65_536], bins[a : a + 65_536]
        order = _ORDERS[b]
        source = order[np.arange(len(b)), filled[r[:, None], order].argmax(axis=1)]
        values[r, b] = values[r, source]
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sets), BANDS))
    for k in range(ROWS):
        out = mix(out * np.uint64(7) + values[:, k::ROWS])
    return out.view(np.int64)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key (MD5 of the text), words_key (MD5 of its words, null without words), n_shingles and bands of each row."""

    def compute(piece: pa.RecordBatch, at: int) -> list[pa.Array]:
        offsets, data = utf8(piece.column(at))
        sets = shingle_sets(offsets, data)
        some = [i for i, s in enumerate(sets) if len(s)]
        found = bands([sets[i] for i in some])
        raw = data.tobytes()
        split = [raw[a:b].lower().split() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        ends = np.zeros(len(sets) + 1, np.int32)
        ends[1:] = np.cumsum([BANDS if len(s) else 0 for s in sets])
        return [
            pa.array([hashlib.md5(b" ".join(w)).digest() if w else None for w in split], pa.binary()),
            pa.array([len(s) for s in sets], pa.int64()),
            pa.ListArray.from_arrays(pa.array(ends), pa.array(found.ravel(), pa.int64())),
        ]

    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).withColumn("key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    return annotate(own, "text", [("words_key", T.BinaryType()), ("n_shingles", T.LongType()), ("bands", T.ArrayType(T.LongType()))], compute, ["doc_id", "key"])


def placed(columns: list[F.Column]) -> tuple[F.Column, F.Column]:
    """The word of the filter that a key belongs to, and its bit there."""
    place = F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))
    return F.shiftright(place, 6), F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63).cast("int"))


def words_of(keys: DataFrame, columns: list[str]) -> DataFrame:
    """The words of a filter with the keys in it: FILTER_BITS / 64 rows at most."""
    word, bit = placed([F.col(c) for c in columns])
    return keys.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or("__bit").alias("__bits"))


def maybe(df: DataFrame, filter_words: DataFrame, columns: list[F.Column], there: bool = True) -> DataFrame:
    """Rows whose key may be in the filter (all that are, and few others), or the rest, without a shuffle."""
    word, bit = placed(columns)
    known = df.join(F.broadcast(filter_words), word == F.col("__word"), "left")
    hit = F.coalesce(F.col("__bits").bitwiseAND(bit) != 0, F.lit(False))
    return known.where(hit if there else ~hit).drop("__word", "__bits")


def dealt(wide: DataFrame, narrow: DataFrame, on: str, by: str, how: str = "inner") -> DataFrame:
    """Join with `narrow`, which has one row a key and in `__n` the rows of `wide` with it; `narrow` must be durable.

    Rows of a heavy key, of which there are fewer than HEAVY, are dealt by the
    column `by` to SALTS tasks, each with a copy of the key's row in `narrow`.
    """
    total = narrow.agg(F.sum("__n")).first()[0] or 0
    heavy = F.broadcast(narrow.where(F.col("__n") * HEAVY > F.lit(total)).select(on, F.lit(SALTS).alias("__salts")))
    salts = F.coalesce("__salts", F.lit(1))
    copies = narrow.drop("__n").join(heavy, on, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    own = wide.join(heavy, on, "left").withColumn("__salt", F.pmod(F.xxhash64(by), salts).cast("int")).drop("__salts")
    return own.join(copies, [on, "__salt"], how).drop("__salt")


def components(edges: DataFrame) -> DataFrame:
    """node and component, its least node, for the nodes of undirected edges (a, b).

    Each round every node takes its least neighbour for a parent, parents are
    followed once more, and the edges are contracted; rounds grow with the
    logarithm of the longest path.
    """
    labels, rest = None, durable(edges.select("a", "b").where("a <> b").distinct())
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = durable(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p"), F.count("*").alias("__n")))
        children = parent.groupBy("p").agg(F.count("*").alias("__n"))
        up = durable(parent.select(F.col("a").alias("p"), F.col("p").alias("component")).join(children, "p"))
        parent = durable(dealt(parent.withColumnRenamed("__n", "n"), up, "p", "a").select(F.col("a").alias("node"), "component", F.col("n").alias("__n")))
        if labels is None:
            labels = parent.select("node", "component")
        else:
            step = parent.select(F.col("node").alias("component"), F.col("component").alias("further"))
            step = durable(step.join(labels.groupBy("component").agg(F.count("*").alias("__n")), "component"))
            labels = durable(dealt(labels, step, "component", "node", "left").select("node", F.coalesce("further", "component").alias("component")))
        for x, y in (("a", "b"), ("b", "a")):
            rest = dealt(rest, parent.select(F.col("node").alias(x), F.col("component").alias(f"{x}{x}"), "__n"), x, y)
        rest = rest.select(F.col("aa").alias("a"), F.col("bb").alias("b")).where("a <> b")
        rest = durable(rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        tidy(edges.sparkSession)
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("component")).where(F.lit(False))


class Links:
    """Distinct texts as nodes, and what is needed to confirm links between them."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str):
        self.docs = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
        self.rows = durable(fingerprints(docs, doc_id, text).withColumn("row", F.monotonically_increasing_id()))
        worded = self.rows.where(F.col("words_key").isNotNull())
        self.classes = durable(worded.groupBy("words_key").agg(F.min("row").alias("node"), F.min("doc_id").alias("least_id"), F.count("*").alias("__n")))
        nodes = self.rows.join(self.classes.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node")
        self.nodes = durable(nodes.select("node", "doc_id", "key", "n_shingles", "bands"))
        buckets = self.nodes.select("node", F.explode("bands").alias("bucket"))
        # Members of buckets that hold at least two texts.
        self.shared = durable(buckets.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
        self.members = durable(dealt(buckets, self.shared.withColumn("__n", F.col("size")), "bucket", "node"))

    def sets(self, wanted: DataFrame) -> DataFrame:
        """node and its full shingle set, for the nodes wanted: made again from the texts, which are found by content and id."""
        own = durable(self.nodes.select("node", "doc_id", "key").join(wanted.select("node").distinct(), "node"))
        docs = self.docs.withColumn("key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
        # A node is one row, but repeated rows have its id and text too.
        docs = maybe(docs, words_of(own, ["doc_id", "key"]), [F.col("doc_id"), F.col("key")]).dropDuplicates(["key", "doc_id"])
        texts = docs.alias("d").join(own.alias("w"), F.col("d.key").eqNullSafe(F.col("w.key")) & F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")))

        def compute(piece: pa.RecordBatch, at: int) -> list[pa.Array]:
            offsets, data = utf8(piece.column(at))
            found = shingle_sets(offsets, data)
            return [pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))]

        return durable(annotate(texts.select("node", "text"), "text", [("shingles", T.ArrayType(T.LongType()))], compute, ["node"]).dropDuplicates(["node"]))

    def confirmed(self, pairs: DataFrame, sets: DataFrame | None = None) -> DataFrame:
        """Of pairs (a, b), those whose full shingle sets are similar enough."""
        if sets is None:
            sizes = self.nodes.select("node", "n_shingles")
            for x in ("a", "b"):
                pairs = pairs.join(sizes.withColumnsRenamed({"node": x, "n_shingles": f"n_{x}"}), x)
            pairs = durable(pairs.where(100 * F.least("n_a", "n_b") >= SIMILARITY * F.greatest("n_a", "n_b")).select("a", "b"))
            sets = self.sets(pairs.select(F.explode(F.array("a", "b")).alias("node")))
        for x, y in (("a", "b"), ("b", "a")):
            degree = pairs.groupBy(x).agg(F.count("*").alias("__n"))
            own = durable(sets.select(F.col("node").alias(x), F.col("shingles").alias(f"s_{x}")).join(degree, x))
            pairs = dealt(pairs, own, x, y)
        both = F.size(F.array_intersect("s_a", "s_b"))
        return durable(pairs.where(100 * both >= SIMILARITY * (F.size("s_a") + F.size("s_b") - both)).select("a", "b"))

    def stars(self) -> DataFrame:
        """Edges from each bucket's hub to its other members.

        The hub is the member that meets most others over all its buckets: of
        copies of one text, the text that they were made from.
        """
        meets = self.members.groupBy("node").agg(F.sum("size").alias("meets"))
        own = self.members.join(meets, "node")
        hubs = own.groupBy("bucket").agg(F.max(F.struct("meets", "node")).alias("h"), F.count("*").alias("__n")).select("bucket", F.col("h.node").alias("a"), "__n")
        return dealt(self.members, durable(hubs), "bucket", "node").where("node <> a").select("a", F.col("node").alias("b")).distinct()

    def labels(self) -> DataFrame:
        """node and component of every text that is linked to another."""
        tidy(self.docs.sparkSession)
        links = self.confirmed(self.stars())
        tidy(self.docs.sparkSession)
        labels = components(links)
        more = self.confirmed_across(labels)
        return labels if more is None else components(links.unionByName(more))

    def confirmed_across(self, labels: DataFrame) -> DataFrame | None:
        """Links between texts of one bucket that the stars leave in different components; None if there are none.

        Texts that such buckets join, at one or more removes, are a family.  A
        family is cut into blocks, and every two blocks are compared in a task of
        their own, by sets of half hashes: these can only seem more alike than
        they are.  Only pairs that seem similar enough leave the tile, and their
        full sets decide.  Of a family of over FAMILY texts each bucket is
        compared so instead, which then is less work for the same pairs.
        """
        own = self.members.select("bucket", "node").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        own = durable(own)
        mixed = own.groupBy("bucket").agg(F.count("*").alias("n"), F.min("node").alias("least"), F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high")
        own = durable(dealt(own, durable(mixed.select("bucket", "n", "least", F.col("n").alias("__n"))), "bucket", "node"))
        if own.isEmpty():
            return None
        families = components(own.select(F.col("least").alias("a"), F.col("node").alias("b"))).withColumnRenamed("component", "family")
        sizes = families.groupBy("family").agg(F.count("*").alias("size"))
        families = durable(families.join(sizes, "family"))
        small = own.select("node", "component").distinct().join(families.where(F.col("size") <= FAMILY), "node")
        small = small.select("node", "component", F.lit(0).alias("kind"), F.col("family").alias("group"), F.col("size").alias("n"))
        large = own.join(families.where(F.col("size") > FAMILY).select("node"), "node", "left_semi").select("node", "component", F.lit(1).alias("kind"), F.col("bucket").alias("group"), "n")
        sets = self.sets(own)
        tiles = small.unionByName(large).withColumn("blocks", F.ceil(F.col("n") / BLOCK)).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
        tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        tiles = tiles.select("node", "component", "kind", "group", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))
        halves = sets.select("node", F.transform("shingles", lambda s: F.shiftright(s, 32).cast("int")).alias("halves"))
        held = tiles.join(halves, "node").groupBy("kind", "group", "low", "high").agg(F.collect_list(F.struct("node", "component", "block", "halves")).alias("members"))

        def run(batches):
            free(None)
            for batch in batches:
                for row in range(batch.num_rows):
                    yield from similar_in_tile(batch.column(0).slice(row, 1).flatten(), bool(batch.column(1)[row].as_py()))
            trim()

        bounded_batches(self.docs.sparkSession)

        tidy(self.docs.sparkSession)
        pairs = durable(held.select("members", (F.col("low") == F.col("high")).alias("diagonal")).mapInArrow(run, "a long, b long").distinct())
        return None if pairs.isEmpty() else self.confirmed(pairs, sets)


def similar_in_tile(members: pa.StructArray, diagonal: bool):
    """Batches of pairs (a, b) of different components that seem similar enough; across the two blocks, or within the one."""
    node, component, block = (members.field(k).to_numpy() for k in range(3))
    lists = members.field(3)
    size = lists.value_lengths().to_numpy()
    values, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(node)), size)
    kinds, inverse, counts = np.unique(values, return_inverse=True, return_counts=True)
    # Only what two members have can be shared.
    column = np.cumsum(counts > 1) - 1
    keep = counts[inverse] > 1
    owner, inverse = owner[keep], column[inverse[keep]]
    shared = np.zeros((len(node), len(node)), np.float32)
    for low in range(0, int((counts > 1).sum()), 4096):
        some = (inverse >= low) & (inverse < low + 4096)
        grid = np.zeros((len(node), 4096), np.float32)
        np.add.at(grid, (owner[some], inverse[some] - low), 1)
        shared += grid @ grid.T
    near = 100 * shared >= SIMILARITY * (size[:, None] + size[None, :] - shared)
    near &= component[:, None] != component[None, :]
    near &= (node[:, None] < node[None, :]) & (diagonal | (block[:, None] != block[None, :]))
    a, b = np.nonzero(near)
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])


def near_duplicates(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row, and its `key`, the MD5 of its text.

    A text without words (null, empty, white space) has no shingles, no links
    and its own id for a component.  Rows with equal words are linked, whatever
    their ids.  Rows that share an id but not their words are nodes of their
    own.  A null id is never a component's id while another is there.
    """
    links = Links(docs, doc_id, text)
    ids = durable(links.classes.join(links.labels(), "node", "left").withColumn("component", F.coalesce("component", "node")))
    least = durable(ids.groupBy("component").agg(F.min("least_id").alias("component_id"), F.count("*").alias("__n")))
    tidy(docs.sparkSession)
    named = durable(dealt(ids.select("words_key", "component", F.col("__n").alias("n")), least, "component", "words_key").select("words_key", "component_id", F.col("n").alias("__n")))
    rows = links.rows.select("doc_id", "key", "words_key", "n_shingles")
    whole = dealt(rows.where(F.col("words_key").isNotNull()), named, "words_key", "doc_id").select("doc_id", "n_shingles", "component_id", "key")
    bare = rows.where(F.col("words_key").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), "key")
    return whole.unionByName(bare).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group: that with the least id, once if its row is repeated.

    Columns of any name stay as they are.  Documents whose id and text are no
    one else's, and that are kept, are passed on where they are read; only the
    rest, and the few that the filter takes for them, are shuffled.
    """
    columns = docs.columns
    found = near_duplicates(docs).groupBy(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).agg(F.max("kept").alias("__kept"), F.count("*").alias("__rows"))
    found = durable(found.where("not __kept or __rows > 1"))
    tidy(spark)
    inside = words_of(found, ["__id", "__key"])
    name = "__own"
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias(name))
    key = [F.col(f"{name}.doc_id").cast("long"), F.unhex(F.md5(F.coalesce(F.col(f"{name}.text").cast("string"), F.lit(""))))]
    sure = maybe(own, inside, key, there=False)
    other = maybe(own, inside, key).select(name, key[0].alias("__id_"), key[1].alias("__key_"))
    other = other.join(found, F.col("__id_").eqNullSafe(F.col("__id")) & F.col("__key_").eqNullSafe(F.col("__key")), "left").where("coalesce(__kept, true)")
    # Rows that aren't repeated are no copies of each other; those that are differ in nothing that counts.
    once = other.where("__rows is null").select(name).unionByName(other.where("__rows is not null").dropDuplicates(["__id", "__key"]).select(name))
    return sure.select(name).unionByName(once).select(*[F.col(name).getField(c).alias(c) for c in columns])


OP5_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), x AS (SELECT r, unnest(w) AS w, generate_subscripts(w, 1) AS k FROM d),
f AS (SELECT r, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' || lead(w, 4) OVER o AS g FROM x WINDOW o AS (PARTITION BY r ORDER BY k)),
e AS MATERIALIZED (SELECT DISTINCT r, g FROM f WHERE g IS NOT NULL UNION ALL SELECT r, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4),
n AS MATERIALIZED (SELECT r, doc_id, (SELECT count(*) FROM e WHERE e.r = d.r) AS n_shingles FROM d),
i AS (SELECT a.r AS a, b.r AS b, count(*) AS n_both FROM e a JOIN e b ON a.g = b.g AND a.r < b.r GROUP BY ALL),
h AS MATERIALIZED (SELECT a, b FROM i JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * n_both >= 75 * (x.n_shingles + y.n_shingles - n_both)),
l AS MATERIALIZED (SELECT a, b FROM h UNION ALL SELECT b, a FROM h),
c AS (SELECT r, r AS reach FROM n UNION SELECT c.r, l.b FROM c JOIN l ON l.a = c.reach),
m AS (SELECT c.r, min(n.doc_id) AS component_id FROM c JOIN n ON n.r = c.reach GROUP BY c.r)
SELECT n.doc_id, n.n_shingles, m.component_id, n.doc_id = m.component_id AS kept FROM n JOIN m USING (r)
"""
