"""A full-text index kept up to date: postings in segments by term, deletes as marks, statistics as differences.

Every change is one commit of five tables:

- postings (bucket, doc_id, dl, terms, tfs, version): one row for all terms of a
  row in one bucket, a hash of the term; a segment's files are parted by bucket,
  so a search opens the files of its terms only;
- marks (doc_id, version): postings of the row from earlier versions don't count;
- rows (doc_id, dl, version): what a later change has to take back, besides its postings;
- df (bucket, term, df) and sizes (n, tokens): differences, which are added up.

A row's tokens are counted and dealt into buckets within the row, so texts aren't
shuffled and postings are only once, on their way to the files of their bucket.
`merge` writes one segment anew, without what marks hide.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.operators import retrieval
from palimpsest.sources.commits import CommitLog, StaleVersion, View
from palimpsest.sources.tables import durable, stored

#: Buckets of terms; a segment has a file or more for each that it holds.
BUCKETS = 64
#: Rows of postings that one task sorts by bucket, and ids of a change that are sent to all rather than joined by a shuffle.
TASK_ROWS, SENT = 500_000, 1_000_000
#: `terms` are joined by spaces, which no token holds.
POSTINGS = "bucket int, doc_id {id}, dl int, terms string, tfs array<double>, version long"
MARKS = "doc_id {id}, version long"
ROWS = "doc_id {id}, dl int, version long"
DF = "bucket int, term string, df long"
SIZES = "n long, tokens long"
#: Files of `postings` and `df` are parted by bucket.
PARTED = {"postings": ["bucket"], "df": ["bucket"]}


def bucket_of(term: Column) -> Column:
    return (F.crc32(term.cast("binary")) % BUCKETS).cast("int")


def _runs(sorted_: Column, key) -> tuple[Column, Column]:
    """Where the runs of equal keys begin in a sorted array, and where they end (exclusive, from 0)."""
    at = lambda i: key(F.get(sorted_, i))
    begins = F.filter(F.transform(sorted_, lambda x, i: F.when(~key(x).eqNullSafe(at(i - 1)), i)), lambda i: i.isNotNull())
    ends = F.filter(F.transform(sorted_, lambda x, i: F.when(~key(x).eqNullSafe(at(i + 1)), i + 1)), lambda i: i.isNotNull())
    return begins, ends


def _counts(tokens: Column, weight: float) -> Column:
    """A map from each token of a sorted array to its occurrences by weight."""
    begins, ends = _runs(tokens, lambda t: t)
    return F.map_from_arrays(F.array_distinct(tokens), F.zip_with(begins, ends, lambda b, e: (e - b) * float(weight)))


def lists(docs: DataFrame, columns: dict[str, float]) -> DataFrame:
    """doc_id, dl and lists (bucket, terms, tfs) of every row: the postings that `retrieval.postings` gives, by bucket, within the row."""
    own = docs.select("doc_id", *[F.sort_array(retrieval.index_tokens(F.col(c))).alias(f"__{k}") for k, c in enumerate(columns)])
    maps = [_counts(F.col(f"__{k}"), w) for k, w in enumerate(columns.values())]
    every = reduce(lambda a, b: F.map_zip_with(a, b, lambda _, x, y: F.coalesce(x, F.lit(0.0)) + F.coalesce(y, F.lit(0.0))), maps)
    entries = F.sort_array(F.transform(F.map_entries(every), lambda e: F.struct(bucket_of(e["key"]).alias("bucket"), e["key"].alias("term"), e["value"].alias("tf"))))
    own = own.select("doc_id", sum((F.size(f"__{k}") for k in range(len(columns))), F.lit(0)).alias("dl"), entries.alias("__e"))
    begins, ends = _runs(F.col("__e"), lambda e: e["bucket"])

    def cut(b: Column, e: Column) -> Column:
        part = F.slice(F.col("__e"), b + 1, e - b)
        return F.struct(F.get(F.col("__e"), b)["bucket"].alias("bucket"), F.array_join(part["term"], " ").alias("terms"), part["tf"].alias("tfs"))

    return own.select("doc_id", "dl", F.zip_with(begins, ends, cut).alias("lists"))


def _among(rows: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Rows joined with distinct ids (doc_id, ..) on doc_id; few ids are sent to all, so that the rows stay where they are."""
    return rows.join(F.broadcast(ids) if ids.limit(SENT + 1).count() <= SENT else ids, "doc_id", how)


def _by_bucket(postings: DataFrame, rows: int) -> DataFrame:
    """Postings dealt for writing: a task sorts about TASK_ROWS of them by bucket, however many there are."""
    n = max(postings.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS))
    return postings.repartition(n, "bucket", F.pmod(F.xxhash64("doc_id"), F.lit(-(-4 * n // BUCKETS))))


class SearchIndex:
    """An index of rows with a unique id, over weighted text columns, in a commit log of its own."""

    def __init__(self, spark: SparkSession, root: str, columns: dict[str, float], id_type: str = "long"):
        self.spark, self.log, self.columns, self.id_type = spark, CommitLog(spark, root), columns, id_type

    def _read(self, view: View, table: str, schema: str) -> DataFrame:
        return view.read(table, schema.format(id=self.id_type))

    def _marks(self, view: View) -> DataFrame:
        return self._read(view, "marks", MARKS).groupBy("doc_id").agg(F.max("version").alias("hidden"))

    def _visible(self, view: View, table: str, schema: str) -> DataFrame:
        """Rows of a table that no later mark hides."""
        return _among(self._read(view, table, schema), durable(self._marks(view)), "left").where("hidden is null or version >= hidden").drop("hidden")

    def apply(self, expected: int, upserts: DataFrame | None = None, deletes: DataFrame | None = None) -> int:
        """Insert or replace rows (doc_id and the text columns) and delete ids (doc_id), in one commit.

        An id that is upserted and deleted in one call is upserted.  Of several
        upserts of an id the one of least texts counts; null ids are left out,
        ids to delete that aren't there are no error.  Raises StaleVersion where
        another writer was first.
        """
        if self.log.version() != expected:
            raise StaleVersion(f"version {self.log.version()}, not {expected}")
        view, version = self.log.view(expected), F.lit(expected + 1).cast("long").alias("version")
        schema = f"doc_id {self.id_type}, {', '.join(f'`{c}` string' for c in self.columns)}"
        new = (self.spark.createDataFrame([], schema) if upserts is None else upserts.select("doc_id", *self.columns)).where("doc_id is not null")
        # Texts are compared, and shuffled, only where an id comes more than once.
        twice = durable(new.groupBy("doc_id").count().where("count > 1").select("doc_id"))
        if not twice.isEmpty():
            least = _among(new, twice, "left_semi").groupBy("doc_id").agg(F.min(F.struct(*self.columns)).alias("r"))
            new = _among(new, twice, "left_anti").unionByName(least.select("doc_id", *[F.col("r").getField(c).alias(c) for c in self.columns]))
        # Rows without a token are in the statistics too.
        rows = stored(lists(new, self.columns))
        own = rows.select("doc_id", "dl", F.explode("lists").alias("p")).select("p.bucket", "doc_id", "dl", "p.terms", "p.tfs")
        gone = rows.select("doc_id") if deletes is None else rows.select("doc_id").unionByName(deletes.select("doc_id").where("doc_id is not null"))
        gone = durable(gone.distinct())
        held = durable(_among(self._visible(view, "rows", ROWS), gone, "left_semi"))
        # What they held is looked up where the postings are.
        lost = _among(self._visible(view, "postings", POSTINGS), held.select("doc_id"), "left_semi")
        one = lambda t, sign: t.select("bucket", F.explode(F.split("terms", " ")).alias("term"), F.lit(sign).alias("by"))
        df = one(own, 1).unionByName(one(lost, -1)).groupBy("bucket", "term").agg(F.sum("by").cast("long").alias("df")).where("df <> 0")
        sums = lambda t, sign: t.select((F.count("*") * sign).alias("n"), (F.coalesce(F.sum("dl"), F.lit(0)) * sign).cast("long").alias("tokens"))
        count = rows.agg(F.coalesce(F.sum(F.size("lists")), F.lit(0)).alias("n")).first().n
        tables = {
            "postings": _by_bucket(own, count).select("doc_id", "dl", "terms", "tfs", version, "bucket"),
            "marks": held.select("doc_id", version),
            "rows": rows.select("doc_id", "dl", version),
            "df": df.select("term", "df", "bucket").repartition("bucket"),
            "sizes": sums(rows, 1).unionByName(sums(held, -1)).agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")),
        }
        return self.log.commit(tables, expected=expected, by=PARTED, note="index")

    def merge(self, expected: int) -> int:
        """One segment in place of all: what marks hide is left out, and differences are added up."""
        if self.log.version() != expected:
            raise StaleVersion(f"version {self.log.version()}, not {expected}")
        view = self.log.view(expected)
        tables = {
            "postings": _by_bucket(self._visible(view, "postings", POSTINGS), self._read(view, "postings", POSTINGS).count()).select("doc_id", "dl", "terms", "tfs", "version", "bucket"),
            "marks": self._read(view, "marks", MARKS).limit(0),
            "rows": self._visible(view, "rows", ROWS),
            "df": self._read(view, "df", DF).groupBy("term", "bucket").agg(F.sum("df").alias("df")).where("df <> 0").select("term", "df", "bucket").repartition("bucket"),
            "sizes": self._read(view, "sizes", SIZES).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")),
        }
        return self.log.commit(tables, expected=expected, replace=tuple(tables), by=PARTED, note="merge")

    def bm25(self, queries: DataFrame, *, version: int | None = None, query_id: str = "query_id", query: str = "query") -> DataFrame:
        """query_id, doc_id and score of every row that holds a query term, as `retrieval.bm25` over all rows gives them.

        Only the buckets of the queries' terms are read; queries are few and are
        sent to all.  An index without rows finds nothing.
        """
        view = self.log.view(version)
        wanted = durable(queries.select(F.col(query_id).alias("query_id"), F.explode(F.flatten(F.transform(retrieval.fts_terms(F.col(query)), retrieval.index_tokens))).alias("term")).distinct().withColumn("bucket", bucket_of(F.col("term"))))
        buckets = [r.bucket for r in wanted.select("bucket").distinct().collect()]  # BUCKETS at most
        asked = F.broadcast(wanted.select("bucket", "term").distinct())
        within = F.col("bucket").isin(buckets) if buckets else F.lit(False)
        postings = self._read(view, "postings", POSTINGS).where(within).select("bucket", "doc_id", "dl", "version", F.explode(F.arrays_zip(F.split("terms", " ").alias("term"), F.col("tfs").alias("tf"))).alias("t"))
        postings = postings.select("bucket", "doc_id", "dl", "version", "t.term", "t.tf").join(asked, ["bucket", "term"], "left_semi")
        hits = postings.join(self._marks(view), "doc_id", "left").where("hidden is null or version >= hidden")
        df = self._read(view, "df", DF).where(within).join(asked, ["bucket", "term"], "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
        sizes = self._read(view, "sizes", SIZES).agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens"))
        n, avgdl = sizes.select("n").scalar(), sizes.select(F.col("tokens") / F.col("n")).scalar()
        return retrieval.bm25_scores(hits, df, F.broadcast(wanted), n, avgdl)
