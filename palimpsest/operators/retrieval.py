"""Hybrid retrieval: exact, lexical and dense channels, and their fusion.

Queries are a table, so many are answered in one plan; every ranking is per
query and totally ordered, ties going to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.scoring import RANK_CONSTANT, cosine_similarity, lexical_score, structured_score
from palimpsest.functions.text import CJK, LATIN_WORD, fold, terms
from palimpsest.sources.tables import durable

#: Saturation and length normalisation of BM25.
K1, B = 1.2, 0.75
#: Column weights of the two full-text indexes, by field.
RULE_COLUMNS = {"source_title": 5.0, "section_title": 5.0, "heading_paths": 3.0, "content": 1.0}
MODULE_COLUMNS = {"module_title": 8.0, "chapter_title": 6.0, "scene_title": 4.0, "headings": 3.0, "keywords": 2.5, "tags": 2.0, "scene_type": 2.0, "chunk_type": 1.5, "content": 1.0}
#: Channel weights of rule search; module search weighs all alike.
RULE_CHANNELS = {"exact": 1.5, "lexical": 1.0, "dense": 1.0}
#: Queries of one search, which are broadcast.
QUERIES_MOST = 10_000
#: Documents' characters that a term pattern may match, as the index cuts them.
INDEX_TOKEN = r"([\p{L}\p{N}\p{Co}]+)"


def enrich_query(query: Column, hints: dict[str, list[str]] | None) -> Column:
    """Append the distinct aliases of every hint whose term is in the query, case counting."""
    if not hints:
        return query
    aliases = F.array_distinct(F.concat(*[F.when(F.contains(query, F.lit(term)), F.array(*map(F.lit, own))).otherwise(F.array().cast("array<string>")) for term, own in hints.items() if own]))
    return F.when(F.size(aliases) > 0, F.concat(query, F.lit(" "), F.array_join(aliases, " "))).otherwise(query)


def fts_terms(query: Column) -> Column:
    """Alternatives of a full-text query: CJK runs, then Latin words, without repeats; operator words are plain words."""
    bare = F.regexp_replace(query, r"[*^\"()+\-\\]", " ")
    return F.array_distinct(F.concat(F.regexp_extract_all(bare, F.lit(f"({CJK}+)"), F.lit(1)), F.regexp_extract_all(bare, F.lit(f"({LATIN_WORD})"), F.lit(1))))


def top_k(scored: DataFrame, score: str, k: int, by: list[str], tie: list[str]) -> DataFrame:
    """The k best rows of each group, with `rank` from 1."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), *tie))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k)


def lexical_top_k(docs: DataFrame, query: str, k: int, *, doc_id: str, title: Column, content: Column) -> DataFrame:
    """doc_id and score of the k best documents for one query; a plain limit, so a heap a partition."""
    score = F.round(lexical_score(terms(F.lit(query)), title, content), 6)
    return docs.select(F.col(doc_id), score.alias("score")).orderBy(F.desc("score"), doc_id).limit(k)


def structured_top_k(docs: DataFrame, query: str, k: int, *, doc_id: str, weights: dict[str, float] | None = None, **fields: Column) -> DataFrame:
    score = F.round(structured_score(terms(F.lit(query)), weights, **fields), 6)
    return docs.select(F.col(doc_id), score.alias("score")).orderBy(F.desc("score"), doc_id).limit(k)


def cosine_top_k(vectors: DataFrame, query: list[float], k: int, *, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    score = F.round(cosine_similarity(F.col(vector), F.array(*[F.lit(float(x)) for x in query])), 6)
    return vectors.select(F.col(vec_id), score.alias("score")).orderBy(F.desc("score"), vec_id).limit(k)


def index_tokens(text: Column) -> Column:
    """Folded runs of letters, digits and private-use characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(INDEX_TOKEN), F.lit(1))


def _weighted(text: Column, weight: float) -> Column:
    return F.transform(index_tokens(text), lambda t: F.struct(t.alias("term"), F.lit(float(weight)).alias("w")))


def postings(docs: DataFrame, doc_id: str, columns: dict[str, float]) -> DataFrame:
    """Inverted index: term, doc_id, tf (occurrences by column weight) and dl (tokens of the row in all columns).

    One row's tokens are counted within the row; nothing is shuffled.
    """
    every = F.concat(*[_weighted(F.col(c), w) for c, w in columns.items()])
    own = docs.select(F.col(doc_id).alias("doc_id"), every.alias("tokens")).withColumn("dl", F.size("tokens"))
    return own.select("doc_id", "dl", F.explode("tokens").alias("t")).groupBy("doc_id", "dl", F.col("t.term").alias("term")).agg(F.sum("t.w").alias("tf")).select("term", "doc_id", "tf", "dl")


def bm25(docs: DataFrame, queries: DataFrame, *, doc_id: str, columns: dict[str, float], query_id: str = "query_id", query: str = "query") -> DataFrame:
    """query_id, doc_id and score of every row that holds a query term in any column.

    Rows are read once: within each row its tokens are counted and those asked
    for (few, sent to all as one array) are taken out; only these are exploded,
    with the row's length, and one row a table part for the statistics.
    """
    wanted = queries.select(F.col(query_id).alias("query_id"), F.explode(F.flatten(F.transform(fts_terms(F.col(query)), index_tokens))).alias("term")).distinct()
    asked = wanted.agg(F.collect_set("term").alias("asked")).scalar()
    tokens = sum((F.regexp_count(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(INDEX_TOKEN)) for c in columns), F.lit(0))
    own = docs.select(F.col(doc_id).alias("doc_id"), tokens.alias("dl"), *[F.col(c).alias(f"__{k}") for k, c in enumerate(columns)], asked.alias("asked"))
    # Terms that the row has, by hashing; then its tokens are compared with these alone.
    own = own.withColumn("there", F.array_intersect(F.flatten(F.array(*[index_tokens(F.col(f"__{k}")) for k in range(len(columns))])), F.col("asked")))
    hits = F.concat(*[F.filter(_weighted(F.col(f"__{k}"), w), lambda t: F.array_contains(F.col("there"), t["term"])) for k, w in enumerate(columns.values())])
    hits = F.when(F.size("there") > 0, hits)
    # Every row leaves its length, most leave nothing else; these narrow rows are written once and read for both.
    found = durable(own.select("doc_id", "dl", hits.alias("hits")))
    sizes = found.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    hits = found.select("doc_id", "dl", F.explode("hits").alias("t")).groupBy("doc_id", "dl", F.col("t.term").alias("term")).agg(F.sum("t.w").alias("tf"))
    df = hits.groupBy("term").agg(F.count("*").alias("df"))
    return bm25_scores(hits, df, wanted, sizes.select("n").scalar(), sizes.select("avgdl").scalar())


def bm25_scores(hits: DataFrame, df: DataFrame, wanted: DataFrame, n: Column, avgdl: Column) -> DataFrame:
    """query_id, doc_id and score from postings (term, doc_id, tf, dl), df (term, df), wanted (query_id, term) and the statistics."""
    idf = F.greatest(F.ln((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / avgdl))
    return hits.join(df, "term").join(wanted.select("query_id", "term"), "term").select("query_id", "doc_id", part.alias("part")).groupBy("query_id", "doc_id").agg(F.sum("part").alias("score"))


def exact_matches(docs: DataFrame, queries: DataFrame, titles: list[str], *, doc_id: str, query_id: str = "query_id", query: str = "query") -> DataFrame:
    """query_id and doc_id where a folded, trimmed title equals the raw query; an equi-join on the folded text."""
    named = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.array_distinct(F.array(*[fold(F.trim(F.col(t))) for t in titles]))).alias("key"))
    asked = queries.select(F.col(query_id).alias("query_id"), fold(F.trim(F.col(query))).alias("key"))
    return named.where("key <> ''").join(asked, "key").select("query_id", "doc_id").distinct()


def ranked(scored: DataFrame, channel: str, score: str | None = "score", limit: int | None = None) -> DataFrame:
    """query_id, doc_id, channel and rank of one channel; without a score the order is that of the ids.

    With a limit, partitions give their own best rows.  Without one all rows are
    ranked: they are dealt out by range of (query, score, id), so that one query
    may have any number of rows, and each partition numbers its own on from
    those before it.
    """
    order = ["query_id", *([F.desc(score)] if score else []), "doc_id"]
    if limit:
        out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order[1:]))).where(F.col("rank") <= limit)
        return out.select("query_id", "doc_id", F.lit(channel).alias("channel"), "rank")
    # Ranges are sampled and rows dealt out by what is written here, so that nothing is scored twice.
    scored = durable(scored.select("query_id", "doc_id", *([score] if score else [])))
    dealt = scored.repartitionByRange(*order).sortWithinPartitions(*order).select("query_id", "doc_id")
    dealt = durable(dealt.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    sizes = dealt.groupBy("query_id", "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy("query_id").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each query and partition that it reaches into.
    placed = dealt.join(sizes.withColumn("__before", before), ["query_id", "__part"])
    return placed.select("query_id", "doc_id", F.lit(channel).alias("channel"), (F.col("__at") - F.col("__first") + F.col("__before") + 1).cast("int").alias("rank"))


def reciprocal_rank_fusion(channels: list[DataFrame], *, weights: dict[str, float] | None = None, constant: int = RANK_CONSTANT, order: list[str] | None = None) -> DataFrame:
    """query_id, doc_id, score (sum of weight / (constant + rank)) and the channels that hold the row, in `order`."""
    every = channels[0]
    for c in channels[1:]:
        every = every.unionByName(c)
    weight = F.lit(1.0)
    for name, w in (weights or {}).items():
        weight = F.when(F.col("channel") == name, F.lit(float(w))).otherwise(weight)
    names = F.array(*map(F.lit, order or list(weights or {})))
    place = F.struct(F.array_position(names, F.col("channel")).alias("at"), F.col("channel").alias("name"))
    fused = every.groupBy("query_id", "doc_id").agg(F.sum(weight / (constant + F.col("rank"))).alias("score"), F.array_sort(F.collect_set(place)).alias("own"))
    return fused.select("query_id", "doc_id", "score", F.col("own.name").alias("channels"))


def hybrid_search(
    docs: DataFrame,
    queries: DataFrame,
    k: int,
    *,
    doc_id: str,
    titles: list[str],
    fields: dict[str, str],
    vectors: DataFrame | None = None,
    hints: dict[str, list[str]] | None = None,
    weights: dict[str, float] | None = None,
    index: dict[str, float] | None = None,
    decimals: int = 12,
) -> DataFrame:
    """query_id, rank, doc_id, score and channels of the k best rows of each query.

    Exact matches compare the raw query with titles; the lexical channel scores
    the enriched query, by BM25 over `index` where it finds anything for the
    query, else by weighted fields over all rows; the dense channel ranks all
    rows of `vectors` (doc_id, embedding) by cosine with the query's own
    embedding.  Filter `docs` before: the limit of the index comes after it.
    Scores are rounded to `decimals` before they are ranked, so that rounding
    errors break no ties.  The queries are the small side of every join; documents aren't shuffled
    before they are ranked.
    """
    if queries.limit(QUERIES_MOST + 1).count() > QUERIES_MOST:
        raise ValueError(f"more than {QUERIES_MOST} queries: all are sent to every executor, so search in batches")
    asked = queries.withColumn("enriched", enrich_query(F.col("query"), hints))
    exact = ranked(exact_matches(docs, asked, titles, doc_id=doc_id), "exact", None)
    own = docs.select(F.col(doc_id).alias("doc_id"), *[F.col(c).alias(f) for f, c in fields.items()])
    one = F.lit(1)
    pairs = own.withColumn("__one", one).join(F.broadcast(asked.select("query_id", terms(F.col("enriched")).alias("terms")).withColumn("__one", one)), "__one")
    structured = pairs.select("query_id", "doc_id", F.round(structured_score(F.col("terms"), **{f: F.col(f) for f in fields}), decimals).alias("score"))
    if index:
        found = ranked(bm25(docs, asked.withColumn("query", F.col("enriched")), doc_id=doc_id, columns=index), "lexical", limit=max(4 * k, 20))
        structured = structured.join(F.broadcast(found.select("query_id").distinct()), "query_id", "left_anti")
        lexical = found.unionByName(ranked(structured, "lexical"))
    else:
        lexical = ranked(structured, "lexical")
    channels = [exact, lexical]
    if vectors is not None:
        dense = vectors.withColumn("__one", one).join(F.broadcast(asked.where(F.col("embedding").isNotNull()).select("query_id", F.col("embedding").alias("asked")).withColumn("__one", one)), "__one")
        dense = dense.select("query_id", "doc_id", F.round(cosine_similarity(F.col("embedding"), F.col("asked")), decimals).alias("score"))
        channels.append(ranked(dense, "dense"))
    fused = reciprocal_rank_fusion(channels, weights=weights, order=["exact", "lexical", "dense"]).withColumn("score", F.round("score", 9))
    return top_k(fused, "score", k, ["query_id"], ["doc_id"]).select("query_id", "rank", "doc_id", "score", "channels")
