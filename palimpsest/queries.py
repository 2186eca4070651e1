"""Registered queries over the driver tables and their DuckDB twins.

The tables stand in for ledgers and documents: each query says how.  Every query
reads its whole tables; limits are those of top-k reports.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import hashing, text
from palimpsest.functions.scoring import FIELD_WEIGHTS, cosine_similarity
from palimpsest.operators import access, candidates, cast, catalog, chunking, contracts, documents, facts, headings, ledger, outline, records, reflow, regions, retrieval, rulepacks, spatial
from palimpsest.plans import cards, ingestion, packages, timelines, transactions
from palimpsest.sources import vectors
from palimpsest.sources.commits import CommitLog
from palimpsest.sources.index import SearchIndex
from palimpsest.sources.tables import dealt, shared_folder, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL twin."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ------------------------------------------------------------------ retrieval

ASKED = "the thing of erand"
ASKED_TERMS = ASKED.split()
VECTOR = [round(1 / (i + 1), 6) for i in range(64)]


def _fold(c: str) -> str:
    return f"replace(lower(coalesce({c}, '')), 'ß', 'ss')"


def _count(c: str, term: str) -> str:
    return f"((length({_fold(c)}) - length(replace({_fold(c)}, '{term}', ''))) // {len(term)})"


def _n_terms(c: str) -> str:
    cjk = f"len(regexp_extract_all({_fold(c)}, '[\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}]'))"
    return f"(len(regexp_extract_all({_fold(c)}, '[A-Za-z0-9_''-]+')) + {cjk} + greatest({cjk} - 1, 0))"


def _lexical(title: str, content: str, terms: list[str]) -> str:
    return "round((" + " + ".join(f"4.0 * {_count(title, t)} + least({_count(content, t)}, 8)" for t in terms) + f") / sqrt(greatest({_n_terms(content)}, 1)), 6)"


def _structured(fields: dict[str, str], terms: list[str]) -> str:
    score = " + ".join(f"{FIELD_WEIGHTS[f]} * {_count(c, t)}" for f, c in fields.items() for t in terms)
    return f"round(({score}) / sqrt(greatest({_n_terms(fields['content'])}, 4)), 6)"


@query(f"SELECT doc_id, {_lexical('source', 'text', ASKED_TERMS)} AS score FROM documents ORDER BY score DESC, doc_id LIMIT 20")
def lexical_topk(spark, d):
    """Documents by weighted term score; the source is the title."""
    return retrieval.lexical_top_k(read(spark, d, "documents"), ASKED, 20, doc_id="doc_id", title=F.col("source"), content=F.col("text"))


_FIELDS = {"source_title": "source", "tags": "lang", "content": "text"}


@query(f"SELECT doc_id, {_structured(_FIELDS, ASKED_TERMS)} AS score FROM documents ORDER BY score DESC, doc_id LIMIT 20")
def structured_topk(spark, d):
    return retrieval.structured_top_k(read(spark, d, "documents"), ASKED, 20, doc_id="doc_id", **{f: F.col(c) for f, c in _FIELDS.items()})


_COSINE = f"list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), {VECTOR}::DOUBLE[])"


@query(f"SELECT vec_id, round({_COSINE}, 6) AS score FROM embeddings ORDER BY score DESC, vec_id LIMIT 20")
def cosine_topk(spark, d):
    return retrieval.cosine_top_k(read(spark, d, "embeddings"), VECTOR, 20)


@query(f"SELECT vec_id AS id, round({_COSINE}, 6) AS score FROM embeddings WHERE label = 3 ORDER BY {_COSINE} DESC, vec_id LIMIT 10")
def vector_query(spark, d):
    """A filtered search of a vector collection."""
    own = read(spark, d, "embeddings").withColumnRenamed("vec_id", "id")
    return vectors.query(own, VECTOR, 10, F.col("label") == 3).withColumn("score", F.round("score", 6))


_BM25 = {"source": 5.0, "text": 1.0}
_QUERIES = [(0, "the thing"), (1, "der und NOT queos"), (2, "les (src3)")]
_BM25_TERMS = [(0, "the"), (0, "thing"), (1, "der"), (1, "und"), (1, "not"), (1, "queos"), (2, "les"), (2, "src3")]


def _asked(spark):
    return spark.createDataFrame(_QUERIES, "query_id int, query string")


_BM25_SQL = f"""
WITH q(query_id, term) AS (VALUES {", ".join(f"({i}, '{t}')" for i, t in _BM25_TERMS)}),
tok AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(source, '')), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+') AS s, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+') AS c FROM documents
), size AS (SELECT doc_id, len(s) + len(c) AS dl FROM tok), avg AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM size),
hit AS (
  SELECT doc_id, term, sum(w) AS tf FROM (SELECT doc_id, unnest(s) AS term, CAST(5 AS DOUBLE) AS w FROM tok UNION ALL SELECT doc_id, unnest(c), CAST(1 AS DOUBLE) FROM tok)
  WHERE term IN (SELECT term FROM q) GROUP BY ALL
), df AS (SELECT term, count(*) AS df FROM hit GROUP BY term),
score AS (
  SELECT query_id, doc_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM hit JOIN df USING (term) JOIN q USING (term) JOIN size USING (doc_id), avg GROUP BY query_id, doc_id
)"""


@query(_BM25_SQL + " SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM score QUALIFY rank <= 20")
def bm25_topk(spark, d):
    scored = retrieval.bm25(read(spark, d, "documents"), _asked(spark), doc_id="doc_id", columns=_BM25).withColumn("score", F.round("score", 6))
    return retrieval.top_k(scored, "score", 20, ["query_id"], ["doc_id"]).select("query_id", "rank", "doc_id", "score")


@query("SELECT n_nationkey AS query_id, n_regionkey AS doc_id FROM nation")
def exact_match(spark, d):
    """Regions by exact title: each nation asks for its region's name, in other case and with blanks."""
    regions = read(spark, d, "region")
    asked = read(spark, d, "nation").join(F.broadcast(regions), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("query_id"), F.concat(F.lit("  "), F.lower("r_name")).alias("query"))
    return retrieval.exact_matches(regions, asked, ["r_name"], doc_id="r_regionkey")


_RRF_SQL = f"""
WITH lex AS (SELECT doc_id, row_number() OVER (ORDER BY {_lexical("source", "text", ASKED_TERMS)} DESC, doc_id) AS rank FROM documents),
dense AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY round({_COSINE}, 6) DESC, vec_id) AS rank FROM embeddings),
fused AS (SELECT doc_id, round(sum(w / (60 + rank)), 9) AS score FROM (SELECT doc_id, rank, 1.5 AS w FROM lex UNION ALL SELECT doc_id, rank, 1.0 FROM dense) GROUP BY doc_id)
SELECT CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM fused QUALIFY rank <= 20"""


@query(_RRF_SQL)
def rrf_fusion(spark, d):
    """Lexical ranks of documents fused with cosine ranks of vectors of the same ids."""
    one = F.lit(0).alias("query_id")
    lex = read(spark, d, "documents").select(one, "doc_id", F.round(retrieval.lexical_score(text.terms(F.lit(ASKED)), F.col("source"), F.col("text")), 6).alias("score"))
    dense = read(spark, d, "embeddings").select(one, F.col("vec_id").alias("doc_id"), F.round(cosine_similarity(F.col("embedding"), F.array(*map(F.lit, VECTOR))), 6).alias("score"))
    fused = retrieval.reciprocal_rank_fusion([retrieval.ranked(lex, "lexical"), retrieval.ranked(dense, "dense")], weights={"lexical": 1.5, "dense": 1.0})
    return retrieval.top_k(fused.withColumn("score", F.round("score", 9)), "score", 20, ["query_id"], ["doc_id"]).select("rank", "doc_id", "score")


_HYBRID_QUERY = "src3"
_HYBRID_SQL = f"""
WITH exact AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rank FROM documents WHERE trim(lower(source)) = 'src3'),
lex AS (SELECT doc_id, row_number() OVER (ORDER BY {_structured(_FIELDS, ["src3", "thing"])} DESC, doc_id) AS rank FROM documents),
dense AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY round({_COSINE}, 6) DESC, vec_id) AS rank FROM embeddings),
every AS (SELECT doc_id, rank, 1.5 AS w, 'exact' AS c FROM exact UNION ALL SELECT doc_id, rank, 1.0, 'lexical' FROM lex UNION ALL SELECT doc_id, rank, 1.0, 'dense' FROM dense),
fused AS (SELECT doc_id, round(sum(w / (60 + rank)), 9) AS score, string_agg(c, '+' ORDER BY CASE c WHEN 'exact' THEN 1 WHEN 'lexical' THEN 2 ELSE 3 END) AS channels FROM every GROUP BY doc_id)
SELECT CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score, channels FROM fused QUALIFY rank <= 20"""


@query(_HYBRID_SQL)
def hybrid_search(spark, d):
    """All three channels for one query with an alias hint; vectors go by document id."""
    asked = spark.createDataFrame([(0, _HYBRID_QUERY, [float(x) for x in VECTOR])], "query_id int, query string, embedding array<double>")
    held = read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    found = retrieval.hybrid_search(read(spark, d, "documents"), asked, 20, doc_id="doc_id", titles=["source"], fields=_FIELDS, vectors=held, hints={"src3": ["thing"]}, weights=retrieval.RULE_CHANNELS, decimals=6)
    return found.select("rank", "doc_id", "score", F.array_join("channels", "+").alias("channels"))


# ------------------------------------------------------------------ documents


@query("""
SELECT doc_id, CASE WHEN c > 0 AND l > 0 AND least(c, l) / greatest(c, l) >= 0.15 THEN 'mixed' WHEN c > 0 THEN 'zh' WHEN l > 0 THEN 'en' ELSE 'mixed' END AS detected,
  CASE WHEN lang LIKE 'en%' THEN 'en' WHEN lang LIKE 'zh%' OR lang LIKE 'cn%' THEN 'zh' ELSE 'mixed' END AS normalized
FROM (SELECT doc_id, lang, len(regexp_extract_all(text, '[\\x{3400}-\\x{4dbf}\\x{4e00}-\\x{9fff}]')) AS c, len(regexp_extract_all(text, '[A-Za-z]')) AS l FROM documents)""")
def language_detect(spark, d):
    return read(spark, d, "documents").select("doc_id", text.detect_text_language(F.col("text")).alias("detected"), text.normalize_language(F.col("lang")).alias("normalized"))


_PAGE = r"""
p AS (
  SELECT source, doc_id, length(text) AS characters, len(regexp_extract_all(text, '[\s\x0B\x1C-\x1F\x{85}\p{Z}]')) AS sp, len(regexp_extract_all(text, '\p{L}')) AS alphabetic,
    len(regexp_extract_all(text, '\p{Co}')) AS private_use, len(regexp_extract_all(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x{9F}]')) AS control, len(regexp_extract_all(text, '\x{FFFD}')) AS replacement,
    len(list_filter(regexp_extract_all(text, '\p{L}+'), lambda r: length(r) >= 30)) AS long_runs
  FROM documents
), f AS (SELECT *, characters - sp AS non_whitespace, characters - sp < 20 AS sparse, alphabetic >= 200 AND sp / greatest(alphabetic, 1) < 0.08 AND long_runs >= 3 AS fused,
    private_use / greatest(characters, 1) >= 0.02 OR control / greatest(characters, 1) >= 0.01 OR replacement / greatest(characters, 1) >= 0.01 AS corrupt FROM p)"""


@query(f"WITH {_PAGE} SELECT doc_id, characters, non_whitespace, alphabetic, private_use, control, replacement, long_runs, sparse, fused, corrupt FROM f")
def page_quality(spark, d):
    """Documents as pages."""
    names = ("characters", "non_whitespace", "alphabetic", "private_use", "control", "replacement", "long_runs", "sparse", "fused", "corrupt")
    q = documents.page_quality(F.col("text"))
    return read(spark, d, "documents").select("doc_id", *[q[n].alias(n) for n in names])


@query(f"""WITH {_PAGE} SELECT source, count(*) AS pages, CAST(sum(characters) AS BIGINT) AS characters, CAST(sum(non_whitespace) AS BIGINT) AS non_whitespace,
  CAST(count(*) FILTER (sparse) AS BIGINT) AS sparse, CAST(count(*) FILTER (fused) AS BIGINT) AS fused, round(sum(control) / greatest(sum(characters), 1), 6) AS control_ratio, round((count(*) - count(*) FILTER (sparse)) / count(*), 6) AS coverage
FROM f GROUP BY source""")
def document_quality(spark, d):
    """Sources as documents, documents as their pages."""
    q = documents.document_quality(read(spark, d, "documents"), "source", "doc_id", "text")
    return q.select("source", "pages", "characters", "non_whitespace", F.size("sparse_pages").cast("long").alias("sparse"), F.size("fused_pages").cast("long").alias("fused"), "control_ratio", "coverage")


@query(r"""
WITH l AS (SELECT source, doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents),
e AS (SELECT source, doc_id, unnest(list_distinct(list_transform(list_filter(list_concat(l[1:3], l[greatest(len(l) - 2, 1):]), lambda x: NOT regexp_matches(x, '^[-–—\s]*(?:[Pp][Aa][Gg][Ee]\s+)?[0-9]{1,4}[-–—\s]*$') AND NOT regexp_matches(x, '(?i)^\s*(?:chapter|appendix|ch\.|app\.)\s*[0-9ivxlca-z]+')),
  lambda x: regexp_replace(replace(lower(x), 'ß', 'ss'), '[^\p{L}\p{M}\p{N}_]+', '', 'g')))) AS line FROM l),
n AS (SELECT source, count(DISTINCT doc_id) AS of FROM documents GROUP BY source)
SELECT source, line, count(*) AS pages FROM e JOIN n USING (source) WHERE line <> '' GROUP BY source, line, of HAVING count(*) >= greatest(2, of // 8)""")
def repeated_margins(spark, d):
    return documents.repeated_margin_lines(read(spark, d, "documents"), "source", "doc_id", "text")


@query()
def chunk_windows(spark, d):
    """Chunks of documents under two headings each, with exact offsets; no SQL form, tested by slicing."""
    docs = read(spark, d, "documents").withColumn("text", F.concat(F.lit("# "), "source", F.lit("\n## "), F.col("doc_id").cast("string"), F.lit("\n"), "text"))
    return chunking.parse_chunks(docs, "doc_id", "text").select("doc_id", "section", "ordinal", "start", "end", "tokens", F.sha2("content", 256).alias("content_sha256"))


@query()
def module_chunks(spark, d):
    """Sources as chapters' titles, documents as scenes with page markers."""
    body = F.concat(F.lit("<!-- page: 1 -->\n# "), "source", F.lit("\n## "), F.col("doc_id").cast("string"), F.lit("\n"), "text")
    return chunking.parse_modules(read(spark, d, "documents").withColumn("text", body), "doc_id", "text").drop("content")


@query("""
WITH l AS (SELECT doc_id, text, list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '') AS l FROM documents)
SELECT doc_id, CASE WHEN len(l) > 0 AND len(list_filter(l, lambda x: ltrim(x)[1] = '|')) = len(l) THEN 'table' WHEN ltrim(text)[1] = '>' THEN 'blockquote'
  WHEN len(l) > 0 AND len(list_filter(l, lambda x: ltrim(x)[1] IN ('-', '*'))) >= len(l) / 2 THEN 'list' ELSE 'narrative' END AS kind FROM l""")
def chunk_type(spark, d):
    return read(spark, d, "documents").select("doc_id", text.chunk_type(F.col("source"), F.col("text")).alias("kind"))


@query("SELECT sha256(text) AS address, count(*) AS copies, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_copies(spark, d):
    """Groups of documents by content address."""
    own = read(spark, d, "documents").groupBy(F.sha2("text", 256).alias("address")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first"))
    return own.where("copies > 1")


@query("SELECT p_partkey, trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-') AS slug, regexp_replace(lower(p_name), '[^a-z0-9]+', '', 'g') AS compact, greatest(1, length(p_type) // 4) AS tokens FROM part")
def text_keys(spark, d):
    return read(spark, d, "part").select("p_partkey", text.ascii_slug(F.col("p_name")).alias("slug"), text.compact_ascii_key(F.col("p_name")).alias("compact"), text.estimated_tokens(F.col("p_type")).alias("tokens"))


@query("""
WITH k AS (SELECT p_partkey, trim(regexp_replace(lower(p_brand || '/' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS k FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY p_partkey) AS n FROM k)
SELECT p_partkey, CASE WHEN n = 1 THEN k ELSE k || '--' || n END AS stable_key FROM n""")
def stable_keys(spark, d):
    """Brands and types as heading paths."""
    own = read(spark, d, "part").select("p_partkey", text.stable_key(F.array("p_brand", "p_type"), F.col("p_name")).alias("k"))
    return ledger.occurrence_keys(own, [], "k", ["p_partkey"]).select("p_partkey", "stable_key")


@query("SELECT doc_id, coalesce(contains(trim(regexp_replace(translate(text, '‘’“”‐‑‒–—', '''''\"\"-----'), '\\s+', ' ', 'g')), trim(regexp_replace(translate(substr(text, 11, 40), '‘’“”‐‑‒–—', '''''\"\"-----'), '\\s+', ' ', 'g'))), false) AS held FROM documents")
def evidence_containment(spark, d):
    """Each document bound to an excerpt of itself, compared after cleaning; a null text holds nothing."""
    held = F.contains(text.clean_evidence(F.col("text")), text.clean_evidence(F.substring("text", 11, 40)))
    return read(spark, d, "documents").select("doc_id", F.coalesce(held, F.lit(False)).alias("held"))


@query("SELECT event_id, sha256(replace(props, ' ', '')) AS address FROM events")
def json_addresses(spark, d):
    """Content addresses of the canonical JSON of event properties."""
    return read(spark, d, "events").select("event_id", hashing.json_sha256(F.col("props")).alias("address"))


@query("SELECT event_id, sha256(replace(props, ' ', '')) AS id, length(replace(props, ' ', '')) AS size, replace(props, ' ', '') AS value FROM events")
def state_documents(spark, d):
    """Event properties as compressed state documents, encoded, decoded and verified."""
    doc = read(spark, d, "events").select("event_id", hashing.encoded_document(F.col("props")).alias("e"))
    back = doc.withColumn("d", hashing.decoded_document("e.id", "e.codec", "e.size", "e.payload"))
    return back.select("event_id", "e.id", "e.size", "d.value")


@query("SELECT doc_id, source || '/section-0/chunk-' || doc_id || '-' || substr(sha256(text), 1, 16) AS chunk_key FROM documents")
def chunk_keys(spark, d):
    return read(spark, d, "documents").select("doc_id", hashing.chunk_key(F.col("source"), F.lit(0), F.col("doc_id"), F.col("text")).alias("chunk_key"))


# ------------------------------------------------------------------ ledgers


@query("SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def branch_heads(spark, d):
    """Orders as revisions of their customer."""
    own = read(spark, d, "orders").select("o_custkey", F.struct("o_orderdate", "o_orderkey").alias("v"), "o_orderkey", "o_orderstatus", "o_totalprice")
    return ledger.latest(own, ["o_custkey"], "v").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice")


def _events(spark, d):
    """Events with derived branches, snapshots and scopes."""
    e = F.col("event_id")
    scope = F.when(F.col("event_type") == "view", "public").when(F.col("event_type") == "click", "party").when(F.col("event_type") == "signup", "actor").otherwise("dm")
    return read(spark, d, "events").select(
        "event_id", F.col("event_id").alias("sequence"), "event_type", "user_id", "value", "ts",
        F.concat(F.lit("b"), (e % 3).cast("string")).alias("branch_id"), F.when(e % 5 < 3, F.concat(F.lit("s"), (e % 4).cast("string"))).alias("committed_snapshot_id"), scope.alias("audience_scope"),
    )


_EVENTS = "SELECT *, event_id AS sequence, 'b' || event_id % 3 AS branch_id, CASE WHEN event_id % 5 < 3 THEN 's' || event_id % 4 END AS committed_snapshot_id, CASE event_type WHEN 'view' THEN 'public' WHEN 'click' THEN 'party' WHEN 'signup' THEN 'actor' ELSE 'dm' END AS audience_scope FROM events"


def _visible(spark, d):
    own = _events(spark, d)
    return ledger.visible_events(own, own.where(F.col("committed_snapshot_id").isNotNull()).select(F.col("committed_snapshot_id").alias("snapshot_id"), "event_id"), "b1", "s2")


_VISIBLE = f"SELECT * FROM ({_EVENTS}) WHERE committed_snapshot_id = 's2' OR (branch_id = 'b1' AND committed_snapshot_id IS NULL)"


@query(f"SELECT event_id, branch_id, committed_snapshot_id FROM ({_VISIBLE})")
def event_visibility(spark, d):
    return _visible(spark, d).select("event_id", "branch_id", "committed_snapshot_id")


@query(f"SELECT event_id, audience_scope FROM ({_VISIBLE}) WHERE audience_scope IN ('public', 'party', 'player') OR (audience_scope = 'actor' AND user_id = 7)")
def audience_events(spark, d):
    """Users as actors."""
    own = _visible(spark, d)
    return ledger.audience_events(own, "player", _events(spark, d).where("user_id = 7").select("event_id")).select("event_id", "audience_scope")


@query(f"SELECT event_id, event_type, user_id FROM ({_VISIBLE}) ORDER BY sequence DESC LIMIT 500")
def event_tail(spark, d):
    return ledger.tail(_visible(spark, d), 500, ["sequence", "event_id"]).select("event_id", "event_type", "user_id")


@query("SELECT o_orderkey, string_agg(p, ',' ORDER BY p) AS participants FROM (SELECT DISTINCT l_orderkey AS o_orderkey, l_returnflag || ':' || l_suppkey AS p FROM lineitem) GROUP BY o_orderkey")
def participants(spark, d):
    """Suppliers as participants of orders, return flags as roles."""
    own = ledger.participant_map(read(spark, d, "lineitem"), "l_orderkey", "l_returnflag", "l_suppkey")
    joined = F.array_join(F.array_sort(F.transform("participants", lambda p: F.concat_ws(":", p["role"], p["actor"].cast("string")))), ",")
    return own.select(F.col("l_orderkey").alias("o_orderkey"), joined.alias("participants"))


_HEADS = [("F", "O"), ("O", "P")]


@query("""
WITH a AS (SELECT o_custkey, max(o_orderkey) AS v FROM orders WHERE o_orderstatus <> 'O' GROUP BY 1), b AS (SELECT o_custkey, max(o_orderkey) AS v FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT 'facts' AS ledger, CAST(coalesce(a.o_custkey, b.o_custkey) AS VARCHAR) AS key, CASE WHEN b.v IS NULL THEN 'left_only' WHEN a.v IS NULL THEN 'right_only' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.o_custkey = b.o_custkey WHERE a.v IS DISTINCT FROM b.v""")
def branch_compare(spark, d):
    """Heads of customers on a branch of closed orders and one of open orders."""
    o = read(spark, d, "orders")
    heads = [o.where(F.col("o_orderstatus") != s).groupBy("o_custkey").agg(F.max("o_orderkey").alias("v")) for s in ("O", "F")]
    return ledger.compare_branches({"facts": (heads[0], heads[1], "o_custkey", "v")})


@query("""
WITH o AS (SELECT p_name || '/' || p_partkey AS stable_key, p_brand AS c FROM part WHERE p_partkey % 7 <> 0), n AS (SELECT p_name || '/' || p_partkey AS stable_key, CASE WHEN p_partkey % 5 = 0 THEN p_brand || '!' ELSE p_brand END AS c FROM part WHERE p_partkey % 3 <> 0),
p AS (SELECT p_name || '/' || p_partkey AS stable_key, count(*) AS progress FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
SELECT stable_key, CASE WHEN n.c IS NULL THEN 'left_only' WHEN o.c IS NULL THEN 'right_only' WHEN o.c = n.c THEN 'unchanged' ELSE 'changed' END AS change, coalesce(progress, 0) AS progress
FROM o FULL JOIN n USING (stable_key) LEFT JOIN p USING (stable_key)""")
def scene_diff(spark, d):
    """Parts as scenes of two revisions, line items as progress."""
    key = F.concat_ws("/", "p_name", F.col("p_partkey").cast("string"))
    part = read(spark, d, "part").select("p_partkey", key.alias("stable_key"), "p_brand")
    old = part.where("p_partkey % 7 <> 0").select("stable_key", F.col("p_brand").alias("checksum"))
    new = part.where("p_partkey % 3 <> 0").select("stable_key", F.when(F.col("p_partkey") % 5 == 0, F.concat("p_brand", F.lit("!"))).otherwise(F.col("p_brand")).alias("checksum"))
    progress = read(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).select("stable_key")
    return ingestion.scene_diff(old, new, progress)


@query("""
WITH RECURSIVE n AS (SELECT conv_id || ':' || turn AS id, CASE WHEN turn > 0 THEN conv_id || ':' || (turn - 1) END AS parent FROM conversations),
s AS (SELECT max_by(conv_id || ':' || turn, turn * 1000000 + conv_id) AS id FROM conversations),
w(id, depth) AS (SELECT id, 0 FROM s UNION ALL SELECT n.parent, depth + 1 FROM w JOIN n ON n.id = w.id WHERE n.parent IS NOT NULL)
SELECT id, CAST(depth AS INTEGER) AS depth, CASE WHEN id NOT IN (SELECT id FROM n) THEN 'missing' END AS error FROM w""")
def snapshot_lineage(spark, d):
    """The longest conversation as a chain of snapshots."""
    c = read(spark, d, "conversations")
    key = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    nodes = c.select(key(F.col("turn")).alias("id"), F.when(F.col("turn") > 0, key(F.col("turn") - 1)).alias("parent_id"))
    start = c.agg(F.max_by(key(F.col("turn")), F.col("turn") * 1000000 + F.col("conv_id")).alias("id")).first()
    return ledger.lineage(nodes, start.id if start and start.id else "")


@query("""
SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY (role = 'assistant') DESC, turn DESC, text DESC) AS n FROM conversations WHERE role IN ('assistant', 'user')) WHERE n = 1""")
def scope_fallback(spark, d):
    """The last turn of the assistant, else of the user, as the scope and its fallback."""
    own = read(spark, d, "conversations").withColumnRenamed("role", "scope_id")
    return ledger.scoped(own, "assistant", ["conv_id"], fallback="user", order=["turn", "text"]).select("conv_id", "turn", F.col("scope_id").alias("role"))


@query(f"""
WITH f AS (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'retired' ELSE 'active' END AS status, o_orderkey + o_custkey AS ref FROM orders), k AS (SELECT l_returnflag AS s, l_orderkey * 3 AS ref FROM lineitem)
SELECT (SELECT count(*) FROM f) AS facts_total, (SELECT count(*) FROM f WHERE status = 'active') AS facts_active, (SELECT count(*) FROM f WHERE ref NOT IN (SELECT event_id FROM events)) AS orphan_fact_refs,
  (SELECT count(*) FROM k) AS knowledge_total, (SELECT count(*) FROM k WHERE s = 'R') AS knowledge_inactive, (SELECT count(*) FROM k WHERE ref NOT IN (SELECT event_id FROM events)) AS orphan_knowledge_refs,
  (SELECT count(*) FROM ({_EVENTS}) WHERE branch_id = 'b1') AS events_total, (SELECT count(*) FROM ({_EVENTS}) WHERE branch_id = 'b1' AND committed_snapshot_id IS NULL) AS events_unsnapshotted, (SELECT max(event_id) FROM ({_EVENTS}) WHERE branch_id = 'b1') AS latest_sequence""")
def diagnostics(spark, d):
    """Orders as facts, line items as knowledge."""
    facts = read(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "retired").otherwise("active").alias("status"), F.array(F.col("o_orderkey") + F.col("o_custkey")).alias("source_event_ids"))
    known = read(spark, d, "lineitem").select(F.when(F.col("l_returnflag") == "R", "forgotten").otherwise("known").alias("epistemic_status"), (F.col("l_orderkey") * 3).alias("source_event_id"))
    snapshots = read(spark, d, "region").select(F.col("r_name").alias("id"), F.col("r_regionkey").alias("slot"))
    own = ledger.diagnostics(facts, known, _events(spark, d).where("branch_id = 'b1'"), _events(spark, d), snapshots)
    return own.select("facts_total", "facts_active", "orphan_fact_refs", "knowledge_total", "knowledge_inactive", "orphan_knowledge_refs", "events_total", "events_unsnapshotted", "latest_sequence")


@query("SELECT l_orderkey, l_linenumber, l_suppkey * 11 AS ref FROM lineitem WHERE l_suppkey * 11 NOT IN (SELECT o_orderkey FROM orders)")
def orphan_refs(spark, d):
    own = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") * 11).alias("ref"))
    return ledger.orphans(own, read(spark, d, "orders"), "ref", "o_orderkey").select("l_orderkey", "l_linenumber", "ref")


@query("""
WITH b AS (SELECT user_id, count(*) AS v FROM events WHERE ts < TIMESTAMP '2024-01-15' GROUP BY 1), a AS (SELECT user_id, count(*) AS v FROM events WHERE event_type <> 'error' GROUP BY 1)
SELECT user_id, CASE WHEN b.v IS NULL THEN 'added' WHEN a.v IS NULL THEN 'removed' ELSE 'changed' END AS change, b.v AS before, a.v AS after FROM a FULL JOIN b USING (user_id) WHERE a.v IS DISTINCT FROM b.v""")
def recap_delta(spark, d):
    """Event counts by user, before and after."""
    e = read(spark, d, "events")
    before = e.where("ts < timestamp '2024-01-15'").groupBy("user_id").agg(F.count("*").alias("v"))
    return ledger.recap(before, e.where("event_type <> 'error'").groupBy("user_id").agg(F.count("*").alias("v")), "user_id", "v")


@query("""
WITH RECURSIVE c AS (SELECT conv_id, turn, length(text) AS size, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) % 7 DESC, role, turn) AS n FROM conversations),
w(conv_id, n, used, took) AS (SELECT conv_id, 0::BIGINT, 0::BIGINT, []::BIGINT[] FROM c GROUP BY conv_id
  UNION ALL SELECT w.conv_id, c.n, CASE WHEN used + size <= 1000 THEN used + size ELSE used END, CASE WHEN used + size <= 1000 THEN list_append(took, turn) ELSE took END FROM w JOIN c ON c.conv_id = w.conv_id AND c.n = w.n + 1)
SELECT conv_id, used, array_to_string(took, ',') AS picked FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) AS r FROM w) WHERE r = 1""")
def budget_fold(spark, d):
    """Turns as candidates for a budget of each conversation."""
    own = read(spark, d, "conversations").select("conv_id", (F.length("text") % 7).cast("double").alias("score"), F.col("role").alias("ledger"), F.col("turn").alias("index"), F.length("text").alias("size"), F.col("turn").alias("item"))
    out = ledger.budget_fold(own, ["conv_id"], budget=1000)
    return out.select("conv_id", "used", F.array_join(F.transform("picked", lambda p: p["item"].cast("string")), ",").alias("picked"))


def _revisions(spark, d):
    l = read(spark, d, "lineitem")  # noqa: E741
    return l.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.col("l_orderkey").cast("string").alias("group_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("sequence"), F.when(F.col("l_orderkey") % 100 < 90, "applied").otherwise("undone").alias("status"), F.lit(True).alias("reversible"), F.concat(F.lit("b"), (F.col("l_orderkey") % 2).cast("string")).alias("branch_id"))


_REVISIONS = "SELECT l_orderkey || '-' || l_linenumber AS id, CAST(l_orderkey AS VARCHAR) AS group_id, l_orderkey * 100 + l_linenumber AS sequence, CASE WHEN l_orderkey % 100 < 90 THEN 'applied' ELSE 'undone' END AS status, 'b' || l_orderkey % 2 AS branch_id FROM lineitem"


@query(f"WITH r AS (SELECT * FROM ({_REVISIONS}) WHERE branch_id = 'b0' AND status = 'applied') SELECT id, sequence FROM r WHERE group_id = (SELECT max_by(group_id, sequence) FROM r)")
def undo_cursor(spark, d):
    """Line items as revisions, orders as mutation groups."""
    return ledger.undo_group(_revisions(spark, d), "b0").select("id", "sequence")


@query(f"WITH r AS (SELECT * FROM ({_REVISIONS}) WHERE branch_id = 'b1'), c AS (SELECT coalesce(max(sequence) FILTER (status = 'applied'), 0) AS c FROM r), g AS (SELECT group_id, min(sequence) AS first FROM r WHERE status = 'undone' GROUP BY 1) SELECT id, sequence FROM r WHERE group_id = (SELECT min_by(group_id, first) FROM g, c WHERE first > c)")
def redo_cursor(spark, d):
    return ledger.redo_group(_revisions(spark, d), "b1").select("id", "sequence")


@query("""
WITH e AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b, (a.n_nationkey + b.n_nationkey) % 2 = 0 AS bi, a.n_nationkey * 100 + b.n_nationkey AS ordinal, a.n_nationkey > b.n_nationkey AS level FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey)
SELECT a, b, bi AS bidirectional, ordinal FROM (SELECT *, row_number() OVER (PARTITION BY CASE WHEN bi THEN least(a, b) ELSE a END, CASE WHEN bi THEN greatest(a, b) ELSE b END, bi ORDER BY level DESC, ordinal DESC) AS n FROM e) WHERE n = 1""")
def edge_merge(spark, d):
    """Nations of a region as connected places; edges to smaller keys are reviewed."""
    n = read(spark, d, "nation").select("n_nationkey", "n_regionkey")
    e = n.select(F.col("n_nationkey").alias("a"), "n_regionkey").join(n.select(F.col("n_nationkey").alias("b"), "n_regionkey"), "n_regionkey").where("a <> b")
    e = e.select("a", "b", ((F.col("a") + F.col("b")) % 2 == 0).alias("bidirectional"), (F.col("a") * 100 + F.col("b")).alias("ordinal"))
    return ledger.merge_edges(e.where("a < b"), e.where("a > b"))


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders FROM customer")
def child_counts(spark, d):
    return ledger.counts_per_parent(read(spark, d, "customer").select("c_custkey"), {"orders": read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"))}, "c_custkey")


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) + user_id * 10 AS sequence FROM events")
def next_sequences(spark, d):
    """Events numbered on from each user's last sequence."""
    e = read(spark, d, "events")
    held = e.select("user_id").distinct().withColumn("sequence", F.col("user_id") * 10)
    return ledger.next_sequence(e.select("event_id", "user_id", "ts"), held, "user_id", ["ts", "event_id"]).select("event_id", "user_id", F.col("sequence").cast("long").alias("sequence"))


# ------------------------------------------------------------------ contracts and access


@query("""
WITH a AS (SELECT 'p.' || s_suppkey AS pack_id, s_nationkey AS n, s_suppkey AS k FROM supplier WHERE s_suppkey % 4 <> 0), d AS (SELECT 'p.' || s_suppkey AS pack_id, 'p.' || (s_suppkey + 1) AS dep FROM supplier WHERE s_suppkey % 3 = 0),
c AS (SELECT 'p.' || s_suppkey AS pack_id, 'p.' || (s_suppkey * 2) AS o FROM supplier WHERE s_suppkey % 5 = 0)
SELECT pack_id AS subject, 'the locked version is unavailable' AS problem FROM a WHERE n % 6 = 0 OR k % 11 = 0
UNION ALL SELECT pack_id, 'missing dependency ' || dep FROM d WHERE pack_id IN (SELECT pack_id FROM a) AND dep NOT IN (SELECT pack_id FROM a)
UNION ALL SELECT pack_id, 'conflicts with ' || o FROM c WHERE pack_id IN (SELECT pack_id FROM a) AND o IN (SELECT pack_id FROM a)""")
def ruleset_violations(spark, d):
    """Suppliers as rule packs."""
    s = read(spark, d, "supplier").select(F.concat(F.lit("p."), F.col("s_suppkey").cast("string")).alias("pack_id"), "s_suppkey", "s_nationkey")
    one, none = F.lit("1.0.0").alias("version"), F.lit(None).cast("string")
    active = s.where("s_suppkey % 4 <> 0").select("pack_id", one, F.lit("x").alias("checksum"))
    versions = s.select("pack_id", one, F.when(F.col("s_suppkey") % 11 == 0, "y").otherwise("x").alias("checksum"), F.when(F.col("s_nationkey") % 6 == 0, "draft").otherwise("installed").alias("status"), F.array().cast("array<string>").alias("editions"))
    deps = s.where("s_suppkey % 3 = 0").select("pack_id", F.concat(F.lit("p."), (F.col("s_suppkey") + 1).cast("string")).alias("depends_on"), none.alias("version"), none.alias("checksum"))
    clash = s.where("s_suppkey % 5 = 0").select("pack_id", F.concat(F.lit("p."), (F.col("s_suppkey") * 2).cast("string")).alias("conflicts_with"))
    mechanics = s.select("pack_id", F.concat("pack_id", F.lit(".m")).alias("id"), F.lit("h").alias("checksum"), none.alias("patch_target"), none.alias("patch_checksum"))
    return contracts.resolve_ruleset(active, versions, deps, clash, mechanics)[0]


@query("SELECT subject, problem FROM (SELECT p_brand AS subject, CASE WHEN NOT regexp_matches(lower(p_brand), '^[a-z0-9]+([._-][a-z0-9]+)+$') THEN 'the brand is no identifier' END AS problem, p_partkey FROM part UNION ALL SELECT p_brand, CASE WHEN p_size > 45 THEN 'too large' END, p_partkey FROM part) WHERE problem IS NOT NULL")
def part_violations(spark, d):
    """Checks of every row in one scan."""
    return contracts.violations(read(spark, d, "part"), "p_brand", {"the brand is no identifier": F.lower("p_brand").rlike(contracts.PACK_ID), "too large": F.col("p_size") <= 45})


_STEP = "['staged', 'inspected', 'extracted', 'review_required', 'reviewed', 'compiled', 'validated', 'installed', 'imported', 'activated', 'failed']"


@query(f"""SELECT event_id, f, t FROM (SELECT event_id, {_STEP}[1 + event_id % 11] AS f, {_STEP}[1 + user_id % 11] AS t FROM events)
WHERE f || '>' || t NOT IN ({", ".join(f"'{a}>{b}'" for a, bs in contracts.TRANSITIONS.items() for b in bs)})""")
def state_machine(spark, d):
    """Events as steps of import jobs."""
    states = F.array(*[F.lit(s) for s in ("staged", "inspected", "extracted", "review_required", "reviewed", "compiled", "validated", "installed", "imported", "activated", "failed")])
    own = read(spark, d, "events").select("event_id", F.element_at(states, (F.col("event_id") % 11 + 1).cast("int")).alias("f"), F.element_at(states, (F.col("user_id") % 11 + 1).cast("int")).alias("t"))
    return contracts.illegal_transitions(own, "f", "t")


@query("""
WITH r AS (SELECT event_id, event_type AS scope, CAST(user_id AS VARCHAR) AS key, sha256(CAST(CAST(floor(value) AS BIGINT) % 2 AS VARCHAR)) AS h FROM events),
old AS (SELECT event_type AS scope, CAST(user_id AS VARCHAR) AS key, sha256('0') AS h FROM events WHERE user_id % 4 = 0 GROUP BY 1, 2),
first AS (SELECT scope, key, min_by(h, event_id) AS h, min(event_id) AS event_id FROM r GROUP BY 1, 2)
SELECT r.event_id, CASE WHEN old.h IS NOT NULL THEN CASE WHEN old.h = r.h THEN 'replay' ELSE 'conflict' END WHEN r.event_id = first.event_id THEN 'new' WHEN r.h = first.h THEN 'repeat' ELSE 'conflict' END AS outcome
FROM r LEFT JOIN old USING (scope, key) JOIN first USING (scope, key)""")
def idempotency(spark, d):
    """Events as requests, keyed by type and user."""
    e = read(spark, d, "events")
    r = e.select("event_id", F.col("event_type").alias("scope"), F.col("user_id").cast("string").alias("key"), F.sha2((F.floor("value").cast("long") % 2).cast("string"), 256).alias("request_sha256"), F.col("event_id").alias("at"))
    old = e.where("user_id % 4 = 0").select(F.col("event_type").alias("scope"), F.col("user_id").cast("string").alias("key"), F.sha2(F.lit("0"), 256).alias("request_sha256")).distinct()
    return contracts.idempotent_write(r, old).select("event_id", "outcome")


@query("""
SELECT doc_id AS job_id, CASE WHEN quality = 0 AND toxic = 1 THEN 'failed' WHEN vec_id IS NULL THEN 'failed' ELSE 'deliver' END AS outcome,
  CASE WHEN vec_id IS NULL AND NOT (toxic = 1 AND quality = 0) THEN 'the entity is gone' WHEN toxic = 1 AND quality = 0 THEN 'unsupported entity type other' END AS error FROM labels LEFT JOIN embeddings ON vec_id = doc_id""")
def outbox(spark, d):
    """Labels as jobs, embeddings as entities."""
    jobs = read(spark, d, "labels").select(F.col("doc_id").alias("job_id"), F.col("doc_id").alias("entity_id"), F.when((F.col("toxic") == 1) & (F.col("quality") == 0), "other").otherwise("rule_chunk").alias("entity_type"))
    return contracts.classify_jobs(jobs, read(spark, d, "embeddings").select(F.col("vec_id").alias("entity_id"), "embedding")).select("job_id", "outcome", "error")


@query("SELECT p_brand AS pack_id, p_type AS key, CASE WHEN count(DISTINCT p_size) = 1 THEN max(p_size) END AS value, count(DISTINCT p_size) > 1 AS conflict FROM part GROUP BY 1, 2")
def option_merge(spark, d):
    """Parts as owners of options."""
    own = read(spark, d, "part").select(F.col("p_brand").alias("pack_id"), F.col("p_partkey").alias("owner"), F.col("p_type").alias("key"), F.col("p_size").alias("value"))
    return contracts.merged_options(own).drop("owners")


@query("""
SELECT c_custkey, o_orderkey, c_custkey = o_custkey AND (c_mktsegment = 'BUILDING' OR (o_orderstatus = 'F')) AS allowed FROM (SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE o_custkey + 1 END AS asker FROM orders) JOIN customer ON c_custkey = asker""")
def actor_access(spark, d):
    """Customers as principals, orders as actors; buyers of one segment are masters, closed orders are granted to their customer."""
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    asked = o.select(F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey")).otherwise(F.col("o_custkey") + 1).alias("principal_id"), F.col("o_custkey").alias("campaign_id"), F.col("o_orderkey").alias("actor_id"), F.lit(True).alias("control"), F.lit(False).alias("private"))
    asked = asked.join(c.select(F.col("c_custkey").alias("principal_id")), "principal_id", "left_semi")
    members = c.select(F.col("c_custkey").alias("campaign_id"), F.col("c_custkey").alias("principal_id"), F.when(F.col("c_mktsegment") == "BUILDING", "owner").otherwise("player").alias("role"))
    grants = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("campaign_id"), F.col("o_custkey").alias("principal_id"), F.col("o_orderkey").alias("actor_id"), F.lit(True).alias("can_control"), F.lit(False).alias("can_view_private"))
    actors = o.select(F.col("o_custkey").alias("campaign_id"), F.col("o_orderkey").alias("actor_id"))
    return access.may_use_actor(asked, members, grants, actors).select(F.col("principal_id").alias("c_custkey"), F.col("actor_id").alias("o_orderkey"), "allowed")


@query("SELECT source || '/' || (doc_id % 10) AS source_key, sha256(text) AS checksum, CASE WHEN doc_id % 3 = 0 THEN 'skip' WHEN doc_id % 3 = 1 THEN 'retire' ELSE 'add' END AS action FROM documents")
def source_plan(spark, d):
    """Documents as incoming sources; a third is there unchanged, a third in another revision."""
    docs = read(spark, d, "documents")
    incoming = docs.select(F.col("doc_id").cast("string").alias("system_id"), F.concat_ws("/", "source", (F.col("doc_id") % 10).cast("string")).alias("source_key"), "text")
    held = docs.where("doc_id % 3 < 2").select(F.col("doc_id").cast("string").alias("system_id"), F.concat_ws("/", "source", (F.col("doc_id") % 10).cast("string")).alias("source_key"), F.when(F.col("doc_id") % 3 == 0, F.sha2("text", 256)).otherwise("old").alias("checksum"), F.lit(True).alias("active"))
    return ingestion.plan_sources(incoming, held).select("source_key", "checksum", "action")


@query("""
WITH n AS (SELECT o_custkey, max(o_orderkey) AS revision, max_by(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1)
SELECT c_custkey AS o_custkey, CASE WHEN revision IS NULL THEN 'missing' WHEN c_nationkey % 2 = 0 THEN 'applied' ELSE 'conflict' END AS outcome,
  CASE WHEN c_nationkey % 2 = 0 THEN revision + 1 END AS revision, CASE WHEN c_nationkey % 2 = 0 AND revision IS NOT NULL THEN CASE WHEN c_nationkey % 3 = 0 THEN c_mktsegment ELSE p END END AS o_orderpriority FROM customer LEFT JOIN n ON o_custkey = c_custkey""")
def conditional_updates(spark, d):
    """Orders as revisions of customers; every other nation expects a revision that isn't there."""
    held = read(spark, d, "orders").select("o_custkey", F.col("o_orderkey").alias("revision"), "o_orderpriority")
    change = read(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.lit(1).alias("ordinal"), F.when(F.col("c_nationkey") % 2 == 1, -1).alias("expected"), F.when(F.col("c_nationkey") % 3 == 0, F.col("c_mktsegment")).alias("o_orderpriority"))
    return records.compare_and_swap(held, change, "o_custkey", ["o_orderpriority"]).drop("ordinal")


@query("""
WITH c AS (SELECT doc_id, source, 0 AS n, substr(text, 1, length(text) // 2) AS own FROM documents UNION ALL SELECT doc_id, source, 1, substr(text, length(text) // 2 + 1) FROM documents)
SELECT doc_id, sha256(own) AS content_sha256, source || '/' || doc_id || '/section-0/chunk-' || n || '-' || substr(sha256(own), 1, 16) AS chunk_key FROM c""")
def source_bundles(spark, d):
    """Each document as a source bundle of two chunks, its halves."""
    docs = read(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source_key"), "text")
    half, whole = F.floor(F.length("text") / 2).cast("int"), F.length("text")
    parts = F.array(F.struct(F.lit(0).alias("ordinal"), F.lit(0).alias("start"), half.alias("end")), F.struct(F.lit(1).alias("ordinal"), half.alias("start"), whole.alias("end")))
    chunks = docs.select("doc_id", "source_key", F.lit(0).alias("section"), F.inline(parts))
    return packages.bundle_chunks(docs.drop("doc_id"), chunks).select("doc_id", "content_sha256", "chunk_key")


@query()
def source_bundles_whole(spark, d):
    """Each document as a source bundle: the chunks of its whole text, by section and window.

    The first chunk of a section begins where the section before it ends, so that headings are hashed too; a null text is one empty chunk.
    """
    docs = read(spark, d, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("source_key"), F.coalesce("text", F.lit("")).alias("text"))
    before = F.lag("end", 1, 0).over(Window.partitionBy("source_key").orderBy("section", "ordinal"))
    start = F.when(F.col("ordinal") == 0, before).otherwise(F.col("start")).alias("start")
    chunks = chunking.parse_chunks(docs, "source_key", "text").select("source_key", "section", "ordinal", start, "end")
    return packages.bundle_chunks(docs, chunks)


# ------------------------------------------------------------------ listings
# Rules: orders stand in for chunks, customers for sections, nations for sources.  Modules: orders for chunks,
# customers for scenes, nations for chapters, regions for modules.


def _rules(spark, d):
    chunks = read(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("section_id"), F.col("o_orderpriority").alias("content"), F.col("o_orderstatus").alias("ordinal"))
    sections = read(spark, d, "customer").select(F.col("c_custkey").alias("section_id"), F.col("c_nationkey").alias("source_id"), F.col("c_name").alias("section_title"))
    nations = read(spark, d, "nation").select(F.col("n_nationkey").alias("source_id"), F.col("n_name").alias("title"), F.col("n_regionkey").cast("string").alias("system_id"), F.when(F.col("n_nationkey") % 2 == 0, "a").otherwise("b").alias("edition"), (F.col("n_nationkey") % 3 != 0).alias("active"))
    return chunks, sections, nations


def _modules(spark, d):
    chunks = read(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_custkey").alias("scene_id"), F.col("o_orderpriority").alias("content"))
    scenes = read(spark, d, "customer").select(F.col("c_custkey").alias("scene_id"), F.col("c_nationkey").alias("chapter_id"), F.col("c_name").alias("scene_title"))
    chapters = read(spark, d, "nation").select(F.col("n_nationkey").alias("chapter_id"), F.col("n_regionkey").alias("module_id"), F.col("n_name").alias("chapter_title"))
    return chunks, scenes, chapters, read(spark, d, "region").select(F.col("r_regionkey").alias("module_id"), F.col("r_name").alias("module_title"))


@query("SELECT n_nationkey AS source_id, n_name AS title FROM nation WHERE n_regionkey = 1 AND n_nationkey % 2 = 0 AND n_nationkey % 3 <> 0")
def rule_sources(spark, d):
    """Active sources of one system and edition."""
    return catalog.sources(_rules(spark, d)[2], system_id="1", edition="a").select("source_id", "title")


@query("SELECT o_orderkey AS chunk_id, c_custkey AS section_id, c_name AS section_title, o_orderstatus AS ordinal FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE n_nationkey = 7")
def rule_source_chunks(spark, d):
    """All chunks of one source, with their sections."""
    return catalog.source_chunks(*_rules(spark, d), 7).select("chunk_id", "section_id", "section_title", "ordinal")


@query("SELECT DISTINCT o_orderkey AS chunk_id, c_name AS section_title, n_name AS title, n_regionkey::VARCHAR AS system_id FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE l_returnflag = 'R'")
def rule_expand(spark, d):
    """Section and source of every chunk that a returned line asks for."""
    asked = read(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("chunk_id"))
    return catalog.expand_rule(*_rules(spark, d), asked).select("chunk_id", "section_title", "title", "system_id")


@query("""
SELECT l_orderkey + CASE WHEN l_linenumber = 2 THEN 100000000 ELSE 0 END AS chunk_id, l_linenumber, coalesce(c_nationkey, -1) AS source_id,
  CASE WHEN c_nationkey IS NULL THEN 'unknown' WHEN l_linenumber = 1 OR l_suppkey % 25 = c_nationkey THEN 'bound' ELSE 'other source' END AS outcome
FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey + CASE WHEN l_linenumber = 2 THEN 100000000 ELSE 0 END LEFT JOIN customer ON c_custkey = o_custkey""")
def rule_citations(spark, d):
    """Each line cites its order: the first for any source, the second an order that isn't there, the others for the nation of their supplier's number."""
    line = F.col("l_linenumber")
    asked = read(spark, d, "lineitem").select((F.col("l_orderkey") + F.when(line == 2, 100000000).otherwise(0)).alias("chunk_id"), "l_linenumber", F.when(line != 1, F.col("l_suppkey") % 25).alias("asked_source"))
    chunks, sections, _ = _rules(spark, d)
    return catalog.citations(asked, chunks, sections).select("chunk_id", "l_linenumber", F.coalesce("source_id", F.lit(-1)).alias("source_id"), "outcome")


@query("SELECT o_orderkey AS chunk_id, c_name AS scene_title, n_name AS chapter_title, r_name AS module_title, 'module/' || r_regionkey || '/' || c_custkey || '/' || o_orderkey AS source_ref, sha256(o_orderpriority) AS content_sha256 FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def module_expand(spark, d):
    """Each chunk with scene, chapter, module and an exact reference."""
    return catalog.expand_module(*_modules(spark, d)).select("chunk_id", "scene_title", "chapter_title", "module_title", "source_ref", "content_sha256")


@query("SELECT c_custkey AS scene_id, c_name AS scene_title, n_name AS chapter_title, r_name AS module_title FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def scene_listing(spark, d):
    return catalog.scene_index(*_modules(spark, d)[1:]).select("scene_id", "scene_title", "chapter_title", "module_title")


@query("SELECT o_orderkey AS progress_id, o_orderstatus AS status, c_name AS scene_title, r_name AS module_title FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE o_orderstatus <> 'P'")
def progress_listing(spark, d):
    """Orders as progress in their customers' scenes."""
    progress = read(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("progress_id"), F.col("o_custkey").alias("scene_id"), F.col("o_orderstatus").alias("status"))
    return catalog.progress_index(progress, *_modules(spark, d)[1:]).select("progress_id", "status", "scene_title", "module_title")


@query("SELECT s_suppkey AS character_id, s_name AS name, l_orderkey AS scene_id, l_linenumber FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_linestatus = 'O'")
def binding_listing(spark, d):
    """Lines bind suppliers, as characters, to orders, as scenes; one kind of them."""
    bindings = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("character_id"), F.col("l_orderkey").alias("scene_id"), "l_linenumber", F.col("l_linestatus").alias("binding_kind"))
    characters = read(spark, d, "supplier").select(F.col("s_suppkey").alias("character_id"), F.col("s_name").alias("name"))
    return catalog.actor_bindings(bindings, characters, kind="O").select("character_id", "name", "scene_id", "l_linenumber")


@query("SELECT event_id AS receipt_id, user_id AS group_id, c_name AS author FROM events JOIN customer ON c_custkey = user_id WHERE event_type = 'purchase' AND c_nationkey % 2 = 0 ORDER BY ts DESC, event_id DESC LIMIT 50")
def receipt_listing(spark, d):
    """The newest purchases as receipts of one mechanic, users as mutation groups, on one branch."""
    rows = read(spark, d, "events").select(F.col("event_id").alias("receipt_id"), F.col("user_id").alias("group_id"), F.col("event_type").alias("mechanic_id"), F.col("ts").alias("created_at"))
    groups = read(spark, d, "customer").select(F.col("c_custkey").alias("group_id"), F.col("c_name").alias("author"), (F.col("c_nationkey") % 2).alias("branch_id"))
    return catalog.receipts(rows, groups, branch_id=0, mechanic_id="purchase", limit=50).select("receipt_id", "group_id", "author")


@query("SELECT doc_id FROM documents WHERE lang = 'de' AND source IN ('src1', 'src2', 'src3')")
def search_scope(spark, d):
    """What a search in one language and three sources looks at."""
    own = read(spark, d, "documents").withColumnsRenamed({"lang": "locale", "source": "source_key"})
    return catalog.searchable(own, locale="de", source_keys=["src1", "src2", "src3"]).select("doc_id")


# ------------------------------------------------------------------ more of the ledger, access and contracts
# Customers stand in for campaigns' members, orders for their grants and revisions, users of events for actors.


@query("SELECT event_id, user_id FROM events JOIN customer ON c_custkey = user_id WHERE c_acctbal >= 0 AND event_type <> 'view'")
def actor_events(spark, d):
    """Events that one actor knows: it takes part for every customer, is no witness of those in debt, and only looks on at views."""
    e = read(spark, d, "events")
    own = read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_acctbal")
    role = F.when(F.col("event_type") == "view", "onlooker").when(F.col("c_acctbal") >= 0, "witness").otherwise("target")
    part = e.join(own, "user_id").select("event_id", F.lit("me").alias("actor_id"), role.alias("role"))
    return ledger.for_actor(e, part, "me", ["witness", "actor"]).select("event_id", "user_id")


@query("""
SELECT DISTINCT event_id FROM events WHERE event_type = 'view' AND user_id % 5 = 0
UNION SELECT event_id FROM events WHERE event_type = 'error' AND user_id % 7 = 0""")
def known_events(spark, d):
    """Views cited by visible knowledge, and errors taken part in."""
    e = read(spark, d, "events")
    knowledge = e.where("event_type = 'view'").select(F.when(F.col("user_id") % 5 == 0, "me").otherwise("you").alias("actor_id"), F.col("event_id").alias("source_event_id"), F.lit("owner").alias("disclosure_scope"))
    part = e.where("event_type = 'error'").select("event_id", F.when(F.col("user_id") % 7 == 0, "me").otherwise("you").alias("actor_id"))
    return ledger.actor_known_events(knowledge, part, "me")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 500")
def revision_history(spark, d):
    """The newest revisions; more than the bound are asked for."""
    e = read(spark, d, "events").select("event_id", "user_id", "event_type", F.col("event_id").alias("sequence"))
    return ledger.history(e, 10_000).drop("sequence")


@query("SELECT 'b:' || event_id AS id, CASE WHEN lag(event_id) OVER (ORDER BY event_id) IS NULL THEN '-' ELSE 'b:' || lag(event_id) OVER (ORDER BY event_id) END AS parent_id, 1000 + row_number() OVER (ORDER BY event_id) AS sequence FROM events")
def revision_copies(spark, d):
    """All events, each the child of the one before, copied to a new branch."""
    e = read(spark, d, "events").select(F.col("event_id").cast("string").alias("id"), F.col("event_id").alias("sequence"))
    ids = ledger.numbered(e, ["sequence", "id"], "n")
    parents = ids.select(F.col("id").alias("parent_id"), (F.col("n") + 1).alias("n"))
    out = ledger.copy_revisions(ids.join(parents, "n", "left").drop("n"), "b", 1000)
    return out.select("id", F.coalesce("parent_id", F.lit("-")).alias("parent_id"), "sequence")


@query("""
SELECT o_custkey AS snapshot_id, 'orders' AS kind, o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'unbound' ELSE 'not in payload' END AS problem FROM orders WHERE o_orderstatus IN ('F', 'P')""")
def payload_bindings(spark, d):
    """Snapshots whose payload names finished orders that aren't bound, and whose bindings name pending ones that it doesn't."""
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("snapshot_id"), F.col("o_orderkey").alias("id"), "o_orderstatus")
    return ledger.snapshot_violations(o.where("o_orderstatus <> 'P'"), o.where("o_orderstatus <> 'F'"), "orders")


@query("""
SELECT 'party' AS scope_id, c_custkey AS old_scene_id, CASE WHEN c_nationkey < 20 THEN c_custkey + 1000000 ELSE -1 END AS new_scene_id, CASE WHEN c_nationkey < 20 THEN '-' ELSE 'unmapped' END AS error FROM customer""")
def progress_migration(spark, d):
    """Progress in every scene, moved to a revision that lacks the scenes of some chapters."""
    c = read(spark, d, "customer")
    progress = c.select(F.col("c_custkey").alias("scene_id"), F.lit("party").alias("scope_id"))
    old = c.select(F.col("c_custkey").alias("scene_id"), F.col("c_name").alias("stable_key"))
    new = c.where("c_nationkey < 20").select((F.col("c_custkey") + 1000000).alias("scene_id"), F.col("c_name").alias("stable_key"))
    out = ledger.migrate_progress(progress, old, new)
    return out.select("scope_id", "old_scene_id", F.coalesce(F.col("new_scene_id").cast("long"), F.lit(-1)).alias("new_scene_id"), F.coalesce("error", F.lit("-")).alias("error"))


@query("SELECT DISTINCT o_custkey AS principal_id, c_nationkey AS campaign_id, c_nationkey % 4 = 1 AS allowed FROM orders JOIN customer ON c_custkey = o_custkey")
def campaign_access(spark, d):
    """Customers with orders ask for their nation's campaign; members of some are mere spectators."""
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("principal_id"), F.col("c_nationkey").alias("campaign_id"))
    asked = read(spark, d, "orders").select(F.col("o_custkey").alias("principal_id")).distinct().join(c, "principal_id")
    members = c.withColumn("role", F.when(F.col("campaign_id") % 4 == 1, "player").otherwise("spectator"))
    return access.may_see_campaign(asked, members, ("owner", "player")).select("principal_id", "campaign_id", "allowed")


@query("SELECT c_custkey AS principal_id, c_nationkey % 2 = 0 AS can_control, c_nationkey % 3 = 0 AS can_view_private FROM customer WHERE c_nationkey % 5 <> 0")
def grant_changes(spark, d):
    """Grants of control, changed to let some view private parts, and revoked for every fifth nation."""
    c = read(spark, d, "customer").select(F.lit(1).alias("campaign_id"), F.col("c_custkey").alias("principal_id"), F.lit("hero").alias("actor_id"), "c_nationkey")
    held = c.select("campaign_id", "principal_id", "actor_id", (F.col("c_nationkey") % 2 == 0).alias("can_control"), F.lit(False).alias("can_view_private"))
    change = c.where("c_nationkey % 3 = 0").select("campaign_id", "principal_id", "actor_id", F.lit(None).cast("boolean").alias("can_control"), F.lit(True).alias("can_view_private"))
    _, grants = access.revoke(c.select("campaign_id", "principal_id"), access.upsert_grants(held, change), c.where("c_nationkey % 5 = 0").select("campaign_id", "principal_id"))
    return grants.select("principal_id", "can_control", "can_view_private")


@query("SELECT sha256(o_orderpriority) AS address, 'stored' AS state FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY ALL UNION ALL SELECT DISTINCT sha256(o_orderpriority), 'new' FROM orders WHERE o_orderpriority NOT LIKE '1%' UNION ALL SELECT sha256('gone'), 'unreferenced'")
def stored_content(spark, d):
    """Priorities as content: one is stored, the others are to be; one that is stored is no longer referred to."""
    values = read(spark, d, "orders").select(F.sha2("o_orderpriority", 256).alias("address"), "o_orderpriority")
    stored = values.where("o_orderpriority like '1%'").select("address").distinct().unionByName(spark.range(1).select(F.sha2(F.lit("gone"), 256).alias("address")))
    new = contracts.persist_by_content(values, stored, "address").select("address", F.lit("new").alias("state"))
    free = contracts.unreferenced(stored, values, "address")
    kept = stored.join(free, "address", "left_anti").select("address", F.lit("stored").alias("state"))
    return kept.unionByName(new).unionByName(free.select("address", F.lit("unreferenced").alias("state")))


@query("SELECT p_partkey AS id, CASE WHEN p_size % 4 = 0 THEN 'missing' WHEN p_size % 4 = 1 THEN 'match' WHEN p_size % 4 = 2 THEN 'unverified' ELSE 'conflict' END AS status FROM part")
def component_states(spark, d):
    """Parts as components: missing, installed alike, without a checksum, or installed with another."""
    p = read(spark, d, "part").select(F.lit("part").alias("kind"), F.col("p_partkey").alias("id"), F.lit("1.0.0").alias("version"), "p_brand", (F.col("p_size") % 4).alias("r"))
    wanted = p.select("kind", "id", "version", F.when(F.col("r") != 2, F.col("p_brand")).alias("checksum"))
    there = p.where("r <> 0").select("kind", "id", "version", F.when(F.col("r") == 3, "other").otherwise(F.col("p_brand")).alias("checksum"))
    return contracts.component_status(wanted, there, there.where("false")).select("id", "status")


@query("SELECT DISTINCT l_suppkey AS addon_id FROM lineitem WHERE l_returnflag IN ('A', 'R')")
def addon_conflicts(spark, d):
    """Suppliers as add-ons that conflict with one: it names those of all lines returned, those of all lines accepted name it."""
    lines = read(spark, d, "lineitem")
    there = lines.where("l_returnflag = 'R'").select(F.lit(-1).cast("long").alias("addon_id"), F.col("l_suppkey").alias("conflicts_with"))
    back = lines.where("l_returnflag = 'A'").select(F.col("l_suppkey").alias("addon_id"), F.lit(-1).cast("long").alias("conflicts_with"))
    active = read(spark, d, "supplier").select(F.col("s_suppkey").alias("addon_id"))
    return contracts.symmetric_conflicts(active, there.unionByName(back), -1)


@query("SELECT doc_id, trim(regexp_replace(lower(replace(text, 'ß', 'ss')), '[^a-z0-9]+', '-', 'g'), '-') AS slug, greatest(1, length(text) // 4) AS tokens, coalesce(list_distinct(list_transform(regexp_extract_all(source, '[A-Za-z][A-Za-z0-9''-]{2,}'), lambda w: lower(w)))[1], '-') AS keyword FROM documents")
def document_slugs(spark, d):
    """Slug, estimated tokens and first keyword of the source of each document."""
    own = read(spark, d, "documents")
    return own.select("doc_id", text.ascii_slug(F.col("text")).alias("slug"), text.estimated_tokens(F.col("text")).alias("tokens"), F.coalesce(F.get(text.keywords(F.col("source")), F.lit(0)), F.lit("-")).alias("keyword"))


@query("""
SELECT doc_id, CASE WHEN (doc_id * 37) % (length(text) + 35) >= length(text) // 2 + 18 THEN 4 ELSE 3 END AS page FROM documents""")
def page_lookup(spark, d):
    """Documents with two page markers put in: the page of some offset of each."""
    own = read(spark, d, "documents").select("doc_id", F.floor(F.length("text") / 2).cast("int").alias("h"), "text")
    marked = F.concat(F.lit("<!-- page: 3 -->\n"), F.substring("text", F.lit(1), F.col("h")), F.lit("\n<!-- page: 4 -->\n"), F.expr("substring(text, h + 1)"))
    own = own.select("doc_id", marked.alias("text")).withColumn("marks", text.page_markers(F.col("text")))
    return own.select("doc_id", text.page_for_offset(F.col("marks"), F.col("doc_id") * 37 % F.length("text")).alias("page"))


@query("SELECT doc_id, sha256(trim(regexp_replace(text, '\\r\\n|\\r', '\n', 'g'), ' ')) AS digest FROM documents")
def marker_removal(spark, d):
    """Page markers put before and after each document are taken out again: the digest of what is left."""
    marked = F.concat(F.lit("<!-- page: 1 -->\n"), F.col("text"), F.lit("\n  <!-- page: 2 -->  "))
    return read(spark, d, "documents").select("doc_id", F.sha2(text.strip_page_markers(marked), 256).alias("digest"))


# ------------------------------------------------------------------ facts, beliefs and their evidence
# Customers stand in for facts that are there, orders for new ones; events cite and are cited.


@query("""
WITH n AS (SELECT o_orderkey AS ordinal, o_custkey, 'b' || (o_orderkey % 3) AS branch_id, c_nationkey AS c, CASE WHEN o_orderkey % 7 = 0 THEN 'rumour' WHEN o_orderkey % 11 = 0 THEN 'bad' ELSE 'fact' END AS kind FROM orders JOIN customer ON c_custkey = o_custkey),
f AS (SELECT *, min(ordinal) FILTER (kind <> 'bad') OVER k AS first, min_by(kind, ordinal) FILTER (kind <> 'bad') OVER k AS one FROM n WINDOW k AS (PARTITION BY o_custkey)),
s AS (SELECT *, kind <> 'bad' AND kind = CASE WHEN c % 2 = 0 THEN 'fact' ELSE one END AS same, c % 4 = 0 AND branch_id = 'b0' AS head FROM f),
t AS (SELECT *, min(ordinal) FILTER (same AND NOT head) OVER (PARTITION BY o_custkey, branch_id) AS taken FROM s),
u AS (SELECT *, CASE WHEN kind = 'bad' THEN 'invalid' WHEN NOT same THEN 'identity' WHEN head OR ordinal <> taken THEN 'exists' WHEN c % 2 = 1 AND ordinal = first THEN 'created' ELSE 'headed' END AS outcome FROM t)
SELECT ordinal, branch_id, outcome, CASE WHEN outcome NOT IN ('created', 'headed') THEN '-' WHEN c % 2 = 0 THEN 'm' || o_custkey ELSE 'n' || first END AS memory_id FROM u""")
def fact_additions(spark, d):
    """Orders as new facts under their customer's key; customers of every other nation are facts already."""
    c, text_of = read(spark, d, "customer"), lambda p, col: F.concat(F.lit(p), F.col(col).cast("string"))
    none = {x: F.lit("") for x in ("subject", "subject_ref", "predicate")}
    held = c.where("c_nationkey % 2 = 0").select(F.lit("c").alias("campaign_id"), text_of("k", "c_custkey").alias("fact_key"), text_of("m", "c_custkey").alias("memory_id"), F.lit("fact").alias("kind")).withColumns(none)
    heads = c.where("c_nationkey % 4 = 0").select(F.lit("b0").alias("branch_id"), text_of("m", "c_custkey").alias("memory_id"))
    k, bad = F.col("o_orderkey"), (F.col("o_orderkey") % 11 == 0) & (F.col("o_orderkey") % 7 != 0)
    new = read(spark, d, "orders").join(c, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(k.alias("ordinal"), F.lit("c").alias("campaign_id"), F.concat(F.lit("b"), (k % 3).cast("string")).alias("branch_id"), text_of("k", "o_custkey").alias("fact_key"), text_of("n", "o_orderkey").alias("memory_id"),
        F.when(k % 7 == 0, "rumour").when(bad, "actor_state").otherwise("fact").alias("kind"), F.lit("").alias("subject"), F.when(bad, "faction:x").otherwise("").alias("subject_ref"), F.lit("").alias("predicate"))
    return facts.add_facts(held, heads, new).select("ordinal", "branch_id", "outcome", F.coalesce("memory_id", F.lit("-")).alias("memory_id"))


@query("SELECT c_custkey AS fact_key, concat_ws(',', CASE WHEN c_custkey % 2 = 0 THEN 'kind' END, CASE WHEN c_custkey % 3 = 0 THEN 'predicate' END) AS fields FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def fact_conflicts(spark, d):
    """Customers proposed again, some with another kind or predicate."""
    c, k = read(spark, d, "customer"), F.col("c_custkey")
    own = c.select(F.col("c_nationkey").alias("campaign_id"), k.alias("fact_key"), F.col("c_mktsegment").alias("kind"), F.col("c_name").alias("subject"), F.lit(None).cast("string").alias("subject_ref"), F.lit("is").alias("predicate"))
    proposed = own.withColumns({"kind": F.when(F.col("fact_key") % 2 == 0, "x").otherwise(F.col("kind")), "subject_ref": F.lit(""), "predicate": F.when(F.col("fact_key") % 3 == 0, "x").otherwise(F.col("predicate"))})
    return facts.identity_conflicts(own, proposed).select("fact_key", F.array_join("fields", ",").alias("fields"))


@query("""
WITH k AS (SELECT event_id, user_id, 'key' || (event_id % 5) AS knowledge_key, CASE WHEN event_id % 13 = 0 THEN 'event' WHEN user_id % 10 = 0 AND event_id % 5 = 1 THEN 'held' END AS why FROM events)
SELECT event_id, knowledge_key, CASE WHEN why = 'event' THEN 'event' WHEN why = 'held' THEN 'exists' WHEN event_id = min(event_id) FILTER (why IS NULL) OVER (PARTITION BY user_id, knowledge_key) THEN 'created' ELSE 'exists' END AS outcome FROM k""")
def knowledge_additions(spark, d):
    """Events as beliefs of their user that cite the event: every thirteenth is of another branch, every second one is bound to a snapshot."""
    e, k = read(spark, d, "events"), F.col("event_id")
    known = e.select(k, F.lit("c").alias("campaign_id"), F.when(k % 13 == 0, "x").otherwise("b").alias("branch_id"), F.when(k % 2 == 0, "s").alias("committed_snapshot_id"))
    bound = known.where("event_id % 2 = 0 and event_id % 13 <> 0").select(F.lit("s").alias("snapshot_id"), "event_id")
    new = e.select(k.alias("ordinal"), F.lit("c").alias("campaign_id"), F.lit("b").alias("branch_id"), F.col("user_id").alias("actor_id"), F.concat(F.lit(" key"), (k % 5).cast("string")).alias("knowledge_key"), k, F.lit("s").alias("head_snapshot_id"))
    held = read(spark, d, "customer").where("c_custkey % 10 = 0").select(F.lit("b").alias("branch_id"), F.col("c_custkey").alias("actor_id"), F.lit("key1").alias("knowledge_key"))
    held = held.unionByName(e.where("user_id % 10 = 0").select(F.lit("b").alias("branch_id"), F.col("user_id").alias("actor_id"), F.lit("key1").alias("knowledge_key")))
    return facts.add_knowledge(held, facts.citable(new, known, bound)).select("event_id", F.trim("knowledge_key").alias("knowledge_key"), "outcome")


@query("""
SELECT p_partkey::VARCHAR AS subject, problem FROM part, (VALUES ('an anchor is for the master only', 2), ('the subject is no reference', 3), ('the purpose needs 1 to 200 characters', 5), ('a related reference is invalid', 7), ('an anchor needs 1 to 16 bindings', 11), ('too many related references', 13)) v(problem, m)
WHERE p_partkey % m = 0 AND NOT (m = 7 AND p_partkey % 13 = 0)""")
def anchor_contract(spark, d):
    """Parts as anchors, each kind of fault in some."""
    k, ref = F.col("p_partkey"), lambda x: F.concat(F.lit("item:"), x.cast("string"))
    related = F.when(k % 13 == 0, F.transform(F.sequence(F.lit(1), F.lit(64)), lambda i: F.concat(F.lit("scene:"), i.cast("string")))).when(k % 7 == 0, F.array(F.lit("no reference"))).otherwise(F.array(ref(k), F.lit(" scene:1 ")))
    own = read(spark, d, "part").select(k.alias("anchor_id"), F.lit(1).alias("schema_version"), F.when(k % 5 != 0, F.col("p_name")).alias("purpose"), F.when(k % 3 == 0, "part").otherwise(ref(k)).alias("subject_ref"), F.lit(" ").alias("predicate"), F.when(k % 2 == 0, "party").otherwise("dm").alias("disclosure_scope"), related.alias("related_refs"), F.when(k % 11 == 0, 17).otherwise(1).alias("bindings"))
    return facts.anchor_problems(own)


@query("""
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'unknown' WHEN doc_id % 5 = 1 THEN 'other campaign' WHEN doc_id % 5 = 2 THEN 'moved' WHEN doc_id % 5 = 3 THEN 'absent' ELSE 'bound' END AS outcome FROM documents""")
def binding_resolution(spark, d):
    """Documents as chunks, bound by their own text, in capitals and with other blanks; every kind of mismatch in some."""
    k = F.col("doc_id")
    own = read(spark, d, "documents").select(k, F.coalesce("text", F.lit("")).alias("content"))
    place = {"module_id": F.lit("m"), "scene_id": F.lit("s"), "page_start": F.lit(1), "page_end": F.lit(2), "heading_path": F.array(F.lit("A"), F.lit("a "), F.lit("B"))}
    chunks = own.where(k % 5 != 0).select(k.alias("chunk_id"), F.when(k % 5 == 1, "x").otherwise("c").alias("campaign_id"), "content", *[v.alias(n) for n, v in place.items()], F.sha2("content", 256).alias("content_sha256"))
    place = place | {"page_end": F.when(k % 5 == 2, 3).otherwise(2), "heading_path": F.array(F.lit("A"), F.lit("B"))}
    excerpt = F.when(k % 5 == 3, F.concat("content", F.lit(" and more"))).otherwise(F.regexp_replace(F.upper(F.col("content")), " ", "\n"))
    asked = own.select(k, k.alias("chunk_id"), F.lit("c").alias("campaign_id"), *[v.alias(n) for n, v in place.items()], F.upper(F.sha2("content", 256)).alias("content_sha256"), excerpt.alias("source_excerpt"))
    return facts.resolve_bindings(asked, chunks).select("doc_id", "outcome")


@query("WITH l AS (SELECT l_orderkey, l_suppkey FROM lineitem GROUP BY ALL) SELECT l_orderkey AS recap_id, coalesce(string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_suppkey) FILTER (l_suppkey % 3 = 0), '') AS unknown FROM l GROUP BY 1")
def recap_presentations(spark, d):
    """Orders as recaps with their lines' suppliers as cited events; a third of the suppliers isn't evidence."""
    own = read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("recap_id")).agg(F.collect_set("l_suppkey").alias("evidence_event_ids"))
    held = own.withColumn("evidence_event_ids", F.filter("evidence_event_ids", lambda x: x % 3 != 0))
    return facts.presentable(held, own).select("recap_id", F.array_join(F.transform("unknown", lambda x: x.cast("string")), ",").alias("unknown"))


# ------------------------------------------------------------------ rule packs, add-ons and profiles
# Parts stand in for versions and components, customers for campaigns, orders for requests.


@query("""
SELECT p_partkey, CASE WHEN p_size % 6 = 0 THEN 'unstored' WHEN p_size % 6 = 1 THEN 'other system' WHEN p_size % 6 = 2 THEN 'kept' WHEN p_size % 6 = 3 THEN 'immutable' WHEN p_size % 6 = 4 THEN 'rejected' ELSE 'validated' END AS outcome FROM part""")
def pack_drafts(spark, d):
    """Parts as drafts against packs and versions that are there."""
    r = F.col("p_size") % 6
    own = read(spark, d, "part").select("p_partkey", F.concat(F.lit("pack."), F.col("p_partkey").cast("string")).alias("pack_id"), F.when(r == 0, "1").otherwise("1.0.0").alias("version"), F.lit("s").alias("system_id"), F.col("p_brand").alias("checksum"), F.when(r == 4, 2).alias("problems"), r.alias("r"))
    packs = own.where("r in (1, 2, 3)").select("pack_id", F.when(F.col("r") == 1, "t").otherwise("s").alias("system_id"))
    versions = own.where("r in (2, 3, 4)").select("pack_id", "version", F.when(F.col("r") == 4, "validated").otherwise("installed").alias("status"), F.when(F.col("r") == 2, F.col("checksum")).otherwise("x").alias("checksum"))
    return rulepacks.save_drafts(packs, versions, own.drop("r")).select("p_partkey", "outcome")


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'missing' WHEN p_size % 4 = 1 THEN 'refused' ELSE 'installed' END AS outcome FROM part")
def pack_installs(spark, d):
    own = read(spark, d, "part").select("p_partkey", F.col("p_partkey").alias("pack_id"), F.lit("1.0.0").alias("version"), (F.col("p_size") % 4).alias("r"))
    versions = own.where("r <> 0").select("pack_id", "version", F.element_at(F.array(F.lit("rejected"), F.lit("validated"), F.lit("installed")), F.col("r").cast("int")).alias("status"))
    return rulepacks.install_versions(versions, own).select("p_partkey", "outcome")


def _pack_requests(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("campaign_id"), F.when(F.col("c_nationkey") % 5 == 0, "t").otherwise("s").alias("system_id"), F.when(F.col("c_nationkey") % 3 == 0, "e2").otherwise("e1").alias("edition"), (F.col("c_nationkey") % 7 == 0).alias("locked"))
    asked = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("campaign_id"), F.lit("b").alias("branch_id"), (F.col("o_orderkey") % 100).alias("pack_id"), F.lit("1.0.0").alias("version"))
    packs = spark.range(100).select(F.col("id").alias("pack_id"), F.lit("1.0.0").alias("version"), F.lit("s").alias("system_id"), F.when(F.col("id") % 10 == 0, "validated").otherwise("installed").alias("status"), F.concat(F.lit("sum"), F.col("id").cast("string")).alias("checksum"), F.when(F.col("id") % 2 == 0, F.array(F.lit("e1"))).alias("editions"))
    return c, asked, packs


_PACK_REFUSAL = "CASE WHEN c_custkey IS NULL THEN 'missing' WHEN c_nationkey % 7 = 0 THEN 'locked' WHEN o_orderkey % 10 = 0 THEN 'not installed' WHEN c_nationkey % 5 = 0 THEN 'other system' WHEN o_orderkey % 2 = 0 AND c_nationkey % 3 = 0 THEN 'other edition'"


@query(f"WITH a AS (SELECT o_orderkey, {_PACK_REFUSAL} WHEN o_orderkey % 100 = 7 AND c_nationkey % 2 = 0 THEN 'owned' ELSE 'applied' END AS outcome FROM orders LEFT JOIN customer ON c_custkey = o_custkey) SELECT o_orderkey, outcome, CASE WHEN outcome = 'applied' THEN 'sum' || (o_orderkey % 100) ELSE '-' END AS checksum FROM a")
def pack_activations(spark, d):
    """Orders ask for a pack on their customer's campaign; one pack belongs to an add-on in half of the nations."""
    c, asked, packs = _pack_requests(spark, d)
    held = read(spark, d, "customer").where("c_nationkey % 2 = 0").select(F.col("c_custkey").alias("campaign_id"), F.lit("b").alias("branch_id"), F.lit(7).cast("long").alias("pack_id"), F.array(F.lit("addon")).alias("owners"))
    return rulepacks.set_activations(asked, c, packs, held).select("o_orderkey", "outcome", F.coalesce("checksum", F.lit("-")).alias("checksum"))


@query("SELECT c_custkey, c_nationkey FROM customer WHERE NOT (c_nationkey % 3 = 0 AND c_nationkey % 2 = 1) AND c_nationkey % 5 <> 0")
def pack_removals(spark, d):
    """Locks that stay where every third nation asks to remove its own; some belong to add-ons, some nations have none."""
    c = read(spark, d, "customer").select("c_custkey", "c_nationkey", F.col("c_custkey").alias("campaign_id"), F.lit("b").alias("branch_id"), F.lit("p").alias("pack_id"))
    held = c.where("c_nationkey % 5 <> 0").withColumn("owners", F.when(F.col("c_nationkey") % 2 == 0, F.array(F.lit("addon"))))
    return rulepacks.remove_activations(held, c.where("c_nationkey % 3 = 0"))[0].select("c_custkey", "c_nationkey")


@query(f"SELECT o_orderkey, {_PACK_REFUSAL} WHEN o_orderkey % 100 IN (13, 14) THEN 'components wanting' WHEN o_orderkey % 100 IN (21, 23) AND c_nationkey % 2 = 0 THEN 'conflict' ELSE 'ready' END AS outcome FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def addon_requirements(spark, d):
    """Orders ask whether an add-on may be made active; one active add-on conflicts with two, named by either side."""
    c, asked, packs = _pack_requests(spark, d)
    rename = {"pack_id": "addon_id"}
    wanting = spark.range(13, 15).select(F.col("id").alias("addon_id"), F.lit("1.0.0").alias("version"), F.lit(1).alias("wanting"))
    conflicts = spark.range(2).select(F.when(F.col("id") == 0, 21).otherwise(99).cast("long").alias("addon_id"), F.when(F.col("id") == 0, 99).otherwise(23).cast("long").alias("conflicts_with"))
    active = c.join(read(spark, d, "customer").where("c_nationkey % 2 = 0").select(F.col("c_custkey").alias("campaign_id")), "campaign_id").select("campaign_id", F.lit("b").alias("branch_id"), F.lit(99).cast("long").alias("addon_id"))
    return rulepacks.activation_requirements(asked.withColumnsRenamed(rename), c, packs.withColumnsRenamed(rename).drop("checksum"), wanting, conflicts, active).select("o_orderkey", "outcome")


@query("SELECT l_orderkey AS addon_id, count(*) AS components, count(*) FILTER (l_suppkey % 3 = 0 OR l_suppkey % 3 = 1 AND l_suppkey % 2 = 0) AS wanting FROM lineitem GROUP BY 1")
def addon_components(spark, d):
    """Orders as add-ons, lines as components: a third is missing, half of another third is there with another checksum."""
    own = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("addon_id"), F.lit("1").alias("addon_version"), F.lit("rule_pack").alias("kind"), F.col("l_suppkey").alias("id"), F.lit("1.0.0").alias("version"), F.lit("a").alias("checksum"))
    s = read(spark, d, "supplier").select(F.lit("rule_pack").alias("kind"), F.col("s_suppkey").alias("id"), F.lit("1.0.0").alias("version"))
    there = s.where("id % 3 <> 0").withColumn("checksum", F.when((F.col("id") % 3 == 1) & (F.col("id") % 2 == 0), "b").otherwise("a"))
    return rulepacks.installable(own, there, there.where("false")).select("addon_id", "components", "wanting")


@query("SELECT l_orderkey AS addon_id, string_agg(k || '=' || n, ',' ORDER BY k) AS counts FROM (SELECT l_orderkey, l_returnflag AS k, count(*) AS n FROM lineitem GROUP BY ALL) GROUP BY 1")
def addon_registry(spark, d):
    """Orders as add-ons: how many of their lines, as components, are of each kind."""
    own = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("addon_id"), F.lit("1").alias("version"), F.col("l_returnflag").alias("kind"))
    pairs = F.transform(F.array_sort(F.map_entries("counts")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return rulepacks.component_counts(own).select("addon_id", F.array_join(pairs, ",").alias("counts"))


@query("SELECT l_suppkey AS pack_id, count(DISTINCT l_orderkey) AS owners, count(DISTINCT l_returnflag) > 1 AS conflict, min(l_returnflag) AS version FROM lineitem GROUP BY 1")
def addon_lock_merge(spark, d):
    """Orders as active add-ons that lock their lines' suppliers, as packs, in the version of the return flag."""
    own = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("addon_id"), F.lit("1").alias("addon_version"), F.lit("rule_pack").alias("kind"), F.col("l_suppkey").alias("id"), F.col("l_returnflag").alias("version"), F.lit("a").alias("checksum"))
    active = read(spark, d, "orders").select(F.lit("c").alias("campaign_id"), F.lit("b").alias("branch_id"), F.col("o_orderkey").alias("addon_id"), F.lit("1").alias("addon_version"))
    return rulepacks.addon_locks(active, own).select("pack_id", F.size("owners").cast("long").alias("owners"), "conflict", "version")


@query("""
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'enabled' WHEN 1 THEN 'replaced' WHEN 2 THEN 'disabled' WHEN 3 THEN 'other version' WHEN 4 THEN 'not active' ELSE 'enabled' END AS outcome, o_orderkey % 6 IN (0, 1, 3, 5) AS active FROM orders""")
def addon_switches(spark, d):
    """Orders as add-ons that are switched on, off or to another version."""
    r = F.col("o_orderkey") % 6
    own = read(spark, d, "orders").select(F.lit("c").alias("campaign_id"), F.lit("b").alias("branch_id"), F.col("o_orderkey").alias("addon_id"), F.lit("2").alias("addon_version"), F.lit("a").alias("checksum"), r.isin(0, 1, 5).alias("enabled"), r.alias("r"))
    active = own.where("r not in (0, 4)").select("campaign_id", "branch_id", "addon_id", F.when(F.col("r").isin(1, 3), "1").otherwise("2").alias("addon_version"), "checksum")
    after, judged = rulepacks.switch_addons(active, own.drop("r"))
    return judged.join(after.select("addon_id", F.lit(True).alias("active")), "addon_id", "left").select(F.col("addon_id").alias("o_orderkey"), "outcome", F.coalesce("active", F.lit(False)).alias("active"))


@query("""
SELECT c_custkey, CASE WHEN c_nationkey % 4 = 0 AND c_custkey % 3 = 0 THEN 'locked' WHEN c_nationkey % 4 = 0 AND c_custkey % 3 = 1 THEN 'outside the allow-list' WHEN c_nationkey % 4 = 1 AND c_custkey IN (SELECT o_custkey FROM orders) THEN 'edition frozen' ELSE 'set' END AS outcome FROM customer""")
def profile_changes(spark, d):
    """Customers as campaigns that change edition or options, some under a lock with an allow-list; orders are their characters."""
    c = read(spark, d, "customer").select("c_custkey", F.col("c_custkey").alias("campaign_id"), (F.col("c_nationkey") % 4).alias("r"), (F.col("c_custkey") % 3).alias("o"))
    rest = {"locale": F.lit("en"), "publications": F.array(F.lit("p"))}
    now = c.select("campaign_id", F.lit("e1").alias("edition"), *[v.alias(k) for k, v in rest.items()], F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")).alias("options"))
    options = F.when(F.col("o") == 1, F.create_map(F.lit("a"), F.lit("2"))).otherwise(F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), F.lit("1")))
    asked = c.select("c_custkey", "campaign_id", F.when((F.col("r") == 1) | (F.col("r") == 0) & (F.col("o") == 0), "e2").otherwise("e1").alias("edition"), *[v.alias(k) for k, v in rest.items()], options.alias("options"))
    locks = c.select("campaign_id", (F.col("r") == 0).alias("locked"), F.array(F.lit("a")).alias("mutable_keys"))
    return rulepacks.set_profiles(now, locks, read(spark, d, "orders").select(F.col("o_custkey").alias("campaign_id")), asked).select("c_custkey", "outcome")


# ------------------------------------------------------------------ campaigns, characters, casts, assets, scenes and jobs


@query("SELECT 'campaigns' AS kind, c_custkey AS campaign_id, CASE WHEN c_nationkey % 2 = 0 THEN 2 ELSE 1 END AS revision FROM customer UNION ALL SELECT 'branches', c_custkey, 0 FROM customer UNION ALL SELECT 'memberships', c_custkey, 0 FROM customer WHERE c_nationkey % 3 = 0 UNION ALL SELECT 'profiles', c_custkey, 0 FROM customer WHERE c_nationkey % 2 = 0")
def campaign_creation(spark, d):
    """Customers as new campaigns, some with an owner and an edition: the rows of each table."""
    n = F.col("c_nationkey")
    new = cast.create_campaigns(read(spark, d, "customer").select(F.col("c_custkey").alias("campaign_id"), F.lit("s").alias("system_id"), F.col("c_name").alias("name"), F.when(n % 3 == 0, F.col("c_name")).alias("principal_id"), F.when(n % 2 == 0, "e1").alias("edition")))
    return contracts.union([rows.select(F.lit(kind).alias("kind"), "campaign_id", (F.col("revision") if "revision" in rows.columns else F.lit(0)).alias("revision")) for kind, rows in new.items()])


@query("SELECT s_suppkey::VARCHAR AS character_id, -1 AS campaign_id, '-' AS template_id FROM supplier UNION ALL SELECT s_suppkey || ':instance', s_nationkey, s_suppkey::VARCHAR FROM supplier WHERE s_nationkey % 2 = 0")
def character_creation(spark, d):
    """Suppliers as templates, half of them with an instance in a campaign."""
    asked = read(spark, d, "supplier").select(F.col("s_suppkey").alias("character_id"), F.lit("s").alias("system_id"), F.when(F.col("s_nationkey") % 2 == 0, F.col("s_nationkey")).cast("int").alias("campaign_id"), F.col("s_name").alias("name"), F.lit("{}").alias("sheet"))
    return cast.create_characters(asked).select("character_id", F.coalesce("campaign_id", F.lit(-1)).alias("campaign_id"), F.coalesce("template_id", F.lit("-")).alias("template_id"))


@query("SELECT s_suppkey, CASE WHEN s_nationkey % 5 = 0 THEN 'missing' WHEN s_nationkey % 5 = 1 THEN 'other system' WHEN s_nationkey % 5 = 2 THEN 'conflict' ELSE 'moved' END AS outcome, CASE WHEN s_nationkey % 5 IN (3, 4) THEN 8 ELSE 0 END AS revision FROM supplier")
def character_moves(spark, d):
    """Suppliers as characters that move to a campaign or the library."""
    r = F.col("s_nationkey") % 5
    own = read(spark, d, "supplier").select("s_suppkey", F.col("s_suppkey").alias("character_id"), r.alias("r"))
    campaigns = spark.createDataFrame([("a", "s"), ("b", "t")], "campaign_id string, system_id string")
    held = own.select("character_id", F.lit("s").alias("system_id"), F.lit(7).alias("revision"))
    asked = own.select("s_suppkey", "character_id", F.when(F.col("r") == 0, "c").when(F.col("r") == 1, "b").when(F.col("r") != 4, "a").alias("target"), F.when(F.col("r") == 2, 6).when(F.col("r") == 3, 7).alias("expected"))
    return cast.move_characters(held, asked, campaigns).select("s_suppkey", "outcome", F.coalesce("revision", F.lit(0)).alias("revision"))


@query("SELECT c_custkey, concat_ws(',', CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'orders' END, CASE WHEN c_custkey IN (SELECT user_id FROM events) THEN 'events' END) AS held_by FROM customer")
def actor_removals(spark, d):
    """Customers as actors whose creation is undone: orders and events still refer to some."""
    refs = {"orders": read(spark, d, "orders").select(F.col("o_custkey").alias("actor_id")), "events": read(spark, d, "events").select(F.col("user_id").alias("actor_id"))}
    return cast.removable_actors(read(spark, d, "customer").select(F.col("c_custkey").alias("actor_id")), refs).select(F.col("actor_id").alias("c_custkey"), F.array_join("held_by", ",").alias("held_by"))


@query("""
SELECT c_custkey, CASE c_custkey % 8 WHEN 0 THEN 'invalid' WHEN 1 THEN 'missing' WHEN 2 THEN 'other system' WHEN 3 THEN 'other campaign' WHEN 4 THEN 'no scene' WHEN 5 THEN 'other card' WHEN 6 THEN 'merged' ELSE 'created' END AS outcome, CASE c_custkey % 8 WHEN 6 THEN 'a=2,b=1' WHEN 7 THEN 'a=2' ELSE '-' END AS metadata FROM customer""")
def cast_bindings(spark, d):
    """Customers as characters that are bound to a module, with every kind of fault and two that are bound already."""
    own = read(spark, d, "customer").select(F.col("c_custkey").alias("character_id"), (F.col("c_custkey") % 8).alias("r"))
    r = F.col("r")
    modules = spark.createDataFrame([("m", "s", "c")], "module_id string, system_id string, campaign_id string")
    scenes = spark.createDataFrame([(1, "m", "key")], "scene_id int, module_id string, stable_key string")
    characters = own.where("r <> 1").select("character_id", F.when(r == 2, "t").otherwise("s").alias("system_id"), F.when(r == 3, "x").when(r == 6, "c").alias("campaign_id"))
    held = own.where("r in (5, 6)").select(F.lit("m").alias("module_id"), F.lit("key").alias("scene_key"), "character_id", F.lit("cast").alias("binding_kind"), F.lit("").alias("role"), F.when(r == 5, "other").otherwise("card").alias("actor_card_id"), F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("1")).alias("metadata"))
    asked = own.select(F.lit("m").alias("module_id"), "character_id", F.when(r == 0, "").otherwise(" card ").alias("actor_card_id"), F.lit("Cast").alias("binding_kind"), F.lit(None).cast("string").alias("role"), F.when(r == 4, 2).when(r != 7, 1).alias("scene_id"), F.create_map(F.lit("a"), F.lit("2")).alias("metadata"))
    pairs = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return cast.bind_actors(held, asked, modules, characters, scenes).select(F.col("character_id").alias("c_custkey"), "outcome", F.coalesce(F.array_join(pairs, ","), F.lit("-")).alias("metadata"))


@query("""
WITH a AS (SELECT p_brand, p_type, min(p_size) AS lo, max(p_size) AS hi FROM part GROUP BY ALL)
SELECT p_brand, p_type, CASE WHEN lo <> hi OR p_brand = 'Brand#11' AND lo <> 7 THEN 'different content' WHEN p_brand = 'Brand#11' THEN 'kept' ELSE 'created' END AS outcome FROM a""")
def asset_registry(spark, d):
    """Parts as assets: brand and type as path, the size as content; one brand's are there."""
    p = read(spark, d, "part").select(F.col("p_brand").alias("module_id"), F.col("p_type").alias("source_path"), F.lit("text/plain").alias("media_type"), F.lpad(F.col("p_size").cast("string"), 3, "0").alias("checksum"))
    held = p.where("module_id = 'Brand#11'").select("module_id", "source_path", F.lit("007").alias("checksum")).distinct()
    return cast.register_assets(held, p).select(F.col("module_id").alias("p_brand"), F.col("source_path").alias("p_type"), "outcome")


@query("""
SELECT o_orderkey AS scene_id, coalesce(string_agg('f' || l_returnflag || '=' || v, ',' ORDER BY l_returnflag), 'fN=old') AS fields
FROM orders LEFT JOIN (SELECT l_orderkey, l_returnflag, max_by(l_suppkey::VARCHAR, {'n': l_linenumber, 'v': l_suppkey::VARCHAR}) AS v FROM lineitem WHERE l_linenumber <> 1 GROUP BY ALL
  UNION ALL SELECT o_orderkey, 'N', 'old' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber <> 1 AND l_returnflag = 'N')) ON l_orderkey = o_orderkey GROUP BY 1""")
def scene_fields(spark, d):
    """Orders as scenes with one field; their lines set fields, the first ones such that only parsing may set."""
    scenes = read(spark, d, "orders").select(F.col("o_orderkey").alias("scene_id"), F.create_map(F.lit("fN"), F.lit("old")).alias("metadata"))
    changes = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("scene_id"), F.when(F.col("l_linenumber") == 1, "stable_key").otherwise(F.concat(F.lit(" f"), "l_returnflag")).alias("field"), F.col("l_suppkey").cast("string").alias("value"), F.col("l_linenumber").alias("ordinal"))
    pairs = F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return cast.set_scene_fields(scenes, changes)[0].select("scene_id", F.array_join(pairs, ",").alias("fields"))


_JOB = "CASE WHEN doc_id % 4 = 0 THEN 'completed' WHEN doc_id % 4 = 1 THEN 'failed' ELSE 'pending' END"


@query(f"""
WITH j AS (SELECT doc_id AS job_id, {_JOB} AS was FROM documents), t AS (SELECT job_id FROM j WHERE was <> 'completed' ORDER BY job_id LIMIT 700),
o AS (SELECT j.job_id, was, t.job_id IS NOT NULL AS tried, vec_id IS NOT NULL AS there FROM j LEFT JOIN t USING (job_id) LEFT JOIN embeddings ON vec_id = j.job_id AND label <> 3)
SELECT job_id, CASE WHEN NOT tried THEN was WHEN there THEN 'completed' ELSE 'failed' END AS status, 1 + tried::INT AS attempts, CASE WHEN NOT tried THEN 'old' WHEN there THEN '' ELSE 'the entity is gone' END AS error FROM o""")
def vector_jobs(spark, d):
    """Documents as jobs of an outbox, vectors as entities, some of them gone: all jobs after one batch."""
    k = F.col("doc_id")
    jobs = read(spark, d, "documents").select(k.alias("job_id"), F.lit("s").alias("system_id"), F.lit("c").alias("collection"), F.lit("upsert").alias("operation"), F.expr(_JOB).alias("status"), k.alias("created_at"), F.lit("rule_chunk").alias("entity_type"), k.alias("entity_id"), F.lit(1).alias("attempts"), F.lit("old").alias("error"))
    entities = read(spark, d, "embeddings").where("label <> 3").select(F.col("vec_id").alias("entity_id"), "embedding")
    tried = contracts.classify_jobs(contracts.due_jobs(jobs, system_id="s", collection="c", limit=700).drop("error"), entities)
    return contracts.settle_jobs(jobs, tried).select("job_id", "status", "attempts", "error")


# ------------------------------------------------------------------ descriptors, cards, contexts and documents


@query("SELECT doc_id, sha256(text) AS checksum, strlen(text) AS size, 'blobs/sha256/' || sha256(text) AS blob_key FROM documents")
def asset_descriptors(spark, d):
    """Documents as assets that are found by their content."""
    return cards.blob_descriptors(read(spark, d, "documents").select("doc_id", F.col("text").alias("content"))).select("doc_id", "checksum", "size", "blob_key")


@query("""
SELECT s_suppkey::VARCHAR AS subject, problem FROM supplier, (VALUES ('the id isn''t portable', 2), ('the name is missing', 3), ('the image is another kind of asset', 5), ('unknown image gone', 7)) v(problem, m)
WHERE s_suppkey % m = 0 AND NOT (m = 5 AND s_suppkey % 7 = 0)""")
def card_contract(spark, d):
    """Suppliers as actors' cards, each kind of fault in some."""
    k = F.col("s_suppkey")
    own = read(spark, d, "supplier").select(k.alias("actor_id"), F.lit("1").alias("version"), F.lit("s").alias("system_id"), F.lit("npc").alias("actor_type"), F.when(k % 3 != 0, F.col("s_name")).alias("name"), F.lit(None).cast("string").alias("player_name"), F.lit(None).cast("string").alias("summary"),
        F.lit("{}").alias("sheet"), F.lit("{}").alias("notes"), F.when(k % 7 == 0, "gone").when(k % 5 == 0, "map").otherwise("face").alias("image_asset_key"), F.lit("").alias("image_alt"))
    own = own.withColumn("actor_id", F.col("actor_id").cast("string"))
    made = cards.actor_cards(own).withColumn("card", F.col("card").withField("id", F.when(F.col("actor_id").cast("long") % 2 == 0, "no id").otherwise(F.col("actor_id"))))
    return cards.card_problems(made, spark.createDataFrame([("face", "actor_image"), ("map", "map")], "asset_key string, kind string"), "s")


@query("""
SELECT event_id::VARCHAR AS subject, problem FROM events, (VALUES ('channel is missing', 2), ('the epoch is negative', 3), ('the source isn''t trusted', 5), ('issued_at needs a time zone', 7), ('the signature is no digest', 11)) v(problem, m) WHERE event_id % m = 0""")
def context_contract(spark, d):
    """Events as stored contexts, each kind of fault in some."""
    k = F.col("event_id")
    own = read(spark, d, "events").select(k, F.lit("h").alias("host"), F.when(k % 2 != 0, "c").alias("channel"), F.col("event_type").alias("actor_principal"), F.lit("p").alias("conversation_principal"), F.lit("s").alias("session_id"), F.when(k % 3 == 0, -1).otherwise(0).alias("authorization_epoch"),
        F.when(k % 5 == 0, "me").otherwise("trusted-host").alias("principal_source"), k.cast("string").alias("nonce"), F.when(k % 7 == 0, "2024-01-02T03:04:05").otherwise("2024-01-02T03:04:05+00:00").alias("issued_at"), F.when(k % 11 == 0, "x").otherwise(F.sha2("event_type", 256)).alias("signature"))
    return access.context_problems(own, "event_id")


@query("SELECT o_orderkey, o_orderstatus AS tool, c_name AS actor_principal, c_nationkey AS authorization_epoch FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_nationkey <> 3) ON c_custkey = o_custkey")
def audit_receipts(spark, d):
    """Orders as writes under their customer's context; one nation has none."""
    c = read(spark, d, "customer").where("c_nationkey <> 3").select(F.col("c_custkey").alias("context_id"), F.col("c_name").alias("actor_principal"), F.col("c_nationkey").alias("authorization_epoch"), *[F.lit("x").alias(n) for n in ("conversation_principal", "tenant_id", "campaign_id", "session_id", "nonce")])
    writes = read(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("context_id"), F.col("o_orderstatus").alias("tool"))
    return access.audit_receipts(writes, c, "context_id").select("o_orderkey", "tool", "actor_principal", "authorization_epoch")


@query("""
WITH t AS (SELECT event_id, '{"candidates":[],"inspection":{},"payload":' || replace(props, ' ', '') || ',"result":{},"validation":{}}' AS v FROM events)
SELECT event_id, sha256(v) AS document_checksum, length(v) AS document_uncompressed_size FROM t""")
def import_documents(spark, d):
    """Event properties as payloads of import jobs."""
    return cards.with_import_document(read(spark, d, "events").select("event_id", "props"), payload=F.col("props")).select("event_id", "document_checksum", "document_uncompressed_size")


@query("SELECT event_id, sha256(replace(props, ' ', '')) AS checksum FROM events")
def package_digests(spark, d):
    """The properties of all events as bodies of packages."""
    return cards.package_checksums(read(spark, d, "events"), "props").select("event_id", "checksum")


# ------------------------------------------------------------------ structure over page borders


@query(r"""
WITH raw AS (
  SELECT coalesce(source, '') AS document, doc_id AS page, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
lines AS (
  SELECT document, page, generate_subscripts(parts, 1) AS n, unnest(parts) AS raw FROM raw),
kinds AS (
  SELECT document, page, n, line,
         CASE WHEN line = '' THEN 'gap' WHEN regexp_matches(line, '^[A-Z][a-z]+$') THEN 'heading' WHEN regexp_matches(line, '^(?:[-*]|[0-9]+[.)]) ') THEN 'item' ELSE 'body' END AS kind,
         regexp_matches(line, '[。！？!?；;：:…][”’』」）》】]*$') AS ends
  FROM (SELECT document, page, n, trim(raw) AS line FROM lines)),
on_page AS (SELECT *, lag(kind) OVER (PARTITION BY document, page ORDER BY n) AS kind_before FROM kinds),
solid AS (
  SELECT *, lag(kind) OVER w AS last_kind, lag(ends) OVER w AS last_ends, lag(page) OVER w AS last_page
  FROM on_page WHERE kind <> 'gap' WINDOW w AS (PARTITION BY document ORDER BY page, n)),
begun AS (
  SELECT *, (kind <> 'body' OR last_kind IS NULL OR last_kind <> 'body' OR last_ends OR (last_page = page AND kind_before = 'gap')) AS begins,
         last_value(CASE WHEN kind = 'heading' THEN line END IGNORE NULLS) OVER (PARTITION BY document ORDER BY page, n) AS chapter
  FROM solid),
numbered AS (
  SELECT *, sum(begins::INT) OVER (PARTITION BY document ORDER BY page, n) AS block_id,
         sum(begins::INT) OVER (PARTITION BY document, page ORDER BY n) AS nth FROM begun),
paired AS (SELECT *, lead(line) OVER (PARTITION BY document, block_id ORDER BY page, n) AS following FROM numbered)
SELECT document, min(page) AS page, arg_min(nth, (page, n))::BIGINT AS block, arg_min(kind, (page, n)) AS kind, arg_min(chapter, (page, n)) AS chapter,
       count(*)::INT AS lines, count(DISTINCT page)::BIGINT AS pages,
       md5(string_agg(CASE WHEN following IS NULL THEN line WHEN line LIKE '%-' AND regexp_matches(following, '^[A-Za-z]') THEN line[:-2] WHEN line LIKE '%-' THEN line ELSE line || ' ' END, '' ORDER BY page, n)) AS address
FROM paired GROUP BY document, block_id
""")
def reflowed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of whole documents whose pages are the rows of one source; paragraphs go on over page borders.

    Lines of one capitalised word stand for chapters, as the texts have no marked ones.
    """
    pages = read(spark, sf_dir, "documents").select(F.coalesce("source", F.lit("")).alias("document"), F.col("doc_id").alias("page"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("n", "raw"))
    line = F.trim("raw")
    heading = line.rlike("^[A-Z][a-z]+$")
    kind = F.when(line == "", "gap").when(heading, "heading").when(line.rlike("^(?:[-*]|[0-9]+[.)]) "), "item").otherwise("body")
    lines = pages.select("document", "page", "n", kind.alias("kind"), F.when(heading, reflow.CHAPTER).alias("level"), line.alias("text"), F.lit("").alias("body"))
    return reflow.blocks(lines).select("document", "page", "block", "kind", "chapter", "lines", "pages", F.md5("text").alias("address"))


_KEYED = """SELECT doc_id, doc_id % 4 AS form, chr((65 + doc_id % 26)::INT) AS letter, (10 + doc_id % 90)::VARCHAR AS number,
  trim(regexp_replace(coalesce(text, '') || ' end', '[^A-Za-z]+', ' ', 'g')) AS words FROM documents"""


@query(f"""
WITH d AS ({_KEYED})
SELECT doc_id, form < 2 AS is_heading,
       CASE form WHEN 0 THEN letter || number || '. Gate Of Sorrow' WHEN 1 THEN 'DAY' || number
                 WHEN 2 THEN 'MAP' || number || CASE WHEN len(string_split(words, ' ')) + 1 > 6 THEN '' ELSE '. Old ' || words END ELSE md5(words) END AS heading,
       md5(CASE form WHEN 0 THEN words WHEN 1 THEN 'at ' || words WHEN 2 THEN CASE WHEN len(string_split(words, ' ')) + 1 > 6 THEN 'Old ' || words ELSE '' END ELSE '' END) AS body
FROM d
""")
def keyed_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marked-up lines with known parses: keyed rooms and days with damaged numbers before the words of each document, maps, and plain prose."""
    d = read(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 4).alias("form"), F.char(65 + F.col("doc_id") % 26).alias("letter"), F.translate((10 + F.col("doc_id") % 90).cast("string"), "01", "Ol").alias("number"), F.trim(F.regexp_replace(F.concat(F.coalesce("text", F.lit("")), F.lit(" end")), "[^A-Za-z]+", " ")).alias("words"))
    line = F.when(F.col("form") == 0, F.concat("letter", "number", F.lit(". Gate Of Sorrow. "), "words")).when(F.col("form") == 1, F.concat(F.lit("Day"), "number", F.lit(". at "), "words")).when(F.col("form") == 2, F.concat(F.lit("Map "), "number", F.lit(". Old "), "words")).otherwise(F.col("words"))
    own = d.select("doc_id", "form", headings.keyed_heading(line).alias("is_heading"), headings.split_heading(line).alias("s"))
    return own.select("doc_id", "is_heading", F.when(F.col("form") == 3, F.md5("s.heading")).otherwise(F.col("s.heading")).alias("heading"), F.md5("s.body").alias("body"))


# ------------------------------------------------------------------ an index kept up to date

_LATER = _BM25_SQL.replace("FROM documents\n)", "FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 2 THEN lang ELSE source END AS source, CASE WHEN doc_id % 5 = 2 THEN source || ' the ' || coalesce(text, '') ELSE text END AS text FROM documents WHERE doc_id % 7 <> 3) later\n)")


@query(_LATER + " SELECT query_id, doc_id, score FROM score")
def index_search(spark, d):
    """BM25 over an index of all documents after a fifth of them was replaced, a seventh deleted, and some of it merged."""
    docs = read(spark, d, "documents").select("doc_id", "source", "text", "lang")
    index = SearchIndex(spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}", _BM25)
    index.apply(0, docs)
    index.apply(1, docs.where("doc_id % 5 = 2").select("doc_id", F.col("lang").alias("source"), F.concat("source", F.lit(" the "), F.coalesce("text", F.lit(""))).alias("text")))
    index.merge(2)
    index.apply(3, deletes=docs.where("doc_id % 7 = 3"))
    return index.bm25(_asked(spark)).select("query_id", "doc_id", F.round("score", 6).alias("score"))


# ------------------------------------------------------------------ snapshots over the log


@query("""
WITH e AS (SELECT count(*) AS a, count(*) FILTER (WHERE event_type <> 'error') AS n FROM events),
o AS (SELECT count(DISTINCT o_custkey) AS n, count(DISTINCT o_custkey) FILTER (WHERE o_orderstatus = 'O') AS later FROM orders),
c AS (SELECT count(*) AS n FROM customer)
SELECT 'events' AS collection, n AS first_rows, a AS second_rows, true AS restored, true AS sound, a - n AS dirty FROM e
UNION ALL SELECT 'facts', n, n, true, true, 2 * later FROM o
UNION ALL SELECT 'profile', 1, 1, true, true, 0
UNION ALL SELECT 'states', n, n, true, true, (SELECT 2 * count(*) FROM customer WHERE c_acctbal < 0) FROM c
""")
def snapshot_round_trip(spark, d):
    """A campaign of all events, a fact for each customer with orders and all customers' states: captured, changed, captured again and put back.

    Errors come after the first snapshot, as do second revisions of the facts of
    customers with open orders and new states of those in debt; `dirty` counts
    the rows in which the campaign then differed from its first snapshot.
    """
    events = read(spark, d, "events").select(F.col("event_id").cast("string").alias("event_id"), F.lit("c").alias("campaign_id"), F.lit("main").alias("branch_id"), F.col("event_id").alias("sequence"), F.col("props").alias("content"), F.lit(None).cast("string").alias("committed_snapshot_id"), "event_type")
    orders = read(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("memory_id"), "o_orderkey", "o_orderstatus")
    orders = dealt(orders, "memory_id", rows=orders.count()).groupBy("memory_id").agg(F.max("o_orderkey").cast("string").alias("content"), F.max(F.col("o_orderstatus") == "O").alias("later"))
    head = lambda df, n: df.select(F.lit("main").alias("branch_id"), "memory_id", F.lit(n).cast("long").alias("revision"))
    revision = lambda df, n: df.select(F.lit("main").alias("branch_id"), "memory_id", F.lit(n).cast("long").alias("revision"), "content")
    customers = read(spark, d, "customer")
    state = lambda df, n, c: df.select(F.col("c_custkey").cast("string").alias("entity_id"), F.lit(n).cast("long").alias("revision"), c.alias("state"))
    log = CommitLog(spark, f"{shared_folder(spark)}/{uuid.uuid4().hex}")
    early, late, open_ = events.where("event_type <> 'error'").drop("event_type"), events.where("event_type = 'error'").drop("event_type"), orders.where("later")
    log.commit({"branches": spark.createDataFrame([("c", "main", "main", None)], transactions.BRANCHES), "profiles": spark.createDataFrame([("c", 1, "{}")], timelines.PROFILES), "events": early, "fact_heads": head(orders, 1), "fact_revisions": revision(orders, 1), "states": state(customers, 1, F.col("c_mktsegment"))}, expected=0)
    timelines.create_snapshot(log, 1, "c", "main", "s1", "first")
    log.commit({"events": late, "fact_heads": head(open_, 2), "fact_revisions": revision(open_, 2), "states": state(customers.where("c_acctbal < 0"), 2, F.lit("in debt"))}, expected=2)
    changed = timelines.dirty(log.view(), "c", "main")
    timelines.create_snapshot(log, 3, "c", "main", "s2", "second")
    timelines.restore(log, 4, "c", "main", "s1")
    view = log.view()
    stored = view.read("snapshot_digests")
    one, two = (stored.where(F.col("snapshot_id") == s).select("collection", F.col("rows").alias(r), F.col("digest").alias(s)) for s, r in (("s1", "first_rows"), ("s2", "second_rows")))
    now = timelines.digests(timelines.live(view, "c", "main")).select("collection", F.col("digest").alias("now"))
    bad = timelines.verify(log, "s1").unionByName(timelines.verify(log, "s2")).select("collection").distinct().withColumn("bad", F.lit(True))
    counts = F.create_map(*[F.lit(x) for c in timelines.COLLECTIONS for x in (c, changed.get(f"dirty {c}", 0))])
    both = one.join(two, "collection").join(now, "collection").join(bad, "collection", "left")
    return both.select("collection", "first_rows", "second_rows", (F.col("now") == F.col("s1")).alias("restored"), F.col("bad").isNull().alias("sound"), F.element_at(counts, F.col("collection")).cast("long").alias("dirty"))


# ------------------------------------------------------------------ outlines


@query(r"""
WITH l AS (
  SELECT source AS document, doc_id AS page, generate_subscripts(parts, 1) - 1 AS n, trim(unnest(parts)) AS line
  FROM (SELECT source, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)),
k AS (SELECT *, regexp_replace(replace(lower(line), 'ß', 'ss'), '[^\p{L}\p{M}\p{N}_]+', '', 'g') AS key, count(*) OVER (PARTITION BY document, page) AS lines FROM l),
e AS (SELECT document, page, 1 + page % 3 AS depth, line AS title, key FROM k WHERE n = page % lines),
u AS (SELECT e.* FROM e WHERE length(trim(regexp_replace(title, '\s+', ' ', 'g'))) <= 200 AND EXISTS (SELECT 1 FROM k WHERE k.document = e.document AND k.page = e.page AND k.key <> '')),
m AS (SELECT u.document, u.page, min(k.n) AS line FROM u JOIN k ON k.document = u.document AND k.page = u.page AND k.key = u.key AND k.key <> '' GROUP BY ALL)
SELECT u.document, u.page, m.line::INT AS line, m.line IS NOT NULL AS matched, CASE WHEN m.line IS NOT NULL THEN least(4, 2 + depth)::INT END AS level FROM u LEFT JOIN m USING (document, page)
""")
def outline_matches(spark, d):
    """An outline whose entries are lines of the documents, one a document, matched to the first line that is like them."""
    pages = read(spark, d, "documents").select(F.col("source").alias("document"), F.col("doc_id").alias("page"), "text")
    parts = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    entries = pages.select("document", "page", F.lit(1).alias("ordinal"), F.trim(F.get(parts, (F.col("page") % F.size(parts)).cast("int"))).alias("title"), (1 + F.col("page") % 3).cast("int").alias("depth"))
    told, found = outline.match_outline(pages, entries)
    levels = found.select("document", "page", F.col("n").alias("line"), "level")
    return told.join(levels, ["document", "page", "line"], "left").select("document", "page", "line", "matched", "level")


# ------------------------------------------------------------------ layouts


@query("""
WITH n AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS k FROM lineitem)
SELECT l_orderkey AS page, string_agg('p' || l_partkey, chr(10) ORDER BY k) AS text FROM n GROUP BY l_orderkey
""")
def layout_order(spark, d):
    """Orders as pages whose lines are blocks: a title, two columns whose right one has a side bar, and so on in bands below; read back in order."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = read(spark, d, "lineitem")
    rows = dealt(lines, "l_orderkey", rows=lines.count()).select("l_orderkey", "l_partkey", (F.row_number().over(order) - 1).alias("k"))
    k, band = F.col("k") % 4, F.floor(F.col("k") / 4) * 400.0
    x0, x1 = (F.element_at(F.array(*[F.lit(x) for x in xs]), (k + 1).cast("int")) for xs in ((50.0, 50.0, 400.0, 700.0), (950.0, 330.0, 660.0, 950.0)))
    y0 = band + F.when(k == 0, 20.0).otherwise(140.0)
    blocks = rows.select(F.lit("d").alias("document"), F.col("l_orderkey").alias("page"), F.hash("l_partkey", "k").alias("block"), x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), (y0 + F.when(k == 0, 40.0).otherwise(180.0)).alias("y1"), F.lit(1000.0).alias("width"), F.lit(1300.0).alias("height"), F.concat(F.lit("p"), "l_partkey").alias("text"))
    return regions.page_text(blocks).select("page", "text")


# ------------------------------------------------------------------ reviewed maps


@query("""
WITH l AS (SELECT o_custkey AS module_id, o_orderkey AS scene_id, l_partkey AS key, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
p AS (SELECT *, count(*) OVER (PARTITION BY module_id, key) AS places, lead(key) OVER w AS next FROM l WINDOW w AS (PARTITION BY scene_id ORDER BY n)),
c AS (SELECT p.*, q.places AS next_places FROM p JOIN (SELECT scene_id, n - 1 AS n, places FROM p) q USING (scene_id, n)),
b AS (SELECT scene_id, n, CASE WHEN key = next THEN 'ends' WHEN places > 1 OR next_places > 1 THEN 'location ambiguous' END AS bad FROM c),
f AS (SELECT scene_id, arg_min(bad, n) FILTER (WHERE bad IS NOT NULL) AS bad, count(*) AS n FROM b GROUP BY scene_id),
r AS (SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '1%' THEN 'page' WHEN f.n IS NULL THEN 'no connections' WHEN o_orderstatus = 'F' THEN 'no reviewer' ELSE f.bad END AS problem, f.n FROM orders LEFT JOIN f ON f.scene_id = o_orderkey)
SELECT o_orderkey AS review_id, problem, CASE WHEN problem IS NULL THEN n ELSE 0 END AS edges FROM r
""")
def spatial_reviews(spark, d):
    """Customers as modules, their orders as scenes and reviews, lines as locations that are connected in a row; several faults may meet in one review."""
    o = read(spark, d, "orders").select(F.col("o_orderkey").alias("scene_id"), F.col("o_custkey").alias("module_id"), "o_orderpriority", "o_orderstatus")
    order = Window.partitionBy("scene_id").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    lines = read(spark, d, "lineitem")
    n, lines = lines.count(), lines.withColumn("scene_id", F.col("l_orderkey"))
    lines = dealt(lines, "scene_id", rows=n).join(o.select("scene_id", "module_id"), "scene_id")
    keys = stored(lines.select("module_id", "scene_id", F.col("l_partkey").cast("string").alias("key"), F.row_number().over(order).alias("ordinal"), F.lead(F.col("l_partkey").cast("string")).over(order).alias("to")))
    connections = keys.where(F.col("to").isNotNull()).select(F.col("scene_id").alias("review_id"), "ordinal", F.col("key").alias("from"), "to", F.lit(False).alias("bidirectional"), F.lit("door").alias("kind"), F.lit("seen").alias("observation"))
    reviews = o.select(F.col("scene_id").alias("review_id"), F.lit(1).alias("ordinal"), "scene_id", F.lit("merge").alias("mode"), F.col("module_id").alias("asset_id"), F.when(F.col("o_orderpriority").startswith("1"), 9).otherwise(1).alias("page"), F.when(F.col("o_orderstatus") == "F", "").otherwise("me").alias("reviewer"), F.lit("main").alias("branch_id"))
    assets = o.select(F.col("module_id").alias("asset_id"), "module_id", F.lit("application/pdf").alias("media_type"), F.lit(8).alias("page_count"), F.lit(None).cast("int").alias("source_page"), F.lit("x").alias("checksum")).distinct()
    edges, told = spatial.apply_reviews(spark.createDataFrame([], "scene_id long, `from` string, `to` string, bidirectional boolean, kind string, observation string, asset_id long, asset_checksum string, page long, reviewer string, branch_id string"), reviews, connections, o, keys, assets)
    edges = dealt(edges.select(F.col("scene_id").alias("review_id")), "review_id", rows=n).groupBy("review_id").agg(F.count("*").alias("edges"))
    return told.join(edges, "review_id", "left").select("review_id", "problem", F.coalesce("edges", F.lit(0)).cast("long").alias("edges"))


# ------------------------------------------------------------------ candidates


@query("""
WITH h AS (SELECT user_id AS job_id, event_id AS id, event_id AS ordinal, replace(props, ' ', '') AS content, CASE event_type WHEN 'click' THEN 'accepted' WHEN 'view' THEN 'rejected' ELSE 'pending' END AS status, event_type FROM events),
n AS (SELECT job_id, CASE WHEN event_type = 'view' THEN id + 100000000 ELSE id END AS id, ordinal, CASE WHEN event_type = 'error' THEN '{"k":-1}' ELSE content END AS content, event_type FROM h WHERE event_type <> 'signup'),
kept AS (SELECT n.job_id, n.id FROM n JOIN h USING (job_id, id) WHERE n.content = h.content),
l AS (SELECT *, row_number() OVER (PARTITION BY job_id, content ORDER BY ordinal, id::VARCHAR) AS k FROM n WHERE (job_id, id) NOT IN (SELECT (job_id, id) FROM kept)),
o AS (SELECT *, row_number() OVER (PARTITION BY job_id, content ORDER BY ordinal, id::VARCHAR) AS k FROM h WHERE (job_id, id) NOT IN (SELECT (job_id, id) FROM kept)),
m AS (SELECT l.job_id, l.id, o.status FROM l JOIN o USING (job_id, content, k)),
t AS (SELECT n.job_id, n.id, CASE WHEN k.id IS NOT NULL THEN 'kept' WHEN m.id IS NOT NULL THEN 'moved' WHEN h.id IS NOT NULL THEN 'changed' ELSE 'new' END AS outcome, h.status AS held, m.status AS taken
  FROM n LEFT JOIN kept k USING (job_id, id) LEFT JOIN m USING (job_id, id) LEFT JOIN h USING (job_id, id))
SELECT job_id, id::VARCHAR AS id, outcome, CASE outcome WHEN 'kept' THEN held WHEN 'moved' THEN taken WHEN 'changed' THEN CASE WHEN held = 'pending' THEN 'pending' ELSE 'needs_revision' END ELSE 'pending' END AS review_status FROM t
""")
def candidate_carryover(spark, d):
    """Users as imports and their events as candidates, inspected again: views under other ids, errors edited, signups gone."""
    e = read(spark, d, "events")
    status = F.when(F.col("event_type") == "click", "accepted").when(F.col("event_type") == "view", "rejected").otherwise("pending")
    held = e.select(F.col("user_id").alias("job_id"), F.col("event_id").cast("string").alias("id"), F.col("event_id").alias("ordinal"), F.col("props").alias("artifact"), status.alias("review_status"), F.lit("first").alias("original_fingerprint"))
    renamed = F.when(F.col("event_type") == "view", F.col("event_id") + 100000000).otherwise(F.col("event_id"))
    edited = F.when(F.col("event_type") == "error", '{"k": -1}').otherwise(F.col("props"))
    new = e.where("event_type <> 'signup'").select(F.col("user_id").alias("job_id"), renamed.cast("string").alias("id"), F.col("event_id").alias("ordinal"), edited.alias("artifact"), F.lit(None).cast("string").alias("review_status"))
    return candidates.set_candidates(held, new)[0].where("outcome <> 'untouched'").select("job_id", "id", "outcome", "review_status")
