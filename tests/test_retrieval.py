import random

from pyspark.sql import functions as F

from palimpsest.operators import retrieval


def test_ranks_of_all_rows(spark):
    rng = random.Random(1)
    rows = [(q, d, float(rng.randint(0, 5))) for q in range(3) for d in range(200 if q else 900)]
    got = {(r.query_id, r.doc_id): r["rank"] for r in retrieval.ranked(spark.createDataFrame(rows, "query_id int, doc_id int, score double").repartition(7), "c").collect()}
    for q in range(3):
        own = sorted((-s, d) for x, d, s in rows if x == q)
        assert [got[q, d] for _, d in own] == list(range(1, len(own) + 1))
    some = retrieval.ranked(spark.createDataFrame(rows, "query_id int, doc_id int, score double"), "c", limit=5)
    assert {(r.query_id, r.doc_id): r["rank"] for r in some.collect()} == {k: v for k, v in got.items() if v <= 5}
    assert retrieval.ranked(spark.createDataFrame([], "query_id int, doc_id int, score double"), "c").count() == 0


def test_fusion_adds_weighted_reciprocal_ranks(spark):
    kind = "query_id int, doc_id string, channel string, rank int"
    fused = retrieval.reciprocal_rank_fusion([spark.createDataFrame([(0, "a", "lexical", 1), (0, "b", "lexical", 2)], kind), spark.createDataFrame([(0, "b", "dense", 1)], kind)], weights={"dense": 2.0}, order=["lexical", "dense"])
    got = {r.doc_id: (r.score, r.channels) for r in fused.collect()}
    assert got == {"a": (1 / 61, ["lexical"]), "b": (1 / 62 + 2 / 61, ["lexical", "dense"])}


def test_queries(spark):
    q = spark.createDataFrame([('save "AND" (豁免) x-y save',)], "q string")
    assert q.select(retrieval.fts_terms(F.col("q")).alias("t")).first().t == ["豁免", "save", "AND", "x", "y"]
    hints = {"save": ["throw", "rescue"], "Save": ["no"]}
    assert q.select(retrieval.enrich_query(F.col("q"), hints).alias("t")).first().t.endswith(" throw rescue")


def test_index_falls_back_to_fields_for_queries_it_does_not_know(spark):
    docs = spark.createDataFrame([(1, "Grapple", "hold on"), (2, "Shove", "push the grapple away"), (3, "Rest", "sleep")], "id int, title string, body string")
    asked = spark.createDataFrame([(0, "grapple"), (1, "slee")], "query_id int, query string")
    got = retrieval.hybrid_search(docs, asked, 2, doc_id="id", titles=["title"], fields={"section_title": "title", "content": "body"}, index={"title": 5.0, "body": 1.0}, weights=retrieval.RULE_CHANNELS)
    rows = [(r.query_id, r["rank"], r.doc_id, r.channels) for r in got.orderBy("query_id", "rank").collect()]
    assert rows == [(0, 1, 1, ["exact", "lexical"]), (0, 2, 2, ["lexical"]), (1, 1, 3, ["lexical"]), (1, 2, 1, ["lexical"])]
