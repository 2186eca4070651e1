"""Spatial reviews: every problem, merging and replacing, and what is reached."""

from pyspark.sql import functions as F

from palimpsest.operators import spatial

R = "review_id string, ordinal int, scene_id string, mode string, asset_id string, page int, reviewer string, branch_id string"
C = "review_id string, ordinal int, `from` string, `to` string, bidirectional boolean, kind string, observation string"


def tables(spark, reviews, connections):
    make = spark.createDataFrame
    return {
        "reviews": make(reviews, R),
        "connections": make(connections, C),
        "scenes": make([("s1", "m"), ("s2", "m"), ("t", "n")], "scene_id string, module_id string"),
        "locations": make([("m", "s1", k) for k in "abcd"] + [("m", "s2", "d"), ("m", "s2", "e"), ("n", "t", "a"), ("m", "s2", None)], "module_id string, scene_id string, key string"),
        "assets": make([("pdf", "m", "application/pdf", 3, None, "x"), ("png", "m", "image/png", None, 2, "y"), ("doc", "m", "text/plain", None, None, "z"), ("other", "n", "image/png", None, None, "w")], "asset_id string, module_id string, media_type string, page_count int, source_page int, checksum string"),
    }


def test_every_problem(spark):
    good = ("s1", "merge", "pdf", 3, "me", "main")
    cases = {
        None: (good, [("a", "e", None, None, "seen")]), "no such scene": (("zz", *good[1:]), []), "mode": (("s1", "mix", *good[2:]), []), "no asset named": (("s1", None, " ", 1, "me", "main"), []),
        "asset of another module": (("s1", None, "other", 1, "me", "main"), []), "media type": (("s1", None, "doc", 1, "me", "main"), []), "page": (("s1", None, "pdf", 4, "me", "main"), []),
        "no connections": (good, []), "no reviewer": (("s1", None, "png", 2, " ", "main"), [("a", "b", True, None, "x")]), "no branch": (("s1", None, "png", 2, "me", None), [("a", "b", True, None, "x")]),
        "ends": (good, [(" a", "a ", True, None, "x")]), "location missing": (good, [("a", "q", True, None, "x")]), "location ambiguous": (good, [("a", "d", True, None, "x")]),
        "kind": (good, [("a", "b", True, "slide", "x")]), "observation": (good, [("a", "b", True, None, "x" * 501)]), "too many connections": (good, [("a", "b", True, None, "x")] * 501),
    }
    more = {"page2": (("s1", None, "png", 1, "me", "main"), []), "page3": (("s1", None, "pdf", None, "me", "main"), []), "two": (good, [("a", "b", True, "slide", ""), ("a", "q", True, None, "x")])}
    reviews, connections = [], []
    for n, (name, (r, cs)) in enumerate({**cases, **more}.items()):
        reviews.append((str(name), n, *r))
        connections += [(str(name), k, *c) for k, c in enumerate(cs)]
    t = tables(spark, reviews, connections)
    got = {r.review_id: r.problem for r in spatial.judged_reviews(t["reviews"], t["connections"], t["scenes"], t["locations"], t["assets"]).collect()}
    assert got == {str(k): k for k in cases} | {"page2": "page", "page3": "page", "two": "kind"}


def test_merging_replacing_and_walking(spark):
    reviews = [("r1", 1, "s1", "merge", "pdf", 1, "me", "main"), ("r2", 2, "s1", None, "png", 2, "you", "main"), ("r3", 3, "s2", "replace", "pdf", 2, "me", "main"), ("bad", 9, "s1", "replace", "pdf", 2, "me", "main")]
    connections = [("r1", 1, "a", "b", True, None, "one"), ("r1", 2, "b", "c", False, "stairs", "down"), ("r2", 1, "b", "a", None, "door", "two"), ("r3", 1, "c", "e", True, "secret_door", "x"), ("bad", 1, "a", "q", True, None, "x")]
    t = tables(spark, reviews, connections)
    old = spark.createDataFrame([("s1", "c", "a", False, "portal", "old", "pdf", "x", 1, "me", "main"), ("s2", "a", "e", True, "door", "old", "pdf", "x", 1, "me", "main")], "scene_id string, `from` string, `to` string, bidirectional boolean, kind string, observation string, asset_id string, asset_checksum string, page long, reviewer string, branch_id string")
    after, told = spatial.apply_reviews(old, **t)
    got = {(r.scene_id, r["from"], r["to"], r.kind, r.observation, r.asset_checksum) for r in after.collect()}
    assert got == {("s1", "c", "a", "portal", "old", "x"), ("s1", "b", "a", "door", "two", "y"), ("s1", "b", "c", "stairs", "down", "x"), ("s2", "c", "e", "secret_door", "x", "x")}
    assert {r.review_id: r.problem for r in told.collect()} == {"r1": None, "r2": None, "r3": None, "bad": "location missing"}
    graph = after.join(t["scenes"], "scene_id")
    walk = lambda key, **k: {r.key: r.steps for r in spatial.reached(graph, spark.createDataFrame([("m", key)], "module_id string, key string"), **k).collect()}
    assert walk("a") == {"a": 0, "b": 1, "c": 2} and walk("a", closed=()) == {"a": 0, "b": 1, "c": 2, "e": 3} and walk("e") == {"e": 0}
    assert spatial.apply_reviews(old.limit(0), **tables(spark, [], []))[0].collect() == []


def test_reviews_are_dealt_by_their_number(spark, monkeypatch):
    from palimpsest.sources import tables

    monkeypatch.setattr(tables, "TASK_ROWS", 5)
    tasks = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scenes = spark.range(60).select(F.col("id").alias("scene_id"), F.col("id").alias("module_id"))
    keys = scenes.crossJoin(spark.createDataFrame([("a",), ("b",)], "key string"))
    reviews = scenes.select(F.col("scene_id").alias("review_id"), F.lit(1).alias("ordinal"), "scene_id", F.lit("merge").alias("mode"), F.col("module_id").alias("asset_id"), F.lit(1).alias("page"), F.lit("me").alias("reviewer"), F.lit("main").alias("branch_id"))
    connections = scenes.select(F.col("scene_id").alias("review_id"), F.lit(1).alias("ordinal"), F.lit("a").alias("from"), F.lit("b").alias("to"), F.lit(False).alias("bidirectional"), F.lit("door").alias("kind"), F.lit("seen").alias("observation"))
    assets = scenes.select(F.col("module_id").alias("asset_id"), "module_id", F.lit("image/png").alias("media_type"), F.lit(1).alias("page_count"), F.lit(1).alias("source_page"), F.lit("x").alias("checksum"))
    none = spark.createDataFrame([], "scene_id long, `from` string, `to` string, bidirectional boolean, kind string, observation string, asset_id long, asset_checksum string, page long, reviewer string, branch_id string")
    edges, told = spatial.apply_reviews(none, reviews, connections, scenes, keys, assets)
    assert tasks(spatial.resolved(keys)) > least and tasks(edges) > least
    assert spatial.judged_reviews(reviews, connections, scenes, keys, assets).rdd.getNumPartitions() > least
    assert told.where("problem is null").count() == edges.count() == 60
