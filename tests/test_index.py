"""An index kept up to date against one built anew, and commits that are whole or not there."""

import os
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import retrieval
from palimpsest.plans import transactions
from palimpsest.sources.commits import BrokenLog, CommitLog, StaleVersion
from palimpsest.sources.index import BUCKETS, SearchIndex

COLUMNS = {"title": 3.0, "body": 1.0}
SCHEMA = "doc_id long, title string, body string"
ASKED = [(1, "alpha beta"), (2, "gamma"), (3, "nowhere"), (4, "δ alpha"), (5, "")]


def scores(df):
    return {(r.query_id, r.doc_id): round(r.score, 9) for r in df.collect()}


def test_every_change_gives_what_a_rebuild_gives(spark, tmp_path):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choices(["alpha", "beta", "gamma", "δ", "Alpha", "-", "eps"], k=rng.randint(0, 9)))
    queries = spark.createDataFrame(ASKED, "query_id int, query string")
    index, now, version = SearchIndex(spark, f"file://{tmp_path}/index", COLUMNS), {}, 0
    assert scores(index.bm25(queries)) == {}
    for step in range(5):
        upserts = [(i, None if i % 9 == 0 else text(), text()) for i in rng.sample(range(30), 12)]
        deletes = [(i,) for i in rng.sample(range(40), 6)] + [(None,)]
        if step == 3:
            version = index.merge(version)
        frame = spark.createDataFrame([*upserts, *upserts[:2], (None, "x", "alpha")], SCHEMA)
        version = index.apply(version, None if step == 2 else frame, spark.createDataFrame(deletes, "doc_id long"))
        for (i,) in deletes:
            now.pop(i, None)
        if step != 2:
            now.update({i: (i, a, b) for i, a, b in upserts})
        want = scores(retrieval.bm25(spark.createDataFrame(list(now.values()), SCHEMA), queries, doc_id="doc_id", columns=COLUMNS))
        assert scores(index.bm25(queries)) == want, step
        assert scores(index.bm25(queries, version=version)) == want
    before = scores(index.bm25(queries))
    assert scores(index.bm25(queries, version=index.merge(version))) == before
    with pytest.raises(StaleVersion):
        index.apply(version, frame)
    with pytest.raises(StaleVersion):
        index.merge(version)


def test_a_search_opens_the_files_of_its_terms(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "index"), COLUMNS)
    rows = spark.range(200).select(F.col("id").alias("doc_id"), F.lit("t").alias("title"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("body"))
    index.apply(0, rows)
    found = index.bm25(spark.createDataFrame([(1, "w7")], "query_id int, query string"))
    assert [r.doc_id for r in found.collect()] == [7]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket#" in plan.replace("isnotnull(bucket", "bucket")
    folders = os.listdir(index.log.files("postings")[0].removeprefix("file:"))
    assert 1 < sum(f.startswith("bucket=") for f in folders) <= BUCKETS


def test_bm25_counts_terms_in_all_columns(spark):
    docs = spark.createDataFrame([(1, "a b", "a a c"), (2, None, "b"), (3, "", None), (4, "c", "c c c")], SCHEMA)
    got = scores(retrieval.bm25(docs, spark.createDataFrame([(1, "a"), (2, "c b"), (3, "zz")], "query_id int, query string"), doc_id="doc_id", columns=COLUMNS))
    assert set(got) == {(1, 1), (2, 1), (2, 2), (2, 4)}


def test_a_manifest_is_whole_or_not_there(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    log.commit({"t": spark.range(2)}, expected=0)
    folder = tmp_path / "log" / "_commits"
    (folder / "_half-written").write_bytes(b"")  # of a writer that died before it named its manifest
    assert log.version() == 1 and log.read("t").count() == 2
    assert log.commit({"t": spark.range(1)}, expected=1) == 2 and log.read("t").count() == 3
    assert sorted(f for f in os.listdir(folder) if not f.startswith(".")) == [f"{1:020d}.json", f"{2:020d}.json", "_half-written"]
    (folder / f"{3:020d}.json").write_bytes(b"")  # from elsewhere: it isn't taken for a commit without changes
    with pytest.raises(BrokenLog):
        log.read("t")
    assert log.read("t", 2).count() == 3
    (folder / f"{3:020d}.json").unlink()
    (folder / f"{1:020d}.json").unlink()
    with pytest.raises(BrokenLog):
        log.read("t")


def test_two_writers_of_one_version(spark, tmp_path, monkeypatch):
    one, other = CommitLog(spark, str(tmp_path / "log")), CommitLog(spark, str(tmp_path / "log"))
    monkeypatch.setattr(other, "version", lambda: 0)  # it looked before the first was done
    one.commit({"t": spark.range(2)}, expected=0)
    with pytest.raises(StaleVersion):
        other.commit({"t": spark.range(5)}, expected=0)
    assert one.read("t").count() == 2 and one.version() == 1


def test_two_thousand_commits_are_one_scan(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    log.commit({"branches": spark.createDataFrame([("c", "main", "main", None)], transactions.BRANCHES)}, expected=0)
    for n in range(2, 2001):
        (tmp_path / "log" / "_commits" / f"{n:020d}.json").write_text('{"tables": {}, "note": ""}')
    scans, plain = [], CommitLog.view
    log.view = lambda version=None: scans.append(version) or plain(log, version)
    schema = "event_id string, campaign_id string, branch_id string, content string, ordinal int"
    none = {"new_facts": spark.createDataFrame([], "ordinal int, campaign_id string, branch_id string, fact_key string, memory_id string, kind string, subject string, subject_ref string, predicate string, content string"), "knowledge": spark.createDataFrame([], "ordinal int, campaign_id string, branch_id string, actor_id string, knowledge_key string, proposition string, event_id string")}
    events = spark.createDataFrame([("e9", "c", "main", "x", 1), ("e10", "c", "main", "y", 2)], schema)
    assert transactions.commit_continuity(log, 2000, events=events, **none) == 2001
    assert scans == [2000]
    assert [(r.event_id, r.sequence) for r in log.read("events").orderBy("sequence").collect()] == [("e9", 1), ("e10", 2)]


def test_postings_are_one_row_for_a_row_and_bucket(spark, tmp_path):
    index = SearchIndex(spark, str(tmp_path / "index"), COLUMNS)
    body = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(199)), lambda i: F.concat(F.lit("w"), (i * F.col("id") % 5).cast("string"))))
    rows = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("t").alias("title"), body.alias("body"))
    index.apply(0, rows)
    held = index.log.read("postings")
    # One row for all terms of a row in a bucket, with what the general operator counts.
    got = {(r.doc_id, t, n, r.dl) for r in held.collect() for t, n in zip(r.terms.split(" "), r.tfs, strict=True)}
    assert got == {(r.doc_id, r.term, r.tf, r.dl) for r in retrieval.postings(rows, "doc_id", COLUMNS).collect()}
    assert held.groupBy("doc_id", "bucket").count().where("count > 1").isEmpty()
