"""Snapshots bound to ledgers: capture, change, restore and verify, and refusals that change nothing."""

import pytest
from pyspark.sql import functions as F

from palimpsest.plans import timelines
from palimpsest.plans.transactions import BRANCHES, EVENTS, FACT_REVISIONS, HEADS, Refused
from palimpsest.sources.commits import CommitLog, StaleVersion

PROFILE = '{"system_id":"s","edition":"e","locale":"en","publications":"[]","options":"{}"}'


@pytest.fixture
def log(spark, tmp_path):
    own = CommitLog(spark, str(tmp_path / "log"))
    make = spark.createDataFrame
    own.commit(
        {
            "branches": make([("c", "main", "main", None), ("d", "main2", "x", None)], BRANCHES),
            "events": make([("e1", "c", "main", 1, "x", None), ("e2", "c", "main", 2, "y", None), ("z", "d", "main2", 1, "y", None)], EVENTS),
            "fact_heads": make([("main", "m1", 1), ("main", "m2", 1), ("main2", "m9", 1)], HEADS),
            "fact_revisions": make([("main", "m1", 1, "a"), ("main", "m2", 1, "b"), ("main2", "m9", 1, "c")], FACT_REVISIONS),
            "states": make([("p", 1, "alive"), ("q", 4, None)], timelines.STATES),
            "profiles": make([("c", 1, PROFILE)], timelines.PROFILES),
        },
        expected=0,
    )
    return own


def seen(log):
    view = log.view()
    return {c: sorted(map(tuple, df.select(*timelines.COLUMNS[c]).collect()), key=repr) for c, df in timelines.live(view, "c", "main").items()}


def change(spark, log, expected):
    make = spark.createDataFrame
    return log.commit(
        {
            "events": make([("e3", "c", "main", 3, "late", None)], EVENTS),
            "fact_heads": make([("main", "m1", 2), ("main", "m3", 1)], HEADS),
            "fact_revisions": make([("main", "m1", 2, "aa"), ("main", "m3", 1, "n")], FACT_REVISIONS),
            "states": make([("p", 2, "dead"), ("r", 1, "new")], timelines.STATES),
            "profiles": make([("c", 2, PROFILE.replace("en", "de"))], timelines.PROFILES),
        },
        expected=expected,
    )


def test_capture_change_restore_verify(spark, log):
    assert timelines.create_snapshot(log, 1, "c", "main", "s1", "first") == 2
    before = seen(log)
    assert timelines.verify(log, "s1").collect() == [] and timelines.dirty(log.view(), "c", "main") == {}
    change(spark, log, 2)
    assert timelines.dirty(log.view(), "c", "main") == {"dirty events": 1, "dirty facts": 3, "dirty profile": 2, "dirty states": 3}
    with pytest.raises(Refused) as refused:
        timelines.restore(log, 3, "c", "main", "s1")
    assert refused.value.outcomes["dirty facts"] == 3 and log.version() == 3
    timelines.create_snapshot(log, 3, "c", "main", "s2", "second")
    after = seen(log)
    assert timelines.restore(log, 4, "c", "main", "s1") == 5
    assert seen(log) == before and timelines.dirty(log.view(), "c", "main") == {}
    # Revisions only go forward, other branches stay, later events stay in their ledger.
    assert {(r.entity_id, r.revision) for r in log.read("states").collect()} == {("p", 3), ("q", 5)}
    assert log.read("fact_heads").where("branch_id = 'main2'").count() == 1 and log.read("events").count() == 4
    timelines.restore(log, 5, "c", "main", "s2")
    assert seen(log) == after
    assert all(timelines.verify(log, s).collect() == [] for s in ("s1", "s2"))
    assert log.read("snapshots").where("snapshot_id = 's2'").first().parent_id == "s1"
    assert {(r.event_id, r.snapshot_id) for r in log.read("event_commits").collect()} == {("e1", "s1"), ("e2", "s1"), ("e3", "s2")}


def test_snapshots_that_are_not_sound(spark, log):
    timelines.create_snapshot(log, 1, "c", "main", "s1", "first")
    assert [(r.collection, r.problem) for r in timelines.verify(log, "none").orderBy("collection").collect()] == [(c, "missing") for c in sorted(timelines.COLLECTIONS)]
    log.commit({"snapshot_states": spark.createDataFrame([("s1", "x", "forged")], timelines.SNAPSHOT_STATES), "snapshot_events": spark.createDataFrame([("s1", "nowhere")], timelines.SNAPSHOT_EVENTS)}, expected=2)
    assert {(r.collection, r.problem) for r in timelines.verify(log, "s1").collect()} == {("states", "digest differs"), ("events", "digest differs"), ("events", "no such event")}
    assert timelines.verify(log, "s1", 2).collect() == []
    for bad, why in (("s9", "missing snapshot"),):
        with pytest.raises(Refused) as refused:
            timelines.restore(log, 3, "c", "main", bad)
        assert refused.value.outcomes == {why: 1}
    with pytest.raises(Refused) as refused:
        timelines.create_snapshot(log, 3, "c", "main", "s1", "again")
    assert refused.value.outcomes == {"snapshot exists": 1}
    with pytest.raises(StaleVersion):
        timelines.create_snapshot(log, 2, "c", "main", "s3", "late")


def test_a_converted_branch(spark, log):
    timelines.create_snapshot(log, 1, "c", "main", "s1", "first")
    change(spark, log, 2)
    timelines.create_snapshot(log, 3, "c", "main", "s2", "second")
    new = {"system_id": "s", "edition": "e2", "locale": "fr", "publications": "[]", "options": "{}"}
    args = {"source": "main", "branch": "fork", "name": " Fork ", "child": "s3", "label": "converted"}
    for change_, why in (({"profile": {**new, "system_id": "t"}}, "another system"), ({"profile": {"system_id": "s"}}, "malformed"), ({"name": " "}, "malformed"), ({"child": "s2"}, "snapshot exists"), ({"branch": "main"}, "branch exists")):
        with pytest.raises(Refused) as refused:
            timelines.restore_converted(log, 4, "c", "s1", **({"profile": new} | args | change_))
        assert refused.value.outcomes == {why: 1} and log.version() == 4
    assert timelines.restore_converted(log, 4, "c", "s1", profile=new, **args) == 5
    view = log.view()
    fork = {c: sorted(map(tuple, df.select(*timelines.COLUMNS[c]).collect()), key=repr) for c, df in timelines.live(view, "c", "fork").items()}
    assert fork["events"] == [("e1",), ("e2",)] and fork["facts"] == [("m1", 1), ("m2", 1)] and fork["states"] == [("p", "alive"), ("q", None)]
    assert '"edition":"e2"' in fork["profile"][0][0] and timelines.dirty(view, "c", "fork") == {}
    assert all(timelines.verify(log, s).collect() == [] for s in ("s1", "s2", "s3"))
    assert view.read("snapshots").where("snapshot_id = 's3'").first().parent_id == "s1"
    assert view.read("snapshot_profiles").where("snapshot_id = 's1'").first().profile == PROFILE
    assert view.read("active").first().branch_id == "fork"


def test_digests_count_rows_and_not_their_order(spark):
    one = lambda *rows: timelines.digest(spark.createDataFrame(rows, "a string, b long").repartition(3), ["a", "b"]).first()
    assert one(("x", 1), ("y", None), ("x", 1)) == one(("x", 1), ("x", 1), ("y", None)) != one(("x", 1), ("y", None))
    assert one(("x", None)).digest != one((None, None)).digest
    assert timelines.digest(spark.createDataFrame([], "a string, b long"), ["a", "b"]).first().rows == 0


def test_collections_are_dealt_by_their_number(spark, log, monkeypatch):
    from palimpsest.sources import tables

    make = spark.createDataFrame
    own = {"events": make([(f"n{i}", "c", "main", i, "x", None) for i in range(60)], EVENTS), "fact_heads": make([("main", f"n{i}", 1) for i in range(60)], HEADS), "states": make([(f"n{i}", 1, "alive") for i in range(60)], timelines.STATES)}
    log.commit(own, expected=1)
    before = seen(log)
    monkeypatch.setattr(tables, "TASK_ROWS", 5)
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for name, df in timelines.live(log.view(), "c", "main").items():
        assert name == "profile" or df.select(F.spark_partition_id().alias("p")).distinct().count() > least, name
    assert seen(log) == before
    assert timelines.dirty(log.view(), "c", "main") == {"dirty events": 62, "dirty facts": 62, "dirty states": 62, "dirty profile": 1}
