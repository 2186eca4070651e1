"""Facts, rule packs, casts and whole transactions on the cases that the driver's tables don't have."""

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import text
from palimpsest.operators import cast, contracts, facts, layout, rulepacks
from palimpsest.plans import transactions
from palimpsest.plans.transactions import Refused
from palimpsest.sources.commits import CommitLog, StaleVersion

NEW = "ordinal int, campaign_id string, branch_id string, fact_key string, memory_id string, kind string, subject string, subject_ref string, predicate string, content string"


def fact(n, branch, key, kind="fact", subject=None, ref=None):
    return (n, "c", branch, key, f"m{n}", kind, subject, ref, None, f"text {n}")


def test_facts_of_one_batch_see_those_before(spark):
    rows = [fact(1, "a", "k"), fact(2, "b", "k", subject=""), fact(3, "a", " k "), fact(4, "c", "k", "rumour"), fact(5, "a", None), fact(6, "a", ""), fact(7, "a", "x" * 301), fact(8, "a", "s", "actor_state", ref="actor:7"), fact(9, "a", "t", "actor_state", ref="faction:7"), fact(10, "a", "u", None)]
    new = spark.createDataFrame(rows, NEW)
    none = spark.createDataFrame([], transactions.FACTS), spark.createDataFrame([], transactions.HEADS)
    got = {r.ordinal: (r.outcome, r.memory_id) for r in facts.add_facts(*none, new).collect()}
    assert got == {1: ("created", "m1"), 2: ("headed", "m1"), 3: ("exists", None), 4: ("identity", None), 5: ("created", "m5"), 6: ("invalid", None), 7: ("invalid", None), 8: ("created", "m8"), 9: ("invalid", None), 10: ("created", "m10")}
    assert facts.add_facts(*none, new.limit(0)).count() == 0


def test_citations_and_references(spark):
    events = spark.createDataFrame([("live", "c", "b", None), ("bound", "c", "x", "s"), ("other", "c", "x", None), ("foreign", "d", "b", None)], "event_id string, campaign_id string, branch_id string, committed_snapshot_id string")
    bound = spark.createDataFrame([("s", "bound"), ("s", "bound")], "snapshot_id string, event_id string")
    cited = spark.createDataFrame([(i, "c", "b", "s", e) for i, e in enumerate(["live", "bound", "other", "foreign", "gone", None])], "n int, campaign_id string, branch_id string, head_snapshot_id string, event_id string")
    assert [r.event_visible for r in facts.citable(cited, events, bound).orderBy("n").collect()] == [True, True, False, False, False, None]
    refs = spark.range(1).select(facts.active_refs(F.array(F.lit(" actor:1 "), F.lit("bad"), F.lit("actor:1")), F.lit(None).cast("array<string>"), F.array(F.lit("scene:x y"), F.lit("item:2"))).alias("r")).first().r
    assert refs == ["actor:1", "item:2"]


def test_bindings_are_exact(spark):
    row = ("b", "m", "s", "k", 1, 2, ["A"], "a" * 64, "text")
    schema = "binding_id string, module_id string, scene_id string, chunk_id string, page_start int, page_end int, heading_path array<string>, content_sha256 string, source_excerpt string"
    bad = [("c", None, " ", "k", 3, 2, None, "z", ""), ("d", "m", "s", "k", 0, None, [], "A" * 64, "x" * 2001)]
    found = {(r.subject, r.problem) for r in facts.binding_problems(spark.createDataFrame([row, *bad], schema)).collect()}
    assert {p for s, p in found if s == "c"} == {"the module is missing", "the scene is missing", "the pages are in the wrong order", "the headings are missing", "the digest is no SHA-256", "the excerpt needs 1 to 2000 characters"}
    assert {p for s, p in found if s == "d"} == {"a page is below 1", "the excerpt needs 1 to 2000 characters"} and not any(s == "b" for s, _ in found)


def test_addons_of_one_component_in_two_forms(spark):
    own = spark.createDataFrame([("x", "1", "rule_pack", "p", "1", "a"), ("x", "1", "rule_pack", "p", "1", None), ("y", "1", "rule_pack", "q", "1", "a")], "addon_id string, addon_version string, kind string, id string, version string, checksum string")
    there = spark.createDataFrame([("rule_pack", "p", "1", "a")], "kind string, id string, version string, checksum string")
    assert {r.addon_id: (r.components, r.wanting) for r in rulepacks.installable(own, there, there.limit(0)).collect()} == {"x": (2, 0), "y": (1, 1)}


def test_jobs_that_cannot_be_delivered_stay_due(spark):
    jobs = spark.createDataFrame([(i, "s", "c", "upsert", "pending", i, 0, "") for i in range(3)], "job_id int, system_id string, collection string, operation string, status string, created_at int, attempts int, error string")
    tried = spark.createDataFrame([(0, "deliver", None), (1, "failed", "gone")], "job_id int, outcome string, error string")
    after = contracts.settle_jobs(jobs, tried, "no route")
    assert [tuple(r) for r in after.select("job_id", "status", "attempts", "error").orderBy("job_id").collect()] == [(0, "failed", 1, "no route"), (1, "failed", 1, "gone"), (2, "pending", 0, "")]
    assert contracts.due_jobs(after, system_id="s", collection="c").count() == 3 and [r.job_id for r in contracts.due_jobs(after, system_id="s", collection="c", limit=1, job_ids=[1, 2]).collect()] == [1]
    with pytest.raises(ValueError):
        contracts.due_jobs(jobs, system_id="s", collection="c", limit=0)


def test_headings_and_chapters(spark):
    of = lambda c, *v: [r[0] for r in spark.createDataFrame([(x,) for x in v], "t string").select(c(F.col("t"))).collect()]
    assert of(text.chapter_label, "Ch. 3: Deep", "Chapter 12", "App. B - Maps", "Part 2", "Episodes 1 and 2", "Preface", "") == ["chapter:3", "chapter:12", "appendix:b", "part:2", "episode:1and2", None, None]
    assert of(layout.without_leader, "Gate ---", "Gate - - - -", "Gate -", "A ~~= _") == ["Gate", "Gate", "Gate -", "A"]
    page = spark.createDataFrame([("T H E  G A T E", ["T H E  G A T E", "He saw The Gate there", "thegate", "x"]), ("The Gate", ["y"]), ("T H E  E N D", [])], "h string, lines array<string>")
    assert [r[0] for r in page.select(layout.recover_spaced_heading(F.col("h"), F.col("lines"))).collect()] == ["thegate", "The Gate", "T H E  E N D"]
    contents = "Contents\n" + "\n".join(f"Chapter {i} The road ..... {i}" for i in range(1, 9))
    assert of(layout.is_contents_page, contents, "Contents\nChapter 1 x", "Chapter 1 x\n" * 9, "", None) == [True, False, False, False, False]


def test_recognised_pages(spark):
    good = "A clean line of plain text that is long enough to keep. "
    rows = spark.createDataFrame([(1, good, [(0.9,), (0.9,)]), (2, good, [(0.5,)]), (3, good, []), (4, "short", [(0.9,)]), (5, None, None), (6, "�" * 40, [(0.9,)])], "n int, t string, blocks array<struct<confidence:double>>")
    got = rows.select(layout.recognised_needs_fallback(F.col("t")).alias("a"), layout.layout_needs_fallback(F.col("t"), F.col("blocks")).alias("b")).collect()
    assert [(r.a, r.b) for r in got] == [(False, False), (False, True), (False, True), (True, True), (True, True), (True, True)]
    pages = spark.createDataFrame([("d", 1, "some text"), ("d", 2, "x" * 900), ("d", 3, " -- "), ("d", 4, "other")], "document string, page long, text string")
    matched = spark.createDataFrame([("d", p, None) for p in (1, 2, 3)] + [("d", 4, 0)], "document string, page long, line long")
    ordered = spark.createDataFrame([("d", 4)], "document string, page long")
    assert [r.page for r in layout.unmatched_outline_pages(pages, matched).orderBy("page").collect()] == [1, 2]
    assert [r.page for r in layout.outline_candidates(pages, matched, ordered).collect()] == [1]


def test_scene_fields_and_assets(spark):
    scenes = spark.createDataFrame([(1, {"a": "1"}), (2, None)], "scene_id int, metadata map<string,string>")
    changes = spark.createDataFrame([(1, " a ", "2", 1), (1, "a", "3", 2), (1, "tags", "x", 3), (1, "_x", "x", 4), (9, "a", "x", 5), (2, None, "x", 6)], "scene_id int, field string, value string, ordinal int")
    after, judged = cast.set_scene_fields(scenes, changes)
    assert {r.scene_id: r.metadata for r in after.collect()} == {1: {"a": "3"}, 2: {}}
    assert [r.outcome for r in judged.orderBy("ordinal").collect()] == ["set", "set", "canonical", "invalid", "missing", "invalid"]


@pytest.fixture
def log(spark, tmp_path):
    own = CommitLog(spark, str(tmp_path / "log"))
    own.commit({"branches": spark.createDataFrame([("c", "main", "main", None)], transactions.BRANCHES)}, expected=0)
    return own


def continuity(spark, events, new, known):
    return {"events": spark.createDataFrame([(*e, n) for n, e in enumerate(events)], "event_id string, campaign_id string, branch_id string, content string, ordinal int"), "new_facts": spark.createDataFrame(new, NEW), "knowledge": spark.createDataFrame(known, "ordinal int, campaign_id string, branch_id string, actor_id string, knowledge_key string, proposition string, event_id string")}


def test_continuity_is_all_or_nothing(spark, log):
    one = continuity(spark, [("e1", "c", "main", "x"), ("e2", "c", "main", "y")], [fact(1, "main", "k")], [(1, "c", "main", "a", "kk", "p", "e1"), (2, "c", "main", "a", "kl", "p", None)])
    assert transactions.commit_continuity(log, 1, **one) == 2
    assert [(r.event_id, r.sequence) for r in log.read("events").orderBy("sequence").collect()] == [("e1", 1), ("e2", 2)]
    for bad, why in (
        (continuity(spark, [("e3", "c", "main", "z")], [fact(2, "main", "k")], []), {"exists": 1}),
        (continuity(spark, [("e1", "c", "main", "z")], [], []), {"repeated event": 1}),
        (continuity(spark, [], [], [(1, "c", "main", "a", "new", "p", "nowhere"), (2, "c", "main", "a", "kk", "p", None)]), {"event": 1, "exists": 1}),
    ):
        with pytest.raises(Refused) as e:
            transactions.commit_continuity(log, 2, **bad)
        assert e.value.outcomes == why and log.version() == 2
    with pytest.raises(StaleVersion):
        transactions.commit_continuity(log, 1, **one)
    assert transactions.create_branch(log, 2, "c", "main", "side", "Side") == 3
    assert {(r.branch_id, r.memory_id) for r in log.read("fact_heads").collect()} == {("main", "m1"), ("side", "m1")}
    assert transactions.commit_continuity(log, 3, **continuity(spark, [("e3", "c", "side", "z")], [fact(5, "side", "other")], [(1, "c", "side", "a", "kn", "p", "e3")])) == 4
    for branch in ("side", "main"):
        with pytest.raises(Refused):
            transactions.create_branch(log, 4, "c", "gone" if branch == "main" else "main", "new" if branch == "main" else branch, "again")


def test_states_are_replaced_and_checked_out(spark, log):
    state = "entity_id string, revision long, state string"
    captures = spark.createDataFrame([("main", "x", 1, "one"), ("side", "x", 1, "two"), ("side", "y", 1, "new")], f"branch_id string, {state}")
    log.commit({"states": spark.createDataFrame([("x", 1, "one")], state), "captures": captures, "active": spark.createDataFrame([("c", "main", 1)], "campaign_id string, branch_id string, n long")}, expected=1)
    assert transactions.checkout(log, 2, "c", "side") == 3
    assert sorted(tuple(r) for r in log.read("states").select("entity_id", "revision", "state").collect()) == [("x", 2, "two"), ("y", 2, "new")]
    change = "entity_id string, ordinal int, expected long, state string"
    with pytest.raises(Refused) as e:
        transactions.replace_state(log, 3, spark.createDataFrame([("x", 1, 1, "three"), ("z", 1, None, "q")], change), branch="side", group="g", author="me")
    assert e.value.outcomes == {"conflict": 1, "missing": 1}
    assert transactions.replace_state(log, 3, spark.createDataFrame([("x", 1, 2, "three")], change), branch="side", group="g", author="me") == 4
    assert [(r.entity_id, r.before, r.after, r.sequence) for r in log.read("revisions").collect()] == [("x", "two", "three", 1)]
    with pytest.raises(Refused) as e:
        transactions.checkout(log, 4, "c", "main")
    assert e.value.outcomes == {"dirty": 1}


def test_systems_and_profiles():
    from palimpsest.functions.embeddings import Profile, choose_profile, configured_profiles
    from palimpsest.plans.systems import System, Systems

    own = Systems()
    for name in ("b", "a"):
        own.register(System(name, name.upper()))
    assert [s.id for s in own.all()] == ["a", "b"] and own.get("a").name == "A" and own.discover() == []
    with pytest.raises(ValueError):
        own.register(System("a", "another"))
    with pytest.raises(LookupError):
        own.get("c")
    known = {k: Profile(k, lang, 8) for k, lang in (("m", "multi"), ("z", "zh"))}
    assert [p.key for p in configured_profiles(" Z, m,zz ", known, {"zz": "z"})] == ["z", "m"] and [p.key for p in configured_profiles(None, known, default="m")] == ["m"]
    for bad in ("", "q"):
        with pytest.raises(ValueError):
            configured_profiles(bad, known)
    assert choose_profile([known["m"]], known, key="ZZ", aliases={"zz": "z"}).key == "z" and choose_profile([known["m"]], known, language="zh").key == "m"


def test_requests_of_a_stream_are_kept_once(spark, tmp_path):
    from palimpsest.streaming.ledgers import remember_requests

    schema = "scope string, key string, request_sha256 string, at int"
    log = CommitLog(spark, str(tmp_path / "log"))
    for n, rows in enumerate(([("s", "k", "a", 1), ("s", "k", "a", 2), ("s", "l", "b", 1)], [("s", "k", "a", 3), ("s", "l", "x", 4), ("t", "k", "z", 5)], [("s", "l", "x", 6)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        remember_requests(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), log, "requests", str(tmp_path / "state")).awaitTermination()
    assert sorted((r.scope, r.key, r.request_sha256) for r in log.read("requests").collect()) == [("s", "k", "a"), ("s", "l", "b"), ("t", "k", "z")]
    assert [(r.scope, r.key, r.request_sha256) for r in log.read("requests_conflicts").collect()] == [("s", "l", "x")]


def test_fields_are_dealt_by_their_number(spark, monkeypatch):
    from palimpsest.sources import tables

    monkeypatch.setattr(tables, "TASK_ROWS", 5)
    tasks = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    scenes = spark.range(60).select(F.col("id").alias("scene_id"), F.create_map(F.lit("a"), F.lit("b")).alias("metadata"))
    changes = scenes.select("scene_id", F.lit("f").alias("field"), F.lit("v").alias("value"), F.lit(1).alias("ordinal"))
    assert tasks(cast.set_scene_fields(scenes, changes)[0]) > least


def test_components_are_dealt_by_their_number(spark, monkeypatch):
    from palimpsest.operators import rulepacks
    from palimpsest.sources import tables

    monkeypatch.setattr(tables, "TASK_ROWS", 5)
    tasks = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Constant kinds and versions, and components without an id, which belong to no add-on.
    own = spark.range(60).select(F.col("id").alias("addon_id"), F.lit("1").alias("addon_version"), F.lit("pack").alias("kind"), F.when(F.col("id") < 58, F.col("id") % 7).alias("id"), F.lit("1").alias("version"), F.lit("a").alias("checksum"))
    there = spark.range(6).select(F.lit("pack").alias("kind"), "id", F.lit("1").alias("version"), F.when(F.col("id") == 2, "b").otherwise("a").alias("checksum"))
    told = rulepacks.installable(own, there, there.where("false"))
    assert told.columns == ["addon_id", "addon_version", "components", "wanting"]
    assert sorted((r.addon_id, r.components, r.wanting) for r in told.collect()) == [(i, 1, int(i % 7 in (2, 6))) for i in range(58)]
    assert tasks(told) > least
