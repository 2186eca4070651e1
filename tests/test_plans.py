from pyspark.sql import functions as F

from palimpsest.operators import layout
from palimpsest.plans import context, ingestion, snapshots


def block(text, x0, y0, x1, y1, confidence=1.0):
    return {"text": text, "confidence": confidence, "x0": float(x0), "y0": float(y0), "x1": float(x1), "y1": float(y1)}


def test_columns_are_read_one_after_the_other(spark):
    page = [block("right 1", 520, 100, 900, 120), block("left 2", 50, 140, 450, 160), block("title", 40, 10, 950, 40), block("left 1", 60, 100, 440, 120), block("foot", 40, 900, 950, 920), block("right 2", 520, 140, 910, 160)]
    kind = "document string, page long, width double, priority int, blocks array<struct<text:string,confidence:double,x0:double,y0:double,x1:double,y1:double>>"
    rows = spark.createDataFrame([("d", 1, 1000.0, 1, page), ("d", 2, 1000.0, 1, [block("b", 10, 50, 800, 60, 0.2), block("a", 10, 10, 800, 20, 0.2)]), ("d", 2, 1000.0, 2, [block("c", 10, 50, 800, 60, 0.9)]), ("d", 3, 1000.0, 1, [])], kind)
    got = {r.page: r.text for r in layout.page_text(rows.where("priority = 1")).collect()}
    assert got == {1: "title\nleft 1\nleft 2\nright 1\nright 2\nfoot", 2: "a\nb", 3: ""}
    assert {r.page: r.priority for r in layout.cascade(rows).collect()} == {1: 1, 2: 2, 3: 1}


def test_headings_by_height_and_outline(spark):
    lines = spark.createDataFrame([("d", 1, 0, "Big Title", 20.0), ("d", 1, 1, "body " * 20, 10.0), ("d", 1, 2, "Middle", 15.0)], "document string, page long, ordinal int, text string, height double")
    assert sorted((r.title, r.level) for r in layout.visual_headings(lines).collect()) == [("Big Title", 3), ("Middle", 4)]
    pages = spark.createDataFrame([("d", 1, "CHAPTER 1: THE GATE OF\nnothing\nThe Old Library")], "document string, page long, text string")
    outline = spark.createDataFrame([("d", 1, 0, "Chapter 1: The Gate", 0), ("d", 1, 1, "Old Library", 1), ("d", 1, 2, "Elsewhere", 1)], "document string, page long, ordinal int, title string, depth int")
    assert [(r.title, r.line) for r in layout.match_outline(pages, outline).collect()] == [("Chapter 1: The Gate", 0), ("Old Library", 2), ("Elsewhere", None)]
    assert pages.select(layout.layout_repairs_spaces(F.lit("abcdefg"), F.lit("ab cd efg")).alias("r")).first().r


def test_snapshots(spark):
    rows = spark.createDataFrame([("c", 1, "x"), ("c", 2, None), ("d", 1, "y")], "campaign_id string, id int, v string")
    first = snapshots.capture({"facts": rows}, "campaign_id")
    assert snapshots.dirty(first, snapshots.capture({"facts": rows.repartition(3)}, "campaign_id")).count() == 0
    later = snapshots.capture({"facts": rows.where("id = 1")}, "campaign_id")
    assert [(r.campaign, r.change) for r in snapshots.dirty(later, first).collect()] == [("c", "changed")]
    assert snapshots.snapshot_documents(first).count() == 2
    live = spark.createDataFrame([("a", 7)], "k string, revision int")
    assert sorted(tuple(r) for r in snapshots.restore(live, spark.createDataFrame([("a", 3), ("b", 2)], live.schema), "k", "revision").collect()) == [("a", 8), ("b", 3)]
    held = spark.createDataFrame([("s1", None), ("s2", "s1"), ("s3", "s1")], "id string, parent_id string")
    assert [r.id for r in snapshots.deletable(held, spark.createDataFrame([("s3",)], "head_snapshot_id string")).collect()] == ["s2"]


def test_context_for_players(spark):
    facts = spark.createDataFrame([("f1", "gate", "r", "p", "the gate is open", 5, "active", "party"), ("f2", "gate", "r", "p", "the gate is cursed", 5, "active", "dm"), ("f3", "gate", "r", "p", "old gate", 1, "retired", "party")], "fact_key string, subject string, subject_ref string, predicate string, content string, importance int, status string, disclosure_scope string")
    events = spark.createDataFrame([(1, 1, "move", "they came to the gate", None, "party"), (2, 2, "plot", "a secret gate", None, "dm")], "event_id int, sequence int, event_type string, summary string, retrieval_text string, audience_scope string")
    known = spark.createDataFrame([("k1", "r", "believed", "the gate is shut", 3, "owner")], "knowledge_key string, subject_ref string, epistemic_status string, proposition string, confidence int, disclosure_scope string")
    got = context.context(facts, events, known, "gate", audience="player", limit=10, budget=5000).first()
    assert sorted(p["ledger"] for p in got.picked) == ["actor_knowledge", "events", "facts"] and got.used == sum(p["size"] for p in got.picked)
    assert len(context.context(facts, events, known, "gate", audience="dm", limit=10, budget=5000).first().picked) == 5


def test_changed_sources_are_retired(spark):
    held = spark.createDataFrame([("s", "a", "x", True), ("s", "b", "y", True)], "system_id string, source_key string, checksum string, active boolean")
    planned = ingestion.plan_sources(spark.createDataFrame([("s", "a", "new"), ("s", "c", "# H\nbody")], "system_id string, source_key string, text string"), held)
    assert {r.source_key: r.action for r in planned.collect()} == {"a": "retire", "c": "add"}
    assert sorted((r.source_key, r.active) for r in ingestion.retire(held, planned).collect()) == [("a@x", False), ("b", True)]
    assert sorted((r.source_key, r.content) for r in ingestion.chunk_table(planned).collect()) == [("a", "new"), ("c", "body")]


def test_conditional_changes(spark):
    from palimpsest.operators import records

    held = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "id string, revision int, name string")
    change = spark.createDataFrame([("a", 1, 2, "new"), ("a", 2, 2, "late"), ("b", 1, 5, "q"), ("c", 1, None, "q")], "id string, ordinal int, expected int, name string")
    got = {(r.id, r.ordinal): (r.outcome, r.revision, r.name) for r in records.compare_and_swap(held, change, "id", ["name"]).collect()}
    assert got == {("a", 1): ("applied", 3, "new"), ("a", 2): ("conflict", None, None), ("b", 1): ("conflict", None, None), ("c", 1): ("missing", None, None)}
    jobs = spark.createDataFrame([("j", "staged", 1), ("k", "activated", 4)], "job_id string, state string, revision int")
    steps = spark.createDataFrame([("j", "inspected", 1), ("k", "failed", 4)], "job_id string, target string, expected int")
    assert {r.job_id: (r.state, r.revision, r.error) for r in records.step_jobs(jobs, steps).collect()} == {"j": ("inspected", 2, None), "k": ("activated", 4, "no such transition")}


def test_one_scene_is_current(spark):
    from palimpsest.operators import records

    held = spark.createDataFrame([("p", "s1", "current", 50, 3), ("q", "s1", "current", 1, 1)], "scope_id string, scene_id string, status string, progress int, version int")
    change = spark.createDataFrame([("p", "s2", "current", 150, None), ("q", "s1", "done", 5, 9)], "scope_id string, scene_id string, status string, progress int, expected int")
    assert sorted(tuple(r) for r in records.set_progress(held, change).collect()) == [("p", "s1", "visited", 50, 4), ("p", "s2", "current", 100, 1), ("q", "s1", "current", 1, 1)]


def test_reviews(spark):
    from palimpsest.operators import records

    held = spark.createDataFrame([("j", "1", "pending", None, "{}", []), ("k", "1", "pending", None, "{}", [])], "job_id string, id string, review_status string, disposition string, artifact string, edits array<struct<before:string,after:string>>")
    made = spark.createDataFrame([("j", "1", "accepted", "include", None), ("k", "1", "accepted", "include", None), ("k", "9", "accepted", None, None)], "job_id string, id string, review_status string, disposition string, artifact string")
    after, problems = records.review_candidates(held, made)
    assert sorted((r.job_id, r.review_status, len(r.edits)) for r in after.collect()) == [("j", "accepted", 1), ("k", "pending", 0)]
    assert [tuple(r) for r in problems.collect()] == [("k", "9", "unknown candidate")] and [r.job_id for r in records.finalizable(after).collect()] == ["j"]


def test_bundles(spark):
    from palimpsest.operators import chunking
    from palimpsest.plans import packages

    sources = spark.createDataFrame([("s", "# A\none\n## B\ntwo 😀")], "source_key string, text string")
    chunks = packages.bundle_chunks(sources, chunking.parse_chunks(sources, "source_key", "text").select("source_key", "section", "ordinal", "start", "end"))
    assert packages.bundle_problems(sources, chunks).count() == 0
    assert {r.problem for r in packages.bundle_problems(sources.withColumn("text", F.concat(F.lit("x"), "text")), chunks).collect()} == {"the content differs"}
    tree = packages.portable_tree(chunking.parse_sections(sources, "source_key", "text"), chunks).first()
    assert [(s.title, len(s.chunks)) for s in tree.sections] == [("A", 1), ("B", 1)]
    assets = spark.createDataFrame([("p", "a", "0" * 64, 1), ("p", "a", "zz", 1)], "package_id string, asset_key string, sha256 string, size int")
    got = packages.package_problems(
        spark.createDataFrame([("p", "module", "1.0.0", "s")], "package_id string, kind string, version string, system_id string"), assets,
        spark.createDataFrame([("p", "k", "b")], "package_id string, source_key string, asset_key string"), spark.createDataFrame([("p", "x", None)], "package_id string, actor_id string, image_asset_key string"),
        spark.createDataFrame([("p", "actor", "y"), ("p", "source", "k")], "package_id string, kind string, ref string"),
    )
    assert {r.problem for r in got.collect()} == {"an asset's address is no SHA-256", "an asset is repeated", "unknown asset p|b", "unknown actor p|y"}
