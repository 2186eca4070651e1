import hashlib

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import hashing
from palimpsest.operators import access, contracts, documents, ledger, reflow
from palimpsest.sources import archives, files, vectors
from palimpsest.sources.commits import CommitLog, StaleVersion


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_budget_passes_over_what_does_not_fit(spark):
    c = spark.createDataFrame([(1, 4.0, "facts", 0, 500), (1, 3.0, "facts", 1, 900), (1, 2.0, "events", 0, 300), (1, 1.0, "events", 1, 400)], "q int, score double, ledger string, index int, size int").withColumn("item", F.col("index"))
    got = ledger.budget_fold(c, ["q"], budget=10).first()
    assert got.used == 800 and [(p["ledger"], p["index"]) for p in got.picked] == [("facts", 0), ("events", 0)]
    with pytest.raises(ValueError):
        ledger.budget_fold(c, ["q"], budget=10, reserved=200_000)


def test_lineage_stops_at_cycles_and_gaps(spark):
    nodes = spark.createDataFrame([("a", "b", "x"), ("b", "a", "x"), ("c", "d", "x"), ("e", "f", "x"), ("f", None, "y")], "id string, parent_id string, owner string")
    walk = lambda s: [tuple(r) for r in ledger.lineage(nodes, s, owner="owner").orderBy("depth").collect()]
    assert walk("a") == [("a", 0, None), ("b", 1, None), ("a", 2, "cycle")]
    assert walk("c") == [("c", 0, None), ("d", 1, "missing")]
    assert walk("e") == [("e", 0, None), ("f", 1, "foreign")]


def test_undo_takes_the_latest_group_and_redo_the_next(spark):
    r = spark.createDataFrame([("1", "g1", 1, "applied"), ("2", "g2", 2, "applied"), ("3", "g2", 3, "applied"), ("4", "g3", 4, "undone"), ("5", "g4", 6, "undone")], "id string, group_id string, sequence int, status string").withColumns({"reversible": F.lit(True), "branch_id": F.lit("b")})
    assert [x.id for x in ledger.undo_group(r, "b").collect()] == ["3", "2"]
    assert [x.id for x in ledger.redo_group(r, "b").collect()] == ["4"]


def test_reviewed_edges_win(spark):
    kind = "a string, b string, bidirectional boolean, ordinal int"
    base = spark.createDataFrame([("x", "y", True, 1), ("x", "z", False, 2)], kind)
    got = ledger.merge_edges(base, spark.createDataFrame([("y", "x", True, 0), ("z", "x", False, 1)], kind))
    assert rows(got, "a", "b") == [("x", "z"), ("y", "x"), ("z", "x")]


def test_progress_migrates_by_key_or_ruling(spark):
    progress = spark.createDataFrame([("o1", "p"), ("o2", "p"), ("o3", "p")], "scene_id string, scope_id string")
    old = spark.createDataFrame([("o1", "k1"), ("o2", "k2"), ("o3", "k3")], "scene_id string, stable_key string")
    new = spark.createDataFrame([("n1", "k1"), ("n9", "k9")], "scene_id string, stable_key string")
    ruling = spark.createDataFrame([("o2", "n9")], "old_scene_id string, new_scene_id string")
    assert rows(ledger.migrate_progress(progress, old, new, ruling), "old_scene_id", "new_scene_id", F.coalesce("error", F.lit(""))) == [("o1", "n1", ""), ("o2", "n9", ""), ("o3", None, "unmapped")]


def test_audiences(spark):
    e = spark.createDataFrame([(1, "dm"), (2, "public"), (3, "actor"), (4, "actor")], "event_id int, audience_scope string")
    known = spark.createDataFrame([(3,), (3,)], "event_id int")
    assert rows(ledger.audience_events(e, "player", known), "event_id") == [(2,), (3,)]
    assert ledger.audience_events(e, "dm").count() == 4
    with pytest.raises(ValueError):
        ledger.audience_events(e, "all")


def test_documents_fail_closed():
    value = {"b": [1.0, "é"], "a": None}
    doc = hashing.encode_document(value)
    assert hashing.decode_document(doc) == value and doc["id"] == hashlib.sha256('{"a":null,"b":[1.0,"é"]}'.encode()).hexdigest()
    for change in ({"size": doc["size"] - 1}, {"id": "0" * 64}, {"codec": "raw"}, {"payload": doc["payload"][:-3]}, {"payload": b"x"}):
        with pytest.raises(ValueError):
            hashing.decode_document(doc | change)


def test_document_columns(spark):
    df = spark.createDataFrame([('{"b": 1.0, "a": "é"}',), ("{}",)], "j string").withColumn("e", hashing.encoded_document(F.col("j")))
    got = df.select(hashing.decoded_document("e.id", "e.codec", F.col("e.size") + 1, "e.payload").alias("bad"), hashing.decoded_document("e.id", "e.codec", "e.size", "e.payload").alias("d")).collect()
    assert [r.d.value for r in got] == ['{"a":"é","b":1.0}', "{}"] and all(r.bad.error for r in got)


def test_responses_and_contexts():
    big = {"x": "a" * 100_000}
    assert hashing.public_response(hashing.stored_response(big)) == big and hashing.stored_response({"a": 1}) == {"a": 1}
    fields = dict.fromkeys(access.FIELDS, "v") | {"issued_at": "2024-01-01T00:00:00+00:00"}
    signed = access.sign_context(b"k", **fields)
    assert access.verify_context(signed, b"k", max_age=60, now=1704067230, campaign_id="v") == fields
    for bad, now in ((signed | {"nonce": "w"}, 1704067230), (signed, 1704067400), (signed, 1704067100)):
        with pytest.raises(ValueError):
            access.verify_context(bad, b"k", max_age=60, now=now)
    guard = access.NonceGuard(60)
    guard.remember("n", 0)
    with pytest.raises(ValueError):
        guard.remember("n", 30)
    guard.remember("n", 100)


def test_commits_swap_versions(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/log")
    one, two = spark.range(2), spark.range(5, 6)
    assert log.read("t") is None
    assert log.commit({"t": one, "u": two}, expected=0) == 1
    assert log.commit({"t": two}, expected=1) == 2
    with pytest.raises(StaleVersion):
        log.commit({"t": one}, expected=1)
    assert sorted(r.id for r in log.read("t").collect()) == [0, 1, 5] and log.read("t", 1).count() == 2
    log.commit({"t": one}, expected=2, replace=("t",))
    assert log.read("t").count() == 2 and log.read("u").count() == 1


def test_archives(spark):
    blob = b"content"
    name = hashlib.sha256(blob).hexdigest()
    made = archives.dumps({"id": "p"}, {name: blob})
    assert made == archives.dumps({"id": "p"}, {name: blob})
    package, blobs = archives.loads(made)
    assert package["id"] == "p" and blobs == {name: blob}
    for bad in (b"no zip", made[:-30], made.replace(b"content", b"kontent")):
        with pytest.raises(ValueError):
            archives.loads(bad)
    got = archives.archive_entries(spark.createDataFrame([("a", bytearray(made)), ("b", bytearray(b"x"))], "path string, content binary")).collect()
    assert [(r.path, r.entry, r.error) for r in got] == [("a", "package.json", None), ("a", name, None), ("b", None, "no archive")]


def test_pack_problems(spark):
    packs = spark.createDataFrame([("a.b", "1.0.0", "s", None), ("BAD", "1", "", "x")], "pack_id string, version string, system_id string, namespace string")
    needs = spark.createDataFrame([("a.b", "a.b", None, None)], "pack_id string, depends_on string, version string, checksum string")
    mechanics = spark.createDataFrame([("a.b", "a.b.m", "e", True), ("a.b", "a.b.m", "", False)], "pack_id string, id string, event string, declared boolean")
    cards = spark.createDataFrame([("a.b", "a.b.x", "k", "n", ["a.b.m", "a.b.q"])], "pack_id string, id string, kind string, name string, refs array<string>")
    got = {(r.subject, r.problem) for r in contracts.validate_packs(packs, needs, mechanics, cards).collect()}
    assert {("a.b", "it depends on itself"), ("a.b/a.b.m", "a mechanic is repeated"), ("a.b", "unknown mechanic a.b|a.b.q"), ("BAD", "the version isn't x.y.z"), ("a.b", "a mechanic has no event")} <= got


def test_patched_mechanics_give_way(spark):
    active = spark.createDataFrame([("a.b", "1.0.0", "x"), ("a.c", "1.0.0", "y")], "pack_id string, version string, checksum string")
    versions = active.withColumns({"status": F.lit("installed"), "editions": F.array(F.lit("e"))})
    none = spark.createDataFrame([], "pack_id string, depends_on string, version string, checksum string")
    clash = spark.createDataFrame([], "pack_id string, conflicts_with string")
    mechanics = spark.createDataFrame([("a.b", "m", "h", None, None), ("a.c", "p", "i", "m", "h")], "pack_id string, id string, checksum string, patch_target string, patch_checksum string")
    bad, force = contracts.resolve_ruleset(active, versions, none, clash, mechanics, "e")
    assert bad.count() == 0 and rows(force, "id") == [("p",)]
    assert contracts.resolve_ruleset(active, versions, none, clash, mechanics, "f")[0].count() == 2
    stale = mechanics.withColumn("patch_checksum", F.when(F.col("id") == "p", "z"))
    assert rows(contracts.resolve_ruleset(active, versions, none, clash, stale, "e")[0], "problem") == [("the patch checksum differs",)]


def test_pages(spark):
    pages = spark.createDataFrame([("d", p, f"Running Head\nbody {p} text\nmore\n{p}") for p in range(1, 6)], "document string, page long, text string")
    assert rows(documents.repeated_margin_lines(pages, "document", "page", "text"), "line", "pages") == [("more", 5), ("runninghead", 5)]
    quality = documents.document_quality(pages.unionByName(spark.createDataFrame([("d", 6, "\x02" * 30)], pages.schema)), "document", "page", "text").first()
    assert quality.pages == 6 and 6 in quality.corrupt_pages
    text = "Running Head\nbody 1 text\nmore\n1"
    sha = hashlib.sha256(text.encode()).hexdigest()
    edits = spark.createDataFrame([("d", 1, sha, 1, "body 1", "BODY 1"), ("d", 2, sha, 1, "body", "x"), ("d", 3, hashlib.sha256(text.replace("1", "3").encode()).hexdigest(), 1, "none", "x")], "document string, page long, base_sha256 string, ordinal int, old string, new string")
    got = {r.page: (r.edits, r.error) for r in documents.apply_page_revisions(pages, edits).collect()}
    assert got[1] == (1, None) and got[2][1] == "base text differs" and got[3][1] == "old text isn't there exactly once" and got[4] == (0, None)
    heads = spark.createDataFrame([("d", 1, "Body 1 Text", 2)], "document string, page long, title string, level int")
    out = reflow.structured_markdown(pages, heads, documents.repeated_margin_lines(pages, "document", "page", "text")).where("page = 1").first().markdown
    assert out == "<!-- page: 1 -->\n\n## body 1 text"


def test_vectors(spark):
    held = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "id string, embedding array<double>")
    new = spark.createDataFrame([("b", [1.0, 1.0]), ("c", [0.5, 0.1])], held.schema)
    assert rows(vectors.upsert(held, new), "id") == [("a",), ("b",), ("c",)]
    assert [r.id for r in vectors.query(vectors.upsert(held, new), [1.0, 0.0], 2).collect()] == ["a", "c"]
    assert rows(vectors.delete(held, where=F.col("id") == "a"), "id") == [("b",)]
    with pytest.raises(ValueError):
        vectors.delete(held)


def test_grants_and_files(spark, tmp_path):
    kind = "campaign_id string, principal_id string, actor_id string, can_control boolean, can_view_private boolean"
    got = access.upsert_grants(spark.createDataFrame([("c", "p", "a", True, False)], kind), spark.createDataFrame([("c", "p", "a", None, True), ("c", "q", "a", True, None)], kind))
    assert rows(got, *[x.split(" ")[0] for x in kind.split(", ")]) == [("c", "p", "a", True, True), ("c", "q", "a", True, False)]
    (tmp_path / "x.md").write_text("# H\nbody")
    (tmp_path / "y.csv").write_text("no")
    found = files.read_text(files.read_documents(spark, str(tmp_path))).collect()
    assert [(r.text, r.headings) for r in found] == [("# H\nbody", 1)]


def test_streams(spark, tmp_path):
    from palimpsest.streaming import ledgers

    source, seen = tmp_path / "in", []
    spark.range(5).select("id", F.timestamp_seconds(F.col("id") + 1000).alias("at")).write.parquet(str(source))
    stream = spark.readStream.schema("id long, at timestamp").parquet(str(source))
    ledgers.append_ledger(ledgers.without_replays(stream, "at", ["id"], "1 hour"), str(tmp_path / "out"), str(tmp_path / "c1")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    ledgers.drain_outbox(stream, str(tmp_path / "c2"), lambda df, n: seen.append(df.count())).awaitTermination(60)
    assert sum(seen) == 5
