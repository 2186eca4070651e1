"""Listings, and ledger operators on the cases that the driver's tables don't have."""

import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import catalog, chunking, contracts, ledger
from palimpsest.sources.commits import CommitLog, StaleVersion


def test_search_filters(spark):
    rows = spark.createDataFrame([(1, "s", "a", "en", "p", True), (2, "s", "a", "de", "q", True), (3, "s", "b", "en", "p", True), (4, "t", "a", "en", None, True), (5, "s", "a", "en", "p", False)], "source_id int, system_id string, edition string, locale string, publication_id string, active boolean")
    ids = lambda df: sorted(r.source_id for r in df.collect())
    assert ids(catalog.searchable(rows)) == [1, 2, 3, 4]
    assert ids(catalog.searchable(rows, system_id="s", edition="a", locale="en")) == [1]
    assert ids(catalog.searchable(rows, publications=["p"], source_ids=[1, 2])) == [1]
    assert ids(catalog.searchable(rows, publications=[])) == []
    assert ids(catalog.sources(rows, system_id="s")) == [1, 2, 3] and ids(catalog.sources(rows, system_id="s", edition="a", include_retired=True)) == [1, 2, 5]


def test_citations_are_bound_to_their_source(spark):
    chunks, sections = spark.createDataFrame([(1, 10), (2, 20)], "chunk_id int, section_id int"), spark.createDataFrame([(10, 100), (20, 200)], "section_id int, source_id int")
    asked = spark.createDataFrame([(1, 100), (1, None), (2, 100), (3, 100), (None, None)], "chunk_id int, asked_source int")
    assert [r.outcome for r in catalog.citations(asked, chunks, sections).orderBy("chunk_id", "asked_source").collect()] == ["unknown", "bound", "bound", "other source", "unknown"]


def test_receipts_are_the_newest(spark):
    rows = spark.createDataFrame([(i, i % 3, "m" if i % 2 else "n", i) for i in range(20)], "receipt_id int, group_id int, mechanic_id string, created_at int")
    groups = spark.createDataFrame([(0, "x"), (1, "x"), (2, "y")], "group_id int, branch_id string")
    assert [r.receipt_id for r in catalog.receipts(rows, groups, branch_id="x", mechanic_id="m", limit=3).collect()] == [19, 15, 13]
    assert len(catalog.receipts(rows, groups, limit=0).collect()) == 1


def test_lineage_of_any_depth(spark):
    nodes = spark.range(5000).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_id"))
    walk = ledger.lineage(nodes, "4999").collect()
    assert sorted((r.depth, r.id) for r in walk) == [(d, str(4999 - d)) for d in range(5000)] and not any(r.error for r in walk)
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "id string, parent_id string")
    assert [tuple(r) for r in ledger.lineage(ring, "a").orderBy("depth").collect()] == [("a", 0, None), ("b", 1, None), ("c", 2, None), ("b", 3, "cycle")]
    assert ledger.lineage(ring, "z").count() == 0 and [r.id for r in ledger.lineage(spark.createDataFrame([("a", "a")], "id string, parent_id string"), "a").orderBy("depth").collect()] == ["a", "a"]


def test_recap_tells_null_from_absent(spark):
    before = spark.createDataFrame([(1, None), (2, "x"), (3, "x"), (4, "x")], "k int, v string")
    after = spark.createDataFrame([(1, "y"), (2, None), (3, "x"), (5, None)], "k int, v string")
    assert {r.k: r.change for r in ledger.recap(before, after, "k", "v").collect()} == {1: "changed", 2: "changed", 4: "removed", 5: "added"}


def test_duplicates_compare_columns(spark):
    rows = spark.createDataFrame([("a/b", "c"), ("a", "b/c"), ("x", None), (None, "x"), ("d", "e"), ("d", "e")], "p string, q string")
    assert [tuple(r) for r in contracts.duplicates(rows, ["p", "q"], "twice").collect()] == [("d/e", "twice")]


def test_copies_and_current_scene(spark):
    rows = spark.createDataFrame([(f"r{i}", f"r{i - 1}" if i else None, i * 10) for i in range(50)], "id string, parent_id string, sequence int")
    got = {r.id: (r.parent_id, r.sequence) for r in ledger.copy_revisions(rows, "b", 100).collect()}
    assert got == {f"b:r{i}": (f"b:r{i - 1}" if i else None, 101 + i) for i in range(50)}
    progress = spark.createDataFrame([(1, "party", "current", 9), (2, "me", "current", 1), (3, "me", "current", 2), (4, "me", "done", 8)], "id int, scope_id string, status string, updated_at int")
    assert [r.id for r in ledger.current_scene(progress, "me").collect()] == [3]
    assert [r.id for r in ledger.current_scene(progress, "you").collect()] == [1]
    assert ledger.current_scene(progress, "you", fallback=False).count() == 0


def test_chunks_are_slices_that_cover_the_text():
    rng = random.Random(2)
    for _ in range(300):
        body = "".join(rng.choice(["word ", "end. ", "。", "\n\n", "x" * 30, "\n"]) for _ in range(rng.randint(1, 200)))
        spans = list(chunking.windows(body, 0, len(body), 200, 20))
        assert all(b - a <= 200 and (a, b) == chunking.trimmed(body, a, b) for a, b in spans)
        covered = set().union(*(range(a, b) for a, b in spans))
        assert all(body[i].isspace() or i in covered for i in range(len(body)))


def test_commits_are_read_in_one_scan(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path / "log"))
    assert log.read("t") is None
    for n in range(3):
        log.commit({"t": spark.range(n, n + 1)}, expected=n)
    log.commit({"u": spark.range(1)}, expected=3)
    log.commit({"t": spark.range(9, 10)}, expected=4, replace=("t",))
    log.commit({"t": spark.range(10, 11)}, expected=5)
    ids = lambda v=None: sorted(r.id for r in log.read("t", v).collect())
    assert ids(2) == [0, 1] and ids(4) == [0, 1, 2] and ids() == [9, 10] and len(log.files("u")) == 1
    with pytest.raises(StaleVersion):
        log.commit({"t": spark.range(1)}, expected=2)


def test_a_marker_belongs_to_its_heading_however_far():
    text = "intro\n<!-- page: 3 -->" + "\n" * 900 + "# A\nx"
    assert [(h.begin, h.start) for h in chunking.outline(text)] == [(6, text.index("# A"))]
