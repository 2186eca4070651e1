import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from palimpsest.functions import scoring, text
from palimpsest.operators import chunking


def one(spark, expression, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expression(F.col("v")).alias("r")).first().r


def brute_terms(value):
    low = value.lower().replace("ß", "ss")
    cjk = re.findall("[㐀-䶿一-鿿]", low)
    return re.findall(r"[A-Za-z0-9_'-]+", low) + cjk + ["".join(p) for p in zip(cjk, cjk[1:])]


@pytest.mark.parametrize("value", ["", "The Straße don't", "豁免 save 战斗", "a一b二c三", "foo_bar-baz"])
def test_terms(spark, value):
    assert one(spark, text.terms, value) == brute_terms(value)
    assert one(spark, text.term_count, value) == len(brute_terms(value))


def test_scores_count_substrings_and_cap_the_content(spark):
    row = spark.createDataFrame([("Art party", "art " * 20)], "t string, c string")
    got = row.select(scoring.lexical_score(text.terms(F.lit("art")), F.col("t"), F.col("c")).alias("s")).first().s
    assert got == pytest.approx((2 * 4 + 8) / math.sqrt(20))
    got = row.select(scoring.structured_score(text.terms(F.lit("art")), module_title=F.col("t"), content=F.col("c")).alias("s")).first().s
    assert got == pytest.approx((2 * 8 + 20) / math.sqrt(20))


def test_cosine_of_odd_vectors(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0]), ([0.0], [1.0]), ([3.0, 4.0], [3.0, 4.0]), ([], []), (None, [1.0])], "a array<double>, b array<double>")
    assert [r.s for r in rows.select(scoring.cosine_similarity(F.col("a"), F.col("b")).alias("s")).collect()] == [0.0, 0.0, pytest.approx(1.0), 0.0, 0.0]


@pytest.mark.parametrize("value,want", [("  Foo--Bar! ", "foo-bar"), ("", ""), ("ÄÖ", ""), ("Straße 12", "strasse-12")])
def test_slug(spark, value, want):
    assert one(spark, text.ascii_slug, value) == want


def test_slugify_falls_back_to_random_hex(spark):
    assert re.fullmatch("[0-9a-f]{12}", one(spark, text.slugify, "!!!"))


@pytest.mark.parametrize("value,want", [("hello", "en"), ("你好", "zh"), ("hello 你好世界", "mixed"), ("123", "mixed"), ("abcdefghijklmnopqrstuvwxyz 你", "zh")])
def test_language(spark, value, want):
    assert one(spark, text.detect_text_language, value) == want


def test_paths_and_keys(spark):
    rows = spark.createDataFrame([(["Ch 10", " ch 10 ", "", "Gate_A"],)], "p array<string>")
    got = rows.select(text.heading_path(F.col("p")).alias("h"), text.stable_key(F.col("p"), F.lit("t")).alias("k")).first()
    assert got.h == ["Ch 10", "Gate_A"] and got.k == "ch-10-ch-10-gate-a"


def test_page_markers(spark):
    body = "x\n<!-- page: 3 -->\ny\n<!-- page: 4 -->\nz"
    marks = one(spark, text.page_markers, body)
    assert [(m.start, m.page) for m in marks] == [(2, 3), (21, 4)]
    rows = spark.createDataFrame([(body, o) for o in (0, 2, 20, 21, 39)], "b string, o int")
    assert [r.p for r in rows.select(text.page_for_offset(text.page_markers(F.col("b")), F.col("o")).alias("p")).collect()] == [None, 3, 3, 4, 4]
    assert one(spark, text.strip_page_markers, body) == "x\ny\nz"


@pytest.mark.parametrize("heading,value,want", [("x", "| a |\n| b |", "table"), ("x", "> q", "blockquote"), ("x", "- a\n* b\nc", "list"), ("Appendix", "p", "reference"), ("x", "p", "narrative"), ("x", "", "narrative")])
def test_chunk_type(spark, heading, value, want):
    assert spark.createDataFrame([(heading, value)], "h string, t string").select(text.chunk_type(F.col("h"), F.col("t")).alias("k")).first().k == want
    assert chunking.kind_of(heading, value) == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["# A\n", "## B\n", "#### C \n", "text. more\n\n", "<!-- page: 2 -->\n", "x" * 300 + ". ", "语。" * 120, "\n", "😀"]), max_size=30))
def test_chunks_are_slices(parts):
    body = "".join(parts)
    for c in chunking.chunk_rows(body, 400, 40):
        assert body[c["start"] : c["end"]] == c["content"] == c["content"].strip()
    for s in chunking.section_rows(body):
        assert body[s["start"] : s["end"]] == s["content"] and s["path"][-1] == s["title"]


def test_windows_split_in_their_second_half():
    body = "a" * 150 + ". " + "b" * 300
    assert [body[a:b] for a, b in chunking.windows(body, 0, len(body), 200, 20)][0] == "a" * 150
    body = "a" * 50 + ". " + "b" * 300
    assert len(next(body[a:b] for a, b in chunking.windows(body, 0, len(body), 200, 20))) == 200


def test_sections_skip_levels_and_find_parents():
    body = "# A\n#### B\n#### C\n# A\n## D\n"
    found = chunking.sections(body)
    assert [s["path"] for s in found] == [["A"], ["A", "B"], ["A", "C"], ["A"], ["A", "D"]]
    assert chunking.parents(found) == [None, 0, 0, None, 3]
    assert chunking.sections("plain")[0]["title"] == "Document"
    with pytest.raises(ValueError, match="line 2"):
        chunking.sections("x\n# " + "y" * 501)


def test_modules(spark):
    body = "intro\n<!-- page: 5 -->\n# Ch1\n## Gate\ntext one\n## Library\n- a\n- b\n# Ch2\nlast"
    rows = spark.createDataFrame([("d", body)], "id string, body string")
    got = chunking.parse_modules(rows, "id", "body").orderBy("chapter", "scene", "ordinal").collect()
    assert [(r.chapter_title, r.scene_title, r.kind, r.page_start) for r in got] == [("Front Matter", "Front Matter", "narrative", None), ("Ch1", "Gate", "narrative", 5), ("Ch1", "Library", "list", 5), ("Ch2", "Ch2", "narrative", 5)]
    assert all(body[r.start : r.end] == r.content for r in got)
    many = "# C\n## S\n" + "".join(f"### s{i}\nx\n" for i in range(5))
    assert [t for t, _, _ in chunking.scene_spans("C", many)] == [f"s{i}" for i in range(5)]


def test_rows_of_a_batch_are_given_back_in_parts(spark):
    import pyarrow as pa
    from palimpsest.operators import chunking

    texts = [None if i == 3 else f"# A {i}\n" + "word. " * 400 for i in range(chunking.ROWS)]
    schema = pa.schema([("doc_id", pa.int64()), ("tokens", pa.int32())])
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    parts = list(chunking.parsed([batch], chunking.chunk_rows, ["tokens"], schema))
    want = [(i, r["tokens"]) for i, t in enumerate(texts) for r in chunking.chunk_rows(t or "")]
    assert [tuple(r.values()) for p in parts for r in p.to_pylist()] == want
    assert len(want) > chunking.ROWS >= max(p.num_rows for p in parts)
