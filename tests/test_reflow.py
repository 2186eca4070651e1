"""Headings by grammar and blocks over page borders, against plain versions."""

import random
import re

from pyspark.sql import functions as F

from palimpsest.operators import documents, headings, reflow


def of(spark, c, *values):
    return [r[0] for r in spark.createDataFrame([(x,) for x in values], "t string").select(c(F.col("t"))).collect()]


def test_keyed_headings(spark):
    lines = ["B1O. Gate of Iron. The door is shut.", "d l2. THE HALL --- dust lies here", "C3a. it is damp", "Day 4. They march on", "MAP 3. The Coast", "A5. of the many things that were said there", "K7. {Hall}", "12. Hall", "Ａ1. Hall", "第一章 开始", "D13．Library", "", None, "X1. 大厅", "E5. Hall,"]
    assert of(spark, headings.keyed_heading, *lines) == [True, True, True, True, False, False, False, False, False, False, True, False, False, False, False]
    got = [tuple(x) for x in of(spark, headings.split_heading, *lines[:-4])]
    assert got[0] == ("B10. Gate of Iron", "The door is shut.") and got[1] == ("D12. THE HALL", "dust lies here")
    assert got[2] == ("C3a", "it is damp") and got[3] == ("DAY4", "They march on") and got[4] == ("MAP3. The Coast", "")
    assert got[5] == ("A5", "of the many things that were said there") and got[7] == ("12. Hall", "") and got[10] == ("D13．Library", "")


def test_other_headings(spark):
    assert of(spark, headings.capitals_heading, "THE GATE", "T H E gate", "THE GATE!", "The Gate", "大厅", "A", "", None) == [True, True, False, False, False, False, False, None]
    assert of(spark, headings.chapter_heading, "Chapter 3: Deep", "Chapter 3 for an example", "Chapter 3: Deep .... 12", "第三章 深处", "Part B - x 9", "", None) == [True, False, False, True, False, False, None]
    assert of(spark, headings.damaged_heading, "a ~ b", "a.. b", "''''", "plain", "") == [True, True, True, False, False]


def plain_blocks(pages):
    """Blocks by one walk over the lines of a document: (page, kind, chapter, text)."""
    out, open_text, chapter = [], False, None
    for page, lines in pages:
        for n, (kind, text) in enumerate(lines):
            if kind == "gap":
                # Blank lines beside a page border don't close; others do.
                if any(k != "gap" for k, _ in lines[:n]) and any(k != "gap" for k, _ in lines[n:]):
                    open_text = False
            elif kind == "body" and open_text:
                last = out[-1]
                hyphen = last[3].endswith("-") and re.match("[A-Za-z]", text)
                last[3] = last[3][:-1] + text if hyphen else last[3] + ("" if last[3].endswith("-") else " ") + text
                open_text = not re.search(headings.TERMINAL, text)
            else:
                chapter = text if kind == "heading" else chapter
                out.append([page, kind, chapter, text])
                open_text = kind == "body" and not re.search(headings.TERMINAL, text)
    return [tuple(x) for x in out]


def test_blocks_are_those_of_a_walk(spark):
    rng = random.Random(9)
    documents_, rows = {}, []
    for d in range(12):
        own = []
        for page in sorted(rng.sample(range(1, 400), 60 if d else 300)):
            lines = []
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                kind = rng.choices(["gap", "body", "heading", "item"], [2, 6, 0.3, 0.5])[0]
                lines.append((kind, "" if kind == "gap" else rng.choice(["alpha", "be-", "gamma!", "4 delta", "end?"])))
            own.append((page, lines))
            rows += [(f"d{d}", page, n, k, 1 if k == "heading" else None, t, "") for n, (k, t) in enumerate(lines)]
        documents_[f"d{d}"] = plain_blocks(own)
    found = reflow.blocks(spark.createDataFrame(rows, "document string, page long, n int, kind string, level int, text string, body string")).collect()
    for d, want in documents_.items():
        got = sorted((r for r in found if r.document == d), key=lambda r: (r.page, r.block))
        assert [(r.page, r.kind, r.chapter, r.text) for r in got] == want
        numbers = {}
        for r in got:
            numbers[r.page] = numbers.get(r.page, 0) + 1
            assert r.block == numbers[r.page]


def test_a_paragraph_over_many_pages(spark):
    pages = spark.range(1, 3001).select(F.lit("d").alias("document"), F.col("id").alias("page"), F.when(F.col("id") % 1000 == 1, F.concat(F.lit("Chapter "), (F.col("id") / 1000 + 1).cast("int").cast("string"), F.lit(": Roads\n\nfirst-"))).when(F.col("id") % 1000 == 0, "last one.\nIs it so?\nNext").otherwise("Head\n\ngoes on\n\n12").alias("text"))
    margins = documents.repeated_margin_lines(pages, "document", "page", "text")
    assert [r.line for r in margins.collect()] == ["head", "goeson"] or {r.line for r in margins.collect()} == {"head", "goeson"}
    lines = reflow.page_lines(pages, None, margins.where("line = 'head'"))
    found = sorted(reflow.blocks(lines).collect(), key=lambda r: (r.page, r.block))
    assert [(r.page, r.kind, r.pages) for r in found] == [(1, "heading", 1), (1, "body", 1000), (1000, "body", 1), (1001, "heading", 1), (1001, "body", 1000), (2000, "body", 1), (2001, "heading", 1), (2001, "body", 1000), (3000, "body", 1)]
    assert found[1].text == "firstgoes on" + " goes on" * 997 + " last one. Is it so?" and found[1].chapter == "Chapter 1: Roads" and found[4].chapter == "Chapter 2: Roads"


def test_markdown_of_odd_pages(spark):
    text = "第一章 开始\nChapter 1: Start\n# not a heading\nB1O. Gate of Iron. It is\nshut\n- one\n• two\nTHE END\nEND\n3"
    pages = spark.createDataFrame([("d", 1, text), ("d", 2, "by day.\n大\n厅"), ("d", 3, None), ("d", 4, ""), ("e", 1, "x"), (None, 1, "y"), ("d", 4, "")], "document string, page long, text string")
    hints = spark.createDataFrame([("d", 1, "第一章 开始", 9), ("d", 2, "", 1)], "document string, page long, title string, level int")
    got = {(r.document, r.page): r.markdown for r in reflow.structured_markdown(pages, hints, spark.createDataFrame([], "document string, line string")).collect()}
    assert got["d", 1] == "<!-- page: 1 -->\n\n# 第一章 开始\n\n\\# not a heading\n\n#### B10. Gate of Iron\n\nIt is shut\n\n- one\n\n- two\n\n##### THE END".replace("##### THE END", "##### THE END")
    assert got["d", 2] == "<!-- page: 2 -->\n\nby day. 大厅" and got["d", 3] == "<!-- page: 3 -->" and got["d", 4] == "<!-- page: 4 -->" and got["e", 1].endswith("x")
    assert reflow.blocks(reflow.page_lines(pages.limit(0))).collect() == []
