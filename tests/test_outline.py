"""Outlines against a plain assignment, and what they do to structured text."""

import random
import re
from difflib import SequenceMatcher

import pytest

from palimpsest.operators import outline, reflow
from palimpsest.operators.layout import CHAPTER_LINE

OUTLINE = "document string, page long, ordinal int, title string, depth int"
key = lambda x: re.sub(r"[^\w]+", "", x.casefold())


def spaced(x):
    words = x.split()
    singles = sum(len(w) == 1 and w.isalpha() for w in words)
    return singles >= 3 and singles >= 0.3 * len(words)


def plain_line(title, lines):
    """The first of the lines most like a title, or None."""
    chapter, target, best, at = bool(re.match(CHAPTER_LINE, title.strip())), key(title), 0.0, None
    for n, line in enumerate(lines):
        own = key(line)
        if not own or not target:
            continue
        ratio = SequenceMatcher(None, target, own).ratio()
        if chapter and not re.match(CHAPTER_LINE, line) and not spaced(line) and ratio < 0.68:
            continue
        score = min(len(own), len(target)) / max(len(own), len(target)) if own in target or target in own else ratio
        if score > best:
            best, at = score, n
    return at if best >= (0.45 if chapter else 0.68) else None


def test_lines_are_those_of_a_plain_search(spark):
    rng = random.Random(2)
    words = ["gate", "iron", "hall", "of", "the", "deep", "C h a p", "Chapter 3: Iron", "Ch. 3 Gate", "Part B - Hall", "x"]
    pages, entries = [], []
    for page in range(1, 60):
        lines = [" ".join(rng.choices(words, k=rng.randint(0, 4))) for _ in range(rng.randint(1, 9))]
        pages.append(("d", page, "\n".join(lines)))
        for k in range(rng.randint(0, 3)):
            title = rng.choice([rng.choice(lines), rng.choice(lines).upper(), " ".join(rng.choices(words, k=3)), rng.choice(lines)[:6]])
            entries.append(("d", page, k, title, rng.randint(0, 3)))
    told, _ = outline.match_outline(spark.createDataFrame(pages, "document string, page long, text string"), spark.createDataFrame(entries, OUTLINE))
    got = {(r.page, r.ordinal): r.line for r in told.collect()}
    text = {p: t.split("\n") for _, p, t in pages}
    for _, page, k, title, _ in entries:
        if any(key(x) for x in text[page]):
            assert got[page, k] == plain_line(title, [re.sub(r"[ \t]+", " ", x).strip() for x in text[page]]), (title, text[page])
        else:
            assert (page, k) not in got


@pytest.fixture
def book(spark):
    late = "\n".join(f"line {i} goes on here." for i in range(10))
    pages = [
        (1, "Chapter 1: The Gate\nIt begins."), (2, "Chapter 1: The Gate\nrunning on."), (3, late + "\nChapter 2: Iron\nafter it."), (4, "nothing here.\nAppendix B: Maps\nshown."),
        (5, "T H E  H A L L\nis dark."), (6, "Gate and\nmore."), (7, None),
    ]
    entries = [(1, 0, "Ch .  1: The  Gate", 0), (3, 1, "Chapter 2: Iron", 0), (4, 2, "App. 8: Maps", 0), (5, 3, "The Hall", 1), (6, 4, "Gate and Bars", 2), (6, 5, "Chapter 9: Lost", 0), (9, 6, "No page", 0), (1, 7, "x" * 201, 0), (7, 8, "Empty", 0), (1, 9, None, 0)]
    return spark.createDataFrame([("d", *p) for p in pages], "document string, page long, text string"), spark.createDataFrame([("d", *e) for e in entries], OUTLINE)


def test_trust_depth_and_synthetic_chapters(spark, book):
    told, found = outline.match_outline(*book)
    assert {(r.page, r.ordinal): (r.line, r.synthetic) for r in told.collect()} == {(1, 0): (0, False), (3, 1): (10, True), (4, 2): (1, False), (5, 3): (0, False), (6, 4): (None, False), (6, 5): (None, True)}
    got = {(r.page, r.n): (r.level, r.trusted, r.title) for r in found.collect()}
    assert got == {(1, 0): (2, True, "Ch. 1: The Gate"), (3, -1): (1, True, "Chapter 2: Iron"), (4, 1): (2, True, None), (5, 0): (3, False, "The Hall"), (6, -1): (1, True, "Chapter 9: Lost")}


def test_markdown_with_an_outline(spark, book):
    pages, entries = book
    _, found = outline.match_outline(pages, entries)
    none = spark.createDataFrame([], "document string, page long, title string, level int"), spark.createDataFrame([], "document string, line string")
    got = {r.page: r.markdown.split("\n\n")[1:] for r in reflow.structured_markdown(pages, *none, found).collect()}
    assert got[1] == ["# Ch. 1: The Gate", "It begins. running on."] and got[2] == []
    assert got[3][0] == "# Chapter 2: Iron" and got[3][-1].endswith("line 9 goes on here. after it. nothing here.") and got[4] == ["# Appendix B: Maps", "shown."]
    assert got[5][0] == "### The Hall" and got[6][0] == "# Chapter 9: Lost" and got[7] == []


def test_lines_that_cannot_be_the_best_are_not_compared(spark):
    from pyspark.sql import functions as F

    lines = spark.createDataFrame([("d", 1, n, x, key(x), 0) for n, x in enumerate(["The Old Mill", "The Old Hill", "The Old Mills"])], "document string, page long, n int, line string, key string, above long")
    entries = spark.createDataFrame([("d", 1, 1, "The Old Mill", False)], "document string, page long, ordinal int, title string, chapter boolean")
    told = outline.line_scores(entries, lines).select("n", F.round("score", 3)).collect()
    assert sorted(map(tuple, told)) == [(0, 1.0), (2, round(10 / 11, 3))]
