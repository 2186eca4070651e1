"""Outline entries matched to the lines of their pages, with what a document's own chapters tell about trust.

Entries meet the lines of their own page only.  Lines that contain a title, or
are contained, are scored by length; for the rest the ratio of matching runs is
computed in Arrow batches, for pairs whose lengths alone don't rule them out.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.functions.text import chapter_identity, chapter_label, clean_line, looks_letter_spaced, normalized_line
from palimpsest.operators.layout import CHAPTER_LINE
from palimpsest.sources.tables import durable

#: How like a line must be to a chapter's entry and to another's, how like a title to be preferred, most
#: characters of a heading, lines above a chapter that make it late, deepest level, and when a line repeats a trusted title.
CHAPTER_LIKE, OTHER_LIKE, TITLE_LIKE, HEADING_CHARS, LATE, DEEPEST, LONG = 0.45, 0.68, 0.88, 200, 8, 4, 12
PAGE = ["document", "page"]


@F.pandas_udf(T.DoubleType())
def run_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the characters in matching runs over all characters; null where either is."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def outline_title(title: Column) -> Column:
    """White space collapsed, and no space before the stop of Ch. and App."""
    return F.regexp_replace(F.trim(F.regexp_replace(title, r"(?U)\s+", " ")), r"(?i)^(Ch|App)\s+\.", "$1.")


def usable(outline: DataFrame, lines: DataFrame) -> DataFrame:
    """Entries whose page has a line with letters and whose title is short enough for a heading; `chapter` says which name one."""
    there = lines.where("key <> ''").select(*PAGE).distinct()
    own = outline.withColumns({"clean": outline_title(F.col("title")), "chapter": F.trim("title").rlike(CHAPTER_LINE)})
    return own.where(F.length("clean") <= HEADING_CHARS).join(there, PAGE, "left_semi")


def line_scores(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """document, page, ordinal, n, score and the line of pairs of an entry and a line of its page that may be like enough, and may be the entry's best.

    For a chapter, lines that neither begin one nor are letter-spaced must have
    the ratio that other entries need.
    """
    pairs = entries.select(*PAGE, "ordinal", "chapter", normalized_line(F.col("title")).alias("target")).where("target <> ''")
    pairs = pairs.join(lines.where("key <> ''").select(*PAGE, "n", "key", "line", "above"), PAGE)
    small, large = F.least(F.length("target"), F.length("key")), F.greatest(F.length("target"), F.length("key"))
    within = F.contains("target", F.col("key")) | F.contains("key", F.col("target"))
    needs_ratio = F.col("chapter") & ~F.col("line").rlike(CHAPTER_LINE) & ~looks_letter_spaced(F.col("line"))
    least = F.when(F.col("chapter") & ~needs_ratio, CHAPTER_LIKE).otherwise(OTHER_LIKE)
    pairs = pairs.select("*", within.alias("within"), needs_ratio.alias("needs_ratio"), (small / large).alias("share"), least.alias("least"))
    # The ratio is at most twice the shorter length over both: shorter lines are ruled out before Python sees them.
    hopeful = F.when(F.col("within") & ~F.col("needs_ratio"), F.col("share") >= F.col("least")).otherwise(2 * small >= F.col("least") * (small + large))
    pairs = pairs.where(hopeful)
    # Nor does it see pairs whose bound can't come up to what a contained line of the entry has already; only equal texts reach 1.
    sure = F.max(F.when(F.col("within") & ~F.col("needs_ratio"), F.col("share"))).over(Window.partitionBy(*PAGE, "ordinal"))
    behind = (2 * small / (small + large) < F.col("sure")) | (F.col("sure") == 1)
    pairs = pairs.withColumn("sure", sure).where(F.col("within") | F.col("needs_ratio") | ~F.coalesce(behind, F.lit(False)))
    ratio = run_ratio(F.when(~F.col("within") | F.col("needs_ratio"), F.col("target")), F.col("key"))
    pairs = pairs.withColumn("ratio", ratio).where(~F.col("needs_ratio") | (F.col("ratio") >= OTHER_LIKE))
    return pairs.select(*PAGE, "ordinal", "n", F.when(F.col("within"), F.col("share")).otherwise(F.col("ratio")).alias("score"), "chapter", "line", "above")


def prefer_outline(line: Column, title: Column, trusted: Column, ratio: Column) -> Column:
    """Whether the outline's title replaces the line: where it repairs the line, or is trusted, but not a digit read for an appendix's letter."""
    a, b = normalized_line(line), normalized_line(title)
    misread = title.rlike(r"(?i)^App\.?\s*\d") & line.rlike(r"(?i)^Appendix\s+[A-Z]")
    fuller = (a != "") & (b != "") & ((F.contains(b, a) & (F.length(b) >= F.length(a) + 3)) | (title.rlike(CHAPTER_LINE) & (ratio >= TITLE_LIKE)))
    return F.when(looks_letter_spaced(line), True).when(misread, False).when(trusted, True).otherwise(F.coalesce(fuller, F.lit(False)))


def match_outline(pages: DataFrame, outline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, headings) of an outline (document, page, ordinal, title, depth), depths from 0, over pages (document, page, text).

    Entries: document, page, ordinal, title, matched, line, score, synthetic.
    An entry takes the line of its page that is most like it, the first of
    several; one line may serve several entries.  The least depth at which a
    document's outline names chapters is its structural depth.  Chapters of that
    depth are trusted; those whose line comes late on its page, and those
    without a line, become synthetic: they begin their page.

    Headings: document, page, n, level, trusted and title (null: as the line
    has it) of the lines matched, and n = -1 and up for synthetic chapters, of
    which each identity counts once a page.  Null titles and pages that aren't
    there match nothing.
    """
    text = F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n", -1)).alias("n", "raw")
    lines = pages.select(*PAGE, text).select(*PAGE, "n", clean_line(F.col("raw")).alias("line")).withColumn("key", normalized_line(F.col("line")))
    before = F.sum((F.col("line") != "").cast("int")).over(Window.partitionBy(*PAGE).orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    lines = lines.withColumn("above", F.coalesce(before, F.lit(0)))
    entries = usable(outline, lines)
    depth = entries.where("chapter").groupBy("document").agg(F.min("depth").alias("structural"))
    entries = entries.join(depth, "document", "left").withColumn("trusted", F.coalesce(F.col("chapter") & (F.col("depth") == F.col("structural")), F.lit(False)))

    best = line_scores(entries, lines).groupBy(*PAGE, "ordinal").agg(F.max_by(F.struct("n", "score", "line", "above"), F.struct("score", -F.col("n"))).alias("best"))
    found = entries.join(best, [*PAGE, "ordinal"], "left").withColumns({c: F.col(f"best.{c}") for c in ("n", "score", "line", "above")})
    enough = F.col("score") >= F.when(F.col("chapter"), CHAPTER_LIKE).otherwise(OTHER_LIKE)
    found = found.withColumn("matched", F.coalesce(enough, F.lit(False)))
    found = found.withColumn("synthetic", F.col("trusted") & (~F.col("matched") | (F.col("above") > LATE)))
    found = found.withColumn("ratio", run_ratio(normalized_line(F.when(F.col("matched") & ~F.col("synthetic"), F.col("line"))), normalized_line(F.col("clean"))))
    # One narrow row an entry, read for entries and headings.
    found = durable(found.drop("best"))

    told = found.select(*PAGE, "ordinal", "title", "matched", F.when(F.col("matched"), F.col("n")).alias("line"), F.when(F.col("matched"), F.round("score", 6)).alias("score"), "synthetic")
    hits = found.where("matched and not synthetic")
    preferred = F.when(prefer_outline(F.col("line"), F.col("clean"), F.col("trusted"), F.col("ratio")), F.col("ordinal"))
    on_lines = hits.groupBy(*PAGE, "n").agg(F.min(F.least(F.lit(DEEPEST), 2 + F.col("depth"))).cast("int").alias("level"), F.max("trusted").alias("trusted"), F.max_by("clean", preferred).alias("title"))
    made = found.where("synthetic").groupBy(*PAGE, chapter_identity(F.col("clean")).alias("identity")).agg(F.min(F.struct("ordinal", "clean")).alias("first"))
    place = F.row_number().over(Window.partitionBy(*PAGE).orderBy(F.desc("first.ordinal")))
    made = made.select(*PAGE, (-place).alias("n"), F.lit(1).alias("level"), F.lit(True).alias("trusted"), F.col("first.clean").alias("title"))
    return told, on_lines.select(*PAGE, "n", "level", "trusted", "title").unionByName(made)


def repeated_chapters(lines: DataFrame, headings: DataFrame) -> DataFrame:
    """document, page and n of chapter lines (document, page, n, line) that only repeat a trusted title of their document.

    They have its identity, or go on from a long one, or have its label and are
    much like it.  Trusted lines themselves aren't among them.
    """
    trusted = headings.where("trusted").select("document", F.col("page").alias("at_page"), F.col("n").alias("at"), "title")
    own = lines.select("document", F.col("page").alias("at_page"), F.col("n").alias("at"), "line")
    titles = trusted.join(own, ["document", "at_page", "at"], "left").select("document", F.coalesce("title", "line").alias("title")).distinct()
    titles = titles.select("document", chapter_identity(F.col("title")).alias("known"), chapter_label(F.col("title")).alias("known_label")).distinct()
    chapters = lines.where(F.col("line").rlike(CHAPTER_LINE)).join(headings.where("trusted").select(*PAGE, "n"), [*PAGE, "n"], "left_anti")
    chapters = chapters.select(*PAGE, "n", chapter_identity(F.col("line")).alias("identity"), chapter_label(F.col("line")).alias("label"))
    pairs = chapters.join(titles, "document")
    longer = (F.length("known") >= LONG) & (F.length("identity") > F.length("known")) & F.startswith("identity", F.col("known"))
    alike = (F.length("identity") >= LONG) & (F.length("known") >= LONG) & (F.col("label") == F.col("known_label"))
    pairs = pairs.withColumns({"sure": (F.col("identity") == F.col("known")) | longer, "alike": F.coalesce(alike, F.lit(False))}).where("sure or alike")
    ratio = run_ratio(F.when(~F.col("sure"), F.col("identity")), F.col("known"))
    return pairs.withColumn("ratio", ratio).where(F.col("sure") | (F.col("ratio") >= TITLE_LIKE)).select(*PAGE, "n").distinct()
