"""Page geometry: reading order of positioned blocks, headings by size, and outline titles matched to lines."""

from __future__ import annotations

import re
from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import looks_letter_spaced, normalized_line
from palimpsest.operators.documents import page_quality

#: Ratios of a heading's height to the body's, and the level each gives; the least likeness of an outline title.
HEADING_RATIO, LEVELS = 1.35, ((1.8, 3), (1.4, 4))
STRUCTURAL_LIKENESS, OTHER_LIKENESS = 0.45, 0.68
#: Columns of a page, the least gutter as a share of its width, and the width of a block that spans columns.
MOST_COLUMNS, GUTTER, SPANNING = 4, 0.015, 0.6


def gutters(blocks: list[dict], width: float) -> list[float]:
    """Where columns part: the middles of the empty strips between blocks that don't span the page."""
    spans = sorted((b["x0"], b["x1"]) for b in blocks if b["x1"] - b["x0"] < SPANNING * width)
    found, edge = [], spans[0][1] if spans else 0.0
    for x0, x1 in spans:
        if x0 - edge >= GUTTER * width:
            found.append((edge + x0) / 2)
        edge = max(edge, x1)
    return found[: MOST_COLUMNS - 1]


def reading_order(blocks: list[dict], width: float) -> list[dict]:
    """Blocks by column, top to bottom, between the blocks that span the page."""
    cuts = gutters(blocks, width)
    if not cuts:
        return sorted(blocks, key=lambda b: (b["y0"], b["x0"]))
    wide = lambda b: b["x1"] - b["x0"] >= SPANNING * width or sum(b["x0"] < c < b["x1"] for c in cuts) > 0
    dividers = sorted((b for b in blocks if wide(b)), key=lambda b: (b["y0"], b["x0"]))
    rest = [b for b in blocks if not wide(b)]
    column = lambda b: sum((b["x0"] + b["x1"]) / 2 > c for c in cuts)
    band = lambda b: sum(d["y0"] <= b["y0"] for d in dividers)
    keyed = [((band(b), 1, column(b), b["y0"], b["x0"]), b) for b in rest] + [((n, 0, 0, d["y0"], d["x0"]), d) for n, d in enumerate(dividers, 1)]
    return [b for _, b in sorted(keyed, key=lambda x: x[0])]


def page_text(layouts: DataFrame) -> DataFrame:
    """document, page and text in reading order of (document, page, width, blocks); each page is read where it is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for r in frame.itertuples():
                own = [dict(b) if isinstance(b, dict) else b.asDict() for b in (r.blocks if r.blocks is not None else [])]
                rows.append((r.document, r.page, "\n".join(b["text"] for b in reading_order(own, float(r.width)))))
            yield pd.DataFrame(rows, columns=["document", "page", "text"])

    return layouts.select("document", "page", "width", "blocks").mapInPandas(run, "document string, page long, text string")


def visual_headings(lines: DataFrame) -> DataFrame:
    """document, page, title and level of lines (document, page, ordinal, text, height) much higher than the body's median.

    The median is that of each document's letters, so lines count by length.
    """
    body = lines.groupBy("document").agg(F.expr("percentile(height, 0.5, length(text))").alias("body"))
    ratio = F.col("height") / F.col("body")
    level = F.lit(5)
    for least, n in reversed(LEVELS):
        level = F.when(ratio >= least, n).otherwise(level)
    own = lines.join(body, "document").where((ratio >= HEADING_RATIO) & (F.length(F.trim("text")) > 0))
    return own.select("document", "page", "ordinal", F.trim("text").alias("title"), level.alias("level"))


def likeness(title: str, line: str) -> float:
    """Share of the shorter normalised text in the longer where it contains it, else the ratio of matching runs."""
    a, b = (re.sub(r"[^\w]+", "", x.casefold()) for x in (title, line))
    if not a or not b:
        return 0.0
    if a in b or b in a:
        return min(len(a), len(b)) / max(len(a), len(b))
    return SequenceMatcher(None, a, b).ratio()


def match_outline(pages: DataFrame, outline: DataFrame) -> DataFrame:
    """document, page, title, level, line and likeness of every outline entry (document, page, title, depth).

    The best line of the entry's own page holds, if it is like enough: chapters
    and appendices need less than others.  Lines are used once, in outline
    order; an entry without a line keeps its title and has none.
    """
    entries = outline.groupBy("document", "page").agg(F.array_sort(F.collect_list(F.struct("ordinal", "title", "depth"))).alias("entries"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            rows = []
            for r in frame.itertuples():
                lines, used = (r.text or "").split("\n"), set()
                for e in r.entries:
                    least = STRUCTURAL_LIKENESS if re.match(r"(?i)\s*(?:ch(?:apter|\.)|app(?:endix|\.))", e["title"]) else OTHER_LIKENESS
                    score, n = max(((likeness(e["title"], x), -k) for k, x in enumerate(lines) if k not in used), default=(0.0, 0))
                    hit = score >= least
                    used |= {-n} if hit else set()
                    rows.append((r.document, r.page, e["title"], min(6, e["depth"] + 1), -n if hit else None, round(score, 6)))
            yield pd.DataFrame(rows, columns=["document", "page", "title", "level", "line", "likeness"]).astype({"line": "Int64"})

    return pages.select("document", "page", "text").join(entries, ["document", "page"]).mapInPandas(run, "document string, page long, title string, level int, line long, likeness double")


def layout_repairs_spaces(embedded: Column, layout: Column) -> Column:
    """The same letters, with at least two more words and spaces."""
    bare = lambda x: F.regexp_replace(x, r"(?U)[^\p{L}\p{N}]+", "")
    count = lambda x, p: F.regexp_count(x, F.lit(p))
    return (bare(embedded) == bare(layout)) & (count(layout, r"\S+") >= count(embedded, r"\S+") + 2) & (count(layout, " ") >= count(embedded, " ") + 2)


def confident(layouts: DataFrame, least: float = 0.86) -> DataFrame:
    """Layouts with `accepted`: some text, and a mean confidence that is high enough."""
    mean = F.aggregate("blocks", F.lit(0.0), lambda a, b: a + b["confidence"]) / F.size("blocks")
    return layouts.withColumn("accepted", (F.size("blocks") > 0) & (mean >= least))


def cascade(layouts: DataFrame) -> DataFrame:
    """The layout of each page by the first provider that is confident, else by the most confident."""
    mean = F.aggregate("blocks", F.lit(0.0), lambda a, b: a + b["confidence"]) / F.greatest(F.size("blocks"), F.lit(1))
    n = F.row_number().over(Window.partitionBy("document", "page").orderBy(F.desc("accepted"), F.when(F.col("accepted"), F.col("priority")).asc_nulls_last(), F.desc(mean), "priority"))
    return confident(layouts).withColumn("__n", n).where("__n = 1").drop("__n")


#: Fixed value: how a line that begins a chapter looks.
CHAPTER_LINE = (
    r"(?i)^(?:(?:第[一二三四五六七八九十百0-9]+章|附录\s*[A-ZＡ-Ｚ])(?:\s|：|:)|"
    r"(?:Ch(?:apter)?\s*\.?|App(?:endix)?\s*\.?|Part|Episodes?)\s+"
    r"(?:[0-9A-Z]+(?:\s+and\s+[0-9A-Z]+)?)(?:\s|：|:|-))"
)
#: The least characters of a usable page, the most of one that is recognised for its outline alone, and words of a recovered heading.
LEAST_CHARS, MOST_OUTLINE_CHARS, MOST_HEADING_WORDS = 24, 800, 12


def recognised_score(text: Column) -> Column:
    """(clean, chars): 1 where no damage is seen, and the characters that are no white space; compared in this order."""
    q = page_quality(text)
    return F.struct(F.when(q["corrupt"] | q["fused"] | q["damaged"], 0).otherwise(1).alias("clean"), q["non_whitespace"].alias("chars"))


def recognised_needs_fallback(text: Column) -> Column:
    """Whether another provider should read the page: damage, or too little text."""
    score = recognised_score(text)
    return (score["clean"] == 0) | (score["chars"] < LEAST_CHARS)


def layout_needs_fallback(text: Column, blocks: Column, least: float = 0.86) -> Column:
    """The same of a layout, given with its text in reading order: also without blocks or with a mean confidence below `least`."""
    total = F.aggregate(blocks, F.lit(0.0), lambda a, b: a + b["confidence"].cast("double"))
    poor = F.coalesce(F.size(blocks) <= 0, F.lit(True)) | (total / F.greatest(F.size(blocks), F.lit(1)) < least)
    return recognised_needs_fallback(text) | poor


def unmatched_outline_pages(pages: DataFrame, matched: DataFrame) -> DataFrame:
    """document and page of pages with text of which some outline entry has no line; `matched` is of `match_outline`."""
    bare = matched.where(F.col("line").isNull()).select("document", "page").distinct()
    return pages.where(F.length(normalized_line(F.coalesce("text", F.lit("")))) > 0).join(bare, ["document", "page"], "left_semi").select("document", "page")


def outline_candidates(pages: DataFrame, matched: DataFrame, ordered: DataFrame) -> DataFrame:
    """The unmatched pages worth recognising anew: short, and not among those (document, page) put in order by their layout."""
    short = pages.where(page_quality(F.col("text"))["non_whitespace"] <= MOST_OUTLINE_CHARS)
    return unmatched_outline_pages(short, matched).join(ordered.select("document", "page").distinct(), ["document", "page"], "left_anti")


def recover_spaced_heading(heading: Column, lines: Column) -> Column:
    """A letter-spaced heading as it is spaced elsewhere on its page: of mentions with the same letters the one of fewest words, then the shortest, then the first."""
    target = normalized_line(heading)
    words = F.transform(F.filter(lines, lambda x: x != heading), lambda x: F.regexp_extract_all(x, F.lit("[A-Za-z]+(?:['’][A-Za-z]+)?"), F.lit(0)))

    def mentions(own: Column) -> Column:
        starts = F.when(F.size(own) > 0, F.sequence(F.lit(1), F.size(own))).otherwise(F.array().cast("array<int>"))
        runs = F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(MOST_HEADING_WORDS), F.size(own) - i + 1)), lambda n: F.array_join(F.slice(own, i, n), " ")))
        return F.filter(F.flatten(runs), lambda r: (normalized_line(r) == target) & ~looks_letter_spaced(r))

    found = F.flatten(F.transform(words, mentions))
    best = F.array_sort(F.transform(found, lambda r, i: F.struct(F.size(F.split(r, " ")).alias("words"), F.length(r).alias("chars"), i.alias("at"), r.alias("text"))))
    return F.when(looks_letter_spaced(heading) & (target != "") & (F.size(best) > 0), F.get(best, F.lit(0))["text"]).otherwise(heading)


def without_leader(heading: Column) -> Column:
    """A heading without the run of dashes, lines or waves that leads from it."""
    return F.trim(F.regexp_replace(heading, r"\s*(?:[-_=~]\s*){3,}$", ""))


#: Fixed values of pages of contents: lines of the head that names them and what it says, least lines, most characters of a
#: short line, and what counts as an entry: a chapter, or dots that lead to a page number.
CONTENTS_HEAD, CONTENTS_LINES, CONTENTS_CHARS, LEADER = 5, 8, 80, r"\.{3,}\s*\d+\s*$"
CONTENTS_NAME, CONTENTS_KEY = r"目录|\bcontents\b", "tableofcontents"
#: Enough chapters, enough leaders, and the share of short lines that chapters alone need.
CHAPTERS, LEADS, SHORT_SHARE = 2, 5, 0.75


def contents_entries(text: Column) -> Column:
    """struct(lines, short, chapters, leads): what the lines of a page are, counted in one fold; blank lines don't count."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\r\n]"), lambda x: F.trim(x)), lambda x: x != "")
    zero = F.struct(*[F.lit(0).alias(c) for c in ("lines", "short", "chapters", "leads")])

    def seen(acc: Column, x: Column) -> Column:
        more = {"lines": F.lit(1), "short": (F.length(x) <= CONTENTS_CHARS).cast("int"), "chapters": x.rlike(CHAPTER_LINE).cast("int"), "leads": x.rlike(LEADER).cast("int")}
        return F.struct(*[(acc[c] + n).alias(c) for c, n in more.items()])

    return F.aggregate(lines, zero, seen)


def is_contents_page(text: Column) -> Column:
    """A page of contents: its head says so, and its entries carry it, by many leaders or by chapters among mostly short lines."""
    filled = F.filter(F.split(F.coalesce(text, F.lit("")), r"\r\n|[\r\n]"), lambda x: F.trim(x) != "")
    head = F.lower(F.array_join(F.slice(filled, 1, CONTENTS_HEAD), " "))
    n = contents_entries(text)
    by_leaders = n["leads"] >= LEADS
    by_chapters = (n["chapters"] >= CHAPTERS) & (n["short"] >= SHORT_SHARE * n["lines"])
    return (n["lines"] >= CONTENTS_LINES) & (by_leaders | by_chapters) & (head.rlike(CONTENTS_NAME) | F.contains(normalized_line(head), F.lit(CONTENTS_KEY)))
