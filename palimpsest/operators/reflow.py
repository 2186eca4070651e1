"""Structured text over page borders: lines become blocks, and a paragraph that a page cuts is one block.

Lines are classed by their own page.  Each page then gives a summary of one row:
whether its last paragraph is open, how many blocks it begins, and the chapter
in force at its end.  A window composes these summaries, not the lines, page by
page; only the lines that a page continues look their summary up.  So the work
of a document is spread over its pages, and one task sees a page's lines at most
or one short row a page.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import clean_line, line_joiner, normalized_line
from palimpsest.operators.headings import CJK_CHAPTER, TERMINAL, capitals_heading, chapter_heading, damaged_heading, keyed_heading, split_heading
from palimpsest.operators.layout import CHAPTER_LINE, is_contents_page, without_leader
from palimpsest.operators.outline import repeated_chapters

#: Lines of a page's edges, lines of its top, most characters of a heading, list items and their signs, and page numbers.
EDGE, TOP, HEADING_CHARS = 3, 5, 200
ITEM, SIGN, NUMBER = r"^(?:[-*•●▪◼]|\d+[.)、]|[A-Za-z][.)])\s*", r"^[•●▪◼]\s*", r"^\d{1,4}$"
LATIN_CHAPTER, LATIN_PART = r"(?i)^Chapter\s+[0-9A-Z]", r"(?i)^(?:Chapter|Appendix)\s+[0-9A-Z]"
#: Levels of chapters, keyed headings and headings in capitals.
CHAPTER, KEYED, CAPITALS = 1, 4, 5
PAGE = ["document", "page"]


def page_lines(pages: DataFrame, headings: DataFrame | None = None, margins: DataFrame | None = None, matched: DataFrame | None = None) -> DataFrame:
    """document, page, n, kind, level, text and body of every line of (document, page, text).

    Kinds: gap (blank), skip (margins, page numbers, the Latin half of a chapter
    title given twice), heading, item, body.  `headings` has (document, page,
    title, level) and gives levels to the first line of its page with the same
    letters; `margins` has (document, line) as `repeated_margin_lines` gives
    them; `matched` has the headings that `outline.match_outline` found: their
    levels hold, trusted ones are chapters, chapter lines that only repeat a
    trusted title are skipped, and synthetic ones come first on their page.
    `body` is prose that stood on a heading's line.  A page of contents
    has no headings.  A null text has one gap; an empty table gives none.  Of
    several rows of a page the least text counts; rows without a document or
    page are left out.
    """
    pages = pages.where(F.col("document").isNotNull() & F.col("page").isNotNull()).groupBy(*PAGE).agg(F.min("text").alias("text"))
    raw = pages.select(*PAGE, is_contents_page(F.col("text")).alias("contents"), F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n", -1)).alias("n", "raw"))
    own = raw.select(*PAGE, "contents", "n", clean_line(F.col("raw")).alias("line"))
    own = own.withColumns({"key": normalized_line(F.col("line")), "full": (F.col("line") != "").cast("int"), "chapter": (F.col("line").rlike(CHAPTER_LINE)).cast("int")})
    page, before, after = Window.partitionBy(*PAGE), Window.partitionBy(*PAGE).orderBy("n"), Window.partitionBy(*PAGE).orderBy(F.desc("n"))
    filled = F.when(F.col("full") == 1, F.col("line"))
    own = own.select(
        "*",
        F.sum("full").over(before).alias("rank"), F.sum("full").over(page).alias("lines"), F.sum("chapter").over(page).alias("chapters"),
        F.coalesce(F.last(filled, True).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit("")).alias("previous"),
        F.coalesce(F.last(filled, True).over(after.rowsBetween(Window.unboundedPreceding, -1)), F.lit("")).alias("next"),
    )
    own = own.withColumn("edge", (F.col("full") == 1) & ((F.col("rank") <= EDGE) | (F.col("rank") > F.col("lines") - EDGE)))
    repeated, hint = F.lit(False), F.lit(None).cast("int")
    if margins is not None:
        own = own.join(margins.select("document", F.col("line").alias("key"), F.lit(True).alias("repeated")).distinct(), ["document", "key"], "left")
        repeated = F.coalesce("repeated", F.lit(False))
    if headings is not None:
        hints = headings.groupBy(*PAGE, normalized_line(F.col("title")).alias("key")).agg(F.min(F.least(F.greatest(F.col("level").cast("int"), F.lit(1)), F.lit(6))).alias("hint")).where("key <> ''")
        nth = F.row_number().over(Window.partitionBy(*PAGE, "key").orderBy("n"))
        own = own.withColumn("nth", F.when(F.col("full") == 1, nth)).join(hints, [*PAGE, "key"], "left")
        hint = F.when(F.col("nth") == 1, F.col("hint"))
    known, trusted, again = F.col("line"), F.lit(False), F.lit(False)
    if matched is not None:
        repeats = repeated_chapters(own.select(*PAGE, "n", "line"), matched).withColumn("again", F.lit(True))
        there = matched.where("n >= 0").select(*PAGE, "n", F.col("level").alias("outlined"), "trusted", F.col("title").alias("outline_title"))
        own = own.join(there, [*PAGE, "n"], "left").join(repeats, [*PAGE, "n"], "left")
        known, trusted, again = F.coalesce("outline_title", "line"), F.coalesce("trusted", F.lit(False)), F.coalesce("again", F.lit(False))
        hint = F.coalesce("outlined", hint)
    bare = without_leader(known)
    own = own.withColumns({"bare": bare, "keyed": keyed_heading(bare), "split": split_heading(bare), "damaged": damaged_heading(bare), "opens": chapter_heading(bare)})
    line, keyed, split, damaged = (F.col(c) for c in ("bare", "keyed", "split", "damaged"))
    structural = ~F.col("contents")
    hint = F.when(structural & (~damaged | trusted) & (F.length(line) <= HEADING_CHARS), hint)
    confirmed = hint.isNotNull() | F.col("next").rlike(LATIN_PART) | ((F.col("rank") <= TOP) & (F.col("chapters") == 1))
    level = F.when(structural, F.when((F.col("opens") & confirmed) | (trusted & line.rlike(CHAPTER_LINE)), CHAPTER).when(keyed, F.coalesce(hint, F.lit(KEYED))).when(hint.isNotNull(), hint).when(~damaged & capitals_heading(line), CAPITALS))
    twice = structural & F.col("line").rlike(LATIN_CHAPTER) & F.col("previous").rlike(CJK_CHAPTER)
    own = own.withColumn("level", level)
    kind = (
        F.when(F.col("full") == 0, "gap")
        .when((F.col("edge") & (repeated | F.col("line").rlike(NUMBER))) | twice | again, "skip")
        .when(F.col("level").isNotNull(), "heading")
        .when(F.col("line").rlike(ITEM), "item")
        .otherwise("body")
    )
    text = F.when(F.col("kind") == "heading", F.when(keyed & (F.col("level") != CHAPTER), split["heading"]).otherwise(line)).when(F.col("kind") == "item", F.regexp_replace("line", SIGN, "- ")).otherwise(F.col("line"))
    beside = F.when((F.col("kind") == "heading") & keyed & (F.col("level") != CHAPTER), split["body"]).otherwise("")
    told = own.withColumn("kind", kind).select(*PAGE, "n", "kind", F.when(F.col("kind") == "heading", F.col("level")).alias("level"), text.alias("text"), beside.alias("body"))
    if matched is None:
        return told
    made = matched.where("n < 0").join(pages.select(*PAGE), PAGE, "left_semi")
    return told.unionByName(made.select(*PAGE, F.col("n").cast("int").alias("n"), F.lit("heading").alias("kind"), F.lit(CHAPTER).alias("level"), F.col("title").alias("text"), F.lit("").alias("body")))


def blocks(lines: DataFrame) -> DataFrame:
    """document, page, block, kind, level, chapter, lines, pages and text of the blocks that lines (of `page_lines`) make.

    A paragraph ends at a blank line, a heading, an item or a final stop; a page
    border, with blank lines and margins beside it, doesn't end it.  It belongs
    to the page that it begins on.  Wrapped lines are joined by a space, CJK
    lines by nothing, a hyphen before a Latin letter goes.  `chapter` is the
    last heading of level 1 before the block or in it.
    """
    beside = lines.where("body <> ''").select(*PAGE, "n", F.lit(1).alias("part"), F.lit("body").alias("kind"), F.lit(None).cast("int").alias("level"), F.col("body").alias("text"))
    rows = lines.where("kind <> 'skip'").select(*PAGE, "n", F.lit(0).alias("part"), "kind", "level", "text").unionByName(beside)
    order = Window.partitionBy(*PAGE).orderBy("n", "part")
    solid = F.col("kind") != "gap"
    ends = F.col("text").rlike(TERMINAL)
    rows = rows.select("*", F.lag("kind").over(order).alias("kind_before"), F.lag(ends).over(order).alias("ended"), F.sum(solid.cast("int")).over(order).alias("solids"))
    # The first block of a page may continue the last of an earlier one; all else is known on the page.
    first = solid & (F.col("solids") == 1)
    begins = solid & ~first & ((F.col("kind") != "body") | (F.col("kind_before") != "body") | F.col("ended"))
    rows = rows.withColumns({"first": first, "begins": begins}).withColumn("nth", F.sum(F.col("begins").cast("int")).over(order))

    page = rows.where(solid).groupBy(*PAGE).agg(
        F.max("nth").alias("begun"),
        F.max_by(F.col("kind") == "body", F.when(F.col("first"), 1).otherwise(0)).alias("may_continue"),
        F.max_by(F.struct((F.col("kind") == "body").alias("body"), ends.alias("ends")), F.struct("n", "part")).alias("last"),
        F.max(F.when(F.col("level") == CHAPTER, F.struct("n", "text"))).alias("title"),
    )
    so_far = Window.partitionBy("document").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    page = page.withColumn("continues", F.coalesce(F.col("may_continue") & F.lag(F.col("last.body") & ~F.col("last.ends")).over(Window.partitionBy("document").orderBy("page")), F.lit(False)))
    # A page that only continues has no block of its own; its lines belong where the paragraph began.
    own = F.when(~F.col("continues") | (F.col("begun") > 0), F.struct(F.col("page").alias("page"), (F.col("begun") + F.when(F.col("continues"), 0).otherwise(1)).alias("block")))
    page = page.select(*PAGE, "continues", F.last(own, True).over(so_far).alias("open"), F.last("title.text", True).over(so_far).alias("chapter_before"))

    told = rows.where(solid).join(page, PAGE)
    block = F.when(F.col("continues") & (F.col("nth") == 0), F.col("open")).otherwise(F.struct(F.col("page").alias("page"), (F.col("nth") + F.when(F.col("continues"), 0).otherwise(1)).alias("block")))
    upto = F.last(F.when(F.col("level") == CHAPTER, F.col("text")), True).over(Window.partitionBy(*PAGE).orderBy("n", "part"))
    told = told.select("document", block.alias("at"), F.coalesce(upto, "chapter_before").alias("chapter"), "page", "n", "part", "kind", "level", "text")
    parts = told.groupBy("document", "at").agg(
        F.array_sort(F.collect_list(F.struct("page", "n", "part", "text"))).alias("parts"), F.countDistinct("page").alias("pages"),
        *[F.min_by(c, F.struct("page", "n", "part")).alias(c) for c in ("kind", "level", "chapter")],
    )
    return parts.select("document", "at.page", "at.block", "kind", "level", "chapter", F.size("parts").alias("lines"), "pages", joined(F.transform("parts", lambda p: p["text"])).alias("text"))


def joined(lines: Column) -> Column:
    """Wrapped lines as one text, in time linear in it: what goes between two lines depends on these two alone."""
    after = F.concat(F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))), F.array(F.lit("")))
    hyphen = lambda a, b: a.endswith("-") & b.rlike("^[A-Za-z]")
    return F.array_join(F.zip_with(lines, after, lambda a, b: F.when(hyphen(a, b), F.substring(a, F.lit(1), F.length(a) - 1)).otherwise(F.concat(a, line_joiner(a, b)))), "")


def markdown(found: DataFrame, pages: DataFrame) -> DataFrame:
    """document, page and markdown of every page of `pages`, from blocks: its marker, then the blocks that begin on it."""
    quoted = F.when(F.col("kind") == "heading", F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "text")).when((F.col("kind") == "body") & F.col("text").rlike(r"^#{1,6}\s"), F.concat(F.lit("\\"), "text")).otherwise(F.col("text"))
    told = found.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("block", quoted.alias("text")))).alias("own"))
    mark = F.concat(F.lit("<!-- page: "), F.col("page").cast("string"), F.lit(" -->"))
    body = F.transform(F.coalesce("own", F.array().cast("array<struct<block:bigint,text:string>>")), lambda b: b["text"])
    return pages.select(*PAGE).distinct().join(told, PAGE, "left").select(*PAGE, F.array_join(F.concat(F.array(mark), body), "\n\n").alias("markdown"))


def structured_markdown(pages: DataFrame, headings: DataFrame, margins: DataFrame, matched: DataFrame | None = None) -> DataFrame:
    """document, page and markdown of every page of whole documents, without margins, page numbers and repeated headings."""
    return markdown(without_echoes(blocks(page_lines(pages, headings, margins, matched))), pages)


def without_echoes(found: DataFrame) -> DataFrame:
    """Blocks without headings that only repeat the end of the heading right before them."""
    order = Window.partitionBy(*PAGE).orderBy("block")
    own = normalized_line(F.col("text"))
    seen = found.withColumns({"kind_before": F.lag("kind").over(order), "key_before": F.lag(own).over(order)})
    echo = (F.col("kind") == "heading") & (F.col("kind_before") == "heading") & (own != "") & (F.length(own) < F.length("key_before")) & F.endswith("key_before", own)
    return seen.where(~F.coalesce(echo, F.lit(False))).drop("kind_before", "key_before")
