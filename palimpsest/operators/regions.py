"""Reading order of positioned blocks by recursive cuts, and lines built from glyphs.

A region is cut along the axis on which its widest empty strip is widest, at all
strips about as wide; what is cut is cut again until no strip is left that
counts.  Strips are found by a sweep: in the order of their near edges, a block
that begins beyond all far edges so far begins a new part.  Every round sweeps
all regions of all pages at once, so columns in bands in columns, side bars and
boxes need rounds for their depth, not a task of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.sources.tables import dealt, durable

#: Least empty strip between columns and between bands, as shares of the page's width and height.
GUTTER, BAND = 0.018, 0.012
#: Strips of at least this share of a region's widest are cut in one round.
ALIKE = 0.75
#: Blank between glyphs of a line that parts words, as a share of the line's height.
WORD_GAP = 0.25
PAGE = ["document", "page"]


def _sweep(window, near: str, far: str) -> Column:
    """The empty strip before a block: how far its near edge lies beyond all far edges before it; null for the first."""
    return F.col(near) - F.max(far).over(window.orderBy(near, far, "block").rowsBetween(Window.unboundedPreceding, -1))


def regions(blocks: DataFrame) -> DataFrame:
    """Blocks (document, page, block, x0, y0, x1, y1, width, height, text) with `path`, the parts that the cuts put each in.

    Paths compare in reading order: columns from left to right, bands from top
    to bottom, whichever was cut first.  Blocks without an area, without text or
    with a null edge are left out.  Rounds go on while any region has a strip
    that counts, so there are as many as the deepest nesting.
    """
    own = blocks.where("x1 > x0 AND y1 > y0 AND trim(text) <> ''").withColumn("path", F.array().cast("array<int>"))
    done, rest = None, durable(own)
    while n := rest.count():
        rest = dealt(rest, *PAGE, rows=n)
        region = Window.partitionBy(*PAGE, "path")
        swept = rest.withColumns({"gap_x": _sweep(region, "x0", "x1") / (GUTTER * F.col("width")), "gap_y": _sweep(region, "y0", "y1") / (BAND * F.col("height"))})
        swept = swept.withColumns({"most_x": F.coalesce(F.max("gap_x").over(region), F.lit(0.0)), "most_y": F.coalesce(F.max("gap_y").over(region), F.lit(0.0))})
        across = (F.col("most_x") >= 1) & (F.col("most_x") >= F.col("most_y"))
        gap, most = F.when(across, F.col("gap_x")).otherwise(F.col("gap_y")), F.greatest("most_x", "most_y")
        cut = F.coalesce((gap >= 1) & (gap >= ALIKE * most), F.lit(False)).cast("int")
        order = region.orderBy(F.when(across, F.col("x0")).otherwise(F.col("y0")), F.when(across, F.col("x1")).otherwise(F.col("y1")), "block")
        swept = swept.withColumn("part", F.when(most >= 1, F.sum(cut).over(order).cast("int")))
        swept = durable(swept.select(*own.columns, "part"))
        whole = swept.where("part is null").drop("part")
        done = whole if done is None else done.unionByName(whole)
        rest = swept.where("part is not null").withColumn("path", F.concat("path", F.array("part"))).drop("part")
    return own if done is None else done


def lines(found: DataFrame) -> DataFrame:
    """document, page, line (from 1, in reading order) and text, from blocks or glyphs with their path.

    Within a part, blocks whose middle lies above a lower edge of those before
    them are on one line; they are read from left to right, with a space where
    the blank between two is a fair part of their height.
    """
    region = [*PAGE, "path"]
    down = Window.partitionBy(*region).orderBy("y0", "x0", "block")
    above = F.max("y1").over(down.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce((F.col("y0") + F.col("y1")) / 2 >= above, F.lit(False)).cast("int")
    own = found.withColumn("begins", begins).withColumn("row", F.sum("begins").over(down))
    along = Window.partitionBy(*region, "row").orderBy("x0", "x1", "block")
    blank = F.col("x0") - F.max("x1").over(along.rowsBetween(Window.unboundedPreceding, -1))
    own = own.withColumns({"space": F.when(blank >= WORD_GAP * (F.col("y1") - F.col("y0")), " ").otherwise(""), "place": F.row_number().over(along)})
    rows = own.groupBy(*region, "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat("space", "text").alias("text")))), lambda p: p["text"]), "").alias("text"))
    return rows.select(*PAGE, F.row_number().over(Window.partitionBy(*PAGE).orderBy("path", "row")).alias("line"), "text")


def page_text(blocks: DataFrame) -> DataFrame:
    """document, page and text, its lines in reading order; pages without usable blocks have none."""
    found = regions(blocks)
    told = lines(dealt(found, *PAGE, rows=found.count())).groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("line", "text"))).alias("lines"))
    return told.select(*PAGE, F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("text"))
