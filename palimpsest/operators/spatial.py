"""Reviewed connections between the locations of a module: a graph whose ends are told apart across scenes, and what is reached in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.sources.tables import dealt, durable

#: Kinds of connections, media that show them, modes of a review, most connections of one and characters of an observation.
KINDS = ("passage", "door", "secret_door", "stairs", "portal", "other")
MEDIA = ("application/pdf", "image/png", "image/jpeg")
MODES = ("merge", "replace")
MOST_CONNECTIONS, MOST_OBSERVATION = 500, 500
EDGE = ["scene_id", "from", "to", "bidirectional", "kind", "observation", "asset_id", "asset_checksum", "page", "reviewer", "branch_id"]


def _blank(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) == ""


def _first(*cases: tuple[Column, str]) -> Column:
    """The name of the first case that holds, or null; a null condition doesn't hold."""
    out = None
    for when, name in cases:
        out = F.when(when, name) if out is None else out.when(when, name)
    return out


def resolved(locations: DataFrame) -> DataFrame:
    """module_id, key and places: how many locations of a module's scenes (module_id, scene_id, key) have a key."""
    return dealt(locations.where("key is not null and key <> ''").select("module_id", "key"), "module_id", "key", rows=locations.count()).groupBy("module_id", "key").agg(F.count("*").alias("places"))


def judged_reviews(reviews: DataFrame, connections: DataFrame, scenes: DataFrame, locations: DataFrame, assets: DataFrame) -> DataFrame:
    """review_id and problem of every review, null where it can be applied; the first problem that it has, then its first bad connection's.

    reviews (review_id, ordinal, scene_id, mode, asset_id, page, reviewer,
    branch_id), connections (review_id, ordinal, from, to, bidirectional, kind,
    observation), scenes (scene_id, module_id), assets (asset_id, module_id,
    media_type, page_count, source_page, checksum).  A null mode merges, a null
    kind is a passage.  The asset must be of the scene's module and have the
    page; each end must be the key of exactly one location of the module, in
    whichever scene.
    """
    n, m = reviews.count(), connections.count()
    own = dealt(reviews, "scene_id", rows=n).join(scenes.select("scene_id", "module_id"), "scene_id", "left")
    own = dealt(own, "asset_id", rows=n).join(assets.select("asset_id", F.col("module_id").alias("asset_module"), "media_type", "page_count", "source_page"), "asset_id", "left")
    pdf = F.col("media_type") == "application/pdf"
    beyond = F.when(pdf, (F.col("page_count") > 0) & (F.col("page") > F.col("page_count"))).otherwise((F.col("source_page") > 0) & (F.col("page") != F.col("source_page")))
    # Reviews are brought to their connections, which are dealt by review once.
    connections = dealt(connections, "review_id", rows=m)
    counts = connections.groupBy("review_id").agg(F.count("*").alias("connections"))
    whole = dealt(own, "review_id", rows=m).join(counts, "review_id", "left").withColumn(
        "problem",
        _first(
            (F.col("module_id").isNull(), "no such scene"), (~F.coalesce("mode", F.lit("merge")).isin(*MODES), "mode"),
            (_blank("asset_id"), "no asset named"), (F.col("asset_module").isNull() | (F.col("asset_module") != F.col("module_id")), "asset of another module"),
            (~F.coalesce(F.col("media_type").isin(*MEDIA), F.lit(False)), "media type"), (F.col("page").isNull() | (F.col("page") < 1) | beyond, "page"),
            (F.col("connections").isNull(), "no connections"), (F.col("connections") > MOST_CONNECTIONS, "too many connections"),
            (_blank("reviewer"), "no reviewer"), (_blank("branch_id"), "no branch"),
        ),
    )
    ends = connections.join(whole.select("review_id", "module_id"), "review_id").select("*", F.trim(F.coalesce("from", F.lit(""))).alias("a"), F.trim(F.coalesce("to", F.lit(""))).alias("b"))
    places = resolved(locations)
    for end in ("a", "b"):
        ends = ends.join(places.select("module_id", F.col("key").alias(end), F.col("places").alias(f"places_{end}")), ["module_id", end], "left")
    least, most = F.least(*[F.coalesce(f"places_{x}", F.lit(0)) for x in "ab"]), F.greatest(*[F.coalesce(f"places_{x}", F.lit(0)) for x in "ab"])
    seen = F.trim(F.coalesce("observation", F.lit("")))
    one = _first(((F.col("a") == "") | (F.col("b") == "") | (F.col("a") == F.col("b")), "ends"), (least == 0, "location missing"), (most > 1, "location ambiguous"), (~F.coalesce("kind", F.lit("passage")).isin(*KINDS), "kind"), ((seen == "") | (F.length(seen) > MOST_OBSERVATION), "observation"))
    bad = dealt(ends.withColumn("bad", one).where("bad is not null").select("review_id", "ordinal", "bad"), "review_id", rows=m).groupBy("review_id").agg(F.min(F.struct("ordinal", "bad")).alias("first"))
    return whole.join(bad, "review_id", "left").select("review_id", F.coalesce("problem", "first.bad").alias("problem"))


def apply_reviews(edges: DataFrame, reviews: DataFrame, connections: DataFrame, scenes: DataFrame, locations: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges of all scenes after the reviews, judged reviews); reviews take effect whole, in the order of their ordinals.

    Edges are told apart by their ends, sorted where both ways are open, and by
    whether they are; the later one holds.  A review that replaces drops what
    the scene had before it.
    """
    told = durable(judged_reviews(reviews, connections, scenes, locations, assets))
    n, m = reviews.count(), connections.count()
    good = dealt(reviews, "review_id", rows=n).join(told.where("problem is null").select("review_id"), "review_id")
    since = good.where("mode = 'replace'").groupBy("scene_id").agg(F.max("ordinal").alias("since"))
    kept = edges.join(since.select("scene_id"), "scene_id", "left_anti").select(*EDGE, F.lit(None).cast("long").alias("at"), F.lit(0).cast("long").alias("nth"))
    new = dealt(good, "scene_id", rows=n).join(since, "scene_id", "left").where("since is null or ordinal >= since").select("review_id", "scene_id", F.col("ordinal").cast("long").alias("at"), "asset_id", F.col("page").cast("long").alias("page"), F.trim("reviewer").alias("reviewer"), F.trim("branch_id").alias("branch_id"))
    new = dealt(new, "asset_id", rows=n).join(assets.select("asset_id", F.col("checksum").alias("asset_checksum")), "asset_id")
    drawn = connections.select("review_id", F.col("ordinal").cast("long").alias("nth"), F.trim("from").alias("from"), F.trim("to").alias("to"), F.coalesce("bidirectional", F.lit(True)).alias("bidirectional"), F.coalesce("kind", F.lit("passage")).alias("kind"), F.trim("observation").alias("observation"))
    every = kept.unionByName(new.join(dealt(drawn, "review_id", rows=m), "review_id").select(*EDGE, "at", "nth"))
    both = F.col("bidirectional")
    keyed = every.withColumns({"x": F.when(both, F.least("from", "to")).otherwise(F.col("from")), "y": F.when(both, F.greatest("from", "to")).otherwise(F.col("to"))})
    # What was there comes before all reviews.
    last = dealt(keyed, "scene_id", "x", "y", rows=m + edges.count()).groupBy("scene_id", "x", "y", "bidirectional").agg(F.max_by(F.struct(*[c for c in EDGE if c not in ("scene_id", "bidirectional")]), F.struct(F.coalesce("at", F.lit(-(1 << 62))), "nth")).alias("e"))
    return last.select("scene_id", "bidirectional", "e.*").select(*EDGE), told


def reached(edges: DataFrame, starts: DataFrame, *, by: str = "module_id", closed: tuple[str, ...] = ("secret_door",)) -> DataFrame:
    """by, key and steps: locations of each graph that are reached from its starts (by, key) along open edges, in fewest steps.

    `edges` has the column `by` besides those of EDGE.  Closed kinds, which
    players don't see, aren't walked.  One round a step; a round joins only what
    the one before it reached first.
    """
    open_ = edges.where(~F.col("kind").isin(*closed))
    ways = open_.select(by, F.col("from").alias("key"), F.col("to").alias("next")).unionByName(open_.where("bidirectional").select(by, F.col("to").alias("key"), F.col("from").alias("next")))
    ways = durable(ways.distinct())
    front = durable(starts.select(by, "key").where("key is not null").distinct().withColumn("steps", F.lit(0)))
    found = front
    while not front.isEmpty():
        more = front.join(ways, [by, "key"]).select(by, F.col("next").alias("key"), (F.col("steps") + 1).alias("steps")).distinct()
        front = durable(more.join(found.select(by, "key"), [by, "key"], "left_anti"))
        found = durable(found.unionByName(front))
    return found
