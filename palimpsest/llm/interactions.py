"""How filters interact: what each removes, in every order, alone, and beyond the others.

Every document gets one failure flag a filter.  Documents are counted by flags
and part, and CUBE over the flags and the part sums these few counts.  A row of
a grouping set whose grouped flags are all false counts the documents that fail
none of these filters: the survivors of that subset, whatever the order.  A step
of an order is a pair of subsets, one filter apart; all columns come from such
pairs.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.batches import durable, table

#: Orders grow as the factorial of the filters, grouping sets as a power of two.
MOST_FILTERS = 7


def first_copies(rows: DataFrame, digest: str, doc_id: str) -> DataFrame:
    """digest and the smallest id of each text; pre-aggregated before the shuffle, so a frequent text is no hot key."""
    return rows.where(F.col(doc_id).isNotNull()).groupBy(digest).agg(F.min(doc_id).alias(doc_id))


def failures(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """doc_id, part and the flags A to E of each row (see `op11_filter_audit`), true where the filter fails.

    A null text counts as empty, a null part as the empty string.  A row
    without an id is no copy of any; rows that repeat the smallest id of their
    text are no copies either.  Only digests of texts are shuffled.
    """
    own = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    words = own.withColumn("words", F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    n, distinct = F.size("words"), F.size(F.array_distinct("words"))
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    flags = {"A": n < 50, "B": 100 * distinct < 65 * n, "C": 100 * capitals > 5 * F.length("text"), "D": F.col("text").rlike(r"[#$%&*|]")}
    rows = durable(words.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), *[c.alias(f) for f, c in flags.items()]))
    # Ids are part of the key, so all copies of a text but one find nothing, each in a place of its own.
    firsts = first_copies(rows, "digest", "doc_id").withColumn("first", F.lit(True))
    return rows.join(firsts, ["digest", "doc_id"], "left").select("doc_id", "part", *flags, (F.col("doc_id").isNotNull() & F.col("first").isNull()).alias("E"))


def audit(flagged: DataFrame, filters: list[str], weights: dict[str, Column] | None = None, *, part: str = "part") -> DataFrame:
    """What each step of each order of the filters does to each part.

    `flagged` has a boolean column a filter (null: not failing), whose names
    have one letter each, and the part.  `weights` are further 0-or-1 columns to
    be counted: each gives a column `<name>_lost`.  Returns part, filter_order,
    step, kept, removed, redundant, unique_fails, the lost columns and shapley,
    for every part and order, zeros included.  An empty table gives an empty
    table.  After the first aggregation, rows are at most parts times two to the
    power of the filters.
    """
    if not 1 <= len(filters) <= MOST_FILTERS or len(set(filters)) < len(filters) or any(len(f) != 1 for f in filters):
        raise ValueError(f"1 to {MOST_FILTERS} filters, each named by a letter of its own")
    weights = weights or {}
    every = (1 << len(filters)) - 1
    measures = ["n", *weights]
    counts = flagged.groupBy(F.col(f"`{part}`").alias("part"), *[F.coalesce(F.col(f"`{f}`"), F.lit(False)).alias(f) for f in filters]).agg(
        F.count("*").alias("n"), *[F.sum(F.coalesce(c.cast("long"), F.lit(0))).alias(w) for w, c in weights.items()]
    )
    counts = durable(counts)  # few rows, from all rows, read several times below
    cubed = counts.cube("part", *filters).agg(*[F.sum(m).alias(m) for m in measures], F.grouping("part").alias("no_part"), *[F.grouping(f).alias(f"no_{f}") for f in filters])
    subset = sum((F.lit(1 << i) * (1 - F.col(f"no_{f}")) for i, f in enumerate(filters)), F.lit(0))
    passing = F.lit(True)
    for f in filters:
        passing &= (F.col(f"no_{f}") == 1) | ~F.col(f)
    survivors = cubed.where((F.col("no_part") == 0) & passing).select("part", subset.cast("int").alias("subset"), *measures)
    # Subsets that nobody survives have no row in the cube.
    frame = counts.select("part").distinct().select("part", F.explode(F.sequence(F.lit(0), F.lit(every))).alias("subset"))
    survivors = frame.join(survivors, ["part", "subset"], "left").fillna(0, measures)

    # Pairs of subsets, one filter apart.
    n = len(filters)
    without = survivors.select("part", F.col("subset").alias("before"), *[F.col(m).alias(f"{m}_before") for m in measures], F.explode(F.array(*[F.struct(F.lit(f).alias("filter"), F.lit(1 << i).alias("bit")) for i, f in enumerate(filters)])).alias("f"))
    without = without.where(F.col("before").bitwiseAND(F.col("f.bit")) == 0).select("part", "before", *[f"{m}_before" for m in measures], F.col("f.filter").alias("filter"), (F.col("before") + F.col("f.bit")).alias("subset"))
    pairs = without.join(survivors, ["part", "subset"])
    # So many orders have exactly these filters, in any order, before this one.
    ordered = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), F.bit_count("before") + 1)
    pairs = pairs.select("part", "before", "filter", F.col("n").alias("kept"), (F.col("n_before") - F.col("n")).alias("removed"), *[(F.col(f"{w}_before") - F.col(w)).alias(f"{w}_lost") for w in weights], ordered.cast("long").alias("orders"))
    others = F.lit(every) - F.element_at(F.create_map(*[F.lit(x) for i, f in enumerate(filters) for x in (f, 1 << i)]), F.col("filter"))
    sums = pairs.groupBy("part", "filter").agg(
        F.sum(F.col("removed") * F.col("orders")).alias("shapley"),
        F.max(F.when(F.col("before") == 0, F.col("removed"))).alias("fails"),
        F.max(F.when(F.col("before") == others, F.col("removed"))).alias("unique_fails"),
    )
    told = pairs.join(sums, ["part", "filter"])

    bits = {f: 1 << i for i, f in enumerate(filters)}
    steps = [("".join(o), k + 1, o[k], sum(bits[f] for f in o[:k])) for o in permutations(filters) for k in range(n)]
    plan = flagged.sparkSession.createDataFrame(steps, "filter_order string, step int, filter string, before int")
    lost = [f"{w}_lost" for w in weights]
    return told.join(F.broadcast(plan), ["filter", "before"]).select("part", "filter_order", "step", "kept", "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", *lost, "shapley")


def labelled(flagged: DataFrame, labels: DataFrame) -> DataFrame:
    """Add good and toxic: whether any label of the document says so."""
    says = labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return flagged.join(says, "doc_id", "left")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over whole documents, by source, in all 120 orders.

    A fails under 50 words; B where fewer than 65 % of the words are distinct; C
    where over 5 % of the code points are A to Z; D with any of ``#$%&*|``; E for
    a copy of a text with a smaller id.
    """
    flagged = labelled(failures(table(spark, sf_dir, "documents")), table(spark, sf_dir, "labels"))
    return audit(flagged, list("ABCDE"), {"good": F.col("good"), "toxic": F.col("toxic")})


OP11_SQL = r"""
WITH own AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
says AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
flagged AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(words) < 50)::INT
         + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
         + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text))::INT
         + 8 * regexp_matches(text, '[#$%&*|]')::INT
         + 16 * coalesce(min(doc_id) OVER (PARTITION BY text) < doc_id, false)::INT AS failed
  FROM own LEFT JOIN says USING (doc_id)),
counts AS (SELECT part, failed, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM flagged GROUP BY part, failed),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (
  SELECT filter_order, step, substr(filter_order, step, 1) AS f,
         list_sum([0] || list_transform(range(1, step), lambda k: 1 << (ascii(substr(filter_order, k::INT, 1)) - 65)))::INT AS earlier,
         1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5])::INT AS step)),
told AS (
  SELECT part, filter_order, step, f,
         sum(CASE WHEN failed & (earlier | bit) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN failed & earlier = 0 AND failed & bit > 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN failed & earlier > 0 AND failed & bit > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN failed = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN failed & earlier = 0 AND failed & bit > 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN failed & earlier = 0 AND failed & bit > 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, f)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, f))::BIGINT AS shapley
FROM told
"""
