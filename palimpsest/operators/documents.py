"""Document normalisation: page quality, repairs, margins, markers and revisions."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions.text import normalized_line

#: What makes a page suspect.
SPARSE, FUSED_LETTERS, FUSED_SPACES, LONG_RUN, LONG_RUNS = 20, 200, 0.08, 30, 3
DAMAGED_WORDS, DAMAGED_STARTS, FRAGMENTS, FRAGMENT_SHARE = 200, 4, 8, 0.015
PRIVATE_SHARE, CONTROL_SHARE, REPLACEMENT_SHARE = 0.02, 0.01, 0.01
_PAGE_NUMBER = r"^[-–—\s]*(?:page\s+)?[0-9]{1,4}[-–—\s]*$"
_CHAPTER = r"(?i)^\s*(?:chapter|appendix|ch\.|app\.)\s*[0-9ivxlca-z]+"
_TERMINATED = r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85  ]"


def page_quality(text: Column) -> dict[str, Column]:
    """Counts, ratios and flags of one page as named expressions; a null page counts as empty."""
    text = F.coalesce(text, F.lit(""))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern)).cast("long")
    chars, space, letters = F.length(text).cast("long"), count(r"[\s\x0B\x1C-\x1F\x85\p{Z}]"), count(r"\p{L}")
    long_runs = count(r"(?<!\p{L})\p{L}{%d,}" % LONG_RUN)
    private, control, replaced = count(r"\p{Co}"), count(r"[\p{Cc}&&[^\t\r\n]]"), count("�")
    words, fragments = count("[A-Za-z]+"), count("(?<![A-Za-z])[B-HJ-Zb-hj-z](?![A-Za-z])")
    lines = F.filter(F.split(text, _TERMINATED, -1), lambda x: F.trim(x) != "")
    starts = F.size(F.filter(lines, lambda x: x.rlike(r"^\s*(?:[-~\\:;_.?]|[0-9](?=[A-Za-z]))"))).cast("long")
    of = F.greatest(chars, F.lit(1))
    per_letter = space / F.greatest(letters, F.lit(1))
    return {
        "characters": chars,
        "non_whitespace": chars - space,
        "alphabetic": letters,
        "private_use": private,
        "control": control,
        "replacement": replaced,
        "long_runs": long_runs,
        "fragments": fragments,
        "damaged_starts": starts,
        "sparse": chars - space < SPARSE,
        "fused": (letters >= FUSED_LETTERS) & (per_letter < FUSED_SPACES) & (long_runs >= LONG_RUNS),
        "damaged": (words >= DAMAGED_WORDS) & (starts >= DAMAGED_STARTS) & (fragments >= FRAGMENTS) & (fragments >= FRAGMENT_SHARE * words),
        "corrupt": (private / of >= PRIVATE_SHARE) | (control / of >= CONTROL_SHARE) | (replaced / of >= REPLACEMENT_SHARE),
    }


def with_page_quality(pages: DataFrame, text: str) -> DataFrame:
    return pages.withColumns(page_quality(F.col(text)))


def document_quality(pages: DataFrame, document: str, page: str, text: str) -> DataFrame:
    """Roll page quality up by document: sums, page lists, ratios and coverage; one partial aggregation."""
    own = with_page_quality(pages.select(document, page, text), text)
    suspect = F.col("sparse") | F.col("fused") | F.col("damaged") | F.col("corrupt")
    listed = lambda flag: F.array_sort(F.collect_list(F.when(flag, F.col(page))))
    sums = own.groupBy(document).agg(
        F.count("*").alias("pages"),
        *[F.sum(c).alias(c) for c in ("characters", "non_whitespace", "private_use", "control", "replacement")],
        listed(F.col("sparse")).alias("sparse_pages"), listed(F.col("corrupt")).alias("corrupt_pages"),
        listed(F.col("fused")).alias("fused_pages"), listed(F.col("damaged")).alias("damaged_pages"), listed(suspect).alias("suspect_pages"),
    )
    of = F.greatest(F.col("characters"), F.lit(1))
    ratios = {f"{c}_ratio": F.round(F.col(c) / of, 6) for c in ("private_use", "control", "replacement")}
    return sums.withColumns(ratios | {"coverage": F.round((F.col("pages") - F.size("sparse_pages")) / F.col("pages"), 6)})


def repair_page(text: Column) -> Column:
    """struct(text, word_breaks, control_marks): without U+FFFE and the blanks after it, without U+0002."""
    bare = F.replace(F.regexp_replace(text, "￾[ \\t\\r\\n]*", ""), F.lit("\x02"), F.lit(""))
    return F.struct(bare.alias("text"), F.regexp_count(text, F.lit("￾")).alias("word_breaks"), F.regexp_count(text, F.lit("\\x02")).alias("control_marks"))


def repeated_margin_lines(pages: DataFrame, document: str, page: str, text: str, excluded: str | None = None) -> DataFrame:
    """document, line and pages: normalised first and last three lines that recur on enough pages.

    A line counts once a page; page numbers and chapter headings don't count; a
    line recurs on max(2, pages // 8) pages or more.  Lines are counted after a
    map-side combine, so a line on every page is no hot key.
    """
    lines = F.filter(F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    edge = F.concat(F.slice(lines, 1, 3), F.reverse(F.slice(F.reverse(lines), 1, 3)))
    edge = F.filter(edge, lambda x: ~x.rlike(_PAGE_NUMBER) & ~x.rlike(_CHAPTER) & (~x.rlike(excluded) if excluded else F.lit(True)))
    seen = pages.select(document, page, F.explode(F.array_distinct(F.transform(edge, normalized_line))).alias("line")).where("line <> ''")
    sizes = pages.groupBy(document).agg(F.countDistinct(page).alias("of"))
    counted = seen.groupBy(document, "line").agg(F.count("*").alias("pages"))
    return counted.join(sizes, document).where(F.col("pages") >= F.greatest(F.lit(2), F.floor(F.col("of") / 8))).select(document, "line", "pages")


def replacement_improves(score: Column, candidate_score: Column, chars: Column, candidate_chars: Column) -> Column:
    """A better score, with at least half of the text kept."""
    return (candidate_score > score) & (candidate_chars >= 0.5 * chars)


def replace_suspect_pages(pages: DataFrame, recognised: DataFrame, keys: list[str]) -> DataFrame:
    """Suspect pages take the recognised text where it is better; others stay.  Both have `text`."""
    def score(text: Column) -> Column:
        q = page_quality(text)
        clean = ~(q["sparse"] | q["fused"] | q["damaged"] | q["corrupt"])
        return F.struct(clean.alias("clean"), q["non_whitespace"].alias("chars"))

    both = pages.join(recognised.select(*keys, F.col("text").alias("candidate")), keys, "left")
    old, new = score(F.col("text")), score(F.col("candidate"))
    better = F.col("candidate").isNotNull() & ~old["clean"] & replacement_improves(old, new, old["chars"], new["chars"])
    return both.withColumn("replaced", better).withColumn("text", F.when(better, F.col("candidate")).otherwise(F.col("text"))).drop("candidate")


def best_recognised(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Of several recognised texts of a page (provider, priority, text), the clean one with most text, the first provider on ties."""
    q = page_quality(F.col("text"))
    clean = ~(q["sparse"] | q["fused"] | q["damaged"] | q["corrupt"])
    return candidates.groupBy(*keys).agg(F.max_by(F.struct("provider", "text"), F.struct(clean, q["non_whitespace"], -F.col("priority"))).alias("best")).select(*keys, "best.provider", "best.text")


def page_spans(documents: DataFrame, document: str, content: str) -> DataFrame:
    """document, page, start, end: the span of each page between its marker and the next."""
    from palimpsest.functions.text import page_markers

    marked = documents.select(document, F.length(content).alias("size"), F.posexplode(page_markers(F.col(content))).alias("n", "m"))
    after = F.lead("m.start").over(Window.partitionBy(document).orderBy("n"))
    return marked.select(document, F.col("m.page").alias("page"), F.col("m.start").alias("start"), F.coalesce(after, "size").alias("end"))


#: Bounds of page revisions.
PAGE_EDITS, DOCUMENT_EDITS, LEAST_SIZE, MOST_SIZE = 8, 128, 0.5, 1.5


def apply_page_revisions(pages: DataFrame, revisions: DataFrame) -> DataFrame:
    """Audited replacements of page text: document, page, text, edits, error.

    `pages` has (document, page, text); `revisions` has (document, page,
    base_sha256, ordinal, old, new).  Each replacement must find its old text
    exactly once in the page as replaced so far; the base hash must match; a
    page takes 8 edits at most and keeps 50 to 150 % of its size, a document
    takes 128.  A page that fails keeps its text and gets the error.
    """

    def fold_page(key, page_rows: pd.DataFrame, edits: pd.DataFrame) -> pd.DataFrame:
        document, page = key
        text = page_rows["text"].iloc[0] if len(page_rows) else None
        if text is None:
            return pd.DataFrame([(document, page, None, 0, "no such page")], columns=["document", "page", "text", "edits", "error"])
        now, error = text, None
        edits = edits.sort_values("ordinal")
        if len(edits) > PAGE_EDITS:
            error = "too many edits"
        for e in edits.itertuples():
            if error:
                break
            if hashlib.sha256(text.encode()).hexdigest() != e.base_sha256:
                error = "base text differs"
            elif not e.old or now.count(e.old) != 1:
                error = "old text isn't there exactly once"
            else:
                now = now.replace(e.old, e.new)
        if error is None and len(edits) and not LEAST_SIZE * len(text) <= len(now) <= MOST_SIZE * len(text):
            error = "size changes too much"
        return pd.DataFrame([(document, page, text if error else now, 0 if error else len(edits), error)], columns=["document", "page", "text", "edits", "error"])

    counts = revisions.groupBy("document").count().where(F.col("count") > DOCUMENT_EDITS).select("document", F.lit("too many edits in the document").alias("whole"))
    out = pages.groupBy("document", "page").cogroup(revisions.groupBy("document", "page")).applyInPandas(fold_page, "document string, page long, text string, edits long, error string")
    out = out.join(counts, "document", "left").join(pages.withColumnRenamed("text", "base"), ["document", "page"], "left")
    over = F.col("whole").isNotNull()
    return out.select("document", "page", F.when(over, F.col("base")).otherwise(F.col("text")).alias("text"), F.when(over, 0).otherwise(F.col("edits")).alias("edits"), F.coalesce("whole", "error").alias("error"))


def quality_gate(quality: DataFrame) -> DataFrame:
    """Documents that fail closed: 80 % of the pages or more are suspect."""
    return quality.where(F.size("suspect_pages") >= 0.8 * F.col("pages"))
