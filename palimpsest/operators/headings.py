"""Headings that no outline names: chapters, keyed rooms and capitals, told apart by a small grammar over columns.

A keyed heading is ``prefix number suffix . title``; recognition errors in its
number are repaired, and prose on the same line is parted from its title.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.operators.layout import CHAPTER_LINE

#: The parts of a keyed heading (prefix, number, suffix, separator, title), and what its number's letters stand for.
KEYED = r"(?iU)^([A-Z]{1,3}?)\s*([0-9IlO]{1,3})([A-Za-z]?)(\s*[.．]\s*)([^\W_]\S.*)$"
LETTERS, DIGITS = "IilOo", "11100"
#: Stops that end a sentence, glyphs that only damaged headings have, leaders to a page number, and how chapters without an outline look.
TERMINAL = r"[。！？!?；;：:…][”’』」）》】]*$"
DAMAGED = r"[\\~{}°•·]|\.\. "
LEADERS = r"\.{3,}\s*\d+\s*$|\s\d+\s*$"
CJK_CHAPTER = r"^(?:第[一二三四五六七八九十百0-9]+章|附录\s*[A-ZＡ-Ｚ])"
PLAIN_CHAPTER = r"(?i)^(?:Chapter|Appendix|Part|Episode)\s+[0-9A-Z]+\s*[:：—-]\s*\S+"
#: Most words of a title, least share of its words that begin with a capital, and of its letters that are capitals.
TITLE_WORDS, TITLE_CAPITALS, CAPITALS = 6, 0.5, 0.85


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def damaged_heading(line: Column) -> Column:
    """Glyphs of a decorative or handwritten line: no heading."""
    return line.rlike(DAMAGED) | (_count(line, "['\"]") >= 4)


def spaced_heading(line: Column) -> Column:
    """Display type cut into letters: three single letters or more, most of its Latin words, at most one long word."""
    words = F.regexp_extract_all(line, F.lit("[A-Za-z]+"), F.lit(0))
    singles, long = (F.size(F.filter(words, p)) for p in (lambda w: F.length(w) == 1, lambda w: F.length(w) > 3))
    return (singles >= 3) & (singles >= 0.55 * F.size(words)) & (long <= 1)


def capitals_heading(line: Column) -> Column:
    """A short line of Latin capitals (or spaced letters) that ends no sentence; scripts without case have none."""
    own = F.trim(line)
    latin = _count(own, "[A-Za-z]")
    return (
        F.length(own).between(3, 80) & (_count(own, r"\S+") <= 12) & (latin > 0) & (_count(own, r"[\p{L}&&[^\x00-\x7F]]") == 0)
        & ((_count(own, "[A-Z]") >= CAPITALS * latin) | spaced_heading(own)) & ~own.rlike(TERMINAL)
    )


def chapter_heading(line: Column) -> Column:
    """A line that begins a chapter without further evidence: named, not led to a page number, with a title set off."""
    own = F.trim(line)
    return own.rlike(CHAPTER_LINE) & ~own.rlike(LEADERS) & (own.rlike(CJK_CHAPTER) | own.rlike(PLAIN_CHAPTER))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often `body` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def parsed_key(line: Column) -> Column:
    """struct(prefix, number, written, suffix, separator, title) of a keyed line, its number repaired; null of any other."""

    def own(x: Column) -> Column:
        prefix, number, suffix, separator, title = (F.regexp_extract(x, KEYED, k) for k in range(1, 6))
        return F.struct(F.upper(prefix).alias("prefix"), F.translate(number, LETTERS, DIGITS).alias("number"), number.alias("written"), suffix.alias("suffix"), separator.alias("separator"), title.alias("title"))

    return let(line, lambda x: F.when(x.rlike(KEYED), own(x)))


def _parted(title: Column) -> Column:
    """struct(label, stop, body) around the first full stop and space, else around the first dashes; stop is null without either."""

    def own(x: Column) -> Column:
        at, dashes = F.instr(x, ". "), F.instr(x, " --- ")
        cut = lambda i, n, stop: F.struct(F.substring(x, F.lit(1), i - 1).alias("label"), F.lit(stop).alias("stop"), F.substring(x, i + n, F.length(x)).alias("body"))
        return F.when(at > 0, cut(at, 2, ".")).when(dashes > 0, cut(dashes, 5, "")).otherwise(F.struct(x.alias("label"), F.lit(None).cast("string").alias("stop"), F.lit("").alias("body")))

    return let(title, own)


def _titled(title: Column) -> Column:
    """Whether the label of a title reads as one: capitals, spaced letters, or few words that mostly begin with capitals."""

    def own(label: Column) -> Column:
        words, begun = F.regexp_count(label, F.lit("[A-Za-z]+")), F.regexp_count(label, F.lit("(?<![A-Za-z])[A-Z]"))
        few = (words <= TITLE_WORDS) & (begun >= TITLE_CAPITALS * words) & ~label.rlike("[,;:]$")
        return (words > 0) & (capitals_heading(label) | spaced_heading(label) | few)

    return let(_parted(title)["label"], own)


def keyed_heading(line: Column) -> Column:
    """Whether a keyed line is a heading and no wrapped prose.

    Days without a suffix are; single-letter keys with a small suffix and a
    sure digit are; of all others the title decides.  Maps never are, nor null
    or damaged lines.
    """

    def own(key: Column) -> Column:
        day = (key["prefix"] == "DAY") & (key["suffix"] == "")
        sure = key["suffix"].rlike("^[a-z]$") & (F.length(key["prefix"]) == 1) & key["written"].rlike("[2-9]")
        return (key["prefix"] != "MAP") & (day | sure | _titled(F.trim(key["title"])))

    return let(line, lambda x: F.coalesce(~damaged_heading(x) & let(parsed_key(x), own), F.lit(False)))


def split_heading(line: Column) -> Column:
    """struct(heading, body): a keyed line as its repaired heading and the prose after it; any other line as it is."""
    two = lambda heading, body: F.struct(heading.alias("heading"), body.alias("body"))

    def own(key: Column) -> Column:
        title, code = F.trim(key["title"]), F.concat(key["prefix"], key["number"], key["suffix"])
        prose = key["suffix"].rlike("^[a-z]$") | (_count(title, "[A-Za-z]+") > TITLE_WORDS) | (key["prefix"] == "DAY")
        whole = F.when(prose, two(code, title)).otherwise(two(F.concat(code, key["separator"], key["title"]), F.lit("")))

        def apart(p: Column) -> Column:
            short = F.concat(code, F.lit(". "), p["label"])
            return F.when(p["stop"].isNotNull() & keyed_heading(short), two(F.regexp_replace(F.concat(short, p["stop"]), r"\.+$", ""), F.trim(p["body"]))).otherwise(whole)

        return let(_parted(title), apart)

    return let(line, lambda x: let(parsed_key(x), lambda key: F.when(key.isNull(), two(x, F.lit(""))).otherwise(own(key))))
