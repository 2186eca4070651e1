"""Text functions as native column expressions.

`fold` stands for full case folding: lower case, with the sharp s spelled out.
Offsets and lengths count code points throughout.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words as the lexical model sees them, and CJK characters.
LATIN_WORD = r"[A-Za-z0-9_'-]+"
CJK = r"[㐀-䶿一-鿿]"
PAGE_MARKER = r"(?m)^<!-- page: (\d+) -->$"
#: Quotation marks and dashes, and what they become.
TYPOGRAPHIC, PLAIN = "‘’‚‛“”„‟‐‑‒–—−", "''''\"\"\"\"------"
#: Chars of one estimated token.
CHARS_PER_TOKEN = 4


def fold(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def _strings(values: Column) -> Column:
    return F.coalesce(values, F.array().cast("array<string>"))


def terms(text: Column) -> Column:
    """Words, then CJK characters, then pairs of CJK characters that follow each other, gaps left out; repeats stay."""
    low = fold(text)
    cjk = _strings(F.regexp_extract_all(low, F.lit(f"({CJK})"), F.lit(1)))
    pairs = F.when(F.size(cjk) > 1, F.zip_with(F.slice(cjk, 1, F.greatest(F.size(cjk) - 1, F.lit(0))), F.slice(cjk, 2, F.size(cjk)), lambda a, b: F.concat(a, b)))
    return F.concat(_strings(F.regexp_extract_all(low, F.lit(f"({LATIN_WORD})"), F.lit(1))), cjk, _strings(pairs))


def term_count(text: Column) -> Column:
    """The number of terms, without building them."""
    low = fold(F.coalesce(text, F.lit("")))
    cjk = F.regexp_count(low, F.lit(CJK))
    return F.regexp_count(low, F.lit(LATIN_WORD)) + cjk + F.greatest(cjk - 1, F.lit(0))


def occurrences(text: Column, term: Column) -> Column:
    """Occurrences of a substring that don't overlap; 0 for an empty term."""
    cut = F.length(text) - F.length(F.replace(text, term, F.lit("")))
    return F.when(F.length(term) > 0, (cut / F.length(term)).cast("long")).otherwise(F.lit(0))


def compact_ascii_key(text: Column) -> Column:
    return F.regexp_replace(fold(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "")


def ascii_slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def slugify(text: Column) -> Column:
    """The slug, or twelve random hex digits where it would be empty."""
    slug = ascii_slug(text)
    return F.when(slug != "", slug).otherwise(F.substring(F.replace(F.expr("uuid()"), F.lit("-"), F.lit("")), 1, 12))


def normalize_language(language: Column) -> Column:
    tag = F.replace(F.lower(F.trim(F.coalesce(language, F.lit("")))), F.lit("_"), F.lit("-"))
    return F.when(tag.startswith("zh") | tag.startswith("cn"), "zh").when(tag.startswith("en"), "en").otherwise("mixed")


def detect_text_language(text: Column) -> Column:
    """zh, en, or mixed: where the rarer of CJK and Latin letters reaches 15 % of the other, or neither is there."""
    cjk, latin = F.regexp_count(text, F.lit(CJK)), F.regexp_count(text, F.lit("[A-Za-z]"))
    both = (cjk > 0) & (latin > 0) & (F.least(cjk, latin) / F.greatest(cjk, latin) >= 0.15)
    return F.when(both, "mixed").when(cjk > 0, "zh").when(latin > 0, "en").otherwise("mixed")


def clean_evidence(text: Column) -> Column:
    """Without invisible characters, with plain quotes and dashes, white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(text, r"￾[ \t\r\n]*", ""), r"[\u0002­]", "")
    return F.trim(F.regexp_replace(F.translate(bare, TYPOGRAPHIC, PLAIN), r"(?U)\s+", " "))


def normalize_evidence(text: Column) -> Column:
    return fold(clean_evidence(text))


def strip_page_markers(text: Column) -> Column:
    lines = F.filter(F.split(text, r"\r\n|\r|\n", -1), lambda line: ~line.rlike(r"^\s*<!-- page: \d+ -->\s*$"))
    return F.trim(F.array_join(lines, "\n"))


def page_for_offset(markers: Column, offset: Column) -> Column:
    """The page of the last marker at or before an offset; `markers` is an array of (start, page) in order."""
    before = F.filter(markers, lambda m: m["start"] <= offset)
    return F.when(F.size(before) > 0, F.element_at(before, -1)["page"])


def page_markers(text: Column) -> Column:
    """Array of (start, page) of a text's page markers, in order."""
    found = F.regexp_extract_all(text, F.lit(PAGE_MARKER), F.lit(0))
    parts = F.split(text, PAGE_MARKER, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,page:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        here = acc["at"] + F.length(x["part"])
        one = F.struct(here.alias("start"), F.regexp_extract(x["mark"], r"(\d+)", 1).cast("int").alias("page"))
        return F.struct((here + F.length(x["mark"])).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    pairs = F.zip_with(F.slice(parts, 1, F.greatest(F.size(found), F.lit(0))), found, lambda p, m: F.struct(p.alias("part"), m.alias("mark")))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(text) / CHARS_PER_TOKEN)).cast("long")


def bounded_key(text: Column, most: int = 300) -> Column:
    """The trimmed key, or null where it is empty or too long."""
    key = F.trim(text)
    return F.when(F.length(key).between(1, most), key)


def normalized_line(text: Column) -> Column:
    """Letters, digits and underscores of the folded line."""
    return F.regexp_replace(fold(text), r"(?U)[^\w]+", "")


def clean_line(text: Column) -> Column:
    """Private-use bullets to bullets, other private-use characters to spaces; blanks collapsed."""
    bullets = F.regexp_replace(text, "[]", "•")
    return F.trim(F.regexp_replace(F.regexp_replace(bullets, "[-]", " "), r"[ \t]+", " "))


def line_joiner(left: Column, right: Column) -> Column:
    """What joins wrapped lines: nothing after a hyphen or between CJK characters, else a space."""
    bare = left.endswith("-") | (F.regexp_like(left, F.lit(f"{CJK}$")) & F.regexp_like(right, F.lit(f"^{CJK}")))
    return F.when((left == "") | (right == "") | bare, "").otherwise(" ")


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")


def looks_letter_spaced(text: Column) -> Column:
    """At least three words of one letter, which are 30 % of the words."""
    words = words_of(text)
    singles = F.size(F.filter(words, lambda w: w.rlike(r"(?U)^\p{L}$")))
    return (singles >= 3) & (singles >= 0.3 * F.size(words))


def looks_all_caps(text: Column) -> Column:
    """A heading in capitals: 3 to 80 characters, 12 words at most, 85 % of the letters capital, no stop at the end."""
    letters = F.regexp_count(text, F.lit(r"\p{L}"))
    return (
        F.length(text).between(3, 80) & (F.size(words_of(text)) <= 12) & (letters > 0)
        & (F.regexp_count(text, F.lit(r"\p{Lu}")) >= 0.85 * letters) & ~text.rlike(r"\p{Lo}") & ~text.rlike(r"[.!?:;,]$")
    )


def chapter_identity(text: Column) -> Column:
    """The normalised line, with Ch. and App. spelled out: equal for labels of one chapter."""
    full = F.regexp_replace(F.trim(text), r"(?i)^ch(?:apter)?\s*\.?\s*", "chapter ")
    return normalized_line(F.regexp_replace(full, r"(?i)^app(?:endix)?\s*\.?\s*", "appendix "))


def chapter_label(text: Column) -> Column:
    """chapter:3, appendix:a, part:2, episode:1and2, or null."""
    identity = chapter_identity(text)
    kind, which = (F.regexp_extract(identity, r"^(chapter|appendix|part|episode)s?([0-9]+(?:and[0-9]+)?|[a-z])", i) for i in (1, 2))
    return F.when(kind != "", F.concat(kind, F.lit(":"), which))


def stable_key(path: Column, title: Column) -> Column:
    """A key from a heading path: word characters joined by hyphens, 120 at most, or a hash of the path."""
    joined = F.array_join(F.filter(F.transform(path, lambda p: F.trim(p)), lambda p: p != ""), "/")
    source = F.when(joined != "", joined).otherwise(title)
    key = F.replace(F.regexp_replace(F.regexp_replace(fold(source), r"(?U)[^\w]+", "-"), "^-+|-+$", ""), F.lit("_"), F.lit("-"))
    return F.when(key != "", F.substring(key, 1, 120)).otherwise(F.concat(F.lit("scene-"), F.substring(F.sha2(source, 256), 1, 16)))


def heading_path(headings: Column) -> Column:
    """Trimmed headings without empty ones and without repeats, in any case, next to each other."""
    bare = F.filter(F.transform(headings, lambda h: F.trim(h)), lambda h: h != "")
    return F.aggregate(bare, F.array().cast("array<string>"), lambda acc, h: F.when((F.size(acc) > 0) & (fold(F.element_at(acc, -1)) == fold(h)), acc).otherwise(F.concat(acc, F.array(h))))


def keywords(title: Column, most: int = 20) -> Column:
    """Distinct Latin words of three letters and CJK runs of two to eight of a title, folded, in order."""
    found = F.regexp_extract_all(title, F.lit(r"([A-Za-z][A-Za-z0-9'-]{2,}|[一-鿿]{2,8})"), F.lit(1))
    return F.slice(F.array_distinct(F.transform(found, fold)), 1, most)


def chunk_type(heading: Column, text: Column) -> Column:
    """table, blockquote, list, reference or narrative, by how its lines begin."""
    lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda line: F.trim(line) != "")
    begun = F.transform(lines, lambda line: F.regexp_replace(line, r"^\s+", ""))
    return (
        F.when((F.size(lines) > 0) & F.forall(begun, lambda b: b.startswith("|")), "table")
        .when(F.regexp_like(text, F.lit(r"^\s*>")), "blockquote")
        .when((F.size(lines) > 0) & (F.size(F.filter(begun, lambda b: b.rlike("^[-*]"))) >= F.size(lines) / 2), "list")
        .when(fold(heading).isin("appendix", "附录", "reference", "参考"), "reference")
        .otherwise("narrative")
    )
