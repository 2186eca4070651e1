"""Personal data by weak supervision, in DataFrame and SQL functions only.

Patterns propose spans.  Labelers vote on each: its pattern, its check sum or
form, gazetteers, and words before it that speak for or against it.
Expectation-maximisation over the counts of vote patterns estimates how far
each labeler is to be trusted; its posteriors train a logistic span classifier,
which decides on the spans that the base patterns alone don't give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.batches import durable, table, without

KINDS = ("email", "ip", "card", "phone")
#: Rounds of expectation-maximisation and of gradient descent, its rate, and the least probability of an added span.
EM_ROUNDS, FIT_ROUNDS, FIT_RATE, LEAST_PROBABILITY = 15, 40, 1.0, 0.5
#: Characters before a span where context words count.
CONTEXT = 40

# Patterns start at a run's start or where the last match ended, and never give back what they took:
# the same matches as without, in time linear in the text and without deep recursion.
_LOCAL = "[A-Za-z0-9._%+-]"
_OCTET = "0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: kind, guard, pattern, whether a match is a candidate, whether it is a base span.
PATTERNS = (
    (0, "contains({t}, '@')", rf"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++", "true", "true"),
    (1, "{t} rlike '[0-9][.][0-9]'", r"(?<![0-9])[0-9]++(?:\\.[0-9]++){3}", "true", f"m rlike '^({_OCTET}[.]){{3}}{_OCTET}$'"),
    (2, "{t} rlike '[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]'", r"(?=(?:[0-9][ -]?){13})[0-9]++(?:[ -][0-9]++)*+", "length(regexp_replace(m, '[^0-9]', '')) between 13 and 19", "luhn_check(regexp_replace(m, '[^0-9]', ''))"),
    (3, "contains({t}, '+')", r"\\+[0-9][ ().0-9-]+[0-9]", "length(regexp_replace(m, '[^0-9]', '')) between 9 and 15", "true"),
    # Not base spans: spelled-out addresses, numbers of version 6, telephone numbers without a country.
    (0, "{t} rlike '(?i)[(\\\\[{{ ]dot[)\\\\]}} ]'", rf"(?i)(?<!{_LOCAL}){_LOCAL}++ ?[(\\[{{]? ?at ?[)\\]}}]? ?[A-Za-z0-9-]++(?: ?[(\\[{{ ] ?dot ?[)\\]}} ] ?[A-Za-z0-9-]++)++", "true", "false"),
    (1, "{t} rlike '[0-9A-Fa-f]:[0-9A-Fa-f]{{1,4}}:'", r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])", "true", "false"),
    (3, "{t} rlike '[0-9]{{3}}[ .-][0-9]{{4}}'", r"(?<![0-9+.-])(?<![+][0-9] )\\(?[0-9]{3}\\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])", "true", "false"),
)

#: Top-level domains, beginnings of card numbers and of numbers that no public host has, and context words.
DOMAINS = "com|org|net|edu|gov|info|io|biz|co|us|uk|de|fr|es|it|nl|eu|ch|at|be|ca|au|jp|cn|in|br|mx|ru|pl|se"
ISSUERS = "4|5[1-5]|2[2-7]|3[47]|6011|65|35|36|38|30"
RESERVED = "0[.]|127[.]|255[.]"
FOR_IT = "e-?mail|mail|contact|write|reach|call|phone|tel|mobile|fax|card|visa|credit|pay|iban|address|host|server|login|user"
AGAINST = "version|release|isbn|issn|order|invoice|article|serial|part|section|figure|table|page|sku|tracking"
#: Labelers: each votes 1, -1 or 0 on a candidate c (kind, base, m, before).
LABELERS = (
    "if(c.base, 1, 0)",
    "case c.kind when 2 then if(luhn_check(regexp_replace(c.m, '[^0-9]', '')), 1, -1) when 0 then if(c.m rlike '^[A-Za-z0-9].*[A-Za-z]$', 1, -1) when 3 then if(length(regexp_replace(c.m, '[^0-9]', '')) between 10 and 13, 1, -1) else if(c.base or contains(c.m, ':'), 1, -1) end",
    f"case c.kind when 0 then if(c.m rlike '(?i)[. ]({DOMAINS})$', 1, 0) when 2 then if(c.m rlike '^({ISSUERS})', 1, -1) when 1 then if(c.m rlike '^({RESERVED})', -1, 0) else if(c.m rlike '^[+(]', 1, 0) end",
    f"if(c.before rlike '(?i)\\\\b({FOR_IT})', 1, 0)",
    f"if(c.before rlike '(?i)\\\\b({AGAINST})', -1, 0)",
)
#: Spans that one fold goes over; more are folded in blocks, as a fold copies what it has gathered at each step.
FOLD = 256
_CANDIDATE = "struct<kind:int,base:boolean,start:bigint,end:bigint,m:string,before:string>"


def _let(name: str, value: str, body: str) -> str:
    """SQL for `body` with `value`, which is worked out once, under a name."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _blocks(array: str) -> str:
    """SQL for the blocks of a named array that isn't empty."""
    return f"transform(sequence(0, int((size({array}) - 1) div {FOLD})), b -> slice({array}, b * {FOLD} + 1, {FOLD}))"


def _spans(kind: int, guard: str, pattern: str, candidate: str, base: str) -> str:
    """SQL for the candidates that one pattern gives in the text __t, in order; offsets count code points."""
    m = "x.m"
    step = f"""struct(acc.pos + length(x.p) + length(x.m) AS pos, if({candidate.replace("m,", f"{m},")},
      concat(acc.found, array(named_struct('kind', {kind}, 'base', {base.replace("m rlike", f"{m} rlike").replace("(m,", f"({m},")}, 'start', acc.pos + length(x.p), 'end', acc.pos + length(x.p) + length(x.m), 'm', x.m, 'before', right(x.p, {CONTEXT})))),
      acc.found) AS found)"""
    pairs = f"filter(zip_with(split(__t, '{pattern}', -1), regexp_extract_all(__t, '{pattern}', 0), (p, m) -> struct(p, m)), x -> x.m is not null)"
    empty = f"cast(array() AS array<{_CANDIDATE}>)"
    folded = f"transform({_blocks('q')}, k -> aggregate(k, struct(0L AS pos, {empty} AS found), (acc, x) -> {step}))"
    offsets = "aggregate(r, array(0L), (acc, k) -> concat(acc, array(element_at(acc, -1) + k.pos)))"
    moved = "transform(k.found, f -> named_struct('kind', f.kind, 'base', f.base, 'start', f.start + o, 'end', f.end + o, 'm', f.m, 'before', f.before))"
    whole = _let("r", folded, f"flatten(zip_with(r, slice({offsets}, 1, size(r)), (k, o) -> {moved}))")
    return f"if({guard.format(t='__t')}, {_let('q', pairs, f'if(size(q) = 0, {empty}, {whole})')}, {empty})"


def _running(array: str, kind: str, value: str, least: str) -> str:
    """SQL for structs of each element x (of type `kind`) and m, the greatest `value` of those before it."""
    empty = f"cast(array() AS array<struct<x:{kind},m:bigint>>)"
    before = f"transform(sequence(0, size(r) - 1), i -> greatest({least}, coalesce(array_max(slice(tops, 1, i)), {least})))"
    fold = f"aggregate(k, struct(m0 AS m, {empty} AS out), (acc, x) -> struct(greatest(acc.m, {value}) AS m, concat(acc.out, array(struct(x AS x, acc.m AS m))) AS out), acc -> acc.out)"
    whole = _let("r", _blocks("q"), _let("tops", f"transform(r, k -> array_max(transform(k, x -> {value})))", f"flatten(zip_with(r, {before}, (k, m0) -> {fold}))"))
    return _let("q", array, f"if(size(q) = 0, {empty}, {whole})")


_SPAN = "struct<kind:int,start:bigint,end:bigint>"


def _free(base: str, added: str) -> str:
    """SQL for the added spans that overlap no base span: none reaches in from before, and none begins within."""
    kind, least = f"struct<at:bigint,added:int,v:bigint,t:bigint,c:{_SPAN}>", "-9223372036854775807L"

    def one_way(spans: str, at: str, v: str, t: str) -> str:
        both = f"array_sort(concat(transform({base}, c -> named_struct('at', {at}, 'added', 0, 'v', {v}, 't', 0L, 'c', c)), transform({spans}, c -> named_struct('at', {at}, 'added', 1, 'v', {least}, 't', {t}, 'c', c))))"
        return f"transform(filter({_running(both, kind, 'x.v', least)}, y -> y.x.added = 1 and y.m <= y.x.t), y -> y.x.c)"

    within = one_way("away", "-c.start", "-c.start", "-c.end")
    return f"if(size({added}) = 0, {added}, {_let('away', one_way(added, 'c.start', 'c.end', 'c.start'), f'array_sort({within})')})"


def candidates(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add `candidates`, with the labelers' votes; a null text has none.

    Columns of `docs` named candidates, base or added, in any case, give way.
    """
    kept = without(docs, ["candidates", "base", "added"]).columns if keep is None else keep
    own = docs.select(*[F.col(f"`{c}`") for c in kept], F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("__t"))
    found = own.withColumn("__found", F.expr("concat(" + ", ".join(_spans(*p) for p in PATTERNS) + ")"))
    votes = f"transform(__found, c -> struct(c.kind, c.base, c.start, c.end, array({', '.join(LABELERS)}) AS votes))"
    return found.select(*[F.col(f"`{c}`") for c in kept], F.expr(votes).alias("candidates"))


# Expectation-maximisation, as folds over an array of (kind, votes, n): state th has, for each labeler, the
# probabilities of the votes -1, 0 and 1 given that a span is personal data (0 to 2) and that it isn't (3 to 5).
_LOG_ODDS = "aggregate(zip_with(p.votes, th.t, (v, t) -> ln(t[v + 1] / t[v + 4])), ln(th.prior / (1 - th.prior)), (a, b) -> a + b)"
_POSTERIOR = f"1 / (1 + exp(-greatest(-30D, least(30D, {_LOG_ODDS}))))"


def _sum(what: str) -> str:
    return f"aggregate(q, 0D, (a, p) -> a + {what})"


def _em() -> str:
    """SQL for the array of (features, weight, posterior) after the last round."""
    start = "array(0.05D, 0.25D, 0.7D, 0.6D, 0.3D, 0.1D)"
    init = f"named_struct('prior', 0.5D, 't', array_repeat({start}, {len(LABELERS)}))"
    scored = f"transform(seen, p -> named_struct('kind', p.kind, 'votes', p.votes, 'n', p.n, 'q', {_POSTERIOR}))"
    cell = lambda sign, v: f"({_sum(f'if(p.votes[l] = {v}, p.n * ({sign}), 0D)')} + 1D) / ({_sum(f'p.n * ({sign})')} + 3D)"
    cells = ", ".join(cell(sign, v) for sign in ("p.q", "1 - p.q") for v in (-1, 0, 1))
    maximised = f"named_struct('prior', ({_sum('p.n * p.q')} + 1D) / ({_sum('cast(p.n as double)')} + 2D), 't', transform(sequence(0, {len(LABELERS) - 1}), l -> array({cells})))"
    let = f"element_at(transform(array({scored}), q -> {maximised}), 1)"
    return f"aggregate(sequence(1, {EM_ROUNDS}), {init}, (th, round) -> {let})"


def _features(votes: str, kind: str) -> str:
    ones = ", ".join(f"if({kind} = {k}, 1D, 0D)" for k in range(len(KINDS)))
    return f"concat(transform({votes}, v -> cast(v AS double)), array({ones}))"


_DOT = "aggregate(zip_with(w, p.x, (a, b) -> a * b), 0D, (a, b) -> a + b)"


def fit(marked: DataFrame) -> list[float]:
    """Weights of the span classifier, for the votes and the kinds, from all candidates.

    Only counts of vote patterns are gathered: at most 3^5 for each kind.  No
    candidates: weights of 0, which add nothing.
    """
    seen = marked.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes").agg(F.count("*").alias("n"))
    one = seen.agg(F.array_sort(F.collect_list(F.struct("kind", "votes", "n"))).alias("seen"))
    learned = one.withColumn("th", F.expr(_em())).withColumn("soft", F.expr(f"transform(seen, p -> named_struct('x', {_features('p.votes', 'p.kind')}, 'n', cast(p.n AS double), 'q', {_POSTERIOR}))"))
    size = len(LABELERS) + len(KINDS)
    error = f"p.n * (1 / (1 + exp(-greatest(-30D, least(30D, {_DOT})))) - p.q)"
    gradient = f"aggregate(soft, array_repeat(0D, {size}), (g, p) -> zip_with(g, transform(p.x, x -> x * ({error})), (a, b) -> a + b))"
    step = f"zip_with(w, {gradient}, (a, b) -> a - {FIT_RATE} * (b / total + 0.01D * a))"
    learned = learned.withColumn("total", F.expr("greatest(1D, aggregate(soft, 0D, (a, p) -> a + p.n))"))
    learned = learned.select(F.expr(f"aggregate(sequence(1, {FIT_ROUNDS}), array_repeat(0D, {size}), (w, round) -> {step})").alias("w"))
    return list(learned.first().w)


def spans(marked: DataFrame, weights: list[float]) -> DataFrame:
    """Turn `candidates` into `base` and `added`, arrays of (kind, start, end) by kind, start and end."""
    weigh = "array(" + ", ".join(f"{w!r}D" for w in weights) + ")"
    p = f"1 / (1 + exp(-aggregate(zip_with({weigh}, {_features('c.votes', 'c.kind')}, (a, b) -> a * b), 0D, (a, b) -> a + b)))"
    bare = "struct(c.kind AS kind, c.start AS start, c.end AS end)"
    own = marked.withColumn("base", F.expr(f"array_sort(transform(filter(candidates, c -> c.base), c -> {bare}))"))
    # Each candidate's own pattern keeps it from overlapping others of its kind and origin.
    own = own.withColumn("added", F.expr(f"array_sort(transform(filter(candidates, c -> not c.base and {p} > {LEAST_PROBABILITY}), c -> {bare}))")).drop("candidates")
    return own.withColumn("added", F.expr(_free("base", "added")))


def find(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add `base` and `added` spans of every whole text; null and empty texts have none.

    The classifier is fitted on the candidates of all rows given.  Repeated rows
    get the same spans; an empty table gives an empty table.
    """
    marked = durable(candidates(docs, text=text, keep=keep))
    return spans(marked, fit(marked))


def _named(array: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({array}, s -> concat({names}[s.kind], ':', s.start, ':', s.end)), ',')"


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and all spans of every document."""
    found = find(table(spark, sf_dir, "documents"), keep=["doc_id"])
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) AS bigint)").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(F.expr(_named("base")), 256).alias("base_sha256"), F.expr(_named("array_sort(concat(base, added))")).alias("spans"))


def masked(docs: DataFrame, *, text: str = "text") -> DataFrame:
    """Replace the personal data of each text by the names of its kinds, as in <email>.

    Overlapping spans are replaced as one, by the name of the first.  All other
    columns stay; a null text stays null.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(f"`{text}`").cast("string").alias("__text"))
    # Matching twice is cheaper than keeping all texts: the fit needs only the candidates' counts.
    weights = fit(candidates(rows, text="__text", keep=[]))
    found = spans(candidates(rows, text="__text", keep=["__row", "__text"]), weights)
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    ordered = "array_sort(transform(concat(base, added), s -> struct(s.start AS start, s.end AS end, s.kind AS kind)))"
    last = "array_max(transform(k, y -> greatest(y.m, y.x.end)))"
    put = f"if(y.x.start < y.m, '', concat(substring(part, int(y.m - k[0].m + 1), int(y.x.start - y.m)), '<', {names}[y.x.kind], '>'))"
    block = _let("part", f"substring(__text, int(k[0].m + 1), int({last} - k[0].m))", f"array_join(transform(k, y -> {put}), '')")
    rest = "substring(__text, int(array_max(transform(concat(base, added), s -> s.end)) + 1))"
    whole = _let("q", _running(ordered, "struct<start:bigint,end:bigint,kind:int>", "x.end", "0L"), f"concat(array_join(transform({_blocks('q')}, k -> {block}), ''), {rest})")
    new = F.expr(f"if(size(base) + size(added) = 0, __text, {whole})")
    return found.select(*[(new if c == text else F.col("__row").getField(c)).alias(c) for c in docs.columns])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask personal data; n_chars follows the text, all other columns stay; null and empty texts stay as they are."""
    out = masked(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else out
