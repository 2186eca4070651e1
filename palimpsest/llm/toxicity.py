"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon is a fixed list of English insults plus the words and word stems
that a bounded labelled sample shows almost only in toxic texts.  Features are
densities and rates of whole texts; the trees and the calibration are fitted
here, on different halves of the sample.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.batches import annotate, crc_mod, durable, labelled_sample, labelled_texts, table

#: Sampled rows of each label.
SAMPLE_PER_LABEL = 3_000
#: A stem enters the lexicon with this many toxic texts and this ratio of shares, if so large a part of all texts that have it is toxic; so many stems at most.
LEAST_TEXTS, LEAST_RATIO, LEAST_PRECISION, MOST_STEMS = 6, 20.0, 0.75, 400
#: Boosting: trees, depth, learning rate, bins of a feature, least rows of a leaf, L2 strength.
TREES, DEPTH, RATE, BINS, LEAF, RIDGE = 60, 3, 0.15, 32, 5, 1.0

#: Insults in English.
INSULTS = ("bastard", "bitch", "clown", "cretin", "cunt", "degenerate", "dickhead", "disgusting", "dumbass", "fool", "fuck", "garbage", "idiot", "imbecile", "jerk", "loser", "moron", "pathetic", "scum", "shit", "slut", "stupid", "trash", "vermin", "whore", "worthless")
#: Second person in the languages of the corpus.
SECOND_PERSON = ("you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "te", "toi", "ton", "ta", "tes", "vous", "votre", "vos", "usted", "ustedes", "ti", "tus", "vosotros")
#: Digits and signs that stand for letters.
LOOKALIKES = str.maketrans("013457@$!", "oieastasi")

_WORD = re.compile(r"[^\W\d_]+")
_MASK = re.compile(r"[^\W\d_][0-9@$!*]+[^\W\d_]")
#: Where a letter follows a digit or sign, and the rest of a masked word; fixed signs that stand for letters.
_TURN, _REST, _SIGNS = re.compile(r"[0-9@$!*][^\W\d_]"), re.compile(r"[\w@$!*]*"), "0123456789@$!*"
#: Letters and digits of any script, as a text's end read backwards begins with them.
_ALNUM, _LETTER = re.compile(r"[^\W_]*"), re.compile(r"[^\W\d_]")
_SPACED = re.compile(r"(?<![^\W\d_])(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?![^\W\d_])")
_STRETCHED = re.compile(r"([^\W\d_])\1{3,}")
FEATURES = ("insults", "stems", "either", "any", "near_you", "you", "capitals", "shouted", "exclaims", "signs", "obfuscated", "masked", "spaced", "stretched", "length")
#: Words before a hit that count as near it.
NEAR = 5


@dataclass
class ToxicityModel:
    """Learned stems, trees as (features, thresholds, leaves) and the calibration's steps."""

    stems: list[str]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    start: float = 0.0
    steps: tuple[np.ndarray, np.ndarray] = (np.zeros(1), np.zeros(1))


def stems_of(text: str) -> set[str]:
    """Whole words, marked by a final $, and their beginnings of 4 to 6 letters."""
    found = set()
    for word in set(_WORD.findall(text.lower())):
        if len(word) >= 4:
            found.add(word + "$")
            found.update(word[:n] for n in (4, 5, 6) if len(word) > n)
    return found


class Lexicon:
    """Insults and learned stems, found through the first four letters of a word."""

    def __init__(self, stems: list[str]):
        self.insults, self.second = frozenset(INSULTS), frozenset(SECOND_PERSON)
        self.whole = frozenset(s[:-1] for s in stems if s.endswith("$"))
        self.begun = frozenset(s for s in stems if not s.endswith("$"))
        self.first = frozenset(w[:4] for w in (*INSULTS, *self.whole, *self.begun))

    def learned(self, word: str) -> bool:
        return word in self.whole or any(word[:n] in self.begun for n in (4, 5, 6))

    def insult(self, word: str) -> bool:
        return word in self.insults or word.rstrip("s") in self.insults


def masked_words(text: str) -> list[str]:
    """Words, from their first letter on, in which digits or signs are followed by a letter, in time linear in the text.

    Such a word begins with a letter that follows no letter or digit; then come
    letters and digits, then digits and signs, then a letter, then whatever of
    all these and underscores is left of the run.
    """
    found, done = [], 0
    turn = _TURN.search(text)
    while turn:
        at = turn.start()
        before = text[done : at + 1].rstrip(_SIGNS)
        own = _ALNUM.match(before[::-1]).end()
        start = done + len(before) - own
        follows = start == done > 0 and text[done - 1].isalnum()
        if own and _LETTER.match(text, start) and not follows:
            done = _REST.match(text, at + 1).end()
            found.append(text[start:done])
        else:
            done = at + 1
        turn = _TURN.search(text, max(done, at + 1))
    return found


def features(text: str, lexicon: Lexicon) -> list[float]:
    """Dense features of a whole text; all 0 where it is empty."""
    if not text:
        return [0.0] * len(FEATURES)
    words, low, raw = _WORD.findall(text), _WORD.findall(text.lower()), text.encode("utf-8", "replace")
    n, size = max(1, len(words)), len(raw)
    first, second = lexicon.first, lexicon.second
    likely = [(k, w) for k, w in enumerate(low) if w[:4] in first]
    known = [k for k, w in likely if lexicon.insult(w)]
    own = [k for k, w in likely if lexicon.learned(w)]
    hits = sorted({*known, *own})
    near = sum(not second.isdisjoint(low[max(0, k - NEAR) : k + NEAR + 1]) for k in hits)
    masked = masked_words(text) if _MASK.search(text) else []
    spaced = _SPACED.findall(text)
    hidden = sum(lexicon.insult(w.lower().translate(LOOKALIKES)) for w in masked) + sum(lexicon.insult("".join(_WORD.findall(w)).lower()) for w in spaced)
    stretched = len(_STRETCHED.findall(text))
    upper, letters = size - len(raw.translate(None, _UPPER)), max(1, size - len(raw.translate(None, _LETTERS)))
    return [
        1000 * (len(known) + hidden) / n, 1000 * len(own) / n, 1000 * (len(hits) + hidden) / n, float(min(4, len(hits) + hidden)), 1000 * near / n, 1000 * sum(map(second.__contains__, low)) / n,
        upper / letters, sum(w.isupper() for w in words if len(w) > 2) / n, 100 * (text.count("!") + text.count("?")) / size, 100 * (size - len(raw.translate(None, b"#$%&*@"))) / size, float(hidden), 1000 * len(masked) / n, 1000 * len(spaced) / n, 1000 * stretched / n, float(np.log1p(n)),
    ]


_UPPER, _LETTERS = bytes(range(65, 91)), bytes([*range(65, 91), *range(97, 123), *range(128, 256)])


def dense(df: DataFrame, stems: list[str], text: str, keep: list[str], finish=None, fields=None) -> DataFrame:
    """Add the packed features of each text, or what `finish` makes of a batch of them."""
    sent = df.sparkSession.sparkContext.broadcast(stems)

    def compute(piece: pa.RecordBatch, at: int) -> list[pa.Array]:
        lexicon = Lexicon(sent.value)
        x = np.array([features(v or "", lexicon) for v in piece.column(at).to_pylist()], np.float64).reshape(-1, len(FEATURES))
        return finish(x) if finish else [pa.array([row.tobytes() for row in x], pa.binary())]

    return annotate(df, text, fields or [("x", T.BinaryType())], compute, keep)


def learn_lexicon(rows: DataFrame) -> list[str]:
    """Stems of sampled rows (text, y) that toxic texts have far more often, from counts by label.

    At most MOST_STEMS, by toxic texts times the log ratio of smoothed shares;
    copies of one text count once, so their words don't pass for insults; a longer stem is left
    out where a shorter one within it covers it.
    """

    def compute(piece: pa.RecordBatch, at: int) -> list[pa.Array]:
        return [pa.array([sorted(stems_of(v or "")) for v in piece.column(at).to_pylist()], pa.list_(pa.string()))]

    rows = rows.groupBy(F.md5("text").alias("address"), "y").agg(F.min("text").alias("text"), F.avg("weight").alias("weight"))
    stems = annotate(rows, "text", [("stems", T.ArrayType(T.StringType()))], compute, ["y"])
    sizes = {r.y: r["count"] for r in rows.groupBy("y").count().collect()}
    counts = stems.select("y", F.explode("stems").alias("stem")).groupBy("stem").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))
    weighs = {r.y: r.w for r in rows.groupBy("y").agg(F.avg("weight").alias("w")).collect()}
    precision = F.col("toxic") * weighs.get(1, 1.0) / (F.col("toxic") * weighs.get(1, 1.0) + (F.col("clean") + 0.5) * weighs.get(0, 1.0))
    ratio = ((F.col("toxic") + 0.0) / max(1, sizes.get(1, 0))) / ((F.col("clean") + 0.5) / max(1, sizes.get(0, 0)))
    counts = counts.where(F.col("toxic") >= LEAST_TEXTS).withColumn("ratio", ratio).where((F.col("ratio") >= LEAST_RATIO) & (precision >= LEAST_PRECISION))
    best = counts.orderBy(F.desc(F.col("toxic") * F.log("ratio")), F.length("stem"), "stem").limit(4 * MOST_STEMS).collect()
    chosen: list[str] = []
    for stem in sorted((r.stem for r in best), key=lambda s: (len(s), s)):
        if not any(stem.startswith(c) for c in chosen if not c.endswith("$")):
            chosen.append(stem)
    rank = {r.stem: k for k, r in enumerate(best)}
    return sorted(sorted(chosen, key=rank.get)[:MOST_STEMS])


def grow(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[list, float]:
    """Logistic boosting with histogram splits; each tree is complete, with constant leaves."""
    prior = float(np.clip((y * weight).sum() / weight.sum(), 1e-4, 1 - 1e-4))
    start = float(np.log(prior / (1 - prior)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
    margin, trees = np.full(len(y), start), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(len(y), np.int64)
        chosen, threshold = np.zeros(2**DEPTH - 1, np.int64), np.full(2**DEPTH - 1, np.inf)
        for level in range(DEPTH):
            first, width = 2**level - 1, 2**level
            local = node - first
            best = np.full(width, 1e-9)
            for j, c in enumerate(cuts):
                if not len(c):
                    continue
                key, size = local * (len(c) + 1) + binned[:, j], width * (len(c) + 1)
                sums = [np.cumsum(np.bincount(key, w, size).reshape(width, -1), axis=1) for w in (g, h, None)]
                (gl, hl, nl), (gt, ht, nt) = [s[:, :-1] for s in sums], [s[:, -1:] for s in sums]
                gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(nl < LEAF) | (nt - nl < LEAF)] = 0
                k = gain.argmax(axis=1)
                better = gain[np.arange(width), k] > best
                best = np.where(better, gain[np.arange(width), k], best)
                chosen[first : first + width][better] = j
                threshold[first : first + width][better] = c[k[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), chosen[node]] > threshold[node])
        leaf = node - (2**DEPTH - 1)
        value = -RATE * np.bincount(leaf, g, 2**DEPTH) / (np.bincount(leaf, h, 2**DEPTH) + RIDGE)
        trees.append((chosen, threshold, value))
        margin += value[leaf]
    return trees, start


def margins(x: np.ndarray, trees: list, start: float) -> np.ndarray:
    total = np.full(len(x), start)
    rows = np.arange(len(x))
    for chosen, threshold, value in trees:
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, chosen[node]] > threshold[node])
        total += value[node - (2**DEPTH - 1)]
    return total


def isotonic(margin: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators; the steps are joined by straight lines."""
    order = np.argsort(margin, kind="stable")
    blocks: list[list[float]] = []  # sum of weighted y, weight, sum of weighted margin
    for m, t, w in zip(margin[order], y[order], weight[order], strict=True):
        blocks.append([t * w, w, m * w])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks])


def fit(docs: DataFrame, labels: DataFrame, train: F.Column, *, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_label: int = SAMPLE_PER_LABEL) -> ToxicityModel:
    """Learn lexicon, trees and calibration from at most `per_label` rows of each label.

    Rows are weighted to the labels' true shares.  Two in three sampled rows
    grow the trees, the rest calibrate.  No labelled rows: every score is 0.
    """
    chosen = labelled_sample(labels, doc_id, label, train, per_label)
    rows = durable(labelled_texts(docs, chosen, doc_id, text))  # read by the lexicon, by its counts and by the features
    model = ToxicityModel(learn_lexicon(rows))
    found = sorted(dense(rows, model.stems, "text", ["h", "y", "weight"]).collect(), key=lambda r: (r.h, r.y))
    if not found:
        return model
    x, y, weight = np.stack([np.frombuffer(r.x) for r in found]), np.array([float(r.y) for r in found]), np.array([r.weight for r in found])
    weight = weight * len(found) / weight.sum()
    apart = np.arange(len(found)) % 3 == 2
    if apart.sum() < 20:
        apart[:] = True
        model.trees, model.start = grow(x, y, weight)
    else:
        model.trees, model.start = grow(x[~apart], y[~apart], weight[~apart])
    model.steps = isotonic(margins(x[apart], model.trees, model.start), y[apart], weight[apart])
    return model


def score(docs: DataFrame, model: ToxicityModel, *, text: str = "text", threshold: float = 0.7, keep: list[str] | None = None) -> DataFrame:
    """Add score (0 to 1) and predicted (1 from `threshold` up) from whole texts.

    A null or empty text has features of 0 and the score these lead to.
    Repeated rows score alike.
    """
    trees, start, steps = model.trees, model.start, model.steps

    def finish(x: np.ndarray) -> list[pa.Array]:
        p = np.interp(margins(x, trees, start), *steps)
        return [pa.array(p, pa.float64()), pa.array((p >= threshold).astype(np.int32), pa.int32())]

    return dense(docs, model.stems, text, docs.columns if keep is None else keep, finish, [("score", T.DoubleType()), ("predicted", T.IntegerType())])


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document; a null id is not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), crc_mod("doc_id", 3) != 1)
    docs = docs.withColumn("held_out", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)))
    return score(docs, model, keep=["doc_id", "held_out"])
