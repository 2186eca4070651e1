"""Language ID by compression.

Each language gets a raw-content zstandard dictionary, put together from windows
of a bounded sample of its training texts.  A whole text, in lower case, is compressed window by window with every
dictionary; the language whose dictionary leaves the fewest bytes wins, and the
answer is rejected when the runner-up comes too close.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.batches import annotate, crc_mod, filtered, named, once, table

#: Distinct training texts of each language, the characters of the windows they are cut into, and the bytes of its dictionary.
SAMPLE_TEXTS, SAMPLE_WINDOW, DICTIONARY_BYTES = 96, 512, 65_536
#: Parts of a language's texts that are ranked apart first.
PARTS = 32
#: All dictionaries together go to every executor; with very many languages each gets less.
ALL_DICTIONARIES_BYTES = 64 << 20
#: Bytes of text compressed at a time, so that the dictionary counts throughout a long text.
WINDOW = 2_048
#: Short matches count: the languages share most of their longer strings.
COMPRESSION = dict(strategy=zstandard.STRATEGY_LAZY, min_match=4, window_log=17, hash_log=15, chain_log=15, search_log=2, target_length=16, write_content_size=False)
#: Relative margin to the runner-up under which a prediction is rejected, and the margin scale of the score.
NARROW, SCALE = 0.002, 0.02
_LETTER = regex.compile(r"\p{L}")


@dataclass
class LanguageModel:
    """Languages in sorted order and the dictionary of each."""

    languages: list[str]
    dictionaries: list[bytes]


def fit(docs: DataFrame, train: Column, *, text: str = "text", lang: str = "lang") -> LanguageModel:
    """One dictionary per language, from the distinct training texts of least hash.

    Sampled texts are cut into windows from end to end.  Windows are taken in
    turns, one of each text, in the order of their hashes, until the dictionary
    is full, so that neither a long text nor a common opening fills it.  Copies
    count once.  Rows with a null or empty text, or a null language, teach
    nothing.  No rows: a model without languages, which predicts `und`.
    """
    rows = docs.where(train).select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.where("lang is not null and text <> ''").withColumn("h", F.xxhash64("text"))
    languages = rows.select("lang").distinct().count()
    each = max(1, min(DICTIONARY_BYTES, ALL_DICTIONARIES_BYTES // max(1, languages)) // SAMPLE_WINDOW)
    least = rows.select("lang", "h").distinct()
    # The least of each part of a language, then the least of these: no task sees all texts of a language.
    for part in (F.pmod("h", F.lit(PARTS)), F.lit(0)):
        rank = F.row_number().over(Window.partitionBy("lang", "part").orderBy("h"))
        least = least.withColumn("part", part).withColumn("n", rank).where(F.col("n") <= SAMPLE_TEXTS).drop("n")
    # SAMPLE_TEXTS rows a language at most, and so bounded like the dictionaries.
    texts = rows.join(F.broadcast(least.select("lang", "h")), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text"))
    cut = F.expr(f"transform(sequence(0, int((length(text) - 1) div {SAMPLE_WINDOW})), k -> substring(text, k * {SAMPLE_WINDOW} + 1, {SAMPLE_WINDOW}))")
    windows = texts.select("lang", "h", F.posexplode(cut).alias("k", "window")).withColumn("order", F.xxhash64("h", "k"))
    windows = windows.withColumn("turn", F.row_number().over(Window.partitionBy("lang", "h").orderBy("order", "k")))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("turn", "order", "h", "k"))
    windows = windows.withColumn("place", place).where(F.col("place") <= each)
    samples: dict[str, list[bytes]] = {}
    for r in windows.select("lang", "place", "window").orderBy("lang", "place").collect():
        samples.setdefault(r.lang, []).append(r.window.lower().encode())
    model = LanguageModel([], [])
    for name in sorted(samples):
        model.languages.append(name)
        model.dictionaries.append(b"\n".join(reversed(samples[name])))
    return model


def _judge(spark: SparkSession, model: LanguageModel):
    """The name of the compressors, and a function that gives languages, scores and rejections of the texts of a batch."""
    sent = spark.sparkContext.broadcast(model)
    key = named("zstd", repr((COMPRESSION, WINDOW, model.languages)).encode(), *model.dictionaries)

    def compressors() -> list[zstandard.ZstdCompressor]:
        made, parameters = [], zstandard.ZstdCompressionParameters(**COMPRESSION)
        for content in sent.value.dictionaries:
            own = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(compression_params=parameters)
            made.append(zstandard.ZstdCompressor(compression_params=parameters, dict_data=own))
        return made

    def judge(piece: pa.RecordBatch, at: int) -> tuple[list[str], list[float], list[bool]]:
        names, held = sent.value.languages, once(key, compressors)
        pred, score, rejected = [], [], []
        for value in piece.column(at).to_pylist():
            if not value or not held or not _LETTER.search(value):
                pred.append("und"), score.append(0.0), rejected.append(True)
                continue
            raw = memoryview(value.lower().encode())
            windows = [raw[i : i + WINDOW] for i in range(0, len(raw), WINDOW)]
            left = np.array([sum(len(c.compress(w)) for w in windows) for c in held])
            order = np.argsort(left, kind="stable")
            margin = 1.0 if len(order) == 1 else float(left[order[1]] - left[order[0]]) / float(left[order[1]])
            pred.append(names[order[0]]), score.append(1.0 - float(np.exp(-margin / SCALE))), rejected.append(margin < NARROW)
        return pred, score, rejected

    return key, judge


def predict(docs: DataFrame, model: LanguageModel, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add lang_pred, score and rejected to every row, from its whole text.

    A null text, or one without a letter: `und`, score 0, rejected.  Ties go to
    the language that sorts first and are rejected.  With one learned language
    there is no runner-up: score 1.  Rows are independent; repeated ids keep
    their own answers.
    """
    key, judge = _judge(docs.sparkSession, model)

    def compute(piece: pa.RecordBatch, at: int) -> list[pa.Array]:
        pred, score, rejected = judge(piece, at)
        return [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())]

    fields = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("rejected", T.BooleanType())]
    return annotate(docs, text, fields, compute, keep, key=key)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every document; a null id is not held out."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, crc_mod("doc_id", 3) != 1)
    docs = docs.withColumn("held_out", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)))
    return predict(docs, model, keep=["doc_id", "held_out"])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is clear, with all their columns; texts that are null, empty or without letters go."""
    key, judge = _judge(spark, fit(docs, crc_mod("doc_id", 3) != 1))
    return filtered(docs, "text", lambda piece, at: ~np.array(judge(piece, at)[2], bool), key)
