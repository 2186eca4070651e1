"""Document files: text, markdown and binary sources, content-addressed caching, and an optional PDF reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.text import LATIN_WORD

#: Suffixes of documents.
SUFFIXES = ("md", "markdown", "pdf", "txt")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """path, kind, checksum and content (bytes) of all document files under a path; other suffixes are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").load(path)
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kind = F.when(suffix == "pdf", "pdf").when(suffix == "txt", "text").otherwise("markdown")
    return files.select("path", kind.alias("kind"), F.sha2("content", 256).alias("checksum"), "content")


def read_text(files: DataFrame) -> DataFrame:
    """path, checksum, text and headings of the files that are text; damaged UTF-8 becomes replacement characters."""
    text = F.decode("content", "UTF-8")
    return files.where("kind <> 'pdf'").select("path", "checksum", text.alias("text"), F.regexp_count(text, F.lit(r"(?m)^#{1,6}\s+\S")).alias("headings"))


def uncached(files: DataFrame, cache: DataFrame, profile: str) -> tuple[DataFrame, DataFrame]:
    """(files to convert, cached rows that hold): by checksum and parser profile; a cached row whose content hash is wrong is a miss."""
    held = cache.where((F.col("profile") == profile) & (F.sha2("text", 256) == F.col("content_sha256")))
    return files.join(held.select("checksum"), "checksum", "left_anti"), held.join(files.select("checksum").distinct(), "checksum", "left_semi")


def read_pdf_pages(files: DataFrame) -> DataFrame:
    """path, page and text of PDF files, where a public PDF library is installed on the executors."""
    import importlib.util

    name = next((n for n in ("pypdfium2", "pypdf") if importlib.util.find_spec(n)), None)
    if name is None:
        raise RuntimeError("no PDF library is installed; give page texts as a table instead")

    def run(batches):
        import importlib
        import io

        import pandas as pd

        library = importlib.import_module(name)
        for frame in batches:
            rows = []
            for path, content in zip(frame["path"], frame["content"], strict=True):
                if name == "pypdf":
                    texts = [p.extract_text() or "" for p in library.PdfReader(io.BytesIO(content)).pages]
                else:
                    document = library.PdfDocument(content)
                    texts = [document[i].get_textpage().get_text_range() for i in range(len(document))]
                rows += [(path, n, t) for n, t in enumerate(texts, 1)]
            yield pd.DataFrame(rows, columns=["path", "page", "text"])

    return files.where("kind = 'pdf'").select("path", "content").mapInPandas(run, "path string, page long, text string")


def words(text: str) -> F.Column:
    return F.regexp_count(F.col(text), F.lit(LATIN_WORD))
