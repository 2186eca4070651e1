"""The pipeline, stage by stage, against a brute-force version, and the driver's guard."""

import os
import subprocess
import sys
from pathlib import Path

from pyspark.sql import functions as F

import corpus_pipeline
from palimpsest.llm import decontamination, language, near_dedup, queries

ROOT = Path(__file__).resolve().parents[2]


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, before, data).write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        ids = {r.doc_id for r in after.select("doc_id").collect()}
        rows = {r.doc_id: r.text for r in before.select("doc_id", "text").collect()}
        assert ids <= rows.keys() and after.count() == len(ids)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == columns
        if name == "language":
            marked = language.predict(before, language.fit(before, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1))
            assert ids == {r.doc_id for r in marked.where("not rejected").collect()} and len(ids) > 0.9 * len(rows)
        elif name == "near_dedup":
            assert ids == {r.doc_id for r in near_dedup.near_duplicates(before).where("kept").collect()}
        elif name == "decontamination":
            items = [decontamination.normalised(r.text) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
            held = {i for i, t in rows.items() if any(x in decontamination.normalised(t) for x in items)}
            assert not ids & held and len(rows) - len(ids) <= 2 * len(held) + 1
        elif name == "pii":
            assert ids == rows.keys() and after.where(F.col("text").rlike(r"[A-Za-z0-9]@[a-z0-9]+\.example\.com")).count() == 0
        elif name == "pieces":
            assert ids == rows.keys() and after.where("not lossless").count() == 0
        before = after
    assert corpus_pipeline.run(spark, data).count() == before.count()


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


def test_entry_without_this_subpackage(tmp_path):
    for name in ("palimpsest", "__spark_entry__.py"):
        os.system(f"cp -r {ROOT / name} {tmp_path}")
    os.system(f"rm -r {tmp_path}/palimpsest/llm")
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; assert e.queries() and not any(n[:2] == 'op' and n[2].isdigit() or n == 'pipeline' for n in e.queries()); print(len(e.oracle_sql()))"], cwd=tmp_path, env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
