"""Every registered query with SQL against DuckDB on the smallest tables."""

import hashlib
import math
import os

import duckdb
import pytest

from palimpsest import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v + 0.0) if isinstance(v, float) else repr(v)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_as_sql(spark, data, duck, name):
    df = queries.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    sql = duck.sql(queries.ORACLES[name])
    assert columns == sorted(sql.columns)
    want = duck.sql(f"SELECT {', '.join(f'"{c}"' for c in columns)} FROM ({queries.ORACLES[name]})").fetchall()
    got = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(tuple(map(plain, r)) for r in got) == sorted(tuple(map(plain, r)) for r in want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_others_run(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() > 0


def test_evidence_of_every_document(spark, tmp_path):
    texts = ["0123456789100% of a_b in this place", "0123456789plain", None, "", "short"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.held for r in queries.QUERIES["evidence_containment"](spark, str(tmp_path)).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True}


def test_bundles_cover_whole_texts(spark, tmp_path):
    texts = ["first half " * 200 + "second half " * 200, "# A\none\n## B\ntwo 😀 end", "", None, "x" * 9000]
    spark.createDataFrame([(i, "s", t) for i, t in enumerate(texts)], "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.QUERIES["source_bundles_whole"](spark, str(tmp_path)).collect()
    for i, t in enumerate(texts):
        t, own = t or "", [r for r in rows if r.source_key == f"s/{i}"]
        assert own and all(r.content_sha256 == hashlib.sha256(t[r.start : r.end].encode()).hexdigest() for r in own)
        inside = {k for r in own for k in range(r.start, r.end)}
        assert all(k in inside or c.isspace() for k, c in enumerate(t))
