"""Filter audit, byte-level BPE and fill-in-the-middle against SQL, libraries and plain versions."""

import hashlib
import random
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

import public_tokenizers
from palimpsest.llm import bytepair, fim, interactions
from palimpsest.llm.queries import ORACLES, QUERIES

LONG = "lorem ipsum dolor sit amet\n" * 4000
TEXTS = [None, "", "é\r\n\n", "one two  three\nfour", "one two  three\nfour", "a <P> mark", "x" * 5000, LONG, "<\nP>\n<S\n>", "\n\n\n", "Don't we'll 12 345 ---\t　  ß\U0001f600\U00010d4a", "ABC DEF $", "a a a a"]


def rows_of(spark, texts, repeat=1):
    return spark.createDataFrame([(i, t, None if i % 5 == 0 else f"s{i % 2}") for i, t in enumerate(texts)] * repeat, "doc_id long, text string, source string")


def as_in_sql(spark, name, folder, tables):
    con = duckdb.connect()
    for t, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    df = QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want))
    return len(want)


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_fill_in_middle"])
def test_whole_tables_as_in_sql(spark, data, tmp_path, name):
    tables = {t: spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels")}
    assert as_in_sql(spark, name, tmp_path, tables)


@pytest.mark.parametrize("name", ["op11_filter_audit", "op13_fill_in_middle"])
def test_odd_rows_as_in_sql(spark, tmp_path, name):
    labels = spark.createDataFrame([(i, i % 3 % 2, i % 2) for i in range(10)] + [(3, 1, 1), (4, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    docs = rows_of(spark, TEXTS, 2).unionByName(spark.createDataFrame([(None, "one two  three\nfour", "s1"), (None, None, None)], "doc_id long, text string, source string"))
    assert as_in_sql(spark, name, tmp_path, {"documents": docs, "labels": labels})
    assert as_in_sql(spark, name, tmp_path / "none", {"documents": docs.limit(0), "labels": labels}) == 0


def test_audit_of_any_filters_is_that_of_plain_counts(spark):
    rng = random.Random(5)
    rows = [(rng.choice("pq"), *(rng.random() < 0.4 for _ in range(3)), rng.randint(0, 1)) for _ in range(200)]
    flagged = spark.createDataFrame(rows, "part string, X boolean, Y boolean, Z boolean, dear int")
    got = {(r.part, r.filter_order, r.step): r for r in interactions.audit(flagged, list("XYZ"), {"dear": F.col("dear")}).collect()}
    assert len(got) == 2 * 6 * 3
    total = {}
    for part in "pq":
        for order in permutations("XYZ"):
            left = [r for r in rows if r[0] == part]
            for k, f in enumerate(order):
                at = 1 + "XYZ".index(f)
                gone = [r for r in left if r[at]]
                fails = [r for r in rows if r[0] == part and r[at]]
                left = [r for r in left if not r[at]]
                r = got[part, "".join(order), k + 1]
                assert (r.kept, r.removed, r.redundant, r.dear_lost) == (len(left), len(gone), len(fails) - len(gone), sum(x[4] for x in gone))
                assert r.unique_fails == sum(sum(x[1:4]) == 1 for x in fails)
                total[part, f] = total.get((part, f), 0) + len(gone)
    assert all(r.shapley == total[part, order[step - 1]] for (part, order, step), r in got.items())
    with pytest.raises(ValueError):
        interactions.audit(flagged, ["X", "X"])


@pytest.fixture(scope="module")
def ranks():
    return bytepair.read_ranks(public_tokenizers.path(bytepair.DEFAULT_VOCABULARY))


@pytest.fixture(scope="module")
def library(ranks):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks.tokens, special_tokens={})


def test_ids_are_the_librarys(spark, ranks, library, monkeypatch):
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choices("abcdefghij", k=3000)), "".join(f"a{chr(c)}" for c in rng.sample([*range(0xD800), *range(0xE000, 0x110000)], 4000)), "ab" * 2500]
    pattern = bytepair.java_pattern(spark, public_tokenizers.PATTERN)
    want = {i: library.encode_ordinary(t or "") for i, t in enumerate(texts)}
    for frequent in (1 << 20, 10):  # all words are looked up; nearly all are encoded where they stand
        monkeypatch.setattr(bytepair, "FREQUENT", frequent)
        docs = rows_of(spark, texts, 2).withColumn("IDS", F.lit(1))
        rows = bytepair.decode(bytepair.encode(docs, ranks, pattern), ranks).collect()
        assert len(rows) == 2 * len(texts)
        assert all(list(r.ids) == want[r.doc_id] and bytes(r.decoded) == (texts[r.doc_id] or "").encode() for r in rows)
    assert bytepair.encode(docs.limit(0), ranks, pattern).collect() == []


def test_looked_up_words_are_no_part_of_the_plan(spark, ranks):
    docs = rows_of(spark, ["zebrafinch quagga"] * 50)
    encoded = bytepair.encode(docs, ranks, bytepair.java_pattern(spark, public_tokenizers.PATTERN), keep=["doc_id"])
    assert "quagga" not in encoded._jdf.queryExecution().analyzed().toString()


def test_unknown_words_stand_between_the_known(ranks):
    import numpy as np
    import pyarrow as pa

    known = {"a": [1], "bc": [2, 3], "": []}
    often = pa.array(list(known))
    hashed = bytepair.hashes(often, 2)
    order = np.argsort(hashed)
    for known_ids, names in ((list(known.values()), order), ([], order[:0])):
        tables = often.take(pa.array(names)), hashed[names], pa.array([known_ids[i] for i in names], pa.list_(pa.int32()))
        rows = [["a", "bc", "a"], [], ["x"], ["x", "x", "a", "yy", "bc", "bc", "z"], [], ["bc"]]
        got = bytepair.looked_up(pa.array(rows, pa.list_(pa.string())), *tables).to_pylist()
        for row, parts in zip(rows, got, strict=True):
            want = [{"run": [], "word": None}]
            for word in row:
                if len(names) and word in known:
                    want[-1]["run"] += known[word]
                else:
                    want[-1]["word"] = word
                    want.append({"run": [], "word": None})
            assert parts == want


def test_ids_are_decoded_and_digested_with_nulls(spark, ranks):
    rows = [(0, None), (1, []), (2, [ranks.tokens[b"a"], None]), (3, [len(ranks.tokens) - 1, 0])]
    df = spark.createDataFrame(rows, "k long, ids array<int>").coalesce(1)
    got = {r.k: (bytes(r.decoded), r.d) for r in bytepair.decode(df, ranks).select("k", "decoded", bytepair.ids_digest(F.col("ids")).alias("d")).collect()}
    by_id = sorted(ranks.tokens, key=ranks.tokens.get)
    two = hashlib.sha256((len(by_id) - 1).to_bytes(4, "little") + bytes(4)).hexdigest()
    assert got == {0: (b"", None), 1: (b"", hashlib.sha256().hexdigest()), 2: (b"a", None), 3: (by_id[-1] + by_id[0], two)}
    with pytest.raises(Exception, match="out of bounds"):
        bytepair.decode(spark.createDataFrame([(0, [len(by_id)])], "k long, ids array<int>"), ranks).collect()


def test_every_code_point_is_parted_alike(spark, library):
    import regex

    pattern = bytepair.java_pattern(spark, public_tokenizers.PATTERN)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}1{c}" for c in points[k : k + 4096]) for k in range(0, len(points), 4096)]
    docs = rows_of(spark, texts)
    got = {r.doc_id: r.w for r in docs.select("doc_id", bytepair.words("text", pattern).alias("w")).collect()}
    own = regex.compile(public_tokenizers.PATTERN)
    assert all(got[i] == own.findall(t) for i, t in enumerate(texts))


def test_vocabularies_that_rounds_would_misread_are_refused(tmp_path):
    import base64

    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"ab"]
    path = tmp_path / "v.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    with pytest.raises(ValueError):
        bytepair.read_ranks(str(path))


def test_byte_bpe_query(spark, tmp_path, library):
    rows_of(spark, TEXTS).write.parquet(f"{tmp_path}/documents.parquet")
    for r in QUERIES["op12_byte_bpe"](spark, str(tmp_path)).collect():
        text = TEXTS[r.doc_id] or ""
        ids = library.encode_ordinary(text)
        assert (r.n_tokens, r.decoded_sha256) == (len(ids), hashlib.sha256(text.encode()).hexdigest())
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()


@pytest.mark.parametrize("unit", sorted(fim.BORDERS))
def test_units_and_restoring(spark, unit):
    import re

    cut = {"line": r"[^\n]*\n|[^\n]+", "word": r"^[ \t\n\r\v\f]*[^ \t\n\r\v\f]*[ \t\n\r\v\f]*|[^ \t\n\r\v\f]+[ \t\n\r\v\f]*", "character": r"(?s)."}[unit]
    docs = rows_of(spark, TEXTS, 2).withColumn("__H0", F.lit(1)).withColumn("Output", F.lit(2))
    rows = fim.restore(fim.transform(docs, unit=unit, rate=80, suffix_first=30)).collect()
    assert len(rows) == 2 * len(TEXTS) and {r.form for r in rows} > {"plain"}
    for r in rows:
        text = TEXTS[r.doc_id] or ""
        assert r.restored == text and r.output.replace("<P>", "").replace("<S>", "").replace("<M>", "") is not None
        h = hashlib.sha256(f"7:{r.doc_id}".encode()).hexdigest()
        a, b, c, d = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        units = [u for u in re.findall(cut, text) if u] if unit != "word" else re.findall(r"[^ \t\n\r\v\f]+[ \t\n\r\v\f]*", text)
        if unit == "word" and units:
            units[0] = text[: len(text) - sum(map(len, units[1:]))]
        elif unit == "word" and text:
            units = [text]
        assert r.n == len(units)
        low, high = sorted((a % (r.n + 1), b % (r.n + 1)))
        parts = ["".join(units[:low]), "".join(units[low:high]), "".join(units[high:])]
        plain = not text or any(m in text for m in fim.MARKS) or c % 100 >= 80
        if plain:
            want = ("plain", None, None, text)
        elif d % 100 < 30:
            want = ("spm", len(parts[0]), len(parts[1]), f"<S>{parts[2]}<P>{parts[0]}<M>{parts[1]}")
        else:
            want = ("psm", len(parts[0]), len(parts[1]), f"<P>{parts[0]}<S>{parts[2]}<M>{parts[1]}")
        assert (r.form, r.prefix_chars, r.middle_chars, r.output) == want
    assert fim.transform(docs.limit(0)).collect() == []


def test_marks_that_could_be_mistaken_are_refused(spark):
    for marks in (("<P>", "<S>", "[M]"), ("<P", "<PX", "<M"), ("<P>", "<P>", "<M>")):
        with pytest.raises(ValueError):
            fim.transform(rows_of(spark, TEXTS), marks=marks)
