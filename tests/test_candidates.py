"""Decisions follow unchanged content: reordered, renamed, edited and repeated candidates."""

import hashlib

from pyspark.sql import functions as F

from palimpsest.operators import candidates

HELD = "job_id string, id string, ordinal int, artifact string, review_status string, original_fingerprint string"
NEW = "job_id string, id string, ordinal int, artifact string, review_status string"


def test_fingerprints_leave_ledgers_out(spark):
    texts = ['{"b":1,"a":[{"edit_history":[1],"x":"é"}],"original_fingerprint":"z"}', '{ "a": [ {"x": "é"} ], "b": 1 }', '{"a":[{"x":"e"}],"b":1}', None, "{", '"é"', ""]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(candidates.fingerprint(F.col("t"))).collect()]
    assert got[0] == got[1] == hashlib.sha256('{"a":[{"x":"é"}],"b":1}'.encode()).hexdigest() != got[2] and got[3] is None and got[4] is None and got[5] and got[6] is None


def test_decisions_follow_content(spark):
    held = [("j", "a", 1, '{"v":1}', "accepted", "fa"), ("j", "b", 2, '{"v":2}', "rejected", "fb"), ("j", "c", 3, '{"v":3}', "pending", "fc"), ("j", "d", 4, '{"v":3}', "accepted", "fd"), ("j", "e", 5, '{"v":5}', "accepted", "fe"), ("j", "p", 6, '{"v":6}', "pending", "fp"), ("k", "a", 1, "{}", "accepted", "ka"), ("l", "a", 1, "{}", "rejected", None)]
    new = [("j", "b", 1, '{ "v": 2 }', "pending"), ("j", " a", 2, '{"v":1,"edit_history":[]}', None), ("j", "x", 3, '{"v":3}', None), ("j", "y", 4, '{"v":3}', "accepted"), ("j", "z", 5, '{"v":3}', "rejected"), ("j", "e", 6, '{"v":50}', "accepted"), ("j", "p", 7, '{"v":60}', None), ("l", "a", 1, "{}", None), ("l", "a", 2, "{}", None), (None, "q", 1, "{}", None)]
    after, bad = candidates.set_candidates(spark.createDataFrame(held, HELD), spark.createDataFrame(new, NEW))
    got = {(r.job_id, r.id): (r.review_status, r.original_fingerprint, r.outcome) for r in after.collect()}
    own = hashlib.sha256(b'{"v":3}').hexdigest()
    assert got == {
        ("j", "a"): ("accepted", "fa", "kept"), ("j", "b"): ("rejected", "fb", "kept"), ("j", "x"): ("pending", "fc", "moved"), ("j", "y"): ("accepted", "fd", "moved"), ("j", "z"): ("rejected", own, "new"),
        ("j", "e"): ("needs_revision", "fe", "changed"), ("j", "p"): ("pending", "fp", "changed"), ("k", "a"): ("accepted", "ka", "untouched"), ("l", "a"): ("rejected", None, "refused"),
    }
    assert [tuple(r) for r in bad.collect()] == [("l", "repeated id")]


def test_every_problem_and_no_rows(spark):
    new = [("1", " ", 1, "{}", None), ("2", "a", 1, "{}", "done"), ("3", "a", 1, "{", None), ("4", "a", 2, "{}", "x"), ("4", None, 1, "{}", None), ("5", "a", 1, None, None)]
    held = spark.createDataFrame([], HELD)
    after, bad = candidates.set_candidates(held, spark.createDataFrame(new, NEW))
    assert {r.job_id: r.problem for r in bad.collect()} == {"1": "no id", "2": "unknown review status", "3": "not JSON", "4": "no id", "5": "not JSON"} and after.collect() == []
    assert candidates.set_candidates(held, spark.createDataFrame([], NEW))[0].collect() == []
