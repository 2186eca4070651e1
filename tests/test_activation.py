"""Activation as one transaction: what moves, what refuses, and answers that are kept."""

import json

import pytest

from palimpsest.plans import activation
from palimpsest.plans.transactions import Refused
from palimpsest.sources.commits import CommitLog, StaleVersion


def rows(log, table):
    return sorted(map(tuple, log.read(table).collect()), key=repr)


def test_activation_is_one_transaction(spark, tmp_path):
    make, log = spark.createDataFrame, CommitLog(spark, str(tmp_path / "log"))
    log.commit(
        {
            "modules": make([("c", "m1", "k", 1), ("c", "m2", "k", 2), ("c", "m3", "k", 3), ("d", "x", "k", 1)], activation.MODULES),
            "scenes": make([("m1", "1a", "a"), ("m1", "1b", "b"), ("m2", "2a", "a"), ("m2", "2z", "z"), ("m3", "3a", "a")], activation.SCENES),
            "progress": make([("party", "1a", "done"), ("party", "1b", "open"), ("actor", "1a", "open"), ("party", "other", "open")], activation.PROGRESS),
            "bindings": make([("b1", "m1", "guard", "p"), ("b2", "x", "guard", "q")], activation.BINDINGS),
        },
        expected=0,
    )
    first = activation.activate(log, 1, "c", "m1", key="r1")
    assert json.loads(first) == {"module_id": "m1", "replaced": None, "progress": 0, "bindings": 0} and log.version() == 2
    for args, why in ((("c", "x"), "missing module"), (("c", "m2"), "unmapped")):
        with pytest.raises(Refused) as refused:
            activation.activate(log, 2, *args)
        assert refused.value.outcomes == {why: 1} and log.version() == 2
    for remaps, why in (({"1b": "3a"}, {"remap of another revision": 1}), ({"1b": "2a"}, {"conflict": 2})):
        with pytest.raises(Refused) as refused:
            activation.activate(log, 2, "c", "m2", remaps=remaps)
        assert refused.value.outcomes == why
    second = activation.activate(log, 2, "c", "m2", remaps={"1b": "2z"}, key="r2")
    assert json.loads(second) == {"module_id": "m2", "replaced": "m1", "progress": 3, "bindings": 1}
    assert rows(log, "progress") == [("actor", "2a", "open"), ("party", "2a", "done"), ("party", "2z", "open"), ("party", "other", "open")]
    assert rows(log, "bindings") == [("b1", "m2", "guard", "p"), ("b2", "x", "guard", "q")]
    # The same request again, also by one who missed the commit: the answer that was kept, and no commit; its key for another request: refused.
    assert activation.activate(log, 2, "c", "m2", remaps={"1b": "2z"}, key="r2") == second
    assert activation.activate(log, 3, "c", "m2", remaps={"1b": "2z"}, key="r2") == second and activation.activate(log, 3, "c", "m1", key="r1") == first and log.version() == 3
    with pytest.raises(Refused) as refused:
        activation.activate(log, 3, "c", "m3", key="r2")
    assert refused.value.outcomes == {"key of another request": 1}
    with pytest.raises(StaleVersion):
        activation.activate(log, 2, "c", "m3")
    for module, why in (("m1", {"not active": 1}), ("m2", {"progress": 3})):
        with pytest.raises(Refused) as refused:
            activation.deactivate(log, 3, "c", module)
        assert refused.value.outcomes == why
    assert log.version() == 3 and [tuple(r) for r in activation.active(log.view(), "c").collect()] == [("k", "m2", 2)]


def test_taking_back(spark, tmp_path):
    make, log = spark.createDataFrame, CommitLog(spark, str(tmp_path / "log"))
    log.commit({"modules": make([("c", "m1", "k", 1)], activation.MODULES)}, expected=0)
    activation.activate(log, 1, "c", "m1")
    assert activation.activate(log, 2, "c", "m1") and log.version() == 2
    told = activation.deactivate(log, 2, "c", "m1", key="r")
    assert json.loads(told) == {"module_id": None, "replaced": "m1"} and activation.deactivate(log, 3, "c", "m1", key="r") == told
    assert activation.active(log.view(), "c").first().module_id is None and log.version() == 3
