"""Relations of records, batches and links; request ledgers; self-search; scratch tables."""

from __future__ import annotations

import os
import random

from pyspark.sql import functions as F

from fernwood.operators import graphs, relations, search
from fernwood.sources import scratch
from fernwood.streaming import events, requests


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_look_ups_with_own_columns(spark):
    items = frame(spark, [(1, 10), (2, 20), (3, None), (4, 1)], "id long, boss long")
    assert sorted(r.id for r in relations.holding(items, "id", ["id", "boss"], frame(spark, [(1,), (20,), (None,)], "o long"), "o").collect()) == [1, 2, 4]
    turns = frame(spark, [("a", 1), ("a", 2), ("a", 2), ("b", None), (None, 3)], "g string, n int")
    assert sorted(map(tuple, relations.of_last(turns, "g", "n").collect())) == [("a", 2), ("a", 2)]
    log = frame(spark, [("a", 1, "x"), ("a", 3, "y"), ("a", 3, "z")], "g string, at int, v string")
    assert sorted(map(tuple, relations.with_latest(frame(spark, [("a",), ("b",)], "g string"), "g", log, ["at"], "v", "last").collect())) == [("a", "z"), ("b", None)]
    members = frame(spark, [(1, 5), (1, 6), (2, 5), (2, 7), (3, None)], "batch long, id long")
    assert [tuple(r) for r in relations.whole_groups(members, "batch", "id", frame(spark, [(5,), (6,), (6,)], "id long")).collect()] == [(1, 2)]
    batches = frame(spark, [(1, [1, 2, 2, 3]), (2, [4]), (3, []), (4, None)], "batch long, ids array<long>")
    got = relations.recoverable(batches, "batch", "ids", frame(spark, [(i,) for i in (2, 3, 4)], "id long"), frame(spark, [(4,), (9,)], "id long"), "id").collect()
    assert [tuple(r) for r in got] == [(1, [2, 3])]
    lines = frame(spark, [(1, "F"), (1, "F"), (2, "O"), (3, "F"), (3, "O")], "of long, s string")
    told = relations.outcomes(frame(spark, [(i,) for i in range(1, 5)], "id long"), "id", lines, "of", F.col("s") == "F").collect()
    assert sorted(map(tuple, told)) == [(1, 2, "succeeded"), (2, 1, "started"), (3, 2, "ambiguous"), (4, 0, "not_sent")]
    assert sorted(map(tuple, relations.entries(frame(spark, [(1, '{"a":"b","c":1}'), (2, "broken"), (3, None)], "id int, m string"), "id", "m").collect())) == [(1, "a", "b"), (1, "c", "1")]
    assert [tuple(r) for r in relations.listed(log, "g", [F.desc("at"), "v"], 2, "v").collect()] == [("a", ["y", "z"])]
    assert [tuple(r) for r in relations.behind(log, "g", F.col("at")).collect()] == [("a", 1)]
    assert sorted(r.part for r in relations.suffixed(frame(spark, [("p", 1), ("p", 2), ("q", 1), ("p", 9)], "path string, k int"), "path", "k").collect()) == ["p", "p-2", "p-3", "q"]
    text = "# a\n```\n# no\n```\n### b\n#no\n#### c\n```\n# open"
    assert sorted(map(tuple, relations.heading_levels(frame(spark, [(text,), (None,)], "t string"), "t").collect())) == [(1, 1), (3, 1), (4, 1)]


def test_states_do_not_depend_on_order_and_equal_the_stream(spark, tmp_path):
    rnd = random.Random(16)
    log = [(rnd.choice("abcdefgh"), rnd.choice(["planned", "sent", "failed", "answered", "reconciled", "noise"]), rnd.randint(1, 9)) for _ in range(40)] + [(None, "sent", 1), ("z", "planned", 5), ("y", "planned", 5), ("y", "sent", 5), ("y", None, 7)]
    shape = "request_id string, event string, chars long"

    def plain():
        out = {}
        for key, event, chars in log:
            if key is not None and event in requests.REACHES:
                reach, calls, spent = out.get(key, (0, 0, 0))
                sent = event == "sent"
                out[key] = (max(reach, requests.REACHES[event]), calls + sent, spent + chars * sent)
        return sorted((k, requests.STATES[r], c, s) for k, (r, c, s) in out.items())

    got = requests.states(frame(spark, log, shape))
    assert sorted(map(tuple, got.collect())) == plain()
    rnd.shuffle(log)
    for i in range(0, len(log), 9):
        frame(spark, log[i : i + 9], shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    assert sorted(map(tuple, events.taken(requests.states(stream), "complete").collect())) == plain()
    told = requests.states(frame(spark, [("a", "sent", 10), ("b", "sent", 5), ("b", "failed", 0), ("c", "answered", 0)], shape))
    gate = requests.spent(told, max_calls=9, max_chars=99, cost_per_char=0.01, max_cost=1.0).first()
    assert (gate.calls, gate.chars, gate.cost, gate.open, gate.may_send, gate.reason) == (2, 15, 0.15, 2, False, "reconcile_first")
    settled = requests.reconciled(told, frame(spark, [("a",), ("b",), ("b",), ("c",)], "request_id string"))
    after = requests.states(frame(spark, [("a", "sent", 10), ("b", "sent", 5)], shape).unionByName(settled))
    assert {r.state for r in after.collect()} == {"succeeded"} and settled.count() == 2
    for limits, reason in (({"max_calls": 2}, "calls"), ({"max_chars": 15}, "chars"), ({"max_cost": 0.15}, "cost"), ({}, None)):
        bounds = {"max_calls": 9, "max_chars": 99, "cost_per_char": 0.01, "max_cost": 1.0} | limits
        assert requests.spent(after, **bounds).first().reason == reason
    assert requests.spent(after.filter("false"), max_calls=1, max_chars=1, cost_per_char=1.0, max_cost=1.0).first().may_send


def test_self_search(spark):
    rows = [(f"c{i}", "/a" if i < 3 else f"/p{i}", 2 if i != 5 else 3, "c9" if i in (0, 6) else "up", f"Some text {i} with keyword here.") for i in range(10)]
    pieces = frame(spark, rows, "chunk_id string, path string, level int, parent_id string, text string")
    near = frame(spark, [(f"c{i}", 0.1 * i, 1 - 0.02 * i) for i in range(9)] + [("other", 0.0, 1.0)], "chunk_id string, distance double, similarity double")
    got = search.self_search(pieces, near, ["keyword"], level=2, top_k=3).orderBy(F.desc("score"), "chunk_id").collect()
    assert [(r.chunk_id, r.boost, r.score) for r in got] == [("c0", 0.1, 1.1), ("c1", 0.1, 1.08), ("c2", 0.1, 1.06)]
    assert got[0].context == ["c6", "c9"] and got[1].context == ["c3", "c4", "c5", "c7", "c8", "c9"] and "keyword" in got[0].snippet
    assert search.self_search(pieces.filter("false"), near, [], top_k=3).count() == 0


def test_scratch_tables_go(spark):
    at = scratch.base(spark)
    scratch.cleared(spark)
    before = set(os.listdir(at))
    got = graphs.closure(frame(spark, [(1,)], "root long"), frame(spark, [(1, 2), (2, 3)], "src long, dst long"))
    assert got.count() == 3
    left = {x for x in set(os.listdir(at)) - before if not x.startswith(".")}
    assert len(left) == 1 and next(iter(left)).startswith("closure-")
    assert scratch.cleared(spark) == 1 and not {x for x in set(os.listdir(at)) - before if x.startswith("closure-")}
