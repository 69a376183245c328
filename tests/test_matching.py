"""Exclusive matches against plain loops, and in bounded time on many rows."""

import random
import time

import numpy as np
import pyarrow as pa
import pytest

from cuelake.operators import matching
from cuelake.operators.pairing import greedy_events


def plain_nearest(left, right, radius):
    out, taken = [], set()
    for i, name, at in left:
        own = [j for j, n, _ in sorted(right, key=lambda x: x[0]) if j not in taken and name is not None and n == name]
        near = sorted((abs(t - at), j) for j, _, t in right if j not in taken and at is not None and t is not None)
        if own:
            out.append((i, own[0], None))
            taken.add(own[0])
        elif near and near[0][0] <= radius:
            out.append((i, near[0][1], near[0][0]))
            taken.add(near[0][1])
    return out


def plain_in_turn(left, right):
    out, taken = [], set()
    for i, name, at in sorted(left, key=lambda x: (x[2], x[0])):
        free = sorted((j, n, t) for j, n, t in right if j not in taken)
        own = [j for j, n, t in free if name is not None and n == name and t >= at] or [j for j, n, t in free if t > at]
        if own:
            out.append((i, own[0], None))
            taken.add(own[0])
    return out


ROW = "k string, id int, name string, at double"


@pytest.mark.parametrize("seed", range(3))
def test_matches_are_those_of_a_loop(spark, seed):
    r = random.Random(seed)
    make = lambda n: [(i, r.choice((None, None, "a", "b", "c")), r.choice((None, float(r.randrange(40)), float(r.randrange(40))))) for i in range(n)]
    groups = {f"g{k}": (make(r.randrange(0, 25)), make(r.randrange(0, 25))) for k in range(25)}
    side = lambda n, fix: spark.createDataFrame([(k, i, name, fix(at)) for k, x in groups.items() for i, name, at in x[n]], ROW).repartition(5)
    plain = lambda x: x
    for radius in (0.0, 3.0, 1000.0):
        found = {tuple(x) for x in matching.exclusive(side(0, plain), side(1, plain), ["k"], radius).collect()}
        assert found == {(k, *m) for k, (a, b) in groups.items() for m in plain_nearest(a, b, radius)}
    timed = lambda at: at or 0.0
    found = {tuple(x) for x in matching.exclusive(side(0, timed), side(1, timed), ["k"], taking=matching.InTurn, order="at").collect()}
    assert found == {(k, *m) for k, (a, b) in groups.items() for m in plain_in_turn([(i, n, timed(t)) for i, n, t in a], [(i, n, timed(t)) for i, n, t in b])}
    assert matching.exclusive(side(0, plain).limit(0), side(1, plain), ["k"]).count() == 0


@pytest.mark.parametrize("taking", [matching.Nearest, matching.InTurn])
def test_one_document_of_very_many_rows(taking):
    n = 200_000
    r = random.Random(2)
    right = [(k, f"n{k // 3}", float(k // 10)) for k in range(n)]
    start = time.perf_counter()
    index = taking(right)
    asked = sorted(r.randrange(n // 10) for _ in range(n))
    found = [index.take(f"n{r.randrange(n)}" if k % 2 else None, float(t), 1e9) for k, t in enumerate(asked)]
    taken = [x[0] for x in found if x]
    assert len(taken) == len(set(taken)) > n // 4 and time.perf_counter() - start < 20
    if taking is matching.Nearest:
        assert len(taken) == n


def test_a_burst_of_departures_and_returns(spark):
    n = 20_000
    left = spark.range(n).selectExpr("'m' k", "id", "cast(id % 100 as double) at")
    right = spark.range(n).selectExpr("'m' k", "id", "cast(id % 97 as double) at")
    start = time.perf_counter()
    found = greedy_events(left, right, ["k"], 1000.0)
    rows = found.collect()
    assert len(rows) == n == len({x["right_id"] for x in rows}) and time.perf_counter() - start < 60


def test_groups_stay_together_behind_joins_and_unions(spark):
    """Both sides come from joins on the keys, which Spark plans anew at run time: no group may be torn."""
    n = 300
    ids = spark.range(n).selectExpr("cast(id % 40 as string) k", "cast(id as int) id", "cast(null as string) name", "cast(id as double) at")
    known = spark.range(40).selectExpr("cast(id as string) k").distinct()
    side = lambda: ids.join(known.groupBy("k").count(), "k").select("k", "id", "name", "at")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = matching.exclusive(side(), side(), ["k"], 0.0).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(found) == n and all(x["left_id"] == x["right_id"] for x in found)


@pytest.mark.parametrize("held", [3, 100_000])
def test_blocks_give_the_matches_of_a_loop(spark, monkeypatch, held):
    """Without names stretches are told for a block at once; groups are cut by batches, and streamed beyond ``HELD`` rows."""
    monkeypatch.setattr(matching, "HELD", held)
    r = random.Random(held)
    when = lambda: r.choice((None, float("nan"), *[r.randrange(400) / 2 for _ in range(12)]))
    make = lambda n: [(i, None, when()) for i in range(n)]
    groups = {None if k == 0 else f"g{k}": (make(r.randrange(0, 30)), make(r.randrange(0, 30))) for k in range(60)}
    groups["inf"] = ([(0, None, float("inf")), (1, None, 5.0)], [(0, None, 5.0), (1, None, float("-inf"))])
    side = lambda n: spark.createDataFrame([(k, *x) for k, rows in groups.items() for x in rows[n]], ROW).repartition(5)
    fixed = lambda rows: [(i, n, None if t is None or t != t else t) for i, n, t in rows]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        for radius in (0.0, 0.5, 3.0, 1000.0):
            found = sorted(map(tuple, matching.exclusive(side(0), side(1), ["k"], radius).collect()), key=str)
            assert found == sorted([(k, *m) for k, (a, b) in groups.items() for m in plain_nearest(fixed(a), fixed(b), radius)], key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_block_of_many_small_groups_is_told_at_once():
    n = 400_000
    key, second = np.repeat(np.arange(n // 4), 4), np.tile([0, 1, 0, 1], n // 4)
    side = np.tile([0, 0, 1, 1], n // 4)
    at = second * 600.0 + side
    block = pa.table([pa.array(key), pa.array(side, pa.int32()), pa.array(second.astype(float)), pa.array(second), pa.nulls(n, pa.string()), pa.array(at)], names=["k", "side", "turn", "id", "name", "at"])
    start = time.perf_counter()
    rows, taken, distance, unknown = matching.matches_of(block, 1, 6.0, matching.Nearest)
    assert time.perf_counter() - start < 2
    assert len(rows) == n // 2 and (taken == second[rows]).all() and (distance == 1.0).all() and not unknown.any()
