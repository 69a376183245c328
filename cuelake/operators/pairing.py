"""Pairing of departures and returns, and other operators on ordered events. All are windows or joins on a stated key."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cuelake.runtime import gathered


def paired(events: DataFrame, keys: list[str], order: list[str], polarity: str = "polarity") -> DataFrame:
    """Events with columns on how they pair: polarity is 1 for a departure and 0 for a return.

    closed: a departure whose next event is a return. orphan: a return that no departure comes directly before.
    nested: a departure directly after another one. seen: whether any departure came before. Adds next_event
    (a struct of ``order``) for the extent.
    """
    by = Window.partitionBy(*keys).orderBy(*order)
    past = by.rowsBetween(Window.unboundedPreceding, -1)
    after, before = F.lead(polarity).over(by), F.lag(polarity).over(by)
    own = F.col(polarity)
    return events.withColumns(
        {
            "closed": (own == 1) & F.coalesce(after == 0, F.lit(False)),
            "orphan": (own == 0) & F.coalesce(before != 1, F.lit(True)),
            "nested": (own == 1) & F.coalesce(before == 1, F.lit(False)),
            "seen": F.coalesce(F.max(polarity).over(past) == 1, F.lit(False)),
            "next_event": F.lead(F.struct(*order)).over(by),
        }
    )


def consecutive(rows: DataFrame, keys: list[str], order: list[str], ok: Column) -> DataFrame:
    """Adds streak: how many rows in a row, up to this one, are not ok; 0 where ok."""
    by = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    marked = rows.withColumn("_island", F.sum(F.when(ok, 1).otherwise(0)).over(by))
    inside = Window.partitionBy(*keys, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("streak", F.sum(F.when(ok, 0).otherwise(1)).over(inside).cast("long")).drop("_island")


def latest(rows: DataFrame, keys: list[str], order: list[Column], most: int = 1) -> DataFrame:
    """The first ``most`` rows of each key in an order that leaves no ties."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_n", at).where(F.col("_n") <= most).drop("_n")


def nearest(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, left_id: str, right_id: str, radius: float, how: str = "inner") -> DataFrame:
    """For each left row the nearest right row of its keys within ``radius``, ties to the smaller right id.

    Both sides are put into bins as wide as the radius, so that a row meets three bins and never its whole key; the join
    is then an equi-join on keys and bin. Left rows may have the same times; left_id must be unique within the keys.
    """
    bin_of = lambda c: F.floor(F.col(c) / F.lit(radius)).cast("long")
    spread = F.explode(F.array(bin_of(left_at) - 1, bin_of(left_at), bin_of(left_at) + 1))
    a = left.select(*keys, left_id, left_at).withColumn("_bin", spread)
    b = right.select(*keys, right_id, right_at).withColumn("_bin", bin_of(right_at))
    gap = F.abs(F.col(right_at) - F.col(left_at))
    met = a.join(b, [*keys, "_bin"]).withColumn("gap", gap).where(F.col("gap") <= radius)
    best = met.groupBy(*keys, left_id, left_at).agg(F.min(F.struct("gap", right_id)).alias("_best"))
    best = best.select(*keys, left_id, left_at, F.col(f"_best.{right_id}").alias(right_id), F.col("_best.gap").alias("gap"))
    if how == "inner":
        return best
    return left.select(*keys, left_id, left_at).join(best.select(*keys, left_id, right_id, "gap"), [*keys, left_id], "left")


def contained(points: DataFrame, spans: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """Points with each span that holds them (start included, end not). The spans are few and of stated size; a
    range join with an equal key should use the key as well."""
    return points.join(spans, (F.col(at) >= F.col(start)) & (F.col(at) < F.col(end)))


def coverage(polls: DataFrame, key: str, at: str, every: float, start: Column, end: Column) -> DataFrame:
    """Polls in a window: their number, the expected one, the ratio (1 at most), and the longest stretch without one;
    that from the window's start counts beyond one interval. Times and results are in seconds."""
    inside = polls.where((F.col(at) >= start) & (F.col(at) <= end))
    before = F.coalesce(F.lag(at).over(Window.partitionBy(key).orderBy(at)), start + F.lit(every))
    gaps = inside.withColumn("_gap", F.col(at) - before)
    found = gaps.groupBy(key).agg(F.count("*").alias("polls"), F.max("_gap").alias("_most"), F.max(at).alias("_last"))
    expected = F.greatest(F.lit(1.0), F.floor((end - start) / every + 0.5))
    return found.select(
        key, "polls", expected.cast("long").alias("expected"), F.least(F.lit(1.0), F.col("polls") / expected).alias("ratio"),
        F.greatest(F.lit(0.0), F.floor(F.greatest("_most", end - F.col("_last")) + 0.5)).cast("long").alias("longest_gap"),
    )


MATCHED = "left_id long, right_id long, distance double"


def greedy_events(left: DataFrame, right: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """Exclusive nearest matches of events (keys, id, at): departures (left) in the order of time take the nearest return
    (right) within ``radius`` that is still free, of equally near ones that of the smallest id. Returns keys, left_id,
    right_id, distance.

    No match crosses a stretch of more than ``radius`` without an event, so that each key is cut there into groups that
    are matched apart; a group is streamed in the order of time, and only returns within the radius of the departure at
    hand are held.
    """
    side = lambda rows, n: rows.select(*keys, F.col("id").cast("long").alias("id"), F.col("at").cast("double").alias("at"), F.lit(n).alias("side"))
    both = side(left, 0).unionByName(side(right, 1))
    by = Window.partitionBy(*keys).orderBy("at", "side", "id")
    both = both.withColumn("_new", F.coalesce(F.col("at") - F.lag("at").over(by) > radius, F.lit(True)).cast("int"))
    both = both.withColumn("_group", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0))).select(*keys, "_group", "at", "side", "id")
    spread = gathered(both, *keys, "_group").sortWithinPartitions(*keys, "_group", "at", "side", "id")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.select(*keys).schema.fields) + ", " + MATCHED
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        asked: deque = deque()  # departures that wait for the returns after them, oldest first
        times, ids = [], []  # returns that may still be taken, in order of time and id
        group: list | None = None

        def settle(until: float):
            """Match the departures of which all returns within the radius are known by now."""
            while asked and asked[0][1] + radius < until:
                name, at = asked.popleft()
                k = bisect_left(times, at)
                near = [(abs(times[n] - at), ids[n], n) for n in ([bisect_left(times, times[k - 1])] if k else []) + ([k] if k < len(times) else [])]
                if near and min(near)[0] <= radius:
                    distance, chosen, n = min(near)
                    del times[n], ids[n]
                    yield (*group[:-1], name, chosen, distance)
                forget(asked[0][1] if asked else until)

        def forget(at: float):
            gone = bisect_left(times, at - radius)
            del times[:gone], ids[:gone]

        def made(rows):
            columns = [*zip(*rows, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                *name, at, kind, ident = row
                if name != group:
                    out += settle(float("inf")) if group is not None else ()
                    group = name
                    asked.clear()
                    del times[:], ids[:]
                out += settle(at)
                if kind:
                    times.append(at)
                    ids.append(ident)
                else:
                    asked.append((ident, at))
                if not asked:
                    forget(at)
            if out:
                yield made(out)
        if group is not None and (out := [*settle(float("inf"))]):
            yield made(out)

    return spread.mapInArrow(run, schema)
