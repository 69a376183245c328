"""Exclusive matches: what one row has taken, no later one can take.

Such matches hang on the order in which rows choose. Groups are dealt to tasks by their keys. Where names don't count, a group is
cut where nothing happens for more than the radius, which no match crosses: of a stretch with a single row that chooses it is told
for all stretches of a block at once. All others choose in turn, after what can be taken is indexed by name and by time: some
hundred bytes each, of which every choice finds its own in logarithmic time or less. A group of more than HELD rows is streamed,
so that a task holds what can be taken of it, and no more.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Callable, Iterator
from heapq import heapify, heappop

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cuelake.runtime import gathered


class Nearest:
    """Rows (id, name, at) to be taken: the first one of a name, or the one nearest in time."""

    def __init__(self, rows: list[tuple[int, str | None, float | None]]):
        self.taken: set[int] = set()
        self.named: dict[str, deque[int]] = {}
        by_time: dict[float, list[int]] = {}
        for ident, name, at in sorted(rows, key=lambda r: r[0]):
            if name is not None:
                self.named.setdefault(name, deque()).append(ident)
            if at is not None and at == at:
                by_time.setdefault(at, []).append(ident)
        self.times = sorted(by_time)
        self.free = [deque(by_time[t]) for t in self.times]
        # the next time to either side that may have something left; a step beyond the ends is the number of times, or -1
        self.up, self.down = [*range(len(self.times) + 1)], [*range(len(self.times) + 1)]

    def _left(self, k: int) -> bool:
        own = self.free[k]
        while own and own[0] in self.taken:
            own.popleft()
        return bool(own)

    def _next(self, k: int) -> int:
        seen = []
        while k < len(self.times) and (self.up[k] != k or not self._left(k)):
            if self.up[k] == k:
                self.up[k] = k + 1
            seen.append(k)
            k = self.up[k]
        for x in seen:
            self.up[x] = k
        return k

    def _before(self, k: int) -> int:
        """As ``_next`` to the other side; places are one higher here, so that 0 stands for none."""
        k += 1
        seen = []
        while k > 0 and (self.down[k] != k or not self._left(k - 1)):
            if self.down[k] == k:
                self.down[k] = k - 1
            seen.append(k)
            k = self.down[k]
        for x in seen:
            self.down[x] = k
        return k - 1

    def take(self, name: str | None, at: float | None, radius: float) -> tuple[int, float | None] | None:
        """What a row takes and how far it is (none if by name): the first free one of its name, or else the nearest free one
        within ``radius``, of equally near ones that of the smallest id."""
        own = self.named.get(name) if name is not None else None
        while own:
            ident = own.popleft()
            if ident not in self.taken:
                self.taken.add(ident)
                return ident, None
        if at is None or at != at:
            return None
        k = bisect_left(self.times, at)
        found = [(abs(self.times[x] - at), self.free[x][0]) for x in (self._before(k - 1), self._next(k)) if 0 <= x < len(self.times)]
        if not found or min(found)[0] > radius:
            return None
        distance, ident = min(found)
        self.taken.add(ident)
        return ident, distance


class InTurn:
    """Rows (id, name, at) to be taken in the order of id: the first one of a name from a time on, or the first one after it. The
    times that are asked for never fall."""

    def __init__(self, rows: list[tuple[int, str | None, float | None]]):
        self.taken: set[int] = set()
        self.named: dict[str, list[tuple[int, float]]] = {}
        self.all = [(ident, at) for ident, _, at in rows if at is not None]
        heapify(self.all)
        for ident, name, at in rows:
            if name is not None and at is not None:
                self.named.setdefault(name, []).append((ident, at))
        for own in self.named.values():
            heapify(own)

    def _first(self, heap: list[tuple[int, float]], bound: Callable[[float], bool]) -> int | None:
        while heap:
            ident, at = heappop(heap)
            if ident not in self.taken and bound(at):
                self.taken.add(ident)
                return ident
        return None

    def take(self, name: str | None, at: float | None, _: float) -> tuple[int, float | None] | None:
        if at is None:
            return None
        own = self.named.get(name) if name is not None else None
        ident = self._first(own, lambda x: x >= at) if own else None
        if ident is None:
            ident = self._first(self.all, lambda x: x > at)
        return None if ident is None else (ident, None)


MATCHED = "left_id long, right_id long, distance double"
#: Rows of one group that a task gathers before it streams the group.
HELD = 100_000


def _begun(block: pa.RecordBatch | pa.Table, keys: int) -> np.ndarray:
    """Whether each row begins another group than that of the row before it."""
    new = np.zeros(block.num_rows, bool)
    new[:1] = True
    for k in range(keys):
        column = block.column(k)
        a, b = column.slice(0, len(column) - 1), column.slice(1)
        differs = pc.if_else(pc.and_(pc.is_valid(a), pc.is_valid(b)), pc.not_equal(a, b), pc.xor(pc.is_valid(a), pc.is_valid(b)))
        new[1:] |= differs.to_numpy(zero_copy_only=False) if isinstance(differs, pa.Array) else differs.to_numpy()
    return new


def _in_turn(taking: type, radius: float, side: np.ndarray, idents: np.ndarray, names: list | None, at: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, int, float | None]]:
    """Row, taken id and distance of the matches among ``rows`` of a block, which stand in the order of choice."""
    free, asked = rows[side[rows] == 0], rows[side[rows] == 1]
    known = lambda some: zip(some.tolist(), idents[some].tolist(), [names[k] for k in some.tolist()] if names else [None] * len(some), [None if x != x else x for x in at[some].tolist()], strict=True)
    index = taking([x[1:] for x in known(free)])
    for row, _, name, time in known(asked):
        if got := index.take(name, time, radius):
            yield row, *got


def matches_of(block: pa.Table, keys: int, radius: float, taking: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of ``block`` that have a match, what they take, how far it is, and whether that is null; groups are whole."""
    side, idents = (block.column(keys + k).to_numpy() for k in (0, 2))
    column = block.column(keys + 3)
    given = pc.is_valid(column).to_numpy() if column.null_count < len(column) else None
    names = column.to_pylist() if given is not None else None
    at = pc.fill_null(block.column(keys + 4), float("nan")).to_numpy()
    group = np.cumsum(_begun(block, keys)) - 1
    many = group[-1] + 1
    has = lambda rows: np.bincount(group[rows], minlength=many) > 0
    left, right = side == 1, side == 0
    slow = has(left) & has(right)  # groups of which every row has its turn
    rows, taken, distance, unknown = ([np.zeros(0, t)] for t in (np.int64, np.int64, np.float64, bool))
    if taking is Nearest:
        both = slow
        slow = both & has(np.isinf(at))
        if given is not None:
            slow |= both & has(left & given) & has(right & given)
        place = np.flatnonzero((both & ~slow)[group] & (at == at))
        place = place[np.lexsort((idents[place], -side[place], at[place], group[place]))]
        near = np.ones(len(place), bool)
        near[1:] = (group[place][1:] == group[place][:-1]) & (np.diff(at[place]) <= radius)
        stretch = np.cumsum(~near)
        stretch -= stretch[:1].sum()
        asking = np.bincount(stretch[side[place] == 1], minlength=len(place) + 1)
        for cut in np.flatnonzero(asking > 1).tolist():
            some = place[np.searchsorted(stretch, cut) : np.searchsorted(stretch, cut + 1)]
            for row, ident, far in _in_turn(taking, radius, side, idents, None, at, np.sort(some)):
                rows.append(np.array([row]))
                taken.append(np.array([ident]))
                distance.append(np.array([far]))
                unknown.append(np.array([False]))
        one = np.flatnonzero((side[place] == 1) & (asking[stretch] == 1))
        same = np.r_[False, (stretch[1:] == stretch[:-1]) & (np.diff(at[place]) == 0)][: len(place)]
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(place))))  # of equal times the row of the smallest id
        best = np.full((2, len(one)), np.inf)
        who = np.zeros((2, len(one)), np.int64)
        for k, step in enumerate((-1, 1)):
            other = np.clip(one + step, 0, max(len(place) - 1, 0))
            other = first[other] if step < 0 else other
            met = (stretch[other] == stretch[one]) & (side[place[other]] == 0)
            best[k] = np.where(met, np.abs(at[place[other]] - at[place[one]]), np.inf)
            who[k] = idents[place[other]]
        pick = ((best[1] < best[0]) | ((best[1] == best[0]) & (who[1] < who[0]))).astype(int)
        far, ident = best[pick, np.arange(len(one))], who[pick, np.arange(len(one))]
        ok = np.isfinite(far) & (far <= radius)
        rows.append(place[one[ok]])
        taken.append(ident[ok])
        distance.append(far[ok])
        unknown.append(np.zeros(int(ok.sum()), bool))
    starts = np.searchsorted(group, np.flatnonzero(slow)).tolist()
    ends = np.searchsorted(group, np.flatnonzero(slow), side="right").tolist()
    found = [x for a, b in zip(starts, ends, strict=True) for x in _in_turn(taking, radius, side, idents, names, at, np.arange(a, b))]
    if found:
        row, ident, far = zip(*found, strict=True)
        rows.append(np.array(row))
        taken.append(np.array(ident))
        distance.append(np.array([0.0 if x is None else x for x in far]))
        unknown.append(np.array([x is None for x in far]))
    return tuple(map(np.concatenate, (rows, taken, distance, unknown)))


class _Streamed:
    """A group that is too large to be held: its rows as they come."""

    def __init__(self, keys: int, radius: float, taking: type):
        self.keys, self.radius, self.taking = keys, radius, taking
        self.rows, self.index = [], None

    def found(self, part: pa.RecordBatch) -> Iterator[tuple]:
        for row in zip(*(c.to_pylist() for c in part.columns), strict=True):
            key, (kind, _, ident, name, at) = row[: self.keys], row[self.keys :]
            if kind == 0:
                self.rows.append((ident, name, at))
                continue
            if self.index is None:
                self.index, self.rows = self.taking(self.rows), []
            if got := self.index.take(name, at, self.radius):
                yield (*key, ident, *got)


def exclusive(left: DataFrame, right: DataFrame, keys: list[str], radius: float = float("inf"), taking: type = Nearest, order: str = "id") -> DataFrame:
    """keys, left_id, right_id and distance (null if by name) of the matches of ``left`` with ``right``: both have the keys, id,
    name (a string or null) and at (a number or null). Rows of ``left`` choose in the order of the column ``order`` and then of
    id, as ``taking`` says; a row that finds nothing has no match. Ids are those of one row each within its keys."""
    side = lambda rows, n, by: rows.select(*keys, F.lit(n).alias("side"), by.cast("double").alias("turn"), F.col("id").cast("long").alias("id"), F.col("name").cast("string").alias("name"), F.col("at").cast("double").alias("at"))
    both = side(right, 0, F.lit(0)).unionByName(side(left, 1, F.col(order)))
    spread = gathered(both, *keys).sortWithinPartitions(*keys, "side", "turn", "id")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in both.select(*keys).schema.fields) + ", " + MATCHED
    arrow, n, most = to_arrow_schema(StructType.fromDDL(schema)), len(keys), HELD

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    def settled(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.Table.from_batches(parts).combine_chunks()
        if block.num_rows == 0:
            return
        rows, taken, distance, unknown = matches_of(block, n, radius, taking)
        if len(rows):
            kept = block.select([*range(n), n + 2]).take(pa.array(rows)).combine_chunks()
            columns = [c.combine_chunks() for c in kept.columns]
            columns = [c if isinstance(c, pa.Array) else c.chunk(0) for c in columns]
            columns += [pa.array(taken, pa.int64()), pa.array(distance, pa.float64(), mask=unknown)]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[pa.RecordBatch] = []  # of the group that the last batch ended in
        large: _Streamed | None = None
        key = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            new = _begun(batch, n)
            new[0] = key is None or [batch.column(k)[0].as_py() for k in range(n)] != key
            starts = np.flatnonzero(new)
            first = int(starts[0]) if len(starts) else batch.num_rows
            if first:
                parts.append(batch.slice(0, first))
                if large is None and sum(x.num_rows for x in parts) > most:
                    large = _Streamed(n, radius, taking)
                if large is not None:
                    found = [x for part in parts for x in large.found(part)]
                    parts = []
                    if found:
                        yield made(found)
            if len(starts):
                last = int(starts[-1])
                yield from settled([*parts, batch.slice(first, last - first)])
                parts, large = [batch.slice(last)], None
                key = [batch.column(k)[batch.num_rows - 1].as_py() for k in range(n)]
        if parts:
            yield from settled(parts)

    return spread.mapInArrow(run, schema)
