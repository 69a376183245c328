"""Bit fields of many byte strings at once: a cursor for each, moved on by numpy for all that are being read."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


class Bytes:
    """The bytes of an Arrow array of binaries (or strings) in one piece: where each begins, its size, and whether it is given."""

    def __init__(self, values: pa.Array):
        values = values.cast(pa.binary()) if values.type != pa.binary() else values
        self.given = np.asarray(values.is_valid().to_numpy(zero_copy_only=False), bool)
        bounds = np.frombuffer(values.buffers()[1], np.int32, len(values) + 1, values.offset * 4).astype(np.int64) if len(values) else np.zeros(1, np.int64)
        own = values.buffers()[2]
        self.flat_bytes = (own.to_pybytes() if own is not None else b"") + bytes(8)  # so that a field can be read with those behind it
        self.flat = np.frombuffer(self.flat_bytes, np.uint8)
        self.begin, self.size = bounds[:-1], np.where(self.given, np.diff(bounds), 0)

    def byte(self, rows: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.flat[self.begin[rows] + at].astype(np.int64)


class Cursors:
    """A cursor in each of the pieces that begin at ``begin`` and have ``size`` bytes. A read beyond a piece's end gives 0 and
    makes the piece no longer ``good``; nothing more is read of it."""

    def __init__(self, flat: np.ndarray, begin: np.ndarray, size: np.ndarray):
        self.flat, self.begin, self.bits = flat, begin, size * 8
        self.at = np.zeros(len(begin), np.int64)
        self.good = np.ones(len(begin), bool)

    def left(self) -> np.ndarray:
        return self.bits - self.at

    def skip(self, n: np.ndarray | int, where: np.ndarray) -> np.ndarray:
        """Move on by ``n`` bits; the rows in which there are as many."""
        go = where & self.good
        over = go & (self.at + n > self.bits)
        self.good &= ~over
        go &= ~over
        self.at = np.where(go, self.at + n, self.at)
        return go

    def take(self, n: int, where: np.ndarray) -> np.ndarray:
        """The next ``n`` bits (56 at most) of the rows ``where``, 0 in the others."""
        before = self.at
        rows = np.flatnonzero(self.skip(n, where))
        out = np.zeros(len(self.at), np.int64)
        first = before[rows]
        place, value = self.begin[rows] + (first >> 3), np.zeros(len(rows), np.uint64)
        count = (n + 14) // 8
        for k in range(count):
            value = value << np.uint64(8) | self.flat[np.minimum(place + k, len(self.flat) - 1)].astype(np.uint64)
        shift = (8 * count - (first & 7) - n).astype(np.uint64)
        out[rows] = (value >> shift & np.uint64((1 << n) - 1)).astype(np.int64)
        return out

    def flag(self, where: np.ndarray) -> np.ndarray:
        return self.take(1, where) == 1

    def time(self, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A splice_time: its ticks, and whether it states any."""
        stated = self.flag(where)
        self.take(7, where & ~stated)
        self.take(6, where & stated)
        return self.take(33, where & stated), where & stated


def _table() -> np.ndarray:
    out = []
    for k in range(256):
        crc = k << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
        out.append(crc)
    return np.array(out, np.uint64)


_CRC = _table()


def crc32_columns(data: Bytes, size: np.ndarray) -> np.ndarray:
    """CRC-32/MPEG-2 of the first ``size`` bytes of each piece, a byte of all pieces at a time, longest pieces first."""
    order = np.argsort(-size, kind="stable")
    begin, size = data.begin[order], size[order]
    crc = np.full(len(order), 0xFFFFFFFF, np.uint64)
    active = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), "left").tolist()
    for k, n in enumerate(active):
        own = crc[:n]
        crc[:n] = (own << np.uint64(8) & np.uint64(0xFFFFFFFF)) ^ _CRC[((own >> np.uint64(24)) ^ data.flat[begin[:n] + k]).astype(np.int64)]
    out = np.empty(len(order), np.int64)
    out[order] = crc.astype(np.int64)
    return out


def typed(fields: str) -> dict[str, pa.DataType]:
    """Arrow types of plain fields that are given as DDL."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "boolean": pa.bool_(), "string": pa.string()}
    return {name: kinds[kind] for name, kind in (x.split(" ") for x in fields.split(", "))}


def column(values, kind: pa.DataType, present: np.ndarray | None = None) -> pa.Array:
    """Values as an Arrow column, null where not ``present``."""
    made = pa.array(values, kind) if present is None or pa.types.is_string(kind) else pa.array(values, mask=~present).cast(kind)
    return made


def structs(kinds: dict[str, pa.DataType], got: dict, present: np.ndarray | None = None) -> pa.StructArray:
    """Structs of ``kinds``; ``got`` has values and where they are present by name, what it lacks is null."""
    n = len(next(iter(got.values()))[0]) if got else 0
    made = [column(*(got[name][0], kind, got[name][1])) if name in got else pa.nulls(n, kind) for name, kind in kinds.items()]
    return pa.StructArray.from_arrays(made, fields=[pa.field(k, t) for k, t in kinds.items()], mask=None if present is None else pa.array(~present))


def lists(values: pa.Array, many: np.ndarray, present: np.ndarray) -> pa.ListArray:
    """``values`` dealt out in order, ``many`` to each row; null where not ``present`` (such a row must have none)."""
    many = np.where(present, many, 0)
    ends = np.r_[0, np.cumsum(many)].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), values, mask=pa.array(~present))
