"""SCTE-35 splice_info_section: bytes to a struct column and back, CRC-32/MPEG-2, and UPID checks.

Bit fields are read in numpy, a step for all sections of an Arrow batch at once; payload sniffing, polarity, durations and
UPID checks are column expressions.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from cuelake.functions.bitfields import Bytes, Cursors, column, crc32_columns, lists, structs, typed

# Fixed values of the standard.
COMMANDS = {0: "splice_null", 4: "splice_schedule", 5: "splice_insert", 6: "time_signal", 7: "bandwidth_reservation", 255: "private_command"}
START_TYPES = (0x10, 0x13, 0x17, 0x20, 0x22, 0x24, 0x26, 0x30, 0x32, 0x34, 0x36, 0x38, 0x3A, 0x3C, 0x3E, 0x40, 0x42, 0x44, 0x46, 0x50)
END_TYPES = (0x11, 0x14, 0x21, 0x23, 0x25, 0x27, 0x31, 0x33, 0x35, 0x37, 0x39, 0x3B, 0x3D, 0x3F, 0x41, 0x43, 0x45, 0x47, 0x51)
UNPAIRED_START = 0x17
SUB_SEGMENT_TYPES = (0x34, 0x36, 0x38, 0x3A)
TEXT_UPIDS = (0x01, 0x02, 0x03, 0x07, 0x09, 0x0A, 0x0B, 0x0E, 0x0F, 0x11)
FIXED_UPID_LENGTH = {0x06: 8, 0x08: 8, 0x0A: 12, 0x10: 16}
TICKS = 90_000

_DESCRIPTOR = (
    "tag int, event_id long, cancel boolean, duration_ticks long, upid_type int, upid_hex string, upid_text string, "
    "type_id int, segment_num int, segments_expected int, sub_segment_num int, sub_segments_expected int, raw_hex string"
)
_INSERT = (
    "event_id long, cancel boolean, out_of_network boolean, program_splice boolean, splice_immediate boolean, pts_time long, "
    "utc_time long, auto_return boolean, break_ticks long, unique_program_id int, avail_num int, avails_expected int"
)
SECTION = (
    "struct<ok boolean, error string, section_length int, protocol_version int, encrypted boolean, encryption_algorithm int, "
    f"pts_adjustment long, tier int, command_type int, splice_insert struct<{_INSERT}>, time_signal struct<specified boolean, pts_time long>, "
    f"schedule array<struct<{_INSERT}>>, descriptors array<struct<{_DESCRIPTOR}>>, crc32 long, crc_valid boolean>"
)


def upid_text(kind: int, data: bytes) -> str:
    printable = lambda b: "".join(chr(c) for c in b if 32 <= c < 127)
    if kind in TEXT_UPIDS:
        return printable(data)
    if kind == 0x08 and len(data) == 8:
        return "0x" + data.hex()
    if kind == 0x0C and len(data) > 4:
        private = data[4:]
        shown = private.decode("ascii") if all(32 <= c < 127 or c in b"\t\n\r\f\v" for c in private) else "0x" + private.hex()
        return f"{printable(data[:4])} {shown}"
    if kind == 0x0D:
        parts, at = [], 0
        while at + 2 <= len(data) and at + 2 + data[at + 1] <= len(data):
            body = data[at + 2 : at + 2 + data[at + 1]]
            parts.append(f"{data[at]:#04x}={upid_text(data[at], body) or body.hex()}")
            at += 2 + len(body)
        return " | ".join(parts)
    if kind == 0x10 and len(data) == 16:
        h = data.hex()
        return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))
    return ""


def _event(bits: Cursors, where: np.ndarray, scheduled: bool) -> pa.StructArray:
    """A splice_insert, or one event of a splice_schedule, in each of the rows."""
    got = {"event_id": (bits.take(32, where), where), "cancel": (cancel := bits.flag(where), where)}
    bits.take(7, where)
    more = where & ~cancel
    got["out_of_network"], got["program_splice"] = (bits.flag(more), more), (whole := bits.flag(more), more)
    timed = bits.flag(more)
    immediate = np.zeros(len(where), bool)
    if scheduled:
        bits.take(5, more)
    else:
        immediate = bits.flag(more)
        got["splice_immediate"] = (immediate, more)
        bits.take(4, more)
    times = np.where(whole, 1, bits.take(8, more & ~whole))
    when, stated = np.zeros(len(where), np.int64), np.zeros(len(where), bool)
    for k in range(int(times[more].max(initial=0))):
        now = more & (k < times) & bits.good
        if not now.any():
            break
        bits.take(8, now & ~whole)
        if scheduled:
            value, known = bits.take(32, now), now
        else:
            value, known = bits.time(now & ~immediate)
        when, stated = np.where(now & whole, value, when), np.where(now & whole, known, stated)
    got["utc_time" if scheduled else "pts_time"] = (when, more & stated)
    timed &= more
    got["auto_return"] = (bits.flag(timed), timed)
    bits.take(6, timed)
    got["break_ticks"] = (bits.take(33, timed), timed)
    for name, n in (("unique_program_id", 16), ("avail_num", 8), ("avails_expected", 8)):
        got[name] = (bits.take(n, more), more)
    return structs(typed(_INSERT), got, where)


def _descriptors(data: Bytes, rows: np.ndarray, at: np.ndarray, tag: np.ndarray, size: np.ndarray) -> pa.StructArray:
    """Descriptors that stand at ``at`` in ``rows`` of the data, all at once."""
    body = data.begin[rows] + at + 2
    raw = [data.flat_bytes[a : a + n].hex() for a, n in zip(body.tolist(), size.tolist(), strict=True)]
    own = (tag == 2) & (size >= 5)
    bits = Cursors(data.flat, body + 4, np.maximum(size - 4, 0))
    event, cancel = bits.take(32, own), bits.flag(own)
    bits.take(7, own)
    more = own & ~cancel
    whole, timed = bits.flag(more), bits.flag(more)
    bits.take(6, more)
    bits.skip(bits.take(8, more & ~whole) * 48, more & ~whole)
    ticks = bits.take(40, more & timed)
    kind, length = bits.take(8, more), bits.take(8, more)
    upid = bits.begin + bits.at // 8
    bits.skip(length * 8, more)
    last = [bits.take(8, more) for _ in range(3)]
    sub = more & bits.good & np.isin(last[0], SUB_SEGMENT_TYPES) & (bits.left() >= 16)
    parts = [bits.take(8, sub) for _ in range(2)]
    read = own & bits.good  # what can't be read is kept by its tag and bytes
    hexed, text = np.full(len(rows), None, object), np.full(len(rows), None, object)
    hexed[read], text[read] = "", ""
    for k in np.flatnonzero(read & more & (length > 0)).tolist():
        value = data.flat_bytes[upid[k] : upid[k] + length[k]]
        hexed[k], text[k] = value.hex(), upid_text(int(kind[k]), value)
    full = read & more
    got = {
        "tag": (tag, None), "event_id": (event, read), "cancel": (cancel, read), "duration_ticks": (ticks, full & timed), "upid_type": (kind, read), "upid_hex": (hexed, read), "upid_text": (text, read),
        "type_id": (last[0], read), "segment_num": (last[1], full), "segments_expected": (last[2], full), "sub_segment_num": (parts[0], full & sub), "sub_segments_expected": (parts[1], full & sub), "raw_hex": (raw, None),
    }
    return structs(typed(_DESCRIPTOR), got)


def read_sections(values: pa.Array) -> pa.Array:
    """The fields of a batch of sections, each step for all of them at once. A section that can't be read has ok = false and
    the reason; null gives null."""
    data = Bytes(values)
    n, given = len(values), data.given
    bits = Cursors(data.flat, data.begin, data.size)
    error = np.full(n, None, object)
    error[given & (data.size < 14)] = "too short for a section"
    live = given & (data.size >= 14)
    table = bits.take(8, live)
    for k in np.flatnonzero(live & (table != 0xFC)).tolist():
        error[k] = f"table_id is {int(table[k]):#04x}, not 0xfc"
    live &= table == 0xFC
    bits.take(4, live)
    head = {"section_length": bits.take(12, live), "protocol_version": bits.take(8, live), "encrypted": bits.flag(live), "encryption_algorithm": bits.take(6, live), "pts_adjustment": bits.take(33, live)}
    bits.take(8, live)
    head["tier"], length, kind = bits.take(12, live), bits.take(12, live), bits.take(8, live)
    head["command_type"], begun = kind, bits.at.copy()
    insert = _event(bits, live & (kind == 5), False)
    is_time = live & (kind == 6)
    when, stated = bits.time(is_time)
    is_schedule = live & (kind == 4)
    many = bits.take(8, is_schedule)
    events, owners = [], []
    for k in range(int(many.max(initial=0))):
        now = is_schedule & (k < many) & bits.good
        if not now.any():
            break
        events.append(_event(bits, now, True).filter(pa.array(now)))
        owners.append(np.flatnonzero(now))
    stated_length = live & bits.good & (length != 0xFFF)
    bits.at = np.where(stated_length, begun + 8 * length, bits.at)
    loop = bits.take(16, live)
    live &= bits.good
    error[given & ~bits.good & (error == None)] = "the section ends early"  # noqa: E711
    at = bits.at // 8
    end = np.minimum(at + loop, data.size)
    rows = np.flatnonzero(live)
    found: list[tuple[np.ndarray, ...]] = []
    at = at[rows]
    while len(rows):
        go = at + 2 <= end[rows]
        rows, at = rows[go], at[go]
        tag, size = data.byte(rows, at), data.byte(rows, at + 1)
        go = at + 2 + size <= data.size[rows]
        rows, at, tag, size = rows[go], at[go], tag[go], size[go]
        if len(rows):
            found.append((rows, at, tag, size))
        at = at + 2 + size
    of, where, tag, size = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 4
    order = np.argsort(of, kind="stable")
    descriptors = lists(_descriptors(data, of[order], where[order], tag[order], size[order]), np.bincount(of, minlength=n), live)
    if events:
        owner = np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        order = order[live[owner[order]]]
        schedule = lists(pa.concat_arrays(events).take(pa.array(order)), np.bincount(owner, minlength=n), live & is_schedule)
    else:
        schedule = lists(structs(typed(_INSERT), {}, np.zeros(0, bool)), np.zeros(n, np.int64), live & is_schedule)
    whole = head["section_length"] + 3
    checked = live & (whole >= 4) & (whole <= data.size)
    last = Cursors(data.flat, data.begin + np.where(checked, whole - 4, 0), np.full(n, 4))
    crc = last.take(32, checked)
    valid = checked & (crc32_columns(data, np.where(checked, whole, 0)) == 0)
    signal = structs({"specified": pa.bool_(), "pts_time": pa.int64()}, {"specified": (stated, is_time), "pts_time": (when, is_time & stated)}, live & is_time)
    insert = pa.StructArray.from_arrays(insert.flatten(), fields=[insert.type.field(k) for k in range(insert.type.num_fields)], mask=pa.array(~(live & (kind == 5))))
    plain = typed("section_length int, protocol_version int, encrypted boolean, encryption_algorithm int, pts_adjustment long, tier int, command_type int")
    made = {"ok": column(live, pa.bool_(), given), "error": pa.array(error, pa.string())}
    made |= {name: column(head[name], kind_, live) for name, kind_ in plain.items()}
    made |= {"splice_insert": insert, "time_signal": signal, "schedule": schedule, "descriptors": descriptors, "crc32": column(crc, pa.int64(), live), "crc_valid": column(valid, pa.bool_(), live)}
    return pa.StructArray.from_arrays([*made.values()], names=[*made], mask=pa.array(~given))


def read_section(data: bytes | None) -> dict | None:
    """One section, as a dict of all its fields."""
    return read_sections(pa.array([data], pa.binary()))[0].as_py()


#: Bytes with their bits in reverse.
_MIRRORED = bytes(int(f"{k:08b}"[::-1], 2) for k in range(256))


def crc32_mpeg(data: bytes) -> int:
    """CRC of polynomial 04C11DB7, not reflected, from all ones; 0 over a section that ends with its own CRC. zlib has the
    reflected one, so that bits are mirrored on the way in and out."""
    crc = zlib.crc32(data.translate(_MIRRORED)) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_MIRRORED), "big")


def crc32_of(values: pa.Array) -> pa.Array:
    own = Bytes(values)
    return column(crc32_columns(own, own.size), pa.int64(), own.given)


class _Writer:
    def __init__(self) -> None:
        self.value = self.size = 0

    def put(self, n: int, value: int) -> _Writer:
        self.value, self.size = self.value << n | (value & ((1 << n) - 1)), self.size + n
        return self

    def done(self) -> bytes:
        return self.value.to_bytes(self.size // 8, "big")


def write_section(event_id: int, seconds: float | None = None, out_of_network: bool = True, auto_return: bool = True, pts: int | None = None, type_id: int | None = None, upid_type: int = 0, upid: bytes = b"", valid_crc: bool = True) -> bytes:
    """A splice_insert, or with ``type_id`` a time_signal with one segmentation descriptor."""
    ticks = None if seconds is None else int(seconds * TICKS + 0.5)
    command, descriptor = _Writer(), b""
    if type_id is None:
        command.put(32, event_id).put(1, 0).put(7, 127).put(1, out_of_network).put(1, 1).put(1, ticks is not None).put(1, pts is None).put(4, 15)
        if pts is not None:
            command.put(1, 1).put(6, 63).put(33, pts)
        if ticks is not None:
            command.put(1, auto_return).put(6, 63).put(33, ticks)
        command.put(16, 1).put(8, 0).put(8, 0)
    else:
        command.put(1, pts is not None)
        command.put(7, 127) if pts is None else command.put(6, 63).put(33, pts)
        w = _Writer().put(32, 0x43554549).put(32, event_id).put(1, 0).put(7, 127).put(1, 1).put(1, ticks is not None).put(1, 1).put(5, 31)
        if ticks is not None:
            w.put(40, ticks)
        w.put(8, upid_type).put(8, len(upid)).put(8 * len(upid), int.from_bytes(upid, "big")).put(8, type_id).put(8, 1).put(8, 1)
        body = w.done()
        descriptor = bytes((2, len(body))) + body
    payload = command.done()
    rest = _Writer().put(8, 0).put(1, 0).put(6, 0).put(33, 0).put(8, 0).put(12, 0xFFF).put(12, len(payload)).put(8, 5 if type_id is None else 6)
    body = rest.done() + payload + len(descriptor).to_bytes(2, "big") + descriptor
    head = _Writer().put(8, 0xFC).put(4, 3).put(12, len(body) + 4).done()
    return head + body + (crc32_mpeg(head + body) ^ (0 if valid_crc else 1)).to_bytes(4, "big")


def payload_bytes(payload: Column) -> Column:
    """Quotes stripped; 0x and hex, or bare hex of even length that begins with fc; else base64."""
    text = F.regexp_replace(F.trim(payload), '^"|"$', "")
    digits = F.regexp_replace(text, "^0[xX]", "")
    even = F.substring(digits, F.lit(1), (F.floor(F.length(digits) / 2) * 2).cast("int"))
    hexed = text.rlike("^0[xX][0-9A-Fa-f]*$")
    bare = text.rlike("^[fF][cC]([0-9A-Fa-f]{2})*$")
    return F.when(hexed | bare, F.unhex(even)).otherwise(F.unbase64(text))


def decode_section(payload: Column) -> Column:
    """A payload text as a struct of its section."""
    return decode_bytes(payload_bytes(payload))


def decode_bytes(data: Column) -> Column:
    """The bytes of a section as a struct."""
    return F.arrow_udf(read_sections, SECTION)(data)


def crc_residue(data: Column) -> Column:
    return F.arrow_udf(crc32_of, "long")(data)


def segmentation(section: Column) -> Column:
    """The section's readable segmentation descriptors."""
    return F.filter(section["descriptors"], lambda d: (d["tag"] == 2) & d["type_id"].isNotNull())


def lead_descriptor(section: Column) -> Column:
    """The first descriptor of a start type, or else the first one."""
    all_ = segmentation(section)
    starts = F.filter(all_, lambda d: d["type_id"].isin(*START_TYPES))
    return F.coalesce(F.try_element_at(starts, F.lit(1)), F.try_element_at(all_, F.lit(1)))


def pts_delta(a: Column, b: Column) -> Column:
    """a - b in ticks modulo 2^33, from -2^32 to 2^32 - 1."""
    half = 1 << 32
    return F.pmod(a - b + F.lit(half), F.lit(2 * half)) - F.lit(half)


def unwrapped(pts: Column, clock: Column) -> Column:
    """A time of 33 bits as the one nearest to a clock (ticks that don't wrap)."""
    return clock + pts_delta(pts, clock)


def upid_problem(kind: Column, hexed: Column, text: Column) -> Column:
    """The code of what is wrong with a UPID, or null."""
    size = F.floor(F.length(F.coalesce(hexed, F.lit(""))) / 2)
    wrong = F.lit(False)
    for k, n in FIXED_UPID_LENGTH.items():
        wrong = wrong | ((kind == k) & (size != n))
    byte = lambda at: F.conv(F.substring(hexed, (2 * at + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    begun = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"), F.lit(False).alias("cut"))

    def step(acc, _):
        length = byte(acc["at"] + 1)
        over = acc["at"] + 2 + length > size
        more = ~acc["cut"] & (acc["at"] + 2 <= size)
        return F.struct(
            F.when(more & ~over, acc["at"] + 2 + length).otherwise(acc["at"]).cast("int").alias("at"),
            F.when(more & ~over, acc["n"] + 1).otherwise(acc["n"]).alias("n"),
            (acc["cut"] | (more & over)).alias("cut"),
        )

    walk = F.aggregate(F.sequence(F.lit(0), (size / 2).cast("int")), begun, step)
    return (
        F.when(kind == 0, F.when(size > 0, "UPID_TYPE_NOT_USED"))
        .when(size == 0, "UPID_EMPTY")
        .when(wrong, "UPID_WRONG_LENGTH")
        .when((kind == 0x03) & ~text.rlike("^[A-Z0-9]{11,12}$"), "UPID_MALFORMED_ADID")
        .when((kind == 0x0F) & ~text.rlike("^[A-Za-z][A-Za-z0-9+.-]*:[^\\s]+$"), "UPID_MALFORMED_URI")
        .when((kind == 0x0C) & (size <= 4), "UPID_MPU_NO_PRIVATE_DATA")
        .when((kind == 0x0D) & walk["cut"], "UPID_MID_TRUNCATED")
        .when((kind == 0x0D) & (walk["n"] == 0), "UPID_MID_EMPTY")
    )


def register(spark) -> None:
    """Make the decoders available to SQL."""
    spark.udf.register("decode_scte35", F.arrow_udf(read_sections, SECTION))
    spark.udf.register("crc32_mpeg", F.arrow_udf(crc32_of, "long"))
