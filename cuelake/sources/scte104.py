"""SCTE-104 messages: bytes to operations, and what is wrong with them, or differs from the splice that came of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions.bitfields import Bytes, Cursors, column, lists, structs, typed
from cuelake.functions.splice import TEXT_UPIDS, TICKS
from cuelake.operators.findings import emit, rule

#: Known operations; kinds of splice requests that start a break.
OPERATIONS = (0x0000, 0x0001, 0x0002, 0x0003, 0x0004, 0x0007, 0x0008, 0x0009, 0x0101, 0x0102, 0x0103, 0x0104, 0x0105, 0x0106, 0x0107, 0x0108, 0x0109, 0x010A, 0x010B)
NORMAL, IMMEDIATE = 1, 2
SPLICE, SEGMENTATION, MULTIPLE = 0x0101, 0x0107, 0xFFFF
TIME_BITS = {1: 56, 2: 32, 3: 16}
SHORT_PRE_ROLL_MS, SAME = 4000, 0.05

MESSAGE = (
    "struct<ok boolean, error string, multiple boolean, protocol_version int, as_index int, message_number int, dpi_pid_index int, time_type int, utc_seconds long, operations array<struct<op_id int, raw_hex string, "
    "splice struct<insert_type int, event_id long, program_id int, pre_roll_ms int, tenths int, avail_num int, avails_expected int, auto_return boolean>, "
    "segmentation struct<event_id long, cancel boolean, tenths int, upid_type int, upid_hex string, upid_text string, type_id int, segment_num int, segments_expected int>>>>"
)


_HEAD = "protocol_version int, as_index int, message_number int, dpi_pid_index int"
_SPLICE = "insert_type int, event_id long, program_id int, pre_roll_ms int, tenths int, avail_num int, avails_expected int, auto_return boolean"
_SEGMENT = "event_id long, cancel boolean, tenths int, upid_type int, upid_hex string, upid_text string, type_id int, segment_num int, segments_expected int"


def _operations(data: Bytes, number: np.ndarray, begin: np.ndarray, size: np.ndarray) -> pa.StructArray:
    """Operations of all messages at once. One that is not known, or ends early, is kept as its bytes."""
    bits, spliced = Cursors(data.flat, begin, size), number == SPLICE
    widths = (("insert_type", 8), ("event_id", 32), ("program_id", 16), ("pre_roll_ms", 16), ("tenths", 16), ("avail_num", 8), ("avails_expected", 8))
    splice = {name: (bits.take(n, spliced), None) for name, n in widths} | {"auto_return": (bits.take(8, spliced) == 1, None)}
    own = number == SEGMENTATION
    segment = {"event_id": (bits.take(32, own), None), "cancel": (bits.take(8, own) == 1, None), "tenths": (bits.take(16, own), None), "upid_type": ((kind := bits.take(8, own)), None)}
    length = bits.take(8, own)
    at = bits.begin + bits.at // 8
    bits.skip(length * 8, own)
    segment |= {name: (bits.take(8, own), None) for name in ("type_id", "segment_num", "segments_expected")}
    hexed, text = np.full(len(number), "", object), np.full(len(number), "", object)
    for k in np.flatnonzero(own & bits.good & (length > 0)).tolist():
        upid = data.flat_bytes[at[k] : at[k] + length[k]]
        hexed[k] = upid.hex()
        if kind[k] in TEXT_UPIDS:
            text[k] = "".join(chr(c) for c in upid if 32 <= c < 127)
    segment |= {"upid_hex": (hexed, None), "upid_text": (text, None)}
    read = (spliced | own) & bits.good
    raw = [None if r else data.flat_bytes[a : a + n].hex() for r, a, n in zip(read.tolist(), begin.tolist(), size.tolist(), strict=True)]
    parts = {"op_id": column(number, pa.int32()), "raw_hex": pa.array(raw, pa.string()), "splice": structs(typed(_SPLICE), splice, read & spliced), "segmentation": structs(typed(_SEGMENT), segment, read & own)}
    return pa.StructArray.from_arrays([*parts.values()], names=[*parts])


def read_messages(values: pa.Array) -> pa.Array:
    """The fields of a batch of messages, each step for all of them at once. One that can't be read has ok = false and the
    reason; null gives null."""
    data = Bytes(values)
    n, given = len(values), data.given
    bits = Cursors(data.flat, data.begin, data.size)
    live = given & (data.size >= 6)
    first = bits.take(16, live)
    bits.take(16, live)
    head = {name: bits.take(k, live) for name, k in (("protocol_version", 8), ("as_index", 8), ("message_number", 8), ("dpi_pid_index", 16))}
    several = live & (first == MULTIPLE)
    bits.take(8, several)
    kind = bits.take(8, several)
    utc = bits.take(32, several & (kind == 1))
    for k, width in TIME_BITS.items():
        bits.skip(width - 32 if k == 1 else width, several & (kind == k))
    many = bits.take(8, several)
    live &= bits.good
    alone = np.flatnonzero(live & ~several)
    start = bits.at[alone] // 8
    found = [(alone, first[alone], data.begin[alone] + start, data.size[alone] - start)]
    rows = np.flatnonzero(live & several)
    at = bits.at[rows] // 8
    turn = 0
    while len(rows):
        go = (turn < many[rows]) & (data.size[rows] - at >= 4)
        rows, at, turn = rows[go], at[go], turn + 1
        number, length = (data.byte(rows, at + k) << 8 | data.byte(rows, at + k + 1) for k in (0, 2))
        length = np.minimum(length, data.size[rows] - at - 4)
        found.append((rows, number, data.begin[rows] + at + 4, length))
        at = at + 4 + length
    of, number, begin, size = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(of, kind="stable")
    operations = lists(_operations(data, number[order], begin[order], size[order]), np.bincount(of, minlength=n), live)
    error = np.full(n, None, object)
    error[given & ~live] = "the section ends early"
    error[given & (data.size < 6)] = "too short for a message"
    made = {"ok": column(live, pa.bool_(), given), "error": pa.array(error, pa.string()), "multiple": column(several, pa.bool_(), live)}
    made |= {name: column(head[name], pa.int32(), live) for name in typed(_HEAD)}
    made |= {"time_type": column(kind, pa.int32(), live & several), "utc_seconds": column(utc, pa.int64(), live & several & (kind == 1)), "operations": operations}
    return pa.StructArray.from_arrays([*made.values()], names=[*made], mask=pa.array(~given))


def message_bytes(text: Column) -> Column:
    """Hex with separators, or else base64."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(text), '^"|"$', ""), "^0[xX]", ""), r"[\s:,-]", "")
    return F.when(plain.rlike("^([0-9A-Fa-f]{2})+$"), F.unhex(plain)).otherwise(F.unbase64(F.regexp_replace(F.trim(text), '^"|"$', "")))


def decoded(messages: DataFrame, name: str = "message") -> DataFrame:
    return messages.withColumn("m", F.arrow_udf(read_messages, MESSAGE)(message_bytes(F.col(name))))


def findings(messages: DataFrame) -> DataFrame:
    """Findings of decoded messages (doc_id, m)."""
    out = emit(messages.where("m.ok"), [rule(F.size("m.operations") == 0, "warning", "S104_NO_OPERATIONS")])
    ops = messages.where("m.ok").select("doc_id", F.explode("m.operations").alias("o"))
    s = F.col("o.splice")
    starts = s["insert_type"].isin(NORMAL, IMMEDIATE)
    return out.unionByName(
        emit(
            ops,
            [
                rule(~F.col("o.op_id").isin(*OPERATIONS), "info", "S104_UNKNOWN_OPERATION"),
                rule(s["insert_type"] == IMMEDIATE, "warning", "S104_IMMEDIATE_SPLICE"),
                rule((s["insert_type"] == NORMAL) & (s["pre_roll_ms"] < SHORT_PRE_ROLL_MS), "warning", "S104_SHORT_PRE_ROLL"),
                rule(starts & (s["tenths"] == 0), "warning", "S104_NO_BREAK_DURATION"),
                rule(starts & ~s["auto_return"] & (s["tenths"] > 0), "info", "S104_NO_AUTO_RETURN"),
                rule((s["avails_expected"] > 0) & (s["avail_num"] > s["avails_expected"]), "warning", "S104_AVAIL_NUMBERING"),
            ],
        )
    )


def compared(rows: DataFrame) -> DataFrame:
    """Findings on a message (m) beside the decoded section that an encoder made of it (section), by doc_id."""
    ops = F.coalesce(F.col("m.operations"), F.array().cast("array<" + MESSAGE.split("operations array<", 1)[1][:-1]))
    first = lambda name: F.try_element_at(F.filter(ops, lambda o: o[name].isNotNull()), F.lit(1))[name]
    rows = rows.withColumns({"s": first("splice"), "g": first("segmentation"), "i": F.col("section.splice_insert"), "d": F.try_element_at(F.filter("section.descriptors", lambda d: (d["tag"] == 2) & d["type_id"].isNotNull()), F.lit(1))})
    s, g, i, d = (F.col(x) for x in "sgid")
    both = s.isNotNull() & i.isNotNull()
    out = s["insert_type"].isin(NORMAL, IMMEDIATE)
    length = F.coalesce(i["break_ticks"] / TICKS, F.lit(0.0))
    return emit(
        rows,
        [
            rule(s.isNull() & g.isNull(), "info", "S104_NOTHING_TO_COMPARE"),
            rule(both & (s["event_id"] != i["event_id"]), "error", "S104_EVENT_ID_CHANGED"),
            rule(both & (out != F.coalesce(i["out_of_network"], F.lit(False))), "error", "S104_DIRECTION_CHANGED"),
            rule(both & (s["tenths"] > 0) & (F.abs(length - s["tenths"] / 10) >= SAME), "error", "S104_DURATION_CHANGED"),
            rule(s.isNotNull() & i.isNull() & d.isNotNull(), "info", "S104_FORM_CHANGED"),
            rule(s.isNotNull() & i.isNull() & d.isNull(), "error", "S104_NO_SPLICE_EMITTED"),
            rule(g.isNotNull() & d.isNotNull() & (g["event_id"] != d["event_id"]), "error", "S104_SEGMENTATION_EVENT_ID_CHANGED"),
            rule(g.isNotNull() & d.isNotNull() & (g["type_id"] != d["type_id"]), "error", "S104_SEGMENTATION_TYPE_CHANGED"),
        ],
    )
