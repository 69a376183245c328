"""Signals inside media segments: splice sections of transport streams, event messages of fragmented MP4.

A segment's bytes are read once, in an Arrow pass over the binary files; everything after (decoding, times, agreement
with the manifest) is columns and joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import splice
from cuelake.operators.findings import emit, rule

PACKET, SYNC, SCTE35_STREAM, METADATA_STREAM = 188, 0x47, 0x86, 0x15
MOST_BOXES = 100_000
#: Milliseconds within which a cue belongs to a break; seconds of drift; of an anchor that can be meant.
NEAR_MS, DRIFT, SANE = 10_000.0, 0.5, 3600.0

CUES = (
    "uri string, carriage string, pid int, owner string, scheme string, emsg_id long, timescale long, delta long, presentation_time long, decode_time long, "
    "anchor long, cue_pts long, data binary"
)
#: Cues that a task passes on at once.
MOST_CUES = 5000


def boxes(data: bytes, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(type, first byte of the content, end) of the boxes of a level."""
    end = len(data) if end is None else end
    for _ in range(MOST_BOXES):
        if start + 8 > end:
            return
        size, head = int.from_bytes(data[start : start + 4], "big"), 8
        if size == 1:
            size, head = int.from_bytes(data[start + 8 : start + 16], "big"), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            return
        yield data[start + 4 : start + 8], start + head, start + size
        start += size


def inside(data: bytes, *path: bytes) -> Iterator[tuple[int, int]]:
    """Extents of the boxes at a path."""
    found = [(0, len(data))]
    for name in path:
        found = [(a, b) for x, y in found for kind, a, b in boxes(data, x, y) if kind == name]
    yield from found


def decode_time(data: bytes) -> int | None:
    for a, _ in inside(data, b"moof", b"traf", b"tfdt"):
        return int.from_bytes(data[a + 4 : a + (12 if data[a] == 1 else 8)], "big")
    return None


def event_messages(data: bytes) -> Iterator[dict]:
    """Event messages (versions 0 and 1) at the top level."""
    number = lambda at, n: int.from_bytes(data[at : at + n], "big")
    for a, end in inside(data, b"emsg"):
        version, at = data[a], a + 4
        out: dict = {}
        if version == 1 and at + 20 <= end:
            out = {"timescale": number(at, 4), "presentation_time": number(at + 4, 8), "emsg_id": number(at + 16, 4)}
            at += 20
        elif version != 0:
            continue
        names = []
        for _ in range(2):
            stop = data.find(b"\0", at, end)
            stop = end if stop < 0 else stop
            names.append(data[at:stop].decode("utf-8", "replace"))
            at = min(stop + 1, end)
        if version == 0:
            if at + 16 > end:
                continue
            out = {"timescale": number(at, 4), "delta": number(at + 4, 4), "emsg_id": number(at + 12, 4)}
            at += 16
        out["timescale"] = out["timescale"] or 1
        yield out | {"scheme": names[0], "data": data[at:end]}


def pes_time(data: bytes) -> int | None:
    if len(data) < 14 or data[:3] != b"\0\0\1" or not data[7] & 0x80:
        return None
    b = data[9:14]
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


def timed_tags(pes: bytes) -> Iterator[tuple[str, bytes]]:
    """Owner and data of private ID3 frames that carry a splice section."""
    body = pes[9 + pes[8] :] if len(pes) > 9 and pes[:3] == b"\0\0\1" else b""
    if body[:3] != b"ID3" or len(body) < 10:
        return
    size = 0
    for b in body[6:10]:
        size = size << 7 | b & 0x7F
    at, end = 10, min(10 + size, len(body))
    while at + 10 <= end and re.fullmatch(rb"[A-Z0-9]{4}", body[at : at + 4]):
        length = int.from_bytes(body[at + 4 : at + 8], "big")
        frame = body[at + 10 : at + 10 + length]
        if not 0 < length <= end - at - 10:
            return
        owner, _, data = frame.partition(b"\0")
        if body[at : at + 4] == b"PRIV" and re.search(rb"scte35", owner, re.I) and data[:1] == b"\xfc":
            yield owner.decode("ascii", "replace"), data
        at += 10 + length


def is_transport(data: bytes) -> bool:
    return len(data) >= PACKET and all(data[k] == SYNC for k in range(0, min(len(data), 5 * PACKET) // PACKET * PACKET, PACKET))


def transport_cues(data: bytes) -> Iterator[dict]:
    """Splice sections of a transport stream, in PIDs that its tables name. anchor is the earliest time stamp of its media,
    or else the first clock reference."""
    tables: dict[int, str] = {0: "pat"}
    open_: dict[int, bytearray] = {}
    cues: list[dict] = []
    clock = earliest = None

    def closed(pid: int, payload: bytes) -> None:
        kind = tables.get(pid)
        if kind == "id3":
            cues.extend({"pid": pid, "carriage": "id3-pes", "owner": o, "data": d, "cue_pts": pes_time(payload)} for o, d in timed_tags(payload))
            return
        size = 3 + int.from_bytes(payload[1:3], "big") % 4096
        end = min(size, len(payload)) - 4
        if kind == "pat" and payload[0] == 0:
            for k in range(8, end - 3, 4):
                if payload[k : k + 2] != b"\0\0":
                    tables.setdefault(int.from_bytes(payload[k + 2 : k + 4], "big") % 8192, "pmt")
        elif kind == "pmt" and payload[0] == 2:
            k = 12 + int.from_bytes(payload[10:12], "big") % 4096
            while k + 5 <= end:
                own = int.from_bytes(payload[k + 1 : k + 3], "big") % 8192
                if name := {SCTE35_STREAM: "scte35", METADATA_STREAM: "id3"}.get(payload[k]):
                    tables.setdefault(own, name)
                k += 5 + int.from_bytes(payload[k + 3 : k + 5], "big") % 4096
        elif kind == "scte35" and payload[0] == 0xFC:
            cues.append({"pid": pid, "carriage": "section", "data": bytes(payload[:size])})

    for at in range(0, len(data) - PACKET + 1, PACKET):
        packet = data[at : at + PACKET]
        if packet[0] != SYNC:
            continue
        pid, begins, control = int.from_bytes(packet[1:3], "big") % 8192, packet[1] & 0x40, packet[3] >> 4 & 3
        body = 4 + (1 + packet[4] if control & 2 else 0)
        if control & 2 and packet[4] >= 7 and packet[5] & 0x10 and clock is None:
            clock = int.from_bytes(packet[6:11], "big") >> 7
        if not control & 1 or body >= PACKET:
            continue
        payload, kind = packet[body:], tables.get(pid)
        if kind is None:
            if begins and (t := pes_time(payload)) is not None and (earliest is None or (t - earliest) % (1 << 33) > 1 << 32):
                earliest = t
        elif kind == "id3":
            if begins:
                if pid in open_:
                    closed(pid, bytes(open_.pop(pid)))
                open_[pid] = bytearray(payload)
            elif pid in open_:
                open_[pid] += payload
        else:
            if begins:
                open_[pid] = bytearray(payload[1 + payload[0] :])
            elif pid in open_:
                open_[pid] += payload
            own = open_.get(pid, b"")
            if len(own) >= 3 and len(own) >= 3 + int.from_bytes(own[1:3], "big") % 4096:
                closed(pid, bytes(open_.pop(pid)))
    for pid in [p for p in open_ if tables.get(p) == "id3"]:
        closed(pid, bytes(open_[pid]))
    anchor = clock if earliest is None else earliest
    yield from (c | {"anchor": anchor} for c in cues)


def found_in(batches: Iterator[pa.RecordBatch], arrow: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Cues of batches of segments (uri, content); those of many segments make one batch."""

    def made(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x.get(f.name) for x in rows], f.type) for f in arrow], schema=arrow)

    for batch in batches:
        out: list[dict] = []
        for uri, data in zip(batch.column(0).to_pylist(), (x.as_py() or b"" for x in batch.column(1)), strict=True):
            if is_transport(data):
                out += [x | {"uri": uri} for x in transport_cues(data)]
            else:
                start = decode_time(data)
                out += [x | {"uri": uri, "carriage": "emsg", "decode_time": start} for x in event_messages(data) if "scte35" in x["scheme"].lower()]
            if len(out) >= MOST_CUES:
                yield made(out)
                out = []
        if out:
            yield made(out)


def cues(files: DataFrame) -> DataFrame:
    """Cues of segments (uri, content), undecoded."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(CUES))
    return files.select("uri", "content").mapInArrow(lambda batches: found_in(batches, arrow), CUES)


def signals(found: DataFrame, segments: DataFrame) -> DataFrame:
    """Decoded cues with the wall-clock time that they mean; ``segments`` gives (doc_id, uri, pdt)."""
    rows = found.join(segments.select("doc_id", "uri", "pdt"), "uri").withColumn("section", splice.decode_bytes(F.col("data")))
    lead = F.try_element_at(splice.segmentation(F.col("section")), F.lit(1))
    insert = F.col("section.splice_insert")
    at = F.coalesce(F.col("section.time_signal.pts_time"), insert["pts_time"]) + F.col("section.pts_adjustment")
    by_clock = splice.pts_delta(F.coalesce(at, F.col("cue_pts")), F.col("anchor")) / splice.TICKS
    by_box = F.coalesce(F.col("delta") / F.col("timescale"), (F.col("presentation_time") - F.col("decode_time")) / F.col("timescale"))
    offset = F.when(F.col("carriage") != "emsg", by_clock).when(F.col("delta").isNotNull() | (F.abs(by_box) < SANE), by_box)
    return rows.select(
        "doc_id", "uri", "carriage", "pid", "owner", "section", F.coalesce(lead["event_id"], insert["event_id"]).alias("event_id"),
        F.coalesce(lead["type_id"].isin(*splice.START_TYPES), insert["out_of_network"]).alias("out_of_network"),
        (F.coalesce(lead["duration_ticks"], insert["break_ticks"]) / splice.TICKS).alias("duration"), (F.col("pdt") + offset * 1000).alias("pdt"), F.hex("data").alias("hex"),
    )


def agreement(found: DataFrame, breaks: DataFrame, probed: DataFrame) -> DataFrame:
    """Findings on cues against the manifest's breaks, for every document in ``probed`` (doc_id)."""
    ok = F.col("section.ok")
    out = emit(found, [rule(~ok, "error", "INBAND_SCTE35_UNDECODABLE"), rule(ok & ~F.col("section.crc_valid"), "warning", "INBAND_SCTE35_CRC_INVALID")])
    opens = found.where(ok & F.coalesce("out_of_network", F.lit(True)))
    own = breaks.select("doc_id", "index", "start_time", F.col("pdt").alias("break_pdt"), F.col("event_id").alias("break_event"), "window_clipped")
    whole = own.where("not window_clipped")
    silent = probed.join(opens.select("doc_id").distinct(), "doc_id", "left_anti").join(whole.select("doc_id").distinct(), "doc_id")
    out = out.unionByName(emit(silent, [rule(F.lit(True), "info", "NO_INBAND_SCTE35")]))
    gap = F.abs(F.col("pdt") - F.col("break_pdt"))
    met = _met(opens, own).withColumn("same", F.coalesce(F.col("event_id") == F.col("break_event"), F.lit(False)))
    # of the cues of a break the first one with its event id, or else the first one near it
    rank = F.struct(F.when(F.col("same"), 0).otherwise(1).alias("rank"), "pdt", "hex", "event_id")
    first = met.where("not window_clipped and break_pdt is not null").groupBy("doc_id", "index").agg(F.min(rank).alias("x"), F.first("start_time").alias("start_time"), F.first("break_pdt").alias("break_pdt"), F.first("break_event").alias("break_event"))
    first = first.select("doc_id", "index", "start_time", "break_pdt", "break_event", "x.pdt", "x.event_id")
    at = {"index": F.col("index"), "at": F.col("start_time")}
    out = out.unionByName(
        emit(first, [rule(gap / 1000 > DRIFT, "error", "INBAND_MANIFEST_TIME_MISMATCH", **at), rule(F.col("event_id") != F.col("break_event"), "warning", "INBAND_MANIFEST_EVENT_ID_MISMATCH", **at)])
    )
    # a break that is cut off by the window is one that the manifest names, too
    loose = opens.where("pdt is not null").join(met.select("doc_id", "uri", "hex").distinct(), ["doc_id", "uri", "hex"], "left_anti").join(own.select("doc_id", F.lit(True).alias("has_breaks")).distinct(), "doc_id", "left")
    return out.unionByName(
        emit(loose, [rule(F.col("has_breaks"), "error", "INBAND_SIGNAL_NOT_IN_MANIFEST"), rule(F.col("has_breaks").isNull(), "info", "INBAND_ONLY_SIGNALLING")])
    )


def _met(cues: DataFrame, breaks: DataFrame) -> DataFrame:
    """Cues with each break of their document that has their event id, or begins less than NEAR_MS from them: a join by
    identifier, and one by bins of time, in which a break stands in its own and both beside it. A pair may come twice."""
    named = cues.where("event_id is not null").join(breaks, (cues.doc_id == breaks.doc_id) & (F.col("event_id") == F.col("break_event"))).drop(breaks.doc_id)
    bin_ = lambda c: F.floor(F.col(c) / NEAR_MS)
    dealt = breaks.where("break_pdt is not null").withColumn("_bin", F.explode(F.array(*[bin_("break_pdt") + k for k in (-1, 0, 1)])))
    timed = cues.where("pdt is not null").withColumn("_bin", bin_("pdt")).join(dealt, ["doc_id", "_bin"]).where(F.abs(F.col("pdt") - F.col("break_pdt")) < NEAR_MS).drop("_bin")
    return named.unionByName(timed)


def addressable(listed: DataFrame, docs: DataFrame) -> DataFrame:
    """A finding for each document of ``docs`` (doc_id) of which no segment (doc_id, uri) has an address."""
    known = listed.where("uri is not null and uri <> ''").select("doc_id").distinct()
    return emit(docs.select("doc_id").distinct().join(known, "doc_id", "left_anti"), [rule(F.lit(True), "info", "SEGMENTS_NOT_ADDRESSABLE")])


def probe_totals(asked: DataFrame, files: DataFrame, found: DataFrame) -> DataFrame:
    """(doc_id, asked, read, bytes, cues): segments (doc_id, uri) that were to be opened, those of them that could be
    (uri, content), their size, and the cues (uri) in them."""
    cues_of = found.groupBy("uri").agg(F.count("*").alias("n"))
    rows = asked.select("doc_id", "uri").join(files.select("uri", F.length("content").alias("size")), "uri", "left").join(cues_of, "uri", "left")
    return rows.groupBy("doc_id").agg(
        F.count("*").alias("asked"), F.count("size").alias("read"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("cues")
    )


def chosen(listed: DataFrame, breaks: DataFrame, most: int) -> DataFrame:
    """Segments (doc_id, idx, start_time, ...) worth opening, ``most`` a document: those in which a break begins and the ones
    before them, breaks in order, then others at an even stride."""
    begun = listed.join(breaks.select("doc_id", "index", F.col("start_time").alias("_at")), "doc_id").where(F.col("start_time") + 0.001 >= F.col("_at"))
    begun = begun.groupBy("doc_id", "index").agg(F.min("idx").alias("_first"))
    near = begun.select("doc_id", "index", F.explode(F.array(F.col("_first") - 1, F.col("_first"))).alias("idx")).where("idx >= 0").groupBy("doc_id", "idx").agg(F.min("index").alias("_break"))
    size = near.groupBy("doc_id").agg(F.count("*").alias("_taken"))
    total = listed.groupBy("doc_id").agg(F.count("*").alias("_n")).join(size, "doc_id", "left")
    stride = F.greatest(F.lit(1), F.floor(F.col("_n") / F.greatest(F.lit(1), F.lit(most) - F.coalesce("_taken", F.lit(0)))))
    rows = listed.join(near, ["doc_id", "idx"], "left").join(total.withColumn("_stride", stride), "doc_id")
    rows = rows.where(F.col("_break").isNotNull() | (F.col("idx") % F.col("_stride") == 0))
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("_break").isNull(), "_break", "idx"))
    return rows.withColumn("_place", order).where(F.col("_place") <= most).select(*listed.columns)
