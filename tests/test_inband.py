import struct

from pyspark.sql import functions as F

from cuelake.functions.splice import crc32_mpeg, write_section
from cuelake.sources import scte104, segments


def box(kind, body):
    return struct.pack(">I", 8 + len(body)) + kind + body


def emsg(section, version, at):
    names = b"urn:scte:scte35:2013:bin\0\0"
    if version:
        return box(b"emsg", b"\1\0\0\0" + struct.pack(">IQII", 90000, at, 0, 77) + names + section)
    return box(b"emsg", b"\0\0\0\0" + names + struct.pack(">IIII", 90000, at, 0, 77) + section)


def moof(at):
    return box(b"moof", box(b"traf", box(b"tfdt", b"\1\0\0\0" + struct.pack(">Q", at))))


def packet(pid, payload, begins=True):
    head = bytes((0x47, (0x40 if begins else 0) | pid >> 8, pid & 255))
    room = 184 - len(payload)
    if room == 0:
        return head + b"\x10" + payload
    stuffing = bytes((room - 1,)) + (b"\0" + b"\xff" * (room - 2) if room > 1 else b"")
    return head + b"\x30" + stuffing + payload


def table(kind, body):
    head = bytes((kind,)) + struct.pack(">H", 0xB000 | len(body) + 4) + body
    return head + struct.pack(">I", crc32_mpeg(head))


def pts(t):
    return bytes((0x21 | t >> 29 & 0xE, t >> 22 & 255, t >> 14 & 0xFE | 1, t >> 7 & 255, t << 1 & 0xFE | 1))


def stream(section, media_at=900_000, kind=0x86):
    pat = table(0, struct.pack(">HBBB", 1, 1, 0, 0) + struct.pack(">HH", 1, 0xE000 | 256))
    pmt = table(2, struct.pack(">HBBBHH", 1, 1, 0, 0, 0xE000 | 257, 0xF000) + struct.pack(">BHH", kind, 0xE000 | 300, 0xF000))
    video = packet(257, b"\0\0\1\xe0\0\0\x80\x80\x05" + pts(media_at) + b"x" * 40)
    out = packet(0, b"\0" + pat) + packet(256, b"\0" + pmt) + video
    if kind == 0x86:
        data = b"\0" + section
        parts = [data[k : k + 184] for k in range(0, len(data), 184)]
        return out + b"".join(packet(300, p, k == 0) for k, p in enumerate(parts)) + packet(8191, b"f" * 184)
    frame = b"urn:scte35\0" + section
    tag = b"PRIV" + struct.pack(">I", len(frame)) + b"\0\0" + frame
    id3 = b"ID3\4\0\0" + bytes((len(tag) >> 21 & 127, len(tag) >> 14 & 127, len(tag) >> 7 & 127, len(tag) & 127)) + tag
    return out + packet(300, b"\0\0\1\xbd\0\0\x80\x80\x05" + pts(media_at + 90_000) + id3)


OUT = write_section(5, 30.0, pts=1_080_000)


def test_cues_and_their_times(spark):
    files = {"ts": stream(OUT), "id3": stream(write_section(6, 30.0), kind=0x15), "v1": emsg(OUT, 1, 990_000) + moof(900_000), "v0": emsg(OUT, 0, 180_000), "none": moof(1), "text": b"hello", "empty": b""}
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "uri string, content binary")
    known = spark.createDataFrame([("d", k, 1000.0) for k in files], "doc_id string, uri string, pdt double")
    found = {x["uri"]: x for x in segments.signals(segments.cues(rows), known).collect()}
    assert set(found) == {"ts", "id3", "v1", "v0"}
    assert {k: x["event_id"] for k, x in found.items()} == {"ts": 5, "id3": 6, "v1": 5, "v0": 5}
    assert {k: x["pdt"] for k, x in found.items()} == {"ts": 3000.0, "id3": 2000.0, "v1": 2000.0, "v0": 3000.0}
    assert all(x["section"]["crc_valid"] for x in found.values())


def test_agreement_with_the_manifest(spark):
    signal = "struct<ok:boolean,crc_valid:boolean>"
    rows = [("same", "u", (True, True), 1, True, 10_000.0, "A"), ("late", "u", (True, False), 2, True, 12_000.0, "A"), ("extra", "u", (True, True), 3, True, 99_000.0, "A"), ("only", "u", (True, True), 4, None, 5.0, "A"), ("bad", "u", (False, None), None, None, None, "A")]
    found = spark.createDataFrame(rows, f"doc_id string, uri string, section {signal}, event_id long, out_of_network boolean, pdt double, hex string")
    own = [("same", 0, 0.0, 10_100.0, 1, False), ("late", 0, 0.0, 10_000.0, 9, False), ("extra", 0, 0.0, 10_000.0, 8, False), ("quiet", 0, 0.0, 1.0, 7, False)]
    breaks = spark.createDataFrame(own, "doc_id string, index int, start_time double, pdt double, event_id long, window_clipped boolean")
    probed = spark.createDataFrame([(x,) for x in ("same", "late", "extra", "only", "quiet")], "doc_id string")
    codes = {}
    for x in segments.agreement(found, breaks, probed).collect():
        codes.setdefault(x["doc_id"], set()).add(x["code"])
    assert codes == {
        "late": {"INBAND_SCTE35_CRC_INVALID", "INBAND_MANIFEST_TIME_MISMATCH", "INBAND_MANIFEST_EVENT_ID_MISMATCH"}, "extra": {"INBAND_SIGNAL_NOT_IN_MANIFEST"},
        "only": {"INBAND_ONLY_SIGNALLING"}, "bad": {"INBAND_SCTE35_UNDECODABLE"}, "quiet": {"NO_INBAND_SCTE35"},
    }


def splice_request(kind=1, event=5001, pre=8000, tenths=900, num=0, expected=0, auto=1):
    return struct.pack(">HH", 0x0101, 14) + struct.pack(">BIHHHBBB", kind, event, 1, pre, tenths, num, expected, auto)


def message(*ops):
    body = struct.pack(">BBBHBB", 0, 0, 1, 0, 0, 0) + bytes((len(ops),)) + b"".join(ops)
    return (struct.pack(">HH", 0xFFFF, len(body) + 4) + body).hex()


def test_scte104(spark):
    texts = {"good": message(splice_request()), "none": message(), "now": message(splice_request(2, tenths=0)), "short": message(splice_request(pre=100, auto=0, num=3, expected=2)), "odd": message(struct.pack(">HH", 0x7FFF, 0)), "bad": "00"}
    rows = scte104.decoded(spark.createDataFrame(list(texts.items()), "doc_id string, message string"))
    first = {x["doc_id"]: x["m"] for x in rows.collect()}
    s = first["good"]["operations"][0]["splice"]
    assert (s["event_id"], s["pre_roll_ms"], s["tenths"], s["auto_return"]) == (5001, 8000, 900, True) and not first["bad"]["ok"]
    codes = {}
    for x in scte104.findings(rows).collect():
        codes.setdefault(x["doc_id"], set()).add(x["code"])
    assert codes == {
        "none": {"S104_NO_OPERATIONS"}, "now": {"S104_IMMEDIATE_SPLICE", "S104_NO_BREAK_DURATION"}, "short": {"S104_SHORT_PRE_ROLL", "S104_NO_AUTO_RETURN", "S104_AVAIL_NUMBERING"}, "odd": {"S104_UNKNOWN_OPERATION"},
    }
    from cuelake.functions.splice import decode_section

    pairs = {"same": write_section(5001, 90.0), "id": write_section(5, 90.0), "long": write_section(5001, 60.0), "in": write_section(5001, 90.0, out_of_network=False), "form": write_section(5001, 90.0, type_id=0x30)}
    both = spark.createDataFrame([(k, texts["good"], "0x" + v.hex()) for k, v in pairs.items()], "doc_id string, message string, payload string")
    both = scte104.decoded(both).withColumn("section", decode_section(F.col("payload")))
    found = {(x["doc_id"], x["code"]) for x in scte104.compared(both).collect()}
    assert found == {("id", "S104_EVENT_ID_CHANGED"), ("long", "S104_DURATION_CHANGED"), ("in", "S104_DIRECTION_CHANGED"), ("form", "S104_FORM_CHANGED")}
