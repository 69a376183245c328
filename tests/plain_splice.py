"""Sections and messages read one at a time: the plain version of the batch readers."""

from cuelake.functions.splice import SUB_SEGMENT_TYPES, TEXT_UPIDS, upid_text
from cuelake.sources.scte104 import MULTIPLE, SEGMENTATION, SPLICE, TIME_BITS


def crc32_mpeg(data: bytes) -> int:
    """CRC of polynomial 04C11DB7, not reflected, from all ones; 0 over a section that ends with its own CRC."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


class Bits:
    """Reads unsigned fields from the front of some bytes."""

    def __init__(self, data: bytes):
        self.value, self.size, self.at = int.from_bytes(data, "big"), 8 * len(data), 0

    def take(self, n: int) -> int:
        if self.at + n > self.size:
            raise ValueError("the section ends early")
        self.at += n
        return self.value >> (self.size - self.at) & ((1 << n) - 1)

    def flag(self) -> bool:
        return self.take(1) == 1


def _time(bits: Bits) -> int | None:
    if not bits.flag():
        bits.take(7)
        return None
    bits.take(6)
    return bits.take(33)


def _event(bits: Bits, scheduled: bool) -> dict:
    """A splice_insert, or one event of a splice_schedule."""
    event = {"event_id": bits.take(32), "cancel": bits.flag()}
    bits.take(7)
    if event["cancel"]:
        return event
    event["out_of_network"], event["program_splice"] = bits.flag(), bits.flag()
    timed = bits.flag()
    immediate = False
    if scheduled:
        bits.take(5)
    else:
        immediate = event["splice_immediate"] = bits.flag()
        bits.take(4)
    times = 1 if event["program_splice"] else bits.take(8)
    for _ in range(times):
        if not event["program_splice"]:
            bits.take(8)
        if scheduled:
            when = bits.take(32)
            if event["program_splice"]:
                event["utc_time"] = when
        elif not immediate:
            when = _time(bits)
            if event["program_splice"]:
                event["pts_time"] = when
    if timed:
        event["auto_return"] = bits.flag()
        bits.take(6)
        event["break_ticks"] = bits.take(33)
    event["unique_program_id"], event["avail_num"], event["avails_expected"] = bits.take(16), bits.take(8), bits.take(8)
    return event


def _segmentation(body: bytes) -> dict:
    bits = Bits(body)
    out = {"tag": 2, "event_id": bits.take(32), "cancel": bits.flag(), "type_id": 0, "upid_type": 0, "upid_hex": "", "upid_text": ""}
    bits.take(7)
    if out["cancel"]:
        return out
    whole, timed = bits.flag(), bits.flag()
    bits.take(6)
    if not whole:
        for _ in range(bits.take(8)):
            bits.take(48)
    if timed:
        out["duration_ticks"] = bits.take(40)
    out["upid_type"], size = bits.take(8), bits.take(8)
    upid = bytes(bits.take(8) for _ in range(size))
    out["upid_hex"], out["upid_text"] = upid.hex(), upid_text(out["upid_type"], upid)
    out["type_id"], out["segment_num"], out["segments_expected"] = bits.take(8), bits.take(8), bits.take(8)
    if out["type_id"] in SUB_SEGMENT_TYPES and bits.size - bits.at >= 16:
        out["sub_segment_num"], out["sub_segments_expected"] = bits.take(8), bits.take(8)
    return out


def read_section(data: bytes | None) -> dict | None:
    """The section's fields; a section that can't be read has ok = false and the reason. Null gives null."""
    if data is None:
        return None
    try:
        return _read(data)
    except ValueError as e:
        return {"ok": False, "error": str(e)}


def _read(data: bytes) -> dict:
    if len(data) < 14:
        raise ValueError("too short for a section")
    bits = Bits(data)
    if (table := bits.take(8)) != 0xFC:
        raise ValueError(f"table_id is {table:#04x}, not 0xfc")
    bits.take(4)
    out: dict = {"ok": True, "section_length": bits.take(12), "protocol_version": bits.take(8), "encrypted": bits.flag()}
    out["encryption_algorithm"], out["pts_adjustment"] = bits.take(6), bits.take(33)
    bits.take(8)
    out["tier"], length, kind = bits.take(12), bits.take(12), bits.take(8)
    out["command_type"], begin = kind, bits.at
    if kind == 5:
        out["splice_insert"] = _event(bits, False)
    elif kind == 6:
        when = _time(bits)
        out["time_signal"] = {"specified": when is not None, "pts_time": when}
    elif kind == 4:
        out["schedule"] = [_event(bits, True) for _ in range(bits.take(8))]
    if length != 0xFFF:  # the length is stated: go where it says
        bits.at = begin + 8 * length
    loop = bits.take(16)
    at = bits.at // 8
    end, out["descriptors"] = at + loop, []
    while at + 2 <= min(end, len(data)):
        tag, size = data[at], data[at + 1]
        body = data[at + 2 : at + 2 + size]
        if len(body) < size:
            break
        found = {"tag": tag}
        if tag == 2 and size >= 5:
            try:
                found = _segmentation(body[4:])
            except ValueError:
                found = {"tag": tag}
        out["descriptors"].append(found | {"raw_hex": body.hex()})
        at += 2 + size
    whole = out["section_length"] + 3
    out["crc32"], out["crc_valid"] = 0, False
    if 4 <= whole <= len(data):
        out["crc32"] = int.from_bytes(data[whole - 4 : whole], "big")
        out["crc_valid"] = crc32_mpeg(data[:whole]) == 0
    return out


def _operation(number: int, body: bytes) -> dict:
    bits, out = Bits(body), {"op_id": number}
    try:
        if number == SPLICE:
            fields = (("insert_type", 8), ("event_id", 32), ("program_id", 16), ("pre_roll_ms", 16), ("tenths", 16), ("avail_num", 8), ("avails_expected", 8))
            out["splice"] = {name: bits.take(n) for name, n in fields} | {"auto_return": bits.take(8) == 1}
        elif number == SEGMENTATION:
            own = {"event_id": bits.take(32), "cancel": bits.take(8) == 1, "tenths": bits.take(16), "upid_type": bits.take(8)}
            upid = bytes(bits.take(8) for _ in range(bits.take(8)))
            text = "".join(chr(c) for c in upid if 32 <= c < 127) if own["upid_type"] in TEXT_UPIDS else ""
            own |= {"upid_hex": upid.hex(), "upid_text": text, "type_id": bits.take(8), "segment_num": bits.take(8), "segments_expected": bits.take(8)}
            out["segmentation"] = own
        else:
            out["raw_hex"] = body.hex()
    except ValueError:
        out["raw_hex"] = body.hex()
    return out


def read_message(data: bytes | None) -> dict | None:
    if data is None:
        return None
    try:
        if len(data) < 6:
            raise ValueError("too short for a message")
        bits = Bits(data)
        first = bits.take(16)
        bits.take(16)
        out: dict = {"ok": True, "multiple": first == MULTIPLE} | {n: bits.take(k) for n, k in (("protocol_version", 8), ("as_index", 8), ("message_number", 8), ("dpi_pid_index", 16))}
        if first != MULTIPLE:
            return out | {"operations": [_operation(first, data[bits.at // 8 :])]}
        bits.take(8)
        out["time_type"] = bits.take(8)
        stamp = TIME_BITS.get(out["time_type"], 0)
        if out["time_type"] == 1:
            out["utc_seconds"] = bits.take(32)
            stamp -= 32
        bits.take(stamp)
        out["operations"] = []
        for _ in range(bits.take(8)):
            if bits.size - bits.at < 32:
                break
            number, length = bits.take(16), bits.take(16)
            at = bits.at // 8
            body = data[at : at + length]
            bits.at += 8 * len(body)
            out["operations"].append(_operation(number, body))
        return out
    except ValueError as e:
        return {"ok": False, "error": str(e)}
