"""The batch readers of sections and messages against the plain ones, on made and on broken bytes."""

import base64
import random

import pyarrow as pa
import pytest
from plain_splice import crc32_mpeg, read_message, read_section
from pyspark.sql import functions as F

from cuelake.functions import bitfields, splice
from cuelake.sources import scte104
from test_splice import INSERT, MPU, SCHEDULE, TIME_SIGNAL, TWO

PUBLISHED = [base64.b64decode(x) for x in (INSERT, MPU, SCHEDULE, TIME_SIGNAL, TWO)]


def same(plain, full):
    """Equal, where what the plain reader leaves out is null."""
    if isinstance(full, dict):
        return plain is not None and set(plain) <= set(full) and all(same(plain.get(k), v) for k, v in full.items())
    if isinstance(full, list):
        return plain is not None and len(plain) == len(full) and all(map(same, plain, full))
    return plain == full


def broken(r, data):
    data = bytearray(data)
    for _ in range(r.randrange(0, 6)):
        data[r.randrange(len(data))] = r.getrandbits(8)
    if r.random() < 0.3:
        data = data[: r.randrange(len(data) + 1)]
    if r.random() < 0.3:
        data += r.randbytes(30)
    return bytes(data)


def section(r):
    x = r.random()
    if x < 0.7:
        made = splice.write_section(
            r.getrandbits(32), r.choice((None, r.random() * 1000)), r.random() < 0.5, r.random() < 0.5, r.choice((None, r.getrandbits(33))), r.choice((None, 0x30, 0x34, 0x10, 0x44)), r.choice((0, 1, 3, 8, 12, 13, 15, 16)), r.randbytes(r.choice((0, 3, 8, 16, 40))), r.random() < 0.8
        )
        return made if x < 0.3 else b"\xfc" + broken(r, made)[1:] if x < 0.5 else broken(r, made)
    if x < 0.9:
        made = bytearray(b"\xfc" + r.randbytes(r.randrange(0, 250)))
        if len(made) > 13:
            made[13] = r.choice((4, 4, 5, 6, 0, 255))
            made[11] |= 15 if r.random() < 0.5 else 0
            made[12] = 255 if r.random() < 0.5 else made[12]
        return bytes(made)
    return r.choice((None, b"", b"\xfc", broken(r, r.choice(PUBLISHED)), r.choice(PUBLISHED)))


@pytest.mark.parametrize("seed", range(6))
def test_sections_of_a_batch_are_those_of_one_at_a_time(seed):
    r = random.Random(seed)
    made = [section(r) for _ in range(1500)]
    found = splice.read_sections(pa.array(made, pa.binary())).to_pylist()
    for data, got in zip(made, found, strict=True):
        want = read_section(data)
        assert want is got is None or same(want, got), data
    assert sum(bool(x and x["ok"]) for x in found) > 300 and any(x and x["schedule"] for x in found) and any(x and len(x["descriptors"] or ()) > 1 for x in found)


def message(r):
    if r.random() < 0.1:
        return r.choice((None, b"", b"\xff\xff\0", r.randbytes(20)))
    ops = b""
    many = r.randrange(0, 5)
    for _ in range(many):
        number = r.choice((0x0101, 0x0107, 0x0104, 0x9999))
        body = r.randbytes(r.choice((14, 14, 3, 40)))
        if number == 0x0107 and r.random() < 0.8:
            upid = r.randbytes(r.randrange(0, 20))
            body = r.randbytes(4) + b"\1" + r.randbytes(2) + bytes((r.choice((3, 8)), len(upid))) + upid + r.randbytes(3)
        ops += number.to_bytes(2, "big") + len(body).to_bytes(2, "big") + body
    kind = r.randrange(0, 5)
    if r.random() < 0.2:
        return r.choice((b"\1\1", b"\1\7", b"\0\0")) + bytes(7) + r.randbytes(r.randrange(0, 30))
    made = b"\xff\xff" + r.randbytes(2) + r.randbytes(5) + b"\0" + bytes((kind,)) + r.randbytes({1: 7, 2: 4, 3: 2}.get(kind, 0)) + bytes((many,)) + ops
    return made if r.random() < 0.6 else broken(r, made)


@pytest.mark.parametrize("seed", range(4))
def test_messages_of_a_batch_are_those_of_one_at_a_time(seed):
    r = random.Random(seed)
    made = [message(r) for _ in range(1500)]
    found = scte104.read_messages(pa.array(made, pa.binary())).to_pylist()
    for data, got in zip(made, found, strict=True):
        want = read_message(data)
        assert want is got is None or same(want, got), data
    assert sum(bool(x and x["ok"]) for x in found) > 800 and any(o["segmentation"] for x in found if x and x["ok"] for o in x["operations"])


def test_slices_empty_batches_and_strings():
    made = pa.array([None, *PUBLISHED, b"x"], pa.binary())
    whole = splice.read_sections(made).to_pylist()
    assert splice.read_sections(made.slice(2, 3)).to_pylist() == whole[2:5]
    assert splice.read_sections(made.slice(0, 0)).to_pylist() == [] and splice.read_sections(pa.array([None, None], pa.binary())).to_pylist() == [None, None]
    assert scte104.read_messages(made.slice(0, 0)).to_pylist() == []
    assert str(splice.read_sections(made).type) == str(splice.read_sections(made.slice(0, 1)).type)


def test_checksums_by_column():
    r = random.Random(5)
    made = [r.randbytes(r.choice((0, 1, 2, 50, 300))) for _ in range(200)] + PUBLISHED + [None]
    found = splice.crc32_of(pa.array(made, pa.binary())).to_pylist()
    assert found == [None if x is None else crc32_mpeg(x) for x in made] and found[200:205] == [0] * 5


def test_a_section_of_very_many_descriptors():
    body = b"\0" * 11 + b"\xff\xff" + (20_000).to_bytes(2, "big") + b"\1\0" * 10_000
    found = splice.read_section(b"\xfc\0\0" + body[:8] + b"\xff\xff\xff\0" + body[13:])
    assert found["ok"] in (True, False)


def test_cursors_stop_at_the_end_of_their_piece():
    import numpy as np

    data = bitfields.Bytes(pa.array([b"\xff", b"\xff\xff\xff", None], pa.binary()))
    bits, every = bitfields.Cursors(data.flat, data.begin, data.size), np.ones(3, bool)
    assert bits.take(8, every).tolist() == [255, 255, 0] and bits.good.tolist() == [True, True, False]
    assert bits.take(12, every).tolist() == [0, 4095, 0] and bits.good.tolist() == [False, True, False] and bits.left()[1] == 4


def test_decoding_in_sql(spark):
    splice.register(spark)
    row = spark.sql(f"select decode_scte35(unbase64('{INSERT}')) s, crc32_mpeg(unbase64('{INSERT}')) c, decode_scte35(cast(null as binary)) n").first()
    assert row["s"]["splice_insert"]["event_id"] == 0x4800008F and row["c"] == 0 and row["n"] is None
    none = spark.createDataFrame([], "b binary").select(splice.decode_bytes(F.col("b")).alias("s"))
    assert none.count() == 0 and none.schema["s"].dataType.simpleString().startswith("struct<ok:boolean")
