import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cuelake.functions import splice

TIME_SIGNAL = "/DA0AAAAAAAA///wBQb+cr0AUAAeAhxDVUVJSAAAjn/PAAGlmbAICAAAAAAsoKGKNAIAmsnRfg=="
INSERT = "/DAvAAAAAAAA///wFAVIAACPf+/+c2nALv4AUsz1AAAAAAAKAAhDVUVJAAABNWLbowo="
TWO = "/DBIAAAAAAAA///wBQb+ek2ItgAyAhdDVUVJSAAAGH+fCAgAAAAALMvDRBEAAAIXQ1VFSUgAABl/nwgIAAAAACyk26AQAACZcuND"
MPU = "/DBSAAAAAAAAAP/wBQb+E0/ZAAA8AjpDVUVJAAdTe3//AAApMuAMJlRFU1R7InBvZCI6IjIvNSIsImFzc2V0IjoicHJvbW8tMTE4NyJ9MAAALWdtNA=="
SCHEDULE = "/DA4AAAAAAAA///wJwQCAAAbWX//azbsgP4Ae5igAAEBAgAAG1p//2s2+pD+AFJlwAABAQIAAByanUQ="
BAD_CRC = "0xFC302000000000000000FFF00F0500E1C2787FFFFE0034BC00C00000000000E4612424"


def read(text):
    return splice.read_section(base64.b64decode(text))


def test_published_sections():
    s = read(TIME_SIGNAL)
    assert s["time_signal"]["pts_time"] == 1924989008 and s["crc_valid"]
    d = s["descriptors"][0]
    assert (d["type_id"], d["event_id"], d["upid_text"], round(d["duration_ticks"] / 90000)) == (0x34, 0x4800008E, "0x000000002ca0a18a", 307)
    i = read(INSERT)["splice_insert"]
    assert (i["event_id"], i["out_of_network"], i["auto_return"]) == (0x4800008F, True, True) and round(i["break_ticks"] / 90000, 3) == 60.294
    assert [d["type_id"] for d in read(TWO)["descriptors"]] == [0x11, 0x10]
    assert read(MPU)["descriptors"][0]["upid_text"] == 'TEST {"pod":"2/5","asset":"promo-1187"}'
    assert len(read(SCHEDULE)["schedule"]) == 2 and read(SCHEDULE)["crc_valid"]
    assert splice.crc32_mpeg(base64.b64decode(INSERT)) == 0


def test_payload_texts(spark):
    rows = spark.createDataFrame([(BAD_CRC,), (f'"{INSERT}"',), ("0xDEADBEEF",), ("bm90LXNjdGUtMzUtYXQtYWxs",), (None,), ("",)], "p string")
    found = [x["s"] for x in rows.select(splice.decode_section(F.col("p")).alias("s")).collect()]
    assert found[0]["ok"] and not found[0]["crc_valid"] and found[0]["splice_insert"]["event_id"] == 14795384
    assert found[1]["crc_valid"]
    assert not found[2]["ok"] and "short" in found[2]["error"]
    assert not found[3]["ok"] and "table_id" in found[3]["error"]
    assert found[4] is None and not found[5]["ok"]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**32 - 1), st.one_of(st.none(), st.floats(0, 90000)), st.booleans(), st.one_of(st.none(), st.integers(0, 2**33 - 1)), st.sampled_from([None, *splice.START_TYPES]), st.binary(max_size=40))
def test_round_trip(event, seconds, out, pts, kind, upid):
    s = splice.read_section(splice.write_section(event, seconds, out, True, pts, kind, 0x0C, upid))
    assert s["ok"] and s["crc_valid"]
    own = s["splice_insert"] if kind is None else s["descriptors"][0]
    assert own["event_id"] == event
    ticks = own.get("break_ticks" if kind is None else "duration_ticks")
    assert ticks == (None if seconds is None else int(seconds * 90000 + 0.5))


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=80))
def test_any_bytes_give_a_row(data):
    assert splice.read_section(b"\xfc" + data)["ok"] in (True, False)


@pytest.mark.parametrize(
    ("kind", "data", "text", "code"),
    [
        (0, b"x", "", "UPID_TYPE_NOT_USED"), (0, b"", "", None), (3, b"", "", "UPID_EMPTY"), (8, b"1234567", "", "UPID_WRONG_LENGTH"), (8, b"12345678", "", None),
        (3, b"ABCD1234567", "ABCD1234567", None), (3, b"abcd", "abcd", "UPID_MALFORMED_ADID"), (15, b"no", "no address", "UPID_MALFORMED_URI"), (15, b"u", "urn:a:b", None),
        (12, b"abcd", "", "UPID_MPU_NO_PRIVATE_DATA"), (12, b"abcde", "", None), (13, b"\x03\x09ab", "", "UPID_MID_TRUNCATED"), (13, b"\x03\x01a", "", None), (13, b"\x03", "", "UPID_MID_EMPTY"),
    ],
)
def test_upid_rules(spark, kind, data, text, code):
    row = spark.createDataFrame([(kind, data.hex(), text)], "k int, h string, t string")
    assert row.select(splice.upid_problem(F.col("k"), F.col("h"), F.col("t"))).first()[0] == code


def test_pts_wraps(spark):
    row = spark.range(1).select(splice.pts_delta(F.lit(5), F.lit(2**33 - 5)), splice.pts_delta(F.lit(2**33 - 5), F.lit(5)))
    assert tuple(row.first()) == (10, -10)
