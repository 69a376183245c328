"""Values that lie exactly on a limit, times that wrap, and work that has to be cheap for every row."""

import time

from pyspark.sql import functions as F

from cuelake.functions import splice
from cuelake.plans import hls
from cuelake.sources import landed


def _media(before, inside, signalled):
    segments = lambda xs: "".join(f"#EXTINF:{x},\ns.ts\n" for x in xs)
    return f"#EXTM3U\n#EXT-X-TARGETDURATION:100\n{segments(before)}#EXT-X-CUE-OUT:{signalled}\n{segments(inside)}#EXT-X-CUE-IN\n{segments([9])}#EXT-X-ENDLIST"


def test_a_break_that_is_off_by_exactly_what_is_allowed_is_not_told(spark):
    start, end = 10.2 + 3.78, 10.2 + 3.78 + 78.5 + 50.29
    assert end - start - 78.79 > 50  # in binary fractions
    own = hls.analyse(landed.pasted(spark, {"on": _media([10.2, 3.78], [78.5, 50.29], 78.79), "over": _media([10.2, 3.78], [78.5, 50.3], 78.79)}))
    assert [x["doc_id"] for x in own.coded.where("code = 'BREAK_OVERRUN'").collect()] == ["over"]
    own.release()


def test_renditions_apart_by_exactly_what_is_allowed(spark):
    assert 34.45 - 31.45 > 3 and 32.02 - 31.52 > 0.5  # in binary fractions
    stats = spark.createDataFrame([(d, None, None, None, "CUE-OUT") for d in "abc"], "doc_id string, window_start_pdt double, window_end_pdt double, target_duration double, style string")
    renditions = spark.createDataFrame([("s", d, k) for k, d in enumerate("abc")], "stream_id string, doc_id string, ordinal int")
    break_ = lambda d, at, length: (d, 0, at, None, length, None, True, False)
    breaks = spark.createDataFrame(
        [break_("a", 31.45, 31.52), break_("b", 34.45, 32.02), break_("c", 31.45, 31.02)],
        "doc_id string, index int, start_time double, pdt double, actual_duration double, signalled_duration double, closed boolean, window_clipped boolean",
    )
    found = sorted(x["code"] for x in hls.compare_renditions(renditions, breaks, stats).collect())
    assert found == ["VARIANT_BREAK_MISALIGNED"]  # that of b: 3 s are near enough, half a second is none


def test_a_time_of_33_bits_is_unwrapped_by_a_clock(spark):
    from cuelake.plans.routed import segmentation_roundtrip

    ids = [0, 95_443, 95_444, 600_000, 59_999_999]
    rows = spark.createDataFrame([(i, "view", 1.5) for i in ids], "event_id long, event_type string, value double")
    folder = landed_events(rows)
    found = {x["event_id"]: x["pts_time"] for x in segmentation_roundtrip(spark, folder).collect()}
    assert found == {i: i * splice.TICKS for i in ids}


def landed_events(rows):
    import tempfile

    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    rows.write.parquet(f"{folder}/events.parquet")
    return folder


def test_sections_are_written_in_microseconds():
    begun = time.perf_counter()
    for k in range(5000):
        splice.write_section(k, 30.0)
    assert time.perf_counter() - begun < 2  # 4.6 s when each CRC made arrays of its own
    assert splice.crc32_mpeg(b"123456789") == 0x0376E6E7


def test_clock_of_unwrapping_may_lie_to_either_side(spark):
    at = 7 * (1 << 33) + 5
    row = spark.range(1).select(*[splice.unwrapped(F.lit(5).cast("long"), F.lit(at + d).cast("long")).alias(n) for n, d in (("early", -1000), ("late", 1000))]).first()
    assert row["early"] == row["late"] == at


def test_cues_of_many_segments_leave_a_task_together():
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    from cuelake.sources import segments

    def boxed(i):
        body = b"\0\0\0\0urn:scte:scte35:2013:bin\0\0" + b"".join(x.to_bytes(4, "big") for x in (1000, 0, 0, i)) + splice.write_section(i, 30.0)
        return (len(body) + 8).to_bytes(4, "big") + b"emsg" + body

    files = pa.RecordBatch.from_pylist([{"uri": str(k), "content": boxed(k)} for k in range(7000)] + [{"uri": "none", "content": None}])
    found = [*segments.found_in(iter([files]), to_arrow_schema(StructType.fromDDL(segments.CUES)))]
    assert [x.num_rows for x in found] == [5000, 2000]
    assert [(x["uri"], x["emsg_id"], x["carriage"], x["anchor"]) for x in found[1].slice(0, 1).to_pylist()] == [("5000", 5000, "emsg", None)]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_duration_is_matched_twice_at_most(spark):
    from cuelake.functions.text import iso_duration

    texts = {"PT1H2M3.5S": 3723.5, "-P1DT1S": -86401.0, "P1Y2M": 36_720_000.0, "P": 0.0, "PT1.2.3S": 0.0, "PT": 0.0, "5": None, "PT5S\n": 5.0, None: None, "PT1S,": None}
    found = spark.createDataFrame([(x,) for x in texts], "x string").select("x", iso_duration(F.col("x")).alias("s"))
    assert {r["x"]: r["s"] for r in found.collect()} == texts
    assert _plan(found).count(r"^(-)?P") <= 4  # 2, or as many again where a condition is repeated


def test_a_response_is_parsed_once_for_its_totals(spark):
    from cuelake.plans import vast

    linear = lambda t: f"<Creative><Linear><Duration>{t}</Duration></Linear></Creative>"
    ad = lambda body: f"<Ad><InLine><Creatives>{body}</Creatives></InLine></Ad>"
    bodies = {
        "two": ad(linear("00:00:10") + linear("00:01:00.5")) + "<Ad><Wrapper><VASTAdTagURI>u</VASTAdTagURI></Wrapper></Ad>", "odd": ad(linear("x") + "<Creative><NonLinearAds/></Creative>") + ad(linear("7")),
        "empty": "", "bare": "<Ad/>", "none": "<Ad><InLine/></Ad>",
    }
    docs = spark.createDataFrame([(k, f'<VAST version="4.0">{v}</VAST>') for k, v in bodies.items()] + [("other", "<x/>")], "doc_id string, body string")
    found = vast.totals(docs)
    assert {x["doc_id"]: tuple(x)[1:] for x in found.collect()} == {"two": (2, 1, 70.5), "odd": (2, 0, 7.0), "empty": (0, 0, 0.0), "bare": (1, 0, 0.0), "none": (1, 0, 0.0)}
    assert _plan(found).count("from_xml") + _plan(found).count("xmltostructs") <= 1


def test_fingerprints_of_a_block_take_bounded_memory():
    import tracemalloc

    from cuelake.llm import phrases

    text = b"word other third, " * (phrases.TEXT_BYTES // 18)
    tracemalloc.start()
    runs = phrases.Runs([text], ["x"])
    runs.of(2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 50e6  # 39 MB; 79 MB with blocks of 2 MB
