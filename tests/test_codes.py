"""Each of these codes is found in a document made for it, and not in one like it without the fault."""

import base64

import pytest
from pyspark.sql import functions as F

from cuelake.functions.splice import crc32_mpeg, decode_section, write_section
from cuelake.operators.findings import told
from cuelake.operators.texts import DETAILS
from cuelake.plans import dash, hls, stitching, vast
from cuelake.sources import landed, scte104, segments
from test_dash_vast import event, mpd, period
from test_hls import CUT, IN, OUT, playlist, seg
from test_inband import message, splice_request


def ranged(section, name="a", attrs=""):
    return f'#EXT-X-DATERANGE:ID="{name}",START-DATE="2026-01-01T00:00:06.000Z",SCTE35-OUT=0x{section.hex()}{attrs}'


def encrypted(section):
    body = bytearray(section[:-4])
    body[4] |= 0x80
    return bytes(body) + crc32_mpeg(bytes(body)).to_bytes(4, "big")


def between(name, attrs):
    return f'#EXT-X-DATERANGE:ID="{name}",CLASS="com.apple.hls.interstitial",START-DATE="2026-01-01T00:00:00.000Z",{attrs}'


PLAIN = write_section(1, 12.0)
AFTER = [seg("b1.ts"), seg("b2.ts"), IN, seg("a3.ts")]
HLS = {
    "NO_AUTO_RETURN_NO_CUE_IN": (playlist(seg("a.ts"), ranged(write_section(1, 12.0, auto_return=False)), seg("b.ts")), playlist(seg("a.ts"), ranged(PLAIN), seg("b.ts"))),
    "SPLICE_IMMEDIATE": (playlist(seg("a.ts"), ranged(PLAIN), *AFTER), playlist(seg("a.ts"), ranged(write_section(1, 12.0, pts=9)), *AFTER)),
    "SCTE35_CRC_INVALID": (playlist(seg("a.ts"), ranged(write_section(1, 12.0, valid_crc=False)), *AFTER), playlist(seg("a.ts"), ranged(PLAIN), *AFTER)),
    "SCTE35_ENCRYPTED": (playlist(seg("a.ts"), ranged(encrypted(PLAIN)), *AFTER), playlist(seg("a.ts"), ranged(PLAIN), *AFTER)),
    "SIGNAL_DURATION_DISAGREEMENT": (playlist(seg("a.ts"), ranged(PLAIN, attrs=",PLANNED-DURATION=20"), *AFTER), playlist(seg("a.ts"), ranged(PLAIN, attrs=",PLANNED-DURATION=12.2"), *AFTER)),
    "EVENT_ID_REUSED": (playlist(seg("a.ts"), ranged(PLAIN), *AFTER, ranged(PLAIN, "b"), *AFTER), playlist(seg("a.ts"), ranged(PLAIN), *AFTER, ranged(write_section(2, 12.0), "b"), *AFTER)),
    "UNPAIRED_SEGMENTATION_TYPE": (
        playlist(seg("a.ts"), ranged(write_section(1, 12.0, type_id=0x34)), *AFTER),
        playlist(seg("a.ts"), ranged(write_section(1, 12.0, type_id=0x34)), seg("b1.ts"), f'#EXT-X-DATERANGE:ID="a",START-DATE="2026-01-01T00:00:12.000Z",SCTE35-IN=0x{write_section(1, type_id=0x35).hex()}', seg("a3.ts")),
    ),
    "NO_DISCONTINUITY_AT_BREAK_START": (playlist(seg("a.ts"), CUT, seg("a1.ts"), OUT, *AFTER), playlist(seg("a.ts"), OUT, CUT, *AFTER)),
    "NO_DISCONTINUITY_AT_BREAK_END": (playlist(seg("a.ts"), OUT, CUT, *AFTER), playlist(seg("a.ts"), OUT, CUT, *AFTER[:3], CUT, AFTER[3])),
    "INTERSTITIAL_AMBIGUOUS_ASSET": (playlist(between("i", 'X-ASSET-URI="u",X-ASSET-LIST="l"'), seg("a.ts")), playlist(between("i", 'X-ASSET-URI="u",DURATION=5'), seg("a.ts"))),
    "INTERSTITIAL_UNBOUNDED": (playlist(between("i", 'X-ASSET-URI="u"'), seg("a.ts")), playlist(between("i", 'X-ASSET-LIST="l"'), seg("a.ts"))),
    "INTERSTITIAL_SIGNALLING": (playlist(between("i", 'X-ASSET-LIST="l"'), seg("a.ts")), playlist(seg("a.ts"))),
    "INTERSTITIAL_OVERLAP": (playlist(between("i", 'X-ASSET-URI="u",DURATION=20'), seg("a.ts"), between("j", 'X-ASSET-URI="u",DURATION=5'), seg("b.ts")), playlist(between("i", 'X-ASSET-URI="u",DURATION=6'), seg("a.ts"), between("j", 'X-ASSET-URI="u",DURATION=5'), seg("b.ts"))),
    "LL_NO_SERVER_CONTROL": (playlist('#EXT-X-PART:DURATION=0.5,URI="p"', seg("a.ts"), end=False), playlist("#EXT-X-SERVER-CONTROL:CAN-BLOCK-RELOAD=YES", '#EXT-X-PART:DURATION=0.5,URI="p"', seg("a.ts"), end=False)),
    "LL_NO_RENDITION_REPORT": (playlist('#EXT-X-PART:DURATION=0.5,URI="p"', seg("a.ts"), end=False), playlist('#EXT-X-PART:DURATION=0.5,URI="p"', seg("a.ts"), '#EXT-X-RENDITION-REPORT:URI="r"', end=False)),
}


def found_codes(rows, key="doc_id"):
    codes = {}
    for x in rows.collect():
        codes.setdefault(x[key], set()).add(x["code"])
    return codes


def checked(codes, cases):
    for code in cases:
        assert code in codes.get(f"{code}+", set()), code
        assert code not in codes.get(f"{code}-", set()), code


def both(spark, cases):
    return landed.pasted(spark, {f"{k}{sign}": body for k, pair in cases.items() for sign, body in zip("+-", pair, strict=True)})


def test_codes_of_playlists(spark):
    own = hls.analyse(both(spark, HLS))
    rows = own.findings
    checked(found_codes(rows), HLS)
    assert rows.where("detail is null or title is null").count() == 0
    own.release()


def sets(start, seconds, inner="", attrs="", kind="video", d=20):
    return f'<AdaptationSet mimeType="{kind}/mp4">{inner}<SegmentTemplate timescale="10" presentationTimeOffset="{start * 10}" {attrs}><SegmentTimeline><S t="{start * 10}" d="{d}" r="{seconds * 10 // d - 1}"/></SegmentTimeline></SegmentTemplate><Representation id="v" codecs="avc1"/></AdaptationSet>'


def bare(name, start, *inner, extra=""):
    return f'<Period id="{name}" start="PT{start}S" {extra}>{"".join(inner)}</Period>'


def latency(ms, *periods, head=""):
    return mpd(f'<ServiceDescription><Latency target="{ms}"/></ServiceDescription>', *periods, head=f'type="dynamic" availabilityStartTime="2026-01-01T00:00:00Z" minimumUpdatePeriod="PT2S" {head}')


def payload(**given):
    return base64.b64encode(write_section(**given)).decode()


def timed(*times):
    return '<EventStream schemeIdUri="urn:scte:scte35:2014:xml+bin" timescale="1">' + "".join(f"<Event id=\"{k}\" {t}><s:Signal><s:Binary>{payload(event_id=k, seconds=5)}</s:Binary></s:Signal></Event>" for k, t in enumerate(times)) + "</EventStream>"


START, END = payload(event_id=5, seconds=20, type_id=0x30), payload(event_id=5, type_id=0x31)
BREAK = (period("a", 0, 20), period("b", 20, 20, event(START)), period("c", 40, 20, event(END)))
LIVE = 'type="dynamic" availabilityStartTime="2026-01-01T00:00:00Z" '
INBAND = '<InbandEventStream schemeIdUri="urn:scte:scte35:2013:bin"/>'
CHUNKED = 'availabilityTimeOffset="1.5" availabilityTimeComplete="false"'
DASH = {
    "AV_DURATION_SKEW": (mpd(bare("a", 0, sets(0, 20), sets(0, 18, kind="audio")), period("b", 20, 20)), mpd(bare("a", 0, sets(0, 20), sets(0, 20, kind="audio")), period("b", 20, 20))),
    "EVENT_AMBIGUOUS_TIME": (mpd(period("a", 0, 20, timed("", ""))), mpd(period("a", 0, 20, timed("", 'presentationTime="5"')))),
    "INBAND_EVENT_STREAM_DECLARED": (mpd(bare("a", 0, sets(0, 20, INBAND))), mpd(bare("a", 0, sets(0, 20)))),
    "LL_DASH_NO_LATENCY_TARGET": (mpd(bare("a", 0, sets(0, 20, attrs=CHUNKED))), latency(3000, bare("a", 0, sets(0, 20, attrs=CHUNKED)))),
    "LL_DASH_TARGET_UNREACHABLE": (latency(1000, bare("a", 0, sets(0, 20))), latency(3000, bare("a", 0, sets(0, 20)))),
    "LL_DASH_DELAY_DISAGREEMENT": (latency(3000, bare("a", 0, sets(0, 20)), head='suggestedPresentationDelay="PT10S"'), latency(3000, bare("a", 0, sets(0, 20)), head='suggestedPresentationDelay="PT3S"')),
    "LL_DASH_EARLY_AVAILABILITY_WITHOUT_CHUNKING": (latency(3000, bare("a", 0, sets(0, 20, attrs='availabilityTimeOffset="1.5"'))), latency(3000, bare("a", 0, sets(0, 20, attrs=CHUNKED)))),
    "MUP_LONGER_THAN_SHORTEST_BREAK": (mpd(*BREAK, head=LIVE + 'minimumUpdatePeriod="PT30S"'), mpd(*BREAK)),
    "PERIOD_TRIMMED_AT_WINDOW": (mpd(period("a", 0, 20, pto=0, first=5), period("b", 25, 20), head=LIVE + 'minimumUpdatePeriod="PT2S" timeShiftBufferDepth="PT60S"'), mpd(period("a", 0, 20), period("b", 20, 20), head=LIVE + 'minimumUpdatePeriod="PT2S" timeShiftBufferDepth="PT60S"')),
    "XLINK_ONLOAD_ON_LIVE": (mpd(period("a", 0, 20), '<Period id="r" start="PT20S" xlink:href="http://x" xlink:actuate="onLoad"/>'), mpd(period("a", 0, 20), '<Period id="r" start="PT20S" xlink:href="http://x" xlink:actuate="onLoad"/>', head='type="static"')),
}


def test_codes_of_manifests(spark):
    own = dash.analyse(both(spark, DASH))
    checked(found_codes(own.findings), DASH)
    own.release()


def test_codes_of_pairs_and_renditions(spark):
    signal = f"#EXT-OATCLS-SCTE35:{base64.b64encode(PLAIN).decode()}"
    one = playlist(seg("a.ts"), OUT, *AFTER)
    docs = {
        "feed": one, "later": one.replace("2026-01-01", "2026-02-01"), "timeless": one.replace("#EXT-X-PROGRAM-DATE-TIME:2026-01-01T00:00:00.000Z\n", ""), "signals": playlist(seg("a.ts"), signal, *AFTER),
    }
    own = hls.analyse(landed.pasted(spark, docs))
    pairs = spark.createDataFrame([("same", "feed", "feed"), ("apart", "feed", "later"), ("clock", "feed", "timeless"), ("through", "feed", "signals")], "pair_id string, source_id string, output_id string")
    codes = found_codes(stitching.compare(pairs, own.breaks, own.stats, own.segments).findings, "pair_id")
    assert {k for k, x in codes.items() if "NO_OVERLAPPING_WINDOW" in x} == {"apart"} and {k for k, x in codes.items() if "NO_COMMON_CLOCK" in x} == {"clock"}
    assert {k for k, x in codes.items() if "SIGNAL_PASSED_THROUGH" in x} == {"through"}
    streams = spark.createDataFrame([("same", "feed", 0), ("same", "feed", 1), ("apart", "feed", 0), ("apart", "later", 1)], "stream_id string, doc_id string, ordinal int")
    codes = found_codes(hls.compare_renditions(streams, own.breaks, own.stats), "stream_id")
    assert {k for k, x in codes.items() if "NO_COMMON_WINDOW" in x} == {"apart"}
    own.release()


def test_codes_of_requests(spark):
    segment = bytes.fromhex("0107000f") + (7).to_bytes(4, "big") + b"\0" + (300).to_bytes(2, "big") + b"\x08\0" + b"\x30\1\1" + b"\0" * 3
    null = "/DARAAAAAAAAAP/wAAAAAHpPv/8="
    rows = [("gone", message(splice_request()), null), ("id", message(segment), "0x" + write_section(8, 30.0, type_id=0x30).hex()), ("type", message(segment), "0x" + write_section(7, 30.0, type_id=0x34).hex()), ("same", message(segment), "0x" + write_section(7, 30.0, type_id=0x30).hex())]
    frame = scte104.decoded(spark.createDataFrame(rows, "doc_id string, message string, payload string")).withColumn("section", decode_section(F.col("payload")))
    assert found_codes(scte104.compared(frame)) == {"gone": {"S104_NO_SPLICE_EMITTED"}, "id": {"S104_SEGMENTATION_EVENT_ID_CHANGED"}, "type": {"S104_SEGMENTATION_TYPE_CHANGED"}}


def test_codes_of_responses_and_segments(spark):
    ad = '<VAST version="4.0"><Ad id="1"><InLine><Impression>i</Impression><Creatives><Creative><Linear><Duration>00:00:20</Duration><MediaFiles><MediaFile type="video/mp4">u</MediaFile></MediaFiles></Linear></Creative></Creatives></InLine></Ad></VAST>'
    profiles = spark.createDataFrame([("short", None, None, 30.0, True), ("fits", None, None, 20.0, True)], vast.PROFILE)
    codes = found_codes(vast.findings(landed.pasted(spark, {"short": ad, "fits": ad}), profiles))
    assert "VAST_POD_UNDERFILLS_AVAIL" in codes["short"] and "VAST_POD_UNDERFILLS_AVAIL" not in codes.get("fits", set())
    listed = spark.createDataFrame([("d", "u"), ("e", ""), ("f", None)], "doc_id string, uri string")
    assert found_codes(segments.addressable(listed, listed)) == {"e": {"SEGMENTS_NOT_ADDRESSABLE"}, "f": {"SEGMENTS_NOT_ADDRESSABLE"}}


def test_every_code_has_a_meaning(spark):
    rows = spark.createDataFrame([(c, "error", 3, None, 1.5) for c in DETAILS] + [("NO_SUCH_CODE", "info", None, 2, None)], "code string, severity string, line_number int, break_index int, at_time double")
    found = {x["code"]: x for x in told(rows).collect()}
    for code, text in DETAILS.items():
        assert found[code]["detail"] == f"{text} Line 3. At 1.5 s." and found[code]["title"] == code.lower().replace("_", " ")
    assert found["NO_SUCH_CODE"]["detail"] is None


def test_breaks_of_stitched_pairs_are_read_once(spark):
    """Both sides, the clock and the matches come from one reading; what both lack, take and leave is told."""
    read = spark.sparkContext.accumulator(0)

    def counted(name):
        read.add(1)
        return name

    lone = lambda doc, index, at, length, uri: (doc, index, at / 1000, at, None, None, length, length, False, True, [uri], None)
    rows = [lone("s", 0, 0.0, 30.0, "http://s/show1.ts"), lone("s", 1, 90_000.0, 20.0, "http://s/show2.ts"), lone("s", 2, 200_000.0, 10.0, "http://s/show3.ts"), lone("o", 0, 1_000.0, 30.0, "http://o/ad1.ts"), lone("o", 1, 91_000.0, 5.0, "http://o/show9.ts"), lone("o", 2, 300_000.0, 5.0, "http://o/ad2.ts")]
    schema = "doc_id string, index int, start_time double, pdt double, event_id long, segmentation_type int, signalled_duration double, actual_duration double, window_clipped boolean, discontinuity_at_start boolean, media_uris array<string>, signal struct<ok: boolean>"
    breaks = spark.createDataFrame(rows, schema).withColumn("doc_id", F.udf(counted, "string").asNondeterministic()("doc_id"))
    pairs = spark.createDataFrame([("p", "s", "o"), ("q", "none", "empty")], "pair_id string, source_id string, output_id string")
    stats = spark.createDataFrame([(x, 0.0, 1e9) for x in ("s", "o", "none", "empty")], "doc_id string, window_start_pdt double, window_end_pdt double")
    media = spark.createDataFrame([("o", "http://o/show1.ts")], "doc_id string, uri string")
    own = stitching.compare(pairs, breaks, stats, media)
    avails = {(x["status"], x["index"], x["pdt"], x["alignment"], x["stitched"], x["signalled"]) for x in own.avails.collect()}
    assert avails == {("filled", 0, 0.0, 1.0, 30.0, 30.0), ("passthrough", 1, 90_000.0, 1.0, 5.0, 20.0), ("not-stitched", 2, 200_000.0, None, None, 10.0), ("unsignalled", 2, 300_000.0, None, 5.0, None)}
    assert found_codes(own.findings, "pair_id") == {"p": {"STITCH_MISALIGNED", "AVAIL_PASSED_THROUGH", "AVAIL_NOT_STITCHED", "UNSIGNALLED_AVAIL_IN_OUTPUT"}}
    assert {x["pair_id"]: x["signalled"] for x in own.summary.collect()} == {"p": 3, "q": 0}
    assert read.value == len(rows)
    own.release()
