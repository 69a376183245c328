import base64

import pytest
from pyspark.sql import functions as F

from cuelake.functions.splice import write_section
from cuelake.plans import dash, vast
from cuelake.sources import landed
from cuelake.sources.dash import timeline_segments


def binary(**given):
    return base64.b64encode(write_section(**given)).decode()


def event(payload, scheme="urn:scte:scte35:2014:xml+bin", attrs='id="1"'):
    return f'<EventStream schemeIdUri="{scheme}" timescale="1000"><Event {attrs}><s:Signal><s:Binary>{payload}</s:Binary></s:Signal></Event></EventStream>'


def period(name, start, seconds, inner="", kind="v1", pto=None, first=None, extra=""):
    pto = start if pto is None else pto
    return (
        f'<Period id="{name}" start="PT{start}S" {extra}>{inner}<AdaptationSet mimeType="video/mp4"><SegmentTemplate timescale="10" presentationTimeOffset="{int(pto * 10)}" media="$Time$.m4s">'
        f'<SegmentTimeline><S t="{int((start if first is None else first) * 10)}" d="20" r="{seconds // 2 - 1}"/></SegmentTimeline></SegmentTemplate><Representation id="{kind}" codecs="avc1.{kind}" width="10"/></AdaptationSet></Period>'
    )


def mpd(*periods, head='type="dynamic" availabilityStartTime="2026-01-01T00:00:00Z" minimumUpdatePeriod="PT2S"'):
    return f'<?xml version="1.0"?><MPD xmlns="urn:mpeg:dash:schema:mpd:2011" xmlns:s="urn:x" xmlns:xlink="urn:l" {head}>{"".join(periods)}</MPD>'


START, END = binary(event_id=5, seconds=20, type_id=0x30), binary(event_id=5, type_id=0x31)
MPDS = {
    "good": mpd(period("a", 0, 20), period("b", 20, 20, event(START)), period("c", 40, 20, event(END))),
    "gap": mpd(period("a", 0, 20), period("a", 21, 20), period("c", 38, 20, kind="x")),
    "pto": mpd(period("a", 0, 20, pto=3), period("b", 20, 20, first=25)),
    "static": mpd(period("a", 0, 20), period("b", 20, 20, event(binary(event_id=7, type_id=0x30))), period("c", 40, 20), head='type="static"'),
    "twice": mpd(period("a", 0, 20, event(START) + event(START, "urn:scte:scte35:2013:xml")), period("b", 20, 20, event("bm90LXNjdGUtMzUtYXQtYWxs", attrs=""))),
    "short": mpd(period("a", 0, 20, event(START)), period("b", 20, 20, event(END)), head='type="dynamic"'),
    "remote": mpd(period("a", 0, 20), '<Period id="r" start="PT20S" xlink:href="http://x"/>'),
    "none": mpd(),
    "orphan": mpd(period("a", 0, 20), period("b", 20, 20, event(END))),
}


@pytest.fixture(scope="module")
def analysis(spark):
    found = dash.analyse(landed.pasted(spark, MPDS | {"html": "<html></html>"}))
    codes = {}
    for row in found.findings.collect():
        codes.setdefault(row["doc_id"], set()).add((row["code"], row["severity"]))
    return found, codes


def test_break_of_a_clean_manifest(analysis):
    found, codes = analysis
    row = found.breaks.where("doc_id = 'good'").collect()
    assert len(row) == 1 and (row[0]["start_time"], row[0]["actual_duration"], row[0]["signalled_duration"], row[0]["bounded_by"]) == (20.0, 20.0, 20.0, "end event")
    assert {c for c, _ in codes["good"]} == {"NO_ASSET_IDENTIFIER", "NO_PERIOD_CONTINUITY_SIGNAL"}
    stats = found.stats.where("doc_id = 'good'").first()
    assert (stats["segment_count"], stats["window_duration"], round(stats["ad_percent"], 3)) == (30, 60.0, 33.333)
    assert timeline_segments(found.sets).where("doc_id = 'good' and period_index = 1").count() == 10


@pytest.mark.parametrize(
    ("name", "code", "severity"),
    [
        ("gap", "PERIOD_TIMELINE_GAP", "error"), ("gap", "PERIOD_TIMELINE_OVERLAP", "error"), ("gap", "DUPLICATE_PERIOD_ID", "error"), ("gap", "REPRESENTATION_SET_CHANGED", "error"),
        ("pto", "PTO_MISMATCH", "error"), ("pto", "PERIOD_MEDIA_STARTS_LATE", "warning"), ("static", "UNCLOSED_BREAK", "error"), ("twice", "DUPLICATE_EVENT_STREAMS", "info"),
        ("twice", "SCTE35_DECODE_FAILED", "error"), ("twice", "EVENT_MISSING_ID", "warning"), ("short", "DYNAMIC_NO_MUP", "error"), ("short", "DYNAMIC_NO_AST", "error"),
        ("remote", "XLINK_NO_DURATION", "error"), ("remote", "XLINK_NO_ACTUATE", "warning"), ("remote", "XLINK_REMOTE_PERIOD", "info"), ("none", "NO_PERIODS", "error"), ("orphan", "ORPHAN_BREAK_END", "warning"),
    ],
)
def test_defects(analysis, name, code, severity):
    assert (code, severity) in analysis[1][name]


def test_quiet_where_nothing_is_wrong(analysis):
    codes = {k: {c for c, _ in v} for k, v in analysis[1].items()}
    assert "PTO_MISMATCH" not in codes["gap"] and "ORPHAN_BREAK_END" not in codes["good"] and "html" not in codes
    assert "EMPTY_PERIOD" not in codes["remote"]


EVENTS = "".join(f'<Tracking event="{e}">u</Tracking>' for e in vast.TRACKING)
MEDIA = '<MediaFile type="video/mp4" codec="avc1.4d" bitrate="2500">http://m</MediaFile>'


def response(media=MEDIA, events=EVENTS, duration="<Duration>00:00:30</Duration>", impression="<Impression>i</Impression>", error="<Error>e</Error>"):
    return f'<VAST version="4.0"><Ad id="1"><InLine>{impression}{error}<Creatives><Creative id="c"><Linear>{duration}<TrackingEvents>{events}</TrackingEvents><MediaFiles>{media}</MediaFiles></Linear></Creative></Creatives></InLine></Ad></VAST>'


def wrapper(uri):
    return f'<VAST version="3.0"><Ad id="w"><Wrapper><VASTAdTagURI><![CDATA[{uri}]]></VASTAdTagURI></Wrapper></Ad></VAST>'


def test_vast_rules(spark):
    texts = {
        "good": response(), "empty": '<VAST version="3.0"></VAST>', "bare": response(media="", events="", duration="", impression="", error=""), "some": response(events='<Tracking event="start">u</Tracking>'),
        "run": response(media='<MediaFile type="application/javascript" apiFramework="VPAID">u</MediaFile>'), "odd": response(media='<MediaFile type="video/webm">u</MediaFile>'), "wrap": wrapper(""), "html": "<html/>",
    }
    rows = vast.findings(landed.pasted(spark, texts), spark.createDataFrame([("good", ["avc1.64", "mp4a.40"], [3e6], 30.0, True), ("some", ["hvc1.1"], [1e6], 15.0, True)], vast.PROFILE)).collect()
    codes = {}
    for row in rows:
        codes.setdefault(row["doc_id"], set()).add(row["code"])
    assert "good" not in codes and "html" not in codes
    assert codes["empty"] == {"VAST_NO_FILL"}
    assert codes["bare"] == {"VAST_NO_IMPRESSION", "VAST_NO_ERROR_URL", "VAST_NO_DURATION", "VAST_NO_TRACKING", "VAST_NO_MEDIA_FILE"}
    assert codes["some"] == {"VAST_INCOMPLETE_TRACKING", "VAST_CODEC_MISMATCH", "VAST_BITRATE_ABOVE_LADDER", "VAST_POD_OVERRUNS_AVAIL"}
    assert codes["run"] == {"VAST_EXECUTABLE_CREATIVE"} and codes["odd"] == {"VAST_NO_STITCHABLE_MEDIA"} and codes["wrap"] == {"VAST_WRAPPER_NO_URI"}
    total = {x["doc_id"]: (x["ads"], x["seconds"]) for x in vast.totals(landed.pasted(spark, texts)).collect()}
    assert total["good"] == (1, 30.0) and total["empty"] == (0, 0.0)


def test_wrapper_chains(spark):
    docs = landed.pasted(spark, {"ok": wrapper("u1"), "loop": wrapper("l1"), "lost": wrapper("x"), "text": wrapper("t"), "deep": wrapper("d1")})
    fetched = [("u1", True, wrapper("u2"), 1500.0), ("u2", True, response(), 900.0), ("l1", True, wrapper("l2"), 1.0), ("l2", True, wrapper("l1"), 1.0), ("t", True, "<html/>", 1.0)]
    fetched += [(f"d{k}", True, wrapper(f"d{k + 1}"), 1.0) for k in range(1, 9)]
    hops, found = vast.wrapper_chains(docs, spark.createDataFrame(fetched, "url string, ok boolean, body string, ms double"))
    codes = {}
    for row in found.collect():
        codes.setdefault(row["doc_id"], set()).add(row["code"])
    assert codes == {"ok": {"VAST_CHAIN_SLOW"}, "loop": {"VAST_WRAPPER_LOOP"}, "lost": {"VAST_WRAPPER_UNRESOLVED"}, "text": {"VAST_WRAPPER_UNPARSEABLE"}, "deep": {"VAST_WRAPPER_TOO_DEEP"}}
    assert {(x["doc_id"], x["depth"]) for x in hops.where("doc_id in ('ok', 'deep')").collect()} == {("ok", 1), ("ok", 2), *(("deep", k) for k in range(1, 6))}


def test_schedules(spark):
    brk = lambda attrs, inner="<v:AdSource><v:AdTagURI>u</v:AdTagURI></v:AdSource>": f'<v:AdBreak breakType="linear" {attrs}>{inner}</v:AdBreak>'
    vmap = lambda *b: f'<v:VMAP xmlns:v="urn:v" version="1.0">{"".join(b)}</v:VMAP>'
    texts = {"good": vmap(brk('timeOffset="start"'), brk('timeOffset="00:10:00"')), "none": vmap(), "odd": vmap(brk(""), brk('timeOffset="end"', ""), brk('timeOffset="end"'))}
    codes = {}
    for row in vast.schedule_findings(landed.pasted(spark, texts)).collect():
        codes.setdefault(row["doc_id"], set()).add(row["code"])
    assert codes == {"none": {"VMAP_NO_BREAKS"}, "odd": {"VMAP_NO_TIME_OFFSET", "VMAP_NO_AD_SOURCE", "VMAP_DUPLICATE_OFFSET"}}


def test_manifests_are_written_and_not_held_in_memory(spark):
    """Parsed manifests take more memory than executors have; they are parsed once and given up by ``release``."""
    read = spark.sparkContext.accumulator(0)

    def counted(body):
        read.add(1)
        return body

    docs = landed.pasted(spark, {"d": mpd(period("a", 0, 20))}).withColumn("body", F.udf(counted, "string").asNondeterministic()("body"))
    own = dash.analyse(docs)
    assert not own.parsed.is_cached and own.coded.count() >= 0 and own.periods.count() == 1 and read.value == 1
    own.release()


def test_tables_that_grow_with_manifests_are_not_broadcast(spark, monkeypatch):
    """Files of many alike manifests are a small part of their rows in memory: a join by their size would send all to the driver."""
    plans, written = [], dash.DashAnalysis._written

    def noted(self, table):
        plans.append(table._jdf.queryExecution().executedPlan().toString())
        return written(self, table)

    monkeypatch.setattr(dash.DashAnalysis, "_written", noted)
    one = mpd(period("p", 0, 4, event(binary(event_id=1, seconds=2.0), attrs='id="1" presentationTime="1000"')), period("q", 4, 4))
    own = dash.analyse(spark.range(300).select(F.col("id").alias("doc_id"), F.lit(one).alias("body")))
    assert own.coded.where("code = 'NO_ASSET_IDENTIFIER'").count() == 300 and own.breaks.where("mup = 2 and period_count = 2 and period_length = 4 and live").count() == 300
    sent = []
    for plan in plans:
        below = None
        for line in plan.split("\n"):
            if "BroadcastExchange" in line:
                below = True
            elif below and ("Scan" in line or "Exchange" in line):
                sent += [line] if "Scan" in line else []  # a table as it is written; behind an exchange Spark knows the rows' size
                below = None
    assert not sent
    own.release()
