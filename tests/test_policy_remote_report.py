import base64

from pyspark.sql import functions as F

from cuelake.functions.splice import write_section
from cuelake.plans import dash, hls, policy, remote, report
from cuelake.sources import landed, scte224

NOW = 1_767_225_600_000.0  # 2026-01-01


def signal(kind=0x30, upid=b"ABCD1234567"):
    return base64.b64encode(write_section(1, 30.0, type_id=kind, upid_type=3, upid=upid)).decode()


def point(name, attrs="", inner='<Apply policy="p"/>'):
    return f'<MediaPoint id="{name}" {attrs}>{inner}</MediaPoint>'


def test_policies(spark):
    named = f'<Signal><Binary>{signal()}</Binary></Signal><Apply policy="p"/>'
    text = "".join([
        point("upid", 'expectedDuration="PT20S"', named), point("clock", 'matchTime="2026-01-01T00:01:03Z"'), point("lost", 'matchTime="2026-01-01T09:00:00Z"'),
        point("old", 'expires="2020-01-01T00:00:00Z"'), point("soon", 'effective="2027-01-01T00:00:00Z"'), point("bare", 'matchTime="2026-01-01T08:00:00Z"', ""), point("bad", "", "<Signal><Binary>bm90LXNjdGUtMzUtYXQtYWxs</Binary></Signal><Remove policy='q'/>"),
    ])
    docs = landed.pasted(spark, {"d": f'<Media xmlns="urn:scte:224" id="m">{text}</Media>', "l": f'<MediaList><Media>{point("a")}</Media></MediaList>'})
    points = scte224.points(docs)
    assert points.where("doc_id = 'd'").count() == 7 and points.where("doc_id = 'l'").count() == 1
    rows = [("d", 0, "ABCD1234567", NOW, 0x34, 30.0), ("d", 1, None, NOW + 60_000, None, 30.0), ("d", 2, None, NOW + 600_000, None, 30.0)]
    breaks = spark.createDataFrame(rows, "doc_id string, index int, upid string, pdt double, segmentation_type int, signalled_duration double")
    matches, found = policy.compare(points, breaks, NOW)
    assert {(x["ordinal"], x["index"], x["drift"]) for x in matches.collect()} == {(0, 0, None), (1, 1, 3.0)}
    codes = sorted(x["code"] for x in found.where("doc_id = 'd'").collect())
    assert codes == sorted([
        "SCTE224_TYPE_MISMATCH", "SCTE224_DURATION_MISMATCH", "SCTE224_MATCH_DRIFT", "SCTE224_POINT_UNMATCHED", "SCTE224_POINT_UNMATCHED", "SCTE224_POINT_UNMATCHED",
        "SCTE224_POINT_EXPIRED", "SCTE224_POINT_FUTURE", "SCTE224_POINT_NO_POLICY", "SCTE224_SIGNAL_UNDECODABLE", "SCTE224_SIGNAL_NOT_GOVERNED",
    ])


def test_policies_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(body):
        read.add(1)
        return body

    docs = landed.pasted(spark, {f"d{k}": f'<Media xmlns="urn:scte:224" id="m">{point("a", 'matchTime="2026-01-01T00:00:01Z"')}</Media>' for k in range(5)})
    docs = docs.withColumn("body", F.udf(counted, "string").asNondeterministic()("body"))
    breaks = spark.createDataFrame([(f"d{k}", 0, None, NOW, None, 30.0) for k in range(5)], "doc_id string, index int, upid string, pdt double, segmentation_type int, signalled_duration double")
    own = policy.Governed(scte224.points(docs), breaks, NOW)
    assert own.findings.count() == 0 and own.matches.count() == 5 and read.value == 5
    own.release()


def test_remote_periods(spark):
    media = lambda codec, seconds: f'<Period duration="PT{seconds}S"><AdaptationSet mimeType="video/mp4"><Representation codecs="{codec}"/></AdaptationSet></Period>'
    slots = "".join(f'<Period duration="PT30S" xlink:href="{h}"/>' for h in ("good", "long", "other", "empty", "text", "gone"))
    docs = landed.pasted(spark, {"m": f'<MPD xmlns:xlink="urn:x" type="static">{media("avc1", 30)}{slots}</MPD>'})
    own = dash.analyse(docs)
    fetched = [("good", True, media("avc1", 30), 10.0), ("long", True, media("avc1", 40), 3000.0), ("other", True, media("hvc1", 30), 1.0), ("empty", True, "<x/>", 1.0), ("text", True, "sorry", 1.0), ("gone", False, None, 1.0)]
    rows, found = remote.resolve(own.periods, own.sets, spark.createDataFrame(fetched, "href string, ok boolean, body string, ms double"))
    assert sorted(x["code"] for x in found.collect()) == ["XLINK_CODEC_MISMATCH", "XLINK_DURATION_MISMATCH", "XLINK_RESOLVED_EMPTY", "XLINK_RESOLVE_FAILED", "XLINK_RESOLVE_SLOW", "XLINK_RESOLVE_UNPARSEABLE"]
    assert {x["href"]: x["seconds"] for x in rows.collect()}["good"] == 30.0


def test_reports(spark):
    text = "#EXTM3U\n#EXT-X-TARGETDURATION:6\n#EXTINF:6,\na\n#EXT-X-CUE-OUT:12\n#EXTINF:6,\nb\n#EXT-X-ENDLIST"
    own = hls.analyse(landed.pasted(spark, {"d": text, "e": "#EXTM3U"}))
    found = {x["doc_id"]: x["report"] for x in report.markdown(own.verdicts, own.stats, own.breaks, own.findings).collect()}
    assert "**Verdict:** FAIL (1 errors, 1 warnings, 1 notes)" in found["d"] and "`UNCLOSED_BREAK`, line 5" in found["d"] and "| 0 | 6 | 12 | 6 | no |" in found["d"]
    assert "2 segments over 12 s" in found["d"] and "## Breaks" not in found["e"]
    name = spark.sql("select 'https://a.b/c/d.m3u8?x=1' as u, timestamp'2026-01-02 03:04:05' as t").select(report.file_name(F.col("u"), "md", F.col("t"))).first()[0]
    assert name == "a-b-c-d-m3u8-20260102-0304.md"
