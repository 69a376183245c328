import pytest
from pyspark.sql import functions as F

from cuelake.__main__ import main
from cuelake.plans import dash
from cuelake.sources import landed
from cuelake.sources.dash import addressed
from cuelake.sources.segments import chosen
from cuelake.streaming import store


def test_number_addressed_segments(spark):
    template = '<SegmentTemplate timescale="1" duration="2" startNumber="100" presentationTimeOffset="200" media="$RepresentationID$/$Number%05d$-$Time$.m4s"/>'
    text = lambda head, length: f'<MPD {head}><BaseURL>http://o/</BaseURL><Period {length}><AdaptationSet mimeType="video/mp4">{template}<Representation id="v" bandwidth="5"/></AdaptationSet></Period></MPD>'
    docs = landed.pasted(spark, {"vod": text('type="static"', 'duration="PT6S"'), "live": text('type="dynamic" availabilityStartTime="2026-01-01T00:00:00Z" timeShiftBufferDepth="PT10S" suggestedPresentationDelay="PT4S"', "")})
    own = dash.analyse(docs)
    rows = addressed(own.headers, own.periods, own.sets, 1_767_225_600_000 + 100_000.0).orderBy("doc_id", "number").collect()
    vod = [x for x in rows if x["doc_id"] == "vod"]
    assert [x["url"] for x in vod] == [f"http://o/v/{100 + k:05d}-{200 + 2 * k}.m4s" for k in range(4)] and vod[1]["start"] == 2.0
    live = [x for x in rows if x["doc_id"] == "live"]
    assert [x["number"] for x in live] == list(range(143, 149)) and live[0]["pdt"] == 1_767_225_600_000 + 86_000


def test_segments_worth_opening(spark):
    listed = spark.createDataFrame([("d", k, 6.0 * k) for k in range(30)], "doc_id string, idx int, start_time double")
    breaks = spark.createDataFrame([("d", 0, 60.0), ("d", 1, 0.0)], "doc_id string, index int, start_time double")
    assert sorted(x["idx"] for x in chosen(listed, breaks, 6).collect()) == [0, 9, 10, 20]
    assert chosen(listed, breaks, 2).count() == 2
    assert chosen(listed, breaks.limit(0), 5).count() == 5


def test_store(spark):
    monitors = spark.createDataFrame([("a", 1, "x", 0, None), ("b", 2, "y", 3, 5)], "monitor_id string, created_at long, label string, consecutive_failures int, last_run_at long")
    assert [x["monitor_id"] for x in store.monitors_by_age(monitors).collect()] == ["b", "a"]
    patch = spark.createDataFrame([("a", "new")], "monitor_id string, label string")
    assert {x["monitor_id"]: x["label"] for x in store.patched(monitors, patch).collect()} == {"a": "new", "b": "y"}
    runs = spark.createDataFrame([("a", False, 7), ("b", True, 8)], "monitor_id string, ok boolean, at long")
    assert {x["monitor_id"]: (x["consecutive_failures"], x["last_run_at"]) for x in store.marked(monitors, runs).collect()} == {"a": (1, 7), "b": (0, 8)}
    assert store.without(monitors, patch).count() == 1 and store.last_runs(runs, 8).count() == 1
    alerts = spark.createDataFrame([(k, "a", k, k % 2) for k in range(5)], "alert_id int, monitor_id string, at long, acknowledged int")
    assert [x["alert_id"] for x in store.latest_alerts(alerts, 2, "a").collect()] == [4, 3]
    assert store.unacknowledged(alerts).first()["unacknowledged"] == 3


def test_details_of_a_monitor(spark):
    monitors = spark.createDataFrame([("a", "x"), ("b", "y")], "monitor_id string, label string")
    runs = spark.createDataFrame([("a", k, True) for k in range(5)], "monitor_id string, at long, ok boolean")
    alerts = spark.createDataFrame([("a", 3, "Z"), ("a", 3, "B"), ("a", 1, "C")], "monitor_id string, at long, code string")
    breaks = spark.createDataFrame([("a", "event:2", 0), ("a", "event:1", 0), ("a", "event:3", 1)], "monitor_id string, break_key string, closed int")
    found = {x["monitor_id"]: x for x in store.details(monitors, runs, alerts, breaks, 3, 2).collect()}
    assert [x["at"] for x in found["a"]["runs"]] == [4, 3, 2] and [(x["at"], x["code"]) for x in found["a"]["alerts"]] == [(3, "B"), (3, "Z")]
    assert [x["break_key"] for x in found["a"]["open_breaks"]] == ["event:1", "event:2"]
    assert found["b"]["label"] == "y" and found["b"]["runs"] == found["b"]["alerts"] == found["b"]["open_breaks"] == []


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "bad.m3u8").write_text("#EXTM3U\n#EXT-X-TARGETDURATION:6\n#EXTINF:9,\na\n#EXT-X-ENDLIST")
    assert main([str(tmp_path)]) == 1 and "TARGETDURATION_EXCEEDED" in capsys.readouterr().out
    (tmp_path / "bad.m3u8").write_text("nothing")
    assert main([str(tmp_path)]) == 2


def test_labels_of_addresses_and_times(spark):
    from cuelake.functions.text import address_label, milliseconds_text

    want = {"https://h/a/b.m3u8?x=1#y": "b.m3u8", "http://h/live/.mpd": "live", "http://h/.mpd": "h", "http://u@h:80/": "h", "HTTP://h": "h", "a/b/c.mpd": "c.mpd", "c:\\x\\y.mpd": "y.mpd", "a/": "a/", "": ""}
    found = spark.createDataFrame([(x,) for x in want], "u string").select("u", address_label(F.col("u")).alias("l")).collect()
    assert {x["u"]: x["l"] for x in found} == want
    assert spark.sql("select 0.0125d s").select(milliseconds_text(F.col("s"))).first()[0] == "12.5ms"


def test_compare_on_the_command_line(spark, tmp_path, capsys):
    from cuelake.__main__ import main

    head = "#EXTM3U\n#EXT-X-TARGETDURATION:6\n#EXT-X-PROGRAM-DATE-TIME:2026-01-01T00:00:00Z\n#EXTINF:6,\nlive_1.ts\n"
    feed = head + "#EXT-X-CUE-OUT:12\n#EXTINF:6,\nlive_2.ts\n#EXTINF:6,\nlive_3.ts\n#EXT-X-CUE-IN\n#EXTINF:6,\nlive_4.ts\n#EXT-X-ENDLIST"
    (tmp_path / "feed.m3u8").write_text(feed)
    (tmp_path / "good.m3u8").write_text(feed.replace("live_2.ts", "ads/x.ts").replace("live_3.ts", "ads/y.ts").replace("#EXT-X-CUE-OUT", "#EXT-X-DISCONTINUITY\n#EXT-X-CUE-OUT"))
    (tmp_path / "none.m3u8").write_text(feed.replace("#EXT-X-CUE-OUT:12\n", "").replace("#EXT-X-CUE-IN\n", ""))
    (tmp_path / "text.txt").write_text("hello")
    path = lambda name: str(tmp_path / name)
    assert main(["compare", path("feed.m3u8"), path("good.m3u8")]) == 0 and "fill rate 100.0 %, 1 avails" in capsys.readouterr().out
    assert main(["compare", path("feed.m3u8"), path("none.m3u8"), "--markdown"]) == 1 and "`AVAIL_NOT_STITCHED`" in capsys.readouterr().out
    assert main(["compare", path("feed.m3u8"), path("text.txt")]) == 2
    with pytest.raises(SystemExit):
        main(["a", "b"])
