import pytest

from cuelake.plans import hls, stitching
from cuelake.sources import landed
from cuelake.sources.hls import lines, parts, picked_variants, variants


def playlist(*body, end=True, target=6):
    return "\n".join(["#EXTM3U", f"#EXT-X-TARGETDURATION:{target}", "#EXT-X-PROGRAM-DATE-TIME:2026-01-01T00:00:00.000Z", *body, *["#EXT-X-ENDLIST"] * end])


def seg(name, seconds=6.0):
    return f"#EXTINF:{seconds:.3f},\n{name}"


OUT, IN, CUT = "#EXT-X-CUE-OUT:12.0", "#EXT-X-CUE-IN", "#EXT-X-DISCONTINUITY"
PLAYLISTS = {
    "clean": playlist(seg("a0.ts"), OUT, CUT, seg("b1.ts"), seg("b2.ts"), IN, CUT, seg("a3.ts")),
    "unclosed": playlist(seg("a0.ts"), OUT, seg("a1.ts")),
    "running": playlist(seg("a0.ts"), OUT, seg("a1.ts"), end=False),
    "overrun": playlist(seg("a0.ts"), OUT, *[seg(f"a{k}.ts") for k in range(1, 8)], end=False),
    "orphan": playlist(seg("a0.ts"), OUT, seg("a1.ts"), seg("a2.ts"), IN, seg("a3.ts"), IN, seg("a4.ts")),
    "leading": playlist(seg("a0.ts"), IN, seg("a1.ts"), end=False),
    "nested": playlist(seg("a0.ts"), OUT, seg("a1.ts"), OUT, seg("a2.ts"), seg("a3.ts"), IN, seg("a4.ts")),
    "under": playlist(seg("a0.ts"), "#EXT-X-CUE-OUT:30", seg("a1.ts"), IN, seg("a2.ts")),
    "long": playlist(seg("a0.ts", 9.5)),
    "jump": playlist(seg("a0.ts"), "#EXT-X-PROGRAM-DATE-TIME:2026-01-01T00:01:00.000Z", seg("a1.ts")),
    "container": playlist(seg("a0.ts"), OUT, seg("b1.m4s"), seg("b2.m4s"), IN, seg("a3.ts")),
    "map": playlist('#EXT-X-MAP:URI="x"', seg("a0.m4s"), OUT, '#EXT-X-MAP:URI="y"', seg("b1.m4s"), seg("b2.m4s"), IN, '#EXT-X-MAP:URI="x"', seg("a3.m4s")),
    "dated": playlist('#EXT-X-DATERANGE:ID="d",START-DATE="2026-01-01T00:00:09.000Z",PLANNED-DURATION=6', seg("a0.ts"), '#EXT-X-DATERANGE:ID="d",START-DATE="2026-01-01T00:00:06.000Z"', seg("a1.ts")),
    "low": playlist("#EXT-X-PART-INF:PART-TARGET=0.5", "#EXT-X-SERVER-CONTROL:PART-HOLD-BACK=1.0,CAN-SKIP-UNTIL=12", '#EXT-X-PART:DURATION=0.5,URI="p",INDEPENDENT=YES', seg("a0.ts"), OUT, seg("a1.ts"), end=False),
    "empty": "#EXTM3U",
    "between": playlist('#EXT-X-DATERANGE:ID="i",CLASS="com.apple.hls.interstitial",X-ASSET-URI="u",DURATION=20,CUE="PRE,POST"', seg("a0.ts"), '#EXT-X-DATERANGE:ID="j",CLASS="com.apple.hls.interstitial",X-SNAP="SIDE"', seg("a1.ts")),
}


@pytest.fixture(scope="module")
def analysis(spark):
    found = hls.analyse(landed.pasted(spark, PLAYLISTS))
    codes = {}
    for row in found.findings.collect():
        codes.setdefault(row["doc_id"], []).append((row["code"], row["severity"]))
    return found, codes


def test_clean_playlist_is_quiet(analysis):
    found, codes = analysis
    assert "clean" not in codes
    row = found.breaks.where("doc_id = 'clean'").first()
    assert (row["start_time"], row["actual_duration"], row["signalled_duration"], row["closed"], row["media_uris"]) == (6.0, 12.0, 12.0, True, ["b1.ts", "b2.ts"])
    assert found.stats.where("doc_id = 'clean'").first()["ad_percent"] == 50.0
    assert {x["doc_id"]: x["verdict"] for x in found.verdicts.collect()}["clean"] == "pass"


@pytest.mark.parametrize(
    ("name", "code", "severity"),
    [
        ("unclosed", "UNCLOSED_BREAK", "error"), ("running", "BREAK_IN_PROGRESS", "info"), ("overrun", "BREAK_OVERRUN_UNCLOSED", "error"), ("orphan", "ORPHAN_CUE_IN", "error"),
        ("leading", "ORPHAN_CUE_IN", "info"), ("nested", "NESTED_CUE_OUT", "error"), ("under", "BREAK_UNDERRUN", "warning"), ("long", "TARGETDURATION_EXCEEDED", "error"),
        ("jump", "PDT_DISCONTINUITY", "warning"), ("container", "AD_CONTAINER_MISMATCH", "error"), ("map", "MAP_CHANGED_WITHOUT_DISCONTINUITY", "error"),
        ("dated", "DATERANGE_DUPLICATE_ID", "error"), ("dated", "DATERANGE_START_DATE_MISMATCH", "warning"), ("low", "LL_PART_HOLD_BACK_TOO_SMALL", "error"),
        ("low", "LL_NO_BLOCKING_RELOAD", "warning"), ("low", "LL_DELTA_UPDATE_DROPS_DATERANGES", "warning"), ("low", "LL_AD_DECISION_BUDGET", "info"), ("low", "LL_NO_PRELOAD_HINT", "info"),
        ("empty", "NO_PROGRAM_DATE_TIME", "warning"), ("between", "INTERSTITIAL_NO_ASSET", "error"), ("between", "INTERSTITIAL_PRE_AND_POST", "error"),
        ("between", "INTERSTITIAL_UNKNOWN_ATTRIBUTE_VALUE", "warning"), ("under", "SIGNALLING_ONLY_STREAM", "info"),
    ],
)
def test_defects_are_reported(analysis, name, code, severity):
    assert (code, severity) in analysis[1][name]


def test_codes_stay_away_where_nothing_is_wrong(analysis):
    codes = {k: {c for c, _ in v} for k, v in analysis[1].items()}
    assert codes["running"] == {"BREAK_IN_PROGRESS", "SIGNALLING_ONLY_STREAM"}
    assert codes["long"] == {"TARGETDURATION_EXCEEDED"}
    assert codes["jump"] == {"PDT_DISCONTINUITY"}


def test_renditions(spark, analysis):
    found, _ = analysis
    long = [seg(f"s{k}.ts") for k in range(10)]
    good = playlist(*long[:4], OUT, *long[4:6], IN, *long[6:])
    moved = playlist(*long[:5], OUT, *long[5:7], IN, *long[7:])
    bare = playlist(*long)
    own = hls.analyse(landed.pasted(spark, {"g": good, "h": good, "m": moved, "b": bare}))
    streams = spark.createDataFrame([("same", "g", 0), ("same", "h", 1), ("moved", "g", 0), ("moved", "m", 1), ("bare", "g", 0), ("bare", "b", 1)], "stream_id string, doc_id string, ordinal int")
    codes = {}
    for row in hls.compare_renditions(streams, own.breaks, own.stats).collect():
        codes.setdefault(row["stream_id"], set()).add(row["code"])
    assert "same" not in codes
    assert codes["moved"] == {"VARIANT_MISSING_BREAK"}
    assert codes["bare"] == {"VARIANT_BREAK_COUNT_MISMATCH", "VARIANT_MISSING_BREAK", "VARIANT_SIGNALLING_STYLE_MISMATCH"}


def test_stitching(spark):
    content = [seg(f"live_{k}.ts") for k in range(20)]
    source = playlist(*content[:2], OUT, *content[2:4], IN, *content[4:7], OUT, *content[7:9], IN, *content[9:12], OUT, *content[12:14], IN, *content[14:])
    ads = [seg(f"ads/x_{k}.ts") for k in range(4)]
    output = playlist(*content[:2], OUT, CUT, *ads[:2], IN, CUT, *content[4:7], OUT, CUT, *content[7:9], IN, CUT, *content[9:])
    own = hls.analyse(landed.pasted(spark, {"s": source, "o": output}))
    pairs = spark.createDataFrame([("p", "s", "o"), ("same", "s", "s")], "pair_id string, source_id string, output_id string")
    found = stitching.compare(pairs, own.breaks, own.stats, own.segments)
    assert [x["status"] for x in found.avails.where("pair_id = 'p'").orderBy("index").collect()] == ["filled", "passthrough", "not-stitched"]
    row = found.summary.where("pair_id = 'p'").first()
    assert (row["signalled"], row["signalled_seconds"], row["stitched_seconds"]) == (3, 36.0, 12.0)
    codes = {x["code"] for x in found.findings.where("pair_id = 'p'").collect()}
    assert codes == {"AVAIL_PASSED_THROUGH", "AVAIL_NOT_STITCHED"}


def test_master_playlist_and_parts(spark):
    text = '#EXTM3U\n#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="a",NAME="en",URI="a.m3u8"\n#EXT-X-STREAM-INF:BANDWIDTH=100,CODECS="avc1,mp4a",AUDIO="a"\n\n# note\nv.m3u8\n#EXT-X-MEDIA:TYPE=SUBTITLES,GROUP-ID="s"\n'
    found = variants(landed.pasted(spark, {"m": text})).orderBy("idx").collect()
    assert [(x["media_type"], x["uri"], x["bandwidth"]) for x in found] == [("AUDIO", "a.m3u8", None), ("VIDEO", "v.m3u8", 100.0)]
    assert [x["uri"] for x in picked_variants(variants(landed.pasted(spark, {"m": text})), 1).collect()] == ["v.m3u8"]
    low = parts(lines(landed.pasted(spark, {"l": PLAYLISTS["low"]}))).first()
    assert (low["uri"], low["independent"], low["segment_index"]) == ("p", True, 0)


def test_protocols(spark):
    from pyspark.sql import functions as F

    texts = {"d": '<?xml version="1.0"?><MPD type="static"/>', "h": "#EXTM3U\n", "m": "#EXTM3U\n#EXT-X-STREAM-INF:X=1\nv", "v": "<VAST version='3'/>", "p": "<vmap:VMAP x='y'/>", "n": "hello"}
    found = dict(landed.pasted(spark, texts).select("doc_id", landed.protocol(F.col("body"))).collect())
    assert found == {"d": "dash", "h": "hls", "m": "hls-master", "v": "vast", "p": "vmap", "n": None}
