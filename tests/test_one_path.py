from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from cuelake.functions.text import attributes, codec_family, is_video_codec, resolve_uri
from cuelake.plans.onepath import OnePath

BASES = ["http://a.b/c/d/e.m3u8?x=1#f", "https://h", "http://h/", "file:/x/y"]
REFS = ["g", "./g", "g/", "/g", "//h2/g", "?y", "g?y=/../z", "#s", "", "../g", "../../g", "../../../g", "./../g/./h/..", "/./g/../k", "http://o/b/../c", "g.", "..g", "a/b/../../../z"]


def test_addresses_are_resolved_as_the_standard_says(spark):
    rows = spark.createDataFrame([(b, r) for b in BASES[:3] for r in REFS], "base string, ref string")
    for x in rows.select("base", "ref", resolve_uri(F.col("base"), F.col("ref")).alias("got")).collect():
        want = urljoin(x["base"], x["ref"]) if x["ref"] else x["base"].split("#")[0]
        want = {"http://o/b/../c": "http://o/c"}.get(want, want)
        assert x["got"] in (want, want + "/") or x["got"].rstrip("/") == want.rstrip("/"), (tuple(x), want)


def test_attribute_lists_and_codecs(spark):
    row = spark.sql("""select 'A="x, y",b-c=5 , D_e="",F=1x2,A=last' as t, array('avc1.64', 'hev1.1', 'AV01.x', 'mp4a.40.2', 'Opus', 'x-h264', 'dvh1.05') as c""")
    found = row.select(attributes(F.col("t")).alias("p"), F.transform("c", codec_family).alias("f"), F.transform("c", is_video_codec).alias("v")).first()
    assert [tuple(x) for x in found["p"]] == [("A", "x, y"), ("B-C", "5"), ("D_E", ""), ("F", "1x2"), ("A", "last")]
    assert found["f"] == ["h264", "hevc", "av1", "mp4a", "opus", "h264", "dvh1"]
    assert found["v"] == [True, True, True, False, False, True, True]


MEDIA = "#EXTM3U\n#EXT-X-TARGETDURATION:6\n#EXTINF:6,\na\n#EXT-X-CUE-OUT:12\n#EXTINF:6,\nb\n#EXTINF:6,\nc\n#EXT-X-CUE-IN\n#EXTINF:6,\nd\n#EXT-X-ENDLIST"


@pytest.mark.parametrize("most", [6, 1])
def test_from_a_master_playlist_to_findings_across_its_variants(spark, most):
    master = '#EXTM3U\n#EXT-X-MEDIA:TYPE=AUDIO,GROUP-ID="a",NAME="English",LANGUAGE="en",URI="audio/en.m3u8"\n#EXT-X-STREAM-INF:BANDWIDTH=800000,RESOLUTION=640x360,CODECS="avc1.4d,mp4a.40.2"\nlow.m3u8\n#EXT-X-STREAM-INF:BANDWIDTH=2000000,CODECS="hvc1.1"\n../high.m3u8'
    masters = spark.createDataFrame([("s", "http://h/x/master.m3u8", master), ("none", "http://h/y/m.m3u8", "#EXTM3U\n#EXT-X-STREAM-INF:BANDWIDTH=1\nz.m3u8")], "doc_id string, uri string, body string")
    moved = MEDIA.replace("#EXTINF:6,\na", "#EXTINF:4,\na")
    fetched = spark.createDataFrame([("http://h/x/low.m3u8", True, MEDIA, None), ("http://h/high.m3u8", True, moved, None), ("http://h/x/audio/en.m3u8", False, None, "404")], "url string, ok boolean, body string, error string")
    path = OnePath(masters, fetched, most)
    labels = {x["label"] for x in path.variants.where("doc_id = 's'").collect()}
    codes = {x["code"] for x in path.findings.where("stream_id = 's'").collect()}
    assert {x["code"] for x in path.findings.where("stream_id = 'none'").collect()} == {"VARIANT_FETCH_FAILED", "NO_VARIANT_READABLE"}
    if most == 6:
        assert labels == {"640x360 @ 800kbps", "2000kbps", "audio en (English)"}
        assert {"VARIANT_FETCH_FAILED", "VARIANT_BREAK_MISALIGNED"} <= codes and "VARIANTS_NOT_ANALYSED" not in codes
        profile = path.profiles.where("doc_id = 's'").first()
        assert (profile["codecs"], profile["bandwidths"], profile["avail_seconds"]) == (["h264", "hevc"], [800000.0, 2000000.0], 12.0)
        assert path.verdicts.where("stream_id = 's'").first()["verdict"] == "fail"
    else:
        assert labels == {"640x360 @ 800kbps"} and "VARIANTS_NOT_ANALYSED" in codes


def test_reports_tell_what_findings_mean(spark):
    from cuelake.plans import hls, report
    from cuelake.sources import landed

    own = hls.analyse(landed.pasted(spark, {"d": MEDIA.replace("#EXT-X-CUE-IN\n", "")}))
    found = own.findings.where("code = 'UNCLOSED_BREAK'").first()
    assert found["detail"] == "Nothing ends the break. Line 5. Break 0. At 6 s."
    assert "`UNCLOSED_BREAK`, line 5: Nothing ends the break." in report.markdown(own.verdicts, own.stats, own.breaks, own.findings).first()["report"]
    avails = spark.createDataFrame([("p", 0, 6.0, 30.0, 20.0, -10.0, 0.2, "under-filled")], "pair_id string, index int, start_time double, signalled double, stitched double, delta double, alignment double, status string")
    faults = spark.createDataFrame([("p", "warning", "AVAIL_UNDER_FILLED", "t", "It is short.", None)], "pair_id string, severity string, code string, title string, detail string, line_number int")
    counts = ("signalled", "filled", "not_stitched", "under_filled", "over_filled", "passthrough", "unsignalled")
    summary = spark.createDataFrame([("p", 1, 0, 0, 1, 0, 0, 0, 30.0, 20.0, 2 / 3)], "pair_id string, " + ", ".join(f"{c} long" for c in counts) + ", signalled_seconds double, stitched_seconds double, fill_rate double")
    text = report.comparison(avails, faults, summary).first()["report"]
    assert "**Fill:** 66.7 % (20 of 30 s, 1 avails)" in text and "`AVAIL_UNDER_FILLED`: It is short." in text and "| 0 | 6 | 30 | 20 | -10 | 0.2 | under-filled |" in text


def test_large_files_are_told(spark, tmp_path):
    from cuelake.sources import landed

    (tmp_path / "a.m3u8").write_text("#EXTM3U")
    (tmp_path / "b.m3u8").write_text("#EXTM3U\n" * 100)
    kept = landed.manifests(spark, str(tmp_path), 50).collect()
    told = landed.refused(spark, str(tmp_path), 50).collect()
    assert [x["uri"].endswith("a.m3u8") for x in kept] == [True] and [(x["uri"].endswith("b.m3u8"), x["bytes"], x["code"]) for x in told] == [(True, 800, "DOCUMENT_TOO_LARGE")]


def test_probe_totals_and_documents_without_addresses(spark):
    from cuelake.sources import segments

    asked = spark.createDataFrame([("d", "u1"), ("d", "u2"), ("e", "u3"), ("f", None)], "doc_id string, uri string")
    files = spark.createDataFrame([("u1", b"abc"), ("u3", b"")], "uri string, content binary")
    cues = spark.createDataFrame([("u1",), ("u1",)], "uri string")
    found = {tuple(x) for x in segments.probe_totals(asked, files, cues).collect()}
    assert found == {("d", 2, 1, 3, 2), ("e", 1, 1, 0, 0), ("f", 1, 0, 0, 0)}
    assert [x["doc_id"] for x in segments.addressable(asked, asked).collect()] == ["f"]
