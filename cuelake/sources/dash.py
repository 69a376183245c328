"""DASH manifests as tables, by from_xml with a fixed schema; prefixes of elements and attributes don't matter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions.text import fill_template, given, iso_duration, iso_millis, number

#: Of an adaptation set's timeline so many segments are listed; its totals count all.
MOST_SEGMENTS = 5000
#: Schemes of SCTE-35 events, and of properties that signal continuity between periods.
SCTE35_SCHEMES = ("urn:scte:scte35:2014:xml+bin", "urn:scte:scte35:2013:xml", "urn:scte:scte35:2014:xml")
CONTINUITY_SCHEMES = ("urn:mpeg:dash:period-continuity:2015", "urn:mpeg:dash:period-connectivity:2015")

_PROPERTY = "array<struct<_schemeIdUri:string,_value:string>>"
_TEMPLATE = (
    "array<struct<_timescale:string,_presentationTimeOffset:string,_media:string,_initialization:string,_startNumber:string,_duration:string,"
    "_availabilityTimeOffset:string,_availabilityTimeComplete:string,SegmentTimeline:array<struct<_none:string,S:array<struct<_t:string,_d:string,_r:string>>>>>>"
)
_REPRESENTATION = "array<struct<_id:string,_codecs:string,_bandwidth:string,_width:string,_height:string,_frameRate:string,_audioSamplingRate:string>>"
_SET = (
    "array<struct<_id:string,_mimeType:string,_contentType:string,_lang:string,_codecs:string,BaseURL:array<string>,"
    f"SegmentTemplate:{_TEMPLATE},SegmentList:{_TEMPLATE},Representation:{_REPRESENTATION},SupplementalProperty:{_PROPERTY},EssentialProperty:{_PROPERTY},InbandEventStream:{_PROPERTY}>>"
)
_EVENT = "array<struct<_id:string,_presentationTime:string,_duration:string,_segmentTypeId:string,_VALUE:string,Binary:array<string>,Signal:array<struct<Binary:array<string>>>>>"
_PERIOD = (
    "array<struct<_id:string,_start:string,_duration:string,_href:string,_actuate:string,BaseURL:array<string>,"
    f"AssetIdentifier:{_PROPERTY},SupplementalProperty:{_PROPERTY},EventStream:array<struct<_schemeIdUri:string,_value:string,_timescale:string,Event:{_EVENT}>>,AdaptationSet:{_SET}>>"
)
MPD = (
    "_type string, _profiles string, _availabilityStartTime string, _publishTime string, _minimumUpdatePeriod string, _timeShiftBufferDepth string, "
    "_suggestedPresentationDelay string, _minBufferTime string, _mediaPresentationDuration string, BaseURL array<string>, "
    f"ServiceDescription array<struct<Latency:array<struct<_target:string,_min:string,_max:string,_referenceId:string>>>>, Period {_PERIOD}"
)


def parsed(docs: DataFrame) -> DataFrame:
    """(doc_id, m): documents with an MPD root as a struct."""
    rooted = docs.where(F.substring("body", 1, 4000).rlike(r"<(?:[\w-]+:)?MPD[\s>/]"))
    return rooted.select("doc_id", F.from_xml("body", MPD, {"ignoreNamespace": "true", "rowTag": "MPD"}).alias("m"))


def _first(array: Column) -> Column:
    return F.try_element_at(array, F.lit(1))


def _schemes(properties: Column) -> Column:
    return F.transform(F.coalesce(properties, F.array().cast(_PROPERTY)), lambda p: F.concat(p["_schemeIdUri"], F.coalesce(F.concat(F.lit("="), p["_value"]), F.lit(""))))


def _type(m: Column) -> Column:
    return F.when(m["_type"] == "dynamic", "dynamic").otherwise("static")


def _period_count(m: Column) -> Column:
    return F.size(F.coalesce(m["Period"], F.array()))


def headers(docs: DataFrame) -> DataFrame:
    m = F.col("m")
    latency = _first(F.filter(F.transform(m["ServiceDescription"], lambda s: _first(s["Latency"])), lambda x: x.isNotNull()))
    return docs.select(
        "doc_id", _type(m).alias("type"), m["_profiles"].alias("profiles"),
        iso_millis(m["_availabilityStartTime"]).alias("ast_ms"), iso_millis(m["_publishTime"]).alias("publish_ms"),
        *[iso_duration(m[a]).alias(n) for a, n in (("_minimumUpdatePeriod", "mup"), ("_timeShiftBufferDepth", "tsbd"), ("_suggestedPresentationDelay", "spd"), ("_minBufferTime", "min_buffer"), ("_mediaPresentationDuration", "mpd_duration"))],
        *[number(latency[a]).alias(n) for a, n in (("_target", "target_ms"), ("_min", "min_ms"), ("_max", "max_ms"))], latency.isNotNull().alias("has_latency"),
        _period_count(m).alias("period_count"),
    )


def _raw_periods(docs: DataFrame, *more: Column) -> DataFrame:
    return docs.select("doc_id", *more, F.posexplode("m.Period").alias("period_index", "p"), F.concat_ws("", _first(F.col("m.BaseURL"))).alias("base"))


def adaptation_sets(docs: DataFrame) -> DataFrame:
    """One row a set, with the totals of its timeline; first_time and duration in seconds of media time."""
    rows = _raw_periods(docs).select("doc_id", "period_index", "base", F.concat_ws("", _first(F.col("p.BaseURL"))).alias("own"), F.posexplode("p.AdaptationSet").alias("set_index", "a"))
    a = F.col("a")
    rows = rows.withColumn("t", F.coalesce(_first(a["SegmentTemplate"]), _first(a["SegmentList"])))
    t = F.col("t")
    line = F.coalesce(_first(t["SegmentTimeline"])["S"], F.array().cast("array<struct<_t:string,_d:string,_r:string>>"))
    begun = F.struct(
        F.lit(None).cast("double").alias("cursor"), F.lit(None).cast("double").alias("first"), F.lit(0.0).alias("total"), F.lit(0).cast("long").alias("n"),
        F.array().cast("array<struct<t:double,d:double,k:bigint,n:bigint>>").alias("runs"),
    )

    def step(acc, s):
        d, r = F.coalesce(number(s["_d"]), F.lit(0.0)), F.coalesce(number(s["_r"]), F.lit(0.0))
        many = F.when(r < 0, 1).otherwise(r + 1).cast("long")
        at = F.coalesce(number(s["_t"]), acc["cursor"])
        return F.struct(
            (at + d * many).alias("cursor"), F.coalesce(acc["first"], at).alias("first"), (acc["total"] + d * many).alias("total"), (acc["n"] + many).alias("n"),
            F.concat(acc["runs"], F.array(F.struct(at.alias("t"), d.alias("d"), acc["n"].alias("k"), many.alias("n")))).alias("runs"),
        )

    rows = rows.withColumn("x", F.aggregate(line, begun, step))
    x, scale = F.col("x"), F.coalesce(number(t["_timescale"]), F.lit(1.0))
    uniform = number(t["_duration"])
    pto = F.coalesce(number(t["_presentationTimeOffset"]), F.lit(0.0))
    codecs = lambda r: F.coalesce(given(r["_codecs"]), given(a["_codecs"]), F.lit("?"))
    shape = F.transform(
        F.coalesce(a["Representation"], F.array().cast(_REPRESENTATION)),
        lambda r: F.concat_ws("/", codecs(r), F.coalesce(r["_width"], F.lit("")), F.coalesce(r["_height"], F.lit("")), F.coalesce(r["_audioSamplingRate"], F.lit(""))),
    )
    timeline = F.size(F.coalesce(t["SegmentTimeline"], F.array())) > 0
    return rows.select(
        "doc_id", "period_index", "set_index", a["_id"].alias("id"), a["_mimeType"].alias("mime_type"), a["_contentType"].alias("content_type"), a["_lang"].alias("lang"),
        scale.alias("timescale"), pto.alias("pto"), F.when(x["n"] > 0, x["first"]).when(~timeline & uniform.isNotNull(), pto).alias("first_segment_time"), (x["total"] / scale).alias("media_duration"), x["n"].alias("segment_count"),
        t["_media"].alias("media_template"), t["_initialization"].alias("init_template"), F.coalesce(number(t["_startNumber"]), F.lit(1.0)).cast("long").alias("start_number"),
        F.concat("base", "own", F.concat_ws("", _first(a["BaseURL"]))).alias("base_url"), F.when(~timeline, uniform).alias("segment_duration"), timeline.alias("uses_timeline"),
        number(t["_availabilityTimeOffset"]).alias("ato"), F.when(t["_availabilityTimeComplete"].isNotNull(), t["_availabilityTimeComplete"] != "false").alias("at_complete"),
        F.array_join(F.array_sort(shape), "|").alias("signature"), _first(a["Representation"])["_id"].alias("representation"), number(_first(a["Representation"])["_bandwidth"]).cast("long").alias("bandwidth"), _schemes(a["SupplementalProperty"]).alias("supplemental"), _schemes(a["EssentialProperty"]).alias("essential"),
        _schemes(a["InbandEventStream"]).alias("inband"), (_first(x["runs"])["d"] / scale).alias("first_length"), x["runs"].alias("runs"),
    )


def timeline_segments(sets: DataFrame) -> DataFrame:
    """The segments of timelines, up to MOST_SEGMENTS a set."""
    runs = sets.select("doc_id", "period_index", "set_index", "start_number", F.explode("runs").alias("r")).where(F.col("r.t").isNotNull() & (F.col("r.k") < MOST_SEGMENTS))
    count = F.least(F.col("r.n"), F.lit(MOST_SEGMENTS) - F.col("r.k"))
    each = runs.select("doc_id", "period_index", "set_index", "start_number", "r", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("i"))
    return each.select("doc_id", "period_index", "set_index", (F.col("r.t") + F.col("i") * F.col("r.d")).alias("t"), F.col("r.d").alias("d"), (F.col("start_number") + F.col("r.k") + F.col("i")).alias("number"))


def periods(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Periods with their starts: an implicit one follows the extent of those before. The media's extent is that of the
    first video set with segments, or else of the first set with any. A period has what rules ask of its manifest, of the
    period after it and of its sets (offsets of those with segments), so that they join neither."""
    p, m = F.col("p"), F.col("m")
    whole = [_type(m).alias("type"), iso_millis(m["_availabilityStartTime"]).alias("ast_ms"), iso_duration(m["_minimumUpdatePeriod"]).alias("mup"), iso_duration(m["_timeShiftBufferDepth"]).alias("tsbd"), _period_count(m).alias("period_count")]
    rows = _raw_periods(docs, *whole).select(
        "doc_id", "type", "ast_ms", "mup", "tsbd", "period_count", "period_index", p["_id"].alias("id"), iso_duration(p["_start"]).alias("stated"), iso_duration(p["_duration"]).alias("declared_duration"),
        p["_href"].alias("xlink_href"), p["_actuate"].alias("xlink_actuate"), _first(_schemes(p["AssetIdentifier"])).alias("asset_identifier"), _schemes(p["SupplementalProperty"]).alias("supplemental"),
        F.size(F.coalesce(p["AdaptationSet"], F.array())).alias("set_count"), F.size(F.coalesce(p["EventStream"], F.array())).alias("stream_count"),
    )
    rank = F.when(F.col("mime_type").startswith("video"), 0).otherwise(1)
    timed = F.col("segment_count") > 0
    per = sets.groupBy("doc_id", "period_index").agg(
        F.min_by(F.struct("first_segment_time", "timescale", "media_duration"), F.when(timed, F.struct(rank.alias("rank"), F.col("set_index")))).alias("ref"),
        F.collect_list(F.when(timed, F.col("media_duration"))).alias("lengths"),
        F.array_join(F.array_sort(F.collect_list("signature")), ";").alias("signature"),
        F.count_if(F.col("segment_duration").isNotNull()).alias("uniform_sets"), F.flatten(F.collect_list("supplemental")).alias("set_properties"), F.flatten(F.collect_list("inband")).alias("inband"),
        F.sum(F.when(F.col("mime_type").startswith("video"), F.col("segment_count"))).alias("video_segments"), F.collect_list("media_template").alias("media_templates"),
        F.collect_list(F.when(timed, F.col("pto") / F.col("timescale"))).alias("offsets"),
    )
    rows = rows.join(per, ["doc_id", "period_index"], "left")
    measured = F.col("ref.media_duration")
    extent = F.coalesce("declared_duration", measured, F.lit(0.0))
    by = Window.partitionBy("doc_id").orderBy("period_index")
    rows = rows.withColumn("_chain", F.count("stated").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("doc_id", "_chain").orderBy("period_index").rowsBetween(Window.unboundedPreceding, -1)
    begun = F.first("stated").over(Window.partitionBy("doc_id", "_chain").orderBy("period_index"))
    rows = rows.withColumn("start", F.coalesce(begun, F.lit(0.0)) + F.coalesce(F.sum(extent).over(inside), F.lit(0.0)))
    following = F.lead("start").over(by)
    length = F.coalesce(measured, "declared_duration", F.when(F.coalesce("uniform_sets", F.lit(0)) > 0, F.greatest(F.lit(0.0), F.coalesce(following - F.col("start"), F.lit(0.0)))), F.lit(0.0))
    skew = F.coalesce(F.array_max(F.transform("lengths", lambda x: F.abs(x - measured))), F.lit(0.0))
    placeholder = F.col("xlink_href").isNotNull() & (F.col("set_count") == 0)
    properties = F.concat("supplemental", F.coalesce("set_properties", F.array().cast("array<string>")))
    continuous = F.exists(properties, lambda x: x.startswith(CONTINUITY_SCHEMES[0]) | x.startswith(CONTINUITY_SCHEMES[1]))
    return rows.select(
        "doc_id", "type", "ast_ms", "mup", "tsbd", "period_count", "period_index", "id", "start", F.col("stated").isNotNull().alias("start_explicit"), "declared_duration", length.alias("media_duration"),
        F.coalesce(F.col("ref.first_segment_time") / F.col("ref.timescale"), "start").alias("media_start"), following.alias("next_start"), F.lead("signature").over(by).alias("next_signature"),
        F.lead(placeholder).over(by).alias("next_is_placeholder"), F.lead(continuous).over(by).alias("next_is_continuous"), "offsets", placeholder.alias("is_placeholder"), "xlink_href", "xlink_actuate", "asset_identifier",
        properties.alias("properties"), F.coalesce("inband", F.array().cast("array<string>")).alias("inband"),
        F.coalesce("signature", F.lit("")).alias("signature"), F.coalesce("uniform_sets", F.lit(0)).alias("uniform_sets"), skew.alias("skew"), "stream_count", F.coalesce("video_segments", F.lit(0)).alias("video_segments"),
        F.coalesce("media_templates", F.array().cast("array<string>")).alias("media_templates"),
    )


def events(docs: DataFrame) -> DataFrame:
    """Events in document order (ord); times in seconds."""
    rows = _raw_periods(docs).select("doc_id", "period_index", F.posexplode("p.EventStream").alias("stream_index", "s"))
    rows = rows.select("doc_id", "period_index", "stream_index", "s", F.posexplode("s.Event").alias("event_index", "e"))
    scale = F.coalesce(number(F.col("s._timescale")), F.lit(1.0))
    e = F.col("e")
    payload = F.coalesce(_first(e["Binary"]), _first(_first(e["Signal"])["Binary"]))
    return rows.select(
        "doc_id", "period_index", "stream_index", "event_index", F.coalesce(F.col("s._schemeIdUri"), F.lit("")).alias("scheme"), F.col("s._value").alias("value"), e["_id"].alias("id"),
        (F.coalesce(number(e["_presentationTime"]), F.lit(0.0)) / scale).alias("presentation_time"), e["_presentationTime"].isNotNull().alias("pt_explicit"),
        (number(e["_duration"]) / scale).alias("duration"), given(F.regexp_replace(payload, r"\s+", "")).alias("payload"), e["_segmentTypeId"].alias("vendor_type"),
    )


#: Of number-addressed sets so many segments are listed.
MOST_NUMBERED = 2000


def addressed(headers: DataFrame, periods_: DataFrame, sets: DataFrame, now_ms: float) -> DataFrame:
    """(doc_id, period_index, set_index, number, url, start, pdt): segments of each set's first representation, from its
    timeline or, without one, by number over the period (live: the part of it that is available at ``now_ms``)."""
    rows = sets.where("media_template is not null and representation is not null").join(headers.select("doc_id", "type", "ast_ms", "spd", "tsbd"), "doc_id")
    rows = rows.join(periods_.select("doc_id", "period_index", F.col("start").alias("period_start"), F.col("media_duration").alias("period_length")), ["doc_id", "period_index"])
    fields = lambda n, t: {"RepresentationID": F.col("representation"), "Bandwidth": F.coalesce("bandwidth", F.lit(0)), "Number": n, "Time": t}
    keep = ["doc_id", "period_index", "set_index", "ast_ms", "base_url", "media_template", "representation", "bandwidth", "timescale"]
    listed = timeline_segments(sets).join(rows.select(*keep), ["doc_id", "period_index", "set_index"]).withColumn("begin", F.col("t") / F.col("timescale"))
    each = F.col("segment_duration") / F.col("timescale")
    live = (F.col("type") == "dynamic") & F.col("ast_ms").isNotNull()
    edge = (F.lit(now_ms) - F.col("ast_ms")) / 1000 - F.coalesce(F.col("spd"), each * 2)
    length = F.nullif("period_length", F.lit(0.0))
    begin = F.when(live, F.greatest(F.col("period_start"), edge - F.coalesce("tsbd", F.lit(60.0)))).otherwise(F.col("period_start"))
    end = F.when(live, F.least(edge, F.col("period_start") + F.coalesce(length, F.lit(float("inf"))))).otherwise(F.col("period_start") + F.coalesce(length, each * 20))
    first, last = (F.floor((x - F.col("period_start")) / each).cast("long") for x in (begin, end))
    plain = rows.where((F.size("runs") == 0) & (each > 0)).withColumns({"k0": first, "k1": last, "_some": end > begin}).where("_some")
    plain = plain.withColumn("k", F.explode(F.sequence(F.col("k0"), F.least(F.col("k1"), F.col("k0") + MOST_NUMBERED - 1))))
    plain = plain.select(*keep, (F.col("start_number") + F.col("k")).alias("number"), F.round(F.col("pto") + F.col("k") * F.col("segment_duration")).cast("long").alias("t"), (F.col("period_start") + F.col("k") * each).alias("begin"))
    both = listed.select(*keep, "number", F.col("t").cast("long").alias("t"), "begin").unionByName(plain)
    url = F.concat("base_url", fill_template(F.col("media_template"), **fields(F.col("number"), F.col("t"))))
    return both.select("doc_id", "period_index", "set_index", "number", url.alias("url"), F.col("begin").alias("start"), (F.col("ast_ms") + F.col("begin") * 1000).alias("pdt"))
