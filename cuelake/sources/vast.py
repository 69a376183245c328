"""VAST and VMAP responses as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuelake.functions.text import clock_duration, given, number, skip_offset

_TEXT = "array<struct<_VALUE:string,_none:string>>"
_MEDIA = "array<struct<_VALUE:string,_type:string,_width:string,_height:string,_bitrate:string,_minBitrate:string,_maxBitrate:string,_delivery:string,_codec:string,_apiFramework:string>>"
_LINEAR = (
    "array<struct<_skipoffset:string,Duration:array<string>,TrackingEvents:array<struct<_none:string,Tracking:array<struct<_event:string,_offset:string,_VALUE:string>>>>,"
    f"MediaFiles:array<struct<_none:string,MediaFile:{_MEDIA}>>,VideoClicks:array<struct<_none:string,ClickThrough:array<string>>>>>"
)
_CREATIVE = f"array<struct<_id:string,_sequence:string,UniversalAdId:array<struct<_idRegistry:string,_VALUE:string>>,Linear:{_LINEAR},NonLinearAds:array<struct<_none:string,NonLinear:array<struct<_id:string>>>>,CompanionAds:array<struct<_none:string,Companion:array<struct<_id:string>>>>>>"
_BODY = f"array<struct<_followAdditionalWrappers:string,_allowMultipleAds:string,AdSystem:array<string>,AdTitle:array<string>,VASTAdTagURI:array<string>,Impression:array<string>,Error:array<string>,Creatives:array<struct<_none:string,Creative:{_CREATIVE}>>>>"
VAST = f"_version string, Error array<string>, Ad array<struct<_id:string,_sequence:string,InLine:{_BODY},Wrapper:{_BODY}>>"
VMAP = (
    "_version string, AdBreak array<struct<_timeOffset:string,_breakType:string,_breakId:string,"
    "AdSource:array<struct<_id:string,AdTagURI:array<struct<_VALUE:string,_templateType:string>>,VASTAdData:array<struct<_none:string,VAST:array<struct<_version:string>>>>>>>>"
)


def _first(array: Column) -> Column:
    return F.try_element_at(array, F.lit(1))


def _texts(array: Column) -> Column:
    return F.filter(F.transform(F.coalesce(array, F.array().cast("array<string>")), F.trim), lambda x: x != "")


#: Of a response only what its length is made of.
CREATIVE_LENGTHS = "array<struct<_none:string,Linear:array<struct<_none:string,Duration:array<string>>>>>"
_LENGTH = f"array<struct<_none:string,Creatives:array<struct<_none:string,Creative:{CREATIVE_LENGTHS}>>>>"
LENGTHS = f"Ad array<struct<_none:string,InLine:{_LENGTH},Wrapper:{_LENGTH}>>"


def responses(docs: DataFrame, schema: str = VAST) -> DataFrame:
    """(doc_id, readable, v): readable is whether the root is a VAST element."""
    readable = F.coalesce(F.col("body").rlike(r"<(?:[\w-]+:)?VAST[\s>/]"), F.lit(False))
    parsed = F.from_xml("body", schema, {"ignoreNamespace": "true", "rowTag": "VAST"})
    return docs.select("doc_id", readable.alias("readable"), F.when(readable, parsed).alias("v"))


def ads(found: DataFrame) -> DataFrame:
    rows = found.where("readable").select("doc_id", F.posexplode("v.Ad").alias("ad_index", "a"))
    body = F.coalesce(_first(F.col("a.InLine")), _first(F.col("a.Wrapper")))
    wrapper = F.col("a.Wrapper").isNotNull() & F.col("a.InLine").isNull()
    return rows.withColumn("b", body).select(
        "doc_id", "ad_index", F.col("a._id").alias("id"), number(F.col("a._sequence")).alias("sequence"), wrapper.alias("wrapper"), given(F.trim(_first(F.col("b.VASTAdTagURI")))).alias("ad_tag_uri"),
        F.trim(_first(F.col("b.AdSystem"))).alias("ad_system"), F.trim(_first(F.col("b.AdTitle"))).alias("ad_title"), _texts(F.col("b.Impression")).alias("impressions"), _texts(F.col("b.Error")).alias("errors"),
        F.when(wrapper, F.coalesce(F.col("b._followAdditionalWrappers") != "false", F.lit(True))).alias("follow"), F.when(wrapper, F.col("b._allowMultipleAds") == "true").alias("allow_multiple"),
        F.flatten(F.transform(F.col("b.Creatives"), lambda c: c["Creative"])).alias("creatives"),
    )


def creatives(found: DataFrame) -> DataFrame:
    rows = found.select("doc_id", "ad_index", "wrapper", F.posexplode("creatives").alias("creative_index", "c"))
    linear = _first(F.col("c.Linear"))
    rows = rows.withColumn("l", linear)
    duration = clock_duration(F.trim(_first(F.col("l.Duration"))))
    events = F.flatten(F.transform(F.col("l.TrackingEvents"), lambda t: F.coalesce(t["Tracking"], F.array().cast("array<struct<_event:string,_offset:string,_VALUE:string>>"))))
    none = F.array().cast("array<string>")
    return rows.select(
        "doc_id", "ad_index", "wrapper", "creative_index", F.col("c._id").alias("id"), number(F.col("c._sequence")).alias("sequence"),
        F.when(F.col("c.Linear").isNotNull(), "linear").when(F.col("c.NonLinearAds").isNotNull(), "nonlinear").when(F.col("c.CompanionAds").isNotNull(), "companion").otherwise("linear").alias("kind"),
        duration.alias("duration"), skip_offset(F.col("l._skipoffset"), duration).alias("skip_offset"), F.coalesce(F.transform(events, lambda e: e["_event"]), none).alias("tracking"),
        F.trim(_first(F.col("c.UniversalAdId"))["_VALUE"]).alias("universal_ad_id"), F.trim(_first(_first(F.col("l.VideoClicks"))["ClickThrough"])).alias("click_through"),
        F.coalesce(F.flatten(F.transform(F.col("l.MediaFiles"), lambda m: F.coalesce(m["MediaFile"], F.array().cast(_MEDIA)))), F.array().cast(_MEDIA)).alias("media"),
    )


def schedules(docs: DataFrame) -> DataFrame:
    """(doc_id, break_index, time_offset, offset_seconds, break_type, break_id, ad_tag_uri, has_data) of VMAP documents; a
    document without breaks has one row with a null index."""
    rooted = docs.where(F.col("body").rlike(r"<(?:[\w-]+:)?VMAP[\s>]"))
    rows = rooted.select("doc_id", F.from_xml("body", VMAP, {"ignoreNamespace": "true", "rowTag": "VMAP"}).alias("m"))
    rows = rows.select("doc_id", F.posexplode_outer("m.AdBreak").alias("break_index", "b"))
    source = _first(F.col("b.AdSource"))
    at = given(F.trim(F.col("b._timeOffset")))
    return rows.select(
        "doc_id", "break_index", at.alias("time_offset"), F.when(at.rlike(r"^\d+:\d"), clock_duration(at)).alias("offset_seconds"), F.col("b._breakType").alias("break_type"), F.col("b._breakId").alias("break_id"),
        given(F.trim(_first(source["AdTagURI"])["_VALUE"])).alias("ad_tag_uri"), F.coalesce(F.size(source["VASTAdData"]) > 0, F.lit(False)).alias("has_data"),
    )
