"""SCTE-224 policies as tables of media points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.functions import splice
from cuelake.functions.text import given, iso_duration, iso_millis

_POINT = (
    "array<struct<_id:string,_effective:string,_expires:string,_matchTime:string,_matchDateTime:string,_matchOffset:string,_expectedDuration:string,_source:string,"
    "Signal:array<struct<_none:string,Binary:array<string>,SCTE35:array<string>,SpliceInfoSection:array<string>,SignalPointID:array<string>>>,"
    "Apply:array<struct<_policy:string,Policy:array<string>>>,Remove:array<struct<_policy:string,Policy:array<string>>>>>"
)
MEDIA = f"_id string, _source string, _effective string, _expires string, MediaPoint {_POINT}"
LISTED = f"_id string, Media array<struct<_id:string,MediaPoint:{_POINT}>>"


def points(docs: DataFrame) -> DataFrame:
    """(doc_id, ordinal, point_id, effective, expires, match_at, expected, signal, applies, removes); times are epoch
    milliseconds. The root may be one Media, or a list of them."""
    head = F.substring("body", 1, 4000)
    options = {"ignoreNamespace": "true"}
    one = F.from_xml("body", MEDIA, options | {"rowTag": "Media"})["MediaPoint"]
    many = F.from_xml("body", LISTED, options | {"rowTag": "MediaList"})["Media"]
    listed = head.rlike(r"<(?:[\w-]+:)?MediaList[\s>]")
    rows = docs.where(head.rlike(r"<(?:[\w-]+:)?(Media|MediaList|Audience)[\s>]"))
    rows = rows.select("doc_id", F.when(listed, F.flatten(F.transform(many, lambda m: F.coalesce(m["MediaPoint"], F.array().cast(_POINT))))).otherwise(one).alias("all"))
    rows = rows.select("doc_id", F.posexplode("all").alias("ordinal", "p"))
    p = F.col("p")
    raw = F.flatten(F.transform(p["Signal"], lambda s: F.concat(*[F.coalesce(s[k], F.array().cast("array<string>")) for k in ("Binary", "SCTE35", "SpliceInfoSection")])))
    policies = lambda c: F.filter(F.transform(F.coalesce(c, F.array().cast("array<struct<_policy:string,Policy:array<string>>>")), lambda a: F.coalesce(a["_policy"], F.try_element_at(a["Policy"], F.lit(1)))), lambda x: x.isNotNull() & (x != ""))
    length = lambda c: F.nullif(iso_duration(F.regexp_replace(F.regexp_replace(F.trim(c), "^P?T?", "PT"), "^PT$", "")), F.lit(0.0))
    payload = given(F.regexp_replace(F.try_element_at(raw, F.lit(-1)), r"\s+", ""))
    return rows.select(
        "doc_id", "ordinal", p["_id"].alias("point_id"), iso_millis(p["_effective"]).alias("effective"), iso_millis(p["_expires"]).alias("expires"),
        (iso_millis(F.coalesce(p["_matchTime"], p["_matchDateTime"])) + F.coalesce(length(p["_matchOffset"]), F.lit(0.0)) * 1000).alias("match_at"), length(p["_expectedDuration"]).alias("expected"), p["_source"].alias("source"),
        F.when(payload.isNotNull(), splice.decode_section(payload)).alias("signal"), policies(p["Apply"]).alias("applies"), policies(p["Remove"]).alias("removes"),
        F.flatten(F.transform(p["Signal"], lambda s: F.coalesce(s["SignalPointID"], F.array().cast("array<string>")))).alias("signal_points"),
    )
