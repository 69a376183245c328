"""Findings on VAST and VMAP responses, and the walk along chains of wrappers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.functions.text import clock_duration, codec_family, is_video_codec, number
from cuelake.operators.findings import emit, rule
from cuelake.sources import vast

#: Events that a pod needs, and container types that can be spliced.
TRACKING = ("start", "firstQuartile", "midpoint", "thirdQuartile", "complete")
STITCHABLE = ("video/mp4", "video/mp2t", "video/m4v", "application/x-mpegurl", "application/dash+xml")
MOST_HOPS, SLOW_MS, FIT, ABOVE = 5, 2000, 0.5, 1.5

PROFILE = "doc_id string, codecs array<string>, bandwidths array<double>, avail_seconds double, server_side boolean"


def findings(docs: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """Findings of VAST documents (doc_id, body). ``profiles`` tells for a document the stream that it goes into: codecs,
    bandwidths, length of the avail, and whether it is stitched on a server (assumed so)."""
    responses = vast.responses(docs)
    found = vast.ads(responses)
    if profiles is None:
        profiles = docs.sparkSession.createDataFrame([], PROFILE)
    many = responses.where("readable").select("doc_id", F.coalesce(F.size("v.Ad"), F.lit(0)).alias("n"))
    out = emit(many, [rule(F.col("n") <= 0, "warning", "VAST_NO_FILL")])
    inline = ~F.col("wrapper")
    out = out.unionByName(
        emit(
            found,
            [
                rule(F.col("wrapper") & F.col("ad_tag_uri").isNull(), "error", "VAST_WRAPPER_NO_URI"),
                rule(inline & (F.size("impressions") == 0), "error", "VAST_NO_IMPRESSION"),
                rule(inline & (F.size("errors") == 0), "info", "VAST_NO_ERROR_URL"),
            ],
        )
    )
    rows = vast.creatives(found).where("not wrapper and kind = 'linear'").join(profiles, "doc_id", "left")
    none = F.array().cast("array<string>")
    missing = F.array_except(F.array(*map(F.lit, TRACKING)), F.col("tracking"))
    has_media = F.size("media") > 0
    runs = F.filter("media", lambda m: m["_apiFramework"].isNotNull() & (F.lower(m["_apiFramework"]) != "omid"))
    plain = F.filter("media", lambda m: m["_apiFramework"].isNull() & F.lower(m["_type"]).isin(*STITCHABLE))
    families = lambda codecs: F.array_distinct(F.transform(F.filter(codecs, lambda c: c.isNotNull() & is_video_codec(c)), codec_family))
    theirs, ours = families(F.coalesce("codecs", none)), families(F.transform(plain, lambda m: m["_codec"]))
    rates = F.filter(F.transform(plain, lambda m: F.coalesce(number(m["_bitrate"]), number(m["_maxBitrate"]))), lambda b: b > 0)
    server = F.coalesce("server_side", F.lit(True))
    out = out.unionByName(
        emit(
            rows,
            [
                rule(F.col("duration").isNull(), "error", "VAST_NO_DURATION"),
                rule((F.size("tracking") > 0) & (F.size(missing) > 0), "warning", "VAST_INCOMPLETE_TRACKING"),
                rule(F.size("tracking") == 0, "warning", "VAST_NO_TRACKING"),
                rule(~has_media, "error", "VAST_NO_MEDIA_FILE"),
                rule(has_media & (F.size(runs) > 0) & server, F.when(F.size(runs) == F.size("media"), "error").otherwise("warning"), "VAST_EXECUTABLE_CREATIVE"),
                rule(has_media & (F.size(plain) == 0) & (F.size(runs) != F.size("media")), "warning", "VAST_NO_STITCHABLE_MEDIA"),
                rule((F.size(theirs) > 0) & (F.size(ours) > 0) & ~F.arrays_overlap(theirs, ours), "warning", "VAST_CODEC_MISMATCH"),
                rule(F.array_min(rates) > F.array_max("bandwidths") / 1000 * ABOVE, "info", "VAST_BITRATE_ABOVE_LADDER"),
            ],
        )
    )
    total = rows.groupBy("doc_id", "avail_seconds").agg(F.sum(F.coalesce("duration", F.lit(0.0))).alias("total")).where("total > 0")
    delta = F.col("total") - F.col("avail_seconds")
    return out.unionByName(emit(total, [rule(delta > FIT, "error", "VAST_POD_OVERRUNS_AVAIL"), rule(delta < -FIT, "warning", "VAST_POD_UNDERFILLS_AVAIL")]))


def totals(docs: DataFrame) -> DataFrame:
    """Ads, wrappers and linear seconds of each readable response, which is parsed once and summed up by itself."""
    first = lambda array: F.try_element_at(array, F.lit(1))
    ads = F.col("v.Ad")
    bodies = F.transform(ads, lambda a: F.coalesce(first(a["InLine"]), first(a["Wrapper"])))
    creatives = F.flatten(F.transform(F.flatten(F.filter(F.transform(bodies, lambda b: b["Creatives"]), lambda c: c.isNotNull())), lambda c: F.coalesce(c["Creative"], F.array().cast(vast.CREATIVE_LENGTHS))))
    lengths = F.transform(creatives, lambda c: F.coalesce(clock_duration(F.trim(first(first(c["Linear"])["Duration"]))), F.lit(0.0)))
    rows = vast.responses(docs, vast.LENGTHS).where("readable")
    wrappers = F.size(F.filter(ads, lambda a: a["Wrapper"].isNotNull() & a["InLine"].isNull()))
    return rows.select(
        "doc_id", *[F.when(ads.isNull(), 0).otherwise(c).cast("long").alias(n) for n, c in (("ads", F.size(ads)), ("wrappers", wrappers))],
        F.coalesce(F.aggregate(lengths, F.lit(0.0), lambda a, x: a + x), F.lit(0.0)).alias("seconds"),
    )


def _pointers(rows: DataFrame) -> DataFrame:
    """(doc_id, next_url, next_follow) of the first wrapper that names an address."""
    first = vast.ads(vast.responses(rows)).where("wrapper and ad_tag_uri is not null").groupBy("doc_id")
    return first.agg(F.min_by(F.struct("ad_tag_uri", "follow"), "ad_index").alias("w")).select("doc_id", F.col("w.ad_tag_uri").alias("next_url"), F.col("w.follow").alias("next_follow"))


def wrapper_chains(docs: DataFrame, fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Hops and findings of the chain from each document's first wrapper that names an address. ``fetched`` has
    (url, ok, body, ms) of known responses. Each response is read once; MOST_HOPS joins then follow the addresses, and a
    row keeps what it met on its way."""
    own = _pointers(fetched.select(F.col("url").alias("doc_id"), "body")).withColumnRenamed("doc_id", "url")
    known = fetched.select("url", F.coalesce("ok", F.lit(False)).alias("good"), F.coalesce(F.col("body").rlike(r"<(?:[\w-]+:)?VAST[\s>/]"), F.lit(False)).alias("readable"), "ms").join(own, "url", "left")
    none = F.array().cast("array<string>")
    log = F.array().cast("array<struct<depth:int,url:string,ok:boolean,ms:double,codes:array<string>>>")
    state = _pointers(docs).select("doc_id", F.col("next_url").alias("url"), F.col("next_follow").alias("follow"), none.alias("seen"), F.lit(0.0).alias("total_ms"), log.alias("log"))
    for depth in range(1, MOST_HOPS + 1):
        rows = state.join(known, "url", "left")
        on, loop, good = F.col("url").isNotNull(), F.array_contains("seen", F.col("url")), F.coalesce("good", F.lit(False))
        here, total = on & ~loop, F.col("total_ms") + F.coalesce("ms", F.lit(0.0))
        met = F.array_compact(F.array(
            F.when(loop, "VAST_WRAPPER_LOOP"), F.when(~loop & ~good, "VAST_WRAPPER_UNRESOLVED"), F.when(~loop & good & ~F.col("readable"), "VAST_WRAPPER_UNPARSEABLE"),
            F.when(~loop & (total > SLOW_MS) & (F.col("total_ms") <= SLOW_MS), "VAST_CHAIN_SLOW"),
        ))
        entry = F.struct(F.when(here, F.lit(depth)).alias("depth"), F.col("url").alias("url"), good.alias("ok"), F.col("ms").cast("double").alias("ms"), met.alias("codes"))
        goes_on = here & good & F.col("readable") & F.coalesce("follow", F.lit(True))
        state = rows.select(
            "doc_id", F.when(goes_on, F.col("next_url")).alias("url"), F.col("next_follow").alias("follow"), F.when(on, F.concat("seen", F.array("url"))).otherwise(F.col("seen")).alias("seen"),
            F.when(here, total).otherwise(F.col("total_ms")).alias("total_ms"), F.when(on, F.concat("log", F.array(entry))).otherwise(F.col("log")).alias("log"),
        )
    none_of = lambda kind: F.lit(None).cast(kind)
    deep = F.struct(none_of("int").alias("depth"), F.col("url").alias("url"), none_of("boolean").alias("ok"), none_of("double").alias("ms"), F.array(F.lit("VAST_WRAPPER_TOO_DEEP")).alias("codes"))
    walked = state.select("doc_id", F.explode(F.when(F.col("url").isNotNull(), F.concat("log", F.array(deep))).otherwise(F.col("log"))).alias("x"))
    hops = walked.where("x.depth is not null").select("doc_id", "x.depth", "x.url", "x.ok", "x.ms")
    code = F.col("code")
    found = walked.select("doc_id", F.explode("x.codes").alias("code"))
    return hops, emit(found, [rule(F.lit(True), F.when(code == "VAST_CHAIN_SLOW", "warning").otherwise("error"), code)])


def schedule_findings(docs: DataFrame) -> DataFrame:
    rows = vast.schedules(docs)
    known = F.col("break_index").isNotNull()
    out = emit(
        rows,
        [
            rule(~known, "warning", "VMAP_NO_BREAKS"),
            rule(known & F.col("time_offset").isNull(), "error", "VMAP_NO_TIME_OFFSET", index=F.col("break_index")),
            rule(known & F.col("ad_tag_uri").isNull() & ~F.col("has_data"), "error", "VMAP_NO_AD_SOURCE", index=F.col("break_index")),
        ],
    )
    twice = rows.where("time_offset is not null").groupBy("doc_id", "time_offset").agg(F.count("*").alias("n"), F.max("break_index").alias("break_index"))
    return out.unionByName(emit(twice, [rule(F.col("n") > 1, "warning", "VMAP_DUPLICATE_OFFSET", index=F.col("break_index"))]))
