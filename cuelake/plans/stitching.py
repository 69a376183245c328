"""A signalling feed against its stitched output: which avails were filled, and how well."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions.text import media_shape
from cuelake.operators.findings import emit, rule
from cuelake.operators.matching import exclusive
from cuelake.runtime import dropped, written

#: Seconds: a counterpart's largest distance; tolerance of a fill and of an alignment.
MATCH, FILL, ALIGN = 6.0, 0.5, 0.5
#: What an avail shows of its break.
SHOWN = ("start_time", "pdt", "event_id", "segmentation_type")


@dataclass
class Comparison:
    """What was compared; ``release`` gives up the tables below, after which none of these can be read."""

    avails: DataFrame
    findings: DataFrame
    summary: DataFrame
    release: Callable[[], None] = lambda: None


def compare(pairs: DataFrame, breaks: DataFrame, stats: DataFrame, segments: DataFrame) -> Comparison:
    """``pairs``: (pair_id, source_id, output_id) of documents. Only the time that both windows cover is compared;
    every source avail takes the nearest free output break within MATCH seconds, in the order of the source."""
    sides = pairs.select("pair_id", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_id").alias("doc_id")) for s in ("source", "output")])).alias("x"))
    sides = sides.select("pair_id", "x.side", "x.doc_id")
    span = sides.join(stats.select("doc_id", "window_start_pdt", "window_end_pdt"), "doc_id").groupBy("pair_id").agg(
        F.when(F.count(F.col("window_start_pdt") + F.col("window_end_pdt")) == 2, F.max("window_start_pdt")).alias("from"),
        F.when(F.count(F.col("window_start_pdt") + F.col("window_end_pdt")) == 2, F.min("window_end_pdt")).alias("to"),
    )
    length = F.coalesce("signalled_duration", "actual_duration", F.lit(0.0)) * 1000
    inside = F.col("pdt").isNull() | F.col("from").isNull() | ((F.col("pdt") >= F.col("from")) & (F.col("pdt") + length <= F.col("to") + MATCH * 1000))
    own = sides.join(span, "pair_id", "left").join(breaks.where("not window_clipped"), "doc_id")
    # written, since the clock, the matches and the avails of both sides are all read from it
    own = all_breaks = written(own.select(
        "pair_id", "side", "doc_id", "index", "start_time", "pdt", "event_id", "segmentation_type", "signalled_duration", "actual_duration",
        "discontinuity_at_start", "media_uris", F.coalesce(F.col("signal.ok"), F.lit(False)).alias("carries_signal"), inside.alias("inside"),
    ))
    clock = own.groupBy("pair_id").agg(F.bool_and(F.col("pdt").isNotNull()).alias("clocked"))
    frame = pairs.select("pair_id").join(clock, "pair_id", "left").join(span, "pair_id", "left").withColumn("clocked", F.coalesce("clocked", F.lit(True)))
    found = emit(frame, [rule(~F.col("clocked"), "error", "NO_COMMON_CLOCK"), rule(F.col("to") <= F.col("from"), "error", "NO_OVERLAPPING_WINDOW")], ("pair_id",))
    own = own.where("inside").drop("inside")
    source, output = own.where("side = 'source'"), own.where("side = 'output'")
    clocked = lambda rows: rows.where("pdt is not null").select("pair_id", F.col("index").alias("id"), F.lit(None).alias("name"), (F.col("pdt") / 1000).alias("at"))
    met = exclusive(clocked(source), clocked(output), ["pair_id"], MATCH)
    shown = F.collect_set(media_shape(F.col("uri")))
    within = output.select("pair_id", "doc_id", F.explode("media_uris").alias("uri")).distinct()
    content = segments.join(sides.where("side = 'output'"), "doc_id").join(within, ["pair_id", "doc_id", "uri"], "left_anti")
    content = content.groupBy("pair_id").agg(shown.alias("around"))
    theirs = output.join(content, "pair_id", "left").select(
        "pair_id", F.col("index").cast("long").alias("right_id"), *[F.col(c).alias(f"their_{c}") for c in SHOWN], F.coalesce("actual_duration", "signalled_duration").alias("stitched"), F.col("discontinuity_at_start").alias("marked"),
        F.when((F.size("media_uris") > 0) & (F.size("around") > 0), ~F.arrays_overlap(F.transform("media_uris", media_shape), F.col("around"))).alias("substituted"),
    )
    signalled = F.coalesce("signalled_duration", "actual_duration")
    place = F.row_number().over(Window.partitionBy("pair_id").orderBy("index")) - 1
    asked = source.select(
        "pair_id", F.col("index").cast("long").alias("left_id"), place.alias("place"), "start_time", "pdt", "event_id", "segmentation_type", signalled.alias("signalled"),
    )
    # an avail is one of the source with what it took, or one of the output that none took
    rows = asked.join(met, ["pair_id", "left_id"], "left").join(theirs, ["pair_id", "right_id"], "full")
    extra = F.col("place").isNull()
    delta = F.col("stitched") - F.col("signalled")
    status = (
        F.when(extra, "unsignalled").when(F.col("distance").isNull(), "not-stitched").when(F.col("stitched").isNull() | F.col("signalled").isNull(), "unmeasurable").when(~F.col("substituted"), "passthrough")
        .when(F.abs(delta) <= FILL, "filled").when(delta < 0, "under-filled").otherwise("over-filled")
    )
    either = lambda c: F.when(extra, F.col(f"their_{c}")).otherwise(F.col(c)).alias(c)
    avails = rows.select(
        "pair_id", F.when(extra, F.col("right_id").cast("int")).otherwise(F.col("place")).alias("index"), *map(either, SHOWN), "signalled", "stitched", "marked",
        F.when(~extra, F.col("substituted")).alias("substituted"), F.col("distance").alias("alignment"), delta.alias("delta"), F.when(F.col("signalled") > 0, F.col("stitched") / F.col("signalled")).alias("fill_ratio"), status.alias("status"),
    )
    at = {"index": F.col("index"), "at": F.col("start_time")}
    is_ = lambda s: F.col("status") == s
    found = found.unionByName(
        emit(
            avails,
            [
                rule(is_("not-stitched"), "error", "AVAIL_NOT_STITCHED", **at),
                rule(F.col("alignment") > ALIGN, "error", "STITCH_MISALIGNED", **at),
                rule(~F.col("substituted"), "error", "AVAIL_PASSED_THROUGH", **at),
                rule(is_("under-filled"), "warning", "AVAIL_UNDER_FILLED", **at),
                rule(is_("over-filled"), "warning", "AVAIL_OVER_FILLED", **at),
                rule(~is_("unsignalled") & ~F.col("marked"), "warning", "STITCH_NOT_MARKED", **at),
                rule(is_("unsignalled"), "warning", "UNSIGNALLED_AVAIL_IN_OUTPUT", at=F.col("start_time")),
            ],
            ("pair_id",),
        )
    )
    both = source.select("pair_id").distinct().join(output.where("carries_signal").select("pair_id").distinct(), "pair_id")
    found = found.unionByName(emit(both, [rule(F.lit(True), "info", "SIGNAL_PASSED_THROUGH")], ("pair_id",)))
    n = lambda s, name: F.count_if(is_(s)).alias(name)
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0.0))
    summary = pairs.select("pair_id").join(avails, "pair_id", "left").groupBy("pair_id").agg(
        F.count_if(~is_("unsignalled")).alias("signalled"), n("filled", "filled"), n("not-stitched", "not_stitched"), n("under-filled", "under_filled"),
        n("over-filled", "over_filled"), n("passthrough", "passthrough"), n("unsignalled", "unsignalled"),
        total("signalled", ~is_("unsignalled")).alias("signalled_seconds"), total("stitched", ~is_("unsignalled") & ~is_("passthrough")).alias("stitched_seconds"),
    )
    rate = F.when(F.col("signalled_seconds") > 0, F.col("stitched_seconds") / F.col("signalled_seconds")).otherwise(0.0)
    return Comparison(avails, found, summary.withColumn("fill_rate", rate), lambda: dropped(all_breaks))
