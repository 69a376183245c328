"""Analysis of DASH manifests: timeline, events, breaks and findings."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import splice
from cuelake.functions.text import number
from cuelake.operators.findings import emit, rule, told, verdicts
from cuelake.operators.matching import InTurn, exclusive
from cuelake.runtime import Tables
from cuelake.sources import dash

#: Seconds: gaps, skews, presentation offsets, a latency that differs, a window without a stated depth.
GAP_WARN, GAP_ERROR, SKEW_INFO, SKEW_WARN, PTO, LATENCY, DEPTH = 0.05, 0.5, 0.04, 0.1, 0.001, 1.0, 3600.0


class DashAnalysis(Tables):
    """The tables of an analysis of MPDs (doc_id, body), made when asked for; those that feed others are
    written, until ``release``."""

    def __init__(self, docs: DataFrame):
        super().__init__()
        self.docs = docs

    @cached_property
    def parsed(self) -> DataFrame:
        return self._written(dash.parsed(self.docs))

    @cached_property
    def headers(self) -> DataFrame:
        found = dash.headers(self.parsed)
        chunked = self.sets.groupBy("doc_id").agg(F.bool_or((F.col("at_complete") == F.lit(False)) | (F.col("ato") > 0)).alias("chunked"))
        return self._written(found.join(chunked, "doc_id", "left").withColumn("chunked", F.coalesce("chunked", F.lit(False))))

    @cached_property
    def sets(self) -> DataFrame:
        return self._written(dash.adaptation_sets(self.parsed))

    @cached_property
    def periods(self) -> DataFrame:
        return self._written(dash.periods(self.parsed, self.sets))

    @cached_property
    def signals(self) -> DataFrame:
        return self._written(signals_of(dash.events(self.parsed), self.periods))

    @cached_property
    def unique(self) -> DataFrame:
        return self._written(deduplicated(self.signals))

    @cached_property
    def breaks(self) -> DataFrame:
        return self._written(breaks_of(self.unique))

    @cached_property
    def coded(self) -> DataFrame:
        """Findings of all rules, without words."""
        return self._written(
            _header_rules(self.headers, self.sets, self.periods)
            .unionByName(_period_rules(self.periods))
            .unionByName(_set_rules(self.periods))
            .unionByName(_structure_rules(self.periods))
            .unionByName(_event_rules(self.signals, self.unique))
            .unionByName(_break_rules(self.breaks))
            .unionByName(_orphans(self.unique, self.breaks))
        )

    @cached_property
    def findings(self) -> DataFrame:
        return told(self.coded)

    @cached_property
    def stats(self) -> DataFrame:
        return stats_of(self.headers, self.periods, self.unique, self.breaks)

    @cached_property
    def verdicts(self) -> DataFrame:
        return verdicts(self.docs, self.coded)


def analyse(docs: DataFrame) -> DashAnalysis:
    return DashAnalysis(docs)


def signals_of(events: DataFrame, periods: DataFrame) -> DataFrame:
    """SCTE-35 events with what they say: type_id, event_id and length; start or end by type. They have what breaks ask of
    their period and manifest. Rows of both sides grow with the manifests, and a file of them is much smaller than they are in
    memory: ``merge`` keeps Spark from taking it for a table to broadcast, here and below."""
    scte = F.col("payload").isNotNull()
    for scheme in dash.SCTE35_SCHEMES:
        scte = scte | F.col("scheme").startswith(scheme)
    own = periods.where("stream_count > 0").select(
        "doc_id", "period_index", F.col("start").alias("period_start"), F.col("id").alias("period_id"), "type", "ast_ms", "mup", "period_count", "media_templates", "video_segments",
        F.coalesce("declared_duration", "media_duration").alias("period_length"),
    )
    rows = events.join(own.hint("merge"), ["doc_id", "period_index"])
    rows = rows.withColumns({"is_scte": scte, "signal": F.when(scte & F.col("payload").isNotNull(), splice.decode_section(F.col("payload")))})
    of = lambda ids: F.try_element_at(F.filter(splice.segmentation(F.col("signal")), lambda d: d["type_id"].isin(*ids)), F.lit(1))
    lead = F.coalesce(of(splice.START_TYPES), of(splice.END_TYPES), F.try_element_at(splice.segmentation(F.col("signal")), F.lit(1)))
    insert = F.col("signal.splice_insert")
    own = F.when(~insert["cancel"], insert)
    kind = F.coalesce(lead["type_id"], F.when(own.isNotNull(), F.when(own["out_of_network"], 0x30).otherwise(0x31)), number(F.col("vendor_type")).cast("int"))
    rows = rows.withColumns({
        "type_id": kind,
        "event_id": F.coalesce(lead["event_id"], F.when(lead.isNull(), own["event_id"])),
        "signal_length": F.coalesce(lead["duration_ticks"], F.when(lead.isNull(), own["break_ticks"])) / splice.TICKS,
        "at": F.col("period_start") + F.col("presentation_time"),
    })
    return rows.withColumns({"is_start": F.col("type_id").isin(*splice.START_TYPES), "is_end": F.col("type_id").isin(*splice.END_TYPES)})


def deduplicated(signals: DataFrame) -> DataFrame:
    """One of each signal that several streams carry, the standard's own scheme first, at the place of the first one;
    ord is the order in the document."""
    key = ["doc_id", "period_index", F.coalesce(F.col("type_id").cast("string"), F.lit("?")), F.coalesce(F.col("event_id").cast("string"), F.lit("?")), "presentation_time", F.coalesce("payload", F.lit(""))]
    place = F.struct("stream_index", "event_index")
    rank = F.when(F.col("scheme").startswith("urn:scte:scte35"), 0).otherwise(1)
    own = Window.partitionBy(*key)
    rows = signals.where("is_scte").withColumns({"_n": F.row_number().over(own.orderBy(rank, "stream_index", "event_index")), "place": F.min(place).over(own)})
    order = Window.partitionBy("doc_id").orderBy("period_index", "place")
    return rows.where("_n = 1").withColumn("ord", F.row_number().over(order)).drop("_n")


def breaks_of(unique: DataFrame) -> DataFrame:
    """Each start takes the first free end of its event id in its period or later, or else the first free one of a later
    period."""
    side = lambda when: unique.where(when).select("doc_id", F.col("ord").alias("id"), F.col("event_id").cast("string").alias("name"), F.col("period_start").alias("at"))
    taken = exclusive(side("is_start"), side("is_end"), ["doc_id"], taking=InTurn, order="at")
    ends = unique.select("doc_id", F.col("ord").alias("end_ord"), F.col("at").alias("end_at"))
    taken = taken.select("doc_id", F.col("left_id").alias("ord"), F.col("right_id").alias("end_ord")).join(ends.hint("merge"), ["doc_id", "end_ord"])
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("period_start", "ord")) - 1
    matched = unique.where("is_start").select("doc_id", "ord", place.alias("index")).join(taken, ["doc_id", "ord"], "left")
    rows = matched.join(unique.hint("merge"), ["doc_id", "ord"])
    declared = F.coalesce("signal_length", "duration")
    ended, bounded = F.col("end_ord").isNotNull(), F.col("end_ord").isNull() & declared.isNotNull()
    auto = F.coalesce(F.col("signal.splice_insert.auto_return"), F.lit(False))
    live = F.col("type") == "dynamic"
    return rows.select(
        "doc_id", "index", "period_index", "period_id", F.col("at").alias("start_time"), (F.col("ast_ms") + F.col("at") * 1000).alias("pdt"), declared.alias("signalled_duration"),
        F.when(ended, F.col("end_at") - F.col("at")).when(bounded, declared).alias("actual_duration"), (ended | bounded).alias("closed"),
        F.when(ended, "end event").when(bounded & auto, "auto_return duration").when(bounded, "declared duration").alias("bounded_by"),
        (~ended & ~bounded & live & (F.col("period_index") == F.col("period_count") - 1)).alias("in_progress"), F.col("video_segments").alias("segment_count"), F.col("media_templates").alias("media_uris"),
        F.lit(True).alias("discontinuity_at_start"), F.lit(False).alias("window_clipped"), "signal", "event_id", F.col("type_id").alias("segmentation_type"), "end_ord", "presentation_time", "period_start", "period_length", "period_count", live.alias("live"), "mup",
    )


def _live(h: str = "type") -> Column:
    return F.col(h) == "dynamic"


def _header_rules(headers: DataFrame, sets: DataFrame, periods: DataFrame) -> DataFrame:
    longest = sets.groupBy("doc_id").agg(
        F.max(F.coalesce("first_length", F.col("segment_duration") / F.col("timescale"))).alias("longest"),
        F.bool_or((F.col("ato") > F.coalesce("first_length", F.col("segment_duration") / F.col("timescale")) / 2) & F.coalesce("at_complete", F.lit(True))).alias("early"),
    )
    per = periods.groupBy("doc_id").agg(
        F.max("stream_count").alias("streams"), F.count("asset_identifier").alias("assets"), F.bool_or(F.exists("inband", lambda s: F.lower(s).contains("scte35"))).alias("inband")
    )
    rows = headers.join(longest, "doc_id", "left").join(per, "doc_id", "left")
    target = F.col("target_ms") / 1000
    low = F.col("chunked") | F.col("has_latency")
    return emit(
        rows,
        [
            rule(_live() & F.col("mup").isNull(), "error", "DYNAMIC_NO_MUP"),
            rule(_live() & F.col("ast_ms").isNull(), "error", "DYNAMIC_NO_AST"),
            rule(F.col("period_count") == 0, "error", "NO_PERIODS"),
            rule(F.col("chunked") & target.isNull(), "warning", "LL_DASH_NO_LATENCY_TARGET"),
            rule(low & ~F.col("chunked") & (target < F.col("longest")), "error", "LL_DASH_TARGET_UNREACHABLE"),
            rule(low & (F.abs(F.col("spd") - target) > LATENCY), "warning", "LL_DASH_DELAY_DISAGREEMENT"),
            rule(low & F.col("early"), "warning", "LL_DASH_EARLY_AVAILABILITY_WITHOUT_CHUNKING"),
            rule(low & target.isNotNull() & (F.col("streams") > 0), "info", "LL_AD_DECISION_BUDGET"),
            rule(F.col("inband"), "info", "INBAND_EVENT_STREAM_DECLARED"),
            rule((F.col("period_count") > 1) & (F.coalesce("assets", F.lit(0)) == 0), "info", "NO_ASSET_IDENTIFIER"),
        ],
    )


def _period_rules(periods: DataFrame) -> DataFrame:
    gap = F.col("next_start") - (F.col("media_start") + F.col("media_duration"))
    known = ~(F.col("is_placeholder") & F.col("declared_duration").isNull())
    grade = F.when(F.abs(gap) > GAP_ERROR, "error").otherwise("warning")
    trim, first = F.col("media_start") - F.col("start"), (F.col("period_index") == 0) & _live()
    anchored = first & (trim > F.coalesce("tsbd", F.lit(DEPTH)))
    edge = _live() & (F.col("period_index") == F.col("period_count") - 1)
    remote, at = F.col("xlink_href").isNotNull(), F.col("start")
    return emit(
        periods,
        [
            rule(F.col("id").isNull(), "warning", "PERIOD_MISSING_ID", at=at),
            rule(known & (gap > GAP_WARN), grade, "PERIOD_TIMELINE_GAP", at=at),
            rule(known & (gap < -GAP_WARN), grade, "PERIOD_TIMELINE_OVERLAP", at=at),
            rule((trim > GAP_WARN) & first & ~anchored, "info", "PERIOD_TRIMMED_AT_WINDOW", at=at),
            rule((trim > GAP_WARN) & ~first, "warning", "PERIOD_MEDIA_STARTS_LATE", at=at),
            rule((F.col("skew") > SKEW_INFO) & ~edge, F.when(F.col("skew") > SKEW_WARN, "warning").otherwise("info"), "AV_DURATION_SKEW", at=at),
            rule(remote, "info", "XLINK_REMOTE_PERIOD", at=at),
            rule(F.col("is_placeholder") & F.col("declared_duration").isNull(), F.when(_live(), "error").otherwise("warning"), "XLINK_NO_DURATION", at=at),
            rule(remote & F.col("xlink_actuate").isNull(), "warning", "XLINK_NO_ACTUATE", at=at),
            rule(remote & (F.col("xlink_actuate") == "onLoad") & _live() & F.col("mup").isNotNull(), "warning", "XLINK_ONLOAD_ON_LIVE", at=at),
            rule((F.col("media_duration") == 0) & (F.col("uniform_sets") == 0) & ~F.col("is_placeholder"), "warning", "EMPTY_PERIOD", at=at),
        ],
    ).unionByName(
        emit(
            periods.where("id is not null").groupBy("doc_id", "id").agg(F.count("*").alias("n"), F.max("start").alias("start")),
            [rule(F.col("n") > 1, "error", "DUPLICATE_PERIOD_ID", at=F.col("start"))],
        )
    )


def _set_rules(periods: DataFrame) -> DataFrame:
    rows = periods.select("doc_id", "start", F.explode("offsets").alias("offset"))
    return emit(rows, [rule(F.abs(F.col("offset") - F.col("start")) > PTO, "error", "PTO_MISMATCH", at=F.col("start"))])


def _structure_rules(periods: DataFrame) -> DataFrame:
    """Neighbouring periods, neither of them a placeholder, by their representations."""
    rows = periods.where("next_start is not null and not is_placeholder and not next_is_placeholder")
    changed = F.col("signature") != F.col("next_signature")
    found = emit(rows, [rule(changed, "error", "REPRESENTATION_SET_CHANGED", at=F.col("next_start"))])
    silent = rows.where(~changed & ~F.coalesce("next_is_continuous", F.lit(False))).select("doc_id").distinct()
    return found.unionByName(emit(silent, [rule(F.lit(True), "warning", "NO_PERIOD_CONTINUITY_SIGNAL")]))


def _event_rules(signals: DataFrame, unique: DataFrame) -> DataFrame:
    at = F.col("period_start")
    ok = F.col("signal.ok")
    found = emit(signals.where("signal is not null"), [rule(~ok, "error", "SCTE35_DECODE_FAILED", at=at), rule(ok & ~F.col("signal.crc_valid"), "warning", "SCTE35_CRC_INVALID", at=at)])
    counts = signals.where("is_scte").groupBy("doc_id").agg(F.count("*").alias("all")).join(unique.groupBy("doc_id").agg(F.count("*").alias("own")), "doc_id")
    found = found.unionByName(emit(counts, [rule(F.col("all") > F.col("own"), "info", "DUPLICATE_EVENT_STREAMS")]))
    per = signals.groupBy("doc_id", "type", "period_index", "scheme").agg(F.bool_or(F.col("id").isNull()).alias("nameless"), F.count_if(~F.col("pt_explicit")).alias("implicit"))
    schemes = per.groupBy("doc_id", "type", "scheme").agg(F.bool_or("nameless").alias("nameless"), F.max("implicit").alias("implicit"))
    return found.unionByName(emit(schemes, [rule(_live() & F.col("nameless"), "warning", "EVENT_MISSING_ID"), rule(F.col("implicit") > 1, "warning", "EVENT_AMBIGUOUS_TIME")]))


def _break_rules(breaks: DataFrame) -> DataFrame:
    at = {"index": F.col("index"), "at": F.col("start_time")}
    ended = F.col("end_ord").isNotNull()
    delta = F.col("actual_duration") - F.col("signalled_duration")
    grade = F.when(F.abs(delta) > GAP_ERROR, "warning").otherwise("info")
    margin = F.greatest(F.lit(GAP_ERROR), F.coalesce("mup", F.lit(6.0)) * 2)
    past = F.col("start_time") + F.col("signalled_duration") + margin
    alone = (F.col("period_count") > 1) & (F.col("presentation_time") <= GAP_ERROR)
    stays = (past >= F.col("period_start")) & (past < F.col("period_start") + F.col("period_length"))
    found = emit(
        breaks,
        [
            rule(F.col("in_progress"), "info", "BREAK_IN_PROGRESS", **at),
            rule(~F.col("closed") & ~F.col("in_progress"), "error", "UNCLOSED_BREAK", **at),
            rule(~ended & F.col("closed") & F.col("live") & alone & stays, "error", "BREAK_OVERRUN_UNCLOSED", **at),
            rule(ended & (delta > GAP_WARN), grade, "BREAK_OVERRUN", **at),
            rule(ended & (delta < -GAP_WARN), grade, "BREAK_UNDERRUN", **at),
        ],
    )
    problems = breaks.select("doc_id", "index", "start_time", F.explode(splice.segmentation(F.col("signal"))).alias("d"))
    code = splice.upid_problem(F.col("d.upid_type"), F.col("d.upid_hex"), F.coalesce(F.col("d.upid_text"), F.lit("")))
    found = found.unionByName(emit(problems.withColumn("c", code), [rule(F.col("c").isNotNull(), "warning", F.col("c"), **at)]))
    shortest = breaks.groupBy("doc_id", "live", "mup").agg(F.min("actual_duration").alias("shortest"))
    return found.unionByName(emit(shortest, [rule(F.col("live") & (F.col("mup") > F.col("shortest")), "warning", "MUP_LONGER_THAN_SHORTEST_BREAK")]))


def _orphans(unique: DataFrame, breaks: DataFrame) -> DataFrame:
    """Ends that no start takes, but for those of the oldest period."""
    used = breaks.where("end_ord is not null").select("doc_id", F.col("end_ord").cast("int").alias("ord")).hint("merge")
    free = unique.where("is_end and period_index > 0").join(used, ["doc_id", "ord"], "left_anti")
    return emit(free, [rule(F.lit(True), "warning", "ORPHAN_BREAK_END", at=F.col("period_start"))])


def stats_of(headers: DataFrame, periods: DataFrame, unique: DataFrame, breaks: DataFrame) -> DataFrame:
    span = periods.groupBy("doc_id").agg(
        F.sum("video_segments").alias("segment_count"), (F.max(F.col("media_start") + F.col("media_duration")) - F.min("media_start")).alias("span"), F.min_by("media_start", "period_index").alias("from"),
        F.max_by(F.col("start") + F.col("media_duration"), "period_index").alias("to"),
    )
    ads = breaks.groupBy("doc_id").agg(F.count("*").alias("break_count"), F.sum("actual_duration").alias("ad_seconds"))
    full = headers.join(span, "doc_id", "left").join(unique.groupBy("doc_id").agg(F.count("*").alias("marker_count")), "doc_id", "left").join(ads, "doc_id", "left")
    window = F.when(F.coalesce("span", F.lit(0.0)) > 0, F.col("span")).when(_live(), F.col("tsbd")).otherwise(0.0)
    seconds = F.coalesce("ad_seconds", F.lit(0.0))
    return full.select(
        "doc_id", F.coalesce("segment_count", F.lit(0)).alias("segment_count"), F.coalesce(window, F.lit(0.0)).alias("window_duration"), F.coalesce("marker_count", F.lit(0)).alias("marker_count"), F.coalesce("break_count", F.lit(0)).alias("break_count"),
        seconds.alias("ad_seconds"), F.when(window > 0, seconds / window * 100).otherwise(0.0).alias("ad_percent"), F.col("ast_ms").isNotNull().alias("has_pdt"), _live().alias("live"), (F.coalesce("spd", F.lit(99.0)) < 5).alias("low_latency"),
        (F.col("ast_ms") + F.col("from") * 1000).alias("window_start_pdt"), (F.col("ast_ms") + F.col("to") * 1000).alias("window_end_pdt"),
    )
