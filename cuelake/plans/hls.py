"""Analysis of HLS media playlists: breaks, findings, statistics, and the comparison of renditions."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions import splice
from cuelake.functions.text import container, exact, given, iso_millis, number
from cuelake.operators.findings import emit, emit_array, rule, told, verdicts
from cuelake.operators.pairing import nearest, paired
from cuelake.runtime import Tables
from cuelake.sources import hls

#: Seconds: general tolerance; slack of a target duration; a segment at the front of a window.
EPS, SLACK = 0.5, 0.001
VALUES = {"CUE": ("PRE", "POST", "ONCE"), "X-SNAP": ("IN", "OUT"), "X-RESTRICT": ("SKIP", "JUMP")}


class HlsAnalysis(Tables):
    """The tables of an analysis of media playlists (doc_id, body), each made when it is first asked for. Those that feed
    others are written, so that no plan holds how they came about; ``release`` gives them up."""

    def __init__(self, docs: DataFrame):
        super().__init__()
        self.docs = docs

    @cached_property
    def tokens(self) -> DataFrame:
        return self._persisted(hls.lines(self.docs))  # else its regular expressions run once for each use of an attribute

    @cached_property
    def segments(self) -> DataFrame:
        return self._written(hls.segments(self.tokens))

    @cached_property
    def headers(self) -> DataFrame:
        return self._written(hls.headers(self.tokens))

    @cached_property
    def markers(self) -> DataFrame:
        return self._written(decoded(hls.markers(self.tokens, self.segments)))

    @cached_property
    def _broken(self) -> tuple[DataFrame, DataFrame]:
        points = self._written(linked_points(self.markers))
        return breaks_of(points, self.segments, self.headers), points

    @property
    def extents(self) -> DataFrame:
        """Breaks without what their segments are made of."""
        return self._broken[0]

    @cached_property
    def breaks(self) -> DataFrame:
        return self._written(with_media(self.extents, self.segments))

    @cached_property
    def interstitials(self) -> DataFrame:
        return interstitials_of(self.markers)

    @cached_property
    def coded(self) -> DataFrame:
        """Findings of all rules, without words."""
        breaks, points = self.breaks, self._broken[1]
        return self._written(
            _header_rules(self.headers, self.segments, self.markers)
            .unionByName(_segment_rules(self.segments, self.headers))
            .unionByName(_marker_rules(self.markers, self.headers))
            .unionByName(_daterange_ids(self.markers))
            .unionByName(_interstitial_rules(self.interstitials))
            .unionByName(_break_rules(breaks))
            .unionByName(_unpaired_types(breaks, self.markers))
            .unionByName(_point_rules(points, self.headers))
            .unionByName(_playlist_rules(breaks, points, self.segments))
        )

    @cached_property
    def findings(self) -> DataFrame:
        return told(self.coded)

    @cached_property
    def stats(self) -> DataFrame:
        return stats_of(self.docs, self.headers, self.segments, self.markers, self.breaks)

    @cached_property
    def verdicts(self) -> DataFrame:
        return verdicts(self.docs, self.coded)


def analyse(docs: DataFrame) -> HlsAnalysis:
    return HlsAnalysis(docs)


def decoded(markers: DataFrame) -> DataFrame:
    """Markers with their decoded signal and polarity: 1 out, 0 in, null for the rest."""
    marked = markers.withColumn("signal", F.when(F.col("payload").isNotNull(), splice.decode_section(F.col("payload"))))
    return marked.withColumn("polarity", polarity(F.col("kind"), F.col("attrs"), F.col("signal")))


def polarity(kind: Column, attrs: Column, signal: Column) -> Column:
    types = F.transform(splice.segmentation(signal), lambda d: d["type_id"])
    any_of = lambda ids: F.arrays_overlap(types, F.array(*map(F.lit, ids)))
    insert = signal["splice_insert"]
    has = lambda name: given(F.try_element_at(attrs, F.lit(name))).isNotNull()
    return (
        F.when(kind == "CUE-OUT", 1)
        .when(kind == "CUE-IN", 0)
        .when(kind == "CUE-OUT-CONT", None)
        .when((kind == "DATERANGE") & has("SCTE35-OUT"), 1)
        .when((kind == "DATERANGE") & has("SCTE35-IN"), 0)
        .when(any_of(splice.START_TYPES), 1)
        .when(any_of(splice.END_TYPES), 0)
        .when(insert.isNotNull() & ~insert["cancel"], F.when(insert["out_of_network"], 1).otherwise(0))
    )


def linked_points(markers: DataFrame) -> DataFrame:
    """Splice points: one a segment, a return before a departure, each with what the next one is."""
    rank = F.when(F.col("signal.ok"), 0).when(F.col("payload").isNotNull(), 1).otherwise(2)
    out, in_ = F.col("polarity") == 1, F.col("polarity") == 0
    first = lambda cols, when, by: F.min_by(F.struct(*cols), F.when(when, by))
    points = markers.where("polarity is not null").groupBy("doc_id", "segment_index").agg(
        F.count_if(out).alias("outs"),
        F.count_if(in_).alias("ins"),
        first(["line_number", "kind", "start_time", "pdt", "duration_attr", "signal"], out, F.struct(rank.alias("rank"), F.col("line_number"))).alias("out"),
        F.min_by("duration_attr", F.when(out & F.col("duration_attr").isNotNull(), F.col("line_number"))).alias("any_duration"),
        first(["line_number", "start_time"], in_, F.col("line_number")).alias("in"),
    )
    sides = F.array(
        F.when(F.col("ins") > 0, F.lit(0)), F.when(F.col("outs") > 0, F.lit(1))
    )
    events = points.withColumn("polarity", F.explode(F.filter(sides, lambda x: x.isNotNull())))
    events = events.withColumn("in_line", F.col("in.line_number"))
    linked = paired(events, ["doc_id"], ["segment_index", "polarity"])
    next_in = F.lead("in_line").over(Window.partitionBy("doc_id").orderBy("segment_index", "polarity"))
    last_start = F.last(F.when(F.col("polarity") == 1, F.col("segment_index")), ignorenulls=True).over(
        Window.partitionBy("doc_id").orderBy("segment_index", "polarity").rowsBetween(Window.unboundedPreceding, -1)
    )
    return linked.withColumns({"return_line": F.when(F.col("closed"), next_in), "open_start": last_start})


def breaks_of(linked: DataFrame, segments: DataFrame, headers: DataFrame) -> DataFrame:
    """Breaks of splice points."""
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("segment_index")) - 1
    own = linked.where("polarity = 1").withColumn("index", at)
    sizes = segments.groupBy("doc_id").agg(
        F.count("*").cast("int").alias("n"), F.sum("duration").alias("total"), F.bool_or("discontinuity").alias("any_discontinuity"),
        F.max_by(F.struct("pdt", "duration"), "idx").alias("edge"),
    )
    own = own.join(headers.select("doc_id", "end_list", "target_duration"), "doc_id").join(sizes, "doc_id", "left")
    end = F.when(F.col("closed"), F.col("next_event.segment_index")).otherwise(F.coalesce("n", F.lit(0)))
    own = own.withColumn("end_index", end)
    edges = hls.edge_times(segments).select("doc_id", "idx", "start_time", "discontinuity")
    side = lambda name, at: edges.select(F.col("doc_id"), F.col("idx").alias(at), F.struct("start_time", "discontinuity").alias(name))
    own = own.join(side("first", "segment_index"), ["doc_id", "segment_index"], "left").join(side("after", "end_index"), ["doc_id", "end_index"], "left")
    section = F.col("out.signal")
    lead = splice.lead_descriptor(section)
    attr = F.coalesce(F.col("out.duration_attr"), F.col("any_duration"))
    insert = section["splice_insert"]
    by_descriptor, by_break = lead["duration_ticks"] / splice.TICKS, insert["break_ticks"] / splice.TICKS
    live = ~F.col("end_list")
    extent = F.coalesce(exact(F.col("after.start_time") - F.col("out.start_time")), F.lit(0.0))
    breaks = own.select(
        "doc_id", "index", F.col("out.start_time").alias("start_time"), F.col("out.pdt").alias("pdt"),
        F.coalesce(by_descriptor, by_break, attr).alias("signalled_duration"),
        F.when(by_descriptor.isNotNull(), "segmentation_duration").when(by_break.isNotNull(), "break_duration").when(attr.isNotNull(), "manifest").alias("signalled_source"),
        F.when(F.col("closed") | ~live, extent).alias("actual_duration"), extent.alias("extent"),
        F.greatest(F.lit(0), F.col("end_index") - F.col("segment_index")).alias("segment_count"),
        "closed", (~F.col("closed") & live).alias("in_progress"),
        (live & (F.col("segment_index") == 0) & (F.col("out.start_time") <= SLACK)).alias("window_clipped"),
        F.col("out.line_number").alias("out_line"), F.col("return_line").alias("in_line"), F.col("after.start_time").alias("end_time"),
        F.coalesce(F.col("first.discontinuity"), F.lit(False)).alias("discontinuity_at_start"),
        (F.col("closed") & F.coalesce(F.col("after.discontinuity"), F.lit(False))).alias("discontinuity_at_end"),
        section.alias("signal"), attr.alias("duration_attr"), insert["splice_immediate"].alias("splice_immediate"),
        insert["auto_return"].alias("auto_return"), insert["out_of_network"].alias("out_of_network"),
        F.coalesce(lead["event_id"], insert["event_id"]).alias("event_id"), lead["type_id"].alias("segmentation_type"),
        F.coalesce(given(lead["upid_text"]), lead["upid_hex"]).alias("upid"), lead["upid_type"].alias("upid_type"),
        F.when(live & F.col("out.pdt").isNotNull(), (F.coalesce(F.col("edge.pdt"), F.lit(0.0)) + F.col("edge.duration") * 1000 - F.col("out.pdt")) / 1000).alias("edge_distance"),
        "end_list", "target_duration", "any_discontinuity", "n", "segment_index", "end_index",
    )
    return breaks


def with_media(breaks: DataFrame, segments: DataFrame) -> DataFrame:
    """Breaks with the addresses, initialisation maps and containers of their segments, and of those around them."""
    media = segments.select("doc_id", "idx", "uri", "map_uri")
    place = F.explode(F.sequence("segment_index", F.col("end_index") - 1)).alias("idx")
    inside = breaks.where("end_index > segment_index").select("doc_id", "index", place).join(media, ["doc_id", "idx"]).groupBy("doc_id", "index").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("idx", "uri"))), lambda x: x["uri"]).alias("media_uris"),
        F.collect_set("map_uri").alias("inside_maps"), F.collect_set(container(F.col("uri"))).alias("inside_kinds"),
    )
    beside = breaks.select("doc_id", "index", F.explode(F.array(F.struct(F.lit("before").alias("side"), (F.col("segment_index") - 1).alias("idx")), F.struct(F.lit("after").alias("side"), F.col("end_index").alias("idx")))).alias("x"))
    beside = beside.select("doc_id", "index", "x.side", "x.idx").join(media, ["doc_id", "idx"])
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.struct(F.when(F.col("side") == "before", 0).otherwise(1).alias("n"), c.alias("c")))), lambda x: x["c"])
    known = lambda c: F.filter(listed(c), lambda x: x.isNotNull())
    around = beside.groupBy("doc_id", "index").agg(known(F.col("map_uri")).alias("outside_maps"), known(container(F.col("uri"))).alias("outside_kinds"))
    none = F.array().cast("array<string>")
    full = breaks.join(inside, ["doc_id", "index"], "left").join(around, ["doc_id", "index"], "left")
    return full.withColumns({c: F.coalesce(c, none) for c in ("outside_maps", "outside_kinds")})


def interstitials_of(markers: DataFrame) -> DataFrame:
    get = lambda name: given(F.try_element_at(F.col("attrs"), F.lit(name)))
    listed = lambda name: F.filter(F.transform(F.split(F.coalesce(get(name), F.lit("")), ","), lambda x: F.upper(F.trim(x))), lambda x: x != "")
    return markers.where("kind = 'INTERSTITIAL'").select(
        "doc_id", "line_number", "id", "start_time", "pdt", F.col("duration_attr").alias("duration"),
        number(get("X-PLAYOUT-LIMIT")).alias("playout_limit"), number(get("X-RESUME-OFFSET")).alias("resume_offset"),
        get("X-ASSET-URI").alias("asset_uri"), get("X-ASSET-LIST").alias("asset_list"),
        *[listed(k).alias(n) for k, n in (("CUE", "cue"), ("X-SNAP", "snap"), ("X-RESTRICT", "restrict"))],
        get("X-TIMELINE-OCCUPIES").alias("timeline_occupies"), get("X-CONTENT-MAY-VARY").alias("content_may_vary"),
    )


def _header_rules(headers: DataFrame, segments: DataFrame, markers: DataFrame) -> DataFrame:
    stated = segments.groupBy("doc_id").agg(F.bool_or("pdt_explicit").alias("has_pdt"))
    many = markers.groupBy("doc_id").agg(F.count("*").alias("marker_count"))
    rows = headers.join(stated, "doc_id", "left").join(many, "doc_id", "left")
    low, control = F.col("low_latency"), F.col("server_control")
    return emit(
        rows,
        [
            rule(low & ~control, "error", "LL_NO_SERVER_CONTROL"),
            rule(low & control & ~F.col("can_block_reload"), "warning", "LL_NO_BLOCKING_RELOAD"),
            rule(low & (F.col("part_hold_back") < F.col("part_target") * 3 - SLACK), "error", "LL_PART_HOLD_BACK_TOO_SMALL"),
            rule(low & F.col("can_skip_until").isNotNull() & ~F.col("can_skip_dateranges"), "warning", "LL_DELTA_UPDATE_DROPS_DATERANGES"),
            rule(low & (F.col("part_count") > 0) & ~F.col("preload_hint"), "info", "LL_NO_PRELOAD_HINT"),
            rule(low & (F.col("part_count") > 0) & (F.col("report_count") == 0), "info", "LL_NO_RENDITION_REPORT"),
            rule(low & F.col("part_hold_back").isNotNull() & (F.col("marker_count") > 0), "info", "LL_AD_DECISION_BUDGET"),
            rule(~F.coalesce("has_pdt", F.lit(False)), "warning", "NO_PROGRAM_DATE_TIME"),
        ],
    )


def _segment_rules(segments: DataFrame, headers: DataFrame) -> DataFrame:
    by = Window.partitionBy("doc_id").orderBy("idx")
    expected = F.lag("pdt").over(by) + F.lag("duration").over(by) * 1000
    rows = segments.withColumn("drift", F.when(F.col("pdt_explicit"), exact((F.col("pdt") - expected) / 1000)))
    rows = rows.join(headers.select("doc_id", "target_duration"), "doc_id")
    return emit(
        rows,
        [
            rule((F.col("target_duration") != 0) & (exact(F.col("duration") - F.col("target_duration")) > SLACK), "error", "TARGETDURATION_EXCEEDED", F.col("line_number"), at=F.col("start_time")),
            rule(F.abs("drift") > EPS, F.when(F.col("discontinuity"), "info").otherwise("warning"), "PDT_DISCONTINUITY", F.col("line_number"), at=F.col("start_time")),
        ],
    )


def _marker_rules(markers: DataFrame, headers: DataFrame) -> DataFrame:
    rows = markers.join(headers.select("doc_id", "end_list"), "doc_id")
    drift = exact((iso_millis(F.try_element_at(F.col("attrs"), F.lit("START-DATE"))) - F.col("pdt")) / 1000)
    trimmed = ~F.col("end_list") & (drift < 0) & (F.col("segment_index") == 0)
    ok, at = F.col("signal.ok"), {"line": F.col("line_number"), "at": F.col("start_time")}
    return emit(
        rows,
        [
            rule(F.col("signal").isNotNull() & ~ok, "error", "SCTE35_DECODE_FAILED", **at),
            rule(ok & ~F.col("signal.crc_valid"), "warning", "SCTE35_CRC_INVALID", **at),
            rule(ok & F.col("signal.crc_valid") & F.col("signal.encrypted"), "info", "SCTE35_ENCRYPTED", **at),
            rule((F.col("kind") == "DATERANGE") & (F.abs(drift) > EPS) & ~trimmed, "warning", "DATERANGE_START_DATE_MISMATCH", **at),
        ],
    )


def _daterange_ids(markers: DataFrame) -> DataFrame:
    has = lambda name: given(F.try_element_at(F.col("attrs"), F.lit(name))).isNotNull()
    ids = markers.where("kind = 'DATERANGE' and id is not null and id <> ''").groupBy("doc_id", "id").agg(
        F.count("*").alias("n"), F.count_if(has("SCTE35-OUT")).alias("outs"), F.count_if(has("SCTE35-IN")).alias("ins"),
        F.try_element_at(F.array_sort(F.collect_list("line_number")), F.lit(2)).alias("second"),
    )
    wrong = (F.col("outs") > 1) | (F.col("ins") > 1) | ((F.col("outs") == 0) & (F.col("ins") == 0) & (F.col("n") > 1))
    return emit(ids, [rule(wrong, "error", "DATERANGE_DUPLICATE_ID", F.col("second"))])


def _interstitial_rules(rows: DataFrame) -> DataFrame:
    at = {"line": F.col("line_number"), "at": F.col("start_time")}
    uri, listing = F.col("asset_uri").isNotNull(), F.col("asset_list").isNotNull()
    odd = [
        rule(F.size(F.array_except(F.col(c), F.array(*map(F.lit, VALUES[k])))) > 0, "warning", "INTERSTITIAL_UNKNOWN_ATTRIBUTE_VALUE", **at)
        for k, c in (("CUE", "cue"), ("X-SNAP", "snap"), ("X-RESTRICT", "restrict"))
    ]
    both = F.array_contains("cue", "PRE") & F.array_contains("cue", "POST")
    found = emit(
        rows,
        [
            rule(~uri & ~listing, "error", "INTERSTITIAL_NO_ASSET", **at),
            rule(uri & listing, "error", "INTERSTITIAL_AMBIGUOUS_ASSET", **at),
            rule(F.col("duration").isNull() & F.col("playout_limit").isNull() & ~listing, "warning", "INTERSTITIAL_UNBOUNDED", **at),
            *odd,
            rule(both, "error", "INTERSTITIAL_PRE_AND_POST", **at),
        ],
    )
    ranged = rows.where(F.col("duration").isNotNull() & ~F.arrays_overlap("cue", F.array(F.lit("PRE"), F.lit("POST"))))
    over = overlapping(ranged, ["doc_id"], "start_time", "duration", ["start_time", "line_number"], EPS)
    found = found.unionByName(emit(over, [rule(F.col("overlaps"), "error", "INTERSTITIAL_OVERLAP", **at)]))
    return found.unionByName(emit(rows.select("doc_id").distinct(), [rule(F.lit(True), "info", "INTERSTITIAL_SIGNALLING")]))


def overlapping(rows: DataFrame, keys: list[str], start: str, length: str, order: list[str], slack: float) -> DataFrame:
    """Adds overlaps: whether a range starts before the end of the one just before it, less a slack."""
    end = F.lag(F.col(start) + F.col(length)).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("overlaps", F.coalesce(F.col(start) < end - slack, F.lit(False)))


def _break_rules(breaks: DataFrame) -> DataFrame:
    live, closed, clipped = ~F.col("end_list"), F.col("closed"), F.col("window_clipped")
    signalled, extent = F.col("signalled_duration"), F.col("extent")
    target = F.coalesce("target_duration", F.lit(6.0))
    delta = exact(extent - signalled)
    late = live & ~closed & ~clipped & (delta > F.greatest(F.lit(EPS), target * 2))
    off = closed & ~clipped & (F.abs(delta) > F.greatest(F.lit(EPS), target * 0.5))
    apart = lambda a, b: (F.size(a) > 0) & (F.size(b) > 0) & ~F.arrays_overlap(a, b)
    at = {"line": F.col("out_line"), "index": F.col("index"), "at": F.col("start_time")}
    back = {"line": F.col("in_line"), "index": F.col("index"), "at": F.col("end_time")}
    whole = closed & ~clipped & (F.col("segment_count") > 0)
    from_signal = F.col("signalled_source").isin("segmentation_duration", "break_duration")
    found = emit(
        breaks,
        [
            rule(from_signal & (F.abs(exact(F.col("duration_attr") - signalled)) > EPS), "warning", "SIGNAL_DURATION_DISAGREEMENT", **at),
            rule(late, "error", "BREAK_OVERRUN_UNCLOSED", **at),
            rule(live & ~closed & ~F.coalesce(late, F.lit(False)), "info", "BREAK_IN_PROGRESS", **at),
            rule(~live & ~closed, "error", "UNCLOSED_BREAK", **at),
            rule(off & (delta > 0), "warning", "BREAK_OVERRUN", **at),
            rule(off & (delta < 0), "warning", "BREAK_UNDERRUN", **at),
            rule(whole & apart(F.col("inside_maps"), F.col("outside_maps")) & ~F.col("discontinuity_at_start"), "error", "MAP_CHANGED_WITHOUT_DISCONTINUITY", **at),
            rule(whole & apart(F.col("inside_kinds"), F.col("outside_kinds")), "error", "AD_CONTAINER_MISMATCH", **at),
            rule(F.col("any_discontinuity") & closed & ~clipped & ~F.col("discontinuity_at_start"), "warning", "NO_DISCONTINUITY_AT_BREAK_START", **at),
            rule(F.col("any_discontinuity") & closed & (F.col("end_index") < F.col("n")) & ~F.col("discontinuity_at_end"), "warning", "NO_DISCONTINUITY_AT_BREAK_END", **back),
            rule(F.col("splice_immediate"), "info", "SPLICE_IMMEDIATE", **at),
            rule(~F.col("auto_return") & ~closed, "warning", "NO_AUTO_RETURN_NO_CUE_IN", **at),
        ],
    )
    upids = F.transform(
        splice.segmentation(F.col("signal")),
        lambda d: rule(
            splice.upid_problem(d["upid_type"], d["upid_hex"], F.coalesce(d["upid_text"], F.lit(""))).isNotNull(), "warning",
            splice.upid_problem(d["upid_type"], d["upid_hex"], F.coalesce(d["upid_text"], F.lit(""))), F.col("out_line"), F.col("index"), F.col("start_time"),
        ),
    )
    return found.unionByName(emit_array(breaks.where("signal.ok"), upids))


def _unpaired_types(breaks: DataFrame, markers: DataFrame) -> DataFrame:
    """Start types with an end type of their own of which no later marker has one for the same event."""
    typed = F.filter(splice.segmentation(F.col("signal")), lambda d: d["type_id"].isin(*[t for t in splice.START_TYPES if t != splice.UNPAIRED_START]))
    starts = breaks.where("end_list and signal.ok").select("doc_id", "index", "out_line", "start_time", F.explode(typed).alias("d"))
    starts = starts.select("doc_id", "index", "out_line", "start_time", F.col("d.event_id").alias("event_id"), (F.col("d.type_id") + 1).alias("type_id"))
    ends = markers.where("signal.ok").select("doc_id", "line_number", F.explode(splice.segmentation(F.col("signal"))).alias("d"))
    ends = ends.select("doc_id", F.col("line_number").alias("end_line"), F.col("d.event_id").alias("event_id"), F.col("d.type_id").alias("type_id"))
    last = ends.groupBy("doc_id", "event_id", "type_id").agg(F.max("end_line").alias("end_line"))
    open_ = starts.join(last, ["doc_id", "event_id", "type_id"], "left").where("end_line is null or end_line <= out_line")
    return emit(open_, [rule(F.lit(True), "warning", "UNPAIRED_SEGMENTATION_TYPE", F.col("out_line"), F.col("index"), F.col("start_time"))])


def _point_rules(events: DataFrame, headers: DataFrame) -> DataFrame:
    rows = events.join(headers.select("doc_id", "end_list"), "doc_id")
    live = ~F.col("end_list")
    mild = lambda c: F.when(live & c, "info").otherwise("error")
    return emit(
        rows,
        [
            rule(F.col("orphan"), mild(~F.col("seen")), "ORPHAN_CUE_IN", F.col("in.line_number"), at=F.col("in.start_time")),
            rule(F.col("nested"), mild(F.col("open_start") == 0), "NESTED_CUE_OUT", F.col("out.line_number"), at=F.col("out.start_time")),
        ],
    )


def _playlist_rules(breaks: DataFrame, points: DataFrame, segments: DataFrame) -> DataFrame:
    cut = segments.groupBy("doc_id").agg(F.bool_or("discontinuity").alias("any_cut"))
    plain = breaks.select("doc_id").distinct().join(cut, "doc_id", "left").where("not coalesce(any_cut, false)")
    found = emit(plain, [rule(F.lit(True), "info", "SIGNALLING_ONLY_STREAM")])
    twice = points.where("outs > 1").select("doc_id").distinct()
    found = found.unionByName(emit(twice, [rule(F.lit(True), "info", "DUAL_SIGNALLING")]))
    ids = breaks.where("event_id is not null").groupBy("doc_id", "event_id").agg(F.array_sort(F.collect_list(F.struct("index", "start_time"))).alias("all"))
    second = F.try_element_at(F.col("all"), F.lit(2))
    return found.unionByName(emit(ids.where(F.size("all") > 1), [rule(F.lit(True), "warning", "EVENT_ID_REUSED", index=second["index"], at=second["start_time"])]))


def stats_of(docs: DataFrame, headers: DataFrame, segments: DataFrame, markers: DataFrame, breaks: DataFrame) -> DataFrame:
    window = segments.groupBy("doc_id").agg(
        F.count("*").alias("segment_count"), F.sum("duration").alias("window_duration"), F.bool_or("pdt_explicit").alias("has_pdt"),
        F.min_by("pdt", "idx").alias("window_start_pdt"), F.max_by(F.col("pdt") + F.col("duration") * 1000, "idx").alias("window_end_pdt"),
    )
    marked = markers.groupBy("doc_id").agg(F.count("*").alias("marker_count"), F.concat_ws("+", F.array_sort(F.collect_set("kind"))).alias("style"))
    ads = breaks.groupBy("doc_id").agg(F.count("*").alias("break_count"), F.sum(F.coalesce("actual_duration", "signalled_duration", F.lit(0.0))).alias("ad_seconds"))
    full = docs.select("doc_id").distinct()
    for part in (headers.select("doc_id", "low_latency", "target_duration", (~F.col("end_list")).alias("live")), window, marked, ads):
        full = full.join(part, "doc_id", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("segment_count", "marker_count", "break_count")}
    zero |= {c: F.coalesce(c, F.lit(0.0)) for c in ("window_duration", "ad_seconds")}
    full = full.withColumns(zero | {"style": F.coalesce("style", F.lit("none")), "has_pdt": F.coalesce("has_pdt", F.lit(False))})
    return full.withColumn("ad_percent", F.when(F.col("window_duration") > 0, F.col("ad_seconds") / F.col("window_duration") * 100).otherwise(0.0))


def compare_renditions(renditions: DataFrame, breaks: DataFrame, stats: DataFrame) -> DataFrame:
    """Findings on renditions of one stream: ``renditions`` has (stream_id, doc_id, ordinal); 0 is the reference one.

    Only breaks that are closed and lie inside the window that all renditions share, away from its ends, are
    compared; the nearest break within 3 s is a rendition's counterpart. Distances are of whole microseconds, so that equal ones
    are equal.
    """
    rows = renditions.join(stats, "doc_id")
    window = rows.groupBy("stream_id").agg(
        F.count("*").alias("renditions"), F.max("window_start_pdt").alias("from"), F.min("window_end_pdt").alias("to"),
        (F.count("window_start_pdt") == F.count("*")).alias("clocked"), F.greatest(F.lit(10_000.0), F.coalesce(F.max("target_duration"), F.lit(6.0)) * 2000).alias("grace"),
        F.size(F.collect_set("style")).alias("styles"),
    ).where("renditions > 1")
    apart = F.col("clocked") & (F.col("to") <= F.col("from"))
    found = emit(window, [rule(apart, "warning", "NO_COMMON_WINDOW"), rule(~apart & (F.col("styles") > 1), "warning", "VARIANT_SIGNALLING_STYLE_MISMATCH")], ("stream_id",))
    shared = window.where(~apart)
    own = breaks.where("closed and not window_clipped").join(renditions, "doc_id").join(shared, "stream_id")
    length = F.coalesce("actual_duration", "signalled_duration")
    inside = ~F.col("clocked") | F.col("pdt").isNull() | (
        (F.col("pdt") >= F.col("from") + F.col("grace")) & (F.col("pdt") + F.coalesce(length, F.lit(0.0)) * 1000 <= F.col("to") - F.col("grace"))
    )
    own = own.where(inside).select("stream_id", "ordinal", "index", "start_time", F.round(F.coalesce(F.col("pdt") * 1000, F.col("start_time") * 1e6)).alias("at"), length.alias("length"))
    per = renditions.join(shared.select("stream_id"), "stream_id").join(own.groupBy("stream_id", "ordinal").agg(F.count("*").alias("n")), ["stream_id", "ordinal"], "left")
    counts = per.groupBy("stream_id").agg(F.count_distinct(F.coalesce("n", F.lit(0))).alias("different"))
    found = found.unionByName(emit(counts, [rule(F.col("different") > 1, "error", "VARIANT_BREAK_COUNT_MISMATCH")], ("stream_id",)))
    wanted = own.where("ordinal = 0").select("stream_id", "index", "start_time", "at", "length").join(
        renditions.where("ordinal > 0").select("stream_id", F.col("ordinal").alias("other")), "stream_id"
    )
    candidate = own.where("ordinal > 0").select("stream_id", F.col("ordinal").alias("other"), F.col("index").alias("their"), F.col("at").alias("their_at"), F.col("length").alias("their_length"))
    keys = ["stream_id", "other"]
    near = nearest(wanted, candidate, keys, "at", "their_at", "index", "their", 3e6)
    near = near.join(candidate, [*keys, "their"]).select(*keys, "index", F.struct("gap", "their", "their_length").alias("best"))
    met = wanted.join(near, [*keys, "index"], "left")
    at = {"index": F.col("index"), "at": F.col("start_time")}
    return found.unionByName(
        emit(
            met,
            [
                rule(F.col("best").isNull(), "error", "VARIANT_MISSING_BREAK", **at),
                rule(F.col("best.gap") > EPS * 1e6, "error", "VARIANT_BREAK_MISALIGNED", **at),
                rule(F.abs(exact(F.col("length") - F.col("best.their_length"))) > EPS, "warning", "VARIANT_DURATION_MISMATCH", **at),
            ],
            ("stream_id",),
        )
    )
