"""HLS playlists as tables: every playlist of a DataFrame at once, by windows over its lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuelake.functions.text import attribute, attribute_map, attributes, exact, given, iso_millis, number

INTERSTITIAL = "com.apple.hls.interstitial"


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, ln, line, pairs, seg): non-blank lines, their attributes, and the segment that each belongs to: a
    segment's address ends it."""
    raw = docs.select("doc_id", F.posexplode(F.split("body", r"\r?\n")).alias("pos", "line"))
    kept = raw.select("doc_id", (F.col("pos") + 1).alias("ln"), F.trim("line").alias("line")).where("line <> ''")
    before = Window.partitionBy("doc_id").orderBy("ln").rowsBetween(Window.unboundedPreceding, -1)
    seg = F.count(F.when(~F.col("line").startswith("#"), 1)).over(before).cast("int")
    pairs = F.when(F.col("line").startswith("#EXT"), attributes(_value(F.col("line"))))
    return kept.withColumns({"seg": seg, "pairs": pairs})


def _value(line: Column) -> Column:
    return F.regexp_replace(line, r"^[^:]*:?", "")


def _tag(name: str) -> Column:
    return F.col("line").startswith(f"#{name}:")


def _last(value: Column, when: Column) -> Column:
    return F.max_by(F.when(when, value), F.when(when, F.col("ln")))


def segments(tokens: DataFrame) -> DataFrame:
    """(doc_id, idx, uri, duration, start_time, pdt, pdt_explicit, discontinuity, line_number, map_uri)."""
    mapped = _tag("EXT-X-MAP")
    found = tokens.groupBy("doc_id", "seg").agg(
        F.max(F.when(~F.col("line").startswith("#"), F.col("line"))).alias("uri"),
        F.max(F.when(~F.col("line").startswith("#"), F.col("ln"))).alias("line_number"),
        F.coalesce(_last(number(F.regexp_extract("line", r"^#EXTINF:\s*([\d.]+)", 1)), _tag("EXTINF")), F.lit(0.0)).alias("duration"),
        _last(iso_millis(_value(F.col("line"))), _tag("EXT-X-PROGRAM-DATE-TIME") & iso_millis(_value(F.col("line"))).isNotNull()).alias("stated"),
        F.coalesce(F.bool_or(F.col("line") == "#EXT-X-DISCONTINUITY"), F.lit(False)).alias("discontinuity"),
        _last(F.struct(given(attribute(F.col("pairs"), "URI")).alias("uri")), mapped).alias("own_map"),
    )
    found = found.where(F.col("uri").isNotNull())
    by = Window.partitionBy("doc_id").orderBy("seg")
    past, upto = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(Window.unboundedPreceding, 0)
    timed = found.withColumn("start_time", exact(F.coalesce(F.sum("duration").over(past), F.lit(0.0))))
    anchor = F.last(F.when(F.col("stated").isNotNull(), F.struct("stated", "start_time")), ignorenulls=True).over(upto)
    return timed.select(
        "doc_id", F.col("seg").alias("idx"), "uri", "duration", "start_time",
        (anchor["stated"] + (F.col("start_time") - anchor["start_time"]) * 1000).alias("pdt"),
        F.col("stated").isNotNull().alias("pdt_explicit"), "discontinuity", "line_number",
        F.last("own_map", ignorenulls=True).over(upto)["uri"].alias("map_uri"),
    )


def headers(tokens: DataFrame) -> DataFrame:
    """One row a playlist; the last of several equal tags counts."""
    line, pairs = F.col("line"), F.col("pairs")
    plain = lambda tag: _last(number(F.trim(_value(line))), _tag(tag))
    attr = lambda tag, name: _last(given(attribute(pairs, name)), _tag(tag))
    flag = lambda tag, name: F.coalesce(_last(attribute(pairs, name) == "YES", _tag(tag)), F.lit(False))
    low = reduce(lambda a, b: a | b, map(_tag, ("EXT-X-PART-INF", "EXT-X-PART", "EXT-X-PRELOAD-HINT", "EXT-X-SERVER-CONTROL")))
    any_ = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    return tokens.groupBy("doc_id").agg(
        plain("EXT-X-VERSION").alias("version"),
        plain("EXT-X-TARGETDURATION").alias("target_duration"),
        F.coalesce(plain("EXT-X-MEDIA-SEQUENCE"), F.lit(0.0)).alias("media_sequence"),
        F.coalesce(plain("EXT-X-DISCONTINUITY-SEQUENCE"), F.lit(0.0)).alias("discontinuity_sequence"),
        _last(F.trim(_value(line)), _tag("EXT-X-PLAYLIST-TYPE")).alias("playlist_type"),
        any_(line == "#EXT-X-ENDLIST").alias("end_list"),
        number(attr("EXT-X-PART-INF", "PART-TARGET")).alias("part_target"),
        any_(low).alias("low_latency"),
        any_(_tag("EXT-X-SERVER-CONTROL")).alias("server_control"),
        flag("EXT-X-SERVER-CONTROL", "CAN-BLOCK-RELOAD").alias("can_block_reload"),
        number(attr("EXT-X-SERVER-CONTROL", "PART-HOLD-BACK")).alias("part_hold_back"),
        number(attr("EXT-X-SERVER-CONTROL", "HOLD-BACK")).alias("hold_back"),
        number(attr("EXT-X-SERVER-CONTROL", "CAN-SKIP-UNTIL")).alias("can_skip_until"),
        flag("EXT-X-SERVER-CONTROL", "CAN-SKIP-DATERANGES").alias("can_skip_dateranges"),
        any_(_tag("EXT-X-PRELOAD-HINT")).alias("preload_hint"),
        F.count(F.when(_tag("EXT-X-PART"), 1)).alias("part_count"),
        F.count(F.when(_tag("EXT-X-RENDITION-REPORT"), 1)).alias("report_count"),
        number(attr("EXT-X-SKIP", "SKIPPED-SEGMENTS")).alias("skipped_segments"),
    )


def parts(tokens: DataFrame) -> DataFrame:
    """Partial segments, in order."""
    own = tokens.where(_tag("EXT-X-PART"))
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("ln")) - 1
    pairs = F.col("pairs")
    return own.select(
        "doc_id", at.alias("idx"), F.coalesce(attribute(pairs, "URI"), F.lit("")).alias("uri"),
        F.coalesce(number(attribute(pairs, "DURATION")), F.lit(0.0)).alias("duration"),
        F.coalesce(attribute(pairs, "INDEPENDENT") == "YES", F.lit(False)).alias("independent"),
        F.coalesce(attribute(pairs, "GAP") == "YES", F.lit(False)).alias("gap"), F.col("seg").alias("segment_index"), F.col("ln").alias("line_number"),
    )


def markers(tokens: DataFrame, found: DataFrame) -> DataFrame:
    """Signalling tags of nine kinds with the time of the segment that they precede; those after the last segment
    have the playlist's end as their time."""
    line, pairs = F.col("line"), F.col("pairs")
    get = lambda name: given(attribute(pairs, name))
    kind = (
        F.when(line.startswith("#EXT-X-CUE-OUT-CONT"), "CUE-OUT-CONT")
        .when(line.startswith("#EXT-X-CUE-OUT"), "CUE-OUT")
        .when(line.startswith("#EXT-X-CUE-IN"), "CUE-IN")
        .when(_tag("EXT-X-DATERANGE") & (F.coalesce(get("CLASS"), F.lit("")) == INTERSTITIAL), "INTERSTITIAL")
        .when(_tag("EXT-X-DATERANGE"), "DATERANGE")
        .when(_tag("EXT-OATCLS-SCTE35"), "OATCLS-SCTE35")
        .when(_tag("EXT-X-SCTE35"), "SCTE35")
        .when(_tag("EXT-X-ASSET"), "ASSET")
        .when(_tag("EXT-X-SPLICEPOINT-SCTE35"), "SPLICEPOINT")
    )
    k = F.col("kind")
    bare = F.when(F.trim(_value(line)).rlike(r"^[\d.]+$"), number(F.trim(_value(line))))
    duration = (
        F.when(k == "CUE-OUT-CONT", number(F.coalesce(get("DURATION"), get("CUE-OUT-CONT"))))
        .when(k == "CUE-OUT", F.coalesce(number(get("DURATION")), bare))
        .when(k == "INTERSTITIAL", F.coalesce(number(get("DURATION")), number(get("PLANNED-DURATION"))))
        .when(k == "DATERANGE", number(F.coalesce(get("PLANNED-DURATION"), get("DURATION"))))
    )
    payload = (
        F.when(k.isin("CUE-OUT-CONT", "CUE-OUT"), F.coalesce(get("SCTE35"), get("CUE")))
        .when(k == "DATERANGE", F.coalesce(get("SCTE35-OUT"), get("SCTE35-IN"), get("SCTE35-CMD")))
        .when(k.isin("OATCLS-SCTE35", "SPLICEPOINT"), given(F.trim(_value(line))))
        .when(k == "SCTE35", get("CUE"))
    )
    own = tokens.withColumn("kind", kind).where("kind is not null")
    own = own.select(
        "doc_id", F.col("ln").alias("line_number"), "kind", line.alias("raw"), F.col("seg").alias("segment_index"),
        F.when(k.isin("DATERANGE", "INTERSTITIAL", "SCTE35"), get("ID")).alias("id"),
        duration.alias("duration_attr"), F.when(k == "CUE-OUT-CONT", number(F.coalesce(get("ELAPSEDTIME"), get("ELAPSED")))).alias("elapsed"),
        payload.alias("payload"), F.coalesce(attribute_map(pairs), F.create_map().cast("map<string,string>")).alias("attrs"),
    )
    edges = edge_times(found).select("doc_id", F.col("idx").alias("segment_index"), "start_time", "pdt")
    timed = own.join(edges, ["doc_id", "segment_index"], "left")
    return timed.withColumn("start_time", F.coalesce("start_time", F.lit(0.0)))


def edge_times(found: DataFrame) -> DataFrame:
    """Every segment's start, and the end of the last one under the index that would follow."""
    inner = found.select("doc_id", "idx", "start_time", "pdt", "discontinuity", "map_uri", "uri", F.lit(False).alias("past"))
    last = found.groupBy("doc_id").agg(F.max_by(F.struct("idx", "start_time", "duration", "pdt"), "idx").alias("z"))
    end = last.select(
        "doc_id", (F.col("z.idx") + 1).alias("idx"), exact(F.col("z.start_time") + F.col("z.duration")).alias("start_time"),
        (F.col("z.pdt") + F.col("z.duration") * 1000).alias("pdt"), F.lit(False).alias("discontinuity"),
        F.lit(None).cast("string").alias("map_uri"), F.lit(None).cast("string").alias("uri"), F.lit(True).alias("past"),
    )
    return inner.unionByName(end)


def variants(docs: DataFrame) -> DataFrame:
    """Entries of master playlists: a stream's address is the next line that is neither blank nor a tag."""
    raw = docs.select("doc_id", F.posexplode(F.split("body", r"\r?\n")).alias("ln", "line"))
    raw = raw.select("doc_id", "ln", F.trim("line").alias("line")).where("line <> ''")
    ahead = Window.partitionBy("doc_id").orderBy("ln").rowsBetween(1, Window.unboundedFollowing)
    uri = F.first(F.when(~F.col("line").startswith("#"), F.col("line")), ignorenulls=True).over(ahead)
    stream = F.col("line").startswith("#EXT-X-STREAM-INF:")
    own = raw.withColumn("next_uri", uri).where(stream | F.col("line").startswith("#EXT-X-MEDIA:"))
    own = own.withColumn("pairs", attributes(_value(F.col("line"))))
    get = lambda name: given(attribute(F.col("pairs"), name))
    own = own.withColumn("uri", F.when(stream, F.col("next_uri")).otherwise(get("URI"))).where("uri is not null")
    at = F.row_number().over(Window.partitionBy("doc_id").orderBy("ln")) - 1
    return own.select(
        "doc_id", at.alias("idx"), "uri", number(get("BANDWIDTH")).alias("bandwidth"), number(get("AVERAGE-BANDWIDTH")).alias("average_bandwidth"),
        get("RESOLUTION").alias("resolution"), get("CODECS").alias("codecs"), number(get("FRAME-RATE")).alias("frame_rate"),
        F.when(stream, get("AUDIO")).otherwise(get("GROUP-ID")).alias("audio_group"), get("NAME").alias("name"),
        F.when(stream, F.lit("VIDEO")).otherwise(get("TYPE")).alias("media_type"), get("LANGUAGE").alias("language"),
    )


def picked_variants(found: DataFrame, most: int = 6) -> DataFrame:
    """The first video variants, then audio ones, up to ``most`` a master playlist."""
    rank = F.when(F.col("media_type") == "VIDEO", 0).otherwise(1)
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy(rank, "idx"))
    return found.where(F.col("media_type").isin("VIDEO", "AUDIO")).withColumn("pick", order).where(F.col("pick") <= most)
