"""From the address of a stream to its findings: a master playlist, the variants that it names, and how they compare."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.functions.text import codec_family, is_video_codec, resolve_uri
from cuelake.operators.findings import emit, rule, told, verdicts
from cuelake.plans import hls
from cuelake.runtime import Tables
from cuelake.sources import hls as playlists

#: Variants of a master playlist that are analysed, unless more are asked for.
MOST_VARIANTS = 6


def label(variants: DataFrame) -> DataFrame:
    """Adds label: kind, language and name of an audio variant; size and bandwidth of a video one, or else its place."""
    rate = F.when(F.col("bandwidth") > 0, F.concat(F.round(F.col("bandwidth") / 1000).cast("long").cast("string"), F.lit("kbps")))
    sound = F.concat_ws(" ", F.lower("media_type"), F.col("language"), F.when(F.col("name").isNotNull(), F.concat(F.lit("("), "name", F.lit(")"))))
    sight = F.coalesce(F.nullif(F.concat_ws(" @ ", "resolution", rate), F.lit("")), F.concat(F.lit("variant "), F.col("pick").cast("string")))
    return variants.withColumn("label", F.when(F.col("media_type") == "VIDEO", sight).otherwise(sound))


class OnePath(Tables):
    """``masters`` are (doc_id, uri, body); ``fetched`` (url, ok, body, error) holds what is known of the addresses that they
    name. Tables are made when asked for; the variants and what is parsed of them are written, until ``release``. A rendition's doc_id is its master's with the variant's place."""

    def __init__(self, masters: DataFrame, fetched: DataFrame, most: int = MOST_VARIANTS):
        super().__init__()
        self.masters, self.fetched, self.most = masters, fetched, most

    @cached_property
    def listed(self) -> DataFrame:
        return playlists.variants(self.masters)

    @cached_property
    def variants(self) -> DataFrame:
        """The picked variants with their label, full address and what was fetched from it."""
        rows = label(playlists.picked_variants(self.listed, self.most)).join(self.masters.select("doc_id", F.col("uri").alias("base")), "doc_id")
        rows = rows.withColumn("url", resolve_uri(F.col("base"), F.col("uri"))).join(self.fetched.select("url", "ok", "body", "error"), "url", "left")
        readable = F.coalesce(F.col("ok") & F.ltrim("body").startswith("#EXTM3U"), F.lit(False))
        name = F.concat(F.col("doc_id").cast("string"), F.lit("#"), F.col("pick").cast("string"))
        return self._written(rows.withColumns({"readable": readable, "rendition_id": name}))

    @cached_property
    def analysis(self) -> hls.HlsAnalysis:
        rows = self.variants.where("readable")
        return hls.analyse(rows.select(F.col("rendition_id").alias("doc_id"), "body"))

    @cached_property
    def renditions(self) -> DataFrame:
        """(stream_id, doc_id, ordinal) of those that could be read; the first one is the reference."""
        from pyspark.sql import Window

        place = F.row_number().over(Window.partitionBy("doc_id").orderBy("pick")) - 1
        return self.variants.where("readable").select(F.col("doc_id").alias("stream_id"), F.col("rendition_id").alias("doc_id"), place.alias("ordinal"))

    @cached_property
    def across(self) -> DataFrame:
        """stream_id and the findings on a stream as a whole: how its renditions compare, and what could not be read."""
        found = hls.compare_renditions(self.renditions, self.analysis.breaks, self._written(self.analysis.stats))
        return self._written(found.unionByName(self.reading))

    @cached_property
    def reading(self) -> DataFrame:
        """stream_id and the findings on what could not be read, or was left out."""
        streams = self.variants.groupBy(F.col("doc_id").alias("stream_id")).agg(F.count_if("readable").alias("read"))
        found = emit(self.variants.withColumnRenamed("doc_id", "stream_id"), [rule(~F.col("readable"), "warning", "VARIANT_FETCH_FAILED")], ("stream_id",))
        lost = self.masters.select(F.col("doc_id").alias("stream_id")).join(streams, "stream_id", "left")
        none = emit(lost, [rule(F.coalesce("read", F.lit(0)) == 0, "error", "NO_VARIANT_READABLE")], ("stream_id",))
        beyond = self.listed.where("media_type in ('VIDEO', 'AUDIO')").groupBy(F.col("doc_id").alias("stream_id")).agg(F.count("*").alias("n"))
        left = emit(beyond, [rule(F.col("n") > self.most, "info", "VARIANTS_NOT_ANALYSED")], ("stream_id",))
        return found.unionByName(none).unionByName(left)

    @cached_property
    def findings(self) -> DataFrame:
        """stream_id, rendition_id (null for findings on the whole stream) and the finding."""
        return told(self._coded)

    @cached_property
    def _coded(self) -> DataFrame:
        own = self.analysis.coded.withColumnRenamed("doc_id", "rendition_id").join(self.renditions.select("stream_id", F.col("doc_id").alias("rendition_id")), "rendition_id")
        across = self.across.withColumn("rendition_id", F.lit(None).cast("string"))
        return own.select(*across.columns).unionByName(across)

    @cached_property
    def verdicts(self) -> DataFrame:
        return verdicts(self.masters.withColumnRenamed("doc_id", "stream_id"), self._coded, "stream_id")

    def release(self) -> None:
        self.analysis.release()
        super().release()

    @cached_property
    def profiles(self) -> DataFrame:
        """(doc_id, codecs, bandwidths, avail_seconds): what an ad has to fit, as the VAST rules take it."""
        split = self.listed.where("media_type = 'VIDEO'")
        codec = F.explode_outer(F.split("codecs", ",")).alias("codec")
        families = split.select("doc_id", codec).where(F.col("codec").isNotNull() & is_video_codec(F.col("codec"))).groupBy("doc_id").agg(F.array_sort(F.collect_set(codec_family(F.col("codec")))).alias("codecs"))
        rates = split.groupBy("doc_id").agg(F.array_sort(F.collect_set("bandwidth")).alias("bandwidths"))
        first = self.renditions.where("ordinal = 0").join(self.analysis.breaks, "doc_id").groupBy(F.col("stream_id").alias("doc_id"))
        avail = first.agg(F.min_by(F.coalesce("signalled_duration", "actual_duration"), "index").alias("avail_seconds"))
        return rates.join(families, "doc_id", "left").join(avail, "doc_id", "left")
