"""Policies (SCTE-224) against the breaks that they should govern."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuelake.functions import splice
from cuelake.functions.text import given
from cuelake.operators.findings import emit, rule
from cuelake.operators.matching import exclusive
from cuelake.runtime import Tables

#: Milliseconds: a point's largest distance from its break; how far ahead a point is in the future. Seconds: lengths, drift.
NEAR_MS, AHEAD_MS, LENGTH, DRIFT = 10_000.0, 86_400_000.0, 0.5, 1.0


class Governed(Tables):
    """``points`` against ``breaks`` of the same doc_id at the time ``now``. Points are made once, as are matches, until
    ``release``; findings must be read before."""

    def __init__(self, points: DataFrame, breaks: DataFrame, now: float):
        super().__init__()
        self.all, self.breaks, self.now = points, breaks, now

    @cached_property
    def points(self) -> DataFrame:
        """What the rules need to know of a point."""
        lead = F.try_element_at(splice.segmentation(F.col("signal")), F.lit(1))
        return self._written(self.all.select(
            "doc_id", "ordinal", "match_at", "expected", F.coalesce(given(lead["upid_text"]), given(lead["upid_hex"])).alias("upid"), lead["type_id"].alias("type_id"),
            (F.col("signal").isNotNull() & ~F.col("signal.ok")).alias("unreadable"), F.coalesce(F.col("expires") < self.now, F.lit(False)).alias("expired"),
            F.coalesce(F.col("effective") > self.now + AHEAD_MS, F.lit(False)).alias("ahead"), ((F.size("applies") == 0) & (F.size("removes") == 0)).alias("bare"),
        ))

    @cached_property
    def matches(self) -> DataFrame:
        """(doc_id, ordinal, index, drift): points in order take a free break of the same UPID, or else the nearest free one by
        the clock."""
        asked = self.points.where("not expired and not ahead").select("doc_id", F.col("ordinal").alias("id"), F.col("upid").alias("name"), F.col("match_at").alias("at"))
        taken = exclusive(asked, self.breaks.select("doc_id", F.col("index").alias("id"), F.col("upid").alias("name"), F.col("pdt").alias("at")), ["doc_id"], NEAR_MS)
        return self._written(taken.select("doc_id", F.col("left_id").cast("int").alias("ordinal"), F.col("right_id").cast("int").alias("index"), (F.col("distance") / 1000).alias("drift")))

    @cached_property
    def findings(self) -> DataFrame:
        of = self.breaks.select("doc_id", "index", "segmentation_type", "signalled_duration")
        beside = self.matches.join(of, ["doc_id", "index"])
        full = self.points.join(beside, ["doc_id", "ordinal"], "left")
        live = ~F.col("expired") & ~F.col("ahead")
        at = {"index": F.col("index")}
        out = emit(
            full,
            [
                rule(F.col("unreadable"), "error", "SCTE224_SIGNAL_UNDECODABLE"),
                rule(F.col("expired"), "info", "SCTE224_POINT_EXPIRED"),
                rule(~F.col("expired") & F.col("ahead"), "info", "SCTE224_POINT_FUTURE"),
                rule(live & F.col("bare"), "warning", "SCTE224_POINT_NO_POLICY"),
                rule(live & F.col("index").isNull(), "warning", "SCTE224_POINT_UNMATCHED"),
                rule(F.col("type_id") != F.col("segmentation_type"), "warning", "SCTE224_TYPE_MISMATCH", **at),
                rule(F.abs(F.col("expected") - F.col("signalled_duration")) > LENGTH, "warning", "SCTE224_DURATION_MISMATCH", **at),
                rule(F.col("drift") > DRIFT, "info", "SCTE224_MATCH_DRIFT", **at),
            ],
        )
        # a document with points, and with more breaks than its points have taken
        many = lambda rows, n: rows.groupBy("doc_id").agg(F.count("*").alias(n))
        loose = many(self.breaks, "own").join(self.points.select("doc_id").distinct(), "doc_id", "left_semi").join(many(self.matches, "taken"), "doc_id", "left")
        loose = loose.where(F.col("own") > F.coalesce("taken", F.lit(0)))
        return out.unionByName(emit(loose, [rule(F.lit(True), "info", "SCTE224_SIGNAL_NOT_GOVERNED")]))


def compare(points: DataFrame, breaks: DataFrame, now: float) -> tuple[DataFrame, DataFrame]:
    """Matches (doc_id, ordinal, index, drift) and findings; ``Governed`` gives up its tables."""
    own = Governed(points, breaks, now)
    return own.matches, own.findings
