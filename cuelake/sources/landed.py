"""Where documents come from: landed files, pasted text, and which protocol each is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuelake.functions.text import public_http

#: Largest document or segment that is read.
MOST_BYTES = 24 * 1024 * 1024


def manifests(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """(doc_id, uri, body) of every text file below a path of at most so many bytes, one row a file; the id is the path.
    ``refused`` has the others."""
    found = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("uri"), F.col("value").alias("body"))
    return found.where(F.octet_length("body") <= most).select(F.col("uri").alias("doc_id"), "uri", "body")


def segments_of(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """(uri, content) of every binary file below a path, up to the size that is read. ``refused`` has the others."""
    files = spark.read.format("binaryFile").load(path).where(F.col("length") <= most)
    return files.select(F.col("path").alias("uri"), "content")


def refused(spark: SparkSession, path: str, most: int = MOST_BYTES) -> DataFrame:
    """(uri, bytes, severity, code) of the files below a path that are too large to be read; their content is not read."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("uri"), F.col("length").alias("bytes"))
    return files.where(F.col("bytes") > most).withColumns({"severity": F.lit("error"), "code": F.lit("DOCUMENT_TOO_LARGE")})


def pasted(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    return spark.createDataFrame([(k, k, v) for k, v in texts.items()], "doc_id string, uri string, body string")


def fetchable(requests: DataFrame, column: str = "url") -> DataFrame:
    """Requests for public http(s) addresses only."""
    return requests.where(public_http(F.col(column)))


def protocol(body: Column) -> Column:
    """dash, scte224, vmap, vast, hls-master, hls or null; tried in this order."""
    head = F.substring(body, 1, 4000)
    return (
        F.when(head.rlike(r"<(?:[\w-]+:)?MPD[\s>]"), "dash")
        .when(head.rlike(r"<(?:[\w-]+:)?(Media|MediaList|Audience)[\s>]"), "scte224")
        .when(head.rlike(r"<(?:[\w-]+:)?VMAP[\s>]"), "vmap")
        .when(head.rlike(r"<(?:[\w-]+:)?VAST[\s>/]"), "vast")
        .when(body.rlike(r"(?m)^#EXT-X-STREAM-INF"), "hls-master")
        .when(body.startswith("#EXTM3U"), "hls")
    )
