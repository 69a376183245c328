"""A keyed table on disk: Parquet in one folder for each bucket of monitors; a change rewrites the buckets that it touches.

A change is first written whole to a folder of its own and takes effect from there as its buckets are moved to the place of
the old ones, so that rows are written once. Where a driver is lost on the way, the next one that opens the table finds the
buckets that are not moved yet and goes on; what was not written whole never counts. Every rewritten bucket holds a mark
besides its rows, so that a bucket that has become empty is replaced, too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Folders of a table. A change reads and writes the share of them that its monitors fall into.
BUCKETS = 64


def none_of(spark: SparkSession, schema: StructType) -> DataFrame:
    """No rows, which Spark knows before it plans what is joined with them."""
    return spark.range(0).where(F.lit(False)).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


class Buckets:
    """The table in ``folder`` with rows of ``schema`` (DDL), of which ``key`` names are those that a row is known by;
    the first one deals rows into buckets."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: tuple[str, ...], buckets: int = BUCKETS):
        self.spark, self.folder, self.key, self.buckets = spark, folder.rstrip("/"), key, buckets
        self.schema = StructType.fromDDL(schema)
        self._files = StructType.fromDDL(f"{schema}, live boolean, bucket int")
        self._settle()

    @property
    def _change(self) -> str:
        return f"{self.folder}.change"

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        path, files = self._path(name)
        return files.exists(path)

    def _delete(self, name: str) -> None:
        path, files = self._path(name)
        files.delete(path, True)

    def _settle(self) -> None:
        """Apply a change that was written whole, and forget one that was not."""
        if self._exists(f"{self._change}/_SUCCESS"):
            change, files = self._path(self._change)
            files.mkdirs(self._path(self.folder)[0])
            for own in [x.getPath() for x in files.listStatus(change) if x.getPath().getName().startswith("bucket=")]:
                place, _ = self._path(f"{self.folder}/{own.getName()}")
                files.delete(place, True)
                if not files.rename(own, place):
                    raise OSError(f"{own.toString()} can't be moved to {place.toString()}")
        if self._exists(self._change):
            self._delete(self._change)

    def bucket(self):
        return F.pmod(F.xxhash64(self.key[0]), F.lit(self.buckets)).cast("int")

    def read(self, touched: DataFrame | None = None) -> DataFrame:
        """All rows, or those of the buckets of ``touched`` (bucket), at most ``buckets`` of them."""
        if not self._exists(self.folder):
            return none_of(self.spark, self.schema)
        rows = self.spark.read.schema(self._files).parquet(self.folder)
        if touched is not None:
            rows = rows.where(F.col("bucket").isin([r[0] for r in touched.distinct().collect()]))
        return rows.where("live").select(*self.schema.names)

    def of(self, rows: DataFrame) -> DataFrame:
        """The table's rows in the buckets of ``rows``; other folders are not read."""
        return self.read(rows.select(self.bucket().alias("bucket")))

    def change(self, touching: DataFrame, make: Callable[[DataFrame], DataFrame]) -> None:
        """Replace the rows in the buckets that ``touching`` (with the first key column) falls into by what ``make`` gives
        for them. Rows that ``make`` adds must fall into these buckets."""
        touched = touching.select(self.bucket().alias("bucket")).distinct()
        rows = make(self.read(touched)).select(*self.schema.names)
        marked = rows.select("*", F.lit(True).alias("live"), self.bucket().alias("bucket"))
        marks = touched.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema.fields], F.lit(False).alias("live"), "bucket")
        both = marked.unionByName(marks).repartition("bucket", self.key[0])
        both.write.mode("overwrite").partitionBy("bucket").parquet(self._change)
        self._settle()

    def upsert(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> None:
        """Add ``rows``; of a key that is there already, the row of ``rows`` counts, or what ``merge`` (old rows, new rows)
        makes of both."""
        own = list(self.key)
        latest = lambda old, new: old.join(new.select(*own), own, "left_anti").unionByName(new)
        self.change(rows, lambda old: (merge or latest)(old, rows.select(*self.schema.names)))

    def add(self, rows: DataFrame) -> None:
        """Add the ``rows`` whose key is not there; added again, nothing changes."""
        own = list(self.key)
        new = rows.select(*self.schema.names)
        self.change(rows, lambda old: old.unionByName(new.join(old.select(*own), own, "left_anti").dropDuplicates(own)))

    def delete(self, gone: DataFrame) -> None:
        """Drop all rows of the values of the first key column in ``gone``."""
        self.change(gone, lambda old: old.join(gone.select(self.key[0]), self.key[0], "left_anti"))
