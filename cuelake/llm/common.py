"""What several operators share: byte tables, Arrow passes, written tables, components."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A-Z to a-z; 0-9, a-z and every byte of a non-ASCII character stay; the rest becomes a space.
WORD_BYTES = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
#: Text handled at once inside a task, in bytes; a longer single text is handled alone.
BLOCK_BYTES = 2_000_000


def words(text: bytes) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, ASCII letters and non-ASCII characters."""
    return text.translate(WORD_BYTES).split()


def text_bytes(column: str = "text"):
    """The text as UTF-8 bytes; null is empty."""
    return F.coalesce(F.col(column), F.lit("")).cast("binary").alias(column)


def map_rows(df: DataFrame, make: Callable[[], Callable[[dict], Iterator[dict]]], schema: str) -> DataFrame:
    """Rows to rows inside Arrow batches. ``make`` runs once a task and returns the row function, so that
    tables are built once; batches are cut to a bounded number of bytes before they become Python objects."""
    arrow = arrow_schema(schema)

    def run(batches):
        handle = make()
        for batch in batches:
            for part in blocks(batch):
                rows = [x for row in part.to_pylist() for x in handle(row)]
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return df.mapInArrow(run, schema)


def append_columns(df: DataFrame, make: Callable[[], Callable[[list[bytes]], dict]], added: str, source: str = "text", most: int = BLOCK_BYTES) -> DataFrame:
    """All columns of ``df`` and the ``added`` ones (DDL; a clashing column of ``df`` gives way), made from the UTF-8
    bytes of one text column, null being empty. ``make`` runs once a task; its function gets a block of texts."""
    names = [x.name for x in parsed(added)]
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in {n.lower() for n in names}])
    full = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [added])
    arrow, text = arrow_schema(full), df.columns.index(source)

    def run(batches):
        handle = make()
        for batch in batches:
            for part in blocks(batch, most):
                found = handle([x or b"" for x in part.column(text).cast(pa.binary()).to_pylist()])
                kept = [c.cast(f.type) for c, f in zip(part.columns, arrow, strict=False)]
                extra = [
                    found[n].cast(arrow.field(len(kept) + k).type) if isinstance(found[n], pa.Array) else pa.array(found[n], arrow.field(len(kept) + k).type)
                    for k, n in enumerate(names)
                ]
                yield pa.RecordBatch.from_arrays([*kept, *extra], schema=arrow)

    return df.mapInArrow(run, full)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def parsed(schema: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema)


def arrow_schema(schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(parsed(schema))


def blocks(batch: pa.RecordBatch, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``most`` bytes of string and binary data each."""
    n = batch.num_rows
    if not n:
        return
    size = np.zeros(n, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            size += np.diff(np.frombuffer(column.buffers()[1], np.int32, n + 1, column.offset * 4)).astype(np.int64)
        elif pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
            size += np.diff(np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8))
    part = np.cumsum(size) // most
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's spark.checkpoint.dir. Where that is unset (tests), one below /tmp."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "file:///tmp/checkpoints"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/cuelake-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, reread: cuts the lineage and survives a lost executor."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete the files of tables that ``written`` made, once nothing will read them again."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected links a-b, root being its component's smallest node.

    Alternates two star steps. Large star: every node sends each larger neighbour to the smallest node it
    knows. Small star: every node sends its smaller neighbours and itself to the smallest of them. Both keep
    the components, and end when every node hangs on its root. A node of many links is only ever aggregated
    (a minimum a node) and joined on its own key, never gathered into a list.
    """
    import pyspark.sql.functions as f

    now = edges.select(f.greatest(a, b).alias("u"), f.least(a, b).alias("v")).where("u <> v").distinct()
    now = written(now)
    many = now.count()
    for _ in range(rounds):
        both = now.union(now.select(f.col("v").alias("u"), f.col("u").alias("v")))
        low = both.groupBy("u").agg(f.least(f.min("v"), f.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(f.col("v").alias("u"), f.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(f.min("v").alias("m"))
        small = large.join(low, "u").select(f.col("v").alias("u"), f.col("m").alias("v")).where("u <> v")
        after = written(small.union(low.select("u", f.col("m").alias("v"))).distinct())
        count = after.count()
        # rows are distinct: as many as before, and none that was not there, is the same table
        same = count == many and after.join(now, ["u", "v"], "left_anti").isEmpty()
        dropped(now)
        now, many = after, count
        if same:
            return now.select(f.col("u").alias("node"), f.col("v").alias("root"))
    raise RuntimeError(f"no fixed point after {rounds} rounds of star contraction")
