"""What a job needs before it runs: this package on the executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors this package (as --py-files would), once an application. Returns the session."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).parent
        target = Path(tempfile.mkdtemp(prefix="cuelake-")) / "cuelake.zip"
        with zipfile.ZipFile(target, "w") as out:
            for path in sorted(root.rglob("*.py")):
                out.write(path, str(Path(root.name) / path.relative_to(root)))
        context.addPyFile(str(target))
        _shipped.add(context.applicationId)
    return spark


def gathered(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys in one partition, for a pass that sees partitions as they are. By a hash of the keys: an exchange by the
    keys themselves is left out where Spark takes the rows to be dealt so already, which a union or a skewed join that
    is planned anew at run time need not keep."""
    return df.repartition(F.xxhash64(*keys))


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's spark.checkpoint.dir; where that is unset (tests), below /tmp."""
    base = spark.conf.get("spark.checkpoint.dir", None) or "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/cuelake-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table in the shared folder, reread: no later plan holds how they came about, and a lost executor
    takes none of them along."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Delete the files of ``written`` tables that nothing will read again."""
    for df in tables:
        jvm = df.sparkSession._jvm
        for file in df.inputFiles()[:1]:
            folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
            folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(folder, True)


def settled(result: DataFrame, release: Callable[[], None]) -> DataFrame:
    """``result``, written, after which ``release`` gives up what it was made of."""
    out = written(result)
    release()
    return out


class Tables:
    """Tables of an analysis that are written when they are first asked for, until ``release``."""

    def __init__(self):
        self._held: list[DataFrame] = []
        self._cached: list[DataFrame] = []

    def _written(self, table: DataFrame) -> DataFrame:
        self._held.append(written(table))
        return self._held[-1]

    def _persisted(self, table: DataFrame) -> DataFrame:
        self._cached.append(table.persist())
        return table

    def release(self) -> None:
        """Give up all tables; none of them can be read afterwards."""
        while self._cached:
            self._cached.pop().unpersist()
        dropped(*self._held)
        self._held.clear()
