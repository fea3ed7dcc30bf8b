"""Session-wide plumbing: where intermediate tables go and how lineage is cut.

Intermediate results of iterative operators are written as Parquet below the folder that
``spark.checkpoint.dir`` names (all executors share it), so a lost executor never takes results with it.
Only where that setting is absent and the session runs on this machine alone, as in tests, a temporary folder of this machine is used.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_base: dict[str, str] = {}
_roots: dict[str, list[str]] = {}


def shared_base(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    Without either a local session gets a temporary folder; on a cluster that is an error, as each executor would write to a disk of its own.
    """
    context = spark.sparkContext
    set_dir = context._jsc.sc().getCheckpointDir()
    for conf in (spark.conf.get("spark.checkpoint.dir", None), context.getConf().get("spark.checkpoint.dir", None), set_dir.get() if set_dir.isDefined() else None):
        if conf:
            return conf.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_base:
        _own_base[app] = "file://" + tempfile.mkdtemp(prefix="provq-")
    return _own_base[app]


class Workspace:
    """A folder of intermediate tables of one operator call.

    ``save`` writes a DataFrame and returns the same rows read back, which cuts the lineage; ``drop``
    removes a table that no later step reads. Tables that the returned result still reads stay until the
    caller has read it and calls ``clear_all``, or removes the checkpoint folder.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_base(spark)}/provq-{label}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        _roots.setdefault(spark.sparkContext.applicationId, []).append(self.root)

    def path(self, label: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:04d}-{label}"

    def save(self, df: DataFrame, label: str = "t") -> DataFrame:
        path = self.path(label)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._provq_path = path
        return out

    def drop(self, *dfs: DataFrame | None) -> None:
        for df in dfs:
            path = getattr(df, "_provq_path", None)
            if path:
                self.remove(path)

    def remove(self, path: str) -> None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)

    def clear(self) -> None:
        self.remove(self.root)


def clear_all(spark: SparkSession) -> None:
    """Remove the intermediate tables of all operator calls of this session; their results can't be read any more."""
    for root in _roots.pop(spark.sparkContext.applicationId, []):
        p = spark._jvm.org.apache.hadoop.fs.Path(root)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def stored_bytes(df: DataFrame) -> int:
    """Bytes on disk of a table that ``Workspace.save`` returned."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(df._provq_path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength()


def shared_path(df: DataFrame) -> str:
    """Where ``read_shared`` finds a table that ``Workspace.save`` returned."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(df._provq_path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString()


def read_shared(path: str):
    """A stored table as Arrow, read by a task itself, without Spark."""
    import pyarrow.dataset
    import pyarrow.fs

    fs, at = (pyarrow.fs.LocalFileSystem(), "/" + path[5:].lstrip("/")) if path.startswith("file:") else pyarrow.fs.FileSystem.from_uri(path)
    return pyarrow.dataset.dataset(at, filesystem=fs, format="parquet").to_table()


def is_number(c: Column) -> Column:
    """True where a double is neither null nor NaN."""
    return c.isNotNull() & ~F.isnan(c)


def is_finite(c: Column) -> Column:
    """True where a double is neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def partitions_for(spark: SparkSession, rows: int, rows_each: int) -> int:
    """Partitions so that each holds about ``rows_each`` rows; 1 at least."""
    return max(1, -(-rows // rows_each))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
