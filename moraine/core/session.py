"""Session helpers: settings the engine relies on and the folder shared by all executors."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .errors import LakeError

_CHECKPOINT_KEY = "spark.checkpoint.dir"


def shared_root(spark: SparkSession) -> str:
    """Folder for cut lineage and written intermediate tables.

    The cluster names it in ``spark.checkpoint.dir``. Only a ``local`` master may fall back to a
    folder of this machine; elsewhere a missing setting is an error, because executors on other
    machines could not read what is written there.
    """
    root = spark.conf.get(_CHECKPOINT_KEY, None)
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if not root and current.isDefined():
        root = current.get()
    if not root:
        if not context.master.startswith("local"):
            raise LakeError(f"set {_CHECKPOINT_KEY} to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="moraine-")
    if current.isEmpty():
        context.setCheckpointDir(root)
    if ":" not in root.split("/")[0]:  # no scheme: a folder of the cluster's default file system
        path = context._jvm.org.apache.hadoop.fs.Path(root)
        root = path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nobody else uses."""
    return f"{shared_root(spark).rstrip('/')}/moraine/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with a reliable checkpoint, so a lost executor cannot lose it."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_table(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a table in the shared folder: columnar and small, but not cleaned up."""
    path = scratch_path(df.sparkSession, "cut")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def small_frame(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A DataFrame of a few rows of numbers and strings, as a local relation.

    Unlike one made from a list, its size is known to the optimizer, which so can broadcast it
    where it is small enough, and only there.
    """
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}
    fields = [pa.field(*(name, kinds[kind])) for name, kind in (f.split() for f in ddl.split(", "))]
    columns = zip(*rows) if rows else [[] for _ in fields]
    return spark.createDataFrame(pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=pa.schema(fields)))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per context, for clusters that do not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_moraine_shipped", False):
        return
    package = Path(__file__).resolve().parent.parent
    target = Path(tempfile.mkdtemp(prefix="moraine-")) / f"{package.name}.zip"  # read by the driver's file server only
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for file in sorted(package.rglob("*.py")):
            z.write(file, str(file.relative_to(package.parent)))
    context.addPyFile(str(target))
    context._moraine_shipped = True
