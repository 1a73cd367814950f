"""Session helpers shared by every operator."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees: spark.checkpoint.dir, or in a local session without it (tests) one of
    our own. A cluster must name one: its machines don't see each other's folders."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if master != "local" and not master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = f"file://{tempfile.gettempdir()}/checkpoints/sparkgrove-{spark.sparkContext.applicationId}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def _at(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage and survives lost executors. The files go
    when the driver ends, or by discard()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, where = _at(spark, path)
    fs.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession, groups: int) -> int:
    """Tasks for groups whose work isn't measured by their bytes: Spark leaves an exchange of a given number of
    partitions as it is, where it would merge small ones."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, min(groups, max(parts, groups // 16)))


def discard(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    for file in {f.rpartition("/")[0] for f in df.inputFiles()}:
        fs, where = _at(df.sparkSession, file)
        fs.delete(where, True)


#: Bytes of a batch on its way to Python, in place of Spark's default of 64 MB: a few are held at a time.
BATCH = str(8 << 20)
_BATCH_CONF, _DEFAULT = "spark.sql.execution.arrow.maxBytesPerBatch", {"67108864b", "64MB", "64m", str(64 << 20)}


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors where PYTHONPATH doesn't already name its folder, and
    bound batches on their way to Python where the session has the default."""
    if spark.conf.get(_BATCH_CONF, "64m") in _DEFAULT:
        spark.conf.set(_BATCH_CONF, BATCH)
    root = Path(__file__).resolve().parents[1]
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    d = tempfile.mkdtemp(prefix="sparkgrove-")  # the driver serves the file to executors until it ends
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    file = Path(d, "sparkgrove.zip")
    with zipfile.ZipFile(file, "w") as z:
        for p in Path(__file__).resolve().parent.rglob("*.py"):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(file))
    _SHIPPED.add(app)
