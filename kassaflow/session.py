"""Session settings and the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_scopes: list[list[str]] = []


def local_session(cores: int = 8, partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName("kassaflow")
    base = {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.driver.memory": memory,
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
    }
    spark = b.config(map=base | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, as the cluster sets it.

    Only where it is unset and the master is local (tests, one machine) a
    temporary folder is made, used as the checkpoint folder and removed at the
    end of the process. On a cluster an unset folder is an error, as executors
    would write to disks of their own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="kassaflow-")
        spark.sparkContext.setCheckpointDir(_own[app])
        atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
    return _own[app]


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove, at its end, the tables that were written within it. Frames that read them can't be used any more."""
    mine: list[str] = []
    _scopes.append(mine)
    try:
        yield
    finally:
        _scopes.remove(mine)
        for path in mine:
            remove(spark, path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, removed at the end of its ``scratch_scope`` or of the process."""
    path = f"{shared_dir(spark)}/kassaflow/{name}-{uuid.uuid4().hex}"
    for scope in _scopes[-1:]:
        scope.append(path)
    atexit.register(_forget, spark, path)
    return path


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes below a path of the shared file system."""
    fs, p = _fs(spark, path)
    return int(fs.getContentSummary(p).getLength())


def table_bytes(df: DataFrame) -> int:
    """Bytes of the files that a frame reads."""
    return sum(stored_bytes(df.sparkSession, f) for f in df.inputFiles())


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage at a copy that survives the loss of any executor,
    and gives the planner the true size, so that a join with the table is
    broadcast only below ``spark.sql.autoBroadcastJoinThreshold``.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    return spark.read.schema(schema).parquet(path)


def _forget(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            remove(spark, path)
    except Exception:  # the session has ended; the cluster clears its folder
        pass
