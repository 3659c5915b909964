"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of checkpoints; a session on one machine gets a temporary one where none is set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lorespark-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


#: Written tables that are still there, with their session.
_TABLES: dict[str, SparkSession] = {}


def drop(*frames: DataFrame) -> None:
    """Deletes written tables that nothing will read again."""
    for frame in frames:
        _delete(frame.table_path)


def _delete(path: str) -> None:
    context = _TABLES.pop(path).sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _delete_all() -> None:
    """What a result may still read stays until the driver ends."""
    try:
        for path in list(_TABLES):
            _delete(path)
    except Exception:  # the session is gone, and with it the way to the folder
        _TABLES.clear()


def folder(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    _TABLES[path] = spark
    return path


def saved(spark: SparkSession, frame: DataFrame, *by: str) -> DataFrame:
    """The frame written to the shared folder, to cut the lineage of a loop and to compute it once; in folders ``by`` columns."""
    path = folder(spark)
    frame.write.partitionBy(*by).parquet(path)
    out = spark.read.schema(frame.schema).parquet(path)
    out.table_path = path
    return out


#: Bytes up to which a table is spread over all cores.
SMALL_BYTES = 256 << 20


def spread(frame: DataFrame) -> DataFrame:
    """The rows of a small table, by Catalyst's estimate, over all cores; a larger one as it is read.

    A file of one row group is read by one task, which would leave the other cores idle
    where rows cost much; tables of many row groups are spread by being read.
    """
    size = int(frame._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return frame.repartition(frame.sparkSession.sparkContext.defaultParallelism) if size <= SMALL_BYTES else frame
