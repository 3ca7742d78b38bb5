"""Written intermediate tables.

A table that is used more than once is written as Parquet to the folder that the
cluster names in ``spark.checkpoint.dir`` and read again. That cuts the lineage and
survives lost executors, as the folder is shared storage.
"""

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: list[str] = []
_written: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables.

    Only a local master may do without ``spark.checkpoint.dir``; it gets one temporary
    folder for each process. On a cluster an unset folder is an error.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local_root:
        _local_root.append("file://" + tempfile.mkdtemp(prefix="netlens-"))
    return _local_root[0]


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a scan of what was written."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/netlens/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the table behind a frame that ``materialize`` returned."""
    path = getattr(df, "_scratch_path", None)
    if path:
        delete(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def written() -> int:
    """How many tables are written and not released; a mark for ``release_since``."""
    return len(_written)


def release_since(mark: int, keep: DataFrame) -> None:
    """Delete the tables written since the mark, but for the one behind ``keep``, which none of the others may be needed for."""
    kept = getattr(keep, "_scratch_path", None)
    for spark, path in _written[mark:]:
        if path != kept:
            delete(spark, path)
    _written[mark:] = [x for x in _written[mark:] if x[1] == kept]


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark reaches; one that isn't there is no error."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean_up() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone already
            return
