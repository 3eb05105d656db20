"""Tables that cut lineage: written once to the folder that all machines share, then read by several branches of a plan."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

_own_dir: str | None = None
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder on a local master only."""
    global _own_dir
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="studyloom-plans-")
    return f"file://{_own_dir}"


def own_folder(spark: SparkSession) -> str:
    """A new folder of this program's, cleared at its end."""
    path = f"{shared_dir(spark)}/plans-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def written(df: DataFrame) -> DataFrame:
    """df as a table of its own, until the program ends or ``dropped``."""
    path = own_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Clear tables of ``written`` that nothing reads any more."""
    for t in tables:
        for path in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            if path.rsplit("/", 1)[-1].startswith("plans-"):
                _delete(path)


def _delete(path: str) -> None:
    context = SparkContext._active_spark_context
    if context is not None:
        p = context._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(context._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clear() -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone already
        for path in _made:
            _delete(path)
