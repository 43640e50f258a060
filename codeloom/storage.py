"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a folder of our own for a master in this very process; on a cluster a
    folder of one machine would lose or split the data, so an error tells to set it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="codeloom-")
        spark.sparkContext.setCheckpointDir(found)
    return found


@contextmanager
def _measured(spark: SparkSession) -> Iterator[None]:
    """Within, joins are planned without estimates: a table of a few compressed MB, or what a generator makes of one, can
    be hundreds of MB in the driver. A side whose shuffled size is under the session's threshold is still broadcast. The
    files of a query's shuffles go when it ends."""
    bound = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None) or spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    put = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": bound, "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    before = {k: spark.conf.get(k, None) for k in put}
    try:
        for k, v in put.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def cut(df: DataFrame, large: bool = False, codec: str | None = None) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: no lineage, and a lost executor loses nothing. The
    table stays until ``release`` or the interpreter's end. ``large``: nothing is broadcast for its estimated size."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/codeloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    with _measured(spark) if large else nullcontext():
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
    if not _written:
        atexit.register(release)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def release(since: int = 0) -> None:
    """Deletes the tables that ``cut`` has written, the first ``since`` excepted: what a long session calls between its
    jobs, once their results are written."""
    while len(_written) > since:
        _remove(*_written.pop())


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
        jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    except Exception:  # the session has ended and its folder is the cluster's to clean
        return
