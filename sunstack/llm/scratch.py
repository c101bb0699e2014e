"""Intermediate tables in the folder that driver and executors share.

Lineage is cut with Parquet tables under ``spark.checkpoint.dir``: they survive
the loss of any executor, are column-pruned on every later read and are never
node-local. Where that setting is absent a local master (tests, a laptop) gets a temporary
folder of its one machine; on a cluster that is an error.

A table stays as long as a frame may read it: ``dropping`` deletes those made inside it
but for the ones kept, and what is left goes when the process ends.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_made: list[str] = []


def folder(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir, or on a local master a folder of this process if it is unset."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    master, app = spark.conf.get("spark.master", ""), spark.conf.get("spark.app.id", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="sunstack-scratch-")
    return _own[app]


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and return a reader of what was written."""
    spark = df.sparkSession
    path = f"{folder(spark)}/sunstack/{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    if not _made:
        atexit.register(_at_end, spark)
    _made.append(path)
    give_back(spark)
    return spark.read.schema(df.schema).parquet(path)


def give_back(spark: SparkSession) -> bool:
    """Give native memory that the driver's threads have freed back to the machine, as ``text.release`` does in Python workers; False where its JVM can't.

    Each query plan runs on tens of short-lived threads, and the C library keeps what they free in arenas of their own."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    try:
        call = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")  # the server's own class isn't open
        given = gateway.new_array(jvm.java.lang.Object, 4)
        given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    except Py4JError:  # a JVM before 17.0.9, or another C library
        return False
    return True


def let_go(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are done; until the driver collects its garbage they stay on the executors' disks."""
    for wait in (0.5, 0):  # one collection is not enough: what ended last is held by its listeners
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(wait)


def _drop(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name).getParent()
        path.getFileSystem(hadoop).delete(path, True)
        _made.remove(name)


def _at_end(spark: SparkSession) -> None:
    with suppress(Exception):  # the session may have ended before
        drop_all(spark)


def drop_all(spark: SparkSession) -> None:
    """Delete every table made by this process; frames built on them must not be used afterwards."""
    _drop(spark, list(_made))


@contextmanager
def dropping(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Delete the tables made inside, but for those whose frames are put into the list."""
    before, kept = set(_made), []
    yield kept
    files = {f for df in kept for f in df.inputFiles()}
    _drop(spark, [p for p in _made if p not in before and not any(p.split("://")[-1].lstrip("/") in f for f in files)])
