"""Session settings the operators are planned for."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")

SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # The 15-parameter projection is one long arithmetic expression. Above HotSpot's 8 kB limit
    # a whole-stage method is never JIT-compiled; at this limit Spark falls back to the split
    # projection instead, which is (measured) about six times faster for that stage.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Batches to and from Python hold whole texts; a fifth of the default number of rows keeps them small on both sides.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings to a session somebody else built."""
    for key, value in SQL_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster, read from the session.

    Where none is set, a single-process local session (tests, scripts) gets one of its own; any other master must name a
    folder that all executors share.
    """
    sc = spark.sparkContext
    configured = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        configured = tempfile.mkdtemp(prefix="meltframe-checkpoint-")
        sc.setCheckpointDir(configured)
    return configured


def shared_path(spark: SparkSession, kind: str = "tables") -> str:
    """A new, unused path in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{kind}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """The table written to the shared checkpoint folder and read back.

    Cuts the plan like a checkpoint, but is computed once (an eager checkpoint computes its input twice), is columnar,
    and does not depend on any executor staying alive.
    """
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free(*tables: DataFrame) -> None:
    """Delete the files of stored tables that no later plan reads."""
    for table in tables:
        spark = table.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def together(spark: SparkSession, tasks: Sequence[Callable[[], T]], at_once: int = 4) -> list[T]:
    """Results of independent driver-side tasks (fits, folds) whose Spark jobs run side by side; the first error is raised."""
    tasks = [inheritable_thread_target(spark)(task) for task in tasks]
    with ThreadPoolExecutor(max(1, min(at_once, len(tasks)))) as pool:
        return [f.result() for f in [pool.submit(task) for task in tasks]]


def local_session(app: str = "meltframe", cores: str | int = "*", memory: str = "12g") -> SparkSession:
    """Local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", os.environ.get("MELTFRAME_DRIVER_MEMORY", memory))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in SQL_SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return tune(spark)
