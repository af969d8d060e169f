"""What every part shares: a session for local work, places to write, tables to read."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Used only where the session names no checkpoint folder, as in local tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/textlode"

#: What Python workers are told: a task has one core, so a second thread only takes memory.
WORKER = {"OPENBLAS_NUM_THREADS": "1", "OMP_NUM_THREADS": "1", "MALLOC_ARENA_MAX": "2", "MALLOC_TRIM_THRESHOLD_": "1000000", "ARROW_DEFAULT_MEMORY_POOL": "system"}


def local_session(cpus: str | int = "*", memory: str = "8g", settings: dict[str, str] | None = None) -> SparkSession:
    """A local session for tests, the command line and the bench."""
    return (
        SparkSession.builder.config(map=settings or {})
        .master(f"local[{cpus}]")
        .appName("textlode")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(cpus if cpus != "*" else os.cpu_count()))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir of the session."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(LOCAL_CHECKPOINTS)
        named = LOCAL_CHECKPOINTS
    return named.rstrip("/")


#: Folders of the tables parked in the innermost scope.
SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables parked inside, unless they are to be kept, are removed at the end: for work whose results are written by then."""
    mine: list[str] = []
    token = SCOPE.set(mine)
    try:
        yield
    finally:
        SCOPE.reset(token)
        for path in mine:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def park(df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
    """Write a table into the shared folder and read it again: cuts lineage, survives lost executors. keep: beyond the scope it is parked in."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/textlode/{tag}-{uuid.uuid4().hex}"
    if not keep and (mine := SCOPE.get()) is not None:
        mine.append(path)
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it, each with one thread and no more allocator arenas than it needs."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    for name, value in WORKER.items():
        env.setdefault(name, value)
    if root not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = f"{root}:{env.get('PYTHONPATH', '')}".rstrip(":")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(docs: DataFrame) -> DataFrame:
    """Documents spread for work on their texts: as they are read where there are two files a core, else by an exchange, for one file may hold all rows."""
    enough = len(docs.inputFiles()) >= 2 * docs.sparkSession.sparkContext.defaultParallelism
    return docs if enough else docs.repartition("doc_id")


def stamp(spark: SparkSession, path: str) -> int:
    """A digest of the files at a path: names, sizes and times."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hash(tuple((x.getPath().getName(), x.getLen(), x.getModificationTime()) for x in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)))
