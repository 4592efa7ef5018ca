"""Settings that every query of this library takes from, or gives to, the running session."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of one Arrow batch that Python workers are sent.
BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def make_importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver did, bounds what they are sent at a time, and keeps
    Spark from wrong results of unions.

    A batch for a worker ends at BATCH_BYTES as well as at its number of rows, so long texts don't add up in memory on
    either side; a context that was given a bound of its own keeps it.

    Spark 4.1 may take a union for partitioned by a key although adaptive execution has changed one of its sides, so that
    a window or an aggregate over it sees the rows of one key apart.
    """
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")
    if not spark.sparkContext.getConf().contains(BATCH_SETTING):
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session or its context.

    Where a local session names none (tests, a laptop) a temporary folder of this machine is set as that folder; a
    cluster's session has to name one.
    """
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tesserae-")
        spark.sparkContext.setCheckpointDir(at)
        spark.conf.set("spark.checkpoint.dir", at)
    return at


#: Folders that `written` made and nothing deleted yet, oldest first.
_folders: list[str] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: its lineage ends there and survives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _folders.append(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes the files of tables that `written` made, once nothing reads them any more."""
    for df in tables:
        _deleted(df.sparkSession, {os.path.dirname(x) for x in df.inputFiles()})


def folders() -> tuple[str, ...]:
    """The folders of all written tables that are still there."""
    return tuple(_folders)


def cleared(spark: SparkSession, but: tuple[str, ...] = ()) -> None:
    """Deletes all written tables but those in the folders `but`: for a caller that needs no result that reads them."""
    _deleted(spark, set(_folders) - set(but))


def _deleted(spark: SparkSession, paths: set[str]) -> None:
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    names = {os.path.basename(p) for p in paths}
    _folders[:] = [f for f in _folders if os.path.basename(f) not in names]


def unused(name: str, *tables: DataFrame) -> str:
    """A column name, `name` or longer, that none of the tables has in any case."""
    taken = {c.lower() for t in tables for c in t.columns}
    while name.lower() in taken:
        name += "_"
    return name
