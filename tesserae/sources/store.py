"""The memory store: seven tables as DataFrames, kept as versions of Parquet under one root.

A version is a folder of tables that is written whole and never changed. Versions are numbered by small files under
commits, each of which names a folder; that of the highest number counts. A commit is a file that is written under
another name and then renamed, never over one that is there: readers see the old version or the new one, a job that
dies leaves the old one standing, and of two writers that started from one version the second gets a Conflict and has
to start again from the new one (`changed` does so). Memories and embeddings are bucketed by nothing: they are written
sorted by id inside their files, so that Parquet's minima and maxima prune.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae import schema as S

SORTED_BY = {"memories": "id", "embeddings": "id", "associations": "memory_a", "exposures": "created_at", "attributions": "memory_id", "aliases": "old_id", "state": "key"}


@dataclass(frozen=True)
class Store:
    memories: DataFrame
    associations: DataFrame
    embeddings: DataFrame
    exposures: DataFrame
    attributions: DataFrame
    aliases: DataFrame
    state: DataFrame
    #: The number of the version that this store was read from; None for one that was made otherwise.
    number: int | None = None

    @property
    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in S.TABLES}

    @property
    def spark(self) -> SparkSession:
        return self.memories.sparkSession

    def with_(self, **tables: DataFrame) -> Store:
        return replace(self, **tables)


def empty(spark: SparkSession, **tables: DataFrame) -> Store:
    """A store of the given tables; the others are empty."""
    return Store(**{name: tables[name] if name in tables else spark.createDataFrame([], S.struct(name)) for name in S.TABLES})


def conformed(df: DataFrame, table: str) -> DataFrame:
    """The columns of a table, in order and cast; those that are missing are null."""
    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in S.struct(table).fields))


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


class Conflict(RuntimeError):
    """Another writer made a version since this store was read."""


def _commits(spark: SparkSession, root: str) -> list[int]:
    fs, path = _fs(spark, f"{root}/commits")
    names = [status.getPath().getName() for status in fs.listStatus(path)] if fs.exists(path) else []
    return sorted(int(n) for n in names if n.isdigit())


def _committed(spark: SparkSession, root: str, number: int, version: str) -> None:
    """Makes a version the one of a number, unless there is one of that number."""
    fs, temporary = _fs(spark, f"{root}/commits/.{version}")
    out = fs.create(temporary, True)
    out.write(bytearray(version.encode()))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    _, path = _fs(spark, f"{root}/commits/{number:012d}")
    never = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    never[0] = getattr(hadoop, "Options$Rename").NONE
    try:
        hadoop.FileContext.getFileContext(path.toUri(), spark._jsc.hadoopConfiguration()).rename(temporary, path, never)
    except Exception:
        fs.delete(temporary, False)
        if fs.exists(path):
            raise Conflict(f"version {number} of {root} is another writer's") from None
        raise


def current(spark: SparkSession, root: str) -> str | None:
    """The folder of the version that counts, or None."""
    numbers = _commits(spark, root)
    return _folder(spark, root, numbers[-1]) if numbers else None


def _folder(spark: SparkSession, root: str, number: int) -> str:
    return f"{root}/{spark.read.text(f'{root}/commits/{number:012d}').first()['value'].strip()}"


def read(spark: SparkSession, root: str) -> Store:
    """The store of the current version, or an empty one."""
    numbers = _commits(spark, root)
    if not numbers:
        return replace(empty(spark), number=0)
    at = _folder(spark, root, numbers[-1])
    return Store(**{name: spark.read.schema(S.TABLES[name]).parquet(f"{at}/{name}") for name in S.TABLES}, number=numbers[-1])


def write(store: Store, root: str) -> Store:
    """Writes all tables as the version after the one that the store was read from, and reads it back.

    A Conflict if there is such a version already. A store that was not read from a root follows the current version.
    """
    spark = store.spark
    number = store.number
    if number is None:
        number = max(_commits(spark, root), default=0)
    version = f"v-{uuid.uuid4().hex}"
    for name, df in store.tables.items():
        conformed(df, name).sortWithinPartitions(SORTED_BY[name]).write.parquet(f"{root}/{version}/{name}")
    try:
        _committed(spark, root, number + 1, version)
    except Conflict:
        fs, path = _fs(spark, f"{root}/{version}")
        fs.delete(path, True)
        raise
    return read(spark, root)


def changed(spark: SparkSession, root: str, change: Callable[[Store], Store], tries: int = 5) -> Store:
    """Reads the store, changes and writes it; where another writer came first, again from the version that it made."""
    for left in range(tries - 1, -1, -1):
        try:
            return write(change(read(spark, root)), root)
        except Conflict:
            if not left:
                raise
    raise ValueError("tries must be 1 or more")


def vacuum(spark: SparkSession, root: str) -> int:
    """Deletes the versions that others have followed, and says how many there were.

    A folder that no commit names stays: a writer may be at work on it.
    """
    n = 0
    for number in _commits(spark, root)[:-1]:
        fs, old = _fs(spark, _folder(spark, root, number))
        fs.delete(old, True)
        fs.delete(_fs(spark, f"{root}/commits/{number:012d}")[1], False)
        n += 1
    return n
