"""Tables written to the folder that driver and executors share.

Iterative operators cut their lineage here: a lost executor then costs a re-read, not a re-run, and
later plans know the size of what was written, so that the planner can choose a join by it.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


#: Temporary folders of local applications without spark.checkpoint.dir, by application.
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and Spark is local, as in tests."""
    where = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spark-")
        where = _LOCAL[app]
    return where.rstrip("/")


#: Where written() notes its folders for whoever is to delete them.
_NOTED: ContextVar[list[str] | None] = ContextVar("noted", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/recollect/{name}-{uuid.uuid4().hex[:12]}"
    if (noted := _NOTED.get()) is not None:
        noted.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(table: DataFrame) -> None:
    """Deletes the files of a table from written() that nothing will read again, so that a long job holds no more than it needs."""
    spark = table.sparkSession
    folders = {f.rsplit("/", 1)[0] for f in table.inputFiles()}
    for folder in folders:
        if folder.rsplit("/", 2)[-2] == "recollect":  # only what written() made
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def noting(folders: list[str]) -> Iterator[None]:
    """Within this, the folders that written() makes are added to the list."""
    before = _NOTED.set(folders)
    try:
        yield
    finally:
        _NOTED.reset(before)


def clear(spark: SparkSession, folders: list[str], still: DataFrame) -> None:
    """Deletes the folders but those that `still` reads, and takes them off the list."""
    read = "\n".join(still.inputFiles())
    for folder in [f for f in folders if f.rsplit("/", 1)[-1] not in read]:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        folders.remove(folder)


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """SQL settings for what is run within, by names with __ for the dots; the session has its own again afterwards."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@contextmanager
def bucketed(spark: SparkSession, n: int) -> Iterator[Callable[[DataFrame, str, str], DataFrame]]:
    """put(df, column, name): df as a table in the shared folder, in n buckets by the column, so that joins on it leave it where it is.

    The tables' names are gone afterwards; their files stay, as those of written() do."""
    names: list[str] = []

    def put(df: DataFrame, column: str, name: str) -> DataFrame:
        names.append(f"recollect_{name}_{uuid.uuid4().hex[:12]}")
        path = f"{shared_dir(spark)}/recollect/{names[-1]}"
        df.repartition(n, column).write.format("parquet").bucketBy(n, column).option("path", path).saveAsTable(names[-1])
        return spark.table(names[-1])

    try:
        yield put
    finally:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


#: Rows that one task of a shuffle is to get.
ROWS_EACH = 1_000_000


def spread(spark: SparkSession, rows: int):
    """Within this, shuffles have a partition for every ROWS_EACH rows, and no fewer than the session's; what is written here grows in tasks, not in a task's memory."""
    return settings(spark, spark__sql__shuffle__partitions=str(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS_EACH))))


def lean(spark: SparkSession):
    """Within this, what is shuffled for a table from written() is deleted as soon as the table is there."""
    return settings(spark, spark__sql__classic__shuffleDependency__fileCleanup__enabled="true")


def filtered_early(spark: SparkSession):
    """Within this, a join with a small side prunes the large one by a Bloom filter before its shuffle, whatever its size."""
    return settings(spark, spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold="0")
