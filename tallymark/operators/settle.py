"""Write an intermediate table once where later steps read it several times."""

from __future__ import annotations

from contextlib import contextmanager
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
_tables: dict[str, str] = {}  # the catalog's name of bucketed ones, by path
# A settled table is read instead of the plan that made it, so what that plan shuffled goes when it is written.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def settle(df: DataFrame, by: list[str] = (), buckets: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the cluster's checkpoint folder.

    Later plans read it instead of repeating the work, take only the columns
    they need, know its size when choosing a join, and survive lost executors.
    Tables stay until ``clear_settled``, or the end of ``settled_here``, to be called
    once all results that come from them are written.

    ``by`` stores the rows in ``buckets`` (default: as many as there are shuffle partitions)
    by the hash that a shuffle by these columns uses, so that joins and
    aggregations by them read the rows where they are. Rows that are together by
    ``by`` already, as after an aggregation, are not shuffled for it. The
    session's catalog keeps the buckets' description.
    """
    spark = df.sparkSession
    path = new_path(spark)
    if not by:
        with settings(spark, _WRITING):
            df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    table = "tallymark_" + path.rsplit("-", 1)[-1]
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    with settings(spark, _WRITING):
        df.write.format("parquet").bucketBy(buckets, *by).option("path", path).saveAsTable(table)
    _tables[path] = table
    return spark.table(table)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings of the session for the jobs that run inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


@contextmanager
def settled_here(spark: SparkSession):
    """Drops at its end what was settled inside, also where it ends by an error."""
    before = set(_written)
    try:
        yield
    finally:
        drop_paths(spark, [p for p in _written if p not in before])


def new_path(spark: SparkSession) -> str:
    """An unused path in the cluster's checkpoint folder."""
    path = f"{shared_folder(spark)}/tallymark-{uuid4().hex}"
    _written.append(path)
    return path


def written_paths() -> list[str]:
    """Paths of the tables that this process settled and that are there still."""
    return list(_written)


def clear_settled(spark: SparkSession) -> int:
    """Delete the tables this process settled; returns how many there were."""
    return drop_paths(spark, list(_written))


def drop_paths(spark: SparkSession, paths: list[str]) -> int:
    """Delete tables at ``paths``, once nothing will read them again."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path
    configuration = spark._jsc.hadoopConfiguration()
    for path in paths:
        if path in _tables:
            spark.sql(f"drop table if exists {_tables.pop(path)}")
        jvm_path(path).getFileSystem(configuration).delete(jvm_path(path), True)
    _written[:] = [p for p in _written if p not in paths]
    return len(paths)


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or the one given to ``setCheckpointDir``."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return folder.rstrip("/")
