"""Tables in the folder that the driver and the executors share, for lineage that must not hang on single executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Paths that stored() has written within temporary(), innermost last.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where a session on one machine has none, as in tests, a folder of this machine is set once; a session on a cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="strophe-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def passing(spark: SparkSession, path: str) -> None:
    """Has a path deleted when the session's driver ends, or earlier, when the temporary() around it does."""
    p, files = _file_system(spark, path)
    files.deleteOnExit(p)
    if _open:
        _open[-1].append(path)


def stored(df: DataFrame, name: str, plain: bool = False) -> DataFrame:
    """df, written once to the shared folder and read from there: later stages start from replicated files and not from lost executors. The files go when the driver ends, or when the temporary() around this does.

    plain: values are written as they are. Spark takes a table's size from its files, and sequences in order pack to less than a byte a row, so that it would broadcast millions of rows, and what is made of them, through the driver."""
    spark = df.sparkSession
    path = scratch(spark, name)
    w = df.write
    if plain:
        w = w.option("compression", "none").option("parquet.enable.dictionary", "false")
    w.parquet(path)
    passing(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that stored() wrote and nobody needs any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p, files = _file_system(spark, path)
        files.delete(p, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, all that was stored within it."""
    paths: list[str] = []
    _open.append(paths)
    try:
        yield
    finally:
        _open.remove(paths)
        for path in paths:
            p, files = _file_system(spark, path)
            files.delete(p, True)


def settled(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What make() gives, written to the shared folder, without the tables that were stored on the way to it."""
    path = scratch(spark, name)
    with temporary(spark):
        df = make()
        df.write.parquet(path)
    passing(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def redealt(df: DataFrame, *columns: str) -> DataFrame:
    """df, dealt to tasks by another hash of the columns. A side of a join that an aggregate by the join's keys has left is joined where it is, and then the other side can't be split where a key is hot; a side that is dealt anew is shuffled for the join, and both can."""
    from pyspark.sql import functions as F

    return df.repartition(F.xxhash64(*columns, F.lit(1)))
