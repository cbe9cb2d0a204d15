"""Intermediate tables in the folder that all executors share.

A table that several jobs read is written once as Parquet below
``spark.checkpoint.dir``: it cuts the lineage, survives the loss of executors,
is read with column pruning, and gives later plans exact sizes.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder where it is unset and Spark runs on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="lodestone-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def materialise(df: DataFrame, name: str = "table", *by: str) -> DataFrame:
    """Write ``df`` to the shared folder, in folders ``by`` columns if given, and return the table read back, rows and columns unchanged."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*by).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a table that :func:`materialise` returned and nothing reads any more."""
    spark = table.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(scan: DataFrame) -> DataFrame:
    """A scan that feeds costly Python work, over all cores: one of fewer partitions than cores (a small or a single file) is
    dealt out anew, any other is left as it is. ``scan`` must be without shuffles, as its partitions are counted."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


_REMEMBERED: dict[tuple, object] = {}
#: Files of a table up to which its state is asked for.
MOST_FILES = 200


def state_of(*tables: DataFrame) -> tuple | None:
    """The plans, and path, size and time of the files below them, as a key of what was made of them; None if they are not
    files or many."""
    out: list = []
    for table in tables:
        files = sorted(table.inputFiles())
        if not files or len(files) > MOST_FILES:
            return None
        spark = table.sparkSession
        out += [spark.sparkContext.applicationId, table.semanticHash()]
        for f in files:
            path = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(f))
            at = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path)
            out.append((f, at.getLen(), at.getModificationTime()))
    return tuple(out)


def remembered(state: tuple | None, name: str, make: Callable[[], T]) -> T:
    """What ``make`` gives, made once for each state of the tables it is made of; anew if that is not known, or if tables among it are gone."""
    if state is None:
        return make()
    key = (name, *state)
    if key not in _REMEMBERED or not _there(_REMEMBERED[key]):
        _REMEMBERED[key] = make()
    return _REMEMBERED[key]  # type: ignore[return-value]


def _there(made: object) -> bool:
    for table in made if isinstance(made, tuple) else (made,):
        if isinstance(table, DataFrame) and (files := table.inputFiles()):
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.sparkSession._jvm.java.net.URI(files[0]))
            if not path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).exists(path):
                return False
    return True


def clear(spark: SparkSession) -> None:
    """Delete every table that :func:`materialise` wrote; call it once the results are stored."""
    _REMEMBERED.clear()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/lodestone")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
