"""Tables in the folder that driver and executors share: they cut lineage and survive lost executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only a local session (tests) may leave it unset; it then gets a temporary folder.
    """
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    set_dir = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.conf.set("spark.checkpoint.dir", set_dir)
    return set_dir


#: Tables that :func:`written` has made inside the innermost :func:`tidied`.
_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write ``df`` as Parquet in the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    if (made := _made.get()) is not None:
        made.append(table)
    return table


@contextmanager
def tidied() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables written inside are deleted at the end, but for those that frames passed to the given function still read.

    These belong to the surrounding ``tidied``, if there is one.
    """
    outer, made, kept = _made.get(), [], []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df)
        return df

    token = _made.set(made)
    try:
        yield keep
    finally:
        _made.reset(token)
        folders = lambda df: {f.rsplit("/", 1)[0] for f in df.inputFiles()}
        read = set().union(*map(folders, kept))
        for table in made:
            if not folders(table) & read:
                drop_written(table)
            elif outer is not None:
                outer.append(table)


def drop_written(df: DataFrame) -> None:
    """Delete the files of a table made by :func:`written` once nothing reads it any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    shared = shared_dir(spark).split("://", 1)[-1].rstrip("/")
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if shared.strip("/") in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
