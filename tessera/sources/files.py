"""Files under a contract: delimited batches, verified bytes, appended tables and versioned snapshots."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.texts import csv_cell


class ContractError(ValueError):
    """A source that isn't what its contract says."""


def contract_csv(spark: SparkSession, path: str, columns: list[str], sep: str = ",", rows: int | None = None, sha256: str | None = None) -> DataFrame:
    """A delimited file as texts, after its hash, its exact header and its number of rows have been checked.

    Malformed records fail the read; nothing is repaired. Raises :class:`ContractError`.
    """
    if sha256 is not None:
        held = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).filter(F.col("h") == sha256)
        if held.limit(1).count() == 0:
            raise ContractError(f"{path}: other content than the contract's")
    found = spark.read.options(header=True, sep=sep, mode="FAILFAST", multiLine=True, escape='"', inferSchema=False).csv(path)
    names = [c.removeprefix("\ufeff") for c in found.columns]
    if names != columns:
        raise ContractError(f"{path}: columns {names}, not {columns}")
    found = found.toDF(*names)
    if rows is not None and (n := found.count()) != rows:
        raise ContractError(f"{path}: {n} rows, not {rows}")
    return found


def verified(files: DataFrame, catalog: DataFrame, path: str = "path") -> DataFrame:
    """``files`` (path, length, content) that the catalog (path, bytes, sha256) knows, with ``issue``: size, hash or null."""
    known = catalog.select(F.col(path), F.col("bytes").alias("_bytes"), F.col("sha256").alias("_sha"))
    issue = F.when(F.col("length") != F.col("_bytes"), "size").when(F.sha2("content", 256) != F.col("_sha"), "hash")
    return files.join(known, path).withColumn("issue", issue).drop("_bytes", "_sha")


def append_new(rows: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Append the rows whose key the table at ``path`` doesn't hold yet, one of each key; a second call adds nothing. Returns what it added."""
    spark = rows.sparkSession
    fresh = rows.dropDuplicates(keys)
    if _exists(spark, path):
        fresh = fresh.join(spark.read.parquet(path).select(*keys), keys, "left_anti").select(rows.columns)
    batch = f"{path}/batch={uuid.uuid4().hex}"
    fresh.write.parquet(batch)
    return spark.read.parquet(batch)


def write_snapshot(df: DataFrame, root: str, version: int, again: bool = False) -> None:
    """A table's state as one immutable version; a version that exists is an error, so one writer wins.

    Readers take the highest version whose write was completed. An only writer that knows its version not to be completed
    writes it ``again``.
    """
    df.write.mode("overwrite" if again else "errorifexists").parquet(f"{root}/version={version:012d}")


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> tuple[DataFrame, int]:
    """A version of a snapshot table, the last completed one by default."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(root)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        raise FileNotFoundError(root)
    if version is None:
        done = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(folder) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        if not done:
            raise FileNotFoundError(root)
        version = max(done)
    return spark.read.parquet(f"{root}/version={version:012d}"), version


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def export_lines(rows: DataFrame, columns: list[str], plain: tuple[str, ...] = (), sep: str = ";") -> Column:
    """One line of an exported file: every cell quoted, formulas disarmed but in ``plain`` (numeric) columns."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
    return F.concat_ws(sep, *(quoted(c) if c in plain else csv_cell(F.col(c).cast("string")) for c in columns))


def export_csv(rows: DataFrame, path: str, columns: list[str], order: list[str], plain: tuple[str, ...] = (), sep: str = ";") -> None:
    """Text files in order of their names: a header in each, CRLF line ends. Ranges of the order are written in parallel."""
    lines = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(export_lines(rows, columns, plain, sep).alias("line"))
    header = sep.join(f'"{c}"' for c in columns)
    lines.withColumnRenamed("line", header).write.options(header=True, quote="", escape="", lineSep="\r\n", sep="\x01", encoding="UTF-8").csv(path)


def backup_catalog(**tables: DataFrame) -> DataFrame:
    """(table, n_rows, content_hash) of a backup: a hash that doesn't depend on the order of rows.

    Each row's hash is split into two exact sums, so that the catalog is one pass over each table.
    """
    out = None
    for name, df in sorted(tables.items()):
        row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
        part = lambda i: F.sum(F.conv(F.substring(row, i, 15), 16, 10).cast("decimal(38,0)"))  # noqa: E731,B023
        one = df.agg(F.count("*").alias("n_rows"), F.sha2(F.concat_ws(":", part(1), part(16)), 256).alias("content_hash")).select(F.lit(name).alias("table"), "n_rows", "content_hash")
        out = one if out is None else out.unionByName(one)
    return out


def catalog_issues(reserved: DataFrame, objects: DataFrame, now: Column) -> DataFrame:
    """(object_key, issue): reservations (object_key, expires_at) that ended without an object, and objects that none reserved."""
    ended = reserved.filter(F.col("expires_at") < now).join(objects, "object_key", "left_anti").select("object_key", F.lit("expired").alias("issue"))
    return ended.unionByName(objects.join(reserved, "object_key", "left_anti").select("object_key", F.lit("orphan").alias("issue")))
