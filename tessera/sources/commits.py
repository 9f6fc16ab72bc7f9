"""A ledger of versions: batches are applied whole or not at all, on the version that they were decided on.

``root/log/<version>.json`` names what a version added and what its request was told; ``root/data`` holds the rows. The
log is the truth: data that no log entry names was never applied (:func:`unnamed` lists such folders of failed or
beaten writers). An entry appears at once and only where there is none: by a rename that doesn't overwrite (a file system
such as HDFS, whose renames are atomic), or a hard link (local folders). Of two writers on one base, one wins.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import reconcile
from tessera.sources.files import backup_catalog


class Refused(Exception):
    """A batch that isn't applied; ``gates`` are those that don't hold."""

    def __init__(self, gates: list[str]):
        super().__init__(", ".join(gates))
        self.gates = gates


@dataclass(frozen=True)
class Applied:
    """What a request was told, the same at every repetition."""

    version: int
    request: str
    fingerprint: str
    base: int
    n_lines: int
    n_events: int
    content: str
    data: str
    reused: bool = False


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file unless there is one of its name; readers see all of it or nothing."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    own = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
    temp, fs = _file_system(spark, own)
    out = fs.create(temp, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getScheme() == "file":
            local = lambda p: jvm.java.nio.file.Paths.get(_file_system(spark, p)[0].toUri().getPath(), spark.sparkContext._gateway.new_array(jvm.java.lang.String, 0))
            jvm.java.nio.file.Files.createLink(local(path), local(own))
        else:
            target = fs.makeQualified(_file_system(spark, path)[0])
            none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(fs.makeQualified(temp), target, none)
        return True
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
            raise
        return False
    finally:
        fs.delete(temp, False)


def log(spark: SparkSession, root: str) -> list[Applied]:
    """All versions in their order: a small file each."""
    folder, fs = _file_system(spark, f"{root}/log")
    if not fs.exists(folder):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(folder) if s.getPath().getName()[0] != ".")
    return [_entry(spark, f"{root}/log/{n}") for n in names]


def _entry(spark: SparkSession, path: str) -> Applied:
    at, fs = _file_system(spark, path)
    stream = fs.open(at)
    try:
        return Applied(**json.loads(bytes(stream.readAllBytes())))
    finally:
        stream.close()


def version(spark: SparkSession, root: str) -> int:
    return max((a.version for a in log(spark, root)), default=0)


def read_events(spark: SparkSession, root: str, at: int | None = None) -> DataFrame | None:
    """All events up to a version, each with the ``version`` that added it; None of an empty ledger. One scan of the folders that the log names."""
    named = [a for a in log(spark, root) if at is None or a.version <= at]
    if not named:
        return None
    folder = F.regexp_extract(F.input_file_name(), "/data/([0-9a-f]{32})/", 1)
    rows = spark.read.parquet(*(f"{root}/data/{a.data}/events" for a in named)).withColumn("_data", folder)
    versions = spark.createDataFrame([(a.data, a.version) for a in named], "_data string, version long")
    return rows.join(F.broadcast(versions), "_data").drop("_data")  # a row a version


def frozen(spark: SparkSession, root: str, applied: Applied) -> DataFrame:
    """The lines as they were when the request was applied."""
    return spark.read.parquet(f"{root}/data/{applied.data}/lines")


def apply(root: str, request: str, base: int, classified: DataFrame, events: DataFrame) -> Applied:
    """Append the events of a batch that the ledger doesn't hold, and freeze its lines, as version ``base + 1``.

    Raises :class:`Refused` with the gates that don't hold: lines that wait, targets taken twice, a base that isn't the last
    version (also if another writer comes first). A request that was applied gets the same answer again,
    whatever its base; another batch under its name is refused (``request``). The batch is computed twice here, for its
    fingerprint and to freeze it, and once more where ``events`` derive from it: pass a written table if it costs much.
    """
    spark = classified.sparkSession
    print_ = backup_catalog(lines=classified.select(*sorted(classified.columns))).first()
    fingerprint = f"{print_['n_rows']}:{print_['content_hash']}"

    def repeated() -> Applied | None:
        for a in log(spark, root):
            if a.request == request:
                if a.fingerprint != fingerprint:
                    raise Refused(["request"])
                return Applied(**{**a.__dict__, "reused": True})
        return None

    if (known := repeated()) is not None:
        return known
    # The lines are frozen first, so that the gates read them and don't compute them once more each.
    data = uuid.uuid4().hex
    classified.write.parquet(f"{root}/data/{data}/lines")
    held = spark.read.schema(classified.schema).parquet(f"{root}/data/{data}/lines")
    gates = [r["gate"] for r in reconcile.apply_gates(held, base, version(spark, root)).collect() if not r["holds"]]
    if gates:
        _drop(spark, f"{root}/data/{data}")
        raise Refused(gates)
    ledger = read_events(spark, root, base)
    fresh = events.dropDuplicates(["event_id"]) if ledger is None else reconcile.append_events(ledger, events)
    fresh.write.parquet(f"{root}/data/{data}/events")
    added = backup_catalog(events=spark.read.schema(fresh.schema).parquet(f"{root}/data/{data}/events")).first()
    made = Applied(base + 1, request, fingerprint, base, print_["n_rows"], added["n_rows"], added["content_hash"], data)
    if put_if_absent(spark, f"{root}/log/{made.version:012d}.json", json.dumps({k: v for k, v in made.__dict__.items() if k != "reused"})):
        return made
    _drop(spark, f"{root}/data/{data}")
    # The winner may be the same request, sent twice at once.
    if (known := repeated()) is not None:
        return known
    raise Refused(["base_version"])


def _drop(spark: SparkSession, path: str) -> None:
    at, fs = _file_system(spark, path)
    fs.delete(at, True)


def unnamed(spark: SparkSession, root: str) -> list[str]:
    """Data folders that no version names: of writers that failed, or that are still at work."""
    folder, fs = _file_system(spark, f"{root}/data")
    if not fs.exists(folder):
        return []
    return sorted({s.getPath().getName() for s in fs.listStatus(folder)} - {a.data for a in log(spark, root)})
