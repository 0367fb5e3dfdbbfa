"""Intermediate tables in the folder that driver and executors share, to cut lineage."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None
_made: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.  Only a session without executors of its own may leave it unset: it gets a private one."""
    global _own
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        _own = _own or "file://" + tempfile.mkdtemp(prefix="tallyforge-")
        found = _own
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path below this process's own folder in the shared one; the folder goes at exit or with :func:`discard`."""
    home = _made.setdefault(shared_folder(spark), uuid.uuid4().hex)
    return f"{shared_folder(spark)}/tallyforge/{home}/{label}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def complete_numbers(spark: SparkSession, folder: str) -> list[int]:
    """Names below ``folder`` that are numbers and hold a complete output, in order."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    at = path(folder)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at):
        return []
    found = [s.getPath() for s in files.listStatus(at)]
    return sorted(int(p.getName()) for p in found if p.getName().isdigit() and files.exists(path(p, "_SUCCESS")))


def stored(df: DataFrame, label: str, replaces: DataFrame | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.  ``replaces``: a stored table that nothing needs from now on."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    if replaces is not None:
        remove(spark, getattr(replaces, "_stored_at"))
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(spark: SparkSession | None = None) -> None:
    """Delete every intermediate that this process has made.  Call it once the results are written."""
    spark = spark or SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    for folder, home in list(_made.items()):
        remove(spark, f"{folder}/tallyforge/{home}")
        del _made[folder]


def _at_exit() -> None:
    try:
        discard()
    except Exception:  # the session or its gateway may have ended before  # noqa: BLE001
        pass


atexit.register(_at_exit)
