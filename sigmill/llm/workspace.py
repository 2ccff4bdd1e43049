"""Tables that an operator writes on the way, in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import threading
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession

ROWS_PER_TASK = 20_000
_SETTING = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session. Only a local session may lack it: a folder of this machine is then used, which
    on a cluster no other machine could read."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return f"file://{_own_folder()}"


@cache
def _own_folder() -> str:
    own = tempfile.mkdtemp(prefix="sigmill-")
    atexit.register(shutil.rmtree, own, True)
    return own


class _Cleanup:
    """Lets go of a written table's shuffle files while any thread of the session writes, then leaves the setting as it was."""

    lock, writing, before = threading.Lock(), 0, None

    def __init__(self, spark: SparkSession):
        self.conf = spark.conf

    def __enter__(self) -> None:
        with self.lock:
            if not _Cleanup.writing:
                _Cleanup.before = self.conf.get(_SETTING, None)
                self.conf.set(_SETTING, "true")
            _Cleanup.writing += 1

    def __exit__(self, *_) -> None:
        with self.lock:
            _Cleanup.writing -= 1
            if not _Cleanup.writing:
                self.conf.set(_SETTING, _Cleanup.before) if _Cleanup.before is not None else self.conf.unset(_SETTING)


class Workspace:
    """A folder of its own for one run of an operator. Tables replace lineage: a lost executor costs its running tasks only.

    What is left in it, result tables that may still be read, goes when the driver's JVM ends.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        path, files = self._files(self.root)
        files.mkdirs(path)
        files.deleteOnExit(path)

    def _files(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def write(self, df: DataFrame, name: str, rows: int | None = None, **options: str) -> DataFrame:
        """Writes df, lets go of the shuffle files behind it, and reads the table.

        rows: as many as df has at most, if known; few rows are then written by fewer tasks than the session's shuffles
        have, so that a chain of small tables isn't one of many tiny files.
        """
        path = f"{self.root}/{name}"
        if rows is not None and (tasks := -(-max(rows, 1) // ROWS_PER_TASK)) < int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            df = df.coalesce(tasks)
        with _Cleanup(self.spark):
            df.write.options(**{"compression": "zstd"} | options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path, files = self._files(f"{self.root}/{name}")
            files.delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
