"""Session helpers: table access, the shared work folder, staged tables.

Nothing here keeps state on one machine: staged tables and checkpoints go to the
folder the cluster names in ``spark.checkpoint.dir``.  Only a local session
without that setting gets a temporary folder of its own.
"""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIRS: dict[str, str] = {}
_SCOPE = threading.local()


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``base`` (a file or a folder of files)."""
    return spark.read.parquet(f"{base}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; set for local sessions that have none."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = sc.applicationId
    if app not in _LOCAL_DIRS:
        _LOCAL_DIRS[app] = "file://" + tempfile.mkdtemp(prefix="interlock-")
        sc.setCheckpointDir(_LOCAL_DIRS[app])
    return _LOCAL_DIRS[app]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the file system it lives on."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def move(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder; the parent of ``target`` is made when missing."""
    jvm = spark.sparkContext._jvm
    a, b = jvm.org.apache.hadoop.fs.Path(source), jvm.org.apache.hadoop.fs.Path(target)
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(b.getParent())
    return fs.rename(a, b)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def data_files(spark: SparkSession, path: str) -> list[int]:
    """Sizes in bytes of a folder's data files."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [f.getLen() for f in fs.listStatus(at) if f.getPath().getName()[0] not in "_."]


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(at)) if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text, through the file system it lives on."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that is there whole or not at all; an existing one is an error."""
    part = f"{path}.{uuid.uuid4().hex[:8]}.part"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(part)
    stream = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if exists(spark, path) or not move(spark, part, path):
        remove(spark, part)
        raise FileExistsError(path)


def timed_by_name(spark: SparkSession, path: str) -> None:
    """Sets the times of a folder's data files a second apart in order of their names, as a file stream reads the oldest first."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = sorted((f.getPath().getName(), f.getModificationTime(), f.getPath()) for f in fs.listStatus(at) if f.getPath().getName()[0] not in "_.")
    for k, (_, _, file) in enumerate(found):
        fs.setTimes(file, found[0][1] + 1000 * k, -1)


@contextmanager
def scratch_ends(spark: SparkSession) -> Iterator[None]:
    """Tables staged by this thread inside are deleted at its end; what it returns must have been written elsewhere."""
    before, _SCOPE.paths = getattr(_SCOPE, "paths", None), []
    try:
        yield
    finally:
        for path in _SCOPE.paths:
            remove(spark, path)
        _SCOPE.paths = before


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the driver ends, or its scope."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    if getattr(_SCOPE, "paths", None) is not None:
        _SCOPE.paths.append(path)
        return path

    def clean() -> None:
        try:
            remove(spark, path)
        except Exception:  # the session may be gone; the folder then stays
            pass

    atexit.register(clean)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
