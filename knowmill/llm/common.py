"""What the corpus operators share: table access, lineage cuts in the shared folder, and small Python workers."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import tempfile
import uuid
from contextvars import ContextVar

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Separators of words in most contracts; the complement is a word character.
SPACE = " \\t\\n\\x0B\\f\\r"
CLEAN = "spark.cleaner.referenceTracking.cleanCheckpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a temporary one serves a local
    session; other sessions fail, since executors do not see the driver's folders."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="knowmill-"))
        if sc.getConf().get(CLEAN, None) is None:
            sc._jsc.sc().conf().set(CLEAN, "true")  # the checkpoints' own setting is read when one is made
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and reread from the shared folder; unless the session says otherwise, its files go when nothing
    refers to it any more."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: The folders of the run that is under way, if one owns them.
_owner: ContextVar[list[str] | None] = ContextVar("owner", default=None)


@contextlib.contextmanager
def owned(spark: SparkSession):
    """What new_folder makes inside goes when this ends; only a result that has been written elsewhere may leave it. Folders
    of other runs, threads and callers are not touched."""
    mine: list[str] = []
    before = _owner.set(mine)
    try:
        yield
    finally:
        _owner.reset(before)
        for folder in mine:
            delete(spark, folder)


def new_folder(spark: SparkSession, name: str) -> str:
    """An unused path in the shared folder for tables or files that an operator writes. It stays until ``delete`` or the end
    of the run that owns it."""
    folder = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (mine := _owner.get()) is not None:
        mine.append(folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, so that later readers choose columns."""
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def uri_of(folder: str) -> str:
    return "file://" + folder[5:] if folder.startswith("file:/") and not folder.startswith("file://") else folder


def release() -> None:
    """Gives freed memory back to the system. Idle Python workers stay for a while beside those that run."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run):
    """``run`` for mapInArrow, which leaves a small worker behind."""

    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped
