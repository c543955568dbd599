"""Paths on the shared file system, by way of Hadoop's own client."""

import os
import re
import tempfile
import time
import uuid

from pyspark.sql import SparkSession


_PREFIX = "pagemill-"


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _fs(spark, path).exists(_path(spark, path))


def delete(spark: SparkSession, path: str) -> bool:
    """Remove a directory; False if there was none."""
    return _fs(spark, path).delete(_path(spark, path), True)


def touch(spark: SparkSession, path: str) -> None:
    _fs(spark, path).create(_path(spark, path), True).close()


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the directories in a directory, sorted; empty if it is missing."""
    if not exists(spark, path):
        return []
    return sorted(s.getPath().getName() for s in _fs(spark, path).listStatus(_path(spark, path)) if s.isDirectory())


def parents_of(spark: SparkSession, path: str, pattern: str) -> list[str]:
    """Names of the directories in ``path`` that hold a file like ``pattern``, sorted, by one call."""
    found = _fs(spark, path).globStatus(_path(spark, f"{path}/*/{pattern}"))
    return sorted({s.getPath().getParent().getName() for s in found or []})


def _shared_base(spark: SparkSession) -> str:
    """The shared folder of the cluster.

    The folder is ``spark.checkpoint.dir``.  Only a local session may go
    without it; a temporary folder of the machine is set for it then.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not base and context._jsc.sc().getCheckpointDir().isDefined():
        base = context._jsc.sc().getCheckpointDir().get()
    if not base:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix=_PREFIX)
        context.setCheckpointDir(base)
    return base


def shared_dir(spark: SparkSession) -> str:
    """A new directory name under the shared folder of the cluster."""
    return os.path.join(_shared_base(spark), f"{_PREFIX}{uuid.uuid4().hex}")


def cleanup(spark: SparkSession, older_than: float) -> list[str]:
    """Remove the directories of ``shared_dir`` that nothing was added to for so many seconds; returns their names.

    Results read their tables when they are used, so the age must be more than any of them lives.
    """
    base, until = _shared_base(spark), (time.time() - older_than) * 1000
    if not exists(spark, base):
        return []
    found = _fs(spark, base).listStatus(_path(spark, base))
    old = sorted(s.getPath().getName() for s in found if s.isDirectory() and s.getModificationTime() < until)
    names = [n for n in old if re.fullmatch(f"{_PREFIX}[0-9a-f]{{32}}", n)]
    for name in names:
        delete(spark, os.path.join(base, name))
    return names
