"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``, removed when the application ends.

    Where the session names none, a local master gets a temporary folder (tests); a cluster has to name one, as its
    executors don't see each other's disks.
    """
    application = spark.sparkContext.applicationId
    if application not in _own:
        top = spark.conf.get("spark.checkpoint.dir", None)
        if not top:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            top = tempfile.mkdtemp(prefix="tidemark-")
        jvm = spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{top}/tidemark-{application}")
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(folder)
        fs.deleteOnExit(folder)
        _own[application] = fs.makeQualified(folder).toString()
    return _own[application]


def mounted(uri: str) -> str:
    """The path of a folder on a mounted file system."""
    path = uri.removeprefix("file://") if uri.startswith("file://") else uri.removeprefix("file:")
    if "://" in path:
        raise ValueError(f"plain files are needed there: spark.checkpoint.dir must be a mounted folder, not {uri}")
    return path
