"""Folders that the driver and all executors share, and access to them from tasks."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs
from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below the one the cluster names in ``spark.checkpoint.dir``.

    Only where none is set and the session runs on this machine alone, as in tests, is a folder of this machine used.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallyloom-shared-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def store_of(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI or absolute path, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(uri.rstrip("/"))
