"""The folder that all executors share, for files that sources and sinks exchange."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own under spark.checkpoint.dir. Where that is unset, a folder of our own on a single machine; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", "")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="gleanery-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def as_file(path: str) -> str:
    """A path that open() takes, of one that may be a file: address."""
    return "/" + path[5:].lstrip("/") if path.startswith("file:") else path
