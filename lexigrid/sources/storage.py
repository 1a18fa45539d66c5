"""Folders that every executor can reach."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[tempfile.TemporaryDirectory] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's URI below ``spark.checkpoint.dir``. Without that setting a local session gets a
    temporary folder of this process; a cluster, whose machines would each see their own, gets an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append(tempfile.TemporaryDirectory(prefix="lexigrid-"))
        base = "file://" + _own[0].name
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
