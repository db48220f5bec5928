"""The folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: list[str] = []


def new_folder(spark: SparkSession, what: str) -> str:
    """A name for a folder below spark.checkpoint.dir that no other call has; a session in one process without that setting
    (as in tests) gets one in a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if not _OWN:
            _OWN.append(f"file://{tempfile.mkdtemp(prefix='canloom-')}")
        base = _OWN[0]
    return f"{base.rstrip('/')}/canloom/{what}-{uuid.uuid4().hex}"
