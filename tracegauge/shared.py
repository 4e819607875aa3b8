"""The folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, else the one the context checkpoints to, as a full URI.

    Where neither is set, a session on one machine gets a temporary folder; on a cluster this is an error, as a
    folder of one machine isn't seen by the others.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and (current := sc._jsc.sc().getCheckpointDir()).isDefined():
        named = current.get()
    if not named:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = _own.setdefault(sc.applicationId, "file://" + tempfile.mkdtemp(prefix="tracegauge-"))
    path = sc._jvm.org.apache.hadoop.fs.Path(named)
    return path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")


def shared_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder under the shared root."""
    return f"{shared_root(spark)}/{kind}-{uuid.uuid4().hex}"
