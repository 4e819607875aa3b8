"""Flat files in shared storage, written by tasks and read back in blocks."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


@contextmanager
def published(uri: str) -> Iterator:
    """An output stream that gets its name when complete: a lost or repeated task leaves no half file."""
    system, path = opened(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with system.open_output_stream(own) as out:
            yield out
    except BaseException:
        if system.get_file_info(own).type != fs.FileType.NotFound:
            system.delete_file(own)
        raise
    system.move(own, path)


class Ranges:
    """Reads byte ranges, keeping the last file open."""

    def __init__(self):
        self._uri, self._file = None, None

    def read(self, uri: str, offset: int, length: int) -> bytes:
        if uri != self._uri:
            if self._file is not None:
                self._file.close()
            system, path = opened(uri)
            self._uri, self._file = uri, system.open_input_file(path)
        return self._file.read_at(length, offset)


#: Bytes of files that a task reads, where there are more tasks than that for every core.
TASK_BYTES, TASKS_A_CORE = 64 << 20, 4


def task_count(files: DataFrame, block_bytes: int) -> int:
    """How many tasks read files(length): as many as there are blocks, until every core has TASKS_A_CORE and every
    task TASK_BYTES; beyond that, the number grows with the bytes."""
    n, size = files.agg(F.sum(F.ceil(F.col("length") / block_bytes)), F.sum("length")).first()
    cores = files.sparkSession.sparkContext.defaultParallelism
    return int(max(1, min(n or 0, max(TASKS_A_CORE * cores, -(-(size or 0) // TASK_BYTES)))))


def blocks(files: DataFrame, block_bytes: int) -> DataFrame:
    """(file, uri, length, block, offset): every block of files(file, uri, length), dealt over tasks."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("length") / block_bytes), F.lit(1)) - 1)
    return (
        files.where(F.col("length") > 0)
        .select("file", "uri", "length", F.explode(starts).alias("block"))
        .withColumn("offset", F.col("block") * block_bytes)
        .repartition(task_count(files, block_bytes), "file", "block")
    )
