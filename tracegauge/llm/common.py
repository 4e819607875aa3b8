"""What several operators share: durable intermediate tables, row identities, table loading."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import shared_folder, shared_root
from ..shipping import ensure

__all__ = ["SPACE_CLASS", "arrow_map", "durable", "filled", "row_uid", "shared_folder", "table"]

#: Words are maximal runs of anything but these six ASCII characters.
SPACE_CLASS = r"[\x20\x09-\x0D]"
#: What may be broadcast: tables whose bytes are counted first and are no more than this.
BROADCAST_BYTES = 32 << 20
#: Rows of a narrow table to a file of its checkpoint.
FILE_ROWS = 250_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def durable(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cut lineage with a checkpoint in shared storage, so that lost executors cost no recomputation.

    ``rows``: about how many narrow rows there are; they are then written by a task for every FILE_ROWS of them, and
    by one for every core of the cluster at least, so that few rows aren't spread over very many files.
    """
    sc = df.sparkSession.sparkContext
    if rows is not None:
        df = df.coalesce(max(sc.defaultParallelism, -(-rows // FILE_ROWS)))
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def row_uid() -> Column:
    """A row number that tells apart rows with the same doc_id; checkpoint before using it twice."""
    return F.monotonically_increasing_id()


def filled(text: str = "text") -> Column:
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def integer_id(df: DataFrame, name: str) -> Column:
    """The integer ids of a table; a column of another type is refused at once, not by a failing task."""
    kind = df.schema[name].dataType.typeName()
    if kind not in ("byte", "short", "integer", "long", "void"):
        raise TypeError(f"{name} must be an integer, not {kind}")
    return df[name].cast("long").alias(name)


def arrow_map(df: DataFrame, f, schema) -> DataFrame:
    """``mapInArrow`` whose function finds this package on the executors."""
    ensure(df.sparkSession)
    return df.mapInArrow(f, schema)
