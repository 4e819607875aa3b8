"""Token counts by separator scan over flat, unindexed token files.

A token file is nothing but little-endian unsigned 16-bit ids; every document ends with the
end-of-document id.  Tasks search blocks of a file for that id with numpy; a prefix scan over the blocks of
each file (how many separators lie before, and where the last one is) stitches documents that cross block
boundaries.

Defined cases: a null or empty text is a document of no tokens; tokens behind a file's last separator are
a document that has no end mark (``ended`` false); repeated rows are documents each; an empty table, and an
empty file, give no rows; further columns of the input, whatever their names, are ignored; there is nothing to
tie.  doc_id must be an integer (any other type is refused); a text is tokenised and written whole, however long.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, durable, filled, integer_id, shared_folder
from .files import Ranges, blocks, published

BLOCK_BYTES = 4 << 20
END = 50256


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def write_token_files(docs: DataFrame, vocabulary: str, pattern: str, end: int = END) -> DataFrame:
    """One token file for each partition; returns (file, uri, length, ids): ids lists its documents."""
    if end > 0xFFFF:
        raise ValueError("ids must fit 16 bits")
    folder = shared_folder(docs.sparkSession, "tokens")
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))  # a vocabulary of fixed size

    def run(batches):
        n = TaskContext.get().partitionId()
        codec = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        uri, length, ids = f"{folder}/{n:06d}.u16", 0, []
        with published(uri) as out:
            for batch in batches:
                ids += batch.column(0).to_pylist()
                for x in batch.column(1):
                    tokens = codec.encode_ordinary(x.as_py())
                    tokens.append(end)
                    data = np.array(tokens, "<u2").tobytes()
                    out.write(data)
                    length += len(data)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([uri]), pa.array([length]), pa.array([ids], pa.list_(pa.int64()))], ["file", "uri", "length", "ids"])

    rows = docs.select(integer_id(docs, "doc_id"), filled().alias("text"))
    return durable(arrow_map(rows, run, "file long, uri string, length long, ids array<long>"))


def scan(files: DataFrame, end: int = END, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, ordinal, start, n_tokens, ended) of every document in files(file, uri, length)."""

    def search(batches):
        source = Ranges()
        for batch in batches:
            for file, uri, offset in zip(*(batch.column(c).to_pylist() for c in ("file", "uri", "offset")), strict=True):
                ids = np.frombuffer(source.read(uri, offset, block_bytes), "<u2")
                at = np.flatnonzero(ids == end) + offset // 2
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([offset]), pa.array([offset // 2 + len(ids)]), pa.array([at], pa.list_(pa.int64()))],
                    ["file", "offset", "upto", "ends"],
                )

    # written, as the scan over blocks and the blocks' own separators are two uses
    found = durable(arrow_map(blocks(files, block_bytes), search, "file long, offset long, upto long, ends array<long>"))
    before = Window.partitionBy("file").orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    # of each block the scan moves two numbers, not its separators
    totals = found.select("file", "offset", "upto", F.size("ends").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    scanned = totals.select(
        "file", "offset",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("documents_before"),
        F.coalesce(F.max("last").over(before), F.lit(-1)).alias("end_before"),
        F.when(F.lead("offset").over(Window.partitionBy("file").orderBy("offset")).isNull(), F.col("upto")).alias("file_end"),
    )
    stitched = found.select("file", "offset", "ends").hint("merge").join(scanned.hint("merge"), ["file", "offset"])
    # the last block also closes a document without an end mark
    last = F.coalesce(F.try_element_at("ends", F.lit(-1)), F.col("end_before"))
    open_end = (F.col("file_end") > last + 1)
    rows = stitched.withColumn("ended", F.transform("ends", lambda _: F.lit(True)))
    rows = rows.select(
        "file", "documents_before",
        F.concat("ends", F.when(open_end, F.array("file_end")).otherwise(F.array().cast("array<long>"))).alias("ends"),
        F.concat(F.array("end_before"), "ends").alias("starts"),
        F.size("ends").alias("closed"),
    )
    each = rows.select("file", "documents_before", "closed", "starts", F.posexplode("ends").alias("i", "end"))
    start = F.element_at("starts", F.col("i") + 1) + 1
    return each.select(
        "file", (F.col("documents_before") + F.col("i")).alias("ordinal"), start.alias("start"),
        (F.col("end") - start).alias("n_tokens"), (F.col("i") < F.col("closed")).alias("ended"),
    )


def token_counts(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """Write token files of all documents, then count each document's tokens by scanning the files."""
    files = write_token_files(docs, vocabulary, pattern)
    names = files.select("file", F.posexplode("ids").alias("ordinal", "doc_id")).withColumn("ordinal", F.col("ordinal").cast("long"))
    # both grow with the documents, though the plan's estimate of the unfolded names is small: no broadcast
    return scan(files).hint("merge").join(names.hint("merge"), ["file", "ordinal"]).select("doc_id", "file", "ordinal", "start", "n_tokens")
