"""Token-ID output: documents as token lists in Parquet, made for selective reads.

Rows are range-sorted by document id, so row groups and the page index of doc_id bound what a read of some documents
touches; ids are dictionary-encoded (at most 16 bits an id for vocabularies up to 65,536) or, with encoding="delta",
delta-packed; row groups and pages are kept small. Metadata columns can be read without touching any token page.

Null text counts as empty and yields the end id alone; equal ids of rows stay next to each other; null ids of documents
come first; an empty table writes and reads back empty; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shuffles_freed, small_batches, tokenizer

#: Bytes of a row group and of a page, and the end-of-document id.
ROW_GROUP, PAGE, END_ID = 16 << 20, 64 << 10, 2
LAYOUT = "doc_id long, shard int, shard_start long, n_tokens long, ids array<int>"


def encoder(file: str, end_id: int = END_ID):
    """mapInArrow function: (doc_id, text) in order to LAYOUT; shard_start counts the ids of the task so far."""

    def encode(batches):
        from pyspark import TaskContext

        shard, so_far, encode_all = TaskContext.get().partitionId(), 0, tokenizer(file)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            tokens = [b + end for b in encode_all(batch.column(1).to_pylist())]
            lengths = np.array([len(b) // 4 for b in tokens], np.int64)
            ends = np.concatenate([[0], np.cumsum(lengths)])
            for at in range(0, len(tokens), 128):  # a list column's offsets are 32-bit; and batches stay small
                some = slice(at, at + 128)
                flat = pa.array(np.frombuffer(b"".join(tokens[some]), "<i4"))
                offsets = pa.array((ends[at : at + 129] - ends[at]).astype(np.int32))
                n = len(offsets) - 1
                yield pa.RecordBatch.from_arrays([batch.column(0)[some], pa.array(np.full(n, shard, np.int32)), pa.array(so_far + ends[at : at + n]), pa.array(lengths[some]), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "shard", "shard_start", "n_tokens", "ids"])
            so_far += int(ends[-1])

    return encode


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = END_ID, encoding: str = "dictionary", id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text and writes the token files.

    Texts are dealt by id range before they are encoded, so that the sampling for the ranges reads ids only and each
    text is encoded once.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    options = {"compression": "zstd", "parquet.block.size": ROW_GROUP, "parquet.page.size": PAGE, "parquet.page.row.count.limit": 2000, "parquet.enable.dictionary": "true"}
    if encoding == "delta":
        options |= {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"}
    with shuffles_freed(docs.sparkSession):
        rows.mapInArrow(encoder(tokenizer_file, end_id), LAYOUT).write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: list[str] | None = None, doc_ids: tuple[int, int] | None = None) -> DataFrame:
    """The files' columns, for a range of document ids if given; both reach the Parquet scan."""
    rows = spark.read.schema(LAYOUT).parquet(path)
    if doc_ids:
        rows = rows.where(F.col("doc_id").between(*doc_ids))
    return rows.select(columns) if columns else rows


def shard_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(shard, shard_base): ids before each file. A row per file passes the window, from metadata columns only."""
    sums = read_tokens(spark, path, ["shard", "n_tokens"]).groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    return sums.select("shard", (F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("shard_base"))


def _digest(batches):
    for batch in batches:
        ids = batch.column(3)
        flat, starts = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4"), ids.offsets.to_numpy()
        sums = [zlib.crc32(flat[a:b]) for a, b in zip(starts[:-1], starts[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(starts).astype(np.int64)), pa.array(sums, pa.int64())], names=["doc_id", "shard", "shard_start", "n_tokens", "ids_crc32"])


def token_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and the checksum, all from the written files."""
    small_batches(spark)
    rows = read_tokens(spark, path, ["doc_id", "shard", "shard_start", "ids"]).mapInArrow(_digest, "doc_id long, shard int, shard_start long, n_tokens long, ids_crc32 long")
    return rows.join(shard_offsets(spark, path), "shard").select("doc_id", (F.col("shard_base") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32")
