"""Token ids in ORC files: run-length encoded ids, row indexes, Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_batches, scratch, slices, text_of, view
from .tokens import word_bpe

#: Stripes are the unit of parallel reads and of pruning.
STRIPE_BYTES = 16 << 20


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append end_id, and write ORC files in ascending id order.

    Files hold part, doc_id, local_start (ids of the same file before it), n_tokens and ids. Documents are range
    partitioned by id and sorted within; a file covers a range of ids, so readers prune files, stripes and row groups
    by the ids' statistics and Bloom filters. Only texts are shuffled, once. Null text is empty (end_id alone);
    null ids come first; rows with the same id stay next to each other, by text. Other columns are not carried and may
    have any names; an empty table makes files without rows.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(tokenizer)
    end = np.array([end_id], "<u4").tobytes()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, ctx = word_bpe(shared.value), TaskContext.get()
        part, at = ctx.partitionId() if ctx else 0, 0
        for batch in batches:
            raw, off = view(batch.column(1))
            for lo, hi in slices(raw, off):
                ids = [coder.encode(raw[off[i] : off[i + 1]].tobytes()) + end for i in range(lo, hi)]
                coder.trim()
                sizes = np.array([len(x) // 4 for x in ids], np.int64)
                ends = np.cumsum(sizes)
                flat = pa.array(np.frombuffer(b"".join(ids), "<u4").astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(hi - lo, part, np.int32)), batch.column(0).slice(lo, hi - lo), pa.array(at + ends - sizes), pa.array(sizes), pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), flat)],
                    ["part", id_col, "local_start", "n_tokens", "ids"],
                )
                at += int(ends[-1])

    texts = docs.select(F.col(id_col), text_of(text_col).alias("_text"))
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), texts.rdd.getNumPartitions())
    ordered = texts.repartitionByRange(n, id_col).sortWithinPartitions(id_col, "_text")
    (
        ordered.mapInArrow(run, f"part int, `{id_col}` {kind}, local_start bigint, n_tokens bigint, ids array<int>")
        .write.format("orc")
        .options(**{"compression": "zstd", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(STRIPE_BYTES), "orc.bloom.filter.columns": id_col, "orc.bloom.filter.fpp": "0.01"})
        .save(path)
    )


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Documents of write_tokens() with `start`: ids of all documents before. Files are summed one row each."""
    files = spark.read.orc(path)
    sums = files.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    # a row for each file, whatever the number of documents
    base = sums.select("part", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return files.join(F.broadcast(base), "part").select(id_col, (F.col("_base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def ids_crc32(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The given columns with ids replaced by the crc32 of their little-endian unsigned 32-bit form."""
    arrow_batches(rows.sparkSession)
    keep = [c for c in rows.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(batch.num_columns - 1)
            flat = np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False).astype("<u4"))
            at = np.r_[0, np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))].tolist()
            crc = pa.array([zlib.crc32(flat[a:b]) for a, b in zip(at, at[1:])], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], crc], [*keep, "ids_crc32"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.select(*keep, "ids").mapInArrow(run, schema + ", ids_crc32 bigint")


def token_digest(docs: DataFrame, tokenizer: str, id_col: str = "doc_id") -> DataFrame:
    """Write, read back, and digest each document's ids."""
    spark = docs.sparkSession
    path = scratch(spark, "tokens")
    write_tokens(docs, path, tokenizer, id_col=id_col)
    return ids_crc32(read_tokens(spark, path, id_col), id_col)
