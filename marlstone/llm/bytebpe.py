"""Byte-level BPE: encoding and decoding over Arrow batches, with offsets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, slices, text_of, view
from .tokens import byte_bpe


def encode_texts(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", outputs: tuple[str, ...] = ("ids",)) -> DataFrame:
    """Encode whole texts by a rank file's content; one row per input row, in the same partitions (no shuffle).

    outputs: any of `ids` (array<bigint>), `offsets` (array of code point pairs, flattened), `decoded` (the bytes the
    ids decode to), `n_tokens`, `ids_sha256`, `decoded_sha256`. Every match of `pattern` is encoded separately and
    special tokens are ordinary text. Null text is empty (no ids); repeated rows are encoded each; a null id stays
    null; other columns are not carried.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(bytes(ranks))
    kinds = {"ids": ("array<bigint>", pa.list_(pa.int64())), "offsets": ("array<bigint>", pa.list_(pa.int64())), "decoded": ("binary", pa.binary()), "n_tokens": ("bigint", pa.int64()), "ids_sha256": ("string", pa.string()), "decoded_sha256": ("string", pa.string())}
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{x} {kinds[x][0]}" for x in outputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        coder = byte_bpe(shared.value, pattern)
        make = {
            "ids": lambda text, ids: np.frombuffer(ids, "<u4").tolist(),
            "offsets": lambda text, ids: coder.offsets(text, ids).ravel().tolist(),
            "decoded": lambda text, ids: coder.decode(ids),
            "n_tokens": lambda text, ids: len(ids) // 4,
            "ids_sha256": lambda text, ids: hashlib.sha256(ids).hexdigest(),
            "decoded_sha256": lambda text, ids: hashlib.sha256(coder.decode(ids)).hexdigest(),
        }
        for batch in batches:
            raw, off = view(batch.column(1))
            for lo, hi in slices(raw, off):
                cols = [[] for _ in outputs]
                for i in range(lo, hi):
                    text = raw[off[i] : off[i + 1]].tobytes()
                    ids = coder.encode(text)
                    for col, name in zip(cols, outputs):
                        col.append(make[name](text, ids))
                coder.trim()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *(pa.array(c, kinds[x][1]) for c, x in zip(cols, outputs))], [id_col, *outputs])

    return docs.select(F.col(id_col), text_of(text_col).alias("_text")).mapInArrow(run, schema)


def decode_ids(rows: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded binary) of id arrays. Bytes are joined before anything reads them as characters, so a character
    that is split over several ids comes out whole. A null array decodes to nothing; an id without a rank is an error."""
    spark = rows.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(bytes(ranks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        coder = byte_bpe(shared.value, pattern)
        for batch in batches:
            out = [coder.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], [id_col, "decoded"])

    return rows.select(id_col, F.col(ids_col).cast("array<bigint>")).mapInArrow(run, f"`{id_col}` {rows.schema[id_col].dataType.simpleString()}, decoded binary")
