"""Best-fit packing: bounded-space online best-fit over fixed-length sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, frugal, slices, text_of, view
from .tokens import word_bpe

CAPACITY = 2048
OPEN_BINS = 1024


class BestFit:
    """At most `bins` open bins. Bit f of `free` is set while an open bin has f places left.

    A piece goes to the open bin with the least sufficient space: the lowest set bit at or above its length. When a
    new bin is needed and all are open, the fullest one (the lowest set bit) closes.
    """

    def __init__(self, capacity: int, bins: int, first_id: int = 0):
        self.capacity, self.bins, self.next, self.open = capacity, bins, first_id, 0
        self.free, self.at = 0, [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset in it) for a piece of 1 to `capacity` places."""
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            which = self._take(space)
        else:
            if self.open == self.bins:
                self._take((self.free & -self.free).bit_length() - 1)
            which, space = self.next, self.capacity
            self.next += 1
        left = space - length
        if left:
            self.at[left].append(which)
            self.free |= 1 << left
            self.open += 1
        return which, self.capacity - space

    def _take(self, space: int) -> int:
        """Remove an open bin with this much space; the caller may put it back."""
        stack = self.at[space]
        which = stack.pop()
        if not stack:
            self.free &= ~(1 << space)
        self.open -= 1
        return which


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Pack every document's ids (then end_id) into sequences of at most `capacity` ids.

    `tokenizer` is the content of a tokenizers file. Documents longer than a sequence are cut into full pieces and a
    rest; nothing else is cut. One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset and, if
    asked for, its ids (little-endian unsigned 32-bit).

    Each task packs its own partition in one pass with `open_bins` open bins, so there is no shuffle, memory does not
    grow with the input and a task that runs again makes the same rows. A partition leaves at most `open_bins` bins
    that could have taken more. Null text is empty: a document of end_id alone. Repeated rows are packed once each;
    a null id stays null; other columns are not carried; an empty table gives no rows.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(tokenizer)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, `offset` bigint" + ", ids binary" * with_ids
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, ctx = word_bpe(shared.value), TaskContext.get()
        bins = BestFit(capacity, open_bins, (ctx.partitionId() if ctx else 0) << 40)
        step = capacity * 4
        for batch in batches:
            raw, off = view(batch.column(1))
            for lo, hi in slices(raw, off):
                rows, take = [], []
                for i in range(lo, hi):
                    ids = coder.encode(raw[off[i] : off[i + 1]].tobytes()) + end
                    for piece, at in enumerate(range(0, len(ids), step)):
                        part = ids[at : at + step]
                        rows.append((piece, at // 4, len(part) // 4, zlib.crc32(part), *bins.place(len(part) // 4), part))
                        take.append(i)
                coder.trim()
                cols = list(zip(*rows))
                kinds = (pa.int32(), *[pa.int64()] * 5)
                out = [batch.column(0).take(pa.array(take, pa.int64())), *(pa.array(c, k) for c, k in zip(cols, kinds))]
                names = [id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
                if with_ids:
                    out.append(pa.array(cols[6], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return docs.select(F.col(id_col), text_of(text_col).alias("_text")).mapInArrow(frugal(run, keeps=True), schema)
