"""Shared helpers: tables cut from their lineage, batch sizes, sized joins, Arrow text views."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of a table that may be sent to every executor at once; beyond it the join is by shuffle.
BROADCAST_BYTES = 64 << 20
#: What a byte of a written (encoded, compressed) table takes in memory at most, nearly always.
UNPACKED = 4

#: What a Python worker keeps between tasks, by name: tokenizers with their caches.
KEPT: dict[str, object] = {}

_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a temporary one only where a local master has none."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = getattr(shared_dir, "own", None) or tempfile.mkdtemp(prefix="marlstone-")
        shared_dir.own = path
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def scratch(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark).rstrip('/')}/marlstone/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"
    for scope in getattr(_scopes, "open", [])[-1:]:
        scope.append(path)
    return path


@contextmanager
def scope(spark: SparkSession):
    """Tables written inside go at its end, but for those whose frames were passed to the function it gives; these
    belong to the scope around it, if any. Nothing lazy that reads a table that goes may leave the scope."""
    stack = _scopes.open = getattr(_scopes, "open", [])
    mine: list[str] = []
    kept: set[str] = set()
    stack.append(mine)
    try:
        yield lambda *frames: kept.update(f._ml_path for f in frames)
    finally:
        stack.pop()
        for path in mine:
            if path in kept:
                for outer in stack[-1:]:
                    outer.append(path)
            else:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._ml_path = path
    return out


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application; they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_marlstone", None) != sc.applicationId:
        top = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="marlstone-")) / "marlstone.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        sc.addPyFile(str(path))
        sc._marlstone = sc.applicationId


def arrow_batches(spark: SparkSession, rows: int = 2000, size: str = "4m") -> None:
    """Prepare for Arrow functions: the workers have this package; bound what one batch holds, by rows and by bytes."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def give_back(kept: bool = False) -> None:
    """Return this process's free memory to the system, which libraries else hold on to; with kept=True also KEPT."""
    if kept and KEPT:
        KEPT.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def frugal(run: Callable, keeps: bool = False) -> Callable:
    """`run` for mapInArrow. Python workers outlive stages and stand beside the executor's heap: what other operators kept
    in one goes as a task begins (not with keeps=True), and what a task has freed is returned as it ends."""

    def inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not keeps:
            give_back(kept=True)
        yield from run(batches)
        give_back()

    return inner


def text_of(col: str | Column) -> Column:
    """Null counts as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def sized(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Mark a side made of written tables for broadcast if their bytes, unpacked, are within the limit (by default
    BROADCAST_BYTES); else leave the join to a shuffle. Only file sizes are looked at; no job runs."""
    size = int(df._jdf.queryExecution().analyzed().stats().sizeInBytes())
    return F.broadcast(df) if size * UNPACKED <= (BROADCAST_BYTES if limit is None else limit) else df


def keep_decided(docs: DataFrame, decisions: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that decisions(id, row_key, kept) keep; row_key is xxhash64 of the text.

    Rows are met by id and text, so rows that share only one of them are safe. Of rows that repeat both, one stays if
    any is kept. No text is shuffled while the dropped ids are within the broadcast bound.
    """
    state = decisions.groupBy(F.col(id_col).alias("__ml_id"), F.col("row_key").alias("__ml_key")).agg(F.count_if("kept").alias("__ml_kept"), F.count_if(~F.col("kept")).alias("__ml_gone"))
    state = materialize(state.filter("__ml_gone > 0"), "dropped")
    same = F.col(id_col).eqNullSafe(F.col("__ml_id")) & (F.col("__ml_hash") == F.col("__ml_key"))
    keyed = docs.withColumn("__ml_hash", F.xxhash64(text_of(text_col)))
    out = keyed.join(sized(state.select("__ml_id", "__ml_key")), same, "left_anti")
    repeated = state.filter("__ml_kept > 0").select("__ml_id", "__ml_key")
    if not repeated.isEmpty():
        out = out.unionByName(keyed.join(sized(repeated), same, "left_semi").dropDuplicates([id_col, "__ml_hash"]))
    return out.drop("__ml_hash")


def view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without copying; offsets has one entry more than rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offs, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(raw: np.ndarray, off: np.ndarray, size: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes; a longer text is a range of its own."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + size, "right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_P = 0x9E3779B97F4A7C15 | 1
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_POW: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POW or len(_POW[0]) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            _POW[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, p, np.uint64)], dtype=np.uint64) for p in (_P, pow(_P, -1, 1 << 64))]
    return _POW[0], _POW[1]


def word_hashes(raw: np.ndarray, off: np.ndarray, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, row) of every word of the rows, in order; gaps has True for the bytes between words."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    word = ~gaps[raw]
    first = np.zeros(n, bool)
    starts_at = off[:-1][off[:-1] < off[1:]]
    first[starts_at] = True
    begin = np.flatnonzero(word & (first | np.r_[True, ~word[:-1]]))
    last = np.zeros(n, bool)
    last[starts_at[1:] - 1] = True
    last[-1] = True
    end = np.flatnonzero(word & (last | np.r_[~word[1:], True])) + 1
    up, down = _powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.r_[np.uint64(0), np.cumsum(_TABLE[raw] * up[:n], dtype=np.uint64)]
        h = mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
    return h, np.searchsorted(off, begin, "right") - 1
