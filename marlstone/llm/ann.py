"""Approximate nearest neighbours: anisotropic product quantisation, four-bit table scans, exact reranking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_batches, materialize

#: Vectors that the codebooks are fitted on.
SAMPLE = 8192
#: Dimensions of a subspace; each has 16 codewords, so its code is four bits.
SUBSPACE = 2
WORDS = 16
#: The scores above which the score error matters (cosine).
THRESHOLD = 0.2
#: Rows of an index block, queries of a query block, and rows of a block that each query reranks exactly.
BLOCK = 8192
QUERIES = 2048
RERANK = 96


@dataclass
class Codebook:
    """Codewords (subspaces, 16, SUBSPACE) for unit vectors, and the weight of parallel against orthogonal error."""

    words: np.ndarray
    eta: float

    def encode(self, unit: np.ndarray) -> np.ndarray:
        """Codes (rows, subspaces) that keep eta * |parallel residual|^2 + |orthogonal residual|^2 small.

        Starts from the nearest codewords and then, subspace by subspace, takes the word that is best given the others.
        The parallel part couples the subspaces: it is the residual's inner product with the vector itself.
        """
        n, m = len(unit), len(self.words)
        parts = unit.reshape(n, m, -1)
        square = ((parts[:, :, None, :] - self.words[None]) ** 2).sum(-1)  # (n, m, 16)
        along = np.einsum("nmd,mkd->nmk", parts, self.words)
        own = (parts**2).sum(-1)
        codes = square.argmin(-1)
        take = np.arange(n)
        inner = own - np.take_along_axis(along, codes[..., None], 2)[..., 0]  # residual along the vector, by subspace
        for _ in range(2):
            for j in range(m):
                rest = inner.sum(1) - inner[:, j]
                along_j = own[:, j, None] - along[:, j]
                cost = square[:, j] + (self.eta - 1) * (rest[:, None] + along_j) ** 2
                codes[:, j] = cost.argmin(-1)
                inner[:, j] = along_j[take, codes[:, j]]
        return codes.astype(np.uint8)


def fit_codebook(sample: np.ndarray, threshold: float = THRESHOLD, rounds: int = 8, seed: int = 7) -> Codebook:
    """Codewords for unit vectors by alternating encoding and weighted least squares.

    eta = (d - 1) T^2 / (1 - T^2) is the weight of the parallel residual for unit vectors and score threshold T. Each
    word update solves, for one subspace, the quadratic that its members' parallel and orthogonal errors make.
    """
    n, d = sample.shape
    m = d // SUBSPACE
    eta = max(1.0, (d - 1) * threshold**2 / (1 - threshold**2))
    rng = np.random.default_rng(seed)
    parts = sample.reshape(n, m, SUBSPACE)
    words = np.stack([parts[rng.choice(n, WORDS, replace=n < WORDS), j] for j in range(m)])
    for j in range(m):  # plain k-means to start from
        for _ in range(10):
            near = ((parts[:, j, None] - words[j][None]) ** 2).sum(-1).argmin(-1)
            for k in range(WORDS):
                if (near == k).any():
                    words[j, k] = parts[near == k, j].mean(0)
    book = Codebook(words, eta)
    for _ in range(rounds):
        codes = book.encode(sample)
        for j in range(m):
            picked = book.words[np.arange(m)[None], codes]  # (n, m, SUBSPACE)
            rest = ((parts - picked) * parts).sum(-1)
            rest = rest.sum(1) - rest[:, j]
            x = parts[:, j]
            for k in range(WORDS):
                mine = codes[:, j] == k
                if mine.any():
                    xs, r = x[mine], rest[mine]
                    # minimise sum |x - c|^2 + (eta - 1) (r + x.x - x.c)^2 over c
                    a = mine.sum() * np.eye(SUBSPACE) + (eta - 1) * xs.T @ xs
                    b = xs.sum(0) + (eta - 1) * ((r + (xs**2).sum(1))[:, None] * xs).sum(0)
                    book.words[j, k] = np.linalg.solve(a, b)
    return book


def scan(codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """Approximate scores (queries, rows): for each query the sum over subspaces of its table at the row's code.

    Tables (queries, subspaces, 16) are rounded to 8 bits on one scale a query; two four-bit codes are looked up at a
    time in a table of their 256 sums."""
    q, m, _ = tables.shape
    low = tables.min((1, 2), keepdims=True)
    step = np.maximum(tables.max((1, 2), keepdims=True) - low, 1e-12) / 255
    small = np.rint((tables - low) / step).astype(np.int32)
    total = np.zeros((q, len(codes)), np.int32)
    for j in range(0, m - m % 2, 2):
        pair = (small[:, j, :, None] + small[:, j + 1, None, :]).reshape(q, 256)
        total += pair[:, codes[:, j].astype(np.int64) * 16 + codes[:, j + 1]]
    if m % 2:
        total += small[:, m - 1][:, codes[:, m - 1]]
    return total


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their lengths), each row over a power of two, which rounds nothing, so that no square overflows or vanishes."""
    x = np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])
    return x, np.sqrt((x * x).sum(1))


def _unit(x: np.ndarray) -> np.ndarray:
    x, norm = _scaled(x)
    return x / norm[:, None]


def _valid(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def search(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int = RERANK, block: int = BLOCK) -> DataFrame:
    """query_id, rank, id and score: the k nearest found by cosine of every row for which `queries` holds, best first.

    Rows that are null, zero or hold null or non-finite components take no part. A cosine exists between vectors of one
    length only, so each length is searched by itself, with codebooks of its own. Rows with the query's own id are no
    candidates; equal scores rank by smaller id; of a repeated id each row is a candidate, and each distinct query id
    asks once (with its least vector). Other columns are not carried and may have any names; an empty table gives no
    rows.

    All rows are coded, in blocks that stay where they are written. Blocks of queries (a stated set) are sent to every
    block of rows; in each meeting the table scan picks `rerank` rows for each query, their cosines are computed in
    double precision from the original vectors, and k of them go on. The codebooks are fitted on SAMPLE rows, chosen by
    hash.
    """
    spark = vectors.sparkSession
    arrow_batches(spark, rows=2000, size="8m")
    wide = vectors.schema[vector_col].dataType.elementType.simpleString() != "float"
    v = F.col(vector_col).cast("array<double>" if wide else "array<float>")
    rows = vectors.filter(_valid(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), queries.alias("q"))
    asked = materialize(rows.filter("q").groupBy("id").agg(F.min("v").alias("v")), "asked")
    sizes = rows.groupBy(F.size("v").alias("d")).count().join(asked.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")), "d").orderBy("d").collect()
    out_schema = f"query_id bigint, rank int, {id_col} bigint, score double"
    if not sizes:
        return spark.createDataFrame([], out_schema)
    found = [_search_length(rows.filter(F.size("v") == x["d"]), asked.filter(F.size("v") == x["d"]), x["d"], x["count"], x["n"], wide, k, rerank, block) for x in sizes]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), F.col("id").alias(id_col), "score")


def _few_of_equal(i: np.ndarray, x: np.ndarray, k: int) -> np.ndarray:
    """Places, in order, of rows that suffice: of equal vectors k rows of an id and then 2 k rows; rows are sorted by id.
    Whichever id asks, k rows of others remain where there were that many."""
    same = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel(), return_inverse=True)[1]
    by = np.argsort(same, kind="stable")
    new = np.r_[True, (same[by][1:] != same[by][:-1]) | (i[by][1:] != i[by][:-1])]
    by = by[np.arange(len(by)) - np.flatnonzero(new)[np.cumsum(new) - 1] < k]
    return np.sort(by[np.arange(len(by)) - np.searchsorted(same[by], same[by]) < 2 * k])


def _search_length(rows: DataFrame, asked: DataFrame, d: int, total: int, n_asked: int, wide: bool, k: int, rerank: int, block: int) -> DataFrame:
    """(query_id, id, score) of the candidates that every meeting of blocks lets go on; all vectors have d components."""
    spark = rows.sparkSession
    pad = -d % SUBSPACE
    real = np.float64 if wide else np.float32
    picked = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    sample = picked.flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)
    sample = np.pad(_unit(sample), ((0, 0), (0, pad)))
    book = spark.sparkContext.broadcast(fit_codebook(sample))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a task in packed blocks of at most `block`: ids, vectors and codes, numbered within the job."""
        ids, vecs = [], []
        number = TaskContext.get().partitionId() << 32

        def flush():
            i, x = np.concatenate(ids), np.concatenate(vecs)
            order = np.argsort(i, kind="stable")
            i, x = i[order], x[order]
            by = _few_of_equal(i, x, k)
            i, x = i[by], x[by]
            codes = book.value.encode(np.pad(_unit(x.astype(np.float64)), ((0, 0), (0, pad))))
            two = codes if codes.shape[1] % 2 == 0 else np.pad(codes, ((0, 0), (0, 1)))
            nibbles = (two[:, ::2] << 4 | two[:, 1::2]).tobytes()
            ids.clear(), vecs.clear()
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([b], pa.binary()) for b in (i.tobytes(), x.tobytes(), nibbles))], ["b", "ids", "vecs", "codes"])

        held = 0
        for batch in batches:
            i = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(real)
            lo = 0
            while lo < len(i):
                hi = min(len(i), lo + block - held)
                ids.append(i[lo:hi])
                vecs.append(x[lo:hi])
                held, lo = held + hi - lo, hi
                if held == block:
                    yield flush()
                    number, held = number + 1, 0
        if held:
            yield flush()

    # the hash of the id deals rows evenly; a row that repeats an id often is dealt by its vector too
    n_parts = max(1, -(-total // block))
    packed = rows.select("id", "v").repartition(n_parts, F.xxhash64("id", "v")).mapInArrow(pack, "b bigint, ids binary, vecs binary, codes binary")
    packed = materialize(packed, "index")
    # a row for each block of queries and each block of rows; a block of rows is one key, met by all queries
    n_blocks = max(1, -(-n_asked // QUERIES))
    asked = asked.groupBy(F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("qb")).agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("qs"))
    blocks = [r.b for r in packed.select("b").collect()]  # a number for each `block` rows
    sent = asked.select("qs", F.explode(F.lit(blocks)).alias("b"))
    met = packed.hint("shuffle_merge").join(sent, "b")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = book.value.words
        m = len(words)
        for batch in batches:
            for r in range(batch.num_rows):
                i = np.frombuffer(batch.column(0)[r].as_py(), np.int64)
                x = np.frombuffer(batch.column(1)[r].as_py(), real).reshape(-1, d).astype(np.float64)
                two = np.frombuffer(batch.column(2)[r].as_py(), np.uint8).reshape(len(i), -1)
                codes = np.stack([two >> 4, two & 15], 2).reshape(len(i), -1)[:, :m]
                qs = batch.column(3)[r].values
                qid = qs.field("id").to_numpy(zero_copy_only=False)
                qv = qs.field("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, d).astype(np.float64)
                x, norm = _scaled(x)
                for lo in range(0, len(qid), 128):
                    q, some = qv[lo : lo + 128], qid[lo : lo + 128]
                    q, qn = _scaled(q)
                    unit = np.pad(q / qn[:, None], ((0, 0), (0, pad))).reshape(len(q), m, -1)
                    near = scan(codes, np.einsum("qmd,mkd->qmk", unit, words))
                    near[some[:, None] == i[None]] = -1
                    keep = min(rerank, len(i))
                    # best `keep` by (score, smaller id): rows are in id order, so position breaks ties
                    rank = near.astype(np.int64) * len(i) - np.arange(len(i))
                    best = np.argpartition(-rank, keep - 1, axis=1)[:, :keep]
                    exact = (x[best] * q[:, None]).sum(-1) / (norm[best] * qn[:, None])
                    exact[near[np.arange(len(q))[:, None], best] < 0] = -np.inf
                    order = np.lexsort((best, -exact), axis=1)[:, :k]
                    score = np.take_along_axis(exact, order, 1).ravel()
                    ok = np.isfinite(score)
                    found = i[np.take_along_axis(best, order, 1)].ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(some.repeat(order.shape[1])[ok]), pa.array(found[ok]), pa.array(score[ok])], ["query_id", "id", "score"])

    return met.select("ids", "vecs", "codes", "qs").mapInArrow(meet, "query_id bigint, id bigint, score double")
