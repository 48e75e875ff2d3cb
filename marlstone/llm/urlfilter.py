"""URL filtering: longest rule first, then a character language-model ratio."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, materialize, text_of, view
from .linededup import host_of

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Context characters of the longest model; every shorter one is mixed in.
ORDER = 3
MARKS = "-./?=&_%:#"
#: Symbols: 0 before the URL, 1 to 26 letters of either case, 27 any digit, MARKS, and one for all else.
SYMBOLS = 28 + len(MARKS) + 1
BINS = 4001
SPAN = 20.0


def path_of(url: str | Column) -> Column:
    u = text_of(url)
    return F.regexp_extract(u, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict): the longest rule whose host is the URL's or a parent of it and whose path starts the URL's."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(what)).otherwise(verdict)
    return name, verdict


def _codes() -> np.ndarray:
    out = np.full(256, SYMBOLS - 1, np.int64)
    for i in range(26):
        out[ord("a") + i] = out[ord("A") + i] = i + 1
    out[ord("0") : ord("9") + 1] = 27
    for i, c in enumerate(MARKS):
        out[ord(c)] = 28 + i
    return out


_CODE = _codes()


def grams(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the symbol with its ORDER predecessors, row) of every byte of the rows."""
    code = _CODE[raw]
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    place = np.arange(len(raw)) - off[row]
    index = code.copy()
    for k in range(1, ORDER + 1):
        before = np.zeros_like(code)
        before[k:] = code[:-k]
        index += np.where(place >= k, before, 0) * SYMBOLS**k
    return index, row


def _log_probabilities(counts: np.ndarray) -> np.ndarray:
    """Of each symbol after each context of ORDER symbols: orders are mixed by how many different symbols follow (Witten-Bell)."""
    full = counts.reshape((SYMBOLS,) * (ORDER + 1)).astype(np.float64)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(ORDER + 1):
        c = full.sum(axis=tuple(range(ORDER - order)))
        n, kinds = c.sum(-1, keepdims=True), (c > 0).sum(-1, keepdims=True)
        p = np.where(n > 0, (c + kinds * p) / np.maximum(n + kinds, 1), p)  # p of the shorter context repeats over the new first symbol
    return np.log(p).astype(np.float32).reshape(-1)


@dataclass
class UrlModel:
    """Log-likelihood ratio (accepted over rejected) of each symbol in its context, and the calibrated threshold."""

    ratio: np.ndarray
    threshold: float

    def scores(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Mean ratio per byte; 0 for an empty URL."""
        index, row = grams(raw, off)
        n = np.diff(off)
        return np.bincount(row, self.ratio[index], minlength=len(n)) / np.maximum(n, 1)


def _train(urls: DataFrame, folds: str) -> np.ndarray:
    """Counts (2, SYMBOLS ** (ORDER + 1)) over all rows (url, accepted) of the folds. A task sums its rows in one fixed
    table and sends what is not zero; the sums have a row for each occurring gram, at most twice the table's size."""
    size = SYMBOLS ** (ORDER + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(2 * size, np.int64)
        for batch in batches:
            raw, off = view(batch.column(0))
            kind = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            index, row = grams(raw, off)
            found, n = np.unique(index + kind[row] * size, return_counts=True)
            table[found] += n
        at = np.flatnonzero(table)
        for lo in range(0, len(at), 100_000):
            part = at[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(table[part])], ["i", "n"])

    sums = urls.filter(folds).select("url", F.col("accepted").cast("int").alias("a")).mapInArrow(run, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * size, np.int64)
    out[sums["i"].to_numpy()] = sums["n"].to_numpy()
    return out.reshape(2, size)


def fit(urls: DataFrame) -> UrlModel:
    """From rows (url string, accepted boolean). Counts of nine tenths of the URLs (by hash) make the models; the
    threshold is the score that best splits the other tenth (mean of both classes' hit rates), from a histogram of
    fixed size. Without examples of a class everything is accepted."""
    rows = materialize(urls.select("url", "accepted", (F.pmod(F.xxhash64("url"), F.lit(10)) == 0).alias("_held")), "urls")
    spark = urls.sparkSession
    counts = _train(rows, "not _held")
    if not counts.sum(1).all():
        return UrlModel(np.zeros(counts.shape[1], np.float32), -np.inf)
    model = UrlModel(_log_probabilities(counts[1]) - _log_probabilities(counts[0]), 0.0)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(2 * BINS, np.int64)
        for batch in batches:
            s = shared.value.scores(*view(batch.column(0)))
            b = np.clip(np.rint((s + SPAN) / (2 * SPAN) * (BINS - 1)), 0, BINS - 1).astype(np.int64)
            np.add.at(table, b + BINS * batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64), 1)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], ["i", "n"])

    sums = rows.filter("_held").select("url", F.col("accepted").cast("int")).mapInArrow(run, "i bigint, n bigint").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    hist = np.zeros(2 * BINS)
    hist[sums["i"].to_numpy()] = sums["n"].to_numpy()
    rejected, accepted = hist.reshape(2, BINS)
    if rejected.sum() and accepted.sum():
        below = np.r_[0, np.cumsum(rejected)] / rejected.sum() + 1 - np.r_[0, np.cumsum(accepted)] / accepted.sum()
        best = np.flatnonzero(below >= below.max() - 1e-12)
        model.threshold = float((best[len(best) // 2] - 0.5) / (BINS - 1) * 2 * SPAN - SPAN)
    return model


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule, verdict and score of every row.

    The URLs that a rule allows are the accepted examples, those that one blocks the rejected ones; the model judges
    the rest: allow at or above the threshold. Counts cover all URLs. A null or empty URL has empty parts and, lacking
    evidence, is allowed; repeated rows count and are judged each. Nothing but URLs is read; no row is shuffled, and
    what is broadcast is one table of SYMBOLS ** (ORDER + 1) floats.
    """
    spark = pages.sparkSession
    arrow_batches(spark, rows=20_000)
    host, path = host_of(url_col), path_of(url_col)
    named = pages.select(F.col(id_col).alias("_id"), text_of(url_col).alias("_url"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    named = named.withColumns({"rule": rule, "_said": verdict})
    model = fit(named.filter("rule is not null").select(F.col("_url").alias("url"), (F.col("_said") == "allow").alias("accepted")))
    shared = spark.sparkContext.broadcast(model)
    kind = pages.schema[id_col].dataType.simpleString()
    names = [id_col, "host", "path", "rule", "verdict", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.scores(*view(batch.column(1)))
            own = np.where(score >= shared.value.threshold, "allow", "block")
            own[np.diff(view(batch.column(1))[1]) == 0] = "allow"
            said = batch.column(5)
            verdict = pa.compute.coalesce(said, pa.array(own.astype(object), pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:5], verdict, pa.array(score)], names)

    import pyarrow.compute  # noqa: F401

    return named.select("_id", "_url", "host", "path", "rule", "_said").mapInArrow(run, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, score double")
