"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded; gated attention, learned from document labels alone, weighs
the passages; the weighted representation is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, frugal, slices, text_of, view, word_hashes

#: Bytes of a passage.
PASSAGE = 1024
#: Labelled documents that the model is fitted on at most, chosen by hash of their id.
SAMPLE = 6000
#: Passages of such a document that the fit sees at most, evenly spread over it; scores are of all passages.
FIT_PASSAGES = 32
HIDDEN, GATE = 32, 16
EPOCHS, BATCH, RATE, DECAY = 40, 256, 3e-3, 1e-4

#: Byte classes: lower, upper, digit, blank, line end, sentence marks, other marks, beyond ASCII.
_CLASS = np.full(256, 6, np.int64)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 7
_CLASS[[32, 9]] = 3
_CLASS[[10, 13]] = 4
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 5
#: Bytes of ASCII for themselves, lead and continuation bytes of others as one each.
_BYTE = np.r_[np.arange(128), np.full(64, 128), np.full(64, 129)]
_LINES = np.zeros(256, bool)
_LINES[[10, 13]] = True
EXTRA = 6
FEATURES = 130 + 64 + EXTRA


def passages(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features (passages, FEATURES), passages of each row) of whole texts; an empty text is one passage of zeros."""
    size = np.diff(off)
    count = np.maximum(1, -(-size // PASSAGE))
    first = np.r_[0, np.cumsum(count)]
    n = int(first[-1])
    row = np.repeat(np.arange(len(size)), size)
    which = first[row] + (np.arange(len(raw)) - off[row]) // PASSAGE
    out = np.zeros((n, FEATURES), np.float32)
    length = np.maximum(1, np.bincount(which, minlength=n))[:, None]
    out[:, :130] = np.sqrt(np.bincount(which * 130 + _BYTE[raw], minlength=n * 130).reshape(n, 130) / length)
    kind = _CLASS[raw]
    if len(raw) > 1:
        inside = which[1:] == which[:-1]
        pair = (which[1:] * 64 + kind[:-1] * 8 + kind[1:])[inside]
        out[:, 130:194] = np.sqrt(np.bincount(pair, minlength=n * 64).reshape(n, 64) / length)
    # whole-document shares that every passage carries: distinct words, distinct pairs of words, distinct lines, sizes
    doc = np.zeros((len(size), EXTRA), np.float32)
    h, r = word_hashes(raw, off)
    words = np.bincount(r, minlength=len(size))
    with np.errstate(over="ignore"):
        two = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:] if len(h) else h
        two, r2 = two[r[:-1] == r[1:]], r[:-1][r[:-1] == r[1:]]
    lines, rl = word_hashes(raw, off, _LINES)
    for k, (x, rx) in enumerate(((h, r), (two, r2), (lines, rl))):
        order = np.lexsort((x, rx))
        x, rx = x[order], rx[order]
        new = np.r_[True, (x[1:] != x[:-1]) | (rx[1:] != rx[:-1])] if len(x) else np.zeros(0, bool)
        total = np.bincount(rx, minlength=len(size))
        doc[:, k] = np.bincount(rx[new], minlength=len(size)) / np.maximum(total, 1)
    doc[:, 3] = np.log1p(words)
    doc[:, 4] = size / np.maximum(words, 1) / 10
    doc[:, 5] = np.log1p(np.bincount(rl, minlength=len(size)))
    out[:, 194:] = np.repeat(doc, count, axis=0)
    return out, count


@dataclass
class Model:
    """Standardisation, encoder (w, b), gated attention (v, u, a) and scorer (c, d); None: everything scores `prior`."""

    mean: np.ndarray
    scale: np.ndarray
    p: dict[str, np.ndarray] | None
    prior: float = 0.5

    def scores(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        if self.p is None:
            return np.full(len(count), self.prior)
        return _forward(self.p, (x - self.mean) / self.scale, count)["y"].astype(np.float64)


def _segments(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.r_[0, np.cumsum(count)[:-1]], np.repeat(np.arange(len(count)), count)


def _forward(p: dict[str, np.ndarray], x: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
    start, seg = _segments(count)
    h = np.tanh(np.clip(x, -8, 8) @ p["w"] + p["b"])
    t, g = np.tanh(h @ p["v"]), 1 / (1 + np.exp(-(h @ p["u"])))
    e = (t * g) @ p["a"]
    e = np.exp(e - np.maximum.reduceat(e, start)[seg])
    a = e / np.add.reduceat(e, start)[seg]
    z = np.add.reduceat(h * a[:, None], start, axis=0)
    y = 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"][0], -30, 30)))
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "y": y, "seg": seg, "start": start}


def _gradients(p: dict[str, np.ndarray], x: np.ndarray, count: np.ndarray, label: np.ndarray) -> dict[str, np.ndarray]:
    x = np.clip(x, -8, 8)
    f = _forward(p, x, count)
    seg, h, a, t, g = f["seg"], f["h"], f["a"], f["t"], f["g"]
    dy = (f["y"] - label) / len(label)
    dz = dy[:, None] * p["c"][None]
    da = (dz[seg] * h).sum(1)
    dh = dz[seg] * a[:, None]
    de = a * (da - np.add.reduceat(a * da, f["start"])[seg])
    dtg = de[:, None] * p["a"][None]
    dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
    dh += dt @ p["v"].T + dg @ p["u"].T
    dpre = dh * (1 - h * h)
    return {"w": x.T @ dpre, "b": dpre.sum(0), "v": h.T @ dt, "u": h.T @ dg, "a": de @ (t * g), "c": f["z"].T @ dy, "d": np.array([dy.sum()])}


def train(x: np.ndarray, count: np.ndarray, label: np.ndarray, seed: int = 5) -> Model:
    """Fit on documents given as stacked passages; one fixed order and seed, so equal inputs give equal models."""
    mean, scale = x.mean(0), x.std(0) + 1e-3
    if not len(count) or label.min() == label.max():
        return Model(mean, scale, None, 0.5 if not len(count) else float(label[0]))
    x = ((x - mean) / scale).astype(np.float32)
    rng = np.random.default_rng(seed)
    p = {"w": rng.normal(0, FEATURES**-0.5, (FEATURES, HIDDEN)), "b": np.zeros(HIDDEN), "v": rng.normal(0, 0.2, (HIDDEN, GATE)), "u": rng.normal(0, 0.2, (HIDDEN, GATE)), "a": rng.normal(0, 0.2, GATE), "c": rng.normal(0, 0.2, HIDDEN), "d": np.zeros(1)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m, s = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    first = np.r_[0, np.cumsum(count)]
    step = 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(count))
        rate = RATE * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
        for lo in range(0, len(order), BATCH):
            pick = order[lo : lo + BATCH]
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in pick])
            step += 1
            for k, d in _gradients(p, x[rows], count[pick], label[pick]).items():
                d = d + DECAY * p[k]
                m[k] = 0.9 * m[k] + 0.1 * d
                s[k] = 0.999 * s[k] + 0.001 * d * d
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(mean, scale, p)


def fold(id_col: str | Column) -> Column:
    """crc32 of the id as text, modulo 3; null for a null id."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % 3


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Learn from labelled documents outside fold 1, SAMPLE of them at most and FIT_PASSAGES passages of each, so that
    what the driver gets is bounded. Null labels and ids teach nothing; of repeated labels of an id the smallest counts,
    of rows that repeat an id one (the least by hash of its text). Other columns of either table play no part; empty
    tables teach nothing, and then all scores are 0.5."""
    arrow_batches(docs.sparkSession)
    known = labels.filter(F.col(label_col).isin(0, 1) & (fold(id_col) != 1)).groupBy(F.col(id_col).alias("__ml_id")).agg(F.min(label_col).cast("int").alias("__ml_label"))
    known = known.orderBy(F.xxhash64("__ml_id"), "__ml_id").limit(SAMPLE)
    rows = docs.join(F.broadcast(known), F.col(id_col) == F.col("__ml_id")).select(F.col("__ml_id").cast("string"), "__ml_label", F.xxhash64(text_of(text_col)).alias("_h"), text_of(text_col).alias("_t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = view(batch.column(3))
            for lo, hi in slices(raw, off):
                x, n = passages(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                at = np.r_[0, np.cumsum(n)].tolist()
                some = [x[a + np.unique(np.linspace(0, b - a - 1, min(b - a, FIT_PASSAGES)).astype(np.int64))] for a, b in zip(at, at[1:])]
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:3]), pa.array([y.tobytes() for y in some], pa.binary())], ["i", "y", "h", "x"])

    once = rows.mapInArrow(frugal(run), "i string, y int, h bigint, x binary").groupBy("i", "y").agg(F.min(F.struct("h", "x")).alias("m"))
    got = once.select("i", "y", "m.x").toArrow().to_pylist()
    got.sort(key=lambda r: r["i"])
    bags = [np.frombuffer(r["x"], np.float32).reshape(-1, FEATURES) for r in got]
    x = np.concatenate(bags) if bags else np.zeros((1, FEATURES), np.float32)
    return train(x, np.array([len(b) for b in bags], np.int64), np.array([r["y"] for r in got], np.float32))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), out: str = "score") -> DataFrame:
    """id, score (named `out`) and the carried columns of every row, by every passage of its whole text; no shuffle.

    The score is the model's probability of label 1 and depends on the text alone. Null text is empty, and an empty
    text is scored as one empty passage; repeated rows are scored each; ids may be null.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    own = [id_col, *carry]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own) + f", {out} double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = view(batch.column(batch.num_columns - 1))
            for lo, hi in slices(raw, off):
                y = shared.value.scores(*passages(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]))
                yield pa.RecordBatch.from_arrays([*(c.slice(lo, hi - lo) for c in batch.columns[:-1]), pa.array(y)], [*own, out])

    return docs.select(*own, text_of(text_col).alias("__ml_text")).mapInArrow(frugal(run), schema)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    scored = score(docs, fit(docs, labels))
    return scored.select("doc_id", F.coalesce(fold("doc_id") == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score at least 0.5, all columns as they are."""
    scored = score(docs, fit(docs, labels), carry=tuple(c for c in docs.columns if c != "doc_id"), out="__ml_score")
    return scored.filter("__ml_score >= 0.5").select(*docs.columns)
