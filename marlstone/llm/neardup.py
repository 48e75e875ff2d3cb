"""Near duplicates: BagMinHash signatures of word shingle multisets, banding, verified multiset overlap, classes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, frugal, give_back, keep_decided, materialize, mix, scope, sized, slices, text_of, view, word_hashes
from .components import components

WORDS = 5
SIMILARITY = (4, 5)  # 0.8, as a ratio of integers
BANDS, ROWS = 24, 5
SIZE = BANDS * ROWS
#: Bands of at most SMALL nodes are met pair by pair; larger ones in blocks of about BLOCK shingles.
SMALL, BLOCK = 8, 1 << 19
#: Shingles of a group of blocks above which its memory is returned at once.
LARGE = 1 << 16
#: Groups of equal bags with more rows than this are dealt over SALTS tasks when rows look up their class.
HOT_GROUP, SALTS = 10_000, 64
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def shingle_bags(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, 64-bit shingle, count), sorted by row and shingle. A text of fewer words has one shingle of them all; an
    empty one has one of its own, so that empty texts are copies of each other."""
    with np.errstate(over="ignore"):
        h, row = word_hashes(raw, off)
        n = np.bincount(row, minlength=len(off) - 1)
        first = np.r_[0, np.cumsum(n)[:-1]]
        full = np.flatnonzero(np.r_[row[WORDS - 1 :], np.full(min(WORDS - 1, len(row)), -1)][: len(row)] == row) if len(row) else np.zeros(0, np.int64)
        s = np.zeros(len(full), np.uint64)
        for k in range(WORDS):
            s += h[full + k] * _ODD[k]
        short = np.flatnonzero(n < WORDS)
        t = np.full(len(short), 11, np.uint64)
        for k in range(WORDS - 1):
            has = n[short] > k
            t[has] += h[first[short[has]] + k] * _ODD[k]
        s, r = mix(np.r_[s, t + n[short].astype(np.uint64)]), np.r_[row[full], short]
    order = np.lexsort((s, r))
    s, r = s[order], r[order]
    new = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (r[1:] != r[:-1])])
    return r[new], s[new], np.diff(np.r_[new, len(s)])


def bag_min_hash(row: np.ndarray, shingle: np.ndarray, weight: np.ndarray, rows: int, size: int = SIZE) -> np.ndarray:
    """(rows, size) signatures; two bags agree in a component with the probability of their weighted Jaccard similarity.

    The weight axis is cut at 1, 2, 4, 8, ... Over each cut that a weight reaches, a shingle has a Poisson process of
    rate `size` per unit of weight, the same wherever the shingle occurs. A point falls on a random component and, by
    successive halving of its cut, on a random place of the weight axis; it counts where the place is below the weight.
    A component keeps its earliest point. A process stops once its time has passed the latest component of its row.
    """
    parts = [(np.arange(len(row)), np.zeros(len(row), np.int64))]
    level = 1
    while True:
        more = np.flatnonzero(weight > 2 ** (level - 1))
        if not len(more):
            break
        parts.append((more, np.full(len(more), level)))
        level += 1
    at, cut = (np.concatenate(x) for x in zip(*parts))
    r, w = row[at], weight[at]
    low = np.where(cut > 0, 2.0 ** (cut - 1), 0.0)
    width = np.where(cut > 0, low, 1.0)
    time = np.zeros(len(at))
    best, name = np.full(rows * size, np.inf), np.zeros(rows * size, np.uint64)
    with np.errstate(over="ignore"):
        seed = mix(shingle[at] + _ODD[1] * cut.astype(np.uint64))
        step = 0
        while len(at):
            step += 1
            x = mix(seed + _ODD[0] * np.uint64(step))
            time = time - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / (size * width)
            y = mix(x + _ODD[2])
            comp = ((y >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
            place = low + width * (mix(x + _ODD[3]) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            hit = place < w
            slot, t, who = (r * size + comp)[hit], time[hit], x[hit]
            np.minimum.at(best, slot, t)
            won = best[slot] == t
            name[slot[won]] = who[won]
            going = time < best.reshape(rows, size).max(1)[r]
            at, r, w, low, width, time, seed = (z[going] for z in (at, r, w, low, width, time, seed))
    return name.reshape(rows, size)


def band_keys(signature: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        s = (signature.reshape(len(signature), BANDS, ROWS) * _ODD[None, None]).sum(2, dtype=np.uint64)
        return mix(s + np.arange(BANDS, dtype=np.uint64) * _ODD[1]).view(np.int64)


def bag_digest(row: np.ndarray, shingle: np.ndarray, count: np.ndarray, rows: int) -> np.ndarray:
    """(rows, 2) 64-bit sums over a row's bag: equal bags, equal digests."""
    out = np.zeros((rows, 2), np.uint64)
    with np.errstate(over="ignore"):
        x = mix(shingle + _ODD[2] * count.astype(np.uint64))
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        for k in (0, 1):
            out[row[starts], k] = np.add.reduceat(mix(x + _ODD[k + 3]), starts)
    return out.view(np.int64)


def _sketches(rows: DataFrame) -> DataFrame:
    """rows(id, key, text) -> id, key, d1, d2, n, bands."""
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = view(batch.column(2))
            for lo, hi in slices(raw, off):
                n = hi - lo
                r, s, c = shingle_bags(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                d = bag_digest(r, s, c, n)
                keys = band_keys(bag_min_hash(r, s, c, n))
                bands = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
                total = np.bincount(r, c, minlength=n).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), batch.column(1).slice(lo, n), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(total), bands], ["_id", "_key", "d1", "d2", "n", "bands"])

    return rows.mapInArrow(frugal(run), f"_id {kind}, _key bigint, d1 bigint, d2 bigint, n bigint, bands array<bigint>")


def _bags(rows: DataFrame) -> DataFrame:
    """rows(text) -> d1, d2, s, c: the bags as packed arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = view(batch.column(0))
            for lo, hi in slices(raw, off):
                r, s, c = shingle_bags(raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                d = bag_digest(r, s, c, hi - lo)
                at = np.searchsorted(r, np.arange(hi - lo + 1)).tolist()
                c = c.astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array([s[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary()), pa.array([c[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())], ["d1", "d2", "s", "c"])

    return rows.mapInArrow(frugal(run), "d1 bigint, d2 bigint, s binary, c binary")


def _verified(pairs: DataFrame, bags: DataFrame) -> DataFrame:
    """Those of pairs(a, b) whose multiset Jaccard similarity reaches SIMILARITY, compared as integers."""
    up, down = SIMILARITY

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for sa, ca, sb, cb in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5))):
                x, y = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
                p, q = np.frombuffer(ca, np.int32), np.frombuffer(cb, np.int32)
                at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                both = int(np.minimum(p[at], q)[x[at] == y].sum())
                good.append(down * both >= up * (int(p.sum()) + int(q.sum()) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    left = bags.select(F.col("node").alias("a"), F.col("s").alias("sa"), F.col("c").alias("ca"))
    right = bags.select(F.col("node").alias("b"), F.col("s").alias("sb"), F.col("c").alias("cb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "ca", "sb", "cb").mapInArrow(frugal(run), "a bigint, b bigint").distinct()


def _blocks(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(band, block, node, n, comp) of members(band, node, n, comp), and (band, i, j, at): the pairs of blocks i <= j that
    hold several components and sizes that allow the similarity, once for each block `at` of them.

    A band is cut by classes of size, each a factor of the similarity wide, and a class by hash into blocks of about
    BLOCK shingles. Sizes are summed by task before the shuffle, so a hot band is no task of its own.
    """
    up, down = SIMILARITY
    members = members.withColumn("g", F.floor(F.log(F.greatest("n", F.lit(1)).cast("double")) / F.lit(float(np.log(down / up)))).cast("int"))
    cut = materialize(members.groupBy("band", "g").agg(F.ceil(F.sum(F.col("n") + 64) / BLOCK).alias("cuts")), "cuts")
    block = F.shiftleft(F.col("g").cast("long"), 40) + F.pmod(F.xxhash64("node"), F.col("cuts"))
    members = materialize(members.join(sized(cut), ["band", "g"]).select("band", block.alias("block"), "node", "n", "comp"), "blocks")
    of = members.groupBy("band", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("comp").alias("first"), F.max("comp").alias("last"))
    of = materialize(of, "ranges")
    x, y = (of.toDF("band", *(f"{side}_{c}" for c in of.columns[1:])) for side in "xy")
    # sizes that differ by no more than the similarity allows lie in the same class or in neighbouring ones
    x = x.withColumn("g", F.explode(F.array(F.shiftright("x_block", 40), F.shiftright("x_block", 40) + 1)))
    y = y.withColumn("g", F.shiftright("y_block", 40))
    several = F.least("x_first", "y_first") != F.greatest("x_last", "y_last")
    near = (F.col("x_block") <= F.col("y_block")) & (F.col("y_lo") * up <= F.col("x_hi") * down) & (F.col("x_lo") * up <= F.col("y_hi") * down)
    pairs = x.join(y, ["band", "g"]).filter(near & several)
    both = F.explode(F.array_distinct(F.array("x_block", "y_block"))).alias("at")
    return members, materialize(pairs.select("band", F.col("x_block").alias("i"), F.col("y_block").alias("j"), both), "meetings")


def _codes(x: np.ndarray) -> np.ndarray:
    """The rank of each value among the distinct ones; np.unique's inverse in less memory."""
    order = np.argsort(x)
    y = x[order]
    new = y[1:] != y[:-1]
    del y
    out = np.zeros(len(x), np.int64)
    out[order[1:]] = np.cumsum(new)
    return out


def _across(rows: DataFrame, tasks: int) -> DataFrame:
    """Links between the components of every (band, i, j) of rows(band, i, j, at, node, n, comp, s, c).

    Every pair of different components whose sizes allow the similarity is tested on the bags; within a block (i = j)
    all of them, else those of one block with the other. A link joins its components at once, so that pairs it made
    needless are passed over and no more links come out than components went in. A group's bags are put in order once
    and read where they lie; what a large group took is returned to the system.
    """
    up, down = SIMILARITY

    def run(table: pa.Table) -> pa.Table:
        n, at = (table.column(k).to_numpy() for k in ("n", "at"))
        order = np.argsort(n, kind="stable")
        n, at, node, label = n[order], at[order], table.column("node").to_numpy()[order], np.unique(table.column("comp").to_numpy(), return_inverse=True)[1][order]
        apart = at[0] != at[-1] or len(np.unique(at)) > 1
        (count, start), (code, _) = (view(table.column(k).cast(pa.large_binary()).take(pa.array(order))) for k in ("c", "s"))
        count, start, code = count.view(np.int32), start // 4, _codes(code.view(np.uint64))
        weight, left = np.zeros(int(code.max()) + 1, np.int32), len(np.unique(label))
        end = np.searchsorted(n * up, n * down, "right")
        a, b = [], []
        for p in range(len(n)):
            if left == 1:
                break
            other = label[p + 1 : end[p]] != label[p]
            if apart:
                other &= at[p + 1 : end[p]] != at[p]
            q = np.flatnonzero(other) + p + 1
            if not len(q):
                continue
            size = start[q + 1] - start[q]
            first = np.r_[0, np.cumsum(size)[:-1]]
            of = slice(start[q[0]], start[q[-1] + 1]) if len(q) == q[-1] - q[0] + 1 else np.repeat(start[q] - first, size) + np.arange(int(size.sum()))
            mine = slice(start[p], start[p + 1])
            weight[code[mine]] = count[mine]
            both = np.add.reduceat(np.minimum(weight[code[of]], count[of]), first, dtype=np.int64)
            weight[code[mine]] = 0
            q = q[down * both >= up * (n[p] + n[q] - both)]
            joined, one = np.unique(label[q], return_index=True)
            if len(joined):
                a += [node[p]] * len(joined)
                b += node[q[one]].tolist()
                label[np.isin(label, joined)] = label[p]
                left -= len(joined)
        if len(code) > LARGE:
            del code, count
            give_back()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.repartition(tasks, "band", "i", "j").groupBy("band", "i", "j").applyInArrow(run, "a bigint, b bigint")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", key: bool = False) -> DataFrame:
    """One row per row of docs: id, class_id, class_size, kept (and row_key with key=True).

    Texts are bags of five-word shingles (words are cut at white space). A class is a connected component of links;
    two texts link when the multiset Jaccard similarity of their bags is at least 0.8. class_id is the smallest id of
    the class; the row that has it stays (exactly one of rows that repeat it; a null id comes first). Null counts as
    empty; empty texts are copies of each other; texts of one to four words are one shingle. Other columns are not
    carried; an empty table gives no rows.

    Rows with equal bags become one node first. Nodes sharing a band of their signatures meet through the band's hubs:
    the node that shares most over all its bands, and one chosen by hash. Met pairs are verified on the bags themselves,
    which are made again from the texts of those that met. Then every pair of a band whose components still differ and
    whose sizes allow the similarity is verified, so that all links of texts that share a band count. A pair at
    similarity 0.8 shares a band with probability 0.9999.
    """
    with scope(docs.sparkSession) as keep:
        sketch, classes = _classes(docs, id_col, text_col)
        keep(sketch, classes)
    hot = classes.filter(F.col("size") > HOT_GROUP).select("d1", "d2", F.lit(True).alias("_hot"))  # at most rows / HOT_GROUP
    out = sketch.select("_id", "_key", "_rid", "d1", "d2").join(sized(hot), ["d1", "d2"], "left")
    out = out.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("_rid"), F.lit(SALTS)).cast("int")).otherwise(0))
    dealt = classes.withColumn("_salt", F.explode(F.when(F.col("size") > HOT_GROUP, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    out = out.join(dealt, ["d1", "d2", "_salt"])
    return out.select(F.col("_id").alias(id_col), F.col("head.id").alias("class_id"), F.col("class_size").cast("long"), (F.col("_rid") == F.col("head.rid")).alias("kept"), *[F.col("_key").alias("row_key")] * key)


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Written tables: the sketches (_id, _key, _rid, d1, d2, ...) and, of each distinct bag, d1, d2, size (its rows), head
    (the class's first row) and class_size."""
    spark = docs.sparkSession
    arrow_batches(spark)
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_of(text_col)).alias("_key"), text_of(text_col).alias("_t"))
    sketch = materialize(_sketches(rows).withColumn("_rid", F.monotonically_increasing_id()), "sketches")
    first = F.struct(F.col("_id").isNotNull().alias("x"), F.col("_id").alias("id"), F.col("_rid").alias("rid"))
    nodes = sketch.groupBy("d1", "d2").agg(F.min("_rid").alias("node"), F.min(first).alias("first"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = materialize(nodes, "nodes")

    banded = nodes.select("node", "n", F.explode("bands").alias("band"))
    bands = materialize(banded.groupBy("band").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "bands")
    shared = materialize(banded.join(sized(bands), "band"), "shared")
    degree = shared.groupBy("node").agg(F.sum("m").alias("degree"))
    by_degree, by_hash = (F.max(F.struct(*by, F.col("node").alias("hub"), F.col("n").alias("hub_n"))) for by in (["degree"], [F.xxhash64("node", "band")]))
    hubs = shared.join(degree, "node").groupBy("band").agg(by_degree.alias("x"), by_hash.alias("y"))
    hubs = materialize(hubs.select("band", F.explode(F.array(*(F.struct(f"{h}.hub", f"{h}.hub_n") for h in "xy"))).alias("h")).select("band", "h.*"), "hubs")

    def met(x: DataFrame) -> DataFrame:
        """Distinct pairs whose sizes allow the similarity."""
        up, down = SIMILARITY
        close = F.least("n", "hub_n") * down >= F.greatest("n", "hub_n") * up
        return x.filter((F.col("node") != F.col("hub")) & close).select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()

    pairs = materialize(met(shared.join(sized(hubs), "band")), "pairs")
    owner = materialize(shared.select("node").distinct().join(nodes.select("node", "d1", "d2", F.col("first.id").alias("__ml_id")), "node"), "owners")
    texts = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t")).join(sized(owner.select("__ml_id").distinct()), F.col("_id").eqNullSafe(F.col("__ml_id")), "left_semi")
    bags = _bags(texts.select("_t")).join(sized(owner.select("node", "d1", "d2")), ["d1", "d2"]).select("node", "s", "c")
    own = owner.select("__ml_id", F.col("d1").alias("o1"), F.col("d2").alias("o2"))
    if sketch.select("_id", "d1", "d2").join(sized(own), F.col("_id").eqNullSafe(F.col("__ml_id")) & (F.col("d1") == F.col("o1")) & (F.col("d2") == F.col("o2")), "left_semi").count() > owner.count():
        bags = bags.dropDuplicates(["node"])  # rows that repeat an owner's id and bag
    bags = materialize(bags, "bags")

    comp = components(materialize(_verified(pairs, bags), "links"))
    mine = shared.select("band", "node", "n", "m").join(sized(comp), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mine = materialize(mine, "placed")
    mixed = materialize(mine.groupBy("band").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("band"), "mixed")
    mine = mine.join(sized(mixed), "band", "left_semi")
    # small bands: pair by pair, so that pairs that share several are verified once
    few = mine.filter(F.col("m") <= SMALL).groupBy("band").agg(F.collect_list(F.struct("node", "n", "comp")).alias("all"))
    few = few.select("all", F.inline("all")).select("node", "n", "comp", F.explode("all").alias("h")).filter("node < h.node AND comp <> h.comp")
    new = met(few.select("node", "n", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"))).join(pairs, ["a", "b"], "left_anti")
    found = _verified(materialize(new, "pairs"), bags)
    # large bands: in blocks
    members, meetings = _blocks(mine.filter(F.col("m") > SMALL))
    there = meetings.withColumnRenamed("at", "block").join(members, ["band", "block"]).withColumnRenamed("block", "at")
    found = materialize(found.unionByName(_across(there.join(bags, "node").select("band", "i", "j", "at", "node", "n", "comp", "s", "c"), 4 * spark.sparkContext.defaultParallelism)), "links")
    # components of components
    of = lambda c: comp.select(F.col("node").alias(c), F.col("comp").alias(f"{c}_comp"))
    joined = found.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_comp", "a").alias("a"), F.coalesce("b_comp", "b").alias("b"))
    step = components(joined)
    moved = comp.join(sized(step.toDF("comp", "to")), "comp", "left").select("node", F.coalesce("to", "comp").alias("comp"))
    fresh = step.join(sized(comp.select(F.col("node"))), "node", "left_anti")
    comp = materialize(moved.unionByName(fresh), "components")

    whole = nodes.select("node", "d1", "d2", "first", "size").join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    whole = materialize(whole, "members")
    heads = whole.groupBy("comp").agg(F.min("first").alias("head"), F.sum("size").alias("class_size"))
    return sketch, materialize(whole.select("d1", "d2", "size", "comp").join(heads, "comp").select("d1", "d2", "size", "head", "class_size"), "classes")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that near_classes() keeps, all columns as they are."""
    return keep_decided(docs, near_classes(docs, id_col, text_col, key=True), id_col, text_col)
