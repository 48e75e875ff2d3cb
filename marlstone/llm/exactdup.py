"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash. Column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_decided, materialize, scope, sized, text_of

PREFIX = 256
#: Groups with more rows than this are dealt over SALTS tasks when rows look up their group.
HOT_GROUP = 10_000
SALTS = 64
#: Most 64-bit words of the bits that tell whether a key may be one of those that occur again (8 MB).
WORDS = 1 << 20


def normalized(text: str | Column) -> Column:
    return F.regexp_replace(text_of(text), r"[\x20\x09-\x0D]+", " ")


def _bits(keys: DataFrame, key: Column) -> tuple[Column, int]:
    """(array of 64-bit words in which the bit of every key is set, number of words); keys is a written table.

    About 64 bits a key up to WORDS words, which do not grow further: where they fill up, more rows than need be pass.
    """
    words = min(WORDS, 1 << max(4, keys.count().bit_length()))
    at = keys.select(F.pmod(key, F.lit(words * 64)).alias("at"))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))
    some = at.select(F.floor(F.col("at") / 64).cast("int").alias("w"), mask.alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    every = some.unionByName(keys.sparkSession.range(words).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("m"))).groupBy("w").agg(F.bit_or("m").alias("m"))
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("w", "m"))), lambda x: x["m"])).scalar(), words


def _place(bits: tuple[Column, int], key: Column) -> Column:
    return F.pmod(key, F.lit(bits[1] * 64))


def _may_be(bits: tuple[Column, int], at: Column) -> Column:
    """Whether the bit at a key's place is set."""
    return F.bit_get(F.get(bits[0], F.floor(at / 64).cast("int")), (at % 64).cast("int")) == 1


def refined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """A written row per row of docs: _id, _key (hash of the text as it is), _rid, _len, _pre, _sha and, with digest,
    _digest (of every row).

    The three steps: lengths are counted; rows whose length occurs again get a prefix hash (else _pre is null), which
    is counted with the length; rows for which both occur again get a hash of the full content (else _sha is null).
    What occurs again is kept as bits of bounded size, so a few other rows may pass a step, at any size of the input.
    """
    length = F.length("_t")
    rows = docs.select(F.col(id_col).alias("_id"), normalized(text_col).alias("_t"), F.xxhash64(text_of(text_col)).alias("_key"))
    lengths = rows.groupBy(length.alias("_len")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_len")
    lengths = _bits(materialize(lengths, "lengths"), F.xxhash64("_len"))
    looked = rows.withColumn("_len", length).withColumn("_at", _place(lengths, F.xxhash64("_len")))
    looked = looked.withColumn("_pre", F.when(_may_be(lengths, F.col("_at")), F.xxhash64(F.substring("_t", 1, PREFIX))))
    # a filter on _pre before the groups would be pushed down to the texts and normalise them once more
    prefixes = looked.groupBy("_len", "_pre").agg(F.count("_pre").alias("_n")).filter("_n > 1").select("_len", "_pre")
    prefixes = _bits(materialize(prefixes, "prefixes"), F.xxhash64("_len", "_pre"))
    looked = looked.withColumn("_at", F.when(F.col("_pre").isNotNull(), _place(prefixes, F.xxhash64("_len", "_pre"))))
    full = F.sha2("_t", 256)
    alive = F.col("_at").isNotNull() & _may_be(prefixes, F.col("_at"))
    tagged = looked.select("_id", "_key", F.monotonically_increasing_id().alias("_rid"), "_len", "_pre", F.when(alive, full).alias("_sha"), *[full.alias("_digest")] * digest)
    return materialize(tagged, "tagged")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, key: bool = False) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept (text_sha256 with digest=True; row_key, a hash of the text as
    it is, with key=True).

    Texts are equal when identical after each run of blanks, tabs and line ends becomes one space; null counts as
    empty. Of equal texts the smallest id stays; of rows that repeat this id too, exactly one stays; a null id comes
    before any other. Rows are refined by length, prefix hash and full hash (see refined()); only those that survive
    the first two have their whole content hashed and compared. Each step counts by key before it shuffles, so a hot
    group costs a row a task, and large groups are dealt over SALTS tasks where rows look up their group. No text is
    shuffled. Other columns are not carried and may have any names; an empty table gives no rows.
    """
    with scope(docs.sparkSession) as keep:
        tagged = refined(docs, id_col, text_col, digest)
        rest = tagged.filter("_sha is not null")
        first = F.min(F.struct(F.col("_id").isNotNull().alias("a"), F.col("_id").alias("b"), F.col("_rid").alias("c")))
        groups = materialize(rest.groupBy("_sha").agg(first.alias("_first"), F.count(F.lit(1)).alias("_size")), "groups")
        keep(tagged, groups)
    extra = [F.col("_digest").alias("text_sha256")] * digest + [F.col("_key").alias("row_key")] * key
    alone = tagged.filter("_sha is null").select(F.col("_id").alias(id_col), F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), *extra)
    hot = groups.filter(F.col("_size") > HOT_GROUP).select("_sha", F.lit(True).alias("_hot"))  # at most rows / HOT_GROUP
    salted = rest.join(sized(hot), "_sha", "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64("_rid"), F.lit(SALTS)).cast("int")).otherwise(0))
    dealt = groups.withColumn("_salt", F.explode(F.when(F.col("_size") > HOT_GROUP, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    found = salted.join(dealt, ["_sha", "_salt"]).select(
        F.col("_id").alias(id_col), F.col("_first.b").alias("keep_id"), F.col("_size").cast("long").alias("group_size"), (F.col("_rid") == F.col("_first.c")).alias("kept"), *extra
    )
    return alone.unionByName(found)


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_groups() keeps, all columns as they are."""
    return keep_decided(docs, exact_groups(docs, id_col, text_col, key=True), id_col, text_col)


OP8_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
), g AS (
  SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY h
)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, t.h AS text_sha256
FROM t JOIN g ON t.h = g.h
"""
