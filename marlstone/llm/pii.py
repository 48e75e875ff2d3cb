"""Personal data by bootstrapped contextual extraction. Column functions only.

Identifiers that a strict pattern finds are the seeds. The words around every identifier-like string are lexical
patterns; patterns and the strings they occur with form a graph. In rounds, a pattern is scored by the share of its
strings that are known identifiers, and a string by the patterns it occurs with; strings that several trusted patterns
vouch for become known, and their occurrences are added to the seeds' spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, scope, sized, text_of

KINDS = ("email", "ip", "card", "phone")
# Each is the contract's pattern, written so that no position is tried twice: a match starts where a run starts (or
# where the last match ended), and runs are taken whole.
STRICT = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Shapes that an unseen identifier of the kind may have.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]{1,63}+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]{2,63}+){1,4}+",
    "ip": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![\x20-]?[0-9])",
    "phone": r"(?<![0-9+(.-])\(?[0-9]{2,4}\)?[\x20.-][0-9]{3,4}(?:[\x20.-][0-9]{3,4}){1,2}+(?![0-9])",
}
#: What a text must hold for a pattern of the kind to match at all.
NEEDS = {"email": r"@|[(\[]at[)\]]", "ip": r"[0-9]\.[0-9]|[0-9A-Fa-f]:[0-9A-Fa-f]", "card": r"[0-9](?:[\x20-]?[0-9]){7}", "phone": r"[0-9](?:[\x20().-]*[0-9]){5}"}
#: A pattern is trusted with so many known strings, and with known / (known + UNSEEN * unseen) of at least MIN_CONFIDENCE:
#: an unseen string is weak evidence against it, as unseen identifiers are what the pattern is for.
MIN_KNOWN = 5
UNSEEN = 0.25
MIN_CONFIDENCE = 0.8
#: A string becomes known with so many trusted patterns and this mean confidence.
MIN_PATTERNS = 2
MIN_SCORE = 0.85
#: Characters on either side that the two nearest words of a context are looked for in.
WINDOW = 120
_SPAN = "array<struct<s:int,e:int,m:string>>"


def matches(t: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their code point spans (end exclusive)."""

    def fold(x: Column) -> Column:
        pairs = F.zip_with(F.slice(x["g"], F.lit(1), F.size(x["m"])), x["m"], lambda g, m: F.struct(F.length(g).alias("g"), m.alias("m")))

        def step(acc: Column, y: Column) -> Column:
            s = acc["p"] + y["g"]
            e = s + F.length(y["m"])
            return F.struct(e.alias("p"), F.concat(acc["o"], F.array(F.struct(s.alias("s"), e.alias("e"), y["m"].alias("m")))).alias("o"))

        return F.aggregate(pairs, F.struct(F.lit(0).alias("p"), F.array().cast(_SPAN).alias("o")), step, lambda acc: acc["o"])

    return let(F.struct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("m"), F.split(t, pattern, -1).alias("g")), fold)


def _octet(p: Column) -> Column:
    return let(F.regexp_replace(p, "^0+", ""), lambda z: F.when(F.length(z) > 3, False).otherwise(F.concat(F.lit("0"), z).cast("int") <= 255))


def _luhn(m: Column) -> Column:
    def total(d: Column) -> Column:
        def add(acc: Column, i: Column) -> Column:
            v = F.substr(d, -i, F.lit(1)).cast("int")
            return acc + F.when(i % 2 == 0, v * 2 - F.when(v > 4, 9).otherwise(0)).otherwise(v)

        return F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0

    return let(F.translate(m, " -", ""), total)


def _digits(m: Column) -> Column:
    return F.length(F.regexp_replace(m, "[^0-9]", ""))


VALID = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: F.forall(F.split(m, r"\."), _octet),
    "card": _luhn,
    "phone": lambda m: _digits(m).between(8, 15),
}


def _kind_spans(t: Column, kind: str) -> Column:
    found = F.filter(matches(t, STRICT[kind]), lambda x: VALID[kind](x["m"]))
    return F.when(t.rlike(NEEDS[kind]), found).otherwise(F.array().cast(_SPAN))


def _occurrences(t: Column, kind: str, base: Column) -> Column:
    """Known and identifier-like strings of the kind with their contexts; like ones that touch no base span."""
    full = "array<struct<k:string,s:int,e:int,m:string,known:boolean,p:array<string>>>"

    def tokens(x: Column) -> Column:
        return F.split(F.trim(F.regexp_replace(F.lower(x), "[0-9]+", "0")), r"\s+")

    def context(x: Column) -> Column:
        left = tokens(F.substr(t, F.greatest(x["s"] - (WINDOW - 1), F.lit(1)), F.least(x["s"], F.lit(WINDOW))))
        right = tokens(F.substr(t, x["e"] + 1, F.lit(WINDOW)))

        def pats(c: Column) -> Column:
            l1, l2 = F.element_at(c["l"], -1), F.when(F.size(c["l"]) > 1, F.element_at(c["l"], -2)).otherwise(F.lit(""))
            r1, r2 = F.element_at(c["r"], 1), F.when(F.size(c["r"]) > 1, F.element_at(c["r"], 2)).otherwise(F.lit(""))
            return F.array(F.concat(F.lit("l "), l2, F.lit(" "), l1), F.concat(F.lit("b "), l1, F.lit(" "), r1), F.concat(F.lit("r "), r1, F.lit(" "), r2))

        return let(F.struct(left.alias("l"), right.alias("r")), pats)

    known = F.transform(base[kind], lambda x: F.struct(F.lit(kind).alias("k"), x["s"], x["e"], x["m"], F.lit(True).alias("known"), context(x).alias("p")))
    like = F.filter(matches(t, LOOSE[kind]), lambda x: ~F.exists(F.concat(*[base[k] for k in KINDS]), lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    like = F.transform(like, lambda x: F.struct(F.lit(kind).alias("k"), x["s"], x["e"], x["m"], F.lit(False).alias("known"), context(x).alias("p")))
    return F.when(t.rlike(NEEDS[kind]), F.concat(known, like)).otherwise(F.array().cast(full))


def base_spans(t: Column) -> Column:
    """struct of kind -> array of (s, e, m)."""
    return F.struct(*[_kind_spans(t, k).alias(k) for k in KINDS])


def _named(spans: Column, kind: str) -> Column:
    return F.transform(spans, lambda x: F.struct(F.lit(kind).alias("k"), x["s"], x["e"]))


def _of_kind(spans: str, kind: str) -> Column:
    return F.filter(spans, lambda x: x["k"] == kind)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base and all spans of every row: id, key (xxhash64 of the text), base and added (arrays of k, s, e).

    Null text is empty; empty texts have no spans; repeated rows are each found; ids may be null; other columns are not
    carried and may have any names; an empty table gives no rows. The text is read once; what follows works on
    identifier-like strings only: occurrences, the graph's edges (pattern, string) and their scores, counted by key
    before every shuffle. Rounds go on until one adds no string. A word of a context that is longer than WINDOW counts
    by its WINDOW characters next to the string.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_t"))
    t = F.col("_t")

    def all_of(base: Column) -> Column:
        return F.struct(F.concat(*[_named(base[k], k) for k in KINDS]).alias("base"), F.concat(*[_occurrences(t, k, base) for k in KINDS]).alias("occ"))

    with scope(spark) as keep:
        seen = rows.select(F.monotonically_increasing_id().alias("_rid"), "_id", F.xxhash64(t).alias("_key"), let(base_spans(t), all_of).alias("x"))
        seen = materialize(seen.select("_rid", "_id", "_key", "x.base", "x.occ"), "spans")
        occ = seen.select("_rid", F.explode("occ").alias("o")).select("_rid", "o.*")
        accepted = _bootstrapped(occ.select("k", "m", "known", F.explode("p").alias("p")), keep)
        keep(seen)
    none = F.array().cast("array<struct<k:string,s:int,e:int>>")
    if accepted is None:
        return seen.select(F.col("_id").alias(id_col), F.col("_key").alias("key"), "base", none.alias("added"))
    hits = occ.filter("not known").join(sized(accepted), ["k", "m"]).groupBy("_rid").agg(F.collect_list(F.struct("k", "s", "e")).alias("added"))
    return seen.join(hits, "_rid", "left").select(F.col("_id").alias(id_col), F.col("_key").alias("key"), "base", F.coalesce("added", none).alias("added"))


def _bootstrapped(occurrences: DataFrame, keep) -> DataFrame | None:
    """(k, m) of the strings that become known from occurrences(k, m, known, p); None if there are none."""
    edges = materialize(occurrences.groupBy("k", "p", "m").agg(F.max("known").alias("known")), "edges")
    accepted = None
    while True:
        known = F.count_if("known")
        good = edges.groupBy("k", "p").agg((known / (known + UNSEEN * F.count_if(~F.col("known")))).alias("conf"), known.alias("n"))
        good = materialize(good.filter((F.col("n") >= MIN_KNOWN) & (F.col("conf") >= MIN_CONFIDENCE)).select("k", "p", "conf"), "patterns")
        new = edges.filter("not known").join(sized(good), ["k", "p"]).groupBy("k", "m").agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("score"))
        new = materialize(new.filter((F.col("n") >= MIN_PATTERNS) & (F.col("score") >= MIN_SCORE)).select("k", "m"), "accepted")
        if new.isEmpty():
            return accepted
        keep(new)
        accepted = new if accepted is None else accepted.unionByName(new)
        edges = materialize(edges.join(sized(new.withColumn("_new", F.lit(True))), ["k", "m"], "left").select("k", "p", "m", (F.col("known") | F.col("_new").isNotNull()).alias("known")), "edges")


def _written(spans: Column) -> Column:
    order = F.array(*map(F.lit, KINDS))
    ranked = F.array_sort(F.transform(spans, lambda x: F.struct(F.array_position(order, x["k"]).alias("r"), x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    return F.array_join(F.transform(ranked, lambda x: F.concat_ws(":", x["k"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def span_report(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans as text."""
    x = find(docs)
    counts = [F.size(_of_kind("base", k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return x.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.concat("base", "added")).alias("spans"))


def _redacted(t: Column, spans: Column) -> Column:
    """t with every span replaced by its kind; overlapping spans become one."""

    def step(acc: Column, x: Column) -> Column:
        gap = F.substr(t, acc["p"] + 1, F.greatest(x["s"] - acc["p"], F.lit(0)))
        name = F.when(x["s"] >= acc["p"], F.concat(F.lit("<"), F.upper(x["k"]), F.lit(">"))).otherwise(F.lit(""))
        return F.struct(F.greatest(acc["p"], x["e"]).alias("p"), F.concat(acc["o"], gap, name).alias("o"))

    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"))))
    out = F.aggregate(ordered, F.struct(F.lit(0).alias("p"), F.lit("").alias("o")), step, lambda acc: F.concat(acc["o"], F.substr(t, acc["p"] + 1, F.length(t))))
    return F.when(F.size(spans) == 0, t).otherwise(out)


def mask_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """docs with every span of the text replaced by <EMAIL>, <IP>, <CARD> or <PHONE>, and its length (code points) renewed.

    Null texts stay null. Spans reach their rows by id and text, so rows that repeat an id are safe; rows without
    spans are not touched and nothing of theirs is shuffled while the rows with spans are within the broadcast bound.
    """
    found = find(docs, id_col, text_col).select(F.col(id_col).alias("__ml_id"), F.col("key").alias("__ml_key"), F.concat("base", "added").alias("__ml_spans"))
    some = materialize(found.filter(F.size("__ml_spans") > 0).dropDuplicates(["__ml_id", "__ml_key"]), "masked")
    keyed = docs.withColumn("__ml_hash", F.xxhash64(text_of(text_col)))
    joined = keyed.join(sized(some), F.col(id_col).eqNullSafe(F.col("__ml_id")) & (F.col("__ml_hash") == F.col("__ml_key")), "left")
    text = F.when(F.col("__ml_spans").isNull(), F.col(text_col)).otherwise(_redacted(F.col(text_col), F.col("__ml_spans")))
    masked = joined.withColumn("__ml_text", text)
    cols = [F.col("__ml_text").alias(c) if c == text_col else F.when(F.col("__ml_spans").isNull(), F.col(c)).otherwise(F.length("__ml_text").cast(docs.schema[c].dataType)).alias(c) if c == length_col else F.col(c) for c in docs.columns]
    return masked.select(*cols)
