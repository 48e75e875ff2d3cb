"""More cases of the ten operators: plain versions of their models, hot groups, stages of refinement, awkward tables."""

import collections
import re

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marlstone.llm import ann, exactdup, linededup, neardup, packing, pii, quality, tokenfiles, urlfilter
from marlstone.llm.common import materialize, scope

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, url string, html string, host string, _id long, _lines string, _rid int, d1 int, node int, __x string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd_rows(texts):
    return [(i, t, f"http://h.org/{i % 3}" if i % 4 else None, t and f"<p>{t}</p><p>same</p>", "h", 1, "x", 2, 3, 4, "y") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows and ids, names that operators might use themselves."""
    rows = odd_rows([None, "", "  ", "a b c d e f", "a b  c d\te f", "w" * 300_000, "long text " * 30_000, "mail x@y.org now", "é 😀 ß"])
    return spark.createDataFrame(rows + rows[3:6] + [(None, *rows[3][1:]), (3, "other", *rows[3][2:])], SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


# -- 1
def test_pii_finds_where_a_third_is_unseen(spark):
    known = [(i, f"please call me at +1 (555) 010-{1000 + i} now ok") for i in range(12)]
    unseen = [(100 + i, f"please call me at 555 010 {7000 + i} now ok") for i in range(6)]
    other = [(200, "parts 555 010 8888 are out of stock")]
    got = {r.doc_id: r.spans for r in pii.span_report(spark.createDataFrame(known + unseen + other, "doc_id long, text string")).collect()}
    assert all(got[100 + i] == "phone:18:30" for i in range(6)) and got[200] == ""


def test_pii_rounds_go_on(spark):
    """Each context is trusted only once the strings of the one before are known: more rounds than three."""
    say = lambda k, x: f"ctx{k}a ctx{k}b {x} ctx{k}c ctx{k}d"
    rows = []
    for k, (name, many) in enumerate(zip("uvwxyz", (60, 39, 26, 17, 11, 7))):
        for j in range(many):
            number = f"+1 (555) 010-{1000 + j}" if k == 0 else f"555 0{k}0 {1000 + j}"
            # a string stands in its own context and the next, and so carries what is known from one to the other
            rows += [(len(rows), say(name, number)), (len(rows) + 1, say("uvwxyz."[k + 1], number))]
    last = [i for i, t in rows if t.startswith("ctxz") and "050" in t]
    got = {r.doc_id: r.spans for r in pii.span_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(last) == 7 and all(got[i].startswith("phone:") for i in last)


# -- 2
def test_quality_forward_against_loops():
    rng = np.random.default_rng(6)
    p = {k: rng.normal(size=s) for k, s in {"w": (5, 4), "b": 4, "v": (4, 3), "u": (4, 3), "a": 3, "c": 4, "d": 1}.items()}
    bags = [rng.normal(size=(k, 5)) * 4 for k in (1, 3, 2)]
    want = []
    for bag in bags:
        hidden, weight = [], []
        for x in bag:
            h = [np.tanh(sum(max(-8, min(8, x[i])) * p["w"][i][j] for i in range(5)) + p["b"][j]) for j in range(4)]
            gate = 0.0
            for m in range(3):
                t = np.tanh(sum(h[j] * p["v"][j][m] for j in range(4)))
                g = 1 / (1 + np.exp(-sum(h[j] * p["u"][j][m] for j in range(4))))
                gate += t * g * p["a"][m]
            hidden.append(h)
            weight.append(np.exp(gate))
        z = [sum(w * h[j] for w, h in zip(weight, hidden)) / sum(weight) for j in range(4)]
        want.append(1 / (1 + np.exp(-(sum(z[j] * p["c"][j] for j in range(4)) + p["d"][0]))))
    got = quality._forward(p, np.concatenate(bags), np.array([len(b) for b in bags]))["y"]
    assert np.allclose(got, want, atol=1e-12)


def test_quality_fit_is_bounded(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(quality, "train", lambda x, count, label: seen.update(count=count, label=label) or quality.Model(x.mean(0), x.std(0) + 1, None))
    rows = [(i, "word " * (50_000 if i == 3 else 40)) for i in range(20)] + [(5, f"again {k}") for k in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)] + [(4, 1), (4, 0)], "doc_id long, quality int")
    quality.fit(spark.createDataFrame(rows, "doc_id long, text string"), labels)
    taught = [i for i in range(20) if __import__("zlib").crc32(str(i).encode()) % 3 != 1]
    assert len(seen["count"]) == len(taught) and max(seen["count"]) <= quality.FIT_PASSAGES
    assert seen["count"].tolist().count(quality.FIT_PASSAGES) == (3 in taught)


# -- 3
def lines_by_hand(rows):
    """(id, host, lines, kept lines) of rows (id, host, lines)."""
    hosts = collections.defaultdict(list)
    for _, host, lines in rows:
        hosts[host].append(set(lines))
    out = []
    for i, host, lines in rows:
        pages = hosts[host]
        drop = {x for x in lines if len(pages) >= linededup.MIN_PAGES and (n := sum(x in p for p in pages)) > 1 and n > linededup.MAX_RATIO * len(pages)}
        out.append((i, host, len(lines), len([x for x in lines if x in drop]), "\n".join(x for x in lines if x not in drop)))
    return out


@pytest.mark.parametrize("wide", [False, True])
def test_site_lines_against_hand(spark, monkeypatch, wide):
    if wide:
        monkeypatch.setattr(linededup, "sized", lambda df: df)
    rng = np.random.default_rng(8)
    rows = []
    for i in range(120):
        host = ("hot.org", "b.org", "", "c.org")[0 if i % 3 else i % 4]
        lines = [f"own {i}"] + [f"line {k}" for k in range(6) if rng.random() < (0.2, 0.45, 0.55, 0.9, 0.5, 0.05)[k]] * (1 + i % 2)
        rows.append((i % 100, host, lines))  # ids repeat
    rows += [rows[4], rows[4], (None, "hot.org", ["line 3"]), (7, "hot.org", ["x" * 400_000, "line 3"]), (8, "b.org", [])]
    pages = spark.createDataFrame([(i, f"http://{h}/x" if h else None, "<br>".join(x), 1, "z") for i, h, x in rows], "page_id long, url string, html string, _host int, _codes string")
    got = linededup.drop_boilerplate(pages, "page_id", linededup.host_of("url"), linededup.html_lines("html")).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, lines_by_hand(rows)))


def test_site_lines_awkward(odd, nothing):
    make = lambda d: linededup.drop_boilerplate(d, "doc_id", linededup.host_of("url"), linededup.html_lines("html"))
    assert make(odd).count() == odd.count() and make(nothing).count() == 0


# -- 5
def log_probability(urls, order=urlfilter.ORDER):
    """Witten-Bell mixtures over dictionaries: a function of (context symbols, symbol)."""
    counts = [collections.defaultdict(collections.Counter) for _ in range(order + 1)]
    for u in urls:
        s = symbols(u)
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[k][tuple(s[i - k : i])][s[i]] += 1

    def p(context, symbol):
        out = 1 / urlfilter.SYMBOLS
        for k in range(order + 1):
            c = counts[k].get(tuple(context[order - k :]))
            if c:
                out = (c[symbol] + len(c) * out) / (sum(c.values()) + len(c))
        return out

    return p


def symbols(url):
    code = lambda c: ord(c.lower()) - 96 if c.isascii() and c.isalpha() else 27 if c.isascii() and c.isdigit() else 28 + urlfilter.MARKS.index(c) if c in urlfilter.MARKS else urlfilter.SYMBOLS - 1
    return [0] * urlfilter.ORDER + [x for c in url for x in ([code(c)] if c.isascii() else [urlfilter.SYMBOLS - 1] * len(c.encode()))]


def test_url_model_against_dictionaries(spark):
    rng = np.random.default_rng(2)
    good = [f"http://{''.join(rng.choice(list('abcde'), 6))}.com/{rng.integers(99)}?Q=é" for _ in range(150)]
    bad = [f"http://{''.join(rng.choice(list('cdefg'), 6))}.net/es/{rng.integers(99)}" for _ in range(150)]
    own = [f"http://{''.join(rng.choice(list('abcdefg'), 6))}.org/~{k}_" for k in range(40)] + ["", None, "HTTP://" + "z" * 5000]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in enumerate(good + bad + own + own[:3])], "page_id long, url string, _url string, score int")
    held = {r.url for r in pages.filter(F.pmod(F.xxhash64("url"), F.lit(10)) == 0).collect()}
    yes, no = (log_probability([u for u in x if u not in held]) for x in (good, bad))

    def score(u):
        s = symbols(u or "")
        n = urlfilter.ORDER
        parts = [np.log(yes(s[i - n : i], s[i])) - np.log(no(s[i - n : i], s[i])) for i in range(n, len(s))]
        return sum(parts) / max(1, len(parts))

    rows = {r.page_id: r for r in urlfilter.judge(pages).collect()}
    urls = good + bad + own + own[:3]
    assert len(rows) == len(urls)
    for i, u in enumerate(urls):
        assert abs(rows[i].score - score(u)) < 1e-4, u
    cut = [score(u) for u in good if u in held], [score(u) for u in bad if u in held]
    assert cut[0] and cut[1]
    # the threshold splits the held-out URLs as well as the best of their scores does
    hits = lambda t: np.mean([s >= t for s in cut[0]]) + np.mean([s < t for s in cut[1]])
    judged = [(rows[i].verdict == "allow", rows[i].score) for i in range(300, 340)]
    least, most = min((s for v, s in judged if v), default=9), max((s for v, s in judged if not v), default=-9)
    assert least > most
    best = max(hits(t) for t in [*cut[0], *cut[1], 9])
    assert max(hits(t) for t in np.linspace(most, least, 50)) >= best - 0.05


def test_url_filter_awkward(odd, nothing):
    assert urlfilter.judge(odd, id_col="doc_id").count() == odd.count() and urlfilter.judge(nothing, id_col="doc_id").count() == 0


# -- 7
def test_token_files_are_pruned(spark, nothing, odd, tmp_path, monkeypatch):
    text = open(P.path("word_bpe_49k.json"), encoding="utf-8").read()
    monkeypatch.setattr(tokenfiles, "STRIPE_BYTES", 1 << 16)
    rows = spark.range(0, 100_000, 2).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.hash("id", F.lit(k)).cast("string") for k in range(12)]).alias("text"))
    path = str(tmp_path / "many")
    tokenfiles.write_tokens(rows, path, text)
    from pyarrow import orc

    files = sorted((tmp_path / "many").glob("*.orc"))
    assert max(orc.ORCFile(str(f)).nstripes for f in files) > 1
    scanned = lambda x: rows_scanned(tokenfiles_of(spark, path).filter(F.col("doc_id") == x))
    assert 0 < scanned(20_000) <= 2000 and scanned(20_001) == 0
    tokenfiles.write_tokens(nothing, str(tmp_path / "none"), text)
    assert tokenfiles.read_tokens(spark, str(tmp_path / "none")).count() == 0
    assert tokenfiles.token_digest(odd, text).count() == odd.count()


def tokenfiles_of(spark, path):
    return spark.read.orc(path).select("doc_id", "n_tokens")


def rows_scanned(df):
    df.collect()
    node = df._jdf.queryExecution().executedPlan()
    while node.children().size():
        node = node.children().apply(0)
    return node.metrics().apply("numOutputRows").value()


# -- 8
def test_exact_stages_refine(spark, monkeypatch):
    """Prefix hashes only of rows whose length occurs again, full hashes only of those whose prefix does too."""
    prefix = "p" * exactdup.PREFIX
    texts = [f"{'x' * k}" for k in range(1, 41)]  # forty lengths of their own
    texts += [f"{k:02d}{'y' * 98}" for k in range(30)]  # one length, prefixes of their own
    texts += [f"{prefix}{k:04d}" for k in range(20)]  # one length and prefix, different ends
    texts += ["same text of many rows"] * 50
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for words in (exactdup.WORDS, 1):
        monkeypatch.setattr(exactdup, "WORDS", words)
        got = exactdup.refined(d)
        lengths = collections.Counter(map(len, texts))
        again = [t for t in texts if lengths[len(t)] > 1]
        heads = collections.Counter((len(t), t[: exactdup.PREFIX]) for t in again)
        alive = [t for t in again if heads[len(t), t[: exactdup.PREFIX]] > 1]
        n = got.agg(F.count("_pre").alias("p"), F.count("_sha").alias("s"), F.count("*").alias("n")).first()
        assert n.n == len(texts) and n.p >= len(again) and n.s >= len(alive)
        if words > 1:
            assert (n.p, n.s) == (len(again), len(alive)) == (101, 70)
        out = exactdup.exact_groups(d).collect()
        assert sum(r.kept for r in out) == len(set(texts)) and {r.group_size for r in out} == {1, 50}


# -- 9
def nearest(vectors, query, k=5):
    got = []
    for i, v in vectors:
        if i != query[0] and len(v) == len(query[1]):
            a, b = np.array(v, float), np.array(query[1], float)
            got.append((-float((a * b).sum()) / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())), i))
    return [(i, -s) for s, i in sorted(got)[:k]]


def test_ann_repeated_ids_doubles_and_ties(spark):
    rows = [(0, [1.0, 0.0])] * 7 + [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.5, 0.5])]
    got = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [1, 3, 2] and got[1].score == nearest(rows, rows[0])[1][1] == 0.5 / np.sqrt(0.5)
    rng = np.random.default_rng(3)
    wide = [(i, (rng.normal(size=7) * 10.0 ** rng.integers(-160, 160)).tolist()) for i in range(400)]
    wide += [(400 + i, [1e200 * (k == 0) for k in range(7)]) for i in range(9)]
    d = spark.createDataFrame([(i, v, 1, "q", 2) for i, v in wide], "vec_id long, embedding array<double>, id int, v string, qb int")
    found = collections.defaultdict(list)
    for r in ann.search(d, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    assert [i for i, _ in found[400]] == [401, 402, 403, 404, 405]
    scaled = [(i, (np.array(v) / np.abs(v).max()).tolist()) for i, v in wide]
    hits = sum(len({i for i, _ in found[q]} & {i for i, _ in nearest(scaled, scaled[q])}) for q in range(0, 400, 50))
    assert hits >= 0.9 * 40
    assert ann.search(d.limit(0), F.col("vec_id") % 50 == 0).count() == 0


# -- 10
def test_near_classes_of_a_near_copy_group(spark):
    """1,500 texts of 200 words from one base, 3 to 8 words replaced in each: every link counts, few are near the hubs."""
    rng = np.random.default_rng(0)
    base = [f"b{k}" for k in range(200)]
    texts = []
    for i in range(1500):
        t = list(base)
        for k in rng.choice(200, rng.integers(3, 9), replace=False):
            t[k] = f"r{i}_{k}"
        texts.append(t)
    at = collections.defaultdict(list)
    for i, t in enumerate(texts):
        for k in range(196):
            at[tuple(t[k : k + 5])].append(i)
    shared = np.zeros((1500, 1500), np.int32)
    for rows in at.values():
        if len(rows) > 1:
            shared[np.ix_(rows, rows)] += 1
    linked = 5 * shared >= 4 * (2 * 196 - shared)
    np.fill_diagonal(linked, False)
    label = np.arange(1500)
    while True:
        new = np.minimum(label, np.where(linked, label[None], 1500).min(1))
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    rows = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.near_classes(rows).collect()}
    assert linked.sum() // 2 > 300 and [got[i] for i in range(1500)] == label.tolist()


def test_near_classes_hot_groups_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(neardup, "HOT_GROUP", 50)
    words = [f"w{k}" for k in range(60)]
    same, near = " ".join(words), " ".join([*words[:59], "other"])
    rows = [(i, same) for i in range(300)] + [(7, same)] * 40 + [(1000, near), (1000, near), (None, near), (2000, "apart from all of these")]
    got = neardup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == 2
    assert {(r.class_id, r.class_size) for r in got if r.doc_id != 2000} == {(None, 343)}


# -- shared parts and the pipeline
def test_scope_drops_what_is_not_kept(spark, tmp_path):
    import os

    gone = lambda f: not os.path.exists(f._ml_path.removeprefix("file:"))
    with scope(spark) as outer:
        with scope(spark) as keep:
            a, b = materialize(spark.range(3), "a"), materialize(spark.range(4), "b")
            keep(b)
        assert gone(a) and not gone(b) and b.count() == 4
        outer()
    assert gone(b)


def test_pipeline_stages_on_awkward_and_empty_tables(spark, odd, nothing):
    for d in (odd, nothing):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, d, SF)
            rows = out.count()
            if name == "pack":
                assert rows >= d.count()
            else:
                assert out.columns == d.columns and rows <= d.count()
                if d is odd and name in ("exact", "near"):
                    norm = (lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) if name == "exact" else (lambda t: tuple((t or "").split()))
                    assert rows == len({norm(r.text) for r in d.collect()})
                if name == "pii":
                    assert rows == d.count() and (d is nothing or out.filter(F.col("text") == "mail <EMAIL> now").count() == 1)


def test_pipeline_against_plain_versions(spark, docs):
    from test_llm import base_spans, classes_by_force

    judged = {r.doc_id: r.score for r in quality.judge(docs, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    rows = sorted((r.doc_id, r.text or "") for r in docs.collect() if judged[r.doc_id] >= 0.5)
    first = {}
    for i, t in rows:
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), (i, t))
    rows = sorted(first.values())
    label = classes_by_force([t for _, t in rows])
    kept = {}
    for (i, t), c in zip(rows, label):
        kept.setdefault(c, (i, t))
    want = {}
    for i, t in sorted(kept.values()):
        spans = sorted((int(s), int(e), k) for k, s, e in (x.split(":") for x in base_spans(t)))
        out, at = [], 0
        for s, e, k in spans:
            out.append(t[at:s] if s > at else "")
            if s >= at:
                out.append(f"<{k.upper()}>")
            at = max(at, e)
        want[i] = "".join(out) + t[at:]
    found = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = materialize(stage(spark, found, SF), "stage")
    got = {r.doc_id: r.text or "" for r in found.collect()}
    added = {r.doc_id for r in pii.span_report(spark.createDataFrame(sorted(kept.values()), "doc_id long, text string")).collect() if len(r.spans.split(",")) > r.n_email + r.n_ip + r.n_card + r.n_phone and r.spans}
    assert got.keys() == want.keys() and all(got[i] == want[i] for i in want if i not in added)
    packed = packing.pack_documents(found, open(P.path("word_bpe_49k.json"), encoding="utf-8").read())
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == want.keys()


class Captured:
    """Stands for a frame; keeps the function that an operator hands to Spark."""

    def mapInArrow(self, run, schema):
        return run

    def applyInArrow(self, run, schema):
        return run

    def repartition(self, *_):
        return self

    groupBy = repartition


def test_workers_give_back_what_packing_kept():
    """A worker that goes on to near duplicates or quality holds no tokenizer of the stage before."""
    import gc
    import weakref

    from marlstone.llm import tokens

    content = open(P.path("word_bpe_49k.json"), encoding="utf-8").read()
    coder = tokens.word_bpe(content)
    want, kept = coder.encode(b"one two, three"), weakref.ref(coder)
    assert tokens.word_bpe(content) is coder  # kept between tasks of one operator
    del coder
    assert list(neardup._bags(Captured())(iter([]))) == []
    gc.collect()
    assert kept() is None
    assert tokens.word_bpe(content).encode(b"one two, three") == want


def test_blocks_return_their_memory():
    """Links between blocks are those of all pairs, and a large group leaves little behind in its worker."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    base = [np.unique(rng.integers(0, 1 << 62, 300).astype(np.uint64)) for _ in range(8)]
    bags = []
    for k in range(400):
        b = base[k % 8].copy()
        b[rng.integers(0, 300, 3 + k % 60)] = rng.integers(0, 1 << 62, 3 + k % 60).astype(np.uint64)
        bags.append(np.unique(b))
    n = [len(b) for b in bags]
    table = pa.table({"band": [1] * 400, "i": [1] * 400, "j": [2] * 400, "at": [1 + k // 8 % 2 for k in range(400)], "node": list(range(400)), "n": n, "comp": list(range(400)), "s": pa.array([b.tobytes() for b in bags], pa.binary()), "c": pa.array([np.ones(len(b), np.int32).tobytes() for b in bags], pa.binary())})

    def classes(links):
        up = list(range(400))

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in links:
            a, b = sorted((top(a), top(b)))
            up[b] = a
        return [top(x) for x in range(400)]

    sets = [set(b.tolist()) for b in bags]
    every = [(a, b) for a in range(400) for b in range(a) if a // 8 % 2 != b // 8 % 2 and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    found = neardup._across(Captured(), 1)(table)
    links = list(zip(found.column("a").to_pylist(), found.column("b").to_pylist()))
    assert every and set(map(tuple, map(sorted, links))) <= set(map(tuple, map(sorted, every)))
    assert classes(links) == classes(every)
    x = rng.integers(0, 50, 1000).astype(np.uint64)
    assert neardup._codes(x).tolist() == np.unique(x, return_inverse=True)[1].tolist() and neardup._codes(x[:1]).tolist() == [0]
