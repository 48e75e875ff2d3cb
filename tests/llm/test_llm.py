"""Each operator against a brute-force version or a round trip, and on awkward rows."""

import base64
import collections
import hashlib
import re
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from marlstone.llm import ann, bytebpe, exactdup, linededup, neardup, packing, pii, quality, queries, tokenfiles, urlfilter
from marlstone.llm.common import keep_decided, word_hashes
from marlstone.llm.components import components

SF = "/root/testdata/sf0.001"
ODD = [None, "", " ", "one", "a b  c\td\ne", "x" * 70_000, "word " * 5_000, "naïve déjà-vu 東京 😀 e\u0301", "<|endoftext|> don't I'LL", "a   b\n \n c ", "İ ΑΣ ß"]
SCHEMA = "doc_id long, text string, kept string, keep_id int, _t string, score double"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x", 1, "y", 0.5) for i, t in enumerate(ODD)] + [(1, "", "x", 1, "y", 0.5), (None, "one", "x", 1, "y", 0.5), (3, "one", "z", 2, "y", 0.5), (3, "another text altogether", "z", 2, "y", 0.5)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def word_ids():
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


# -- 1
def base_spans(t):
    out = []
    for k, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(v * 2 - 9 * (v > 4) if i % 2 else v for i, v in enumerate(map(int, reversed(d)))) % 10 == 0
            if k == "email" or k == "ip" and all(int(x) <= 255 for x in m[0].split(".")) or k == "card" and 16 <= len(d) <= 19 and luhn or k == "phone" and 8 <= len(d) <= 15:
                out.append(f"{k}:{m.start()}:{m.end()}")
    return out


PII = [
    "mail a.b+c@d-e.f.g and a@b.c+d@e.f.", "1.2.3.4.5.6.7.8 and 300.1.1.1 and 007.0.0.1 1.2.3", "card 4111 1111-11111111, 4111111111111112 5 4111111111111111", "+1 (555) 010-9999 then +12 3 +123456789012345678",
    "😀é x@y.z 日本 8.8.8.8", "9" * 3000 + " " + "1.1." * 900, "a" * 50_000, "12  34 4111111111111111  4111111111111111", "@@ a@b a@.b x@y..z", "",
]


def test_pii_base_is_exact(spark, docs, odd, nothing):
    cases = spark.createDataFrame(list(enumerate(PII)), "doc_id long, text string").unionByName(docs.select((F.col("doc_id") + 1000).alias("doc_id"), "text"))
    texts = {r.doc_id: r.text or "" for r in cases.collect()}
    for r in pii.span_report(cases).collect():
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), texts[r.doc_id][:80]
        assert set(want) <= set(r.spans.split(",")) | {""}
        assert r.n_email == sum(x.startswith("email") for x in want) and r.n_card == sum(x.startswith("card") for x in want)
    assert pii.span_report(odd).count() == odd.count() and pii.span_report(nothing).count() == 0


def test_pii_bootstraps_from_context(spark):
    known = [(i, f"please call me at +1 (555) 010-{1000 + i} now ok") for i in range(12)]
    rows = known + [(50, "please call me at 555 010 7777 now ok"), (51, "part 555 010 8888 is out of stock")]
    got = {r.doc_id: r.spans for r in pii.span_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[50] == "phone:18:30" and got[51] == ""


def test_pii_masks(spark, odd):
    d = spark.createDataFrame([(1, "x a@b.co, y 8.8.8.8!", 20), (2, None, 0), (3, "clean", 5), (1, "other", 5)], "doc_id long, text string, n_chars long")
    got = sorted((r.doc_id, r.text or "", r.n_chars) for r in pii.mask_documents(d).collect())
    assert got == [(1, "other", 5), (1, "x <EMAIL>, y <IP>!", 18), (2, "", 0), (3, "clean", 5)]
    assert pii.mask_documents(odd, length_col=None).columns == odd.columns


# -- 2
def test_quality_learns_and_holds_out(spark):
    d, y = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge(d, y).collect()
    label = {r.doc_id: r.quality for r in y.collect()}
    assert len(rows) == d.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for r in rows)
    held = [(r.score, label[r.doc_id]) for r in rows if r.held_out and r.doc_id in label]
    good, bad = [s for s, v in held if v == 1], [s for s, v in held if v == 0]
    assert np.mean([a > b for a in good for b in bad]) > 0.95


def test_quality_gradient():
    rng = np.random.default_rng(0)
    p = {"w": rng.normal(size=(5, 4)), "b": rng.normal(size=4), "v": rng.normal(size=(4, 3)), "u": rng.normal(size=(4, 3)), "a": rng.normal(size=3), "c": rng.normal(size=4), "d": rng.normal(size=1)}
    x, n, y = rng.normal(size=(7, 5)), np.array([3, 1, 3]), np.array([1.0, 0.0, 1.0])
    loss = lambda q: -np.mean(y * np.log(o := quality._forward(q, x, n)["y"]) + (1 - y) * np.log(1 - o))
    g = quality._gradients(p, x, n, y)
    for k in p:
        i = tuple(0 for _ in p[k].shape)
        up, down = ({**p, k: p[k].copy()} for _ in range(2))
        up[k][i] += 1e-6
        down[k][i] -= 1e-6
        assert abs((loss(up) - loss(down)) / 2e-6 - g[k][i]) < 1e-5


def test_quality_awkward(spark, odd, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in quality.judge(odd, none).collect()} == {0.5}
    some = spark.createDataFrame([(i, i % 2) for i in range(12)] + [(None, 1), (2, None)], "doc_id long, quality int")
    assert all(0 <= r.score <= 1 for r in quality.judge(odd, some).collect())
    assert quality.keep_good(odd, none).columns == odd.columns and quality.judge(nothing, none).count() == 0


# -- 3
def test_site_lines(spark):
    page = lambda i, own, url="http://A.b/x": (i, url, f"<html><script>var x='<p>no</p>'</script><nav><a>Menu</a></nav><p>{own}</p><footer>&copy; us</footer></html>")
    rows = [page(i, f"own {i}") for i in range(6)] + [page(9, "own 0", None), (10, "http://c.d/", None), (11, "nohost", "<p>Menu</p>")]
    got = {r.page_id: r for r in linededup.drop_boilerplate(spark.createDataFrame(rows, "page_id long, url string, html string"), "page_id", linededup.host_of("url"), linededup.html_lines("html")).collect()}
    assert got[0].text == "own 0" and got[0].host == "a.b" and (got[0].n_lines, got[0].n_dropped) == (3, 2)
    assert got[9].text == "Menu\nown 0\n© us" and got[10].text == "" and got[11].text == "Menu"


# -- 4
def test_packing_is_gapless_and_tight(spark, docs, odd, nothing):
    text = open(P.path("word_bpe_49k.json"), encoding="utf-8").read()
    ids = word_ids()
    for d in (docs, odd):
        rows = packing.pack_documents(d, text, with_ids=True).collect()
        bins = collections.defaultdict(list)
        for r in rows:
            bins[r.sequence_id].append((r.offset, r.length))
            assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length and r.length <= 2048
        for pieces in bins.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            assert at <= 2048
        want = sorted(tuple(ids(r.text) + [0]) for r in d.collect())
        found = collections.defaultdict(list)
        for r in rows:
            found[r.doc_id].append(r)
        if d is docs:
            got = sorted(tuple(np.frombuffer(b"".join(r.ids for r in sorted(x, key=lambda r: r.piece)), "<u4").tolist()) for x in found.values())
            assert got == want
        total = sum(map(len, want))
        assert sum(r.length for r in rows) == total
    whole = packing.pack_documents(docs, text).agg(F.count_distinct("sequence_id"), F.sum("length")).first()
    assert whole[0] <= 1.05 * whole[1] / 2048 + 2
    assert packing.pack_documents(nothing, text).count() == 0


def test_best_fit_against_plain_search():
    rng = np.random.default_rng(3)
    fast, open_bins, n = packing.BestFit(100, 8), [], 0
    for length in rng.integers(1, 101, 3000).tolist():
        fits = [b for b in open_bins if b[1] >= length]
        if fits:
            best = min(b[1] for b in fits)
            b = [x for x in open_bins if x[1] == best][-1]
            open_bins.remove(b)
        else:
            if len(open_bins) == 8:
                full = min(x[1] for x in open_bins)
                open_bins.remove([x for x in open_bins if x[1] == full][-1])
            b, n = [n, 100], n + 1
        assert fast.place(length) == (b[0], 100 - b[1])
        b[1] -= length
        if b[1]:
            open_bins.append(b)


# -- 5
def test_url_parts_and_rules(spark):
    urls = ["http://www.Example.com/en/a?x#y", "https://example.com/en/1", "http://EXAMPLE.COM/fr", "ftp://a.net/es/1", "http://a.net/fr", "http://xnet/es/", "no scheme", None, "", "http://com/", "http://e.com?q=/", "x://net/es/"]
    got = {r.page_id: r for r in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).collect()}
    want = [("www.example.com", "/en/a", "www.example.com/en/"), ("example.com", "/en/1", "example.com/en/"), ("example.com", "/fr", "com/"), ("a.net", "/es/1", "net/es/"), ("a.net", "/fr", None), ("xnet", "/es/", None), ("", "", None), ("", "", None), ("", "", None), ("com", "/", "com/"), ("e.com", "", None), ("net", "/es/", "net/es/")]
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(len(urls))] == want
    assert [got[i].verdict for i in (0, 1, 2, 3)] == ["allow", "block", "allow", "block"] and got[7].verdict == "allow"


def test_url_model_separates(spark):
    rng = np.random.default_rng(1)
    good = [f"http://{''.join(rng.choice(list('abcd'), 8))}.org/{i}" for i in range(400)]
    bad = [f"http://{''.join(rng.choice(list('wxyz'), 8))}.org/{i}" for i in range(400)]
    model = urlfilter.fit(spark.createDataFrame([(u, True) for u in good[:300]] + [(u, False) for u in bad[:300]], "url string, accepted boolean"))

    def score(us):
        raw = np.frombuffer("".join(us).encode(), np.uint8)
        return model.scores(raw, np.r_[0, np.cumsum([len(u) for u in us])])

    assert np.mean(score(good[300:]) >= model.threshold) > 0.95 and np.mean(score(bad[300:]) < model.threshold) > 0.95
    p = np.exp(urlfilter._log_probabilities(np.random.default_rng(0).integers(0, 3, urlfilter.SYMBOLS ** 4))).reshape(-1, urlfilter.SYMBOLS)
    assert np.allclose(p.sum(1), 1, atol=1e-3)


# -- 6
def test_byte_bpe_round_trip(spark, docs, odd, nothing):
    content = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}
    ref = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    d = docs.limit(60).select("doc_id", "text").unionByName(odd.filter("doc_id is not null").select((F.col("doc_id") + 10**6 + F.length(F.coalesce("text", F.lit("")))).alias("doc_id"), "text"))
    texts = {r.doc_id: r.text or "" for r in d.collect()}
    got = bytebpe.encode_texts(d, content, P.PATTERN, outputs=("ids", "offsets", "decoded")).collect()
    for r in got:
        t = texts[r.doc_id]
        assert r.ids == ref.encode_ordinary(t) and bytes(r.decoded) == t.encode()
        spans = np.array(r.offsets).reshape(-1, 2)
        for token, (a, b) in list(zip(r.ids, spans))[:200]:
            part = ref.decode_single_token_bytes(token)
            assert part in t[a:b].encode() and b - a <= len(part)
    rows = spark.createDataFrame([(1, ref.encode_ordinary("😀 héllo")), (2, None), (3, [])], "doc_id long, ids array<long>")
    assert {r.doc_id: bytes(r.decoded).decode() for r in bytebpe.decode_ids(rows, content, P.PATTERN).collect()} == {1: "😀 héllo", 2: "", 3: ""}
    assert bytebpe.encode_texts(nothing, content, P.PATTERN).count() == 0


# -- 7
def test_token_files(spark, docs, odd, tmp_path):
    text = open(P.path("word_bpe_49k.json"), encoding="utf-8").read()
    ids = word_ids()
    start = 0
    got = {r.doc_id: r for r in tokenfiles.token_digest(docs, text).collect()}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        want = ids(r.text) + [1]
        assert (got[r.doc_id].start, got[r.doc_id].n_tokens, got[r.doc_id].ids_crc32) == (start, len(want), crc(want))
        start += len(want)
    tokenfiles.write_tokens(odd, str(tmp_path / "t"), text)
    rows = tokenfiles.read_tokens(spark, str(tmp_path / "t")).collect()
    assert len(rows) == odd.count() and sorted(r.start for r in rows) == np.cumsum([0] + [r.n_tokens for r in sorted(rows, key=lambda r: r.start)][:-1]).tolist()
    assert rows and tokenfiles.read_tokens(spark, str(tmp_path / "t")).filter("doc_id = 4").count() == 1


# -- 8
def test_exact_groups(spark, docs, odd, nothing):
    by = collections.defaultdict(list)
    for r in odd.collect():
        by[re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")].append(r.doc_id)
    rows = exactdup.exact_groups(odd, digest=True).collect()
    assert len(rows) == odd.count() and sum(r.kept for r in rows) == len(by)
    for r in rows:
        t = next(t for t in by if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(by[t]) and r.doc_id in by[t] and r.keep_id == (None if None in by[t] else min(by[t]))
    kept = exactdup.drop_exact_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len(by)
    assert exactdup.exact_groups(nothing).count() == 0 and exactdup.drop_exact_duplicates(nothing).count() == 0


def test_exact_groups_hot_and_wide_paths(spark, monkeypatch):
    d = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.concat(F.lit("t"), F.col("id"))).alias("text"))
    monkeypatch.setattr(exactdup, "HOT_GROUP", 100)
    monkeypatch.setattr(exactdup, "sized", lambda df, limit=0: df)
    rows = exactdup.exact_groups(d).collect()
    assert len(rows) == 3000 and {(r.keep_id, r.group_size) for r in rows if r.doc_id % 3 == 0} == {(0, 1000)} and sum(r.kept for r in rows) == 2001


# -- 9
def test_ann_recall_and_awkward(spark):
    v = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = v.collect()
    i, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = collections.defaultdict(list)
    for r in ann.search(v, F.col("vec_id") % 5 == 0).collect():
        got[r.query_id].append(r)
    hit = 0
    for q in np.flatnonzero(i % 5 == 0):
        s = u @ u[q]
        s[q] = -9
        hit += len({r.vec_id for r in got[i[q]]} & set(i[np.argsort(-s)[:5]].tolist()))
        for r in got[i[q]]:
            assert abs(r.score - s[i == r.vec_id][0]) < 1e-12
        assert [r.rank for r in sorted(got[i[q]], key=lambda r: (-r.score, r.vec_id))] == [1, 2, 3, 4, 5]
    assert hit / 5 / (i % 5 == 0).sum() >= 0.9
    small = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0]), (7, [0.0, 1.0]), (8, [None, 1.0]), (0, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(ann.search(small, F.col("vec_id") % 50 == 0).collect())] == [(0, 1, 1), (0, 2, 2), (0, 3, 7)]
    assert ann.search(small.filter("vec_id = 3"), F.col("vec_id") % 50 == 0).count() == 0


def test_ann_every_length_and_repeated_ids(spark):
    pairs = [(0, [1.0, 0.0])] * 7 + [(i, [1.0, 0.0]) for i in range(1, 9)]
    threes = [(50, [1.0, 0.0, 0.0]), (51, [1.0, 1.0, 0.0])]
    got = ann.search(spark.createDataFrame(pairs + threes, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [(0, n, n) for n in range(1, 6)] + [(50, 1, 51)]


# -- 10
def bag(t):
    w = (t or "").split()
    return collections.Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def classes_by_force(texts):
    bags = [bag(t) for t in texts]
    owner = list(range(len(texts)))

    def find(a):
        while owner[a] != a:
            a = owner[a]
        return a

    for a in range(len(bags)):
        for b in range(a):
            both = sum((bags[a] & bags[b]).values())
            if 5 * both >= 4 * (sum(bags[a].values()) + sum(bags[b].values()) - both):
                owner[find(a)] = find(b)
    return [find(a) for a in range(len(bags))]


def test_near_classes_against_all_pairs(spark, docs, odd, nothing):
    rng = np.random.default_rng(4)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    words = [f"w{k}" for k in range(400)]
    for g in range(6):
        text = list(rng.choice(words, 120))
        for c in range(8):
            text = [w if rng.random() > 0.006 * c else "changed" for w in text]
            rows.append((10_000 + 10 * g + c, " ".join(text)))
    got = {r.doc_id: r for r in neardup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    force = classes_by_force([t for _, t in rows])
    groups = collections.defaultdict(list)
    for (i, _), c in zip(rows, force):
        groups[c].append(i)
    for ids in groups.values():
        assert {got[i].class_id for i in ids} == {min(ids)} and {got[i].class_size for i in ids} == {len(ids)}
    assert {i for i, r in got.items() if r.kept} == {min(x) for x in groups.values()}
    kept = neardup.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and kept.count() == len({tuple((r.text or "").split()) for r in odd.collect()})
    assert neardup.near_classes(nothing).count() == 0


def star(copies, words=240, changes=4, seed=5):
    """An original and copies at about 0.84 to it and about 0.72 to each other: each copy has its own changed words."""
    rng = np.random.default_rng(seed)
    text = [f"w{k}" for k in range(words)]
    out = [" ".join(text)]
    for c in range(copies):
        t = list(text)
        for k in rng.choice(np.arange(4, words - 4, 5), changes, replace=False):
            t[k] = f"c{c}_{k}"
        out.append(" ".join(t))
    return out


def test_near_classes_of_a_star(spark):
    texts = star(1200)
    rows = [(10 * i, t) for i, t in enumerate(texts)]
    sizes = collections.Counter(r.class_size for r in neardup.near_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert sizes == {len(texts): len(texts)}


def test_near_classes_meet_in_blocks(spark, monkeypatch):
    """No hub links: all that a band holds must be verified, within blocks and across them."""
    texts = star(60) + star(60, seed=6) + [" ".join(f"x{k}" for k in range(240))]
    monkeypatch.setattr(neardup, "SMALL", 1)
    monkeypatch.setattr(neardup, "BLOCK", 2000)
    verified = neardup._verified
    monkeypatch.setattr(neardup, "_verified", lambda pairs, bags: verified(pairs, bags).filter("false"))
    got = {r.doc_id: r.class_id for r in neardup.near_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    force = classes_by_force(texts)
    want = {i: min(j for j, c in enumerate(force) if c == force[i]) for i in range(len(texts))}
    assert got == want


def test_bag_min_hash_is_unbiased():
    rng = np.random.default_rng(2)
    shingles = rng.integers(1, 2**63, 60).astype(np.uint64)
    a, b = rng.integers(0, 9, 60), rng.integers(0, 9, 60)
    row = np.r_[np.zeros((a > 0).sum(), int), np.ones((b > 0).sum(), int)]
    s = neardup.bag_min_hash(row, np.r_[shingles[a > 0], shingles[b > 0]], np.r_[a[a > 0], b[b > 0]], 2, 4000)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.03


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 200)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[102] == 100 and 200 not in got


# -- shared parts and the pipeline
def test_word_hashes_and_keep_decided(spark):
    raw = np.frombuffer("ab  c\nab".encode() + b"ab", np.uint8)
    h, row = word_hashes(raw, np.array([0, 8, 8, 10]))
    assert row.tolist() == [0, 0, 0, 2] and h[0] == h[2] == h[3] != h[1]
    d = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "doc_id long, text string")
    say = d.select("doc_id", F.xxhash64("text").alias("row_key"), (F.col("text") == "b").alias("kept"))
    assert [tuple(r) for r in keep_decided(d, say).collect()] == [(1, "b")]


def test_pipeline(spark):
    import corpus_pipeline as c

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    d, last = spark.read.parquet(f"{SF}/documents.parquet"), None
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, d, SF)
        assert out.columns == d.columns and out.count() <= d.count()
        d, last = out, d
    left = d.collect()
    assert len({r.doc_id for r in left}) == len(left) and not any(base_spans(r.text) for r in left)
    packed = c.run(spark, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in left} and {r.doc_id for r in packed} <= set(docs)


def test_registered(spark):
    names = list(queries.queries())
    assert [n for n in names if n.startswith("op")] and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
