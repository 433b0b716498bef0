"""Whitening, prefix trie and personal data against plain versions, and their defined results on edge cases."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlog.llm import packing, pii, trie, whitening
from lumenlog.llm.html import main_text

# Whitening ------------------------------------------------------------------------------------------------------------


def plain_whitening(vectors, k=4):
    x = np.floor(256 * np.array(vectors, float))
    u = np.unique(x, axis=0)
    n, s = len(u), u.sum(axis=0)
    v = np.cov(u.T, bias=True)
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return n, (x - s / n) @ q / np.sqrt(e), e / np.trace(v), [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]


def same_up_to_sign(a, b, tolerance=1e-9):
    a, b = np.array(a), np.array(b)
    sign = np.sign((a * b).sum(axis=0))
    return np.abs(a * sign - b).max() <= tolerance


@pytest.mark.parametrize("dim,rows", [(3, 40), (24, 200), (40, 500)])
def test_whitening_against_eigh(spark, dim, rows):
    rng = np.random.default_rng(dim)
    x = (rng.standard_normal((rows, dim)) * np.linspace(1, 2, dim)).round(3)
    x[rows // 2 :: 7] = x[0]  # repeated vectors are fitted once
    df = spark.createDataFrame([(i, [float(c) for c in v], i) for i, v in enumerate(x)], "vec_id long, embedding array<double>, n int")
    out, fits = whitening.whiten(df.repartition(5))
    got = {r.vec_id: r for r in out.collect()}
    n, want, share, far = plain_whitening(x)
    assert fits[dim].n == n and fits[dim].identity_error < 1e-9 and np.allclose(fits[dim].explained, share, rtol=1e-10)
    assert [got[i].deviation for i in range(rows)] == far and {r.n for r in got.values()} == {n}
    assert same_up_to_sign([got[i].whitened for i in range(rows)], want)


def test_filter_finds_what_the_first_subspace_missed():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((60, 60)))[0]
    e = np.concatenate([[1e6, 1e3, 999.5, 999.0], np.linspace(998, 1, 56)])
    v = (q * e) @ q.T
    passes = []
    values, vectors = whitening.leading(lambda y: passes.append(y.shape[1]) or v @ y, 60, 4)
    assert np.allclose(values, e[:4], rtol=1e-12) and max(passes) <= 60
    assert np.abs(np.abs((vectors * q[:, :4]).sum(axis=0)) - 1).max() < 1e-12


def test_whitening_edges(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.1, 0.2]), (1, [0.1, 0.2]), (None, [0.3, -0.0]), (2, None), (3, [None, 0.1]), (4, [nan, 0.1]), (5, [0.0, -inf]), (6, []), (7, [0.5, 1.0]), (8, [1.0, 2.0, 3.0]), (9, [1.0, 2.0, 3.0]), (10, [1e300, -1e300, 0.0, 1.0]), (11, [0.0, 0.0, 0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("dim", F.lit("x"))
    out, fits = whitening.whiten(df)
    got = out.collect()
    assert sorted(str(r.vec_id) for r in got) == sorted(map(str, [1, 1, None, 7, 8, 9, 10, 11]))
    assert {r.vec_id: len(r.whitened) for r in got if r.vec_id not in (None, 1)} == {7: 2, 8: 0, 9: 0, 10: 1, 11: 1}  # no variance: no component
    assert [r.deviation for r in got if r.vec_id == 8] == [0] and [r.deviation for r in got if r.vec_id == 10] == [None]
    assert fits[2].n == 3 and fits[3].n == 1
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 0.0]) for i in range(9)], "vec_id long, embedding array<float>")
    assert {len(r.whitened) for r in whitening.whiten(line)[0].collect()} == {1}
    none, fits = whitening.whiten(df.limit(0))
    assert none.count() == 0 and fits == {}


# Prefix trie ----------------------------------------------------------------------------------------------------------


def plain_trie(rows, modulus=None, spread=6):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            turns[c].append(((t is not None, t or 0), hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in turns.items()}
    paths = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % spread if modulus else 0
        paths[c] = own.get(int(c / modulus) * modulus, [])[:h] + v[h:] if modulus else v
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, p in sorted(paths.items()):
        for d in range(len(p) + 1):
            members[tuple(p[:d])].append(c)
            if d:
                kids[tuple(p[: d - 1])].add(tuple(p[:d]))
        ends[tuple(p)].append(c)
    out = {}

    def walk(k):
        leaves, saved = 0, (len(members[k]) - 1) * (len(k[-1][1]) if k else 0)
        for x in kids[k]:
            a, b = walk(x)
            leaves, saved = leaves + a, saved + b
        leaves = leaves or 1
        ids = ",".join(map(str, sorted(ends[k])))
        out[k] = (members[k][0], len(k), members[k[:-1]][0] if k else None, len(members[k]), len(kids[k]), leaves, saved, hashlib.sha256(ids.encode()).hexdigest())
        return leaves, saved

    if paths:
        import sys

        sys.setrecursionlimit(20_000)
        walk(())
    return sorted(out.values(), key=str)


def nodes(spark, rows, **more):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("d", F.lit("x")).withColumn("k1", F.lit(1))
    return sorted((tuple(r) for r in trie.prefix_trie(df.repartition(3), **more).collect()), key=str)


def talk(rng, n):
    return [(rng.choice(["user", "assistant", None, ""]), rng.choice([None, "", "a", "ab", "é", "longer text"])) for _ in range(n)]


@pytest.mark.parametrize("modulus", [None, 100, 7])
def test_trie_against_plain_version(spark, modulus):
    rng = random.Random(modulus)
    rows = []
    for c in [*range(0, 40), *range(100, 130), -3, 10**12]:
        talked = talk(rng, rng.choice([1, 1, 2, 3, 6, 9]))
        if c % 3 == 0:
            talked = [("user", "hello")] * 2 + talked[:3]
        rows += [(c, rng.choice([None, i, i, i]), r, t) for i, (r, t) in enumerate(talked)]
    rows += [(None, 1, "user", "x"), rows[0], rows[0]]
    assert nodes(spark, rows, modulus=modulus) == plain_trie(rows, modulus)


def test_trie_of_long_conversations_and_many_copies(spark):
    long = [("user", str(i % 11)) for i in range(2500)]
    rows = [(c, i, r, t) for c in (5, 6) for i, (r, t) in enumerate(long)] + [(7, i, r, t) for i, (r, t) in enumerate(long[:1500] + [("x", "y")] * 900)]
    rows += [(c, 0, "user", "same") for c in range(1000, 2500)]  # ids of one node, more than one text to hash
    assert nodes(spark, rows) == plain_trie(rows)


def test_trie_does_not_hang_on_the_sketch(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(c, i, r, t) for c in range(300) for i, (r, t) in enumerate(talk(rng, 8))]
    want = plain_trie(rows)
    assert nodes(spark, rows) == want
    monkeypatch.setattr(trie, "SLOT_BITS", (12, 12))  # crowded: most singletons look shared
    assert nodes(spark, rows) == want


def test_screen_is_one_sided(spark):
    rows = spark.range(3000).selectExpr("id as conv_id", "1L as d", "xxhash64(id % 2500) as k1", "xxhash64(id % 2500, 1) as k2", "0L as p1", "0L as p2", "1L as t", "0L as c0", "1L as n_chars").repartition(4)
    bits, counted = trie.sketch(rows, 3000)
    sent = spark.sparkContext.broadcast(counted)
    shared = rows.mapInArrow(trie._screen(bits, sent, True), "conv_id long, d long, t long, k1 long, k2 long, c0 long, n_chars long")
    alone = rows.mapInArrow(trie._screen(bits, sent, False), "conv_id long, d long, t long, c0 long, head boolean")
    assert {r.conv_id for r in shared.collect()} >= {*range(500), *range(2500, 3000)}
    assert alone.count() > 1500 and shared.count() + alone.count() == 3000


def test_trie_edges(spark):
    assert nodes(spark, [(None, 1, "a", "b")]) == []
    assert nodes(spark, [(4, None, None, None)]) == plain_trie([(4, None, None, None)])
    h = zlib.crc32(b"101") % 6
    rows = [(101, i, "u", "t") for i in range(h)]  # its base is absent and all its turns go
    assert h > 0 and nodes(spark, rows, modulus=100) == plain_trie(rows, 100) and len(plain_trie(rows, 100)) == 1


# Personal data --------------------------------------------------------------------------------------------------------

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            good = {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else 0, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}
            if good[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def found(spark, texts, model=None):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    cols = [pii.listed(c).alias(c) for c in ("base", "spans")]
    return {r.doc_id: (r.base.split(",") if r.base else [], r.spans.split(",") if r.spans else []) for r in pii.find_personal_data(df, model).select("row.doc_id", *cols).collect()}


def card(rng, n=16):
    head = "".join(rng.choice("0123456789") for _ in range(n - 1))
    return next(head + d for d in "0123456789" if luhn(head + d))


def personal(rng):
    phone = f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
    ip = ".".join(str(rng.randrange(256)) for _ in range(4))
    return rng.choice([phone, ip, card(rng), f"{rng.choice('abc')}x.{rng.randrange(99)}@mail{rng.randrange(9)}.example.com"])


def junk(rng):
    digits = "".join(rng.choice("0123456789") for _ in range(rng.randrange(2, 24)))
    return rng.choice([digits, f"{rng.randrange(256, 999)}.1.2.3", "x" + digits + "a", f"@handle{digits}", "a@b", f"+{digits[:5]}", f"v{rng.randrange(9)}.{rng.randrange(9)}", "2024-01-15"])


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(8)
    words = "the of and to in that is for it as with on".split()
    texts = [" ".join(w for _ in range(12) for w in (*rng.choices(words, k=4), personal(rng) if rng.random() < 0.4 else junk(rng))) for _ in range(300)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return pii.train(pii.candidates(df))


def test_base_spans_against_plain_search(spark):
    rng = random.Random(2)
    parts = ["a@b.c", "@", ".", "1", "22", "333", "4.5.6.7", " ", "-", "+", "(", ")", "é", "😀", "x_", "%+", "\n", card(rng), card(rng, 19), "+1 234 567 89", "255.256.1.1", "00255.1.1.1", "_d@e.f", "..", "@@"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(1, 40))) for _ in range(400)]
    got = found(spark, texts)
    assert sum(map(bool, (plain_spans(t) for t in texts))) > 200
    assert [got[i][0] for i in range(len(texts))] == [plain_spans(t) for t in texts]
    assert all(set(b) <= set(s) for b, s in got.values())


def test_added_spans(spark, model):
    good = ["call (310) 555-4510 now", f"card {'.'.join(re.findall('....', card(random.Random(3))))} it", "x (310) 555-4510 of +1 (310) 555-4511"]
    clean = ["order 4111111111111112 of 2024-01-15 10:20:30", "pages 100-200 and 1999-2000, version 10.2.3", "300.400.1.2 is no address", "look at the dot and 12 345 678", "@handle and a@b", "token = \"2321bac4d15ec8f90433955bf9d3cf61da5bdd1e\""]
    got = found(spark, good + clean, model)
    assert got[0][1] == ["phone:5:19"] and any(s.startswith("card:5:24") for s in got[1][1])
    assert set(got[2][0]) < set(got[2][1])
    assert all(got[i][1] == got[i][0] == [] for i in range(len(good), len(good) + len(clean)))


def test_model_is_held_out_precise(model):
    rows = [((2, 6, 1, 0, 1, 0, 0, 0, 1), 1.0, 0.0), ((2, 1, 1, 0, 0, 0, 0, 0, 1), 0.0, 1.0)]
    assert model.logit(rows[0][0]) > model.thresholds[2] > model.logit(rows[1][0])
    assert pii.boost([((0,) * 9, 0.0, 5.0)], []) is None  # nothing counts: no model
    assert pii.boost([((0,) * 9, 5.0, 0.0)], []).thresholds == (1e9,) * 4  # nothing held out: nothing is added


def test_long_texts_and_many_spans(spark):
    many = "1.2.3.4 a@b.c +1 234 567 890 x\n" * 3000
    texts = [many, "a" * 200_000 + "@", "9" * 200_000, "a@b" + ".c" * 50_000, "1 " * 50_000]  # a plain search takes the square of the second and third
    got = found(spark, texts)
    assert [got[i][0] for i in range(5)] == [plain_spans(many), [], [], ["email:0:100003"], []]


def test_redaction_and_edges(spark, model):
    rows = [(1, "é a@b.cc, call (310) 555-4510!", "x"), (1, "é a@b.cc, call (310) 555-4510!", "x"), (None, None, None), (2, "", "y"), (3, "clean", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, base string").withColumns({"t": F.lit(1), "row": F.lit(2), "email": F.lit(3), "spans": F.lit(4)})
    out = pii.redact(df, model)
    assert out.columns == df.columns
    assert sorted(str(r.text) for r in out.collect()) == sorted(["é [email], call [phone]!"] * 2 + ["None", "", "clean"])
    assert pii.redact(df.limit(0)).count() == 0 and pii.train(pii.candidates(df.limit(0))) is None


def test_tails_of_shards_are_packed_together(spark):
    rng = np.random.default_rng(11)
    rows = [(i, " ".join(f"w{x}" for x in rng.integers(0, 500, rng.integers(5, 900)))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    counts, ids = [], []
    for parts in (1, 25):
        out = packing.pack_best_fit(docs.repartition(parts, "doc_id"))
        counts.append(out.count())
        pieces = packing.packed_pieces(out).collect()
        ids.append(sum(r.length for r in pieces))
        whole = {r.doc_id: r.doc_tokens for r in pieces}
        assert len(whole) == 600 and sum(whole.values()) == ids[-1]
    assert ids[0] == ids[1] and counts[1] <= counts[0] * 1.01 + 1


def test_the_fullest_sequences_are_kept_within_the_slack():
    keep = packing.kept_sequences(np.array([100, 40, 99, 100, 98, 90]), 100)
    assert keep.tolist() == [True, False, True, True, True, False]
    assert packing.kept_sequences(np.zeros(0, np.int64), 100).tolist() == []


# Main text ------------------------------------------------------------------------------------------------------------

PARAGRAPH = "long words of the text go on and on. " * 20


@pytest.mark.parametrize("name", "notice-of-motion social-history advert-free menu-planning comment-on-law share-prices widget-theory".split())
def test_a_topic_in_a_name_does_not_drop_text(name):
    part = f'<div class="{name}"><p>{PARAGRAPH} own words</p></div>'
    page = f"<body><nav><a href=x>a</a></nav><article><h1>T</h1><p>{PARAGRAPH}</p>{part}<p>{PARAGRAPH}</p></article><footer>f</footer></body>"
    assert "own words" in main_text(page)


def test_ratios_decide_inside_the_article():
    links = "".join(f"<li><a href=/{i}>{i} more</a></li>" for i in range(5))
    body = f"<article><h1>T</h1><p>{PARAGRAPH}</p><p>Short.</p><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p><ul>{links}</ul><p>{PARAGRAPH}</p></article>"
    whole = " ".join(["T", PARAGRAPH.strip(), "Short.", *[PARAGRAPH.strip()] * 3])
    assert main_text(f"<body>{body}</body>") == whole


def test_names_of_parts_of_the_page_drop_text():
    for name in ("comments-list", "related-posts", "ad slot-2", "sidebar_right"):
        page = f'<body><article><h1>T</h1><p>{PARAGRAPH}</p><p>{PARAGRAPH}</p><div class="{name}"><p>{PARAGRAPH}not this</p></div></article></body>'
        assert "not this" not in main_text(page)


def test_nesting_and_stray_ends_take_linear_time():
    start = time.perf_counter()
    deep = main_text("<div>" * 30_000 + "<p>words of a text</p>" * 30_000)
    assert deep.startswith("words of a text") and main_text("<div>" * 20_000 + "some text" + "</b>" * 20_000) == "some text"
    assert time.perf_counter() - start < 20
