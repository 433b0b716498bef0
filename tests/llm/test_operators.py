"""Operators against brute force, exact round trips and held-out accuracy on small fixtures."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenlog.llm import components, embeddings, fingerprints, lines, minhash, mixing, packing, quality, suffix_tree, tokens
from lumenlog.llm.html import main_text
from lumenlog.llm.shingles import shingle_sets

RNG = random.Random(5)
VOCAB = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 7))) for _ in range(400)]


def prose(rng: random.Random, n: int) -> str:
    out = []
    while len(out) < n:
        k = rng.randint(4, 12)
        out += [w.capitalize() if i == 0 else w for i, w in enumerate(rng.choice(VOCAB) for _ in range(k))]
        out[-1] += "."
    return " ".join(out)


def edit(rng: random.Random, text: str, n: int) -> str:
    w = text.split(" ")
    for i in rng.sample(range(len(w)), n):
        w[i] = "x" + w[i]
    return " ".join(w)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    rows = [(i, prose(rng, rng.randint(3, 200))) for i in range(60)]
    for i in range(60, 110):
        base = rows[rng.randrange(12)][1]
        rows.append((i, edit(rng, base, min(len(base.split(" ")), rng.randint(0, 9)))))
    rows += [(110, rows[0][1]), (111, rows[0][1]), (112, ""), (113, None), (114, "one two"), (115, "One  two\n"), (116, " \t\n")]
    return rows


def classes(links, ids):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = classes(edges, {x for e in edges for x in e})
    assert all(got.get(i, i) == want[i] for i in want)


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_against_brute_force(spark, corpus, k):
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(corpus, "doc_id long, text string"), k, 80).collect()}
    sets = {}
    for i, t in corpus:
        w = (t or "").lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    ids = sorted(sets)
    links = [(a, b) for a in ids for b in ids if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = classes(links, ids)
    assert len(links) > 10
    assert {i: (got[i].n_shingles, got[i].component_id, got[i].kept) for i in ids} == {i: (len(sets[i]), want[i], want[i] == i) for i in ids}


def test_mixed_groups_beyond_one_tile(spark, monkeypatch):
    """Alike texts around the threshold, in tiles of four: the same components as brute force."""
    monkeypatch.setattr(minhash, "TILE", 4)
    rng = random.Random(8)
    base = prose(rng, 100)
    rows = [(i, edit(rng, base, rng.randint(0, 9))) for i in range(40)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4, 80).collect()}
    sets = dict(zip([i for i, _ in rows], shingle_sets([t for _, t in rows], 4), strict=True))
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(np.intersect1d(sets[a], sets[b])) >= 80 * len(np.union1d(sets[a], sets[b]))]
    assert got == classes(links, sets)


def test_shared_ids_are_one_node(spark):
    rng = random.Random(17)
    a, b, c, d = (prose(rng, 60) for _ in range(4))
    rows = [(0, a), (1, a), (1, b), (2, b), (3, c), (3, d), (4, d), (5, c), (None, a), (6, "")]
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).where("doc_id is not null").collect())
    assert got == [(0, 0, True), (1, 0, False), (1, 0, False), (2, 0, False), (3, 3, True), (3, 3, True), (4, 3, False), (5, 3, False), (6, 6, True)]


def test_segments_are_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(minhash, "SEGMENT_BYTES", 800)
    monkeypatch.setattr(minhash, "SEGMENT", 7)
    x, y = np.arange(20), np.arange(20, 40)
    parts = list(minhash._parts(x, y, np.full(40, 10)))
    assert sorted(np.concatenate([p for p, _ in parts]).tolist()) == list(range(20))
    assert all(len(p) <= 7 and (w <= 800 or len(p) == 1) for p, w in parts)


def test_pigeonhole_keys_meet_at_the_guaranteed_distance():
    rng = np.random.default_rng(2)
    import pyarrow as pa

    for _ in range(50):
        a = rng.integers(0, 1 << 16, 64).astype(np.uint16)
        b = a.copy()
        wrong = rng.choice(64, minhash.GUARANTEED, replace=False)
        b[wrong] ^= 1
        batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([1, 2]), pa.array([a.tobytes(), b.tobytes()])], ["rep", "c", "sig"])
        keys = {1: set(), 2: set()}
        for out in minhash._keys()([batch]):
            for k, r in zip(out.column("key").to_pylist(), out.column("rep").to_pylist(), strict=True):
                keys[r].add(k)
        assert keys[1] & keys[2]


def test_few_true_links_lie_beyond_the_filter():
    tail = sum(math.comb(64, k) * 0.2**k * 0.8 ** (64 - k) for k in range(minhash.FILTER + 1, 65))
    assert tail < 4e-7


@pytest.mark.parametrize("width", [1, 2, 8])
def test_vectors_against_brute_force(spark, width):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(6, 16))
    rows = [(i, [float(x) for x in np.float32(base[i % 6] + rng.normal(size=16) * rng.uniform(0, 0.4))], i % 3) for i in range(150)]
    rows += [(200, None, 1), (201, [0.0] * 16, 1), (202, [float("nan")] * 16, 1), (203, rows[0][1], None), (204, rows[0][1][:8], 0), (205, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embeddings.near_vectors(df, 0.93, tile=16, width=width).collect()}
    ok = [(i, np.array(v), label) for i, v, label in rows if label is not None and v is not None and np.isfinite(v).all() and np.any(v)]
    links = [(a, b) for a, x, p in ok for b, y, q in ok if a < b and p == q and len(x) == len(y) and x @ y / math.sqrt((x @ x) * (y @ y)) >= 0.93]
    root = classes(links, [r[0] for r in rows])
    n = {i: sum(i in e for e in links) for i in root}
    assert len(links) > 50 and got == {i: (n[i], root[i], root[i] == i) for i in root}


def test_quantisation_bound_is_rigorous():
    x = np.random.default_rng(1).normal(size=(300, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    q, s, e = embeddings.quantise(x)
    approx = (q.astype(float) @ q.T.astype(float)) * s[:, None] * s[None, :]
    assert (np.abs(x @ x.T - approx) <= e[None, :] + e[:, None] * (1 + e[None, :])).all()


ODD_TEXTS = ["Hello, WORLD's  end…", "", None, "a\x00b \x00 c", "Ünïcödé\tÇa\r\n東京 123 4.5", "é́ ́x don't", "<|endoftext|> <|StartOfText|>",
             "foo<|endoftext|>bar <|ENDOFTEXT|>", "  x y", "z" * 5000, "we'LL it's 'tis ''ve", "µg ß ªº x²y½ «quoted» naïve\xadsoft a\x85b \x1cq", "Å K ẞ Ÿ ſ İ", "a1b22c, d...e!?"]


@pytest.mark.parametrize("special", [True, False])
def test_tokens_equal_those_of_the_whole_text(special):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    t.encode_special_tokens = not special
    coder = tokens.WordTokenizer(special=special)
    for _ in range(2):  # the second time all words are known
        ids, bounds = coder.encode(ODD_TEXTS)
        for i, x in enumerate(ODD_TEXTS):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == [*t.encode(x or "", add_special_tokens=False).ids, 1]


def test_tokens_of_every_character_below_256():
    from tokenizers import Tokenizer

    t, coder = Tokenizer.from_file(tokens.vocabulary_path()), tokens.WordTokenizer()
    texts = [f"a{chr(i)}b {chr(i)} {chr(i)}{chr(i)}1" for i in range(256)]
    ids, bounds = coder.encode(texts)
    for i, x in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == [*t.encode(x, add_special_tokens=False).ids, 1]


def test_tokens_after_words_were_forgotten(monkeypatch):
    monkeypatch.setattr(tokens, "CACHED_WORDS", 50)
    rng, coder, fresh = random.Random(4), tokens.WordTokenizer(), tokens.WordTokenizer()
    for _ in range(20):
        text = prose(rng, 40)
        assert coder.encode([text])[0].tolist() == [x for w in text.split() for x in fresh.encode([w], None)[0].tolist()] + [1]


def test_query_pieces_have_the_ids_of_a_plain_call(spark, corpus):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    rows = corpus + [(1000 + i, x) for i, x in enumerate(ODD_TEXTS)]
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 1] for d, x in rows}
    seen: dict = {}
    for r in packing.pack_balanced(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect():
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        seen.setdefault(r.doc_id, []).append((r.start, r.length))
    assert {d: sum(n for _, n in p) for d, p in seen.items()} == {d: len(x) for d, x in ids.items()}


def test_number_of_sequences_hardly_depends_on_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    found = []
    for n in (1, 40):
        rows = packing.pack_balanced(docs.repartition(n)).groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
        assert all(r.n == r.end and r.n <= 2048 and r.n & (r.n - 1) == 0 for r in rows)
        found.append((sum(r.n for r in rows), sum(r.n == 2048 for r in rows), len(rows)))
    assert found[0][0] == found[1][0] and found[0][1] == found[1][1] and abs(found[0][2] - found[1][2]) <= 11


def test_balance_matches_a_plain_scan():
    sizes = np.random.default_rng(12).integers(1, 1500, 200)
    pieces = sorted(((d, 0, n) for d, n in enumerate(sizes.tolist())), key=lambda p: (-p[2], p[0]))
    full = int(sizes.sum()) // 2048
    cost, room, want, over = [0.0] * full, [2048] * full, [[] for _ in range(full)], []
    for p in pieces:
        fits = [s for s in range(full) if room[s] >= p[2]]
        if not fits:
            over.append(p)
            continue
        s = min(fits, key=lambda s: (cost[s], s))
        want[s].append(p)
        room[s] -= p[2]
        cost[s] += packing.LINEAR * p[2] + packing.QUADRATIC * p[2] ** 2
    got = packing.balance(sizes)
    whole = {(d, n) for d, _, n in pieces if (d, 0, n) not in over}
    assert [[p for p in s if (p[0], p[2]) in whole] for s in got[:full]] == want


@pytest.mark.parametrize("pack", [packing.balance, packing.best_fit])
def test_packing_is_lossless_and_fits(pack):
    rng = np.random.default_rng(9)
    for sizes in (rng.integers(1, 300, 500), rng.integers(1, 9000, 60), np.array([2048]), np.array([1]), np.array([5000]), np.zeros(0, int)):
        out = pack(sizes)
        assert all(sum(p[2] for p in s) <= 2048 for s in out)
        cover = sorted((d, a, n) for s in out for d, a, n in s)
        for d, n in enumerate(sizes.tolist()):
            at = 0
            for _, a, m in [c for c in cover if c[0] == d]:
                assert a == at
                at += m
            assert at == n
        if pack is packing.balance:
            short = [sum(p[2] for p in s) for s in out if sum(p[2] for p in s) != 2048]
            assert all(x & (x - 1) == 0 for x in short)


def test_best_fit_matches_a_plain_scan():
    sizes = np.random.default_rng(3).integers(1, 2048, 300)
    rooms: list[int] = []
    for n in sorted(sizes.tolist(), reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(2048 - n)
    assert sorted(2048 - sum(p[2] for p in s) for s in packing.best_fit(sizes)) == sorted(rooms)


def test_written_matrices_round_trip(spark, corpus, tmp_path):
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    packing.write_packed(packing.pack_best_fit(docs), str(tmp_path / "packed"))
    back = spark.read.parquet(str(tmp_path / "packed"))
    coder, texts = tokens.WordTokenizer(), dict(corpus)
    parts: dict = {}
    for r in back.collect():
        ids, pos = np.frombuffer(r.input_ids, "<u4"), np.frombuffer(r.position_ids, "<u4")
        assert len(ids) == 2048 and (ids[r.n_tokens :] == 0).all() and r.cu_seqlens[-1] == r.n_tokens
        for i, d in enumerate(r.doc_ids):
            a, b = r.cu_seqlens[i], r.cu_seqlens[i + 1]
            assert pos[a:b].tolist() == list(range(b - a))
            parts.setdefault(d, {})[r.doc_starts[i]] = ids[a:b].tolist()
    for d, t in texts.items():
        assert sum((parts[d][k] for k in sorted(parts[d])), []) == coder.encode([t])[0].tolist()
    digest = {(r.doc_id, r.start): (r.length, r.ids_crc32) for r in packing.packed_pieces(back).collect()}
    assert digest == {(d, s): (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, p in parts.items() for s, x in p.items()}


def test_fingerprints_against_plain_python(spark, corpus):
    got = {r.doc_id: r for r in fingerprints.fingerprint_edits(spark.createDataFrame(corpus, "doc_id long, text string"), buckets=5).collect()}
    rows = [(i, t or "") for i, t in sorted(corpus, reverse=True)]
    for j, (i, t) in enumerate(rows):
        following = rows[(j + 1) % len(rows)][1]
        new = fingerprints.edited(t, following)
        r, own = got[i], fingerprints.chunk_set(t)
        assert r.edited_sha256 == hashlib.sha256(new.encode()).hexdigest() and r.near_edited == pytest.approx(fingerprints.likeness(own, fingerprints.chunk_set(new)))
        assert r.n_chars == len(t) and fingerprints.parse(r.fingerprint) == own and fingerprints.parse(r.edited_fingerprint) == fingerprints.chunk_set(new)
        assert r.near_next == pytest.approx(fingerprints.likeness(own, fingerprints.chunk_set(following)))


def test_chunks_resist_shifts_and_gear_hash_is_local():
    rng = random.Random(1)
    text = prose(rng, 3000)
    a, b = fingerprints.chunk_set(text), fingerprints.chunk_set("A few words in front. " + text)
    assert fingerprints.likeness(a, b) > 0.95
    data = np.frombuffer(text.encode(), np.uint8)
    for i in (20, 500, 1234):
        want = sum(int(fingerprints.GEAR[data[i - k]]) << (2 * k) for k in range(16)) & 0xFFFFFFFF
        assert int(fingerprints.gear_hashes(data)[i]) == want
    ends = fingerprints.boundaries(data)
    sizes = np.diff(ends, prepend=0)
    assert sizes.max() <= fingerprints.MOST and ends[-1] == len(data)


PAGE = """<html><head><title>T</title><style>x{}</style></head><body><header>Site <b>name</b></header><nav><ul><li>Home<li>News</ul></nav>
<div class="cookie-notice">We use cookies and other things, please agree to all of them now.</div>
<main><article><h1>Title &amp; more</h1><p>First   paragraph with <b>bold text and some words that go on for a while.<p>Second&nbsp;one, it is
as long as the first and has a <a href=x>link</a> in it.<script>if (a < b) { "</p>" }</script><aside>Related</aside><ul><li>Point one<li>Point two</ul>
<section class="comments"><p>Great article, I agree with everything that was said in it.</p></section></article></main>
<form><p>Subscribe</p><input></form><div id="sidebar">Popular posts and more</div><footer>&copy; Me"""


def test_main_text_of_a_page():
    assert main_text(PAGE) == "Title & more First paragraph with bold text and some words that go on for a while. Second one, it is as long as the first and has a link in it. Point one Point two"
    assert main_text(None) == "" and main_text("") == "" and main_text("<p>") == ""
    plain = "<div><a href=a>a</a><a href=b>b</a></div>" + "<div>" + "many words in a row " * 20 + "</div>" * 1
    assert main_text(plain).startswith("many words") or "many words" in main_text(plain)


def test_main_text_outside_the_planned_form():
    long = "many words in a row " * 15
    body = f"<h1>A heading</h1><p>Short lead.</p><p>{long}</p><p>{long}</p><p>{long}</p><p>The end.</p>"
    whole = " ".join(["A heading", "Short lead.", *[long.strip()] * 3, "The end."])
    assert main_text(f"<body><div><a href=a>a</a> <a href=b>b</a></div><div>{body}</div></body>") == whole
    assert whole in main_text(f"<body><article><p>{'teaser text ' * 30}</p></article><div>{body}</div></body>")
    for name in ("page has-sidebar", "with-toolbar", "sidebar-layout"):
        assert main_text(f'<body><div class="{name}">{body}</div></body>') == whole
    assert main_text(f'<article><div class="entry-header"><h1>Title</h1></div><p>{long}</p><div class="comments-list"><p>Nice.</p></div></article>') == "Title " + long.strip()
    assert main_text(f'<body><div class="sidebar"><p>{long}</p></div><div><p>Text of it.</p></div></body>') == "Text of it."


def lines_of(text):
    import re

    return [x for x in re.split(r"(?<=[^\W_][.!?] )|(?<=[a-z] )(?=[A-Z])", text) if x]


def test_line_dedup_cuts_later_passages_alone(spark):
    rng = random.Random(21)
    passage = prose(rng, 60)
    rows = [(i, prose(rng, 80)) for i in range(30)]
    for i in (3, 9, 17, 25):
        w = rows[i][1].split(" ")
        rows[i] = (i, " ".join(w[:30]) + " " + passage + " " + " ".join(w[30:]))
    rows.append((40, rows[5][1]))
    rows.append((41, "Short line.\n" + prose(rng, 40)))
    rows.append((42, "Short line.\n" + prose(rng, 40)))
    rows.append((43, passage + "\n" + passage))
    got = {r.doc_id: r for r in lines.drop_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        if i in (9, 17, 25):
            assert passage not in got[i].text and got[i].lines_removed > 0 and len(got[i].text.split()) <= 90
        elif i == 40:
            assert got[i].text == ""
        elif i == 43:
            assert got[i].text.strip() == ""
        else:
            assert got[i].text == t and got[i].lines_removed == 0
    kept = " ".join(r.text for r in got.values())
    assert all(x in kept for x in lines_of(passage))  # the first copy of every line is left
    for i in (9, 17, 25):  # and what was around the passage
        w = [x for x in dict(rows)[i].replace(passage + " ", "").split(" ")]
        assert len(set(w) - set(got[i].text.split(" "))) <= 3


def test_passage_whose_lines_stand_alone_earlier_is_cut(spark):
    """Each fingerprint of the passage is met first in another text, alone or in a piece too short to count."""
    rng = random.Random(31)
    passage = lines_of(prose(rng, 60))
    text = lambda at, part: prose(random.Random(1000 + at), 40) + " " + "".join(part).strip() + " " + prose(random.Random(2000 + at), 40)
    rows = [(i, text(i, passage[i : i + 2])) for i in range(len(passage) - 1)]
    rows += [(50, text(50, passage)), (51, passage[3].strip() + " " + text(51, passage))]
    got = {r.doc_id: r for r in lines.drop_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].text == t for i, t in rows[:-1])
    assert got[51].text == passage[3].strip() + " " + text(51, []).replace("  ", " ")


def test_line_dedup_against_brute_force(spark):
    rng = random.Random(32)
    pool = [" ".join(rng.choice(VOCAB) for _ in range(rng.choice([1, 2, 5, 9, 14, 20, 31]))) for _ in range(25)]
    rows = [(i, [pool[(j + k) % 25] for j in rng.sample(range(25), 3) for k in range(rng.randint(1, 6))]) for i in range(60)]
    got = {r.doc_id: r for r in lines.drop_repeated_runs(spark.createDataFrame([(i, "\n".join(x)) for i, x in rows], "doc_id long, text string")).collect()}
    for at, (i, x) in enumerate(rows):
        cut = set()
        for other in range(at + 1):
            y = rows[other][1]
            for d in range(-len(x), len(y)) if other < at else range(-len(x), 0):
                a = 0
                for b in range(len(x) + 1):
                    if b == len(x) or not 0 <= b + d < len(y) or x[b] != y[b + d]:
                        if sum(len(z.split()) for z in x[a:b]) >= lines.MIN_RUN_WORDS:
                            cut |= set(range(a, b))
                        a = b + 1
        assert got[i].lines_removed == len(cut)
        assert got[i].text.split() == " ".join(z for j, z in enumerate(x) if j not in cut).split()


def test_paragraphs_parted_by_blank_lines_are_cut(spark):
    """Many passages of four short paragraphs: none may hang on which hashes are the smaller ones."""
    rng = random.Random(33)
    passages = ["\n\n".join(" ".join(rng.choice(VOCAB) for _ in range(13)) for _ in range(4)) for _ in range(300)]
    rows = [(i + 1000 * k, f"{k} head {i}\n\n{x}\n\n{k} tail {i}") for i, x in enumerate(passages) for k in range(2)]
    got = {r.doc_id: r.text for r in lines.drop_repeated_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == t if i < 1000 else got[i] == f"1 head {i - 1000}\n\n1 tail {i - 1000}" for i, t in rows)


def test_ordinal_fit_recovers_order_and_held_out_accuracy(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(600):
        words = prose(rng, 60).split(" ")
        kind = rng.random()
        if kind < 0.15:
            words[rng.randrange(60)] = "scoundrel"
        elif kind < 0.3:
            words = [w.upper() + "!!" for w in words]
        rows.append((i, " ".join(words)))
        if i < 400:
            labels.append((i, 0 if 0.15 <= kind < 0.3 else 1, int(kind < 0.15)))
        rows[-1] = (*rows[-1],)
        rng.random()
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.train(docs, lab)
    assert (np.diff(model.thresholds) > 0).all()
    for r in quality.grade_documents(docs, model).where("doc_id >= 400").collect():
        bad = "scoundrel" in r.text.lower() or "!!" in r.text
        assert r.accepted != bad and 0 <= r.expected_grade <= 2


def test_no_labels_keep_everything(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert all(r.accepted for r in quality.grade_documents(docs, model).collect())


LINKS = "<div>" + "".join(f'<span><a href="/{i}">Topic {i}</a></span>' for i in range(9)) + "</div>"
LONG = "A sentence of the article that goes on with many words and says what there is to say. "


def test_ratios_choose_the_content_where_no_name_tells():
    """Menus and teasers in plain div elements: the clusters of the ratios alone part them from the article."""
    body = f"<div><p>{LONG * 3}</p><p>{LONG * 2}</p></div>"
    for page in (f"<body>{LINKS}{body}{LINKS}</body>", f"<body><div>{LINKS}</div><div>{LINKS}{body}</div></body>"):
        assert main_text(page) == " ".join([(LONG * 3).strip(), (LONG * 2).strip()])


def test_smoothing_keeps_short_blocks_beside_long_ones():
    page = f"<body>{LINKS}<div>{LONG * 4}</div><div>Short end.</div>{LINKS}</body>"
    assert main_text(page).endswith("say. Short end.") and not main_text(page, sigma=0.01).endswith("Short end.")


def test_region_of_the_content_is_taken_whole_without_article():
    page = f'<body><div class="layout has-sidebar"><div class="entry-header"><h1>Title</h1></div><div><p>{LONG * 3}</p><h2>Part</h2><p>Brief.</p><p>{LONG}</p><p class="reply-to-critics">{LONG}</p></div><div class="sidebar"><p>{LONG}</p></div></div></body>'
    assert main_text(page) == f"Title {(LONG * 3).strip()} Part Brief. {LONG.strip()} {LONG.strip()}"


def test_two_clusters():
    from lumenlog.llm.html import two_clusters

    assert 1.2 < two_clusters([1, 1.1, 1.2, 5, 5.5, 6]) < 5 and two_clusters([5, 5.2]) == 5


def plain_tree(streams, total, depth, least, alphabet):
    """The tree in dictionaries: context -> (retained, parent, p of its pairs, weight of the shorter context)."""
    counts: dict = {}
    for s in streams:
        for i in range(1, len(s)):
            for d in range(min(depth, i) + 1):
                counts.setdefault(tuple(s[i - d : i]), {}).setdefault(s[i], 0)
                counts[tuple(s[i - d : i])][s[i]] += 1
    often = {c: x for c, x in counts.items() if not c or sum(x.values()) >= least}
    kept, model = set(), {}
    for c in sorted(often, key=len):
        n = sum(often[c].values())
        pairs = {y: k for y, k in often[c].items() if k >= least / suffix_tree.PAIR_SHARE}
        mass = len(often[c]) + n - sum(pairs.values())
        up = model[c[1:]][0] if c else None
        p = {y: (k + mass * (up[y] if c else 1 / alphabet)) / (n + len(often[c])) for y, k in pairs.items()}
        model[c] = (p, mass / (n + len(often[c])))
        if c:
            above = sum(often[c[1:]].values())
            before = {y: math.log(often[c[1:]][y] / above) for y in pairs}
            if sum(k * (math.log(k / n) - before[y]) + min(before[y], 0) for y, k in pairs.items()) >= suffix_tree.DIVERGENCE:
                kept |= {c[i:] for i in range(len(c))}
    return {c: model[c] for c in model if not c or c in kept}


def plain_score(model, s, i, depth, alphabet):
    c = max((tuple(s[i - d : i]) for d in range(min(depth, i) + 1) if all(tuple(s[i - e : i]) in model for e in range(d + 1))), key=len)
    lost = 0.0
    while True:
        p, escape = model[c]
        if s[i] in p:
            return lost + math.log10(p[s[i]])
        lost += math.log10(escape)
        if not c:
            return lost - math.log10(alphabet)
        c = c[1:]


def test_suffix_tree_distributions_sum_to_one():
    rng = random.Random(0)
    streams = [[2, *(rng.randint(3, 8) for _ in range(100)), 1] for _ in range(40)]
    for s in streams:
        for i in range(2, 101):
            if s[i - 1] == 3:
                s[i] = 5
    model = plain_tree(streams, 4040, 3, 15, 8)
    assert len(model) > 1
    for c in model:
        assert sum(10 ** plain_score(model, [*c, y], len(c), len(c), 8) for y in (0, 1, *range(3, 9))) == pytest.approx(1)


@pytest.mark.parametrize("parts", [1, 25])
def test_scores_against_plain_python(spark, parts):
    rng, least, depth = random.Random(6), 12, 3
    common = prose(rng, 30)
    rows = [(i, common + " " + prose(rng, 5) if i % 3 == 0 else " ".join(rng.choice(VOCAB[:40]) for _ in range(30)), i % 10 == 0) for i in range(150)]
    got = {r.doc_id: r.score for r in suffix_tree.score_texts(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(parts), depth, least).collect()}
    words: dict = {}
    train = [t.lower().split() for _, t, h in rows if not h]
    for t in train:
        for w in t:
            words[w] = words.get(w, 0) + 1
    total, ends = sum(words.values()) + len(train), len(train)
    often = sorted(w for w, c in words.items() if c >= least)
    symbol = {w: i + 3 for i, w in enumerate(often)}
    coded = lambda t: [2, *(symbol.get(w, 0) for w in t), 1]
    model = plain_tree([coded(t) for t in train], total, depth, least, len(often) + 2)
    assert any(len(c) > 1 for c in model)
    once, twice = (sum(c == k for c in words.values()) for k in (1, 2))
    discount = once / (once + 2 * twice)
    share = 1 - sum(words[w] for w in often) / total - ends / total + discount * len(often) / total
    for i, t, _ in rows:
        t = t.lower().split()
        s, want = coded(t), 0.0
        for j in range(1, len(s)):
            want += plain_score(model, s, j, depth, len(often) + 2)
            if s[j] == 0:
                c = words.get(t[j - 1], 0)
                want += math.log10((c - discount if c else discount * len(words)) / total) - math.log10(share)
        assert got[i] == pytest.approx(want)


def test_scores_without_training_texts(spark):
    rows = [(1, "a b c", True), (2, None, True)]
    got = {r.doc_id: r for r in suffix_tree.score_texts(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")).collect()}
    assert got[1].n_tokens == 4 and got[1].n_known == 0 and got[1].train_tokens == 0 and got[1].score < 0
    assert got[2].n_tokens == 1 and math.isfinite(got[2].score)


def test_gathered_contexts_do_not_depend_on_partitions(spark, sf, monkeypatch):
    seen = []
    whole = suffix_tree.SuffixTree.__init__

    def spy(self, depth, context, *rest, **named):
        seen.append((len(context), len(rest[3])))
        whole(self, depth, context, *rest, **named)

    monkeypatch.setattr(suffix_tree.SuffixTree, "__init__", spy)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", F.lit(False).alias("held_out"))
    n = [r.train_tokens for parts in (1, 50) for r in [suffix_tree.score_texts(docs.repartition(parts)).first()]][0]
    assert seen[0] == seen[1] and seen[0][0] <= 1 + 4 * max(20_000, 2 * math.sqrt(n))


def test_default_model_on_held_out_texts(spark, sf):
    """Log10 per token of the default model: a coarser tree (a higher least count) doesn't reach this."""
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    docs = docs.select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0).alias("held_out"))
    got = suffix_tree.score_texts(docs).groupBy("held_out").agg((F.sum("score") / F.sum("n_tokens")).alias("each"), F.avg((F.col("score") > F.col("base_score")).cast("int")).alias("better")).collect()
    held = next(r for r in got if r.held_out)
    assert held.each >= -3.37 and held.better > 0.9


def test_scoring_base_by_hand_and_beats_it(spark):
    rng = random.Random(2)
    common = prose(rng, 40)
    rows = [(i, common if i % 3 == 0 else prose(rng, 50), i % 10 == 0) for i in range(200)] + [(900, None, True), (901, "unseenword", True)]
    got = {r.doc_id: r for r in suffix_tree.score_texts(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean"), least=9).collect()}
    counts: dict = {}
    for _, t, h in rows:
        if not h:
            for w in [*(t or "").lower().split(), None]:
                counts[w] = counts.get(w, 0) + 1
    total, v = sum(counts.values()), len(counts)
    for i, t, h in rows:
        toks = [*(t or "").lower().split(), None]
        base = sum(math.log10((counts.get(w, 0) + 0.1) / (total + 0.1 * (v + 1))) for w in toks)
        r = got[i]
        assert r.base_score == pytest.approx(base) and r.n_tokens == len(toks) and r.n_known == sum(w in counts for w in toks) and r.train_tokens == total and r.held_out == h
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert all(r.score <= 1e-9 for r in got.values())


def test_takings_come_near_their_targets(spark, sf):
    docs = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    got = mixing.mix_plan(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("longest"), F.max("source_size").alias("size")).collect()
    assert len(got) > 10 and all(abs(r.taken - r.target) <= 0.02 * r.target for r in got)


def test_mixing_targets_and_copies(spark):
    rows = [(i, "w " * (i % 7 + 1), None if i % 11 == 0 else f"s{i % 5}" if i % 5 else "tiny" if i == 5 else "big") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix_plan(df).collect()
    sources = {r.source: (r.source_size, r.target) for r in plan}
    assert sum(t for _, t in sources.values()) == pytest.approx(sum(s for s, _ in sources.values()))
    assert all(t <= 3 * s + 1e-9 for s, t in sources.values()) and sources["tiny"][1] == pytest.approx(3 * sources["tiny"][0])
    assert all(r.taken <= 3 * r.size and r.taken == r.copies * r.size for r in plan)
    names = sorted((n for n in sources if n is not None), key=lambda n: n.encode()) + [None]
    level = [sources[n][1] / (i % 3 + 1) for i, n in enumerate(names) if sources[n][1] < 3 * sources[n][0] - 1e-6]
    assert max(level) == pytest.approx(min(level))
    again = {r.doc_id: r.copies for r in mixing.mix_plan(df).collect()}
    assert again == {r.doc_id: r.copies for r in plan}
    assert mixing.mix(df).count() == sum(again.values())
    assert mixing.mix(df).columns == df.columns
