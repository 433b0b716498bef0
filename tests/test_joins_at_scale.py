"""Interval, edit-distance and grouping operators against plain loops."""

import itertools
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lumenlog.operators import graph as G
from lumenlog.operators import intervals as I
from lumenlog.operators import joins as J

T0 = datetime(2024, 1, 1)


def spans(rng, n, ids):
    out = []
    for i in range(n):
        start = T0 + timedelta(seconds=rng.randrange(90 * 86400))
        out.append((rng.choice([1, 1, 2, None]), ids + i, start, rng.choice([start, None, *[start + timedelta(seconds=rng.choice([1, 5, 3600, 86400, 40 * 86400]))] * 6])))
    return out


SPANS = "user_id long, id long, start_ts timestamp, end_ts timestamp"


def test_overlaps_of_intervals_of_any_length(spark):
    rng = random.Random(1)
    a, b = spans(rng, 120, 0), spans(rng, 120, 1000)
    got = sorted((r.a_id, r.b_id) for r in I.overlap_join(spark.createDataFrame(a, SPANS), spark.createDataFrame(b, SPANS), "user_id").collect())
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] is not None and x[0] == y[0] and x[3] and y[3] and x[2] < x[3] and y[2] < y[3] and x[2] < y[3] and y[2] < x[3])
    assert got == want and len(want) > 500
    assert I.overlap_join(spark.createDataFrame([], SPANS), spark.createDataFrame(b, SPANS), "user_id").count() == 0
    month = spark.createDataFrame([(1, 1, T0, T0 + timedelta(days=30))], SPANS)
    rows = I._homed(month, "start_ts", "end_ts").select(F.explode(I._nodes(F.col("home")))).count()
    assert rows <= 2


def test_points_in_intervals_of_any_length(spark):
    rng = random.Random(2)
    held = [s for s in spans(rng, 80, 0) if s[3]]
    points = [(rng.choice([1, 2, 3, None]), T0 + timedelta(seconds=rng.randrange(90 * 86400)), i % 50) for i in range(200)]
    points += points[:3]
    p = spark.createDataFrame(points, "user_id long, ts timestamp, n int")
    s = spark.createDataFrame(held, SPANS).withColumnRenamed("id", "span_id")
    got = sorted(((r.user_id, r.ts, r.n, r.span_id) for r in I.points_in_intervals(p, s, "user_id").collect()), key=str)
    want = []
    for u, ts, n in points:
        met = [x[1] for x in held if u is not None and x[0] == u and x[2] <= ts < x[3]]
        want += [(u, ts, n, x) for x in met or [None]]
    assert got == sorted(want, key=str) and any(x[3] is None for x in want) and len(want) > len(points)
    assert I.points_in_intervals(p, s.limit(0), "user_id").where("span_id is null").count() == len(points)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("k", [1, 2, 3])
def test_names_within_edits(spark, k):
    rng = random.Random(k)
    base = ["".join(rng.choice("abcé ") for _ in range(rng.randrange(1, 12))) for _ in range(25)]
    names = {(t, n) for t in "xy" for n in base}
    for t, n in list(names):
        for _ in range(rng.randrange(k + 2)):
            i = rng.randrange(len(n) + 1)
            n = n[:i] + rng.choice(["", "a", "Q"]) + n[i + rng.randrange(2) :]
        names.add((t, n))
    rows = [*names, ("x", None), (None, "a")]
    got = {(r.entity_type, r.name_a, r.name_b): r.distance for r in J.levenshtein_pairs(spark.createDataFrame(rows, "entity_type string, name string"), k).collect()}
    low = {(t, n.lower()) for t, n in names if n}
    want = {(t, *sorted((a, b))): edits(a, b) for (t, a), (u, b) in itertools.combinations(sorted(low), 2) if t == u and edits(a, b) <= k}
    assert got == want and len(want) >= 10


def alike(a, b):
    a, b = a.lower(), b.lower()
    if a == b:
        return 1.0
    if a in b or b in a:
        return 0.9
    x, y = set(a) - {" "}, set(b) - {" "}
    return len(x & y) / len(x | y) if x | y else 0.0


def test_greedy_groups_against_a_loop(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcde") for _ in range(rng.randrange(2, 5))) for _ in range(20)]
    rows = [(i, rng.choice("xy"), rng.choice(words) + rng.choice(["", "f", "g"]), [rng.choice(words)] if rng.random() < 0.2 else None) for i in range(60)]
    rows += [(100, "z", "abcd", None), (101, "z", "abcde", None), (102, "z", "bcdef", None), (103, "z", "cdefg", None)]  # a chain
    got = {r.entity_id: r.group_id for r in J.greedy_groups(spark.createDataFrame(rows, "entity_id long, entity_type string, canonical_name string, aliases array<string>"), 0.6).collect()}
    want, taken = {}, set()
    ordered = sorted(rows, key=lambda r: (r[2], r[0]))
    for i, e in enumerate(ordered):
        if e[0] in taken:
            continue
        like = [f for f in ordered[i + 1 :] if f[0] not in taken and f[1] == e[1] and any(alike(a, b) >= 0.6 for a in [e[2], *(e[3] or [])] for b in [f[2], *(f[3] or [])])]
        for f in like:
            want[f[0]] = e[0]
            taken.add(f[0])
        if like:
            want[e[0]] = e[0]
    assert got == want and len(set(want.values())) > 5


@pytest.mark.parametrize("support", [1, 2, 5])
def test_cooccurrence_with_support(spark, support):
    rng = random.Random(3)
    links = {(n, rng.choice([rng.randrange(8), rng.randrange(200)])) for n in range(60) for _ in range(8)}
    got = {(r.from_id, r.to_id): r.support for r in G.cooccurrence_edges(spark.createDataFrame(sorted(links), "note_id long, entity_id long"), support, tile=4).collect()}
    want: dict = {}
    for n in range(60):
        for pair in itertools.combinations(sorted(e for m, e in links if m == n), 2):
            want[pair] = want.get(pair, 0) + 1
    assert got == {p: c for p, c in want.items() if c >= support}
