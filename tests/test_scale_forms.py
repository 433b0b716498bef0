"""Forms made for hot keys and hubs against brute force, and streams replayed in several batches with late rows."""

import itertools
import os
import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lumenlog.operators import graph as G
from lumenlog.operators import joins as J
from lumenlog.operators.sets import union_arrays
from lumenlog.operators.spans import build_spans
from lumenlog.plans.catalog_streams import drain
from lumenlog.streaming import streams as T

RNG = random.Random(7)


def test_cooccurrence_in_tiles(spark):
    links = {(n, e) for n in range(3) for e in RNG.sample(range(40), 30 if n else 3)}
    rows = [*links, *list(links)[:5], (None, 1), (9, None)]
    got = G.cooccurrence_edges(spark.createDataFrame(rows, "note_id long, entity_id long"), tile=4).collect()
    want: dict = {}
    for n in range(3):
        for pair in itertools.combinations(sorted(e for m, e in links if m == n), 2):
            want[pair] = want.get(pair, 0) + 1
    assert {(r.from_id, r.to_id): r.support for r in got} == want


def test_paths_are_all_shortest_ones(spark):
    pairs = {tuple(RNG.sample(range(14), 2)) for _ in range(22)} | {(3, 3), (90, 91)}
    near: dict = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    edges = spark.createDataFrame(sorted(pairs), "from_id long, to_id long")
    for a, b in ((0, 13), (2, 11), (5, 5), (1, 90)):
        walks, want = [[a]], []
        for _ in range(4):
            want = [w for w in walks if w[-1] == b]
            if want:
                break
            walks = [[*w, x] for w in walks for x in near.get(w[-1], ()) if x not in w]
        got = G.paths(edges, a, b).collect()
        assert sorted(r.path for r in got) == sorted(">".join(map(str, w)) for w in want)


def test_components(spark):
    links = [(i, i + 1) for i in range(20)] + [(30, 40), (40, 35), (50, 50)] + [(99, x) for x in range(60, 70)]
    got = {r.node: r.component for r in G.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(21), 0), 30: 30, 35: 30, 40: 30, **dict.fromkeys([*range(60, 70), 99], 60)}
    assert G.components(spark.createDataFrame([], "a long, b long")).count() == 0


def similarity(a: str, b: str) -> float:
    if a in b or b in a:
        return 0.9
    x, y = set(a) - {" "}, set(b) - {" "}
    return len(x & y) / len(x | y) if x | y else 0.0


def test_similar_pairs_and_held_texts(spark):
    words = ["".join(RNG.choice("abcdefg ") for _ in range(RNG.randint(1, 9))) for _ in range(60)] + ["Ab", "", "  ", "ab"]
    rows = [(RNG.choice("xy"), w) for w in words] + [("x", None), (None, "abc")]
    df = spark.createDataFrame(rows, "entity_type string, name string")
    for threshold in (0.5, 0.8, 0.95):
        got = {(r.entity_type, r.name_a, r.name_b): r.similarity for r in J.similar_pairs(df, threshold).collect()}
        want = {}
        for t in "xy":
            for a, b in itertools.combinations(sorted({n.lower() for k, n in rows if k == t and n}), 2):
                if similarity(a, b) >= threshold:
                    want[(t, a, b)] = similarity(a, b)
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    known = spark.createDataFrame([(w,) for w in words], "known string")
    asked = spark.createDataFrame([(w[:n],) for w in words for n in (1, 2, 4)], "asked string")
    got = {tuple(r) for r in J.held_pairs(asked, known).collect()}
    assert got == {(a, k) for a in {w[:n] for w in words for n in (1, 2, 4)} for k in words if a and k and a in k}


def test_potential_duplicates_by_alias_alone(spark):
    rows = [(1, "app", "Visual Studio", ["vscode"]), (2, "app", "Editor Q", ["VSCode"]), (3, "topic", "vscode", None), (4, "app", "zzz", []), (5, "app", "qed rotie", None)]
    df = spark.createDataFrame(rows, "entity_id long, entity_type string, canonical_name string, aliases array<string>")
    got = {r.entity_id: r.group_id for r in J.potential_duplicates(df).collect()}
    assert got == {1: 1, 2: 1, 5: 1}


def test_union_arrays_nulls(spark):
    df = spark.createDataFrame([(1, ["b", "a"]), (1, ["a", None]), (2, None), (3, [])], "k int, v array<string>")
    assert {r.k: r.v for r in union_arrays(df, "k", "v").collect()} == {1: ["a", "b"], 2: [], 3: []}


def test_spans_keep_the_newest_ids(spark):
    rows = [(1, datetime(2024, 1, 1, 0, i), i, "a", None, None) for i in range(9)]
    df = spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, event_id long, app_id string, window_title string, url string")
    (got,) = build_spans(df, keep_ids=3).collect()
    assert got.evidence_ids == [6, 7, 8] and got.n_samples == 9


def replay(spark, folder, batches, schema, first=0):
    """A stream of one file a batch, in the given order; late rows are those before the watermark of two batches ago."""
    os.makedirs(folder, exist_ok=True)
    for i, rows in enumerate(batches, first):
        path = f"{folder}/part-{i:03}.parquet"
        spark.createDataFrame(rows, schema).toPandas().to_parquet(path, coerce_timestamps="us")
        os.utime(path, (1_700_000_000 + 10 * i,) * 2)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")


def at(minute):
    return datetime(2024, 1, 1) + timedelta(minutes=minute)


SAMPLES = "user_id long, ts timestamp_ntz, event_id long, app_id string"


def test_spans_over_batches_with_late_and_idle_ones(spark, tmp_path):
    batches = [
        [(1, at(0), 1, "a"), (1, at(20), 3, "b"), (2, at(0), 9, "z")],
        [(1, at(10), 2, "a"), (1, at(40), 4, "b")],
        [(1, at(200), 5, "c")],
        [(1, at(205), 10, "c")],
        [(1, at(30), 6, "late"), (1, at(210), 7, "d")],
        [(1, at(900), 8, "e")],
    ]
    stream = T.stream_spans(replay(spark, tmp_path / "in", batches, SAMPLES), delay="30 minutes", idle=60 * 60)
    got = sorted((r.user_id, r.app_id, r.s, r.e, r.n_samples) for r in drain(stream).select("*", F.col("start_ts").cast("timestamp_ntz").alias("s"), F.col("end_ts").cast("timestamp_ntz").alias("e")).collect())
    assert got == [(1, "a", at(0), at(20), 2), (1, "b", at(20), at(40), 2), (1, "c", at(200), at(210), 2), (1, "d", at(210), at(210), 1), (2, "z", at(0), at(0), 1)]


def test_hours_over_batches_drop_late_rows(spark, tmp_path):
    batches = [[(1, at(5), 1, "a")], [(1, at(300), 2, "a")], [(1, at(301), 6, "a")], [(1, at(20), 3, "a"), (1, at(290), 4, "a")], [(1, at(900), 5, "a")]]
    got = drain(T.stream_hourly(replay(spark, tmp_path / "in", batches, SAMPLES), delay="1 hour"))
    assert {(r.h, r.events) for r in got.select(F.col("hour").cast("timestamp_ntz").alias("h"), "events").collect()} == {(at(0), 1), (at(240), 1), (at(300), 2)}


def test_duplicates_across_batches_and_monitors(spark, tmp_path):
    schema = "user_id long, monitor int, ts timestamp_ntz, event_id long, fingerprint string"
    batches = [[(1, 0, at(0), 1, "00"), (1, 1, at(0), 2, "ff")], [(1, 0, at(1), 3, "01"), (1, 1, at(1), 4, "00")]]
    got = drain(T.stream_drop_dups(replay(spark, tmp_path / "in", batches, schema), threshold=1, key=("user_id", "monitor")))
    assert {r.event_id: r.is_dup for r in got.collect()} == {1: False, 2: False, 3: True, 4: False}


def test_keys_are_forgotten_after_their_time(spark, tmp_path):
    schema = "user_id long, ts timestamp_ntz, event_id long, fingerprint string"
    rocks = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", rocks)
    for ttl, dup in ((1, False), (10**8, True)):
        folder = tmp_path / str(ttl)
        for i in range(2):
            stream = replay(spark, folder / "in", [[(1, at(i), i + 1, "00")]], schema, first=i)
            out = T.stream_drop_dups(stream, ttl=ttl).writeStream.format("parquet").option("path", f"file://{folder}/out").option("checkpointLocation", f"file://{folder}/state")
            out.trigger(once=True).start().awaitTermination(120)
        got = {r.event_id: r.is_dup for r in spark.read.parquet(f"file://{folder}/out").collect()}
        assert got == {1: False, 2: dup}
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_blocked_domains_and_those_below(spark, tmp_path):
    schema = "app_id string, domain string"
    rows = [[("a", "Bad.com"), ("b", "x.y.bad.com"), ("c", "notbad.com"), ("Evil", None), ("d", None), ("e", "co.uk"), ("f", "x.shop.co.uk")]]
    bl = spark.createDataFrame([("app", "evil", True), ("domain", "bad.com", True), ("domain", "Shop.co.uk", True), ("domain", "com", False)], "block_type string, pattern string, enabled boolean")
    got = drain(T.stream_blocklist(replay(spark, tmp_path / "in", rows, schema), bl))
    assert {r.app_id for r in got.collect()} == {"c", "d", "e"}
