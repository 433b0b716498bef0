"""Branch fixtures of single operators."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lumenlog.functions import text as X
from lumenlog.operators import entities as E
from lumenlog.operators import graph as G
from lumenlog.operators import integrity as I
from lumenlog.operators import intervals as IV
from lumenlog.operators import joins as J
from lumenlog.operators import rollups as A
from lumenlog.operators import selection as K
from lumenlog.operators import spans as W
from lumenlog.sources import tables as S


def at(minute: float) -> datetime:
    return datetime.fromtimestamp(1_700_000_000 + 60 * minute)


def samples(spark, rows):
    return spark.createDataFrame([(i, 1, at(m), app, title, url) for i, (m, app, title, url) in enumerate(rows)], "event_id long, user_id long, ts timestamp_ntz, app_id string, window_title string, url string")


def test_spans_break_on_app_title_and_browser_url(spark):
    df = samples(spark, [(0, "a", "t", None), (1, "a", None, None), (2, "a", "u", None), (3, "a", "v", None), (4, "b", "v", "x"), (5, "b", "v", None), (6, "c", "v", "x"), (7, "c", "v", "y")])
    got = [(r.app_id, r.n_samples) for r in W.build_spans(df, browsers=["b"]).orderBy("start_ts").collect()]
    assert got == [("a", 3), ("a", 1), ("b", 1), ("b", 1), ("c", 2)]  # title to null and on isn't a change; url counts in b alone


def test_span_ends_at_the_sample_that_breaks_it(spark):
    got = W.build_spans(samples(spark, [(0, "a", None, None), (5, "b", None, None), (9, "b", None, None)])).orderBy("start_ts").collect()
    assert [(r.end_ts - r.start_ts).seconds for r in got] == [300, 240]


def test_consecutive_duplicates_drift(spark):
    base = "0" * 63
    df = spark.createDataFrame([(i, 1, at(i), base + d) for i, d in enumerate("0137f")], "event_id long, user_id long, ts timestamp_ntz, fingerprint string")
    assert [r.is_dup for r in W.drop_consecutive_dups(df, "user_id", threshold=1).orderBy("ts").collect()] == [False, True, True, True, True]


def test_budget_stops_and_cuts(spark):
    df = spark.createDataFrame([(1, i, t) for i, t in enumerate([300, 600, 250, 400])], "k long, i long, token_estimate long")
    got = [(r.i, r.used_tokens) for r in W.budget_snippets(df, "k", ["i"], budget=900, cap=500, least=100).orderBy("i").collect()]
    assert got == [(0, 300), (1, 500), (2, 100)]
    got = [(r.i, r.used_tokens) for r in W.budget_snippets(df, "k", ["i"], budget=899, cap=500, least=100).orderBy("i").collect()]
    assert got == [(0, 300), (1, 500)]


def test_keyframes_gap_and_anchor(spark):
    rows = [("h", f"f{i}", datetime(2024, 1, 1, 0, 0, 0).replace(minute=m // 60, second=m % 60), s) for i, (m, s) in enumerate([(0, 0.9), (29, 0.8), (30, 0.7), (400, 0.6), (215, 0.05), (800, 0.5)])]
    df = spark.createDataFrame(rows, "k string, frame_id string, ts timestamp_ntz, score double")
    got = [(r.frame_id, r.why) for r in K.select_keyframes(df, ["k"], k=5, gap=30, anchor=300).collect()]
    assert got[0] == ("f0", "score") and ("f1", "score") not in got and len(got) == 5


def test_point_in_span_bounds(spark):
    spans = spark.createDataFrame([(1, 10, at(0), at(150))], "u long, span_id long, start_ts timestamp_ntz, end_ts timestamp_ntz")
    points = spark.createDataFrame([(1, at(0)), (1, at(149)), (1, at(150)), (2, at(5))], "u long, ts timestamp_ntz")
    got = [r.span_id for r in J.point_in_span_join(points, spans, "u").orderBy("u", "ts").collect()]
    assert got == [10, 10, None, None]


def test_interval_joins_have_no_nested_loop(spark):
    spans = spark.createDataFrame([(1, 10, at(0), at(150))], "u long, span_id long, start_ts timestamp_ntz, end_ts timestamp_ntz")
    points = spark.createDataFrame([(1, at(0))], "u long, ts timestamp_ntz")
    for df in (J.point_in_span_join(points, spans, "u"), IV.overlap_join(spans.withColumnRenamed("span_id", "id"), spans.withColumnRenamed("span_id", "id"), "u")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_blocklist_suffix_not_lookalike(spark):
    df = spark.createDataFrame([("a", "sub.example.com"), ("a", "notexample.com"), ("z", None), ("Mail", "x.org")], "app_id string, domain string")
    bl = spark.createDataFrame([("domain", "example.com", True), ("app", "mail", True), ("domain", "x.org", False)], "block_type string, pattern string, enabled boolean")
    got = {(r.app_id, r.domain): r.blocked_by for r in J.apply_blocklist(df, bl).collect()}
    assert got == {("a", "sub.example.com"): "domain:example.com", ("a", "notexample.com"): None, ("z", None): None, ("Mail", "x.org"): "app:mail"}


def test_minutes_over_midnight_and_bad_input(spark):
    df = spark.createDataFrame([("23:50", "00:10"), ("9:5", "9:15"), ("abc", "10:00"), ("10:00", None)], "a string, b string")
    assert [r[0] for r in df.select(A.hhmm_minutes(F.col("a"), F.col("b"))).collect()] == [20.0, 10.0, 0.0, 0.0]


def test_heatmap_of_nothing(spark):
    got = A.heatmap(spark.createDataFrame([], "ts timestamp_ntz"))
    assert got.count() == 168 and got.agg(F.sum("events")).first()[0] == 0


def test_json_repair_and_names(spark):
    df = spark.createDataFrame([('x ```json\n{"a": {"b": 1}}\n``` y',), ("none",)], "t string")
    assert [r[0] for r in df.select(X.repair_json(F.col("t"))).collect()] == ['{"a": {"b": 1}}', "none"]
    d = spark.createDataFrame([("HTTP://A.b.c:80/x",), ("a.b/x",), ("",), (None,)], "u string")
    assert [r[0] for r in d.select(X.extract_domain(F.col("u"))).collect()] == ["a.b.c", "a.b", "", ""]


def test_normalisation_chain_and_cycle(spark):
    m = spark.createDataFrame([("a", "b"), ("b", "c")], "variant string, canonical string")
    assert {(r.variant, r.canonical) for r in E.resolve_chains(m).collect()} == {("a", "c"), ("b", "c")}
    with pytest.raises(ValueError):
        E.resolve_chains(spark.createDataFrame([("a", "b"), ("b", "a")], "variant string, canonical string"))


def test_expand_keeps_best_route_and_paths(spark):
    e = spark.createDataFrame([(1, 2, "ABOUT_TOPIC", 1.0), (1, 3, "WATCHED", 1.0), (2, 4, "ABOUT_TOPIC", 0.8), (3, 4, "ABOUT_TOPIC", 1.0), (4, 5, "X", 0.2)], "from_id long, to_id long, edge_type string, weight double")
    seeds = spark.createDataFrame([(1,)], "entity_id long")
    got = {r.entity_id: (r.hop, r.relevance) for r in G.expand(seeds, e, 2).collect()}
    assert got == {2: (1, 1.0), 3: (1, 0.6), 4: (2, 0.5)}
    assert {r.path for r in G.paths(e, 1, 4).collect()} == {"1>2>4", "1>3>4"}
    assert [r.hops for r in G.paths(e, 1, 1).collect()] == [0]


def test_purge_dry_run_safe_and_forced(spark):
    df = spark.createDataFrame([(datetime(2024, 1, d),) for d in (1, 2, 30)], "ts timestamp_ntz")
    safe = spark.sql("select date'2024-01-01' as day")
    kept, log = I.purge(df, safe, 7, "2024-01-31 00:00:00")
    assert kept.count() == 2 and log.count() == 1
    assert I.purge(df, safe, 7, "2024-01-31 00:00:00", dry_run=True)[0].count() == 3
    assert I.purge(df, safe, 7, "2024-01-31 00:00:00", force=True)[0].count() == 1


def test_period_rewrite_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "p int, v string")
    for _ in range(2):
        S.overwrite_period(df, str(tmp_path / "t"), ["p"])
    S.overwrite_period(spark.createDataFrame([(2, "c")], "p int, v string"), str(tmp_path / "t"), ["p"])
    assert {(r.p, r.v) for r in spark.read.parquet(str(tmp_path / "t")).collect()} == {(1, "a"), (2, "c")}


def test_knn_join_on_ties_nulls_and_tiles(spark):
    from lumenlog.operators.vectors import knn_join

    rows = [(i, [float(i % 4), 1.0]) for i in range(60)] + [(60, None), (61, [float("nan"), 1.0]), (62, [1.0, 2.0, 3.0]), (63, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in knn_join(df.where("vec_id % 20 = 0"), df, 5, block=2, tile=7).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.distance))
    want = {q: [(i + 1, v, 0.0) for i, v in enumerate(range(q % 4, 20, 4))] for q in (0, 20, 40)}
    assert {q: sorted(x) for q, x in got.items()} == want
    assert knn_join(df.limit(0), df, 5).count() == 0 and knn_join(df, df.limit(0), 5).count() == 0


def test_upsert_sink_over_several_batches_and_a_half_written_one(spark, tmp_path):
    from lumenlog.streaming.streams import latest_version, table_versions, upsert_sink

    path = f"file://{tmp_path}/table"
    assert latest_version(spark, path) is None
    write = upsert_sink(path, ["k"], "t")
    parts = [[(1, 1, "a"), (2, 1, "b")], [(1, 3, "c")], [(1, 2, "late"), (3, 1, "d")], [(2, 5, "e")]]
    frames = [spark.createDataFrame(p, "k long, t long, v string") for p in parts]
    for i, f in enumerate(frames):
        write(f, i)
        write(f, i)  # run again
    assert sorted(tuple(r) for r in latest_version(spark, path).collect()) == [(1, 3, "c"), (2, 5, "e"), (3, 1, "d")]
    assert table_versions(spark, path) == [1, 2, 3]
    (tmp_path / "table" / "segments" / "segment=18" / "bucket=0").mkdir(parents=True)  # a write that never ended
    assert table_versions(spark, path)[-1] == 3
    write(frames[0], 10)
    assert sorted(tuple(r) for r in latest_version(spark, path).collect()) == [(1, 3, "c"), (2, 5, "e"), (3, 1, "d")]
