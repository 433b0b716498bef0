"""Streams over several files with late rows against their batch forms."""

import random

from pyspark.sql import functions as F

from lumenlog.operators.spans import drop_consecutive_dups, throttle_carry
from lumenlog.plans.catalog_streams import drain
from lumenlog.streaming import streams as T
from tests.test_scale_forms import at, replay

END = at(10_000)  # a last row that moves the watermark past all others


def shuffled(rows, seed, batches=4, by=25):
    """Rows in batches by time, some of them a batch late, and two closing batches."""
    rng = random.Random(seed)
    out = [[] for _ in range(batches + 1)]
    size = len(rows) // batches + 1
    for i, r in enumerate(rows):
        out[i // size + (rng.random() < 0.2)].append(r)
    return [b for b in out if b] + [[(9, END, 900 + i, None) for i in range(1)], [(9, END, 990, None)]]


def test_throttled_readings_over_files(spark, tmp_path):
    rng = random.Random(1)
    rows = [(rng.choice([1, 2]), at(i + rng.randrange(2)), i, rng.choice([None, float(i)])) for i in range(80)]
    schema = "user_id long, ts timestamp_ntz, event_id long, value double"
    out = drain(T.stream_throttle(replay(spark, tmp_path / "in", shuffled(rows, 2), schema), 300, delay="2 hours"))
    got = {r.event_id: r.carried for r in out.collect() if r.event_id < 900}
    want = {r.event_id: r.carried for r in throttle_carry(spark.createDataFrame(rows, schema), "user_id", "value", 300).collect()}
    assert got == want


def test_state_of_silent_keys_goes(spark, tmp_path):
    schema = "user_id long, ts timestamp_ntz, event_id long, value double"
    batches = [[(1, at(0), 1, 5.0), (1, at(1), 2, 6.0)], [(2, at(500), 3, 1.0)], [(1, at(501), 4, None)], [(9, END, 900, None)], [(9, END, 901, None)]]
    for silence, carried in ((3600, None), (None, 5.0)):
        out = drain(T.stream_throttle(replay(spark, tmp_path / str(silence), batches, schema), 300, delay="10 minutes", silence=silence))
        assert {r.event_id: r.carried for r in out.collect() if r.event_id < 900} == {1: 5.0, 2: 5.0, 3: 1.0, 4: carried}


def test_duplicates_of_late_frames_are_those_of_the_batch_form(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice([1, 2]), at(i), i, f"{rng.choice([0, 1, 3, 255]):064x}") for i in range(80)]
    schema = "user_id long, ts timestamp_ntz, event_id long, fingerprint string"
    batches = [[(*r[:3], r[3] or "0") for r in b] for b in shuffled(rows, 4)]
    out = drain(T.stream_drop_dups(replay(spark, tmp_path / "in", batches, schema), threshold=1, delay="2 hours"))
    got = {r.event_id: r.is_dup for r in out.collect() if r.event_id < 900}
    want = {r.event_id: r.is_dup for r in drop_consecutive_dups(spark.createDataFrame(rows, schema), "user_id", threshold=1).collect()}
    assert got == want and len(set(got.values())) == 2


def test_frames_without_a_span_come_out_after_the_watermark(spark, tmp_path):
    f = "user_id long, ts timestamp_ntz, frame_id long"
    s = "user_id long, start_ts timestamp_ntz, end_ts timestamp_ntz, span_id long"
    frames = replay(spark, tmp_path / "f", [[(1, at(5), 1), (1, at(50), 2), (2, at(5), 3)], [(1, at(70), 4)], [(9, at(900), 8)], [(9, at(2000), 9)]], f)
    spans = replay(spark, tmp_path / "s", [[(2, at(0), at(10), 20)], [(1, at(0), at(20), 10)], [(9, at(900), at(901), 30)], [(9, at(2000), at(2001), 31)]], s)  # the span of frame 1 comes a batch late
    got = {r.frame_id: r.span_id for r in drain(T.stream_frame_span_join(frames, spans, how="left_outer")).collect()}
    assert {k: v for k, v in got.items() if k < 8} == {1: 10, 2: None, 3: 20, 4: None}


def test_blocked_rows_are_kept_without_their_address(spark, tmp_path):
    schema = "app_id string, domain string, url string, window_title string"
    rows = [[("a", "Bad.com", "u", "t"), ("b", "x.y.bad.com", "u", "t"), ("c", "notbad.com", "u", "t"), ("Evil", "x.bad.com", "u", "t"), ("d", None, None, "t")]]
    bl = spark.createDataFrame([("app", "evil", True), ("domain", "bad.com", True), ("domain", "y.bad.com", True), ("domain", "com", False)], "block_type string, pattern string, enabled boolean")
    got = {r.app_id: (r.domain, r.url, r.window_title, r.blocked, r.blocked_reason) for r in drain(T.stream_redact(replay(spark, tmp_path / "in", rows, schema), bl)).collect()}
    hidden = lambda why: (None, None, None, True, why)
    assert got == {"a": hidden("domain: bad.com"), "b": hidden("domain: bad.com"), "c": ("notbad.com", "u", "t", False, None), "Evil": hidden("app: evil"), "d": (None, None, "t", False, None)}


def test_tokens_by_hour(spark, tmp_path):
    schema = "ts timestamp_ntz, app_id string, n long"
    out = drain(T.stream_hourly(replay(spark, tmp_path / "in", [[(at(1), "a", 5), (at(2), "a", 7)], [(at(70), "b", 1)], [(END, "z", 0)], [(END, "z", 0)]], schema), tokens="n"))
    assert {(r.h, r.app_id, r.events, r.tokens) for r in out.select("*", F.col("hour").cast("timestamp_ntz").alias("h")).collect()} == {(at(0), "a", 2, 12), (at(60), "b", 1, 1)}
