"""Tasks get a bounded number of rows, however few bytes their rows take in a shuffle."""

import re

import pandas as pd
import pytest

from lumenlog.operators import graph as G
from lumenlog.plans import base as B
from lumenlog.sources import scratch
from tests.test_oracles import ALL, SQL, normal

ROWS = 128

EVENTS = [
    "w05_focus_sessions",
    "w05_focus_summary",
    "a30_hourly_apps",
    "f21_timeline_text",
    "w06_media_hours",
    "w13_temporal_sequence",
]


@pytest.mark.parametrize("name", EVENTS)
def test_spans_are_dealt_by_rows(spark, duck, sf, monkeypatch, name):
    monkeypatch.setattr(scratch, "TASK_ROWS", ROWS)
    out = ALL[name](spark, sf)
    assert out.rdd.getNumPartitions() >= duck.execute("select count(*) from events").fetchall()[0][0] // ROWS
    pd.testing.assert_frame_equal(normal(out.toPandas()), normal(duck.execute(SQL[name]).df()))


LINKS = [
    "a16_topic_usage",
    "g10_graph_view",
    "e04_normalized_edges",
    "g10_graph_view_edges",
    "g07_paths_of_two_parts",
    "a20_dashboard",
]


@pytest.mark.parametrize("name", LINKS)
def test_links_and_edges_are_dealt_by_rows(spark, duck, sf, monkeypatch, name):
    monkeypatch.setattr(scratch, "TASK_ROWS", 1024)
    out = ALL[name](spark, sf)
    assert re.search(r"RepartitionByExpression \[[^\]]*l_(order|part)key", out._jdf.queryExecution().optimizedPlan().toString()) or name == "g07_paths_of_two_parts"
    assert min(B.links(spark, sf).rdd.getNumPartitions(), B.edges(spark, sf).rdd.getNumPartitions()) > 4
    pd.testing.assert_frame_equal(normal(out.toPandas()), normal(duck.execute(SQL[name]).df()))


@pytest.mark.parametrize("name", ["g02_cooccurrence", "g02_cooccurrence_support"])
def test_pairs_are_joined_by_rows(spark, duck, sf, monkeypatch, name):
    monkeypatch.setattr(scratch, "TASK_ROWS", 1024)
    out = ALL[name](spark, sf)
    assert re.search(r"RepartitionByExpression \[note_id[^\]]*low", out._jdf.queryExecution().optimizedPlan().toString())
    pd.testing.assert_frame_equal(normal(out.toPandas()), normal(duck.execute(SQL[name]).df()))


def test_paths_make_only_edges_of_a_level_distinct(spark, sf, monkeypatch):
    steps = []
    monkeypatch.setattr(G, "written", lambda df, tag="step": steps.append(df) or df.localCheckpoint())
    found = G.paths(B.edges(spark, sf).where("weight >= 0.5"), 150, -1)
    assert len(steps) == 3 and found.count() == 0
    for df in steps:
        assert not re.search(r"Aggregate \[from_id#\d+L, to_id#\d+L\].*\n[ :+-]*(Filter.*\n[ :+-]*)?Union", df._jdf.queryExecution().optimizedPlan().toString())


def test_paths_over_repeated_edges_come_once(spark):
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (2, 3), (3, 2), (3, 4), (3, 4)], "from_id long, to_id long")
    assert [tuple(r) for r in G.paths(edges, 1, 4).collect()] == [("1>2>3>4", 3)]


@pytest.mark.parametrize("name", ["g10_graph_view", "g10_graph_view_edges"])
def test_notes_of_an_entity_are_counted_after_links_are_distinct(spark, sf, name):
    assert "count(distinct" not in ALL[name](spark, sf)._jdf.queryExecution().executedPlan().toString()


def test_notes_of_an_entity_count_once(spark):
    links = spark.createDataFrame([(1, 10), (1, 10), (2, 10), (3, 10), (None, 10), (2, 11)], "note_id long, entity_id long")
    notes = spark.createDataFrame([(1,), (2,), (2,), (None,)], "note_id long")
    entities = spark.createDataFrame([(10,), (11,), (12,)], "entity_id long")
    edges = spark.createDataFrame([(11, 12, "USED_APP", 0.9)], "from_id long, to_id long, edge_type string, weight double")
    top, among = G.graph_view(entities, edges, links, notes)
    assert [tuple(r) for r in top.collect()] == [(11, 1, 1), (12, 1, 0), (10, 0, 2)]
    assert among.count() == 1


def test_repointed_edges_are_dealt_by_rows(spark, duck, sf, monkeypatch):
    monkeypatch.setattr(scratch, "TASK_ROWS", 1024)
    out = ALL["e04_normalized_edges"](spark, sf)
    assert len(re.findall("REPARTITION_BY_NUM", out._jdf.queryExecution().executedPlan().toString())) == 2
    assert out.rdd.getNumPartitions() > 4
    pd.testing.assert_frame_equal(normal(out.toPandas()), normal(duck.execute(SQL["e04_normalized_edges"]).df()))
