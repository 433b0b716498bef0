"""The kept index of names: equal to a scan with `contains`, built once for many searches, opening only what it asks for."""

import random

import pytest

from lumenlog.operators.name_index import NameIndex


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    r = random.Random(3)
    names = ["".join(r.choice("aAbcä😀 ") for _ in range(r.randint(0, 9))) for _ in range(300)] + [None, "", "aaaa", "aaaa", "A", "%_%"]
    rows = list(enumerate(names))
    df = spark.createDataFrame(rows, "id long, name string")
    return NameIndex(spark, str(tmp_path_factory.mktemp("index") / "names"), buckets=8).build(df, "name", "id"), rows


PARTS = ["a", "AA", "abc", "aaaa", "ä", "😀", "b a", "%", "_", "zzz", "c😀", "abcabcabcabc"]


def test_searches_equal_a_scan(index):
    held, rows = index
    for part in PARTS:
        want = sorted(i for i, n in rows if n and part.lower() in n.lower())
        assert sorted(r.id for r in held.search(part).collect()) == want, part
    assert held.search("").count() == 0


def test_many_texts_equal_a_scan(spark, index):
    held, rows = index
    asked = spark.createDataFrame([(p,) for p in [*PARTS, "a", "", None]], "part string")
    got = sorted((r.part, r.id) for r in held.held(asked, "part").collect())
    assert got == sorted((p, i) for p in PARTS for i, n in rows if n and p.lower() in n.lower())


def test_a_search_opens_one_bucket(index):
    plan = index[0].search("abc")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "PushedFilters" in plan and "Generate" not in plan
    assert len(index[0].search("abc").inputFiles()) >= 1


def test_empty_table(spark, tmp_path):
    held = NameIndex(spark, str(tmp_path / "none")).build(spark.createDataFrame([], "id long, name string"), "name", "id")
    assert held.search("abc").count() == 0
