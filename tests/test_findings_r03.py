"""Faults that the review of round 3 found, on inputs that showed them."""

import numpy as np
from pyspark.sql import functions as F

from lumenlog.functions import text as X
from lumenlog.operators.neighbours import Cells, _vectors
from lumenlog.operators.spans import throttle_carry
from lumenlog.plans import catalog, catalog4
from lumenlog.plans.catalog_streams import drain
from lumenlog.streaming import streams as T
from tests.test_scale_forms import at, replay


def test_words_end_at_other_letters_as_in_sql(spark, duck, tmp_path):
    texts = ["tätesch undözusch", "ü ersch undäein", "Ein üund", "the ünd", "Und der", "the_ and1", "derßthe", None, "", "THE und"]
    rows = spark.createDataFrame([(i, 0, "user", t) for i, t in enumerate(texts)], "conv_id long, turn int, role string, text string")
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(tuple(r) for r in catalog.QUERIES["f17_classify_text"](spark, str(tmp_path)).collect())
    sql = catalog.ORACLES["f17_classify_text"].replace("FROM conversations", f"FROM '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(duck.execute(sql).fetchall())
    assert spark.range(1).select(X.extract_mention(F.lit("öabout Spark"))).first()[0] == "Spark"


def test_bands_of_a_cell_are_drawn_once(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(400, 4)))], "vec_id long, embedding array<double>")
    corpus = _vectors(rows, "vec_id", "embedding", "vec_id")
    cells = Cells(corpus, 400, 100)
    assert "percentile_approx" not in cells.rows._jdf.queryExecution().toString()
    held = {(r.pivot, r.band): r["count"] for r in cells.rows.groupBy("pivot", "band").count().collect()}
    assert held == {(int(s["pivot"]), int(s["band"])): int(s["n"]) for s in cells.stats}


def test_keys_of_a_bucket_share_a_group_of_the_stream(spark, tmp_path):
    rows = [(u, at(i), 100 * u + i, float(i % 7) if i % 3 else None) for i in range(20) for u in range(5)]
    schema = "user_id long, ts timestamp_ntz, event_id long, value double"
    end = [[(9, at(9000), 9900, None)], [(9, at(9001), 9901, None)]]
    work = T.Throttle({"user_id": "bigint"})
    work.seconds = 300
    stream = replay(spark, tmp_path / "in", [rows[:60], rows[60:], *end], schema)
    out = T._in_order(stream, work, "user_id long, event_id long, carried double", "10 minutes", buckets=1)
    got = {r.event_id: r.carried for r in drain(out).collect() if r.event_id < 9900}
    assert got == {r.event_id: r.carried for r in throttle_carry(spark.createDataFrame(rows, schema), "user_id", "value", 300).collect()}


def test_a_batch_of_several_files_is_read_as_one(spark, sf, duck, monkeypatch):
    monkeypatch.setattr(catalog4, "FILE_ROWS", 50)
    got = catalog4.QUERIES["st2_stream_drop_dups_in_order"](spark, sf).collect()
    assert sorted(tuple(r) for r in got) == sorted(duck.execute(catalog4.ORACLES["st2_stream_drop_dups_in_order"]).fetchall())
