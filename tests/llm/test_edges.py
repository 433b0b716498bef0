"""Nulls in any column, empty and very long texts, ties, repeated rows, empty tables, clashing extra columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lumenlog.llm import embeddings, fingerprints, html, lines, minhash, mixing, packing, quality, suffix_tree
from lumenlog.llm.queries import ORACLES, QUERIES

LONG = "Word and another word here. " * 4_000
ROWS = [(1, "A text.", "en", "s", 7), (1, "A text.", "en", "s", 7), (1, "Other text", "en", None, None), (None, "No id here", None, "s", 1), (None, None, None, None, None), (5, None, "en", "s", 0), (6, "", "en", "s", 0), (7, " \t\n", "en", "s", 3), (8, LONG, "en", "t", 1), (9, LONG + "end", "en", "t", 1)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["key", "rep", "sig", "digest", "n", "h", "w", "pos", "__u", "size", "rate", "target", "copies", "component_id", "kept", "accepted", "p_good", "mark", "bucket", "lines_removed", "__runs", "word", "c"]


def docs(spark, rows=ROWS):
    return spark.createDataFrame(rows, SCHEMA)


def wide(df):
    for c in CLASH:
        df = df.withColumn(c, F.lit("x"))
    return df


def held(df):
    return df.withColumn("held_out", F.lit(False))


RUNS = {
    "op1": lambda d: suffix_tree.score_texts(held(d)),
    "op2": lambda d: minhash.near_duplicates(d, 5, 80),
    "op3": lambda d: packing.packed_pieces(packing.pack_best_fit(d)),
    "op4": lambda d: quality.grade_documents(d, quality.train(d, d.sparkSession.createDataFrame([(1, 1, 0), (5, None, None), (None, 0, 1), (8, 0, None), (8, 1, 1)], "doc_id long, quality int, toxic int"))),
    "op6": lambda d: packing.pack_balanced(d),
    "op7": lambda d: fingerprints.fingerprint_edits(d),
    "op9": lambda d: lines.drop_repeated_runs(d),
    "op10": lambda d: mixing.mix_plan(d),
}


@pytest.mark.parametrize("op", sorted(RUNS))
def test_edges(spark, op):
    n = RUNS[op](docs(spark)).count()
    assert n == len(ROWS) if op not in ("op3", "op6") else n >= len(ROWS)
    assert RUNS[op](wide(docs(spark))).count() == n
    assert RUNS[op](docs(spark, [])).count() == 0
    assert RUNS[op](docs(spark, [(None, None, None, None, None)])).count() == 1


def test_defined_results(spark):
    rows = {(r.doc_id, r.n_shingles): r for r in minhash.near_duplicates(docs(spark), 5, 80).collect()}
    assert rows[(None, 0)].component_id is None and rows[(None, 0)].kept
    assert rows[(5, 0)].component_id == 5 and rows[(6, 0)].kept and rows[(7, 0)].kept
    assert minhash.drop_near_duplicates(docs(spark), 5, 80).count() == len(ROWS) - 1  # 9 is like 8
    out = lines.drop_repeated_runs(docs(spark)).where("doc_id = 1").collect()
    assert len(out) == 3 and all(r.lines_removed == 0 for r in out)
    assert [r.taken for r in mixing.mix_plan(docs(spark)).where("text is null").collect()] == [0, 0]


def test_vector_and_page_edges(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (2, None, 1), (3, [1.0, None], 1), (4, [1.0, 0.0], 1), (5, [], 1), (6, [1.0, 0.0], None)], "vec_id long, embedding array<double>, label int")
    got = embeddings.near_vectors(v.withColumn("dim", F.lit(1)).withColumn("tile", F.lit(1)), 0.93).collect()
    assert len(got) == 8 and {r.vec_id for r in got if r.component_id == 1} == {1, 4}
    assert embeddings.near_vectors(v.limit(0), 0.93).count() == 0
    p = spark.createDataFrame([(1, "u", "<article><p>Text</article>"), (1, None, None), (None, "u", ""), (2, "u", "<p>" + LONG)], "page_id long, url string, html string")
    got = html.extract_text(p.withColumn("text", F.lit(1))).collect()
    assert sorted(r.n_chars for r in got) == [0, 0, 4, len(LONG.strip())]
    assert html.extract_text(p.limit(0)).count() == 0


def test_pipeline_stages_on_edges(spark, sf):
    df = docs(spark)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, df, sf)
        if name != "packing":
            assert out.columns == df.columns
            assert stage(spark, docs(spark, []), sf).count() == 0
        out.count()


def test_pipeline_end_to_end(spark, sf):
    packed = corpus_pipeline.run(spark, sf)
    rows = packed.collect()
    assert rows and all(r.length > 0 for r in rows)
    by: dict = {}
    for r in rows:
        by[r.sequence_id] = by.get(r.sequence_id, 0) + r.length
    assert max(by.values()) <= 2048


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, sf, name):
    got, want = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).df()
    names = sorted(got.columns)
    got, want = (x[names].astype(object).where(x[names].notna(), None).sort_values([c for c in names if x[c].notna().all()]).reset_index(drop=True) for x in (got, want))
    assert len(got) == len(want) and (got.to_numpy() == want.to_numpy()).all()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
