"""Exact neighbours through cells: equal to brute force, pruned where vectors cluster, whole for copies and odd widths."""

import numpy as np
import pytest

from lumenlog.operators import neighbours


def frame(spark, vectors, first=0):
    rows = [(first + i, None if v is None else [float(x) for x in v]) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def brute(queries, corpus, k):
    out = {}
    for i, q in enumerate(queries):
        d = [(float(np.sqrt(((np.array(q) - np.array(v)) ** 2).sum())), j) for j, v in enumerate(corpus) if v is not None and len(v) == len(q)]
        out[i] = sorted(d)[:k]
    return out


def got(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: r.rank):
        out.setdefault(r.query_id, []).append((r.distance, r.vec_id))
    return out


def same(a, b):
    assert set(a) == {q for q, x in b.items() if x}
    for q in a:
        assert [j for _, j in a[q]] == [j for _, j in b[q]]
        assert [d for d, _ in a[q]] == pytest.approx([d for d, _ in b[q]])


def clusters(rng, n, dim, groups):
    centres = rng.normal(size=(groups, dim)) * 20
    return (centres[rng.integers(0, groups, n)] + rng.normal(size=(n, dim))).round(3)


@pytest.mark.parametrize("k", [1, 5, 40])
def test_equal_to_brute_force_on_clusters(spark, k):
    rng = np.random.default_rng(k)
    corpus, queries = clusters(rng, 900, 6, 12), rng.normal(size=(60, 6)) * 15
    queries[:30] = corpus[:30]
    same(got(neighbours.knn_join(frame(spark, queries), frame(spark, corpus), k, block=16, tile=40)), brute(queries, corpus, k))


def test_equal_to_brute_force_without_clusters(spark):
    rng = np.random.default_rng(4)
    corpus, queries = rng.normal(size=(500, 16)), rng.normal(size=(40, 16))
    same(got(neighbours.knn_join(frame(spark, queries), frame(spark, corpus), 7, block=16, tile=64)), brute(queries, corpus, 7))


def test_copies_odd_widths_and_bad_vectors(spark):
    rng = np.random.default_rng(5)
    corpus = [[1.0, 2.0]] * 300 + rng.normal(size=(300, 2)).round(2).tolist() + [[1.0], None, [float("nan"), 1.0], [float("inf"), 1.0], [], [3.0]]
    queries = [[1.0, 2.0], [0.5, 0.5], [2.0], [1.0, 2.0, 3.0]]
    clean = [v if v and np.isfinite(v).all() else None for v in corpus]
    same(got(neighbours.knn_join(frame(spark, queries), frame(spark, corpus), 4, block=2, tile=32)), brute(queries, clean, 4))


def test_fewer_vectors_than_k_and_empty_sides(spark):
    corpus, queries = [[float(i), 0.0] for i in range(6)], [[0.0, 0.0]]
    same(got(neighbours.knn_join(frame(spark, queries), frame(spark, corpus), 50, tile=2)), brute(queries, corpus, 50))
    some = frame(spark, corpus)
    assert neighbours.knn_join(some.limit(0), some, 3, tile=2).count() == 0 and neighbours.knn_join(some, some.limit(0), 3, tile=2).count() == 0


def test_far_bands_are_not_paired(spark):
    rng = np.random.default_rng(6)
    corpus = clusters(rng, 4000, 8, 40)
    assert neighbours.compared_share(frame(spark, corpus[:100]), frame(spark, corpus), 5, block=64, tile=50) < 0.25
