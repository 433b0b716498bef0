"""Near-duplicate vectors: int8 tile products with error bounds, doubtful pairs recomputed in full precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm.common import discard, materialize, table
from lumenlog.llm.components import connected_components

TILE = 1024
SUPER = 8  # tiles of a super-tile: a vector is sent once for each super-tile of its label
BROADCAST_GROUPS = 50_000


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes, scales and residual norms of unit vectors: ||x - scale*code|| <= residual."""
    scale = np.abs(x).max(axis=1) / 127.0
    code = np.rint(x / scale[:, None]).astype(np.int8)
    residual = np.linalg.norm(x - scale[:, None] * code, axis=1) * (1 + 1e-9) + 1e-12
    return code, scale, residual


def tile_links(x: np.ndarray, y: np.ndarray, qx, qy, threshold: float, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two tiles with cosine >= threshold. x, y: vectors in double precision.

    For unit vectors u, v with quantised forms a, b: |u.v - a.b| <= e_v + e_u*(1 + e_v), so only pairs whose int8
    product plus that bound reaches the threshold are recomputed. int8 products of up to 1000 components are exact
    in the float32 matrix product used here (their sums stay below 2**24); wider vectors are summed in slices.
    """
    (cx, sx, ex), (cy, sy, ey) = qx, qy
    product = np.zeros((len(cx), len(cy)))
    for at in range(0, cx.shape[1], 1000):
        product += cx[:, at : at + 1000].astype(np.float32) @ cy[:, at : at + 1000].astype(np.float32).T
    product *= sx[:, None]
    product *= sy[None, :]
    product += ey[None, :] + ex[:, None] * (1 + ey[None, :])
    maybe = product >= threshold - 1e-9
    if same:
        maybe &= np.triu(np.ones(maybe.shape, bool), 1)
    i, j = np.nonzero(maybe)
    nx, ny = np.sqrt((x * x).sum(axis=1)), np.sqrt((y * y).sum(axis=1))
    keep = np.zeros(len(i), bool)
    for at in range(0, len(i), 16384):
        p, q = i[at : at + 16384], j[at : at + 16384]
        keep[at : at + 16384] = (x[p] * y[q]).sum(axis=1) / (nx[p] * ny[q]) >= threshold
    return i[keep], j[keep]


def local_roots(n: int, i: np.ndarray, j: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Per vector of a pair of tiles the smallest id its links in these tiles reach."""
    root = ids.copy()
    while len(i):
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        if (before == root).all():
            break
    return root


def _pack(key: tuple, rows: pa.Table) -> pa.Table:
    """One row per tile: ids and raw vectors, ordered by id."""
    label, dim, tile = (k.as_py() for k in key)
    rows = rows.sort_by("vec_id")
    flat = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return pa.table({"label": pa.array([label], pa.int64()), "dim": pa.array([dim], pa.int32()), "tile": pa.array([tile], pa.int32()), "ids": [rows.column("vec_id").to_numpy().astype(np.int64).tobytes()], "raw": [flat.astype(np.float64 if flat.dtype == np.float64 else np.float32).tobytes()], "wide": [bool(flat.dtype == np.float64)]})


def _compare(threshold: float, width: int):
    """All pairs of tiles of two super-tiles (or of one with itself): counts and a star forest of the links of each."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows, out = list(group.sort_values("tile").itertuples()), []

        def opened(r):
            v = np.frombuffer(r.raw, np.float64 if r.wide else np.float32).reshape(-1, r.dim).astype(np.float64)
            return np.frombuffer(r.ids, np.int64), v, quantise(v / np.sqrt((v * v).sum(axis=1))[:, None])

        one = len({r.tile // width for r in rows}) == 1
        for at, left in enumerate(rows):
            ia, va, qa = opened(left)
            for right in rows[at:]:
                if not one and left.tile // width == right.tile // width:
                    continue  # compared where the super-tile meets itself
                same = left is right
                ib, vb, qb = (ia, va, qa) if same else opened(right)
                i, j = tile_links(va, vb, qa, qb, threshold, same)
                ids = ia if same else np.concatenate([ia, ib])
                j = j if same else j + len(ia)
                n = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
                root, has = local_roots(len(ids), i, j, ids), n > 0
                out.append((ids[has], n[has], root[has]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
        return pd.DataFrame(dict(zip(("vec_id", "n", "root"), columns, strict=True)))

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93, tile: int = TILE, width: int = SUPER) -> DataFrame:
    """Per row of `vectors(vec_id, embedding, label)`: `vec_id, n_links, component_id, kept`.

    Vectors are compared with all others of an equal, non-null label and equal width, by cosine in double precision.
    Null, zero or non-finite vectors link with nothing, nor do rows without an id (no component, kept). Rows sharing
    an id count as one node with the links of all of them. An empty table gives no rows.

    Each label is dealt by a hash of the id into tiles of about `tile` vectors, `width` of them a super-tile. Each pair
    of super-tiles of a label is one group of at most 2*width rows, compared tile by tile, so a label that holds most
    vectors only makes more groups, and a vector is sent once for each super-tile of its label. A pair of tiles
    returns counts and a star forest of its links, never the links themselves.
    """
    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").alias("v"))
    finite = "label is not null and vec_id is not null and v is not null and size(v) > 0 and not exists(v, x -> x is null or isnan(x) or abs(x) = double('inf')) and exists(v, x -> x <> 0)"
    good = src.where(finite).withColumn("dim", F.size("v"))
    counts = materialize(good.groupBy("label", "dim").agg(F.count("*").alias("m")).select("label", "dim", F.ceil(F.col("m") / tile).cast("int").alias("tiles")), "counts")
    sized = F.broadcast(counts) if counts.count() <= BROADCAST_GROUPS else counts
    dealt = good.join(sized, ["label", "dim"]).withColumn("tile", F.pmod(F.xxhash64("vec_id"), F.col("tiles")).cast("int"))
    tiles = dealt.select("label", "dim", "tile", "vec_id", "v").groupBy("label", "dim", "tile").applyInArrow(_pack, "label long, dim int, tile int, ids binary, raw binary, wide boolean")
    packed = materialize(tiles, "tiles")
    tiles = packed.join(sized, ["label", "dim"])
    block = F.floor(F.col("tile") / width).cast("int")
    partner = F.explode(F.sequence(F.lit(0), F.floor((F.col("tiles") - 1) / width).cast("int")))
    paired = tiles.withColumn("other", partner).select("dim", "tile", "ids", "raw", "wide", "label", F.least(block, "other").alias("i"), F.greatest(block, "other").alias("j"))
    linked = materialize(paired.groupBy("label", "dim", "i", "j").applyInPandas(_compare(threshold, width), "vec_id long, n long, root long"), "linked")
    n = linked.groupBy("vec_id").agg(F.sum("n").alias("n"))
    found = connected_components(linked.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    out = src.select("vec_id").join(n, "vec_id", "left").join(found.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    out = materialize(out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))), "vectors")
    discard(counts, packed, linked, found)
    return out


def op5_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"), 0.93)


OP5_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), g AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), p AS MATERIALIZED (
  SELECT x.vec_id AS a, y.vec_id AS b FROM g x JOIN g y ON x.label = y.label AND len(x.e) = len(y.e) AND x.vec_id < y.vec_id
  WHERE list_cosine_similarity(x.e, y.e) >= 0.93
), l AS (
  SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), r AS (
  SELECT vec_id AS node, vec_id AS reach FROM v
  UNION
  SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a
)
SELECT v.vec_id, (SELECT count(*) FROM l WHERE l.a = v.vec_id) AS n_links, m.component_id, v.vec_id = m.component_id AS kept
FROM v JOIN (SELECT node, min(reach) AS component_id FROM r GROUP BY node) m ON m.node = v.vec_id
"""
