"""Exact nearest neighbours of many queries: cells around pivots, triangle bounds, tiles compared in Arrow blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.sources.scratch import written

QUERY_BLOCK = 4096  # queries that a corpus tile is sent to together
CORPUS_TILE = 32_768  # vectors compared in one group
PIVOTS = 512  # cells at most
BANDS = 8  # of a cell, by the distance to its pivot

VISIT_SCHEMA = "query_id long, v array<double>, dim int, pivot int, band int"


def _nearest(k: int):
    """The k nearest of a corpus tile for each query of a block, ties by id; both come as rows `(id, v)` of one width."""

    def arrays(rows: pa.Table, name: str, width: int) -> tuple[np.ndarray, np.ndarray]:
        if not rows.num_rows:
            return np.zeros(0, np.int64), np.zeros((0, width))
        return rows.column(name).to_numpy(), rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

    def run(key: tuple, queries: pa.Table, corpus: pa.Table) -> pa.Table:
        width = key[0].as_py()
        (ids, q), (names, x) = arrays(queries, "query_id", width), arrays(corpus, "vec_id", width)
        out = []
        step = max(1, 4_000_000 // max(1, len(names)))  # so that a block of distances takes 32 MB
        for at in range(0, len(ids) if len(names) else 0, step):
            part = q[at : at + step]
            d = np.maximum((part * part).sum(1)[:, None] - 2 * part @ x.T + (x * x).sum(1)[None, :], 0)
            limit = np.partition(d, min(k, len(names)) - 1, axis=1)[:, min(k, len(names)) - 1]
            slack = 1e-9 * (1 + (part * part).sum(1) + (x * x).sum(1).max())  # the products round; all that may be among the k stay
            rows, cols = np.nonzero(d <= (limit + slack)[:, None])
            exact = np.sqrt(((part[rows] - x[cols]) ** 2).sum(1))
            order = np.lexsort((names[cols], exact, rows))
            rows, cols, exact = rows[order], cols[order], exact[order]
            first = np.searchsorted(rows, np.arange(len(part)))
            best = np.arange(len(rows)) - first[rows] < k
            out.append((ids[at : at + step][rows[best]], names[cols[best]], exact[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "distance"), columns, strict=True)))

    return run


def _vectors(df: DataFrame, name: str, vec: str, key: str) -> DataFrame:
    rows = df.select(F.col(key).cast("long").alias(name), F.col(vec).cast("array<double>").alias("v"))
    finite = "not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity'))"
    return rows.where(f"{name} is not null and size(v) > 0 and {finite}").withColumn("dim", F.size("v"))


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, rows, their vectors) for each width in a batch."""
    v, dims = batch.column("v"), batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        at = np.nonzero(dims == dim)[0]
        yield dim, at, v.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] - 2 * x @ pivots.T + (pivots * pivots).sum(1)[None, :]
    return np.sqrt(np.maximum(square, 0))


def choose_pivots(corpus: DataFrame, n: int, tile: int) -> dict[int, tuple[int, np.ndarray]]:
    """(first number, vectors) of each width; about one pivot a tile, `PIVOTS` at most, drawn by a hash of the id."""
    wanted = min(PIVOTS, max(1, -(-n // tile)))
    drawn = corpus.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // wanted))) == 0).select("v").limit(PIVOTS).collect()
    widths: dict[int, dict[tuple, None]] = {}
    for r in drawn:
        widths.setdefault(len(r.v), {})[tuple(r.v)] = None
    out, number = {}, 0
    for dim, vectors in sorted(widths.items()):
        out[dim] = (number, np.array(list(vectors)))
        number += len(vectors)
    return out


def _assign(pivots: dict):
    """The nearest pivot of each vector and the distance to it; -1 where no pivot is that wide."""

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in items:
            pivot, away = np.full(batch.num_rows, -1, np.int32), np.zeros(batch.num_rows)
            for dim, at, x in _by_width(batch):
                if dim in pivots:
                    first, centres = pivots[dim]
                    d = _distances(x, centres)
                    best = d.argmin(1)
                    pivot[at], away[at] = first + best, d[np.arange(len(at)), best]
            columns = [*(batch.column(c) for c in ("vec_id", "v", "dim")), pa.array(pivot), pa.array(away)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "dim", "pivot", "away"])

    return run


def _bounds(x: np.ndarray, dim: int, pivots: dict, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bands of this width, the least distance of each query to a vector of each, its distances to their pivots, their errors)."""
    first, centres = pivots[dim]
    rows = stats[(stats["pivot"] >= first) & (stats["pivot"] < first + len(centres))]
    d = _distances(x, centres)[:, rows["pivot"] - first]
    norms = np.sqrt((x * x).sum(1))[:, None] + np.sqrt((centres * centres).sum(1))[rows["pivot"] - first][None, :]
    slack = 4 * np.sqrt(dim * np.finfo(float).eps) * (1 + norms + rows["hi"][None, :])  # by which the distances may be off
    return rows, np.maximum(np.maximum(rows["lo"][None, :] - d, d - rows["hi"][None, :]) - slack, 0), d, slack


def _home(least: np.ndarray, d: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    """Marks each query's bands of least bound, nearest pivot first, until they hold `k` vectors."""
    order = np.lexsort((d, least), axis=1)
    held = np.cumsum(n[order], axis=1) - n[order]
    out = np.zeros(least.shape, bool)
    np.put_along_axis(out, order, held < k, axis=1)
    return out


def _visits(pivots: dict, stats: np.ndarray, k: int, rest: bool):
    """Rows of `VISIT_SCHEMA`: the home bands of each query, or (`rest`) the others that may hold a vector within `limit`."""

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in VISIT_SCHEMA.split(", ")]
        for batch in (b.slice(at, 1024) for b in items for at in range(0, b.num_rows, 1024)):
            for dim, at, x in _by_width(batch):
                if dim in pivots:
                    rows, least, d, slack = _bounds(x, dim, pivots, stats)
                    marks = _home(least, d, rows["n"], k)
                    if rest:
                        limit = batch.column("limit").to_numpy(zero_copy_only=False)[at][:, None]
                        marks = ~marks & (least <= limit + slack)
                    q, b = np.nonzero(marks)
                    pivot, band = rows["pivot"][b], rows["band"][b]
                else:
                    q = np.zeros(0, int) if rest else np.arange(len(at))
                    pivot, band = np.full(len(q), -1, np.int32), np.zeros(len(q), np.int32)
                of = batch.take(pa.array(at[q]))
                columns = [*(of.column(c) for c in ("query_id", "v", "dim")), pa.array(pivot, pa.int32()), pa.array(band, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def _compare(visits: DataFrame, cells: DataFrame, sizes: DataFrame, k: int, block: int) -> DataFrame:
    """The k nearest of each tile that a query visits; a band is split in tiles and its queries in blocks by hashes."""
    load = visits.groupBy("pivot", "band").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    plan = sizes.join(load, ["pivot", "band"])  # a row a band: PIVOTS * BANDS at most, and one of vectors without a pivot
    left = visits.join(F.broadcast(plan), ["pivot", "band"]).withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks")).withColumn("tile", F.explode(F.expr("sequence(0, tiles - 1)")))
    right = cells.join(F.broadcast(plan), ["pivot", "band"]).withColumn("tile", F.pmod(F.xxhash64("vec_id"), "tiles").cast("int")).withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1L)")))
    keys = ["dim", "pivot", "band", "tile", "block"]
    left, right = left.select(*keys, "query_id", "v"), right.select(*keys, "vec_id", "v")
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_nearest(k), "query_id long, vec_id long, distance double")


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


class Cells:
    """A corpus in cells around pivots and bands of the distance to them, written once; `stats` bound what a band holds.

    The driver holds `PIVOTS` vectors and `PIVOTS * BANDS` rows of stats, whatever the corpus. Vectors of widths that no
    pivot has (rare ones) form one band without bounds. A band has as many tiles as its vectors need, dealt by a hash, so
    copies of one vector are no hot group."""

    def __init__(self, corpus: DataFrame, n: int, tile: int) -> None:
        self.n, self.pivots = n, choose_pivots(corpus, n, tile)
        placed = written(corpus.mapInArrow(_assign(self.pivots), "vec_id long, v array<double>, dim int, pivot int, away double"), "placed")
        parts = ", ".join(str(i / BANDS) for i in range(1, BANDS))
        # Written, as approximate percentiles depend on the order of merging: the bands of `stats` and of all later passes must be the same.
        edges = written(placed.where("pivot >= 0").groupBy("pivot").agg(F.expr(f"percentile_approx(away, array({parts}))").alias("edges")), "edges")
        band = F.coalesce(F.size(F.filter("edges", lambda e: e < F.col("away"))), F.lit(0)).alias("band")
        self.rows = placed.join(F.broadcast(edges), "pivot", "left").select("vec_id", "v", "dim", "pivot", band, "away")
        bands = self.rows.groupBy("pivot", "band").agg(F.min("away").alias("lo"), F.max("away").alias("hi"), F.count("*").alias("n")).collect()
        kinds = [("pivot", "i4"), ("band", "i4"), ("lo", "f8"), ("hi", "f8"), ("n", "i8")]
        self.stats = np.array([tuple(r) for r in sorted(bands) if r.pivot >= 0], kinds)
        tiles = [(r.pivot, r.band, -(-r.n // tile), r.n) for r in bands]
        self.sizes = corpus.sparkSession.createDataFrame(tiles, "pivot int, band int, tiles int, n long")

    def home(self, queries: DataFrame, k: int) -> DataFrame:
        return queries.select("query_id", "v", "dim").mapInArrow(_visits(self.pivots, self.stats, k, False), VISIT_SCHEMA)

    def others(self, queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
        """Visits beyond home, by each query's k-th distance at home (none if it has fewer than k there)."""
        limit = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("distance")).alias("limit"))
        limited = queries.join(limit, "query_id", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
        return limited.select("query_id", "v", "dim", "limit").mapInArrow(_visits(self.pivots, self.stats, k, True), VISIT_SCHEMA)


def knn_join(queries: DataFrame, corpus: DataFrame, k: int, vec: str = "embedding", key: str = "vec_id", block: int = QUERY_BLOCK, tile: int = CORPUS_TILE) -> DataFrame:
    """The k nearest rows of the corpus by l2 for every query: `(query_id, vec_id, distance, rank)`.

    A corpus beyond one tile is put in cells around pivots. A query first meets the bands nearest to it; its k-th
    distance there then rules out every band that the triangle inequality puts farther away, and only what is left is
    paired. Vectors are copied once for each block of queries that visits their band, never to those that can't need them.
    Each pair of a tile and a block is one group, compared by matrix products, that sends on its k best per query.

    Vectors that are null, empty or hold null, NaN or infinite numbers, and ones of other widths, match nothing; ties go by
    id; rows of one query id are ranked together; empty sides give no rows; extra columns are ignored."""
    q, c = _vectors(queries, "query_id", vec, key), _vectors(corpus, "vec_id", vec, key)
    n = c.count()
    if n <= tile:
        keys = ["dim", "block"]
        blocks = max(1, -(-q.count() // block))
        left = q.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
        right = c.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        rows = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_nearest(k), "query_id long, vec_id long, distance double")
        return _ranked(rows, k)
    cells = Cells(c, n, tile)
    found = written(_ranked(_compare(written(cells.home(q, k), "home"), cells.rows, cells.sizes, k, block), k).drop("rank"), "nearest")
    rest = written(cells.others(q, found, k), "visits")
    return _ranked(found.union(_compare(rest, cells.rows, cells.sizes, k, block)), k)


def compared_share(queries: DataFrame, corpus: DataFrame, k: int, vec: str = "embedding", key: str = "vec_id", block: int = QUERY_BLOCK, tile: int = CORPUS_TILE) -> float:
    """The share of all pairs of a query and a vector that `knn_join` compares on a corpus beyond one tile."""
    q, c = _vectors(queries, "query_id", vec, key), _vectors(corpus, "vec_id", vec, key)
    cells = Cells(c, c.count(), tile)
    home = cells.home(q, k)
    found = written(_ranked(_compare(home, cells.rows, cells.sizes, k, block), k), "nearest")
    visits = home.union(cells.others(q, found, k)).join(F.broadcast(cells.sizes), ["pivot", "band"])
    return visits.agg(F.sum("n")).first()[0] / (q.count() * cells.n)
