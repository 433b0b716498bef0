"""Vector retrieval: exact search as expressions, coarse-to-fine drill-down; the join of many queries is in `neighbours`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenlog.operators.neighbours import knn_join

__all__ = ["cosine_distance", "day_context", "dot", "hierarchical_fallback", "hierarchical_search", "knn", "knn_join", "l2", "needs_embedding"]


def _d(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(_d(a), _d(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def cosine_distance(a: Column, b: Column) -> Column:
    """Null if either vector is zero."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms > 0, 1 - dot(a, b) / norms)


def knn(df: DataFrame, query: list[float], k: int, metric: str = "l2", vec: str = "embedding", key: str = "vec_id", where: Column | None = None, min_score: float | None = None) -> DataFrame:
    """The k nearest rows that pass `where` (applied first), score 1/(1+d) for l2 and 1-min(d,1) for cosine."""
    rows = df if where is None else df.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    d = l2(F.col(vec), q) if metric == "l2" else cosine_distance(F.col(vec), q)
    score = 1 / (1 + F.col("distance")) if metric == "l2" else 1 - F.least(F.col("distance"), F.lit(1.0))
    out = rows.withColumn("distance", d).where("distance is not null").withColumn("score", score)
    if min_score is not None:
        out = out.where(F.col("score") >= min_score)
    return out.orderBy("distance", key).limit(k)


def hierarchical_search(parents: DataFrame, children: DataFrame, query: list[float], days: int = 3, hours: int = 3) -> DataFrame:
    """The best parents by cosine, the best children of each: relevance 0.6*parent + 0.4*mean child score, or the parent's alone.

    `parents(parent_id, embedding)`, `children(parent_id, vec_id, embedding)`."""
    top = knn(parents, query, 2 * days, "cosine", key="parent_id").select("parent_id", F.col("score").alias("parent_score"))
    scored = _scored(children.join(top, "parent_id", "left_semi"), query)
    best = scored.withColumn("r", F.row_number().over(Window.partitionBy("parent_id").orderBy(F.col("score").desc(), "vec_id"))).where(F.col("r") <= hours)
    mean = best.groupBy("parent_id").agg(F.avg("score").alias("child_score"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "vec_id"))), lambda x: x["vec_id"].cast("string")), ",").alias("children"))
    rows = top.join(mean, "parent_id", "left")
    relevance = F.when(F.col("child_score").isNull(), F.col("parent_score")).otherwise(0.6 * F.col("parent_score") + 0.4 * F.col("child_score"))
    return rows.select("parent_id", F.round(relevance, 6).alias("relevance"), "children").orderBy(F.col("relevance").desc(), "parent_id").limit(days)


def _scored(df: DataFrame, query: list[float]) -> DataFrame:
    q = F.array(*[F.lit(float(x)) for x in query])
    return df.withColumn("distance", cosine_distance(F.col("embedding"), q)).where("distance is not null").withColumn("score", 1 - F.least("distance", F.lit(1.0)))


def hierarchical_fallback(children: DataFrame, query: list[float], days: int = 3, hours: int = 3) -> DataFrame:
    """Without parents, the best days*hours children grouped by parent, by mean score."""
    best = _scored(children, query).orderBy(F.col("score").desc(), "vec_id").limit(days * hours)
    return best.groupBy("parent_id").agg(F.round(F.avg("score"), 6).alias("relevance"), F.count("*").alias("n")).orderBy(F.col("relevance").desc(), "parent_id").limit(days)


def needs_embedding(notes: DataFrame, embeddings: DataFrame, force: bool = False) -> DataFrame:
    """Notes without an embedding or changed after it; all of them if forced."""
    if force:
        return notes
    rows = notes.join(embeddings.select("note_id", "embedded_ts"), "note_id", "left")
    return rows.where("embedded_ts is null or updated_ts > embedded_ts").drop("embedded_ts")


def day_context(notes: DataFrame) -> DataFrame:
    """Per day its notes in order."""
    return notes.groupBy(F.to_date("start_ts").alias("day")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_ts", "note_id"))), lambda x: x["note_id"].cast("string")), ",").alias("note_ids"))
