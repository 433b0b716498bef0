"""Ordering, set operations and merging of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def topk(df: DataFrame, order: list, n: int) -> DataFrame:
    """The first `n` rows."""
    return df.orderBy(*order).limit(n)


def order_by_all(df: DataFrame, *cols) -> DataFrame:
    """A total order over several keys."""
    return df.orderBy(*cols)


def activity_hours(*tables: tuple[DataFrame, str]) -> DataFrame:
    """Distinct hours in which any table has rows."""
    out = None
    for df, ts in tables:
        one = df.select(F.date_trunc("hour", ts).cast("timestamp_ntz").alias("hour"))
        out = one if out is None else out.union(one)
    return out.distinct()


def merge_results(*parts: DataFrame, key: str, ts: str) -> DataFrame:
    """Results joined, one per key, the first part that has it wins."""
    tagged = [p.withColumn("source_rank", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p)
    w = Window.partitionBy(key).orderBy("source_rank")
    return out.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n").orderBy(F.col(ts).desc(), key)


def key_set_ops(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys with where they are: only_a, only_b or both."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    tag = lambda df, s: df.withColumn("where_found", F.lit(s))
    return tag(x.subtract(y), "only_a").union(tag(y.subtract(x), "only_b")).union(tag(x.intersect(y), "both"))


def union_arrays(df: DataFrame, key: str, col: str) -> DataFrame:
    """The sorted union of an array column per key (nulls in it left out); a key without values has an empty one."""
    return df.select(key, F.explode_outer(col).alias("value")).groupBy(key).agg(F.array_sort(F.collect_set("value")).alias(col))


def pack_context(parents: DataFrame, children: DataFrame, n: int) -> DataFrame:
    """Parents by relevance, then children in their parents' order, the first `n` of all.

    `parents(parent_id, relevance)`, `children(parent_id, child_id, score)`."""
    p = parents.withColumn("parent_rank", F.row_number().over(Window.orderBy(F.col("relevance").desc(), "parent_id")))  # a handful of parents
    c = children.join(p.select("parent_id", "parent_rank"), "parent_id").withColumn("child_rank", F.row_number().over(Window.partitionBy("parent_id").orderBy(F.col("score").desc(), "child_id")))
    both = p.select(F.lit("parent").alias("level"), F.col("parent_id").alias("item_id"), F.lit(0).alias("l"), "parent_rank", F.lit(0).alias("child_rank")).unionByName(c.select(F.lit("child").alias("level"), F.col("child_id").alias("item_id"), F.lit(1).alias("l"), "parent_rank", "child_rank"))
    return both.orderBy("l", "parent_rank", "child_rank").limit(n).select("level", "item_id", "parent_rank", "child_rank")
