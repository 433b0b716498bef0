"""Connected components of an edge list by contraction, in joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.llm.common import discard, materialize


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """`(node, component)` for every node of `edges`; the component is its smallest node id.

    Each round points every node at the neighbour (itself included) of smallest hash, another hash each round,
    rewrites the edges to those targets and drops loops. In hash order chains are short, so a path loses a constant
    share of its nodes a round and a star is gone after two. The tables of a round are written to the shared scratch
    folder, so lineage stays short. Null ids are ignored; no edges give no rows.
    """
    live = materialize(
        edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(),
        "edges",
    )
    labels = None
    for turn in range(max_rounds):
        if live.isEmpty():
            break
        both = live.select("a", "b").union(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("id"))  # noqa: B023, E731
        step = both.groupBy("a").agg(F.min(rank("b")).alias("m")).select(F.col("a").alias("node"), F.least(rank("a"), F.col("m"))["id"].alias("to"))
        step = materialize(step, "step")
        left, right = step.select(F.col("node").alias("a"), F.col("to").alias("ta")), step.select(F.col("node").alias("b"), F.col("to").alias("tb"))
        moved = live.join(left, "a").join(right, "b").where("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        moved = materialize(moved, "edges")
        if labels is None:
            merged = step.select("node", F.col("to").alias("component"))
        else:
            hop = step.select(F.col("node").alias("component"), "to")
            merged = labels.join(hop, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
        merged = materialize(merged, "labels")
        discard(live, step, *([labels] if labels is not None else []))
        live, labels = moved, merged
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    if labels is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("component"))
    least = labels.groupBy("component").agg(F.min("node").alias("least"))
    out = materialize(labels.join(least, "component").select("node", F.col("least").alias("component")), "components")
    discard(live, labels)
    return out
