"""Joins of intervals of any length: each interval stands at the level of a binary time tree that fits its length.

At that level it touches two nodes at most, and at each higher one too. So a point or a shorter interval looks at the
levels that occur on the other side, some dozen at most, and no interval makes a row for each hour that it lasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TICK = 20  # bits: the lowest level is about a second, 2^20 microseconds


def _tick(ts: str) -> Column:
    return F.shiftright(F.unix_micros(F.col(ts).cast("timestamp")), TICK)


def _levels(df: DataFrame) -> list[int]:
    """The levels that occur: 64 at most, however many rows there are."""
    return sorted(r[0] for r in df.select("home").distinct().collect())


def _homed(df: DataFrame, start: str, end: str) -> DataFrame:
    """With `t0, t1` (first and last tick) and `home`: the level whose nodes are as long as the interval."""
    rows = df.withColumns({"t0": _tick(start), "t1": F.greatest(_tick(start), _tick(end))})
    return rows.withColumn("home", F.ceil(F.log2(F.col("t1") - F.col("t0") + 1)).cast("int"))


def _nodes(level: Column) -> Column:
    at = lambda t: F.call_function("shiftright", F.col(t), level)
    return F.array_distinct(F.array(at("t0"), at("t1")))


def overlap_join(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Pairs of intervals `(key, id, start_ts, end_ts)` that overlap, with the seconds they share, each once.

    A pair meets at the home level of the longer one, in the node where what they share begins. Empty intervals and
    ones with null ends or keys overlap nothing."""
    named = lambda df, x: df.select(F.col(key), F.col("id").alias(f"{x}_id"), F.col("start_ts").alias(f"{x}_start"), F.col("end_ts").alias(f"{x}_end")).where(f"{x}_start < {x}_end")
    a, b = (_homed(named(df, x), f"{x}_start", f"{x}_end") for df, x in ((a, "a"), (b, "b")))

    def at_home(df: DataFrame, x: str) -> DataFrame:
        return df.select(key, f"{x}_id", f"{x}_start", f"{x}_end", F.col("t0").alias(f"{x}0"), F.col("home").alias("level"), F.explode(_nodes(F.col("home"))).alias("node"))

    def above(df: DataFrame, x: str, levels: list[int], least: int) -> DataFrame:
        up = df.select("*", F.explode(F.array(*[F.lit(n) for n in levels])).alias("level")) if levels else df.withColumn("level", F.lit(0)).limit(0)
        up = up.where(F.col("level") >= F.col("home") + least)
        return up.select(key, f"{x}_id", f"{x}_start", f"{x}_end", F.col("t0").alias(f"{x}0"), "level", F.explode(_nodes(F.col("level"))).alias("node"))

    on = [key, "level", "node"]
    rows = at_home(a, "a").join(above(b, "b", _levels(a), 0), on).unionByName(above(a, "a", _levels(b), 1).join(at_home(b, "b"), on))
    first = F.call_function("shiftright", F.greatest("a0", "b0"), F.col("level"))
    rows = rows.where((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")) & (F.col("node") == first))
    start, end = F.greatest("a_start", "b_start"), F.least("a_end", "b_end")
    return rows.withColumn("seconds", F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))).select(key, "a_id", "b_id", "seconds")


def points_in_intervals(points: DataFrame, spans: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    """J01 for spans of any length: every point with the spans of its key that hold it ([start, end)); points without one
    have nulls. A point looks up one node at each level that spans have."""
    s = _homed(spans.select(F.col(key).alias("s_key"), "span_id", "start_ts", "end_ts").where("start_ts < end_ts"), "start_ts", "end_ts")
    levels = _levels(s)
    homes = s.select("s_key", "span_id", "start_ts", "end_ts", F.col("home").alias("level"), F.explode(_nodes(F.col("home"))).alias("node"))
    names = points.columns
    look = F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright(F.unix_micros(F.col(ts).cast("timestamp")), TICK + n).alias("node")) for n in levels] or [F.struct(F.lit(-1).alias("level"), F.lit(0).cast("long").alias("node"))])
    asked = points.select("*", F.explode(look).alias("__x")).select(*names, F.col("__x.level").alias("level"), F.col("__x.node").alias("node"))
    on = (F.col(key) == F.col("s_key")) & (asked["level"] == homes["level"]) & (asked["node"] == homes["node"]) & (F.col(ts) >= F.col("start_ts")) & (F.col(ts) < F.col("end_ts"))
    found = asked.join(homes, on).select(*names, "span_id", "start_ts", "end_ts")
    # Points equal in all columns meet the same spans, so what has met none is told by the hashes of all columns.
    mark = lambda df: df.withColumns({"__h1": F.xxhash64(*names), "__h2": F.xxhash64(F.lit(1), *names)})
    met = mark(found).select("__h1", "__h2").distinct()
    types = {f.name: f.dataType for f in found.schema}
    alone = mark(points).join(met, ["__h1", "__h2"], "left_anti").select(*names, *[F.lit(None).cast(types[c]).alias(c) for c in ("span_id", "start_ts", "end_ts")])
    return found.unionByName(alone)
