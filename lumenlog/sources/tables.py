"""Sources, sinks and keyed writes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_samples(spark: SparkSession, path: str, streaming: bool = False, schema=None) -> DataFrame:
    """Activity samples as a batch or a file stream (its schema is read from the files if none is given)."""
    if not streaming:
        return spark.read.parquet(path)
    return spark.readStream.schema(schema or spark.read.parquet(path).schema).parquet(path)


def spans_in_range(df: DataFrame, a: str, b: str, start: str = "start_ts", end: str = "end_ts") -> DataFrame:
    """Spans that touch [a, b], by start."""
    return df.where((F.col(end) >= F.lit(a).cast("timestamp_ntz")) & (F.col(start) <= F.lit(b).cast("timestamp_ntz"))).orderBy(start, end)


def upsert_latest(base: DataFrame, new: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """Base and new rows, one per key, the last by `order` wins (new rows before old ones at a tie)."""
    both = base.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rank = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col("__new"))
    best = F.max_by(F.struct(*[F.col(f"`{c}`") for c in base.columns]), rank).alias("__row")  # a partial maximum in each task, no sort
    return both.groupBy(*[F.col(c).alias(f"__k_{c}") for c in key]).agg(best).select("__row.*")


def with_token_estimate(df: DataFrame, text: str = "text") -> DataFrame:
    """A quarter of the characters."""
    return df.withColumn("token_estimate", F.floor(F.length(text) / 4).cast("long"))


def check_source_type(col: Column, allowed: list[str]) -> Column:
    """The value, or an error if it isn't allowed."""
    return F.when(col.isin(allowed), col).otherwise(F.raise_error(F.concat(F.lit("source_type not allowed: "), F.coalesce(col, F.lit("null")))))


def overwrite_period(df: DataFrame, path: str, by: list[str]) -> None:
    """Rewrites exactly the partitions that `df` has; running it again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_notes(notes: DataFrame, path: str, ts: str = "start_ts") -> None:
    """Notes in folders by year, month and day."""
    dated = notes.withColumns({"y": F.year(ts), "m": F.month(ts), "d": F.dayofmonth(ts)})
    dated.repartition("y", "m", "d").write.mode("overwrite").partitionBy("y", "m", "d").parquet(path)


def list_notes(df: DataFrame, a: str, b: str, limit: int, ts: str = "start_ts", key: str = "note_id") -> DataFrame:
    """Notes that start in [a, b], newest first."""
    return df.where(F.col(ts).between(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz"))).orderBy(F.col(ts).desc(), key).limit(limit)


def export_summary(tables: dict[str, DataFrame | None]) -> DataFrame:
    """Rows per table; a missing table has 0."""
    spark = next(t.sparkSession for t in tables.values() if t is not None)
    out = None
    for name, t in tables.items():
        one = spark.range(1).select(F.lit(name).alias("table_name"), F.lit(0).cast("long").alias("n")) if t is None else t.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def export_bundle(tables: dict[str, DataFrame], path: str) -> DataFrame:
    """Every table as JSON lines under `path`, with a manifest of counts, which is returned."""
    for name, t in tables.items():
        t.write.mode("overwrite").option("compression", "gzip").json(f"{path}/{name}")
    manifest = export_summary(dict(tables))
    manifest.write.mode("overwrite").json(f"{path}/manifest")
    return manifest


def lookup(df: DataFrame, **eq) -> DataFrame:
    """Rows whose columns equal the given values; a DataFrame as value is a set of keys (semi join)."""
    for name, value in eq.items():
        df = df.join(value.select(F.col(value.columns[0]).alias(name)), name, "left_semi") if isinstance(value, DataFrame) else df.where(F.col(name) == F.lit(value))
    return df


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """Rows that the predicate doesn't hold for (unknown counts as not)."""
    return df.where(~F.coalesce(predicate, F.lit(False)))


def render_notes(notes: DataFrame) -> DataFrame:
    """Markdown per note of `(note_id, start_ts, summary, activities array<struct<time_start,description,app>>)`."""
    cell = lambda c: F.when(F.length(c) > 60, F.concat(F.substring(c, 1, 57), F.lit("..."))).otherwise(c)
    rows = F.transform("activities", lambda a: F.concat_ws(" | ", F.coalesce(a["time_start"], F.lit("")), F.coalesce(a["app"], F.lit("")), cell(F.coalesce(a["description"], F.lit("")))))
    text = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("note_id: "), F.col("note_id").cast("string")), F.concat(F.lit("start: "), F.date_format("start_ts", "yyyy-MM-dd HH:mm")), F.lit("---"), F.lit("## Summary"), F.coalesce("summary", F.lit("")), F.lit("## Activities"), F.array_join(rows, "\n"))
    return notes.select("note_id", text.alias("markdown"))
