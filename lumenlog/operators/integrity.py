"""Integrity, retention and backfill: all days in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlog.operators.joins import orphan_edges, orphan_links

SEVERITY = {"invalid_json": "error", "missing_embedding": "warning", "missing_daily_note": "warning", "orphaned_edge": "error", "orphaned_link": "error"}


def integrity_issues(notes: DataFrame, embeddings: DataFrame, entities: DataFrame, links: DataFrame, edges: DataFrame, with_embeddings: bool = True) -> DataFrame:
    """`(day, issue, item)` of notes `(note_id, note_type, start_ts, payload)` and what hangs on them."""
    day = F.to_date("start_ts")
    item = lambda df, issue, key: df.select(day.alias("day"), F.lit(issue).alias("issue"), F.col(key).cast("string").alias("item"))
    out = item(notes.where(F.expr("try_parse_json(payload) is null")), "invalid_json", "note_id")
    if with_embeddings:
        out = out.unionByName(item(notes.join(embeddings.select("note_id"), "note_id", "left_anti"), "missing_embedding", "note_id"))
    days = notes.where("note_type = 'hour'").select(day.alias("day")).distinct()
    daily = notes.where("note_type = 'day'").select(day.alias("day")).distinct()
    out = out.unionByName(days.join(daily, "day", "left_anti").select("day", F.lit("missing_daily_note").alias("issue"), F.col("day").cast("string").alias("item")))
    loose = orphan_links(links, entities).join(notes.select("note_id", "start_ts"), "note_id")
    out = out.unionByName(loose.select(day.alias("day"), F.lit("orphaned_link").alias("issue"), F.concat_ws("-", F.col("note_id").cast("string"), F.col("entity_id").cast("string")).alias("item")))
    ends = orphan_edges(edges, entities)
    return out.unionByName(ends.select(day.alias("day"), F.lit("orphaned_edge").alias("issue"), F.concat_ws("-", "role", F.col("from_id").cast("string"), F.col("to_id").cast("string")).alias("item")))


def integrity_report(issues: DataFrame, days: DataFrame) -> DataFrame:
    """Per day the number of each issue, of errors, and whether it passed (no errors)."""
    counts = [F.count_if(F.col("issue") == i).alias(i) for i in SEVERITY]
    errors = F.count_if(F.col("issue").isin([i for i, s in SEVERITY.items() if s == "error"])).alias("errors")
    got = issues.groupBy("day").agg(*counts, errors)
    out = days.select("day").distinct().join(got, "day", "left")
    return out.select("day", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in [*SEVERITY, "errors"]]).withColumn("passed", F.col("errors") == 0)


def safe_days(report: DataFrame) -> DataFrame:
    """Days that may be deleted."""
    return report.where("passed").select("day")


def purge(df: DataFrame, safe: DataFrame, retention_days: int, now: str, ts: str = "ts", dry_run: bool = False, force: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows that stay, rows deleted per day): rows older than the retention whose day is safe, or all of them if
    forced; a dry run only counts."""
    day = F.to_date(ts)
    old = day < F.date_sub(F.to_date(F.lit(now).cast("timestamp_ntz")), retention_days)
    rows = df.withColumn("day", day)
    gone = rows.where(old) if force else rows.where(old).join(safe, "day", "left_semi")
    log = gone.groupBy("day").agg(F.count("*").alias("deleted"))
    if dry_run:
        return df, log
    kept = rows.where(~old) if force else rows.where(~old).unionByName(rows.where(old).join(safe, "day", "left_anti"))
    return kept.drop("day"), log


def log_deletions(log: DataFrame, table: str, path: str) -> None:
    """Deletions appended to the audit table."""
    log.select(F.lit(table).alias("table_name"), "day", "deleted").write.mode("append").parquet(path)


def deletion_history(df: DataFrame, n: int) -> DataFrame:
    """The newest entries of the audit table."""
    return df.orderBy(F.col("day").desc(), "table_name").limit(n)


def audit_constraints(df: DataFrame, domains: dict[str, list[str]], ranges: dict[str, tuple[float, float]], key: list[str]) -> DataFrame:
    """`(rule, violations)` for allowed values, ranges and unique keys."""
    rules = [F.count_if(~F.coalesce(F.col(c).isin(v), F.lit(False))).alias(f"domain_{c}") for c, v in domains.items()]
    rules += [F.count_if(~F.coalesce(F.col(c).between(*r), F.lit(False))).alias(f"range_{c}") for c, r in ranges.items()]
    one = df.agg(*rules, F.count("*").alias("__rows"))
    twice = df.groupBy(*key).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("unique_key"))
    names = [f"domain_{c}" for c in domains] + [f"range_{c}" for c in ranges] + ["unique_key"]
    wide = one.join(twice, F.lit(True))
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).cast("long").alias("violations")) for n in names])).alias("x")).select("x.*")


def missing_hours(activity: DataFrame, notes: DataFrame, now: str, least: int = 5, n: int = 10) -> DataFrame:
    """Hours before the current one with at least `least` rows of `activity(ts)` and no hour note
    (`notes(hour)`), oldest first."""
    hours = activity.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("rows")).where(F.col("rows") >= least)
    current = F.date_trunc("hour", F.lit(now).cast("timestamp_ntz")).cast("timestamp_ntz")
    return hours.where(F.col("hour") < current).join(notes.select("hour"), "hour", "left_anti").orderBy("hour").limit(n)


def pending_windows(candidates: DataFrame, done: DataFrame, key: list[str], force: bool = False) -> DataFrame:
    """Windows not done yet; all if forced."""
    return candidates if force else candidates.join(done.select(*key), key, "left_anti")
