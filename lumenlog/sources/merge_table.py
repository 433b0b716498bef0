"""Keyed tables kept up by increments: each batch adds what it has, readers merge, folding keeps that short.

A table is a folder of segments, `segments/segment=<n>/bucket=<b>/`, and a folder of manifests. A batch writes one
segment with only the buckets that its rows fall in, so what is written follows the batch and not the table. A manifest
names, for each bucket, the segments that are live and how many rows each has; it is put in place last, by a rename, so
a batch is in the table as a whole or not at all, and the same batch run twice leaves the same rows. Readers take the
newest manifest and merge the live segments of the buckets they ask for; other buckets are not opened."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Merge = Callable[[DataFrame], DataFrame]


def keep_latest(key: list[str], order: list[str]) -> Merge:
    """The row of each key that is last by `order`, then by segment: a partial maximum in each task, no sort."""

    def merge(rows: DataFrame) -> DataFrame:
        names = [c for c in rows.columns if c != "segment"]
        best = F.max_by(F.struct(*[F.col(f"`{c}`") for c in names], "segment"), F.struct(*order, "segment")).alias("__row")
        return rows.groupBy(*[F.col(c).alias(f"__k_{c}") for c in key]).agg(best).select("__row.*")

    return merge


class MergeTable:
    """A table under `path`. `bucket`: a column of whole numbers or dates, as text, from the rows; `merge`: folds rows
    that belong together to what is kept of them, and can be applied again to its own results.

    A bucket with more than `max_segments` live segments is folded by the batch that makes it so: all into one if what
    was added has at least a quarter of the rows of the first, else only what was added. So a row is written again
    about as often as the logarithm of the table over the batch. Manifests and segments of the `keep` last versions stay
    for readers that began before. Batches come one after another, with rising ids, as foreachBatch gives them."""

    def __init__(self, spark: SparkSession, path: str, merge: Merge, bucket: Column, max_segments: int = 6, keep: int = 3, about: dict | None = None):
        self.spark, self.path, self.merge, self.bucket, self.about = spark, path.rstrip("/"), merge, bucket, about
        self.max_segments, self.keep = max_segments, keep

    # Files

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        folder, fs = self._fs(f"{self.path}/manifests")
        if not fs.exists(folder):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, before: int | None = None) -> dict:
        """The newest manifest, or the newest of the batches before one: `{"schema", "live": {bucket: [[segment, rows], ...]}}`."""
        there = [v for v in self.versions() if before is None or v < before]
        if not there:
            return {"version": -1, "schema": None, "live": {}}
        p, fs = self._fs(f"{self.path}/manifests/{there[-1]}.json")
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def _commit(self, manifest: dict) -> None:
        target, fs = self._fs(f"{self.path}/manifests/{manifest['version']}.json")
        draft, _ = self._fs(f"{self.path}/manifests/{manifest['version']}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        fs.delete(target, False)
        if not fs.rename(draft, target):
            raise OSError(f"could not put {target} in place")

    # Reading

    def _segments(self, live: dict, schema: str) -> DataFrame:
        """Rows of the named segments, with `segment` and `bucket`; opens only their folders."""
        paths = [f"{self.path}/segments/segment={s}/bucket={b}" for b, parts in sorted(live.items()) for s, _ in parts]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, segment long, bucket string")
        return self.spark.read.schema(f"{schema}, segment long, bucket string").option("basePath", f"{self.path}/segments").parquet(*paths)

    def read(self, buckets: list[str] | None = None, version: int | None = None) -> DataFrame | None:
        """The table, or some buckets of it, as its last batch left it (or batch `version`); None before the first."""
        m = self.manifest(None if version is None else version + 1)
        if m["schema"] is None:
            return None
        live = m["live"] if buckets is None else {b: m["live"][b] for b in map(str, buckets) if b in m["live"]}
        return self.merge(self._segments(live, m["schema"]).drop("bucket")).drop("segment")

    def dirty(self, since: int) -> list[str]:
        """Buckets that batches after `since` have touched: what derived results have to be made anew for."""
        return sorted(b for b, touched in self.manifest().get("touched", {}).items() if touched > since)

    # Writing

    def apply(self, batch: DataFrame, batch_id: int, replace: bool = False) -> list[str]:
        """Adds a batch (or, with `replace`, makes it all that its buckets hold) and returns the buckets it touched."""
        if {"segment", "bucket"} & set(batch.columns):
            raise ValueError("columns of a merged table can't be named segment or bucket")
        m = self.manifest(batch_id)
        schema = m["schema"] or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in batch.schema)
        segment = 2 * batch_id  # even: as batches gave them; odd: folded
        rows = self.merge(batch.withColumn("segment", F.lit(segment).cast("long"))).drop("segment")
        touched = self._write(rows, segment)
        live = {b: list(parts) for b, parts in m["live"].items()}
        for b, n in touched.items():
            live[b] = ([] if replace else live.get(b, [])) + [[segment, n]]
        full = {b: p for b, p in live.items() if len(p) > self.max_segments}
        if full:
            whole = {b: p for b, p in full.items() if 4 * sum(n for _, n in p[1:]) >= p[0][1]}
            folded = {b: p if b in whole else p[1:] for b, p in full.items()}
            made = self._write(self.merge(self._segments(folded, schema).drop("bucket")).drop("segment"), segment + 1)
            for b in full:
                live[b] = (full[b][:0] if b in whole else full[b][:1]) + [[segment + 1, made[b]]]
        history = {**m.get("touched", {}), **dict.fromkeys(touched, batch_id)}
        self._commit({"version": batch_id, "schema": schema, "live": live, "touched": history, "about": self.about})
        self._forget()
        return sorted(touched)

    def _write(self, rows: DataFrame, segment: int) -> dict[str, int]:
        """Writes a segment by bucket, over what an earlier try left, and returns its rows by bucket."""
        target = f"{self.path}/segments/segment={segment}"
        rows.withColumn("bucket", self.bucket.cast("string")).hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        p, fs = self._fs(target)
        if not any(x.isDirectory() for x in fs.listStatus(p)):
            return {}  # an empty batch
        counted = self.spark.read.schema("bucket string").parquet(target).groupBy("bucket").count().collect()  # from the files' footers
        return {r["bucket"]: r["count"] for r in counted}

    def _forget(self) -> None:
        """Removes manifests older than the last `keep` and the segments that none of those names."""
        old = self.versions()[: -self.keep]
        if not old:
            return
        needed = set()
        for v in self.versions()[-self.keep :]:
            needed |= {s for parts in self.manifest(v + 1)["live"].values() for s, _ in parts}
        folder, fs = self._fs(f"{self.path}/segments")
        for x in fs.listStatus(folder):
            n = int(x.getPath().getName().split("=")[1])
            if n not in needed and n < 2 * self.versions()[-1]:
                fs.delete(x.getPath(), True)
        for v in old:
            p, _ = self._fs(f"{self.path}/manifests/{v}.json")
            fs.delete(p, False)


def hash_bucket(key: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*key), buckets)
