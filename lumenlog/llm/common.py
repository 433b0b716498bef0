"""Helpers shared by the training-data operators: shared scratch tables, word splitting, block iteration."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_SPLIT = r"[\x20\x09-\x0D]+"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the session names in spark.checkpoint.dir; a local one only where none is set and all runs in this process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    base = base or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lumenlog-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` as a table in the shared scratch folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/lumenlog-{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lumenlog_path = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete tables made by `materialize` that no later plan reads."""
    for df in frames:
        path = getattr(df, "_lumenlog_path", None)
        if path:
            jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(sc._jsc.hadoopConfiguration()).delete(target, True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batches(items: Iterator[pa.RecordBatch], text: str, limit: int = 6_000_000) -> Iterator[pa.Table]:
    """Regroup Arrow batches into tables of about `limit` text bytes (never splitting a row)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in items:
        if batch.num_rows == 0:
            continue
        at = 0
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0)).astype(np.int64)
        while at < batch.num_rows:
            room = max(1, int(np.searchsorted(np.cumsum(lengths[at:]), limit - size)) if limit > size else 1)
            part = batch.slice(at, room)
            size += int(lengths[at : at + room].sum())
            at += part.num_rows
            held.append(part)
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def words_of(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """Lower-cased (A-Z) words of all texts in one list, and the number of words of each text.

    `bytes.split` parts at exactly the bytes 0x20 and 0x09 to 0x0D."""
    flat: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            w = t.encode("utf-8", "surrogatepass").lower().split()
            counts[i] = len(w)
            flat += w
    return flat, counts


def encode_words(flat: list[bytes]) -> tuple[pa.Array, np.ndarray]:
    """Distinct words and, per word, its index among them."""
    if not flat:
        return pa.array([], pa.binary()), np.zeros(0, np.int64)
    coded = pa.array(flat, pa.binary()).dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 (public domain), elementwise."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= _M1
    x ^= x >> np.uint64(33)
    x *= _M2
    x ^= x >> np.uint64(33)
    return x


def word_count(text: str = "text"):
    """Column: the number of words of a text (null: 0)."""
    trimmed = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, WORD_SPLIT))).cast("long")


def tie_ids(df: DataFrame, *cols: str) -> DataFrame:
    """Only `cols`, so that extra columns whose names clash with an operator's own can't reach its joins."""
    return df.select(*[F.col(f"`{c}`") for c in cols])
