"""Document fingerprints by content-defined chunking: gear-hash boundaries, chunk digests weighted by length."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm.common import shuffle_partitions, table

LEAST, NORMAL, MOST = 16, 32, 128  # bytes of a chunk
STRICT, LOOSE = 6, 3  # bits that must be zero before and after the normal size
WINDOW = 16  # bytes that the gear hash sees
GEAR = np.random.default_rng(77).integers(0, 2**32, 256, dtype=np.uint32)


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = sum over the last 16 bytes of gear(byte) << 2*age, by doubling the window four times."""
    h = GEAR[data]
    width = 1
    while width < WINDOW:
        older = h[:-width] << np.uint32(2 * width)
        h = h.copy()
        h[width:] += older
        width *= 2
    return h


def boundaries(data: np.ndarray) -> np.ndarray:
    """Ends of the chunks of one text: normalised chunking picks the first boundary after the least size, by a stricter
    mask up to the normal size and a looser one beyond, and cuts at the most."""
    n = len(data)
    if n <= LEAST:
        return np.array([n] if n else [], np.int64)
    top = gear_hashes(data) >> np.uint32(32 - STRICT)
    loose = np.flatnonzero((top >> np.uint32(STRICT - LOOSE)) == 0) + 1
    is_strict = top[loose - 1] == 0
    strict = loose[is_strict].tolist()
    loose = loose.tolist()
    ends, start, i, j = [], 0, 0, 0
    while n - start > LEAST:
        low, normal, high = start + LEAST, start + NORMAL, start + MOST
        while i < len(strict) and strict[i] < low:
            i += 1
        if i < len(strict) and strict[i] <= normal:
            end = strict[i]
        else:
            while j < len(loose) and loose[j] <= normal:
                j += 1
            end = loose[j] if j < len(loose) and loose[j] <= high else high
        if end >= n:
            break
        ends.append(end)
        start = end
    ends.append(n)
    return np.array(ends, np.int64)


def chunk_set(text: str) -> dict[int, int]:
    """32-bit digests of the distinct chunks of a text and the bytes of each."""
    data = text.encode("utf-8", "surrogatepass")
    out: dict[int, int] = {}
    start = 0
    for end in boundaries(np.frombuffer(data, np.uint8)).tolist():
        out[xxhash.xxh32_intdigest(data[start:end])] = end - start
        start = end
    return out


def fingerprint(chunks: dict[int, int]) -> str:
    """The set in order of digest, ten hex digits a chunk: digest and length."""
    return "".join(f"{d:08x}{n:02x}" for d, n in sorted(chunks.items()))


def parse(fp: str) -> dict[int, int]:
    return {int(fp[i : i + 8], 16): int(fp[i + 8 : i + 10], 16) for i in range(0, len(fp), 10)}


def likeness(a: dict[int, int], b: dict[int, int]) -> float:
    """Bytes in shared chunks by the bytes of the smaller set: 1 if it is contained in the other. Both empty: 1."""
    if not a or not b:
        return float(not a and not b)
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    shared = sum(n for d, n in small.items() if d in large)
    return shared / min(sum(a.values()), sum(b.values()))


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited(text: str, following: str) -> str:
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _walk(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, each bucket closed by its `mark` row (the next bucket's first text): every document meets its next."""
    names = [c.split()[0] for c in OUT.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    held: tuple | None = None
    rows: list[tuple] = []
    size = 0
    for batch in items:
        for doc, text, mark in zip(*[batch.column(c).to_pylist() for c in ("doc_id", "text", "mark")], strict=True):
            text = text or ""
            chunks = chunk_set(text)
            if held is not None:
                last, own, mine = held
                new = edited(own, text)
                theirs = chunk_set(new)
                rows.append((last, len(own), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), fingerprint(mine), fingerprint(theirs), likeness(mine, theirs), likeness(mine, chunks)))
                size += len(own)
            held = None if mark else (doc, text, chunks)
            if size > 8_000_000 or len(rows) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def fingerprint_edits(docs: DataFrame, buckets: int | None = None) -> DataFrame:
    """Per row of `docs(doc_id, text)` its fingerprint, that of its edited text, and its likeness to that and to the next.

    The next document is the one before in falling order of (doc_id, text), null ids last; after the last comes the
    first, so a lone document follows itself. Null texts are empty; an empty text has the empty fingerprint, alike
    only to another empty one (1). Rows that repeat follow each other. An empty table gives no rows.

    Ids are dealt to ranges by approximate quantiles (a few numbers), texts move once, and each range gets the first
    text of the next one as a closing row, so no global sort or single task is needed.
    """
    spark = docs.sparkSession
    n = buckets or max(8, shuffle_partitions(spark))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    cuts = rows.select("doc_id").where("doc_id is not null").agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts), reverse=True)
    steps = [1 << i for i in range(len(cuts).bit_length())][::-1]  # a binary search for the number of cuts above the id
    above = lambda at, step: (at + step <= len(cuts)) & (F.get(F.lit(cuts), at + step - 1) > F.col("doc_id"))
    below = F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(above(at, step), at + step).otherwise(at)) if cuts else F.lit(0)
    bucket = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(below)
    dealt = rows.withColumn("bucket", bucket.cast("int"))
    first = dealt.groupBy("bucket").agg(F.max(F.struct("doc_id", "text")).alias("x"))
    there = sorted(r.bucket for r in dealt.select("bucket").distinct().collect())  # at most `buckets` numbers
    if not there:
        return spark.createDataFrame([], OUT)
    before = {b: there[i - 1] for i, b in enumerate(there)}
    owner = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    marks = first.select(F.col("x.doc_id").alias("doc_id"), F.col("x.text").alias("text"), owner[F.col("bucket")].alias("bucket"), F.lit(True).alias("mark"))
    every = dealt.select("doc_id", "text", "bucket", F.lit(False).alias("mark")).unionByName(marks)
    placed = every.repartitionByRange(n, "bucket").sortWithinPartitions("bucket", "mark", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    return placed.select("doc_id", "text", "mark").mapInArrow(_walk, OUT)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_edits(table(spark, sf_dir, "documents"))
