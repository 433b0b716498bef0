"""Near-duplicate documents: MinHash signatures joined by a multi-index Hamming join, links confirmed on full sets."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm.common import batches, discard, materialize, mix64, table
from lumenlog.llm.components import connected_components
from lumenlog.llm.embeddings import local_roots
from lumenlog.llm.shingles import shingle_sets

POSITIONS = 64  # symbols of a signature
BITS = 16  # bits of a symbol
CHUNKS = 12  # chunks of 5 or 6 symbols, one wrong symbol allowed in each
GUARANTEED = 2 * CHUNKS - 1  # by pigeonhole some chunk of two signatures this far apart has at most one wrong symbol
FILTER = 30  # pairs further apart than this are not confirmed: at similarity 0.8 that is 5.5 deviations off, 3e-7 of the links
FIRST_CHUNKS = 3  # chunks whose keys join most links before all the others are looked at
TILE = 2048  # members of a key that are compared in one task; larger groups are dealt as pairs of tiles
SEGMENT = 20_000  # candidate pairs confirmed together at most
SEGMENT_BYTES = 48_000_000  # of the sets they are confirmed on
BROADCAST_BYTES = 16_000_000

_RNG = np.random.default_rng(20240607)
_XOR = _RNG.integers(0, 2**32, POSITIONS, dtype=np.uint32)
_MUL = _RNG.integers(0, 2**31, POSITIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def chunk_bounds(chunks: int = CHUNKS) -> list[tuple[int, int]]:
    edges = np.linspace(0, POSITIONS, chunks + 1).round().astype(int)
    return list(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True))


def signature(hashes: np.ndarray) -> np.ndarray:
    """64 minima, each of its own 32-bit permutation of the shingle hashes, cut to 16 bits."""
    h = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(POSITIONS, np.uint32(0xFFFFFFFF))
    for at in range(0, len(h), 4096):
        x = h[at : at + 4096][None, :] ^ _XOR[:, None]
        x *= _MUL[:, None]
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        np.minimum(least, x.min(axis=1), out=least)
    return ((least ^ (least >> np.uint32(16))) & np.uint32(0xFFFF)).astype(np.uint16)


def _sign(k: int):
    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in batches(items, "text"):
            sets = shingle_sets(block.column("text").to_pylist(), k)
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id").combine_chunks().cast(pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_digest(s.tobytes()) for s in sets], pa.binary()),
                    pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                ["doc_id", "n_shingles", "digest", "sig"],
            )

    return run


def _keys(first: int = 0, last: int = CHUNKS):
    """One key per chunk and left-out symbol: two chunks with at most one wrong symbol share such a key."""

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in items:
            n = batch.num_rows
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(n, POSITIONS).astype(np.uint64)
            ids, classes = batch.column("rep").to_numpy(), batch.column("c").to_numpy()
            for chunk, (a, b) in list(enumerate(chunk_bounds()))[first:last]:
                keys = []
                for out in range(a, b):
                    h = np.full(n, np.uint64(chunk * 64 + out), np.uint64)
                    for p in range(a, b):
                        if p != out:
                            h = mix64((h << np.uint64(16)) ^ (h >> np.uint64(48)) ^ sig[:, p])
                    keys.append(h)
                slots = np.repeat(np.arange(a, b, dtype=np.int8), n)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(slots), pa.array(np.tile(ids, b - a)), pa.array(np.tile(classes, b - a))], ["key", "slot", "rep", "c"])

    return run


KEYS = "key long, slot byte, rep long, c long"


def _near(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in items:
        n = batch.num_rows
        if not n:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(n, POSITIONS) for c in ("sa", "sb"))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array((x != y).sum(axis=1) <= FILTER))


def _sets(k: int):
    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in batches(items, "text"):
            sets = [x.tobytes() for x in shingle_sets(block.column("text").to_pylist(), k)]
            yield pa.RecordBatch.from_arrays([block.column("doc_id").combine_chunks().cast(pa.int64()), pa.array([_digest(x) for x in sets], pa.binary()), pa.array(sets, pa.binary())], ["doc_id", "digest", "shingles"])

    return run


def _digest(shingles: bytes) -> bytes | None:
    return hashlib.blake2b(shingles, digest_size=16).digest() if shingles else None


def _confirm(percent: int):
    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in items:
            keep = []
            for x, y in zip(batch.column("xa").to_pylist(), batch.column("xb").to_pylist(), strict=True):
                u, v = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(100 * both >= percent * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


_CHUNK_OF = np.repeat(np.arange(CHUNKS), [b - a for a, b in chunk_bounds()])
_STARTS = np.array([a for a, _ in chunk_bounds()])


def _first_key(wrong: np.ndarray) -> np.ndarray:
    """Per pair the slot of the first key that it shares, from its wrong positions (pairs x 64); -1: none."""
    per_chunk = np.add.reduceat(wrong.astype(np.uint8), _STARTS, axis=1)
    good = per_chunk <= 1
    chunk = good.argmax(axis=1)
    inside = wrong & (_CHUNK_OF[None, :] == chunk[:, None])
    slot = np.where(inside.any(axis=1), inside.argmax(axis=1), _STARTS[chunk])
    return np.where(good.any(axis=1), slot, -1)


def _group_pairs(slot: int, left: np.ndarray, right: np.ndarray, same: bool, comps, sizes, sigs, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Candidate pairs of one group in parts: of different components, like sizes and signatures, not met at an earlier key."""
    step = max(1, 200_000 // max(1, len(right)))
    for at in range(0, len(left), step):
        i = left[at : at + step]
        x, y = np.repeat(i, len(right)), np.tile(right, len(i))
        ok = (comps[x] != comps[y]) & (100 * np.minimum(sizes[x], sizes[y]) >= percent * np.maximum(sizes[x], sizes[y]))
        if same:
            ok &= x < y
        x, y = x[ok], y[ok]
        wrong = sigs[x] != sigs[y]
        near = np.flatnonzero(wrong.sum(axis=1) <= FILTER)
        near = near[_first_key(wrong[near]) == slot]
        if len(near):
            yield x[near], y[near]


def _parts(x: np.ndarray, y: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """The pairs in parts of at most SEGMENT whose distinct members' sets hold at most SEGMENT_BYTES, and those bytes."""
    todo = [np.arange(at, min(len(x), at + SEGMENT)) for at in range(0, len(x), SEGMENT)][::-1]
    while todo:
        part = todo.pop()
        weight = 8 * int(sizes[np.unique(np.concatenate([x[part], y[part]]))].sum())
        if weight > SEGMENT_BYTES and len(part) > 1:
            todo += [part[len(part) // 2 :], part[: len(part) // 2]]
        else:
            yield part, weight


def _pairs(percent: int):
    """Rows sorted by group (key, i, j) to segments: rows of about SEGMENT candidate pairs, each pair at one key only."""

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, xs, ys, held, size = TaskContext.get().partitionId() << 32, [], [], 0, 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([number]), pa.array([np.concatenate(xs)]), pa.array([np.concatenate(ys)])], ["segment", "xs", "ys"])

        tail: pa.Table | None = None
        for batch in itertools.chain(_regrouped(items), [None]):
            if batch is None:
                rows, tail = tail, None
            else:
                rows = pa.Table.from_batches([batch]) if tail is None else pa.concat_tables([tail, pa.Table.from_batches([batch])])
            if rows is None or not rows.num_rows:
                continue
            key, a, b = (rows.column(c).to_numpy() for c in ("key", "i", "j"))
            first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
            ends = np.append(first[1:], len(key))
            if batch is not None:  # the last group may go on in the next batch
                tail = rows.slice(int(first[-1]))
                first, ends = first[:-1], ends[:-1]
            ids, comps, sizes, tile, slot = (rows.column(c).to_numpy() for c in ("rep", "c", "n", "tile", "slot"))
            sigs = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint16).reshape(-1, POSITIONS)
            for p, q in zip(first.tolist(), ends.tolist(), strict=True):
                every, same = np.arange(p, q), a[p] == b[p]
                left, right = (every, every) if same else (every[tile[p:q] == a[p]], every[tile[p:q] == b[p]])
                for x, y in _group_pairs(int(slot[p]), left, right, same, comps, sizes, sigs, percent):
                    for part, weight in _parts(x, y, sizes):
                        if xs and (held + len(part) > SEGMENT or size + weight > SEGMENT_BYTES):
                            yield out()
                            number, xs, ys, held, size = number + 1, [], [], 0, 0
                        xs.append(ids[x[part]])
                        ys.append(ids[y[part]])
                        held, size = held + len(part), size + weight
        if xs:
            yield out()

    return run


def _regrouped(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (b for b in items if b.num_rows)


def _overlap(u: np.ndarray, v: np.ndarray) -> int:
    both = np.concatenate([u, v])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _settle(percent: int):
    """A segment's pairs against its members' full sets: a star forest of the links found."""

    def run(key: tuple, pairs: pa.Table, members: pa.Table) -> pa.Table:
        sets = {d: np.frombuffer(s, np.uint64) for d, s in zip(members.column("rep").to_pylist(), members.column("shingles").to_pylist(), strict=True)}
        a, b = [], []
        for xs, ys in zip(pairs.column("xs").to_pylist(), pairs.column("ys").to_pylist(), strict=True):
            for x, y in zip(xs, ys, strict=True):
                u, v = sets[x], sets[y]
                both = _overlap(u, v)
                if 100 * both >= percent * (len(u) + len(v) - both):
                    a.append(x)
                    b.append(y)
        ids, at = np.unique(np.array(a + b, np.int64), return_inverse=True)
        root = local_roots(len(ids), at[: len(a)], at[len(a) :], ids)
        return pa.table({"a": pa.array(ids, pa.int64()), "b": pa.array(root, pa.int64())})

    return run


def _full_sets(docs: DataFrame, reps: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """`rep, shingles` of the sets named in `wanted(rep)`: of the texts of their documents the one with that digest.

    What is looked for is broadcast only if its counted size is small."""
    named = materialize(reps.join(wanted, "rep", "left_semi").select("rep", "doc_id", "digest"), "named")
    few = named.count() * 64 <= BROADCAST_BYTES
    small = F.broadcast(named) if few else named
    texts = docs.join(small.select("doc_id"), "doc_id", "left_semi")
    made = texts.mapInArrow(_sets(k), "doc_id long, digest binary, shingles binary").join(small, ["doc_id", "digest"])
    out = materialize(made.groupBy("rep").agg(F.first("shingles").alias("shingles")), "sets")
    discard(named)
    return out


def _links(pairs: DataFrame, docs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose signatures are near and whose full shingle sets reach the similarity."""
    sigs = reps.select("rep", "sig")
    signed = pairs.join(sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sa")), "a").join(sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sb")), "b")
    near = materialize(signed.select("a", "b", "sa", "sb").mapInArrow(_near, "a long, b long"), "near")
    sets = _full_sets(docs, reps, near.select(F.col("a").alias("rep")).union(near.select("b")).distinct(), k)
    full = near.join(sets.select(F.col("rep").alias("a"), F.col("shingles").alias("xa")), "a").join(sets.select(F.col("rep").alias("b"), F.col("shingles").alias("xb")), "b")
    out = materialize(full.select("a", "b", "xa", "xb").mapInArrow(_confirm(percent), "a long, b long"), "links")
    discard(near, sets)
    return out


def _links_across(rows: DataFrame, docs: DataFrame, reps: DataFrame, k: int, percent: int) -> DataFrame:
    """Links between components among the members `rows(key, slot, rep, c, n, sig)` of keys, as a star forest."""
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    dealt = rows.join(sizes, "key").withColumn("tile", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    one = dealt.where("tiles = 1").select("key", "slot", "rep", "c", "n", "sig", "tile", F.lit(0).alias("i"), F.lit(0).alias("j"))
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("other")
    many = dealt.where("tiles > 1").select("key", "slot", "rep", "c", "n", "sig", "tile", other)
    many = many.select("key", "slot", "rep", "c", "n", "sig", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
    groups = one.union(many).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    segments = materialize(groups.mapInArrow(_pairs(percent), "segment long, xs array<long>, ys array<long>"), "segments")
    members = segments.select(F.col("segment").alias("of"), F.explode(F.array_distinct(F.concat("xs", "ys"))).alias("rep"))
    sets = _full_sets(docs, reps, members.select("rep").distinct(), k)
    held = members.join(sets, "rep").select("of", "rep", "shingles")
    out = materialize(segments.groupBy("segment").cogroup(held.groupBy("of")).applyInArrow(_settle(percent), "a long, b long"), "across")
    discard(segments, sets)
    return out


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of `docs(doc_id, text)`: `doc_id, n_shingles, component_id, kept`.

    Documents whose sets of k-word shingles have 100*intersection >= percent*union are linked; a component is what
    links reach, its id the smallest doc_id in it, and only that document is kept.

    1. One signature and one 128-bit digest of the whole set per document; equal sets fold into one representative.
    2. Each signature of 64 16-bit minima is split into 12 chunks; a key per chunk and left-out symbol enumerates the
       one error a chunk may hold, so all pairs up to 23 wrong symbols of 64 share a key. At similarity 0.8 a pair
       shares none with a probability of 3e-7; with those that `FILTER` leaves out, about 6e-7 are missed at most.
    3. By the keys of the first three chunks every member is tried with its group's smallest one, links are confirmed
       on full sets and joined to components. Most links are within those.
    4. The keys of all chunks then carry the component of their member. A group of one component has nothing left to
       find, an aggregation drops it. Of the others only pairs across components are compared, as all others already
       reach each other: inside tasks, tile by tile, each pair at the first key that it shares; rows leave only as
       lists of candidates and as star forests of links. Texts alike but below the threshold are the costly case.

    Empty or null texts have no shingles and link with nothing. Rows that share an id count as one node: whatever
    links one of their texts has, all of them have. A row without an id links with nothing, has no component and is
    kept. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = materialize(docs.mapInArrow(_sign(k), "doc_id long, n_shingles long, digest binary, sig binary"), "signed")
    named = signed.where("digest is not null and doc_id is not null")
    reps = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.min_by("sig", "doc_id").alias("sig"), F.max("n_shingles").alias("n"))
    reps = materialize(reps.withColumn("rep", F.monotonically_increasing_id()), "reps")  # written: ids of a lazy plan could change
    keys = materialize(reps.select("rep", "sig", F.col("rep").alias("c")).mapInArrow(_keys(0, FIRST_CHUNKS), KEYS), "keys")
    heads = keys.groupBy("key").agg(F.min("rep").alias("head"), F.max("rep").alias("last")).where("head < last").select("key", "head")
    stars = keys.join(heads, "key").where("rep <> head").select(F.col("head").alias("a"), F.col("rep").alias("b")).distinct()
    near = _links(stars, docs, reps, k, percent)
    links = near.union(_shared_ids(named, reps))
    first = connected_components(links)
    labelled = reps.join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("c", F.coalesce("component", "rep"))
    every = materialize(labelled.select("rep", "sig", "c").mapInArrow(_keys(), KEYS), "keys")
    mixed = every.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo < hi").select("key")
    left = every.join(mixed, "key").join(reps.select("rep", "n", "sig"), "rep")
    more = _links_across(left, docs, reps, k, percent)
    found = connected_components(links.union(more))
    classes = reps.select("digest", "rep", "doc_id").join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("class", F.coalesce("component", "rep"))
    least = classes.groupBy("class").agg(F.min("doc_id").alias("least"))
    to = classes.join(least, "class").select("digest", "least")
    out = signed.select("doc_id", "n_shingles", "digest").join(to, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    out = materialize(out, "classes")
    discard(signed, reps, keys, near, every, more, first, found)
    return out


def _shared_ids(named: DataFrame, reps: DataFrame) -> DataFrame:
    """Links between the sets of different texts that share an id."""
    several = named.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo < hi").select("doc_id")
    theirs = named.select("doc_id", "digest").join(several, "doc_id").join(reps.select("digest", "rep"), "digest").select("doc_id", "rep")
    return theirs.join(theirs.groupBy("doc_id").agg(F.min("rep").alias("a")), "doc_id").where("a <> rep").select("a", F.col("rep").alias("b"))


def drop_near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` whose document is the kept one of its component, with the columns of `docs`."""
    gone = near_duplicates(docs, k, percent).where("not kept").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


OP2_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(list_slice(ws, i, i + 3), ' '))) END AS sh
  FROM w
), e AS MATERIALIZED (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s
), p AS MATERIALIZED (
  SELECT x.doc_id AS a, y.doc_id AS b FROM e x JOIN e y ON x.g = y.g AND x.doc_id < y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), l AS (
  SELECT a, b FROM p UNION ALL SELECT b, a FROM p
), r AS (
  SELECT doc_id AS node, doc_id AS reach FROM documents
  UNION
  SELECT r.node, l.b FROM r JOIN l ON r.reach = l.a
)
SELECT s.doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, m.component_id, s.doc_id = m.component_id AS kept
FROM s JOIN (SELECT node, min(reach) AS component_id FROM r GROUP BY node) m ON m.node = s.doc_id
"""
