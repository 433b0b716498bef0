"""Conversation prefix trie: digests of prefixes, screened by a count-min sketch, so that only what may be shared is shuffled."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlog.llm.common import discard, materialize, mix64, shuffle_partitions, table

PIECE = 10  # bits: turns of a conversation that are put in order together
SLOT_BITS = (12, 26)  # least and most bits of a slot: the sketch that is sent to all tasks has 16 MiB at most
LOAD = 4  # slots a prefix, up to the most
BLOCK = 12  # bits of the slots of a block, the unit in which counters are added up
FLUSH = 4_000_000  # slots a task holds before it sends their counters
CHUNK = 512  # ids of a piece of text to be hashed
MODULUS, SPREAD = 100, 6  # the query's rebuilding: turns of conversation c - c%100, as many as crc32(c)%6
_KEY = ["d", "k1", "k2"]
_NO_ENDS = hashlib.sha256(b"").hexdigest()


# Order and rebuilding -------------------------------------------------------------------------------------------------


def digested(conversations: DataFrame) -> DataFrame:
    """`conv_id, turn, g, n_chars`: 128 bits of role and text, and the code points of the text; texts go no further."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    g = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return rows.where("conv_id is not null").select("conv_id", "turn", g.alias("g"), F.length(text).cast("long").alias("n_chars"))


def ordered(turns: DataFrame, heads: Column, base: Column) -> tuple[DataFrame, DataFrame]:
    """Rows with `pos` (from 1), `d` (the depth after rebuilding, null: replaced) and `t` (the rebuilt depth), and conversations `conv_id, h, m, t`.

    Turns go by `turn`, null first, then by digest. A conversation is cut by ranges of 1,024 turn numbers; counts of
    those pieces, one row each, give every piece the turns before it, so no task orders a whole conversation.
    """
    rows = turns.withColumn("piece", F.coalesce(F.shiftright("turn", PIECE), F.lit(-(2**63))))
    sizes = rows.groupBy("conv_id", "piece").agg(F.count("*").alias("size"))
    mine = Window.partitionBy("conv_id")
    before = F.coalesce(F.sum("size").over(mine.orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pieces = materialize(sizes.select("conv_id", "piece", before.alias("before"), F.sum("size").over(mine).alias("own")), "pieces")
    convs = pieces.groupBy("conv_id").agg(F.max("own").alias("own")).select("conv_id", "own", heads.alias("h"), base.alias("base"))
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    convs = convs.join(lengths, "base", "left").withColumn("m", F.least("h", F.coalesce("there", F.lit(0))))
    depth = F.greatest(F.col("own") - F.col("h"), F.lit(0)) + F.col("m")
    convs = materialize(convs.select("conv_id", "base", "h", "m", depth.alias("t")), "convs")
    placed = pieces.join(convs, "conv_id").select("conv_id", "piece", "before", "h", "m", "t")
    joined = rows.join(placed, ["conv_id", "piece"])
    pos = F.col("before") + F.row_number().over(Window.partitionBy("conv_id", "piece").orderBy(F.col("turn").asc_nulls_first(), "g"))
    ranked = joined.withColumn("pos", pos)
    d = F.when(F.col("pos") > F.col("h"), F.col("pos") - F.col("h") + F.col("m"))
    out = materialize(ranked.select("conv_id", "pos", d.alias("d"), "t", "g", "n_chars"), "ordered")
    discard(pieces)
    return out, convs


def rebuilt(ranked: DataFrame, convs: DataFrame, modulus: int, most: int) -> DataFrame:
    """`conv_id, d, t, g, n_chars`: a conversation's own turns after its first h, behind the first m of its base.

    Only the first turns of base conversations, `most` at most of each, are gathered; each serves `modulus` conversations."""
    own = ranked.where("d is not null").select("conv_id", "d", "t", "g", "n_chars")
    if most == 0:
        return own
    firsts = ranked.where((F.col("conv_id") % modulus == 0) & (F.col("pos") <= most)).groupBy(F.col("conv_id").alias("base"))
    firsts = firsts.agg(F.collect_list(F.struct("pos", "g", "n_chars")).alias("turns"))
    heads = convs.where("m > 0").join(firsts, "base").select("conv_id", "m", "t", F.explode("turns").alias("x")).where("x.pos <= m")
    return own.union(heads.select("conv_id", F.col("x.pos").alias("d"), "t", "x.g", "x.n_chars"))


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """`conv_id, d, t, k1, k2, p1, p2, c0, n_chars`: per turn the digest (128 bits) of the prefix that it ends, that of the
    prefix before, and the code points before it.

    The digest is the exclusive or of hashes of (depth, turn), so it builds up in any order: pieces of 1,024 depths are
    summed up on their own and the longer conversations, if any, get what their earlier pieces hold.
    """
    parts = turns.select("conv_id", "d", "t", "n_chars", F.shiftright("d", PIECE).alias("piece"), F.xxhash64(F.lit(1), "d", "g").alias("h1"), F.xxhash64(F.lit(2), "d", "g").alias("h2"))
    run = Window.partitionBy("conv_id", "piece").orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = parts.select("conv_id", "d", "t", "piece", "n_chars", "h1", "h2", F.bit_xor("h1").over(run).alias("k1"), F.bit_xor("h2").over(run).alias("k2"), F.sum("n_chars").over(run).alias("cum"))
    local = materialize(local, "running")
    if not convs.where(F.col("t") >= 2**PIECE).isEmpty():
        ends = local.where(F.col("d").bitwiseAND(F.lit(2**PIECE - 1)) == 2**PIECE - 1)
        upto = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        carry = ends.select("conv_id", (F.col("piece") + 1).alias("piece"), F.bit_xor("k1").over(upto).alias("y1"), F.bit_xor("k2").over(upto).alias("y2"), F.sum("cum").over(upto).alias("y"))
        moved = local.where("piece > 0").join(carry, ["conv_id", "piece"])
        moved = moved.withColumns({"k1": F.col("k1").bitwiseXOR(F.col("y1")), "k2": F.col("k2").bitwiseXOR(F.col("y2")), "cum": F.col("cum") + F.col("y")}).select(*local.columns)
        local = local.where("piece = 0").union(moved)
    return local.select("conv_id", "d", "t", "k1", "k2", F.col("k1").bitwiseXOR(F.col("h1")).alias("p1"), F.col("k2").bitwiseXOR(F.col("h2")).alias("p2"), (F.col("cum") - F.col("n_chars")).alias("c0"), "n_chars")


# Screening ------------------------------------------------------------------------------------------------------------


def slots(d: np.ndarray, k: np.ndarray, bits: int) -> np.ndarray:
    return (mix64(k.astype(np.uint64) ^ (d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) >> np.uint64(64 - bits)).astype(np.int64)


def _counted(bits: int):
    """Counters of a task, 0, 1 or more, in blocks: a bitmap of slots met and one of slots met twice."""
    size = 1 << BLOCK

    def emit(held: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for row in (0, 1):
            slot, n = np.unique(np.concatenate([h[row] for h in held]), return_counts=True)
            blocks, starts = np.unique(slot >> BLOCK, return_index=True)
            met, twice = [], []
            for a, b in zip(starts, [*starts[1:], len(slot)], strict=True):
                flags = np.zeros((2, size), bool)
                flags[0, slot[a:b] & (size - 1)] = True
                flags[1, slot[a:b][n[a:b] > 1] & (size - 1)] = True
                met.append(np.packbits(flags[0]).tobytes())
                twice.append(np.packbits(flags[1]).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(blocks), row), pa.int32()), pa.array(blocks, pa.int32()), pa.array(met, pa.binary()), pa.array(twice, pa.binary())], ["row", "block", "met", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            d, k1, k2 = (np.asarray(batch.column(i)) for i in range(3))
            held.append((slots(d, k1, bits), slots(d, k2, bits)))
            n += len(d)
            if n >= FLUSH:
                yield from emit(held)
                held, n = [], 0
        if n:
            yield from emit(held)

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums the counters of each block, whose rows come one after another; holds one block."""
    key, met, twice = None, 0, 0

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([twice.to_bytes((1 << BLOCK) // 8, "big")], pa.binary())], ["row", "block", "twice"])

    for batch in batches:
        for r, b, m, t in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (r, b) != key:
                if key is not None and twice:
                    yield row()
                key, met, twice = (r, b), 0, 0
            m, t = int.from_bytes(m, "big"), int.from_bytes(t, "big")
            twice |= t | (met & m)
            met |= m
    if key is not None and twice:
        yield row()


def sketch(rows: DataFrame, n: int) -> tuple[int, np.ndarray]:
    """Bits of a slot, and a bitmap for each of the two rows of the sketch: is the count of a slot over one?

    Its size follows the number of prefixes up to 2 x 2^26 slots (16 MiB, what is sent to all tasks at most). Beyond
    some 2^26 prefixes it lets more and more through that is not shared; that costs shuffling, never a result.
    """
    bits = int(np.clip(int(LOAD * n).bit_length(), *SLOT_BITS))
    parts = rows.select(*_KEY).mapInArrow(_counted(bits), "row int, block int, met binary, twice binary")
    parts = parts.repartition(shuffle_partitions(rows.sparkSession), "row", "block").sortWithinPartitions("row", "block")
    out = np.zeros((2, 1 << (bits - 3)), np.uint8)
    width = 1 << (BLOCK - 3)
    for r in parts.mapInArrow(_added, "row int, block int, twice binary").collect():  # 16 MiB at most
        out[r["row"], r["block"] * width : (r["block"] + 1) * width] = np.frombuffer(r["twice"], np.uint8)
    return bits, out


def _screen(bits: int, sent, shared: bool):
    """Rows whose prefix may be shared, or those proven to be of one conversation, with `head`: may the prefix before be shared?"""

    def over_one(d: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        seen = np.ones(len(d), bool)
        for row, k in enumerate((k1, k2)):
            s = slots(d, k, bits)
            seen &= (sent.value[row][s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1 == 1
        return seen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d, k1, k2, p1, p2 = (np.asarray(batch.column(c)) for c in ("d", "k1", "k2", "p1", "p2"))
            maybe = over_one(d, k1, k2)
            if shared:
                yield batch.filter(pa.array(maybe)).select(["conv_id", "d", "t", "k1", "k2", "c0", "n_chars"])
            else:
                head = (d == 1) | over_one(d - 1, p1, p2)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("conv_id", "d", "t", "c0")), pa.array(head)], ["conv_id", "d", "t", "c0", "head"]).filter(pa.array(~maybe))

    return run


# Hashes of ordered ids ------------------------------------------------------------------------------------------------


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of (key, conv_id): the hash of each key's ids, or, for a key of many ids or one that other tasks may hold too, texts of up to 512 ids."""
    key, ids, whole, at_start = None, [], True, True

    def out(done: bool) -> pa.RecordBatch:
        joined = ",".join(map(str, ids))
        sha = hashlib.sha256(joined.encode()).hexdigest() if done else None
        return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in (*key, ids[0])), pa.array([None if done else joined], pa.string()), pa.array([sha], pa.string())], [*_KEY, "first", "ids", "sha"])

    for batch in batches:
        for d, k1, k2, c in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if (d, k1, k2) != key:
                if key is not None:
                    yield out(whole and not at_start)
                    at_start = False
                key, ids, whole = (d, k1, k2), [], True
            elif len(ids) == CHUNK:
                yield out(False)
                ids, whole = [], False
            ids.append(c)
    if key is not None:
        yield out(False)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From texts in order of (key, first id): the hash of each key; holds the state of one hash."""
    key, state = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([v], pa.int64()) for v in key), pa.array([state.hexdigest()], pa.string())], [*_KEY, "sha"])

    for batch in batches:
        for d, k1, k2, ids in zip(*(batch.column(c).to_pylist() for c in (*_KEY, "ids")), strict=True):
            if (d, k1, k2) != key:
                if key is not None:
                    yield out()
                key, state = (d, k1, k2), hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
    if key is not None:
        yield out()


def end_hashes(ends: DataFrame) -> DataFrame:
    """`d, k1, k2, sha`: SHA-256 of each key's conversation ids, ascending, joined by commas.

    Ids are dealt by ranges of (key, id), so the ids of a key that most conversations share are ordered and written by
    many tasks; only the hash itself, which is sequential by its nature, goes over the joined texts in one task."""
    dealt = ends.select(*_KEY, "conv_id").repartitionByRange(shuffle_partitions(ends.sparkSession), *_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id")
    parts = materialize(dealt.mapInArrow(_hashed, "d long, k1 long, k2 long, first long, ids string, sha string"), "ends")
    open_ = parts.where("ids is not null").repartition(shuffle_partitions(ends.sparkSession), *_KEY).sortWithinPartitions(*_KEY, "first")
    rest = open_.select(*_KEY, "ids").mapInArrow(_chained, "d long, k1 long, k2 long, sha string")
    return parts.where("sha is not null").select(*_KEY, "sha").union(rest)


# The trie -------------------------------------------------------------------------------------------------------------


def prefix_trie(conversations: DataFrame, modulus: int | None = None, spread: int = SPREAD) -> DataFrame:
    """One row per distinct sequence of first turns of `conversations(conv_id, turn, role, text)`, the empty one included:
    `conv_id` (smallest member), `depth`, `parent_conv_id`, `n_convs`, `n_children`, `n_leaves`, `saved_tokens`, `ends_sha256`.

    With `modulus`, conversation c is rebuilt first: its first h = crc32(c) % spread turns give way to those of
    conversation c - c % modulus (the remainder has the sign of c), as far as there are any.

    1. Turns become digests; depth and prefix digest are found in pieces of a conversation (`ordered`, `prefixes`).
    2. A count-min sketch of all prefix digests is summed up on the cluster. A prefix whose estimate is one is of one
       conversation: it is a chain of single nodes from there, emitted as it stands.
    3. Prefixes that may be shared (and the root) are grouped exactly. Every node is owned by its smallest member, and
       what a conversation owns is a suffix of its path, from depth s + 1 on. So sums over subtrees need no
       levels: leaves are the members that own one, children are members with s <= depth < t, and the code points
       saved are those of all members from here on less those of the nodes, each counted at its owner.

    Null role or text counts as empty; rows without conv_id are ignored; turns are ordered by number, null first, ties
    by digest (so repeated rows are turns of their own); other columns are not read. Texts of any length only meet a
    hash. No rows give no nodes, not even a root. Turn numbers that a great many rows of one conversation share are
    ordered together.
    """
    spark = conversations.sparkSession
    heads = F.lit(0) if modulus is None else (F.crc32(F.col("conv_id").cast("string").cast("binary")) % spread).cast("int")
    base = F.col("conv_id") if modulus is None else F.col("conv_id") - F.col("conv_id") % modulus
    ranked, convs = ordered(digested(conversations), heads, base)
    most = 0 if modulus is None else spread - 1
    rows = materialize(prefixes(rebuilt(ranked, convs, modulus or 1, most), convs), "prefixes")
    bits, counted = sketch(rows, rows.count())
    sent = spark.sparkContext.broadcast(counted)
    tails = rows.mapInArrow(_screen(bits, sent, False), "conv_id long, d long, t long, c0 long, head boolean")
    shared = rows.mapInArrow(_screen(bits, sent, True), "conv_id long, d long, t long, k1 long, k2 long, c0 long, n_chars long")
    zero = F.lit(0).cast("long")
    roots = convs.select("conv_id", zero.alias("d"), "t", zero.alias("k1"), zero.alias("k2"), zero.alias("c0"), zero.alias("n_chars"))
    shared = materialize(shared.union(roots), "shared")

    groups = shared.groupBy(*_KEY).agg(F.min("conv_id").alias("conv_id"), F.min("c0").alias("c0"), (F.min("t") == F.max("t")).alias("same"), F.max("t").alias("t"))
    owned = groups.select("conv_id", "d", "c0", (F.col("same") & (F.col("t") == F.col("d"))).alias("leaf"))
    owned = owned.union(tails.select("conv_id", "d", "c0", (F.col("d") == F.col("t")).alias("leaf")))
    owned = owned.groupBy("conv_id").agg(F.min(F.struct("d", "c0")).alias("x"), F.max("leaf").cast("int").alias("leaf"))
    totals = rows.where("d = t").select("conv_id", (F.col("c0") + F.col("n_chars")).alias("total"))
    info = convs.select("conv_id", "t").join(totals, "conv_id", "left").join(owned, "conv_id", "left")
    total = F.coalesce("total", zero)
    info = materialize(info.select("conv_id", F.coalesce(F.col("x.d") - 1, F.col("t")).alias("s"), total.alias("total"), F.coalesce(F.col("x.c0"), total).alias("from"), F.coalesce("leaf", F.lit(0)).alias("leaf")), "owners")

    members = shared.join(info, "conv_id")
    owner = F.min(F.struct("conv_id", "s", F.col("from").alias("c"))).alias("o")
    nodes = members.groupBy(*_KEY).agg(owner, F.count("*").alias("n"), F.sum(F.when((F.col("s") <= F.col("d")) & (F.col("d") < F.col("t")), 1).otherwise(0)).alias("children"), F.sum("leaf").alias("leaves"), F.sum(F.when(F.col("d") == F.col("t"), 1).otherwise(0)).alias("ends"), F.sum("from").alias("below"), F.min("c0").alias("c0"))
    saved = F.col("below") - F.col("n") * F.col("c0") - F.col("o.c") + F.col("c0")
    nodes = materialize(nodes.select(*_KEY, F.col("o.conv_id").alias("conv_id"), F.col("o.s").alias("s"), "n", "children", "leaves", "ends", saved.alias("saved")), "nodes")
    above = members.where("d = s").select(F.col("conv_id").alias("child"), *_KEY).join(nodes.select(*_KEY, "conv_id"), _KEY).select("child", F.col("conv_id").alias("above"))
    above = materialize(above, "above")

    hashes = end_hashes(shared.where("d = t"))
    inner = nodes.join(hashes, _KEY, "left").join(above, F.col("conv_id") == F.col("child"), "left")
    parent = F.when(F.col("d") == 0, None).when(F.col("d") - 1 > F.col("s"), F.col("conv_id")).otherwise(F.col("above"))
    inner = inner.select("conv_id", F.col("d").alias("depth"), parent.alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").cast("long").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("sha", F.lit(_NO_ENDS)).alias("ends_sha256"))
    first = tails.where("head").select("conv_id", "d", "t").join(info.select("conv_id", "s"), "conv_id").join(above, F.col("conv_id") == F.col("child"), "left")
    first = first.select("conv_id", "d", "t", F.when(F.col("d") - 1 > F.col("s"), F.col("conv_id")).otherwise(F.col("above")).alias("parent"))
    chain = tails.where("not head").select("conv_id", "d", "t", F.col("conv_id").alias("parent")).union(first)
    last = F.col("d") == F.col("t")
    one = F.lit(1).cast("long")
    chain = chain.select("conv_id", F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), one.alias("n_convs"), F.when(last, zero).otherwise(one).alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"), F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(F.lit(_NO_ENDS)).alias("ends_sha256"))
    discard(ranked)
    return inner.union(chain)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"), MODULUS)


#: crc32 bit by bit over the digits; prefixes as joined digests; sums over subtrees by all pairs of nodes on a path.
OP12_SQL = r"""
WITH src AS (
  SELECT conv_id, turn, md5(CAST(length(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS g,
         CAST(length(coalesce(text, '')) AS BIGINT) AS n_chars
  FROM conversations WHERE conv_id IS NOT NULL
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, g) AS pos FROM src
), crc AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295,
           list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
             lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]),
               lambda q, z: xor(q >> 1, 3988292384 * (q & 1))))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM src)
), convs AS (
  SELECT c.conv_id, c.base, c.h, least(c.h, (SELECT count(*) FROM src s WHERE s.conv_id = c.base)) AS m FROM crc c
), turns AS (
  SELECT r.conv_id, r.pos - c.h + c.m AS d, r.g, r.n_chars FROM ranked r JOIN convs c USING (conv_id) WHERE r.pos > c.h
  UNION ALL
  SELECT c.conv_id, r.pos, r.g, r.n_chars FROM convs c JOIN ranked r ON r.conv_id = c.base AND r.pos <= c.m
), path AS MATERIALIZED (
  SELECT conv_id, d, n_chars, string_agg(g, '') OVER (PARTITION BY conv_id ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k,
         d = count(*) OVER (PARTITION BY conv_id) AS last FROM turns
  UNION ALL
  SELECT conv_id, 0, 0, '', conv_id NOT IN (SELECT conv_id FROM turns) FROM convs
), nodes AS MATERIALIZED (
  SELECT d, k, min(conv_id) AS conv_id, count(*) AS n, min(n_chars) AS n_chars, count(*) FILTER (WHERE last) AS ends,
         coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE last), '') AS ids
  FROM path GROUP BY d, k
), below AS (
  SELECT p.d, p.k, CAST(sum(u.n_chars * (u.n - 1)) AS BIGINT) AS saved, count(*) FILTER (WHERE u.ends = u.n) AS leaves,
         count(*) FILTER (WHERE u.d = p.d + 1) AS children
  FROM nodes u JOIN path p ON p.conv_id = u.conv_id AND p.d <= u.d GROUP BY p.d, p.k
)
SELECT v.conv_id, CAST(v.d AS BIGINT) AS depth, CASE WHEN v.d > 0 THEN w.conv_id END AS parent_conv_id, v.n AS n_convs,
       b.children AS n_children, b.leaves AS n_leaves, b.saved AS saved_tokens, sha256(v.ids) AS ends_sha256
FROM nodes v JOIN below b ON b.d = v.d AND b.k = v.k
LEFT JOIN path q ON q.conv_id = v.conv_id AND q.d = v.d - 1 LEFT JOIN nodes w ON w.d = q.d AND w.k = q.k
"""
