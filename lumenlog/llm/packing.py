"""Packing token ids into fixed-length sequences: cost-balanced (op6) and best-fit-decreasing (op3)."""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm.common import batches, materialize, table
from lumenlog.llm.tokens import WordTokenizer

LENGTH = 2048
SHARD_TOKENS = 4_000_000  # of one packing problem: about 2,000 sequences, 16 MB of ids
LINEAR, QUADRATIC = 1.0, 1.0 / 1024

_TOKENIZERS: dict[str | None, WordTokenizer] = {}


def tokenizer(path: str | None) -> WordTokenizer:
    """One per Python worker: its words stay known from task to task."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


class CapacityTree:
    """Open sequences by remaining capacity 0..length in a segment tree; each leaf is a heap of (cost, sequence)."""

    def __init__(self, length: int):
        self.base = 1 << length.bit_length()
        self.least = [float("inf")] * (2 * self.base)
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in range(self.base)]

    def _renew(self, capacity: int) -> None:
        i = capacity + self.base
        self.least[i] = self.heaps[capacity][0][0] if self.heaps[capacity] else float("inf")
        i >>= 1
        while i:
            a, b = self.least[2 * i], self.least[2 * i + 1]
            self.least[i] = a if a <= b else b
            i >>= 1

    def push(self, capacity: int, cost: float, sequence: int) -> None:
        heapq.heappush(self.heaps[capacity], (cost, sequence))
        self._renew(capacity)

    def pop(self, capacity: int) -> tuple[float, int]:
        out = heapq.heappop(self.heaps[capacity])
        self._renew(capacity)
        return out

    def cheapest(self, need: int) -> int | None:
        """The capacity >= need whose heap holds the lowest cost."""
        best, node = float("inf"), 0
        a, b = need + self.base, 2 * self.base
        while a < b:
            if a & 1:
                if self.least[a] < best:
                    best, node = self.least[a], a
                a += 1
            if b & 1:
                b -= 1
                if self.least[b] < best:
                    best, node = self.least[b], b
            a >>= 1
            b >>= 1
        if not node:
            return None
        while node < self.base:
            node = 2 * node if self.least[2 * node] <= self.least[2 * node + 1] else 2 * node + 1
        return node - self.base

    def tightest(self, need: int) -> int | None:
        """The smallest capacity >= need that any open sequence has."""
        a = need + self.base
        while self.least[a] == float("inf"):
            while a & 1:
                a >>= 1
                if a <= 1:
                    return None
            a += 1
        while a < self.base:
            a = 2 * a if self.least[2 * a] < float("inf") else 2 * a + 1
        return a - self.base


def pieces_of(sizes: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """(document, start, size) of whole chunks of `length` and the remainders."""
    return [(d, s, min(length, n - s)) for d, n in enumerate(sizes.tolist()) for s in range(0, n, length)]


def balance(sizes: np.ndarray, length: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, size), all full but for a last few whose sizes are powers of two.

    Pieces go by falling cost linear*n + quadratic*n^2, ties by document and start, each to the sequence of lowest
    cost that has room for it. What no sequence has room for is cut to fill the gaps that are left.
    """
    pieces = sorted(pieces_of(sizes, length), key=lambda p: (-p[2], p[0], p[1]))
    total = int(sizes.sum())
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(total // length)]
    tree = CapacityTree(length)
    for s in range(len(out)):
        tree.push(length, 0.0, s)
    over = []
    for p in pieces:
        n = p[2]
        room = tree.cheapest(n) if out else None
        if room is None:
            over.append(p)
            continue
        cost, s = tree.pop(room)
        out[s].append(p)
        tree.push(room - n, cost + linear * n + quadratic * n * n, s)
    used = [sum(p[2] for p in s) for s in out]
    gaps = sorted(((length - u, i) for i, u in enumerate(used) if u < length), reverse=True)
    rest = sum(p[2] for p in over) - sum(g for g, _ in gaps)
    power = length
    while rest > 0:  # the tail of the shard
        while power > rest:
            power >>= 1
        gaps.append((power, len(out)))
        out.append([])
        rest -= power
    at = 0
    for gap, s in gaps:
        while gap:
            d, start, n = over[at]
            take = min(gap, n)
            out[s].append((d, start, take))
            gap -= take
            if take == n:
                at += 1
            else:
                over[at] = (d, start + take, n - take)
    return out


def best_fit(sizes: np.ndarray, length: int = LENGTH) -> list[list[tuple[int, int, int]]]:
    """Best-fit-decreasing: each piece, longest first, goes to the fullest sequence with room for it, else a new one."""
    tree, out = CapacityTree(length), []
    for p in sorted(pieces_of(sizes, length), key=lambda p: (-p[2], p[0], p[1])):
        room = tree.tightest(p[2])
        if room is None:
            room, s = length, len(out)
            out.append([])
        else:
            _, s = tree.pop(room)
        out[s].append(p)
        if room > p[2]:
            tree.push(room - p[2], 0.0, s)
    return out


def _shards(items: Iterator[pa.RecordBatch], path: str | None) -> Iterator[tuple[int, list, np.ndarray, np.ndarray]]:
    """(number, document ids, ids, bounds) of each packing problem of a partition, ordered as read."""
    coder = tokenizer(path)
    docs: list = []
    ids: list[np.ndarray] = []
    sizes: list[np.ndarray] = []
    number, held = 0, 0

    def shard():
        return number, docs, np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))])

    for block in batches(items, "text"):
        got, bounds = coder.encode(block.column("text").to_pylist())
        docs += block.column("doc_id").to_pylist()
        ids.append(got)
        sizes.append(np.diff(bounds))
        held += len(got)
        if held >= SHARD_TOKENS:
            yield shard()
            docs, ids, sizes, held, number = [], [], [], 0, number + 1
    if docs:
        yield shard()


def sequence_base(number: int) -> int:
    return (TaskContext.get().partitionId() << 32) | (number << 20)


PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PIECE_NAMES = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]
TAILS = 512  # shard tails packed together
TAIL_BASE = 1 << 61  # of the sequence ids of those


def _checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _with_ids(rows: list[tuple], ids: list[bytes | None]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in PIECE_NAMES]
    return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.array(ids, pa.binary())], [*PIECE_NAMES, "ids"])


def _piece_rows(shards: Iterator, pack, length: int) -> Iterator[pa.RecordBatch]:
    """Pieces of each shard; those of sequences that are not full, its tail of less than `length` ids, have their ids with them."""
    for number, docs, ids, bounds in shards:
        sizes, base = np.diff(bounds), sequence_base(number)
        rows, kept = [], []
        for s, pieces in enumerate(pack(sizes)):
            full, offset = s < int(sizes.sum()) // length, 0
            for d, start, n in pieces:
                piece = ids[int(bounds[d]) + start : int(bounds[d]) + start + n]
                rows.append((docs[d], start, n, _checksum(piece), int(sizes[d]), base + s, offset))
                kept.append(None if full else piece.astype("<u4").tobytes())
                offset += n
        yield _with_ids(rows, kept)


def _pack_tails(pack):
    """The tails of a group of shards as one packing problem."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        held = [np.frombuffer(x, "<u4") for x in rows.column("ids").to_pylist()]
        docs, starts, whole = (rows.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens"))
        out = []
        for s, pieces in enumerate(pack(np.array([len(x) for x in held], np.int64))):
            offset = 0
            for d, start, n in pieces:
                out.append((docs[d], starts[d] + start, n, _checksum(held[d][start : start + n]), whole[d], TAIL_BASE + (key[0].as_py() << 20) + s, offset))
                offset += n
        return pa.Table.from_batches([_with_ids(out, [None] * len(out))]).drop_columns(["ids"])

    return run


def pack_balanced(docs: DataFrame, length: int = LENGTH, path: str | None = None, linear: float = LINEAR, quadratic: float = QUADRATIC) -> DataFrame:
    """One row per piece of `docs(doc_id, text)`: `doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`.

    A document's ids end with id 1; a null text is empty and has that id alone. Long documents are cut. Each read
    partition packs itself in shards of about 4 million tokens, so memory is bounded; within a shard all sequences
    are full except for a tail of less than one sequence. Only those tails are shuffled, with their ids, to groups of
    some hundred that are packed in the same way; each group leaves one tail, in powers of two. So the number of
    sequences hardly depends on how the table is cut. Rows that repeat an id are packed each for itself; an empty
    table gives no rows; further columns are ignored.
    """

    def pack(sizes: np.ndarray) -> list[list[tuple[int, int, int]]]:
        return balance(sizes, length, linear, quadratic)

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _piece_rows(_shards(items, path), pack, length)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = materialize(source.mapInArrow(run, PIECE_SCHEMA + ", ids binary"), "pieces")
    tails = pieces.where("ids is not null")
    groups = -(-tails.select(F.shiftright("sequence_id", 20)).distinct().count() // TAILS)
    group = F.pmod(F.xxhash64(F.shiftright("sequence_id", 20)), F.lit(max(1, groups))).alias("group")
    packed = tails.select(group, *PIECE_NAMES, "ids").groupBy("group").applyInArrow(_pack_tails(pack), PIECE_SCHEMA)
    return pieces.where("ids is null").select(*PIECE_NAMES).union(packed)


ROW_SCHEMA = "sequence_id long, n_tokens int, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, doc_starts array<long>, doc_tokens array<long>"

ROW_NAMES = [c.split()[0] for c in ROW_SCHEMA.split(", ")]
ROW_KINDS = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int32()), *[pa.list_(pa.int64())] * 3]
SLACK = 0.01  # of the room of a shard's sequences that may be padding; those beyond it are packed with other shards'


def kept_sequences(used: np.ndarray, length: int, slack: float = SLACK) -> np.ndarray:
    """Marks the fullest sequences, as many as have no more than `slack` of their room free together."""
    order = np.argsort(-used, kind="stable")
    free = np.cumsum(length - used[order])
    keep = np.zeros(len(used), bool)
    keep[order[free <= slack * length * np.arange(1, len(used) + 1)]] = True
    return keep


def _matrix_rows(sequences: list, length: int, pad: int, base: int, docs: list, starts: list, whole: list, ids: np.ndarray, bounds: np.ndarray) -> Iterator[tuple]:
    """Rows of `ROW_SCHEMA`; unit `d` of a sequence stands at `bounds[d]` of `ids` and at `starts[d]` of its document."""
    ramp = np.arange(length, dtype="<u4")
    for s, pieces in enumerate(sequences):
        row, position, ends = np.full(length, pad, "<u4"), np.zeros(length, "<u4"), [0]
        for d, start, n in pieces:
            at = ends[-1]
            row[at : at + n] = ids[bounds[d] + start : bounds[d] + start + n]
            position[at : at + n] = ramp[:n]
            ends.append(at + n)
        of = [p[0] for p in pieces]
        yield (base + s, ends[-1], row.tobytes(), position.tobytes(), ends, [docs[d] for d in of], [starts[d] + p[1] for d, p in zip(of, pieces, strict=True)], [whole[d] for d in of])


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def _matrices(length: int, path: str | None, pad: int):
    """Each shard packed by itself; `tail` marks the sequences that are to be packed with other shards'."""

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = [*ROW_NAMES, "tail"], [*ROW_KINDS, pa.bool_()]
        for number, docs, ids, bounds in _shards(items, path):
            sizes = np.diff(bounds)
            sequences = best_fit(sizes, length)
            keep = kept_sequences(np.array([sum(p[2] for p in s) for s in sequences], np.int64), length)
            rows = []
            found = _matrix_rows(sequences, length, pad, sequence_base(number), docs, [0] * len(docs), sizes.tolist(), ids.astype("<u4"), bounds)
            for row, kept in zip(found, keep.tolist(), strict=True):
                rows.append((*row, not kept))
                if len(rows) == 256:
                    yield _batch(rows, names, kinds)
                    rows = []
            if rows:
                yield _batch(rows, names, kinds)

    return run


def _pack_matrices(length: int, pad: int):
    """The pieces of a group of tails as one packing problem."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("sequence_id")
        ends = rows.column("cu_seqlens").to_pylist()
        docs, starts, whole = (rows.column(c).combine_chunks().flatten().to_pylist() for c in ("doc_ids", "doc_starts", "doc_tokens"))
        held = [np.frombuffer(x, "<u4")[: e[-1]] for x, e in zip(rows.column("input_ids").to_pylist(), ends, strict=True)]
        sizes = np.concatenate([np.diff(e) for e in ends])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        base = TAIL_BASE + (key[0].as_py() << 20)
        out = list(_matrix_rows(best_fit(sizes, length), length, pad, base, docs, starts, whole, np.concatenate(held), bounds))
        return pa.Table.from_batches([_batch(out, ROW_NAMES, ROW_KINDS)])

    return run


def pack_best_fit(docs: DataFrame, length: int = LENGTH, path: str | None = None, pad: int = 0) -> DataFrame:
    """One row per sequence, as it is written for training.

    `input_ids`: `length` little-endian unsigned 32-bit ids, padded by `pad`; `position_ids`: as many, starting at 0
    with each piece (0 in the padding); `cu_seqlens`: 0 and the ends of the pieces; `doc_ids, doc_starts, doc_tokens`:
    of each piece its document, the ids of that before it, and all ids of that. Documents end with id 1, longer ones
    are split without loss. Shards, nulls, repeated ids and empty tables as in `pack_balanced`; extra columns are ignored.

    A shard keeps its fullest sequences, as many as are padded by `SLACK` or less together, and leaves the others as its
    tail. Tails are shuffled to groups as large as a shard, and each group is packed again, so that padding does not grow
    with the number of partitions. Both parts are written to the shared folder and what is returned is read from there.
    """

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shards = materialize(source.mapInArrow(_matrices(length, path, pad), ROW_SCHEMA + ", tail boolean"), "packed")
    tails = shards.where("tail")
    groups = -(-(tails.agg(F.sum("n_tokens")).first()[0] or 0) // SHARD_TOKENS)
    group = F.pmod(F.xxhash64("sequence_id"), F.lit(max(1, groups))).alias("group")
    again = tails.select(group, *ROW_NAMES).groupBy("group").applyInArrow(_pack_matrices(length, pad), ROW_SCHEMA)
    return shards.where("not tail").select(*ROW_NAMES).union(materialize(again, "packed_tails"))


def write_packed(packed: DataFrame, path: str) -> None:
    """Write the rows of `pack_best_fit` as Parquet files of binary matrices."""
    packed.write.mode("errorifexists").option("compression", "zstd").parquet(path)


def packed_pieces(packed: DataFrame) -> DataFrame:
    """One row per piece of packed sequences, its checksum taken from the written matrix."""
    piece = """transform(sequence(1, size(doc_ids)), i -> struct(doc_ids[i - 1] as doc_id, doc_starts[i - 1] as start,
      cast(cu_seqlens[i] - cu_seqlens[i - 1] as long) as length,
      crc32(substring(input_ids, 4 * cu_seqlens[i - 1] + 1, 4 * (cu_seqlens[i] - cu_seqlens[i - 1]))) as ids_crc32,
      doc_tokens[i - 1] as doc_tokens, cast(cu_seqlens[i - 1] as long) as offset))"""
    return packed.select("sequence_id", F.explode(F.expr(piece)).alias("p")).select("p.doc_id", "p.start", "p.length", "p.ids_crc32", "p.doc_tokens", "sequence_id", "p.offset")


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packs all documents, writes the matrices to the shared folder and returns a digest of what was written."""
    return packed_pieces(pack_best_fit(table(spark, sf_dir, "documents")))


def op6_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_balanced(table(spark, sf_dir, "documents"))
