"""A probabilistic suffix tree over words: learnt from the corpus, then used to score whole texts.

Symbols are the words seen at least `least` times in training, one class for all other words, the end of a text and its
start. A context is a run of up to `depth` symbols within a text; those seen `least` times are counted with their next
symbols over the whole corpus, and retained if the divergence test speaks for them. `least` is 5e-5
of the N training tokens, from 100 million tokens on half their square root: words and contexts of each depth are
bounded by 20,000 or 2*sqrt(N), whichever is more, and grow with the data. A token's probability is that of its symbol in the longest retained suffix of what
precedes it; a word of the class has besides its share of the class, by discounted counts that leave the unseen words
what the words seen once suggest.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm.common import batches, discard, encode_words, materialize, mix64, table, words_of

DEPTH = 4  # symbols of the longest context
ROOT_SHARE, SHARE = 0.5, 5e-5  # a word or context counts from the lesser of ROOT_SHARE * sqrt(N) and SHARE * N occurrences on
PAIR_SHARE = 32  # next symbols rarer than 1/PAIR_SHARE of that are left to the shorter contexts: so pairs are bounded too
DIVERGENCE = 12.0  # nats that a context must save beyond the cost of naming the symbols that follow it
OTHER, END, START = 0, 1, 2  # symbols; words follow
SKETCH_SLOTS = 4  # counters of a sketch by N/least, at least
CHUNK = 4096  # counters of a sketch in one row
PARTS = 256  # tasks whose sketches are added first
_K = np.uint64(0x9E3779B97F4A7C15)
_SYM = np.int64(1 << 24)


def _longer(hashes: np.ndarray, older: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(hashes.view(np.uint64) * _K + older.astype(np.uint64) + np.uint64(1)).view(np.int64)


def _counts(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, how often each occurs, and per key its index among them."""
    coded = pa.array(keys).dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    return coded.dictionary.to_numpy(), np.bincount(codes, minlength=len(coded.dictionary)), codes


def _places(values: np.ndarray, among: pa.Array) -> np.ndarray:
    """Index of each value in the array, -1 where it isn't there."""
    return pc.fill_null(pc.index_in(pa.array(values), among), -1).to_numpy(zero_copy_only=False).astype(np.int64)


class Stream:
    """The symbols of a block's texts: START, its words, END, and so on, with the position in the text."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, symbol_of: np.ndarray):
        ends = np.cumsum(counts + 2)
        self.symbols = np.full(int(ends[-1]) if len(ends) else 0, END, np.int64)
        self.owner = np.repeat(np.arange(len(counts)), counts + 2)
        self.place = np.arange(len(self.symbols)) - np.repeat(ends - counts - 2, counts + 2)
        self.symbols[self.place == 0] = START
        self.is_word = (self.place > 0) & (self.place <= counts[self.owner])
        self.symbols[self.is_word] = symbol_of[codes] if len(codes) else 0
        self.at = np.flatnonzero(self.place > 0)

    def contexts(self, depth: int, wanted=None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(d, places, hashes, hashes of the parents) of the contexts of d symbols; `wanted(d, hashes)` says which to lengthen."""
        at, h = self.at, np.zeros(len(self.at), np.int64)
        for d in range(1, depth + 1):
            keep = self.place[at] >= d
            at, parent = at[keep], h[keep]
            h = _longer(parent, self.symbols[at - d])
            if wanted is not None:
                keep = wanted(d, h)
                at, h, parent = at[keep], h[keep], parent[keep]
            yield d, at, h, parent


def _slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    u = hashes.view(np.uint64)
    return (u >> np.uint64(64 - bits)).astype(np.int64), (u & np.uint64((1 << bits) - 1)).astype(np.int64)


def sketch(s: Stream, depth: int, bits: int) -> np.ndarray:
    """Counters of all contexts of these texts, by depth and by two parts of the hash."""
    out = np.zeros((depth, 2, 1 << bits), np.int64)
    for d, _, h, _ in s.contexts(depth):
        for row, slot in enumerate(_slots(h, bits)):
            out[d - 1, row] += np.bincount(slot, minlength=1 << bits)
    return out


class Passing:
    """Which contexts may be frequent: both of their counters have reached the least count."""

    def __init__(self, depth: int, bits: int, slots: np.ndarray):
        """slots: rows of (depth, row, slot) that have."""
        self.bits = bits
        self.ok = np.zeros((depth, 2, 1 << bits), bool)
        self.ok[slots[:, 0] - 1, slots[:, 1], slots[:, 2]] = True

    def __call__(self, d: int, hashes: np.ndarray) -> np.ndarray:
        a, b = _slots(hashes, self.bits)
        return self.ok[d - 1, 0, a] & self.ok[d - 1, 1, b]


def context_counts(s: Stream, passing: Passing, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(depth, context, parent, n) of the contexts that may be frequent."""
    for d, _, h, parent in s.contexts(depth, passing):
        keys, n, codes = _counts(h)
        of = np.zeros(len(keys), np.int64)
        of[codes] = parent
        yield d, keys, of, n


def pair_counts(s: Stream, contexts: pa.Array, passing: Passing, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys slot*2^24 + symbol and their counts; slots number `contexts`, the empty one (hash 0) among them."""
    root = _places(np.zeros(1, np.int64), contexts)[0]
    keys = [root * _SYM + s.symbols[s.at]]
    for _, at, h, _ in s.contexts(depth, passing):
        slot = _places(h, contexts)
        known = slot >= 0
        keys.append(slot[known] * _SYM + s.symbols[at[known]])
    return _counts(np.concatenate(keys))[:2]


class SuffixTree:
    """Retained contexts with smoothed next-symbol distributions, as sorted arrays."""

    def __init__(self, depth, context, parent, total, kinds, slot, symbol, n, alphabet: int, divergence: float = DIVERGENCE):
        """Arrays with a row per frequent context (total: its occurrences, kinds: its distinct next symbols) and arrays
        with a row per counted pair of a context's slot and a symbol. Contexts that fail the divergence test are
        dropped unless a retained one ends in them. What isn't counted as pairs goes to the shorter context."""
        self.depth, self.alphabet = int(depth.max()) if len(depth) else 0, alphabet
        place = {int(c): i for i, c in enumerate(context)}
        up = np.array([place[int(c)] for c in parent], np.int64)
        order = np.lexsort((symbol, slot))
        slot, symbol, n = slot[order], symbol[order], n[order].astype(float)
        pair = slot * _SYM + symbol
        over = np.minimum(np.searchsorted(pair, up[slot] * _SYM + symbol), max(0, len(pair) - 1))
        held = np.bincount(slot, n, len(context))
        mass = kinds + (total - held)  # Witten-Bell: the shorter context weighs as much as there are symbols, and what isn't counted
        with np.errstate(divide="ignore", invalid="ignore"):
            before = np.log(n[over] / total[up[slot]])
            gain = np.bincount(slot, n * (np.log(n / total[slot]) - before) + np.minimum(before, 0), len(context))
        keep = (depth == 0) | (gain >= divergence)
        for d in range(self.depth, 1, -1):
            keep[up[keep & (depth == d)]] = True
        p = np.zeros(len(pair))
        for d in range(self.depth + 1):
            rows = depth[slot] == d
            shorter = 1.0 / alphabet if d == 0 else p[over[rows]]
            of = slot[rows]
            p[rows] = (n[rows] + mass[of] * shorter) / (held[of] + mass[of])
        kept = np.flatnonzero(keep)
        rename = np.full(len(context), -1)
        rename[kept] = np.arange(len(kept))
        rows = keep[slot]
        self.states, self.parents = pa.array(context[kept]), rename[up[kept]]
        self.root = int(np.flatnonzero(depth[kept] == 0)[0]) if len(kept) else -1
        with np.errstate(invalid="ignore"):
            self.escape = np.where(held[kept] + mass[kept] > 0, np.log10(mass[kept] / (held[kept] + mass[kept])), 0.0)
        self.pairs, self.logs = rename[slot[rows]] * _SYM + symbol[rows], np.log10(p[rows])

    def score(self, s: Stream) -> np.ndarray:
        """log10 of the probability of each token's symbol (words and ends, in order)."""
        if not len(self.pairs):  # nothing was learnt
            return np.full(len(s.at), -np.log10(self.alphabet))
        state = np.full(len(s.symbols), self.root)
        live = None

        def known(_: int, h: np.ndarray) -> np.ndarray:
            nonlocal live
            found = _places(h, self.states)
            live = found[found >= 0]
            return found >= 0

        for _, at, _, _ in s.contexts(self.depth, known):
            state[at] = live
        keys, _, codes = _counts(state[s.at] * _SYM + s.symbols[s.at])
        state, symbol = keys // _SYM, keys % _SYM
        out, todo = np.zeros(len(keys)), np.arange(len(keys))
        while len(todo):
            key = state[todo] * _SYM + symbol[todo]
            slot = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            found = self.pairs[slot] == key
            out[todo[found]] += self.logs[slot[found]]
            todo = todo[~found]
            out[todo] += self.escape[state[todo]]
            top = state[todo] == self.root
            out[todo[top]] -= np.log10(self.alphabet)
            todo = todo[~top]
            state[todo] = self.parents[state[todo]]
        return out[codes]


def pack_codes(codes: np.ndarray) -> bytes:
    """Four planes of bytes: frequent words have small numbers, so the upper planes compress to little."""
    return codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def unpack_codes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def _blocks(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for block in batches(items, "text"):
        flat, counts = words_of(block.column("text").to_pylist())
        words, codes = encode_words(flat)
        order = np.argsort(-np.bincount(codes, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        words, codes = words.take(pa.array(order)), rank[codes] if len(codes) else codes
        held = np.asarray(block.column("held_out").combine_chunks().to_numpy(zero_copy_only=False), bool)
        train = np.bincount(codes[np.repeat(~held, counts)], minlength=len(words)).astype(np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([number]),
                pa.array([block.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                pa.array([held.tolist()], pa.list_(pa.bool_())),
                pa.array([counts.tolist()], pa.list_(pa.int64())),
                pa.array([pack_codes(codes)], pa.binary()),
                pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())),
                pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), pa.array(train)),
            ],
            ["block", "docs", "held", "counts", "stream", "words", "train"],
        )
        number += 1


BLOCK_SCHEMA = "block long, docs array<long>, held array<boolean>, counts array<long>, stream binary, words array<string>, train array<long>"


class _Row:
    """A block: its columns as arrays."""

    def __init__(self, batch: pa.RecordBatch, i: int, symbols: pa.Array):
        value = {c: batch.column(c)[i] for c in batch.schema.names}
        self.counts = value["counts"].values.to_numpy(zero_copy_only=False)
        self.held = value["held"].values.to_numpy(zero_copy_only=False).astype(bool)
        self.codes = unpack_codes(value["stream"].as_buffer())
        self.words = value["words"].values
        self.symbol_of = pc.add(pc.fill_null(pc.index_in(self.words, symbols), OTHER - 3), 3).to_numpy(zero_copy_only=False).astype(np.int64)
        self.docs = value["docs"].values if "docs" in value else None

    def training(self) -> Stream:
        return Stream(self.codes[np.repeat(~self.held, self.counts)], self.counts[~self.held], self.symbol_of)


def _add(key: tuple, rows: pa.Table) -> pa.Table:
    """The sum of some tasks' counters."""
    total = sum(np.frombuffer(x.as_buffer(), "<i8") for x in rows.column("counts"))
    one = rows.slice(0, 1).drop_columns(["counts"])
    return one.append_column("counts", pa.array([total.tobytes()], pa.binary()))


def least_count(total: int) -> float:
    """The occurrences from which words and contexts count: at most the greater of 20,000 and 2*sqrt(N) of them can be."""
    return max(2.0, min(SHARE * total, ROOT_SHARE * math.sqrt(total)))


def learn(blocks: DataFrame, symbols: list[str], total: int, depth: int = DEPTH, least: float | None = None) -> SuffixTree:
    """The tree from the training texts of `blocks`, in three passes over them.

    1. Each task adds up counters of all contexts, of a width that N/least bounds. The sums over all tasks are taken on
       the cluster, in groups of a few thousand counters. As the counters of a row sum to N, at most N/least of them
       reach the least count, however the texts are dealt; those go to the driver and out to all tasks.
    2. The contexts that may be frequent are counted exactly. Those that are, at most N/least of each depth, follow.
    3. Next symbols are counted for these. A context's pairs come to the driver if they are seen least/32 times: at
       most 32*N/least of each depth.

    With the default least count each of these bounds is a multiple of 20,000 or of sqrt(N), whichever is more."""
    spark = blocks.sparkSession
    least = least_count(total) if least is None else least
    bits = max(12, math.ceil(math.log2(SKETCH_SLOTS * max(1.0, total / least))))
    source = blocks.select("held", "counts", "stream", "words")
    known = spark.sparkContext.broadcast(pa.array(symbols, pa.string()))

    def rows(items: Iterator[pa.RecordBatch]) -> Iterator[_Row]:
        for batch in items:
            for i in range(batch.num_rows):
                yield _Row(batch, i, known.value)

    def count_all(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = None
        for row in rows(items):
            more = sketch(row.training(), depth, bits)
            counters = more if counters is None else counters + more
        if counters is not None:
            part = TaskContext.get().partitionId() // PARTS
            for d in range(depth):
                for r in range(2):
                    chunks = counters[d, r].astype("<i8").reshape(-1, CHUNK)
                    n = len(chunks)
                    yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int64()), pa.array([d + 1] * n, pa.int32()), pa.array([r] * n, pa.int32()), pa.array(range(n), pa.int32()), pa.array([c.tobytes() for c in chunks], pa.binary())], ["part", "depth", "row", "chunk", "counts"])

    def frequent(key: tuple, rows: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), "<i8") for x in rows.column("counts"))
        d, row, chunk = (k.as_py() for k in key)
        slots = np.flatnonzero(total >= least) + chunk * CHUNK
        return pa.table({"depth": np.full(len(slots), d, np.int32), "row": np.full(len(slots), row, np.int32), "slot": slots.astype(np.int64)})

    layout = "part long, depth int, row int, chunk int, counts binary"
    counters = source.mapInArrow(count_all, layout).groupBy("part", "depth", "row", "chunk").applyInArrow(_add, layout)
    slots = counters.groupBy("depth", "row", "chunk").applyInArrow(frequent, "depth int, row int, slot long").toArrow()
    slots = np.stack([slots.column(c).to_numpy().astype(np.int64) for c in ("depth", "row", "slot")], axis=1)
    passing = spark.sparkContext.broadcast(Passing(depth, bits, slots))

    def count_contexts(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows(items):
            for d, context, parent, n in context_counts(row.training(), passing.value, depth):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), d, np.int32)), pa.array(context), pa.array(parent), pa.array(n)], ["depth", "context", "parent", "n"])

    counted = source.mapInArrow(count_contexts, "depth int, context long, parent long, n long").groupBy("context").agg(F.sum("n").alias("n"), F.first("depth").alias("depth"), F.first("parent").alias("parent"))
    got = counted.where(F.col("n") >= least).toArrow().sort_by("context")
    level, context, parent, n = (got.column(c).to_numpy() for c in ("depth", "context", "parent", "n"))
    context = np.concatenate([[np.int64(0)], context])
    level, parent, sums = np.concatenate([[0], level]), np.concatenate([[np.int64(0)], parent]), np.concatenate([[total], n]).astype(float)
    contexts = spark.sparkContext.broadcast(pa.array(context))

    def count_pairs(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in rows(items):
            keys, n = pair_counts(row.training(), contexts.value, passing.value, depth)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["key", "n"])

    pairs = materialize(source.mapInArrow(count_pairs, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "pairs")
    kinds = np.zeros(len(context))
    several = pairs.groupBy(F.shiftright("key", 24).alias("slot")).agg(F.count("*").alias("kinds")).toArrow()
    kinds[several.column("slot").to_numpy()] = several.column("kinds").to_numpy()
    got = pairs.where(F.col("n") >= least / PAIR_SHARE).toArrow()
    discard(pairs)
    key = got.column("key").to_numpy()
    return SuffixTree(level, context, parent, sums, kinds, key // _SYM, key % _SYM, got.column("n").to_numpy(), alphabet=len(symbols) + 2)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score_texts(docs: DataFrame, depth: int = DEPTH, least: float | None = None) -> DataFrame:
    """Per row of `docs(doc_id, text, held_out)`: `doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`.

    Texts that are not held out are learnt from, all are scored. A block of about 6 MB of texts is one row, with its
    distinct words and the words of its texts as numbers, so only a row per block and distinct word is shuffled and no
    word is on more rows than there are blocks. `least` is the count from which words and contexts count (by default
    it grows with the square root of the corpus). A null text is empty and has the end alone. Rows without an id are
    learnt from; rows that repeat count each; no training texts leave all words unknown; an empty table gives no rows.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("held_out", F.lit(False)).alias("held_out"))
    blocks = materialize(source.mapInArrow(_blocks, BLOCK_SCHEMA), "blocks")
    seen = blocks.select(F.explode(F.arrays_zip("words", "train")).alias("x")).select(F.col("x.words").alias("word"), F.col("x.train").alias("c"))
    vocabulary = materialize(seen.groupBy("word").agg(F.sum("c").alias("c")).where("c > 0"), "vocabulary")
    v = vocabulary.agg(F.count("*"), F.sum("c"), F.sum(F.expr("int(c = 1)")), F.sum(F.expr("int(c = 2)"))).first()
    ends = blocks.select(F.explode("held").alias("h")).where("not h").count()
    total, kinds = (v[1] or 0) + ends, v[0] + (ends > 0)
    once, twice = v[2] or 0, v[3] or 0
    discount = once / (once + 2 * twice) if once else 0.5
    least = least_count(total) if least is None else least
    often = sorted(vocabulary.where(F.col("c") >= least).select("word", "c").collect())  # at most N/least rows
    symbols = [r.word for r in often]
    tree = spark.sparkContext.broadcast((learn(blocks, symbols, total, depth, least), pa.array(symbols, pa.string())))
    unseen = discount * max(1, v[0])
    class_share = max(1e-300, 1.0 - sum(r.c for r in often) / total - ends / total + discount * len(often) / total) if total else 1.0
    of_end, offset = math.log10(ends + 0.1), math.log10(total + 0.1 * (kinds + 1))

    def finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        model, known = tree.value
        pieces = []
        for batch in left.combine_chunks().to_batches():
            for i in range(batch.num_rows):
                row = _Row(batch, i, known)
                c = np.zeros(len(row.words), np.int64)
                if right.num_rows:
                    c[right.column("pos").to_numpy()] = right.column("c").to_numpy()
                s = Stream(row.codes, row.counts, row.symbol_of)
                share = np.where(c > 0, c - discount, unseen) / total if total else np.ones(len(c))
                inner = np.where(row.symbol_of == OTHER, np.log10(np.maximum(share, 1e-300)) - math.log10(class_share), 0.0)
                log_base = np.log10(c + 0.1) - offset
                word, owner, n = s.is_word[s.at], s.owner[s.at], len(row.counts)
                extra, base, seen_before = np.zeros(len(s.at)), np.full(len(s.at), of_end - offset), np.full(len(s.at), float(ends > 0))
                extra[word], base[word], seen_before[word] = inner[row.codes], log_base[row.codes], c[row.codes] > 0
                pieces.append(pa.table({"doc_id": row.docs.cast(pa.int64()), "held_out": pa.array(row.held, pa.bool_()), "n_tokens": row.counts + 1, "n_known": np.bincount(owner, seen_before, n).astype(np.int64), "base_score": np.bincount(owner, base, n), "score": np.bincount(owner, model.score(s) + extra, n)}))
        if not pieces:
            pieces = [pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]).empty_table()]
        return pa.concat_tables(pieces)

    places = blocks.select(F.col("block").alias("of"), F.posexplode("words").alias("pos", "word"))
    replies = places.join(vocabulary, "word").select("of", "pos", "c")
    out = blocks.select("block", "docs", "held", "counts", "stream", "words").groupBy("block").cogroup(replies.groupBy("of")).applyInArrow(finish, SCORES)
    out = materialize(out.withColumn("train_tokens", F.lit(total).cast("long")), "scores")
    discard(blocks, vocabulary)
    return out


def op1_suffix_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(10)) == 0).alias("held_out"))
    return score_texts(docs).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
