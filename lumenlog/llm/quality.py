"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text features."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm.common import batches, discard, encode_words, materialize, table

BUCKETS = 1 << 18
TRAIN_ROWS = 20_000  # bound on the labelled rows that are fitted
SELECTED = 1024  # bound on the buckets with a weight
LEAST_G = 20.0  # likelihood-ratio statistic that a bucket must reach
GRADES = 3  # 0: toxic, 1: of low quality, 2: good
KEEP = 0.5
_PUNCT = b".,;:!?*&$#%|()\"'"
_ODD = (b"!!", b"*", b"&", b"$", b"#", b"%", b"|")
_SHARES = (0.03, 0.1, 0.3, 0.6)
_SHAPES = ("upper", "odd", "bar", "again")


def bucket(name: bytes) -> int:
    return xxhash.xxh32_intdigest(name) & (BUCKETS - 1)


_SHAPE_BUCKETS = np.array([[bucket(f"shape:{s}:{q}".encode()) for q in _SHARES] for s in _SHAPES])


class Features:
    """Of a block of texts: distinct (document, bucket) pairs, with a table of the buckets that count (None: all).

    Per word its lower-cased core and the first five bytes of that; per text the shares of capitals, of words with odd
    signs, of lone bars and of words said again at once, each as the steps 3, 10, 30 and 60 % that it reaches.
    """

    def __init__(self, wanted: np.ndarray | None = None):
        self.wanted = wanted

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        flat: list[bytes] = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                w = t.encode("utf-8", "surrogatepass").split()
                counts[i] = len(w)
                flat += w
        words, codes = encode_words(flat)
        del flat
        owner = np.repeat(np.arange(len(texts)), counts)
        flags = np.zeros((3, len(words)), bool)
        by_word, by_bucket = [], []
        wanted, digest, mask = self.wanted, xxhash.xxh32_intdigest, BUCKETS - 1
        for i, w in enumerate(words.to_pylist()):
            low = w.lower()
            core = low.strip(_PUNCT)
            if core != w:
                flags[0, i] = len(w) > 1 and w.isupper()
                flags[1, i] = w.endswith(_ODD)
                flags[2, i] = w == b"|"
            for b in (digest(b"w:" + core) & mask, digest(b"p:" + core[:5]) & mask):
                if wanted is None or wanted[b]:
                    by_word.append(i)
                    by_bucket.append(b)
        by_word, by_bucket = np.array(by_word, np.int64), np.array(by_bucket, np.int64)
        size = np.bincount(by_word, minlength=len(words))
        begin = np.cumsum(size) - size
        lengths = size[codes] if len(codes) else np.zeros(0, np.int64)
        at = np.repeat((begin[codes] if len(codes) else lengths) - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        pairs = [np.repeat(owner, lengths) * BUCKETS + by_bucket[at]] if len(by_bucket) else []
        n = np.maximum(counts, 1)
        again = np.zeros(len(codes), bool)
        if len(codes) > 1:
            again[1:] = (codes[1:] == codes[:-1]) & (owner[1:] == owner[:-1])
        for kind, hit in enumerate([*(f[codes] if len(codes) else again for f in flags), again]):
            share = np.bincount(owner, hit, len(texts)) / n
            for step, least in enumerate(_SHARES):
                docs = np.flatnonzero(share >= least)
                pairs.append(docs * BUCKETS + _SHAPE_BUCKETS[kind, step])
        pairs = np.unique(np.concatenate(pairs))
        doc, b = pairs // BUCKETS, pairs % BUCKETS
        if wanted is not None:
            doc, b = doc[wanted[b]], b[wanted[b]]
        return doc, b


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Ordinal:
    """P(grade <= k) = sigmoid(threshold[k] - score), thresholds rising."""

    weights: np.ndarray  # per bucket, mostly zero
    thresholds: np.ndarray

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ..."""
        return 1.0 - sigmoid(self.thresholds[None, :] - score[:, None])


def fit_ordinal(row: np.ndarray, col: np.ndarray, p: int, grade: np.ndarray, ridge: float = 1e-4, steps: int = 400, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by full-batch Adam on the ridge-penalised likelihood; deterministic. row, col: the ones of the design."""
    n = len(grade)
    k = GRADES - 1
    w = np.zeros(p)
    share = np.clip(np.array([(grade <= i).mean() for i in range(k)]), 1e-3, 1 - 1e-3)
    t = np.log(share / (1 - share))
    raw = np.concatenate([[t[0]], np.log(np.maximum(np.diff(t), 1e-3))])
    m, v = np.zeros(p + k), np.zeros(p + k)
    for step in range(1, steps + 1):
        t = np.concatenate([[raw[0]], raw[0] + np.cumsum(np.exp(raw[1:]))])
        s = np.bincount(row, w[col], n)
        cdf = np.concatenate([np.zeros((n, 1)), sigmoid(t[None, :] - s[:, None]), np.ones((n, 1))], axis=1)
        slope = cdf * (1 - cdf)
        rows = np.arange(n)
        prob = np.maximum(cdf[rows, grade + 1] - cdf[rows, grade], 1e-12)
        high, low = slope[rows, grade + 1] / prob, slope[rows, grade] / prob
        gw = np.bincount(col, (high - low)[row], p) / n + ridge * w
        gt = np.array([-(high[grade == i].sum()) + low[grade == i + 1].sum() for i in range(k)]) / n
        graw = np.concatenate([[gt.sum()], np.array([gt[i:].sum() for i in range(1, k)]) * np.exp(raw[1:])])
        g = np.concatenate([gw, graw])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, raw = w - move[:p], raw - move[p:]
    return w, np.concatenate([[raw[0]], raw[0] + np.cumsum(np.exp(raw[1:]))])


def _grades(labels: DataFrame) -> DataFrame:
    """One grade per labelled document: the worst of its labels; rows without an id or any label are left out."""
    worst = labels.where("doc_id is not null and (quality is not null or toxic is not null)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("t"), F.min("quality").alias("q"))
    return worst.select("doc_id", F.when(F.col("t") == 1, 0).when(F.col("q") == 0, 1).otherwise(2).alias("grade"))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Ordinal:
    """Fit on about `rows` labelled documents, chosen by a hash of the id; fewer labels are all taken, none keep everything."""
    graded = materialize(_grades(labels), "grades")
    n = graded.count()
    chosen = graded.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(min(1.0, rows / max(1, n)) * 1_000_000))
    sample = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id"), "sample")  # at most about `rows` ids
    every = Features()

    def count(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in batches(items, "text"):
            doc, b = every.of(block.column("text").to_pylist())
            g = block.column("grade").to_numpy().astype(np.int64)
            n = np.bincount(b * GRADES + g[doc], minlength=BUCKETS * GRADES).reshape(BUCKETS, GRADES)
            some = np.flatnonzero(n.sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(some), *[pa.array(n[some, i]) for i in range(GRADES)]], ["b", "g0", "g1", "g2"])

    got = sample.mapInArrow(count, "b long, g0 long, g1 long, g2 long").groupBy("b").agg(*[F.sum(c).alias(c) for c in ("g0", "g1", "g2")]).toArrow()  # at most BUCKETS rows
    totals = dict(sample.groupBy("grade").count().collect())
    total = np.array([totals.get(i, 0) for i in range(GRADES)], float)
    seen = np.stack([got.column(c).to_numpy() for c in ("g0", "g1", "g2")], axis=1).astype(float)
    if total.sum() == 0 or len(seen) == 0:
        discard(graded, sample)
        return Ordinal(np.zeros(BUCKETS), np.array([-20.0, -19.0]))
    rest, share = total[None, :] - seen, total / total.sum()
    with np.errstate(divide="ignore", invalid="ignore"):
        g = 2 * sum(np.where(x > 0, x * np.log(x / (x.sum(axis=1, keepdims=True) * share)), 0).sum(axis=1) for x in (seen, np.maximum(rest, 0)))
    order = np.lexsort((got.column("b").to_numpy(), -g))
    order = order[g[order] >= LEAST_G][:SELECTED]
    names = np.sort(got.column("b").to_numpy()[order])
    wanted = np.zeros(BUCKETS, bool)
    wanted[names] = True
    some = Features(wanted)

    def design(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in batches(items, "text"):
            doc, b = some.of(block.column("text").to_pylist())
            offsets = np.searchsorted(doc, np.arange(block.num_rows + 1))
            yield pa.RecordBatch.from_arrays([block.column("doc_id").combine_chunks(), block.column("grade").combine_chunks().cast(pa.int32()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(b, pa.int64()))], ["doc_id", "grade", "b"])

    design_rows = sample.mapInArrow(design, "doc_id long, grade int, b array<long>").toArrow().sort_by("doc_id")
    grade = design_rows.column("grade").to_numpy().astype(np.int64)
    lists = design_rows.column("b").combine_chunks()
    row = np.repeat(np.arange(len(grade)), lists.value_lengths().to_numpy(zero_copy_only=False))
    w, t = fit_ordinal(row, np.searchsorted(names, lists.flatten().to_numpy()), len(names), grade)
    weights = np.zeros(BUCKETS)
    weights[names] = w
    discard(graded, sample)
    return Ordinal(weights, t)


def grade_documents(docs: DataFrame, model: Ordinal) -> DataFrame:
    """`docs` with `expected_grade` (0 to 2), `p_good` (probability of grade 2) and `accepted` (at least one half).

    Null and empty texts have no features and get the probabilities of the thresholds alone. Rows that repeat are
    graded each; an empty table gives no rows; columns of those names are replaced."""
    names = [c for c in docs.columns if c not in ("expected_grade", "p_good", "accepted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*[F.col(f"`{c}`") for c in names]).schema.add("expected_grade", "double").add("p_good", "double")

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        some = Features(m.weights != 0)
        for block in batches(items, "text"):
            doc, b = some.of(block.column("text").to_pylist())
            tails = m.tails(np.bincount(doc, m.weights[b], block.num_rows))
            out = block.append_column("expected_grade", pa.array(tails.sum(axis=1))).append_column("p_good", pa.array(tails[:, -1]))
            yield from out.combine_chunks().to_batches()

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema).withColumn("accepted", F.col("p_good") >= KEEP)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, table(spark, sf_dir, "labels"))
    return grade_documents(docs, model).select("doc_id", "expected_grade", "p_good", "accepted")
