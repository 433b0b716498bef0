"""Line dedup (native): winnowing over line hashes, window minima met by hash, windows around them matched, later repeated runs deleted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm.common import discard, materialize, table

#: A line ends at a line feed, after a sentence, or before a capital that follows a small letter; it keeps its white space.
LINE = r"(?<=[\n ])(?:(?<=\n)|(?<=[\p{L}\p{N}][.!?] )|(?<=\p{Ll} )(?=\p{Lu}))"
MIN_RUN_WORDS = 30  # shorter repeated runs stay: they are boilerplate or chance
BROADCAST_RANGES = 400_000  # of repeated runs, over all texts: 16 MB or so
BROADCAST_FINGERPRINTS = 1_000_000  # of 8 bytes
_TRIED = 6  # run lengths that are tried one by one before all up to the most lines are summed

_PLAIN = r"transform(lines, x -> lower(trim(replace(replace(replace(x, '\n', ' '), '\t', ' '), '\r', ' '))))"
_HASHES = "transform(real, x -> xxhash64(x))"
_WORDS = "transform(real, x -> 1 + octet_length(x) - octet_length(replace(x, ' ', '')))"
#: Numbers of the lines with words, null where all lines have some.
_AT = "if(size(real) = size(plain), null, filter(sequence(1, greatest(1, size(plain))), i -> plain[i - 1] <> ''))"
#: Per line the last line of the shortest run from it that has the least words, n + 1 if there is none. A line has a word at least.
_ENDS = f"""transform(sequence(1, greatest(1, n)), i -> coalesce(case
  {" ".join(f"when {' + '.join(f'get(w, i + {j - 1})' for j in range(k))} >= {MIN_RUN_WORDS} then i + {k - 1}" for k in range(1, _TRIED + 1))}
  else aggregate(sequence(i, greatest(i, least(n, i + {MIN_RUN_WORDS - 1}))), named_struct('s', 0, 'at', i - 1),
    (s, t) -> if(s.s >= {MIN_RUN_WORDS}, s, named_struct('s', s.s + coalesce(get(w, t - 1), 0), 'at', t)),
    s -> if(s.s >= {MIN_RUN_WORDS}, s.at, n + 1)) end, n + 1))"""


def _of_lines(one: str, some: str, all_of: str) -> str:
    """SQL: a function of the line hashes i to j. Windows have few lines: up to `_TRIED` are named one by one, which spares
    an array for each window; what is made of as many lines is made in the same way everywhere."""
    cases = [f"when {n} then {(some if n else one).format(', '.join(f'v.h[i - 1 + {m}]' for m in range(n + 1)))}" for n in range(_TRIED)]
    return f"case j - i {' '.join(cases)} else {all_of.format('transform(sequence(i, j), t -> v.h[t - 1])')} end"


_WHOLE, _LEAST = _of_lines("xxhash64({})", "xxhash64({})", "xxhash64({})"), _of_lines("{}", "least({})", "array_min({})")
#: The shortest run from each line, and the shortest one to each line at which none of those ends. The arrays are bound
#: to a variable: the optimizer would else put what makes them into the inner function, to be done again for each line. slice() copies
#: the whole array each time, so elements are taken one by one; no filter
#: stands behind these columns, as it would be pushed below them with all that makes them.
_LEAST_RUNS = f"""flatten(flatten(transform(array(named_struct('e', e, 'h', h, 'at', at, 'n', n, 'size', size)), v ->
  transform(filter(sequence(1, greatest(1, v.n)), i -> v.e[i - 1] <= v.n), i -> transform(
    sequence(v.e[i - 1], greatest(v.e[i - 1], coalesce(get(v.e, i), v.n + 1) - 1)),
    j -> named_struct('k', {_WHOLE}, 'f', {_LEAST}, 'a', if(v.at is null or i = 1, i, v.at[i - 1]), 'b', if(v.at is null, j, coalesce(get(v.at, j), v.size + 1) - 1)))))))"""
#: Within a text a run meets its place before; only the first place is held against other texts.
_AGAIN = "sort_array(transform(filter(s, (x, i) -> i > 0 and s[greatest(i, 1) - 1].k = x.k), x -> named_struct('a', x.a, 'b', x.b)))"
_FIRSTS = "filter(s, (x, i) -> i = 0 or s[greatest(i, 1) - 1].k <> x.k)"
#: The fingerprints of a text: each least hash of a window once, though neighbouring windows share it.
_PRINTS = "array_distinct(transform(s, x -> x.f))"


def _joined(runs: str) -> str:
    """Sorted runs as few that neither overlap nor touch."""
    return f"""aggregate({runs}, named_struct('a', 0, 'b', -1, 'runs', cast(array() as array<struct<a:int,b:int>>)),
  (s, x) -> case when s.b < 0 then named_struct('a', x.a, 'b', x.b, 'runs', s.runs)
    when x.a <= s.b + 1 then named_struct('a', s.a, 'b', greatest(s.b, x.b), 'runs', s.runs)
    else named_struct('a', x.a, 'b', x.b, 'runs', concat(s.runs, array(named_struct('a', s.a, 'b', s.b)))) end,
  s -> if(s.b < 0, s.runs, concat(s.runs, array(named_struct('a', s.a, 'b', s.b)))))"""


def repeated_runs(docs: DataFrame) -> DataFrame:
    """`doc_id, th, runs`: per text (th: its xxhash64) the ranges of lines, from 1, that repeat an earlier place.

    1. Texts become arrays of line hashes, once and without a shuffle. Blank lines have no part in it.
    2. A window is a shortest run of 30 words or more from a line, or to a line. Its fingerprint is its least line
       hash; neighbouring windows mostly share theirs. A window that repeats in another text has its fingerprint there
       too, so a fingerprint of one text alone clears all windows that it is the least of. Only fingerprints are
       counted over the corpus, by partial aggregation.
    3. Around fingerprints of two texts or more matches are extended to both sides: the windows that hold them meet as a
       whole, by a hash of all their lines. Any longer run is the union of the windows inside it, so a line is repeated
       if and only if one of its windows is: no choice of fingerprints can miss a run, and each meets its own first copy.
    4. A run said again in one text meets its place before there. The first text of every hash is a partial
       aggregation of numbers; the first places of later texts join it. One row stands on that side of each key, so
       a passage that most texts hold makes no more rows than it has places.
    5. The ranges of each text are joined to the longest ones.

    Every line deleted equals one at a smaller place, so the first copy of each passage stays; blank lines that
    follow a deleted line, or precede it at the head of a text, go with it.
    """
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null and text <> ''")
    split = lines.select("doc_id", F.xxhash64("text").alias("th"), F.split("text", LINE).alias("lines"))
    plain = split.select("doc_id", "th", F.expr(_PLAIN).alias("plain")).withColumn("real", F.expr("if(array_contains(plain, ''), filter(plain, x -> x <> ''), plain)"))
    hashed = plain.select("doc_id", "th", F.size("plain").alias("size"), F.size("real").alias("n"), F.expr(_AT).alias("at"), F.expr(_HASHES).alias("h"), F.expr(_WORDS).alias("w"))
    placed = hashed.withColumn("e", F.expr(_ENDS)).select("doc_id", "th", F.sort_array(F.expr(_LEAST_RUNS)).alias("s"))
    firsts = F.expr(f"transform({_FIRSTS}, x -> struct(x.f as f, x.k as k, x.a as a, x.b as b))")
    placed = materialize(placed.select("doc_id", "th", F.expr(_joined(_AGAIN)).alias("again"), F.expr(_PRINTS).alias("prints"), firsts.alias("firsts")), "places")
    met = placed.select("doc_id", F.explode("prints").alias("f")).groupBy("f").agg((F.min("doc_id") < F.max("doc_id")).alias("twice")).where("twice").select("f")
    met = materialize(met, "fingerprints")
    known = F.broadcast(met) if met.count() <= BROADCAST_FINGERPRINTS else met
    places = placed.select("doc_id", "th", F.explode("firsts").alias("x")).select("doc_id", "th", "x.f", "x.k", "x.a", "x.b").join(known, "f", "left_semi")
    first = places.groupBy("k").agg(F.min("doc_id").alias("fdoc"), F.max("doc_id").alias("last")).where("fdoc < last").select("k", "fdoc")
    across = places.join(first, "k").where("fdoc < doc_id").select("doc_id", "th", "a", "b")
    within = placed.select("doc_id", "th", F.explode("again").alias("x")).select("doc_id", "th", "x.a", "x.b")
    found = across.union(within).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set(F.struct("a", "b"))).alias("s"))
    out = materialize(found.select("doc_id", "th", F.expr(_joined("s")).alias("runs")), "runs")
    discard(placed, met)
    return out


def drop_repeated_runs(docs: DataFrame) -> DataFrame:
    """`docs` with later repeated runs of lines cut from `text`, and `lines_removed` (a column of that name is replaced).

    A run is deleted if it has at least 30 words and equals a run at an earlier place, by (doc_id, line), in the same
    or another document. Texts without such runs stay as they are, to the byte; what is left of the others is joined
    without change. A text that consists of repeated runs alone becomes empty. Null and empty texts and rows without
    an id pass through; rows that share an id are compared each, equal rows of one id both stay. An empty table gives
    no rows. The runs found are broadcast only after counting
    their ranges, else joined by a shuffle. Long texts take time in proportion to their lines.
    """
    found = repeated_runs(docs).select(F.col("doc_id").alias("of"), "th", "runs")
    if (found.agg(F.sum(F.size("runs"))).first()[0] or 0) <= BROADCAST_RANGES:  # a text has one range at least
        found = F.broadcast(found)
    names = [c for c in docs.columns if c != "lines_removed"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("text"))
    joined = rows.join(found, (F.col("id") == F.col("of")) & (F.xxhash64("text") == F.col("th")), "left")
    numbered = F.split("text", LINE)
    kept = F.filter(numbered, lambda x, i: ~F.exists("runs", lambda r: (i + 1 >= r["a"]) & (i + 1 <= r["b"])))
    hit = F.col("runs").isNotNull()
    removed = F.when(hit, F.size(numbered) - F.size(kept)).otherwise(0).cast("long")
    text = F.when(hit, F.array_join(kept, "")).otherwise(F.col("text"))
    return joined.select(*[text.alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in names], removed.alias("lines_removed"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars_before"))
    out = drop_repeated_runs(docs)
    return out.select("doc_id", "lines_removed", "n_chars_before", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), "text")
