"""Mixing sources to target weights (native): DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlog.llm.common import materialize, table, word_count

CAP = 3.0
BROADCAST_SOURCES = 100_000
OWN = ["size", "source_size", "target", "copies", "taken"]
SEEDS = 512  # that are tried for each source
CIRCLE = 2**32

def source_targets(sizes: DataFrame, cap: float = CAP) -> DataFrame:
    """Per source of `sizes(source, source_size)`: weight, target and rate; other columns stay.

    Weights run 1, 2, 3 and again over the sources by code point, null last. All targets sum to the total size,
    except that a target stops at `cap` times its source's size and the excess is shared anew by weight until none
    is above: that is min(cap*size, level*weight) with one common level, found after sorting the sources by
    cap*size/weight. The windows run over one row per source, the only thing here that isn't partitioned.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.hex(F.col("source").cast("binary")))
    weighed = sizes.withColumn("weight", ((F.row_number().over(by_name) - 1) % 3 + 1).cast("double"))
    weighed = weighed.withColumn("ceiling", F.lit(cap) * F.col("source_size"))
    order = [F.col("ceiling") / F.col("weight"), F.col("source").isNull(), F.hex(F.col("source").cast("binary"))]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(*order).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))
    stepped = weighed.withColumn("level", left / F.sum("weight").over(rest))
    level = F.max("level").over(everything)  # it rises with every source rightly stopped and falls after those
    out = stepped.withColumn("target", F.least(F.col("ceiling"), level * F.col("weight")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    more = [c for c in sizes.columns if c not in ("source", "source_size")]
    return out.select("source", F.col("source_size").cast("long").alias("source_size"), "weight", "target", rate.alias("rate"), *more)


def drawn(key: Column, seed: str, at: int) -> Column:
    """A whole number below 2^32 from 8 hex digits of an md5, the same in every engine and run."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), at, 8), 16, 10).cast("long")


def mix_plan(docs: DataFrame, cap: float = CAP, seed: str = "mix", payload: list[str] | None = None) -> DataFrame:
    """`docs` with `size, source_size, target, copies, taken`: the copies of each document are floor(rate) plus one
    Bernoulli copy, seeded by a hash of its id (and text hash), with probability equal to the fraction.

    A document draws a point u and a step v; under seed j its point is u + j*v on a circle of 2^32, and its copy is
    taken if that lies within `fraction` of the circle. Each source takes that one of 512 seeds whose copies come
    nearest to its target: one aggregation to 512 numbers a source tells. So what a source takes misses its target by
    the least of 512 independent chances.

    Null text has size 0; a null source is a source of its own; rows that share id and text get the same copies;
    no rows give no rows. A source's rate is target/size and never above `cap`, so neither are the copies.
    Existing columns with these names are replaced. `payload` names the columns to keep besides those (all by
    default); where it names none but the id, sizes and draws are written once instead of reading the texts twice.
    The targets are one row a source; they are broadcast only after counting them, else joined by a shuffle.
    """
    names = [c for c in (docs.columns if payload is None else payload) if c not in OWN]
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce(F.col("text"), F.lit(""))))
    row = F.struct(*[F.col(f"`{c}`") for c in names]) if names else F.lit(None)
    base = docs.select("source", word_count("text").alias("size"), drawn(key, seed, 1).alias("u"), drawn(key, seed, 9).alias("v"), row.alias("row"))
    if names == ["doc_id"]:
        base = materialize(base, "draws")
    sizes = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    rated = source_targets(sizes, cap).select(F.col("source").alias("of"), "source_size", "target", "rate", ((F.col("rate") - F.floor("rate")) * CIRCLE).alias("within"))
    rated = materialize(rated, "targets")
    few = rated.count() <= BROADCAST_SOURCES
    at_hand = lambda df: F.broadcast(df) if few else df
    tried = base.where("size > 0").select("source", "size", "u", "v").join(at_hand(rated), F.col("source").eqNullSafe(F.col("of"))).where("within > 0")
    point = lambda j: F.pmod(F.col("u") + j * F.col("v"), F.lit(CIRCLE))
    tried = tried.select("of", "size", "within", "source_size", "u", "v", F.explode(F.sequence(F.lit(0), F.lit(SEEDS - 1))).alias("j"))
    sums = tried.groupBy("of", "j").agg(F.sum(F.when(point(F.col("j")) < F.col("within"), F.col("size")).otherwise(0)).alias("w"), F.max("within").alias("within"), F.max("source_size").alias("total"))
    miss = F.abs(F.col("w") - F.col("within") / CIRCLE * F.col("total"))
    seeds = sums.groupBy("of").agg(F.min_by("j", F.struct(miss, "j")).alias("j"))
    chosen = seeds.select(F.col("of").alias("for"), "j")
    targets = materialize(rated.join(chosen, F.col("of").eqNullSafe(F.col("for")), "left").select("of", "source_size", "target", "rate", "within", F.coalesce("j", F.lit(0)).alias("j")), "seeds")
    joined = base.join(at_hand(targets), F.col("source").eqNullSafe(F.col("of")), "left")
    copies = (F.floor("rate") + F.when(point(F.col("j")) < F.col("within"), 1).otherwise(0)).cast("long")
    return joined.select(*[F.col("row").getField(c).alias(c) for c in names], "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, cap: float = CAP, seed: str = "mix") -> DataFrame:
    """The mix itself: every document as often as `mix_plan` says, with the columns of `docs`."""
    names = docs.columns
    whole = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in names]).alias("document"))
    planned = mix_plan(whole, cap, seed, payload=["document"])
    repeated = planned.where("copies > 0").select("document", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return repeated.select(*[F.col("document").getField(c).alias(c) for c in names])


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_plan(docs, payload=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, text, source,
         CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS ss FROM d GROUP BY source
), w AS (
  SELECT source, ss, 3.0 * ss AS ceiling,
         CAST((row_number() OVER (ORDER BY source IS NULL, hex(encode(source))) - 1) % 3 + 1 AS DOUBLE) AS weight FROM s
), l AS (
  SELECT *, (sum(ss) OVER () - coalesce(sum(ceiling) OVER (ORDER BY ceiling / weight, source IS NULL, hex(encode(source))
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY ceiling / weight, source IS NULL, hex(encode(source))
               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, ss, least(ceiling, max(level) OVER () * weight) AS target FROM l
), k AS MATERIALIZED (
  SELECT doc_id, size, source, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS u, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS v
  FROM (SELECT *, md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS h FROM d)
), r AS MATERIALIZED (
  SELECT *, (rate - floor(rate)) * 4294967296 AS inside FROM (SELECT *, CASE WHEN ss > 0 THEN target / ss ELSE 0.0 END AS rate FROM t)
), tries AS (
  SELECT k.source, s.j, abs(sum(CASE WHEN (k.u + s.j * k.v) % 4294967296 < r.inside THEN k.size ELSE 0 END) - max(r.inside) / 4294967296 * max(r.ss)) AS d
  FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source CROSS JOIN (SELECT unnest(range(512)) AS j) s
  WHERE k.size > 0 AND r.inside > 0 GROUP BY k.source, s.j
), seeds AS (
  SELECT source, arg_min(j, struct_pack(d := d, j := j)) AS j FROM tries GROUP BY source
), j AS (
  SELECT k.doc_id, k.size, CAST(r.ss AS BIGINT) AS source_size, r.target, r.rate, r.inside, (k.u + coalesce(o.j, 0) * k.v) % 4294967296 AS p
  FROM k JOIN r ON k.source IS NOT DISTINCT FROM r.source LEFT JOIN seeds o ON k.source IS NOT DISTINCT FROM o.source
)
SELECT doc_id, size, source_size, target, CAST((floor(rate) + CASE WHEN p < inside THEN 1 ELSE 0 END) * size AS BIGINT) AS taken
FROM j
"""
