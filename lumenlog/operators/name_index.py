"""Substring search over a kept index: the character substrings of all names as a table in buckets, built once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenlog.operators.joins import _grams

GRAM = 3
BUCKETS = 64


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


class NameIndex:
    """An index under `path`, one folder a bucket of grams (substrings of up to three characters of the name in lower case).

    `postings`: `(gram, known, *payload)`, sorted by gram within its files, so that row groups are skipped; a gram that
    most names hold is dealt over many files. `counts`: `(gram, n)`. A search opens the buckets of the grams it asks for:
    the rarest of them leaves a few names, and only these are tested. Null and empty names are in no answer, and an empty
    text finds nothing; case is ignored as `lower` does; rows that repeat are found once."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    def build(self, names: DataFrame, text: str, *payload: str) -> NameIndex:
        """Writes the index of `names`, with the columns that answers carry; one pass that shuffles postings by bucket."""
        rows = names.select(F.lower(F.col(f"`{text}`")).alias("known"), *[F.col(f"`{c}`") for c in payload]).where("known <> ''").distinct()
        grams = F.array_distinct(F.concat(*[_grams(F.col("known"), n) for n in range(1, GRAM + 1)]))
        dealt = rows.withColumn("gram", F.explode(grams)).withColumn("bucket", _bucket(F.col("gram"), self.buckets))
        dealt.hint("rebalance", "bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{self.path}/postings")
        dealt.limit(0).write.parquet(f"{self.path}/columns")  # an empty index has no other file that names them
        counts = self._read("postings").groupBy("bucket", "gram").agg(F.count("*").alias("n"))
        counts.repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{self.path}/counts")
        return self

    def _read(self, name: str) -> DataFrame:
        columns = "gram string, n long, bucket int" if name == "counts" else self.spark.read.parquet(f"{self.path}/columns").schema
        return self.spark.read.schema(columns).parquet(f"{self.path}/{name}")

    @staticmethod
    def _asked(asked: Column) -> Column:
        return F.when(F.length(asked) < GRAM, F.array(asked)).otherwise(F.array_distinct(_grams(asked, GRAM)))

    def search(self, part: str) -> DataFrame:
        """`known` and the payload of all names that hold `part`. The driver looks up the counts of its grams alone."""
        low = F.lower(F.lit(part))
        one = self.spark.range(1).select(low.alias("low"), self._asked(low).alias("grams")).first()
        grams = [F.lit(g) for g in one.grams]
        found = self._read("counts").where(F.col("bucket").isin([_bucket(g, self.buckets) for g in grams]) & F.col("gram").isin(one.grams))
        counts = {r.gram: r.n for r in found.select("gram", "n").collect()}
        rarest = min(one.grams, key=lambda g: (counts.get(g, 0), g))
        rows = self._read("postings").where((F.col("bucket") == _bucket(F.lit(rarest), self.buckets)) & (F.col("gram") == rarest))
        return rows.where(F.col("known").contains(F.lit(one.low)) & (F.lit(one.low) != "")).drop("gram", "bucket")

    def held(self, names: DataFrame, text: str) -> DataFrame:
        """`(text, known, payload)` for each distinct text that a name of the index holds; many texts by two equi joins."""
        asked = names.select(F.col(f"`{text}`").alias("__text")).distinct().withColumn("__asked", F.lower("__text")).where("__asked <> ''")
        keyed = asked.withColumn("gram", F.explode(self._asked(F.col("__asked")))).withColumn("bucket", _bucket(F.col("gram"), self.buckets))
        counted = keyed.join(self._read("counts"), ["bucket", "gram"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
        w = Window.partitionBy("__text").orderBy("n", "gram")  # as many rows as a text has characters
        rarest = counted.withColumn("__rank", F.row_number().over(w)).where("__rank = 1").drop("n", "__rank")
        rows = rarest.join(self._read("postings"), ["bucket", "gram"]).where(F.col("known").contains(F.col("__asked")))
        return rows.drop("bucket", "gram", "__asked").withColumnRenamed("__text", text)
