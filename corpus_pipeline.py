"""From raw documents to packed training sequences: five stages, each written as Parquet and read by the next.

1. quality: the ordinal classifier is fitted on the labels and documents that it rejects go.
2. lines: later copies of repeated runs of lines are cut; a document that consisted of nothing else goes.
3. near_duplicates: of documents alike by five-word shingles (0.8 or more) one stays, the one of the smallest id.
4. mixing: sources are brought to their target weights by repeating or leaving out whole documents.
5. packing: what is left is packed, one row per piece of a sequence of 2048 tokens.

All stages but the last return the columns of `documents`. Empty inputs give empty outputs; null texts pass the
stages as empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenlog.llm.common import materialize, table
from lumenlog.llm.lines import drop_repeated_runs
from lumenlog.llm.minhash import drop_near_duplicates
from lumenlog.llm.mixing import mix
from lumenlog.llm.packing import pack_balanced
from lumenlog.llm.quality import grade_documents, train


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(docs, table(spark, sf_dir, "labels"))
    return grade_documents(docs, model).where("accepted").select(*[F.col(f"`{c}`") for c in docs.columns])


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    cut = drop_repeated_runs(docs).where("lines_removed = 0 or trim(text) <> ''")
    whole = F.col("lines_removed") == 0
    n_chars = F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return cut.withColumn("n_chars", n_chars).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_duplicates(docs, k=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_balanced(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: No SQL: the classifier, the tokenizer and the packing can't be expressed; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
