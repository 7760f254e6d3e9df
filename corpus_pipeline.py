"""Documents to training tokens: bad ones out, repeats out, sources mixed, texts encoded.

Each stage takes ``(spark, docs, sf_dir)`` and returns a table that is written
before the next stage reads it. All but the last return the columns of
``documents``; empty tables, null and repeated rows are as the operators say.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import bpe, lines, minhash, mixing, quality
from citeloom.llm.registry import table
from citeloom.llm.written import written


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grade classifier selects; fitted on the labelled ones among them."""
    return quality.selected(docs, table(spark, sf_dir, "labels"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line is similar to; ``n_chars`` counts what is left."""
    left = lines.without_repeated_lines(docs)
    return left.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else left


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's share takes them."""
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every document (packed), and the bytes they decode to; clashing names are lengthened."""
    return bpe.with_round_trip(docs)[0].drop("text")


STAGES = [
    ("select_quality", select_quality),
    ("drop_repeated_lines", drop_repeated_lines),
    ("drop_near_duplicates", drop_near_duplicates),
    ("mix_sources", mix_sources),
    ("encode", encode),
]

#: The classifier, the sketches and the tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
