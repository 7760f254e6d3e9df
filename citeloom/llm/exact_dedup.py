"""Exact duplicates by distributed radix partitioning of the texts' bytes.

Texts are split into groups by their first bytes, groups of several texts by
the next bytes, and so on until a group holds one text or its texts have ended
together. Groups are told apart by the bytes themselves, never by a digest. A
round counts its groups before rows move, so a text with millions of copies is
one count per task there; the rows then meet their counts in a join whose large
partitions Spark splits. Each round looks four times as far as the one before,
so a text of n bytes takes part in log4(n) rounds, and only texts that still
have a partner are carried on.

Defined cases: a null text equals the empty text; a null id is smaller than any
other and stays only if all ids of its group are null; repeated rows are copies
of each other, and rows that share the largest id of their group are all
``kept``; an empty table gives an empty result; other columns are not read.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.registry import query, table
from citeloom.llm.written import written

FIRST_BYTES = 64
GROWTH = 4


def _round(rows: DataFrame, depth: int) -> DataFrame:
    """Rows of one round, each resolved (``open`` false) or to be split further."""
    keyed = rows.withColumn("head", F.substring("body", 1, depth))
    groups = (
        keyed.groupBy("head")
        .agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
        .filter("n > 1")
    )
    met = keyed.join(groups, "head", "left")
    ended = F.length("body") < depth
    still = F.col("n").isNotNull() & ~ended
    copies = F.col("n").isNotNull() & ended
    return met.select(
        "doc_id",
        F.when(copies, F.col("last")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.when(copies, F.col("n")).otherwise(F.lit(1).cast("long")).alias("group_size"),
        "digest",
        F.when(still, F.col("body")).alias("body"),
        still.alias("open"),
    )


def copy_groups(docs: DataFrame, first_bytes: int = FIRST_BYTES, growth: int = GROWTH) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per document."""
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    rows = docs.select("doc_id", body.alias("body")).withColumn("digest", F.unhex(F.sha2("body", 256)))
    depth, found = first_bytes, []
    while True:
        step = written(_round(rows, depth), "exact-dedup", "open")
        found.append(step.filter("NOT open").drop("body", "open"))
        rows = step.filter("open").select("doc_id", "body", "digest")
        if rows.isEmpty():
            break
        depth *= growth
    result = found[0]
    for part in found[1:]:
        result = result.unionByName(part)
    return result.select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""


@query("op5_exact_dedup", SQL)
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copy_groups(table(spark, sf_dir, "documents"))
