"""Four retrieval arms over a question table, and the facts their reports need."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.operators import dedup, evidence, fusion
from citeloom.plans.ask import both_branches, written_indexes
from citeloom.session import shared_dir, write_table


def arm_candidates(
    questions: DataFrame, chunks: DataFrame, *, n_queries: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Search once, then :func:`arms_from`."""
    vector, words = both_branches(questions, chunks, written_indexes(chunks), n_queries=n_queries)
    return arms_from(vector, words)


def arms_from(vector: DataFrame, words: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Candidates of every (case, arm), the drop facts, and the fusion facts.

    All arms share the hits of the two branches.
    """
    facts = fusion.fuse(vector, words)
    lists = {
        "vector": vector,
        "lexical": words,
        "hybrid": fusion.choose_strategy("hybrid", vector, words),
    }
    lists["hybrid_audit"] = lists["hybrid"]
    columns = [*fusion.HIT, "score", "rank"]
    combined = None
    for arm, hits in lists.items():
        rows = hits.select(*columns).withColumn("query_id", F.concat_ws("|", "query_id", F.lit(arm)))
        combined = rows if combined is None else combined.unionByName(rows)
    # Lists and decisions are small and read several times.
    spark = vector.sparkSession
    combined = write_table(combined, shared_dir(spark, "arm-lists"))
    audited = F.col("query_id").endswith("|hybrid_audit")
    decisions = dedup.deduplicate(combined.where(~audited)).unionByName(
        dedup.without_dedup(combined.where(audited))
    )
    decisions = write_table(decisions, shared_dir(spark, "arm-decisions"))
    kept = dedup.retained(combined, decisions)
    drops = dedup.drop_facts(decisions).unionByName(
        fusion.fusion_drops(vector, words, facts).withColumn(
            "query_id", F.explode(F.array(*[F.concat_ws("|", "query_id", F.lit(a)) for a in ("hybrid", "hybrid_audit")]))
        )
    )
    return split_arm(kept), split_arm(drops), facts


def split_arm(rows: DataFrame) -> DataFrame:
    parts = F.split("query_id", r"\|")
    return rows.withColumn("case_id", parts[0]).withColumn("arm", parts[1])


def arm_evidence(candidates: DataFrame, questions: DataFrame) -> DataFrame:
    """Evidence of every (case, arm): reranked, cut to six, gated."""
    asked = questions.select(F.col("query_id").alias("case_id"), "question")
    reranked = evidence.rerank(candidates.join(asked, "case_id"))
    return evidence.relevance_gate(evidence.select_evidence(reranked))


def duplicate_noise(candidates: DataFrame) -> DataFrame:
    """Per (case, arm): candidates whose content hash came earlier in the list."""
    return candidates.groupBy("case_id", "arm").agg(
        (F.count("*") - F.count_distinct("content_hash")).alias("duplicate_noise")
    )
