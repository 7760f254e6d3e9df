"""Reciprocal-rank fusion of two ranked branches, and the retrieval strategies."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom import fixed
from citeloom.session import bounded_broadcast

HIT = ["query_id", "version_id", "chunk_id", "content_hash", "file_name", "heading_path", "text"]


def attach_chunks(hits: DataFrame, chunks: DataFrame, *, n_queries: int, k: int = fixed.MAX_CANDIDATES) -> DataFrame:
    """Add the chunk's text and locator columns to ranked hits.

    There are at most ``n_queries * k`` hits, so chunks are filtered where
    they are read and their texts never enter a shuffle.
    """
    few = bounded_broadcast(hits, n_queries * k, 256)
    columns = [c for c in chunks.columns if c not in hits.columns or c in ("version_id", "chunk_id")]
    return chunks.select(*columns).join(few, ["version_id", "chunk_id"])


def identity() -> Column:
    """What counts as one document: its content hash, else version and chunk."""
    return F.when(
        F.coalesce(F.length("content_hash"), F.lit(0)) > 0, F.concat(F.lit("h:"), F.col("content_hash"))
    ).otherwise(F.concat_ws("\n", F.lit("c:"), "version_id", "chunk_id"))


def candidate_id() -> Column:
    return F.when(F.length(F.trim("content_hash")) > 0, F.trim("content_hash")).otherwise(
        F.concat_ws(":", "version_id", "chunk_id")
    )


def branch_facts(hits: DataFrame, branch: str) -> DataFrame:
    """One row per candidate as a branch saw it."""
    return hits.select(
        "query_id",
        F.lit(branch).alias("branch"),
        candidate_id().alias("candidate_id"),
        "rank",
        F.col("score").alias("retrieval_score"),
        "content_hash",
        F.col("chunk_id").alias("source_id"),
    )


def active_only(hits: DataFrame, version_ids: DataFrame, limit: int = fixed.MAX_CANDIDATES) -> DataFrame:
    """Recheck hits against the admitted versions and renumber, at most ``limit`` each."""
    kept = hits.join(version_ids.select("version_id").distinct(), "version_id", "left_semi")
    order = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)


def _branches(vector: DataFrame, lexical: DataFrame) -> DataFrame:
    columns = [*HIT, "score", "rank"]
    return vector.select(*columns, F.lit("vector").alias("branch")).unionByName(
        lexical.select(*columns, F.lit("lexical").alias("branch"))
    )


def fuse(
    vector: DataFrame,
    lexical: DataFrame,
    *,
    rrf_k: int = fixed.RRF_K,
    profile: str = "balanced",
    weights: tuple[float, float] | None = None,
) -> DataFrame:
    """Every fused candidate with its facts: branch ranks, membership, rrf_score, fused_rank.

    Inside a branch only the first hit of an identity takes a rank; ranks are
    dense over identities. The vector hit is shown when both branches agree.
    All steps are keyed by question, so one exchange serves them all.
    """
    vector_weight, lexical_weight = weights or fixed.FUSION_WEIGHTS[profile]
    if rrf_k < 1 or vector_weight <= 0 or lexical_weight <= 0:
        raise ValueError("rrf_k and both weights must be positive")
    hits = _branches(vector, lexical).withColumn("identity", identity()).repartition("query_id")
    first = Window.partitionBy("query_id", "branch", "identity").orderBy("rank")
    dense = Window.partitionBy("query_id", "branch").orderBy("rank")
    ranked = (
        hits.withColumn("nth", F.row_number().over(first))
        .where("nth = 1")
        .withColumn("branch_rank", F.row_number().over(dense))
    )
    shown = [F.col(c) for c in HIT[1:]]
    on_vector = F.col("branch") == "vector"
    fused = (
        ranked.groupBy("query_id", "identity")
        .agg(
            F.min_by(F.struct(*shown), F.when(on_vector, 0).otherwise(1)).alias("hit"),
            F.max(F.when(on_vector, F.col("branch_rank"))).alias("vector_rank"),
            F.max(F.when(~on_vector, F.col("branch_rank"))).alias("lexical_rank"),
        )
        .select("query_id", "hit.*", "vector_rank", "lexical_rank")
        .withColumn(
            "rrf_score",
            F.coalesce(F.lit(vector_weight) / (F.lit(rrf_k) + F.col("vector_rank")), F.lit(0.0))
            + F.coalesce(F.lit(lexical_weight) / (F.lit(rrf_k) + F.col("lexical_rank")), F.lit(0.0)),
        )
    )
    order = Window.partitionBy("query_id").orderBy(
        F.col("rrf_score").desc(),
        "version_id",
        "chunk_id",
        "content_hash",
        F.concat_ws("\x00", "file_name", F.concat_ws("/", "heading_path"), "text"),
    )
    membership = (
        F.when(F.col("vector_rank").isNotNull() & F.col("lexical_rank").isNotNull(), "shared")
        .when(F.col("vector_rank").isNotNull(), "vector_only")
        .otherwise("lexical_only")
    )
    return fused.withColumns(
        {
            "membership": membership,
            "fused_rank": F.row_number().over(order),
            "candidate_id": candidate_id(),
        }
    )


def fused_hits(facts: DataFrame, limit: int = fixed.MAX_CANDIDATES) -> DataFrame:
    """The merged ranking: fused candidates up to ``min(limit, 20)``."""
    return facts.where(F.col("fused_rank") <= fixed.bounded(limit)).select(
        *HIT, F.col("rrf_score").alias("score"), F.col("fused_rank").alias("rank")
    )


def fusion_drops(
    vector: DataFrame, lexical: DataFrame, facts: DataFrame, limit: int = fixed.MAX_CANDIDATES
) -> DataFrame:
    """Why a hit did not leave fusion: merged by identity, or past the limit."""
    first = Window.partitionBy("query_id", "branch", "identity").orderBy("rank")
    merged = (
        _branches(vector, lexical)
        .withColumn("identity", identity())
        .withColumn("nth", F.row_number().over(first))
        .where("nth > 1")
        .select(
            "query_id",
            candidate_id().alias("candidate_id"),
            F.lit("rrf_content_hash_merge").alias("reason"),
            F.lit("rrf").alias("stage"),
            candidate_id().alias("kept_candidate_id"),
            F.col("chunk_id").alias("source_id"),
            "version_id",
        )
    )
    cut = facts.where(F.col("fused_rank") > fixed.bounded(limit)).select(
        "query_id",
        "candidate_id",
        F.lit("top20_truncation").alias("reason"),
        F.lit("rrf").alias("stage"),
        F.lit(None).cast("string").alias("kept_candidate_id"),
        F.col("chunk_id").alias("source_id"),
        "version_id",
    )
    return merged.unionByName(cut)


def choose_strategy(
    strategy: str,
    vector: DataFrame,
    lexical: DataFrame,
    *,
    limit: int = fixed.MAX_CANDIDATES,
    rrf_k: int = fixed.RRF_K,
    profile: str = "balanced",
) -> DataFrame:
    """Candidates of each question under one strategy.

    Hybrid strategies fall back to the vector hits, with their own scores, for
    questions whose lexical branch is empty; an empty vector branch still goes
    through fusion. ``hybrid_normalized`` differs only in the question
    variants behind the lexical branch.
    """
    if strategy not in fixed.STRATEGIES:
        raise ValueError("unsupported retrieval strategy")
    columns = [*HIT, "score", "rank"]
    if strategy == "vector":
        return vector.select(*columns)
    if strategy == "lexical":
        return lexical.select(*columns)
    has_lexical = lexical.select("query_id").distinct()
    merged = fused_hits(fuse(vector, lexical, rrf_k=rrf_k, profile=profile), limit)
    return merged.join(has_lexical, "query_id", "left_semi").select(*columns).unionByName(
        vector.join(has_lexical, "query_id", "left_anti").select(*columns)
    )
