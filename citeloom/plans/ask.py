"""Question table to evidence table: the retrieval operators composed."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom import fixed
from citeloom.functions import text as tx
from citeloom.operators import dedup, evidence, fusion, lexical, segments, vectors, versions
from citeloom.session import shared_dir, write_table


def written_indexes(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The hash and the lexical index of ``chunks`` (with their profiles), each written once."""
    return (
        segments.write_segments(vectors.hash_index(chunks), "hash-index"),
        segments.write_segments(lexical.lexical_index(chunks), "lexical-index"),
    )


def both_branches(
    questions: DataFrame,
    chunks: DataFrame,
    indexes: tuple[DataFrame, DataFrame],
    *,
    n_queries: int,
    k: int = fixed.MAX_CANDIDATES,
) -> tuple[DataFrame, DataFrame]:
    """Vector and lexical hits with their chunks attached.

    ``questions``: query_id, profile, question, queries; ``indexes`` are those
    of ``chunks``. The search is a job of its own: its hits (at most 40 rows a
    question, attached to their chunks in one read) are written once, and
    every later step starts from that table instead of searching again.
    """
    hashes, postings = indexes
    vector = vectors.hash_hits(questions, hashes, n_queries=n_queries, k=k).withColumn("branch", F.lit("vector"))
    words = lexical.lexical_hits(questions, postings, n_queries=n_queries, k=k).withColumn("branch", F.lit("lexical"))
    both = fusion.attach_chunks(vector.unionByName(words), chunks, n_queries=2 * n_queries, k=k)
    kept = write_table(both, shared_dir(both.sparkSession, "hits"))
    return kept.where("branch = 'vector'").drop("branch"), kept.where("branch = 'lexical'").drop("branch")


def question_variants(questions: DataFrame, strategy: str) -> DataFrame:
    """Questions with the lexical queries their strategy asks."""
    cleaned = tx.clean_question(F.col("question"))
    if strategy != "hybrid_normalized":
        return questions.withColumn("queries", F.array(cleaned))
    normalised = tx.normalise_query(cleaned)
    aliased, applied = tx.apply_aliases(F.col("normalised"))
    return (
        questions.withColumn("normalised", normalised)
        .withColumn("aliases_applied", applied)
        .withColumn("queries", F.array_distinct(F.array(cleaned, F.col("normalised"), aliased)))
        .drop("normalised")
    )


def governed_questions(requests: DataFrame) -> DataFrame:
    """Requests (query_id, question, audience_scope, as_of) with their profile."""
    return requests.withColumn(
        "profile", versions.profile_number(F.col("audience_scope"), F.col("as_of"))
    )


def retrieve(
    requests: DataFrame,
    chunks: DataFrame,
    version_table: DataFrame,
    metadata: DataFrame,
    *,
    strategy: str = "hybrid",
    n_queries: int,
) -> DataFrame:
    """Governed candidates: only chunks each request may see are ever scored."""
    profiles = versions.request_profiles(requests)
    eligible = versions.eligible_versions(version_table, metadata, profiles)
    visible = versions.with_profiles(chunks, eligible)
    asked = question_variants(governed_questions(requests), strategy)
    vector, words = both_branches(asked, visible, written_indexes(visible), n_queries=n_queries)
    combined = fusion.choose_strategy(strategy, vector, words)
    return dedup.retained(combined, dedup.deduplicate(combined))


def evidence_table(candidates: DataFrame, questions: DataFrame, scorer=None) -> tuple[DataFrame, DataFrame]:
    """Reranked candidates, and the evidence that passes the relevance gate."""
    reranked = evidence.rerank(candidates.join(questions.select("query_id", "question"), "query_id"), scorer)
    return reranked, gate(reranked)


def gate(reranked: DataFrame) -> DataFrame:
    return evidence.relevance_gate(evidence.select_evidence(reranked))
