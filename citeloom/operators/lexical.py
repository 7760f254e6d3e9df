"""Lexical ranking: postings, document frequency, scored hits."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom import fixed
from citeloom.functions import text as tx
from citeloom.operators import segments


def tokenised(chunks: DataFrame) -> DataFrame:
    """Adds ``text_tokens`` and ``heading_tokens`` (heading parts joined by a space)."""
    return chunks.withColumns(
        {
            "text_tokens": tx.lexical_tokens(F.col("text")),
            "heading_tokens": tx.lexical_tokens(F.concat_ws(" ", "heading_path")),
        }
    )


def _fields(chunks: DataFrame) -> DataFrame:
    """One row per chunk field: version_id, chunk_id, field, tokens."""
    entries = F.array(
        F.struct(F.lit("heading").alias("field"), F.col("heading_tokens").alias("tokens")),
        F.struct(F.lit("text").alias("field"), F.col("text_tokens").alias("tokens")),
    )
    return tokenised(chunks).select("version_id", "chunk_id", F.explode(entries).alias("entry")).select(
        "version_id", "chunk_id", "entry.*"
    )


def postings(chunks: DataFrame) -> DataFrame:
    """(token, version_id, chunk_id, field, tf), one row per token of a chunk field.

    Keyed by chunk first, so a token that occurs everywhere is spread over all
    tasks; write the result bucketed by token when it is to be kept.
    """
    return (
        _fields(chunks)
        .select("version_id", "chunk_id", "field", F.explode("tokens").alias("token"))
        .groupBy("version_id", "chunk_id", "field", "token")
        .agg(F.count("*").alias("tf"))
    )


def query_tokens(questions: DataFrame) -> DataFrame:
    """(query_id, profile, token): distinct tokens over all variants of a question."""
    return questions.select(
        "query_id",
        "profile",
        F.explode(
            F.array_distinct(F.flatten(F.transform("queries", lambda q: tx.lexical_tokens(q))))
        ).alias("token"),
    )


def weighted_tokens(tokens: DataFrame, df: DataFrame, size: DataFrame) -> DataFrame:
    """Question tokens with idf = ln((N + 1) / (df + 1)) + 1; unknown tokens drop out."""
    return (
        tokens.join(df, ["profile", "token"])
        .join(size, "profile")
        .select(
            "query_id",
            "profile",
            F.col("token").alias("f"),
            (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1.0).alias("w"),
        )
    )


def lexical_index(chunks: DataFrame) -> DataFrame:
    """The inverted index of chunks (version_id, chunk_id, text, heading_path, profiles).

    One scan splits every text; worth writing once. A search reads postings only.
    """
    fields = {"text_tokens": fixed.TEXT_BOOST, "heading_tokens": fixed.HEADING_BOOST}
    return segments.build_segments(tokenised(chunks), fields, "log_tf")


def lexical_hits(
    questions: DataFrame, index: DataFrame, *, n_queries: int, k: int = fixed.MAX_CANDIDATES
) -> DataFrame:
    """The best ``k`` (at most 20) chunks per question by lexical score.

    ``questions``: query_id, profile, queries (array of variants). ``index`` is
    a table written from :func:`lexical_index`. Headings and text count once
    in a token's document frequency.
    """
    return indexed_hits(query_tokens(questions), index, n_queries=n_queries, k=fixed.bounded(k))


def indexed_hits(tokens: DataFrame, index: DataFrame, *, n_queries: int, k: int) -> DataFrame:
    """Best ``k`` chunks for the question tokens (query_id, profile, token), all from the index."""
    wanted = tokens.select(F.col("token").alias("f"))
    df = segments.frequencies(index, wanted, n_queries=n_queries).withColumnRenamed("f", "token")
    return segments.top_k(index, weighted_tokens(tokens, df, segments.sizes(index)), k, n_queries=n_queries)


def match_statistics(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per question and token: matched chunks and occurrences, joined on the token.

    Tokens are counted before the join, map-side, so each side has one row per
    token and no pair of question and chunk is written.
    """
    tokens = query_tokens(questions)
    wanted = tokens.select("token").distinct()
    fields = _fields(chunks)
    chunk_counts = (
        fields.select("field", F.explode(F.array_distinct("tokens")).alias("token"))
        .join(wanted, "token", "left_semi")
        .groupBy("token")
        .agg(
            F.count_if(F.col("field") == "text").alias("text_chunks"),
            F.count_if(F.col("field") == "heading").alias("heading_chunks"),
        )
    )
    occurrences = (
        fields.select(F.explode("tokens").alias("token"))
        .join(wanted, "token", "left_semi")
        .groupBy("token")
        .agg(F.count("*").alias("occurrences"))
    )
    return tokens.join(chunk_counts, "token").join(occurrences, "token").select(
        "query_id", "token", "text_chunks", "heading_chunks", "occurrences"
    )


# --- diagnostic scorer: distinct tokens of the text only ----------------------


def diagnostic_index(chunks: DataFrame) -> DataFrame:
    """The inverted index of distinct diagnostic tokens; chunks without any are left out and not counted."""
    tokens = chunks.select(
        "version_id",
        "chunk_id",
        segments.admit_all().alias("profiles"),
        tx.diagnostic_tokens(F.col("text")).alias("tokens"),
    ).where(F.size("tokens") > 0)
    return segments.build_segments(tokens, {"tokens": 1.0}, "log_tf")


def diagnostic_hits(questions: DataFrame, index: DataFrame, *, n_queries: int, k: int = 20) -> DataFrame:
    """Sum of idf over shared distinct tokens, from a written :func:`diagnostic_index`."""
    asked = questions.select(
        "query_id", F.lit(0).alias("profile"), F.explode(tx.diagnostic_tokens(F.col("question"))).alias("token")
    )
    return indexed_hits(asked, index, n_queries=n_queries, k=k)


def ranked(hits: DataFrame, *order) -> DataFrame:
    """Number the hits of each question from 1 in the given order."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
