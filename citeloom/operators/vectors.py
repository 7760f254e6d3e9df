"""Vector branch: hash embeddings, dense search, validation, batch jobs."""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from citeloom import fixed
from citeloom.functions import text as tx
from citeloom.operators import segments


def hash_vector(texts: DataFrame, key: str) -> DataFrame:
    """Sparse unit vectors: (key, bucket, weight) for each text."""
    counts = (
        texts.select(key, F.explode(tx.hash_buckets(F.col("text"))).alias("bucket"))
        .groupBy(key, "bucket")
        .agg(F.count("*").alias("n"))
    )
    norms = counts.groupBy(key).agg(F.sqrt(F.sum(F.col("n") * F.col("n")).cast("double")).alias("length"))
    return counts.join(norms, key).select(key, "bucket", (F.col("n") / F.col("length")).alias("weight"))


def hash_index(chunks: DataFrame) -> DataFrame:
    """The inverted index of hash embeddings; one scan hashes every text's tokens. Worth writing once."""
    return segments.build_segments(
        chunks.withColumn("buckets", tx.hash_buckets(F.col("text"))), {"buckets": 1.0}, "cosine"
    )


def hash_hits(questions: DataFrame, index: DataFrame, *, n_queries: int, k: int = fixed.MAX_CANDIDATES) -> DataFrame:
    """Top-k chunks by cosine of hash embeddings (questions: query_id, profile, question)."""
    vectors = hash_vector(questions.select("query_id", F.col("question").alias("text")), "query_id")
    features = vectors.join(questions.select("query_id", "profile"), "query_id").select(
        "query_id", "profile", F.col("bucket").alias("f"), F.col("weight").alias("w")
    )
    return segments.top_k(index, features, fixed.bounded(k), n_queries=n_queries)


def vector_hits(queries: DataFrame, points: DataFrame, *, n_queries: int, k: int) -> DataFrame:
    """Exact cosine top-k of dense vectors.

    ``queries``: query_id, profile, embedding; ``points``: version_id,
    chunk_id, profiles, embedding.
    """
    packed = segments.build_segments(points, {"embedding": 1.0}, "dense")
    features = queries.select("query_id", "profile", F.col("embedding").alias("x"))
    return segments.top_k(packed, features, k, n_queries=n_queries)


@F.pandas_udf(DoubleType())
def _bucket_cosine(left: pd.Series, right: pd.Series) -> pd.Series:
    def score(a, b):
        x = np.bincount(np.asarray(a, dtype=np.int64), minlength=1024)
        y = np.bincount(np.asarray(b, dtype=np.int64), minlength=1024)
        length = np.sqrt(float(x @ x)) * np.sqrt(float(y @ y))
        return float(x @ y) / length if length else 0.0

    return pd.Series([score(a, b) for a, b in zip(left, right)], dtype="float64")


def hash_score(question: Column, text: Column) -> Column:
    """Cosine of the two texts' hash embeddings, tokens hashed in the JVM."""
    return F.round(_bucket_cosine(tx.hash_buckets(question), tx.hash_buckets(text)), segments.SCORE_DIGITS)


def vector_problem(vector: Column, dimension: int) -> Column:
    """NULL for a usable vector, else its first fault."""
    return (
        F.when(vector.isNull() | (F.size(vector) != dimension), F.lit("VECTOR_DIMENSION"))
        .when(
            ~F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))),
            F.lit("VECTOR_NOT_FINITE"),
        )
        .otherwise(F.lit(None).cast("string"))
    )


def check_vectors(points: DataFrame, dimension: int) -> DataFrame:
    """Violations: (version_id, chunk_id, problem), including repeated vectors."""
    faults = points.select(
        "version_id", "chunk_id", vector_problem(F.col("embedding"), dimension).alias("problem")
    ).where(F.col("problem").isNotNull())
    repeated = (
        points.groupBy("version_id", "chunk_id")
        .agg(F.count("*").alias("n"))
        .where(F.col("n") > 1)
        .select("version_id", "chunk_id", F.lit("VECTOR_REPEATED").alias("problem"))
    )
    return faults.unionByName(repeated)


def hash_embedder(texts: list[str]) -> list[list[float]]:
    """Default embedder: dense form of the hash embedding."""
    import hashlib
    import re

    out = []
    for text in texts:
        vector = np.zeros(1024)
        for token in re.findall(r"[一-鿿]|[a-z0-9]+", text.casefold()):
            vector[int.from_bytes(hashlib.sha256(token.encode("utf-8")).digest()[:4], "big") % 1024] += 1
        out.append((vector / (np.linalg.norm(vector) or 1.0)).tolist())
    return out


def embed(
    texts: DataFrame,
    key: str,
    embedder: Callable[[list[str]], list[list[float]]] = hash_embedder,
    *,
    batch: int = fixed.EMBED_BATCH,
) -> DataFrame:
    """(key, embedding) with the embedder called on at most ``batch`` texts.

    The embedder must return one finite vector per text, in order; anything
    else fails the task rather than storing a wrong vector.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                vectors = embedder(list(part["text"]))
                if len(vectors) != len(part):
                    raise ValueError("embedding count does not match the batch")
                if not all(len(v) and np.isfinite(v).all() for v in vectors):
                    raise ValueError("embedding is empty or not finite")
                yield pd.DataFrame({key: part[key].values, "embedding": list(vectors)})

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(key, "text").mapInPandas(run, f"{key} {kind}, embedding array<double>")


def rerank_scores(
    pairs: DataFrame, scorer: Callable[[list[tuple[str, str]]], list[float]] | None = None
) -> DataFrame:
    """Adds ``rerank_score`` to (question, text) pairs; a custom scorer gets batches."""
    if scorer is None:
        return pairs.withColumn("rerank_score", hash_score(F.col("question"), F.col("text")))

    def score(questions: pd.Series, texts: pd.Series) -> pd.Series:
        scores = scorer(list(zip(questions, texts)))
        if len(scores) != len(questions):
            raise ValueError("rerank count does not match the batch")
        values = pd.Series(scores, dtype="float64")
        if not values.between(0.0, 1.0).all():
            raise ValueError("rerank score is outside [0, 1]")
        return values

    return pairs.withColumn(
        "rerank_score", F.pandas_udf(score, DoubleType())(F.col("question"), F.col("text"))
    )
