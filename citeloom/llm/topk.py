"""Exact search for the largest inner products, with bounds from segment statistics.

A vector is cut into 1, 4 and 16 segments, and each segment keeps its mean and
its deviation (the length of what is left when the mean is taken off). For two
vectors the means and deviations bound the inner product from above, which is
the same as bounding the distance ``|q|^2 + |c|^2 - 2 q.c`` from below. Pairs
are dropped coarse to fine against the k-th best score known so far, and exact
integer scores are computed for the pairs that are left.

Queries and candidates are dealt into blocks of bounded size, and each pair of
blocks is one group: data grow, groups don't. A group returns k rows a query.

Defined cases: a null vector, or one with a null, NaN or infinite component,
takes no part; shorter vectors count as padded with zeros; rows that share the
query's id are its own; other repeated rows each count; a null id is never a
query and comes after all others in a tie; an empty table gives no rows; other
columns are not read. Scores are exact while they fit in 64 bits.
"""

from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.llm.registry import query, table

LEVELS = (1, 4, 16)
QUERY_BLOCK, CANDIDATE_BLOCK, CHUNK = 1024, 16_384, 128
SCHEMA = "query_id long, twin int, vec_id long, score long"


def integer_vectors(rows: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id, ints) of the rows whose vectors are whole and finite."""

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))

    return rows.filter(F.col(vector).isNotNull() & F.forall(vector, finite)).select(
        F.col("vec_id").cast("long"),
        F.transform(vector, lambda x: F.floor(x.cast("double") * scale)).alias("ints"),
    )


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of integers, padded with zeros to ``width``."""
    lists = column.combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _statistics(values: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    parts = values.astype(np.float64).reshape(len(values), segments, -1)
    means = parts.mean(axis=2)
    left = np.sqrt(((parts - means[:, :, None]) ** 2).sum(axis=2))
    return means * np.sqrt(parts.shape[2]), left


def search(
    q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, c_null: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score): the ``k`` best of every query."""
    levels = [(np.hstack(_statistics(q, s)), np.hstack(_statistics(c, s))) for s in LEVELS]
    # The bounds are sums of a few dozen products; this is far more than their rounding error.
    slack = 1e-9 * np.linalg.norm(q.astype(float), axis=1)[:, None] * np.linalg.norm(c.astype(float), axis=1).max() + 1e-6
    found = []
    for start in range(0, len(q), CHUNK):
        rows = slice(start, start + CHUNK)
        own = (q_ids[rows, None] == c_ids) & ~c_null
        bound = levels[0][0][rows] @ levels[0][1].T + slack[rows]
        bound[own] = -np.inf
        # A first k-th best score from the candidates that look best.
        some = min(len(c), max(4 * k, 32))
        best = np.argpartition(-bound, some - 1, axis=1)[:, :some]
        first = np.einsum("qd,qsd->qs", q[rows], c[best])
        allowed = ~np.take_along_axis(own, best, 1)
        ranked = np.sort(np.where(allowed, first.astype(np.float64), -np.inf), axis=1)[:, ::-1]
        floor = ranked[:, k - 1] if some >= k else np.full(len(bound), -np.inf)
        alive = ~own & (bound >= floor[:, None])
        for fine_q, fine_c in levels[1:]:
            if alive.mean() > 0.1:
                alive &= fine_q[rows] @ fine_c.T + slack[rows] >= floor[:, None]
            else:
                a, b = np.nonzero(alive)
                for at in range(0, len(a), 1 << 18):
                    i, j = a[at : at + (1 << 18)], b[at : at + (1 << 18)]
                    near = np.einsum("ij,ij->i", fine_q[rows][i], fine_c[j]) + slack[rows][i, 0]
                    alive[i, j] = near >= floor[i]
        a, b = np.nonzero(alive)
        exact = np.concatenate(
            [np.zeros(0, np.int64)]
            + [
                np.einsum("ij,ij->i", q[rows][a[at : at + (1 << 18)]], c[b[at : at + (1 << 18)]])
                for at in range(0, len(a), 1 << 18)
            ]
        )
        order = np.lexsort((c_ids[b], c_null[b], -exact, a))
        a, b, exact = a[order], b[order], exact[order]
        place = np.arange(len(a)) - np.searchsorted(a, a, "left")
        keep = place < k
        found.append((a[keep] + start, b[keep], exact[keep]))
    return tuple(np.concatenate(x) for x in zip(*found))


def nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, twin, rank, vec_id, score): best ``k`` of ``vectors`` for each of ``queries``.

    Both come from :func:`integer_vectors`; ``twin`` counts different vectors
    that share a query's id.
    """
    queries = queries.filter("vec_id IS NOT NULL").distinct()
    queries = queries.withColumn("twin", F.row_number().over(Window.partitionBy("vec_id").orderBy("ints")))
    n_queries, n_vectors = queries.count(), vectors.count()
    of_q, of_c = max(1, ceil(n_queries / QUERY_BLOCK)), max(1, ceil(n_vectors / CANDIDATE_BLOCK))

    def dealt(rows: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
        return rows.withColumn(own, F.pmod(F.xxhash64("vec_id", "ints"), F.lit(blocks)).cast("int")).withColumn(
            other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))
        )

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        empty = pa.table({f: pa.array([], t) for f, t in (("query_id", pa.int64()), ("twin", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64()))})
        if not len(left) or not len(right):
            return empty
        width = max(pc.max(pc.list_value_length(t["ints"])).as_py() for t in (left, right))
        width = max(1, ceil(width / LEVELS[-1])) * LEVELS[-1]
        null = right["vec_id"].is_null().to_numpy()
        ids = right["vec_id"].fill_null(0).to_numpy()
        q_ids = left["vec_id"].to_numpy()
        a, b, scores = search(_matrix(left["ints"], width), q_ids, _matrix(right["ints"], width), ids, null, k)
        return pa.table(
            {
                "query_id": pa.array(q_ids[a]),
                "twin": pa.array(left["twin"].to_numpy()[a], pa.int32()),
                "vec_id": pa.array(ids[b], mask=null[b]),
                "score": pa.array(scores),
            }
        )

    blocks = (
        dealt(queries, "q_block", of_q, "c_block", of_c)
        .groupBy("q_block", "c_block")
        .cogroup(dealt(vectors, "c_block", of_c, "q_block", of_q).groupBy("q_block", "c_block"))
        .applyInArrow(group, SCHEMA)
    )
    order = Window.partitionBy("query_id", "twin").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last())
    return blocks.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


SQL = """
WITH v AS (
  SELECT vec_id, [floor(x::DOUBLE * 256) FOR x IN embedding] AS ints FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.ints, c.ints)::BIGINT AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


@query("op10_exact_topk", SQL)
def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"))
    found = nearest(vectors, vectors.filter("vec_id % 50 = 0"), 5)
    return found.select("query_id", "rank", "vec_id", "score")
