"""Mixing sources to target weights.

Words are summed per source, each source gets a share of all words by weight,
and the share over the source's size is its repetition rate. A document is
taken ``floor(rate)`` times, and once more when a draw seeded by its id falls
below the fraction: no rows of a source are brought together to decide it.

Defined cases: a null or empty text has size 0; a null source is a source of
its own, last in order; a null id draws as the empty string; repeated rows draw
alike; an empty table gives an empty result; other columns pass through
:func:`mixed` untouched, whatever their names.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.llm.registry import query, table
from citeloom.llm.written import fresh

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
LIMIT = 3
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the id and the seed alone."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(
    sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: float = LIMIT
) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    Sharing again what limited sources leave ends where every source that is
    not limited has the same words per unit of weight, and the limited ones
    are those that reach their limit earliest. So the sources are put in the
    order of ``limit * size / weight`` and the level is found from running
    sums. One row a source: the single task of this window reads no documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*[F.lit(float(w)) for w in weights])
    place = F.row_number().over(by_name)
    table_ = sizes.select(
        "source",
        "source_size",
        F.element_at(kinds, ((place - 1) % len(weights) + 1).cast("int")).alias("weight"),
        (F.col("source_size") * float(limit)).alias("most"),
    )
    order = Window.orderBy((F.col("most") / F.col("weight")), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        F.sum("source_size").over(whole) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    ) / F.sum("weight").over(after)
    limited = F.col("most") / F.col("weight") <= F.col("level")
    levels = table_.withColumn("level", level).withColumn("limited", limited)
    # The level where the first source stays below its limit holds for all after it.
    common = F.min(F.when(~F.col("limited"), F.struct(F.col("most") / F.col("weight"), "level"))).over(
        Window.partitionBy(F.lit(1))
    )["level"]
    target = F.when(F.col("limited"), F.col("most")).otherwise(
        F.least("most", F.col("weight") * F.col("common"))
    )
    return levels.withColumn("common", common).select("source", "source_size", target.alias("target"))


def with_copies(
    docs: DataFrame,
    names: tuple[str, str, str, str] = ("size", "source_size", "target", "copies"),
    seed: str = SEED,
    weights: tuple[int, ...] = WEIGHTS,
    limit: int = LIMIT,
) -> DataFrame:
    """``docs`` and four columns ``names``: words, its source's words and target, copies taken."""
    size, source_size, target, copies = names
    of, rate = fresh([*docs.columns, *names], "of", "rate")
    sized = docs.withColumn(size, word_count(F.col("text")))
    sums = sized.groupBy("source").agg(F.sum(size).alias("source_size"))
    targets = source_targets(sums, weights, limit).select(
        F.col("source").alias(of),
        F.col("source_size").alias(source_size),
        F.col("target").alias(target),
    )
    # One row a source, far fewer than documents; Spark decides by size whether to send it to all tasks.
    joined = sized.join(targets, F.col("source").eqNullSafe(F.col(of)), "left").drop(of)
    exact = F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(0.0)
    whole = F.floor(F.col(rate))
    extra = (draw(F.col("doc_id"), seed) < F.col(rate) - whole).cast("long")
    return (
        joined.withColumn(rate, exact)
        .withColumn(copies, F.least(whole + extra, F.lit(limit).cast("long")))
        .drop(rate)
    )


def mixed(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """Documents repeated as the mix takes them, with the columns they came with."""
    *names, turn = fresh(docs.columns, "size", "source_size", "target", "copies", "turn")
    taken = with_copies(docs, tuple(names), seed).filter(F.col(names[3]) > 0)
    turns = F.sequence(F.lit(1).cast("long"), F.col(names[3]))
    return taken.withColumn(turn, F.explode(turns)).select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
named AS (
  SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight, source_size * 3.0::DOUBLE AS most FROM sums
), levels AS (
  SELECT *, (sum(source_size) OVER ()
     - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
     / sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM named
), targets AS (
  SELECT source, source_size, CASE WHEN most / weight <= level THEN most ELSE least(most, weight *
    (SELECT arg_min(level, most / weight) FROM levels WHERE most / weight > level)) END::DOUBLE AS target
  FROM levels
), rated AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * least(3, floor(rate) + CASE WHEN
  ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0 < rate - floor(rate)
  THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""


@query("op7_source_mix", SQL)
def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return with_copies(docs).select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.col("copies")).alias("taken"),
    )
