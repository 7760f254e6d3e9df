"""The chunk store: keyed look-ups, upserts and deletes over bucketed Parquet.

Chunks are partitioned by a hash bucket of their document, so publishing or
removing a version rewrites the buckets it touches and nothing else. A task
that is lost is run again; readers see the old files until the commit.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom import fixed
from citeloom.functions import text as tx

BUCKETS = 64


def doc_bucket(document_id: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(document_id), F.lit(buckets)).cast("int")


def write_store(chunks: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Write a chunk table by bucket.

    Rows are spread by bucket and chunk, not by bucket alone, so a document
    with a third of all chunks does not end in one task.
    """
    (
        chunks.withColumn("doc_bucket", doc_bucket(F.col("document_id"), buckets))
        .repartition("doc_bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(8)))
        .write.mode("errorifexists")
        .partitionBy("doc_bucket")
        .parquet(path)
    )


def upsert_problems(incoming: DataFrame, dimension: int) -> DataFrame:
    """Rows that may not be stored: repeated keys and wrong vectors."""
    repeated = (
        incoming.groupBy("version_id", "chunk_id")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .select("version_id", "chunk_id", F.lit("DUPLICATE_CHUNK_ID").alias("problem"))
    )
    wrong = incoming.where(F.col("embedding").isNull() | (F.size("embedding") != dimension)).select(
        "version_id", "chunk_id", F.lit("VECTOR_DIMENSION").alias("problem")
    )
    return repeated.unionByName(wrong)


def merged(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Keyed upsert: incoming rows replace existing ones of the same key.

    An anti join, not a sort of each key: both sides stay partitioned by key.
    """
    kept = existing.join(incoming.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(incoming.select(*existing.columns))


def upsert(spark: SparkSession, path: str, incoming: DataFrame, buckets: int = BUCKETS) -> None:
    """Replace or add chunks, rewriting only the buckets they fall into."""
    fresh = incoming.withColumn("doc_bucket", doc_bucket(F.col("document_id"), buckets))
    _rewrite(spark, path, fresh, lambda held: merged(held, fresh, ["version_id", "chunk_id"]))


def delete_version(spark: SparkSession, path: str, version_ids: DataFrame, buckets: int = BUCKETS) -> None:
    """Remove the chunks of versions (version_id, document_id) from their buckets."""
    gone = version_ids.withColumn("doc_bucket", doc_bucket(F.col("document_id"), buckets))
    _rewrite(spark, path, gone, lambda held: held.join(gone.select("version_id").distinct(), "version_id", "left_anti"))


def _rewrite(spark: SparkSession, path: str, touched: DataFrame, change) -> None:
    """Replace the touched buckets by their changed rows, buckets as a unit.

    A dynamic overwrite leaves a bucket alone when no row is written to it, so
    a bucket that loses all its rows is replaced by one tombstone row, which
    :func:`read_store` hides.
    """
    held = spark.read.parquet(path)
    # At most ``buckets`` small integers: they become a partition filter.
    numbers = sorted(r[0] for r in touched.select("doc_bucket").distinct().collect())
    live = change(held.where(F.col("doc_bucket").isin(numbers) & F.col("chunk_id").isNotNull()))
    nulls = [F.lit(None).cast(f.dataType).alias(f.name) for f in held.schema if f.name != "doc_bucket"]
    tombstones = spark.createDataFrame([(n,) for n in numbers], "doc_bucket int").select(*nulls, "doc_bucket")
    (
        live.select(*held.columns)
        .unionByName(tombstones)
        .repartition("doc_bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(8)))
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("doc_bucket")
        .parquet(path)
    )


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("chunk_id").isNotNull())


# --- keyed look-ups -----------------------------------------------------------


def look_up(keys: DataFrame, table: DataFrame, on: str | list[str], columns: list[str]) -> DataFrame:
    """Point reads for a table of keys: unknown keys keep NULLs."""
    on = [on] if isinstance(on, str) else on
    return keys.join(table.select(*on, *columns), on, "left")


def active_by_file(names: DataFrame, versions: DataFrame) -> DataFrame:
    """The active version of each file name, matched without ASCII case."""
    from citeloom.operators.versions import ascii_key

    live = versions.where("status = 'active'").select(
        ascii_key(F.col("file_name")).alias("file_key"), "version_id", "sha256"
    )
    return (
        names.withColumn("file_key", ascii_key(F.col("file_name")))
        .join(live, "file_key", "left")
        .select("file_name", "version_id", "sha256", F.col("version_id").isNotNull().alias("found"))
    )


# --- staging ------------------------------------------------------------------


def publish_problems(candidates: DataFrame, version_id: str) -> DataFrame:
    """Staging candidates that do not belong to the version being published."""
    return candidates.where(~F.col("source_version").eqNullSafe(F.lit(version_id))).select(
        "chunk_id", F.lit("SOURCE_VERSION_MISMATCH").alias("problem")
    )


def publish(existing: DataFrame, candidates: DataFrame, version_id: str) -> DataFrame:
    """The staging table after publishing: replaced or added by (version, chunk)."""
    matching = candidates.where(F.col("source_version") == version_id).withColumn("version_id", F.lit(version_id))
    return merged(existing, matching, ["version_id", "chunk_id"])


def write_candidates(candidates: DataFrame, path: str, buckets: int = BUCKETS) -> DataFrame:
    """Write candidates as JSON by backend and source; returns the count manifest.

    A source's candidates share a bucket folder, so reading one source back
    prunes to it, and there are never more folders than buckets - one folder
    per source would not survive many sources.
    """
    (
        candidates.withColumn("source_bucket", doc_bucket(F.col("source_sha256"), buckets))
        .repartition("backend", "source_bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(4)))
        .write.mode("errorifexists")
        .partitionBy("backend", "source_bucket")
        .json(path)
    )
    return candidate_manifest(candidates)


def candidate_manifest(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("backend", "source_sha256").agg(F.count("*").alias("count"))


def read_candidates(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Strict read: a record that does not fit the schema fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def load_problems(candidates: DataFrame, manifest: DataFrame, files: DataFrame, backend: str) -> DataFrame:
    """Why a candidate set may not be loaded: subject, problem. Empty means it may.

    ``candidates``: backend, file_name, source_version, chunk_id, text,
    content_hash; ``manifest``: file_name, backend, count, coverage_status;
    ``files``: file_name of every source.
    """
    chosen = candidates.where(F.col("backend") == backend)
    promised = manifest.where(F.col("backend") == backend)
    held = chosen.groupBy("file_name").agg(F.count("*").alias("held"))
    problem = lambda name: F.lit(name).alias("problem")
    name = F.col("file_name").alias("subject")
    checks = [
        manifest.join(files, "file_name", "left_anti").select(name, problem("FILE_NOT_IN_MANIFEST")),
        files.join(promised, "file_name", "left_anti").select(name, problem("FILE_NOT_COVERED")),
        promised.where(~F.col("coverage_status").eqNullSafe("pass")).select(name, problem("COVERAGE_NOT_PASSING")),
        promised.join(held, "file_name", "left")
        .where((F.col("count") <= 0) | (F.col("count") != F.coalesce("held", F.lit(0))))
        .select(name, problem("COUNT_MISMATCH")),
        chosen.where(~F.col("source_version").eqNullSafe(fixed.STAGING_VERSION)).select(
            F.col("chunk_id").alias("subject"), problem("SOURCE_VERSION_MISMATCH")
        ),
        chosen.where(F.col("content_hash") != F.sha2(tx.strip(F.col("text")), 256)).select(
            F.col("chunk_id").alias("subject"), problem("CONTENT_HASH_MISMATCH")
        ),
        chosen.groupBy("chunk_id")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("chunk_id").alias("subject"), problem("DUPLICATE_CHUNK_ID")),
    ]
    result = checks[0]
    for check in checks[1:]:
        result = result.unionByName(check)
    return result.distinct()
