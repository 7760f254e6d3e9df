"""Quality reports of an ingestion run: structure, coverage, candidates."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom import fixed
from citeloom.functions import text as tx

AUDIT_COUNTS = (
    "paragraph_count",
    "paragraph_chars",
    "heading_count",
    "textbox_count",
    "textbox_chars",
    "table_count",
    "nonempty_cell_count",
    "table_chars",
    "extracted_chars",
)


def structure_audit(blocks: DataFrame, extracted: DataFrame) -> DataFrame:
    """Per file: what the structure holds against what was extracted.

    ``blocks``: file_name, content_kind (paragraph, heading, table, textbox),
    table_id, text - one row per paragraph, heading, table cell or textbox.
    ``extracted``: file_name, text.
    """
    size = F.length(tx.strip(F.col("text")))
    kind = F.col("content_kind")
    filled = size > 0

    def total(name: str):
        return F.coalesce(F.sum(F.when(kind == name, size)), F.lit(0))

    held = blocks.groupBy("file_name").agg(
        F.count_if(kind.isin("paragraph", "heading")).alias("paragraph_count"),
        total("paragraph").alias("paragraph_chars"),
        F.count_if((kind == "heading") & filled).alias("heading_count"),
        F.count_if((kind == "textbox") & filled).alias("textbox_count"),
        total("textbox").alias("textbox_chars"),
        F.count_distinct(F.when(kind == "table", F.col("table_id"))).alias("table_count"),
        F.count_if((kind == "table") & filled).alias("nonempty_cell_count"),
        total("table").alias("table_chars"),
    )
    got = extracted.groupBy("file_name").agg(F.sum(F.length("text")).alias("extracted_chars"))
    joined = held.join(got, "file_name", "left").withColumn(
        "extracted_chars", F.coalesce("extracted_chars", F.lit(0))
    )
    have, body = F.col("extracted_chars"), F.col("paragraph_chars")
    with_tables = body + F.col("table_chars")
    with_boxes = with_tables + F.col("textbox_chars")
    reasons = F.array_compact(
        F.array(
            F.when(have < body, "paragraph_text_not_covered"),
            F.when((F.col("table_chars") > 0) & (have < with_tables), "table_text_not_covered"),
            F.when((F.col("textbox_chars") > 0) & (have < with_boxes), "textbox_text_not_covered"),
        )
    )
    return joined.withColumn("blocking_reasons", reasons).withColumn(
        "coverage_status", F.when(F.size("blocking_reasons") > 0, "blocked").otherwise("pass")
    )


def compare_coverage(audit: DataFrame, candidates: DataFrame) -> DataFrame:
    """Per file: characters of both chunkings against the audit, with reasons.

    ``candidates``: file_name, backend, text.
    """
    sizes = (
        candidates.groupBy("file_name")
        .pivot("backend", list(fixed.BACKENDS))
        .agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("chunks"))
    )
    zero = F.lit(0)
    planned = F.col("paragraph_chars") + F.col("table_chars") + F.col("textbox_chars")
    joined = (
        audit.join(sizes, "file_name", "left")
        .withColumn("expected_chars", F.when(planned > 0, planned).otherwise(F.col("extracted_chars")))
        .withColumns(
            {
                f"{b}_{n}": F.coalesce(F.col(f"{b}_{n}"), zero)
                for b in fixed.BACKENDS
                for n in ("chars", "chunks")
            }
        )
    )
    expected = F.col("expected_chars")
    short = (expected > 0) & (F.col("docling_chars") < expected)
    own = F.array_compact(
        F.array(
            F.when(F.col("docling_chunks") == 0, "docling_no_chunks"),
            F.when(short, "docling_coverage_below_audit"),
            F.when(
                (F.col("legacy_chunks") > 0) & (expected > 0) & (F.col("legacy_chars") < expected),
                "fallback_coverage_below_audit",
            ),
        )
    )
    inherited = F.when((F.col("coverage_status") == "blocked") & short, F.col("blocking_reasons")).otherwise(
        F.expr("cast(array() as array<string>)")
    )
    return joined.select(
        "file_name",
        "expected_chars",
        "docling_chars",
        F.col("legacy_chars").alias("fallback_chars"),
        F.col("docling_chunks").alias("docling_chunk_count"),
        F.col("legacy_chunks").alias("fallback_chunk_count"),
        F.array_compact(
            F.array(
                F.when(F.col("docling_chunks") > 0, "docling"), F.when(F.col("legacy_chunks") > 0, "legacy")
            )
        ).alias("available_backends"),
        F.array_union(own, inherited).alias("blocking_reasons"),
    ).withColumn("status", F.when(F.size("blocking_reasons") > 0, "blocked").otherwise("pass"))


def choose_backend(coverage: DataFrame, approved: str | None) -> DataFrame:
    """The backend that may go active for each file, or why none may."""
    problem = (
        F.when(F.col("status") != "pass", "COVERAGE_BLOCKED")
        .when(F.size("available_backends") == 0, "NO_BACKEND")
        .when(F.lit(approved is None), "APPROVAL_MISSING")
        .when(~F.array_contains("available_backends", F.lit(approved or "")), "BACKEND_UNAVAILABLE")
    )
    return coverage.select(
        "file_name", F.when(problem.isNull(), F.lit(approved)).alias("active_backend"), problem.alias("problem")
    )


def run_report(coverage: DataFrame, audit: DataFrame, backends: DataFrame) -> DataFrame:
    """Blocking reasons and warnings of a run: file_name, severity, reason.

    ``backends``: file_name, error_code, used_tokenizer_fallback of the primary
    chunker. A gap the audit saw is a warning when the candidate covers it.
    """
    joined = coverage.alias("c").join(
        audit.select("file_name", F.col("coverage_status").alias("audit_status")), "file_name", "left"
    ).join(backends, "file_name", "left")
    blocked_audit = F.col("audit_status") == "blocked"
    passing = F.col("status") == "pass"
    entry = lambda severity, reason: F.struct(
        F.lit(severity).alias("severity"), reason.alias("reason")
    )
    own = F.transform("blocking_reasons", lambda r: F.struct(F.lit("blocking").alias("severity"), r.alias("reason")))
    extra = F.array_compact(
        F.array(
            F.when(blocked_audit & ~passing, entry("blocking", F.lit("extraction_audit_not_recovered"))),
            F.when(
                blocked_audit & passing, entry("warning", F.lit("extraction_audit_gap_recovered_by_candidate"))
            ),
            F.when(
                F.col("error_code") == "docling_unavailable", entry("warning", F.lit("docling_unavailable"))
            ),
            F.when(F.col("used_tokenizer_fallback"), entry("warning", F.lit("primary_tokenizer_fallback"))),
        )
    )
    return joined.select("file_name", F.explode(F.array_distinct(F.concat(own, extra))).alias("e")).select(
        "file_name", "e.severity", "e.reason"
    )


def extraction_summary(manifest: DataFrame, audit: DataFrame) -> DataFrame:
    """Totals over audited files: one row with the status histogram in columns."""
    held = manifest.select("file_name").join(audit, "file_name", "left")
    audited = F.col("coverage_status").isNotNull()
    sums = [F.coalesce(F.sum(F.greatest(F.col(c), F.lit(0))), F.lit(0)).alias(c) for c in AUDIT_COUNTS]
    return held.agg(
        F.count("*").alias("file_count"),
        F.count_if(audited).alias("audited_file_count"),
        F.count_if(~audited).alias("blocked_file_count"),
        *sums,
        F.count_if(F.col("coverage_status") == "pass").alias("status_pass"),
        F.count_if(F.col("coverage_status") == "blocked").alias("status_blocked"),
        F.count_if(F.col("coverage_status") == "unknown").alias("status_unknown"),
    )


def candidate_summary(candidates: DataFrame) -> DataFrame:
    """Per backend: counts, limits, duplicates and how many can be traced back.

    Ids and hashes are first counted per value, so a value repeated very often
    is combined map-side and never gathered.
    """
    located = (F.length("file_name") > 0) & (F.coalesce(F.size("heading_path"), F.lit(0)) > 0)
    rows = candidates.groupBy("backend").agg(
        F.count("*").alias("count"),
        F.count_distinct("file_name").alias("files_with_candidates"),
        F.max("token_count").alias("max_token_count"),
        F.count_if(tx.is_blank(F.col("text"))).alias("empty_chunk_count"),
        F.count_if(F.col("token_count") > fixed.STAGING_MAX_TOKENS).alias("token_over_limit_count"),
        F.count_if(located).alias("source_retraceable_count"),
    )

    def repeats(column: str, name: str) -> DataFrame:
        values = candidates.where(F.col(column).isNotNull()).groupBy("backend", column).count()
        return values.groupBy("backend").agg(F.sum(F.col("count") - 1).alias(name))

    return (
        rows.join(repeats("chunk_id", "duplicate_chunk_id_count"), "backend", "left")
        .join(repeats("content_hash", "duplicate_content_hash_count"), "backend", "left")
        .withColumn(
            "source_retraceable_rate", F.concat_ws("/", F.col("source_retraceable_count"), F.col("count"))
        )
    )


def chunk_integrity(chunks: DataFrame) -> DataFrame:
    """Totals, duplicates and gaps of a chunk table in one row.

    Distinct ids and hashes come from grouped counts, not from sets.
    """
    def distinct(column: str) -> DataFrame:
        present = chunks.where(F.length(column) > 0).groupBy(column).count()
        return present.agg(F.count("*").alias("u"), F.coalesce(F.sum("count"), F.lit(0)).alias("n"))

    ids, hashes = distinct("chunk_id"), distinct("content_hash")
    files = chunks.where(F.length("file_name") > 0).select("file_name").distinct().agg(F.count("*").alias("n"))
    gaps = chunks.agg(
        F.count("*").alias("total_chunks"),
        F.count_if(F.coalesce(F.length("text"), F.lit(0)) == 0).alias("blank_text_count"),
        F.count_if(F.coalesce(F.length("file_name"), F.lit(0)) == 0).alias("missing_file_name_count"),
        F.count_if(F.coalesce(F.size("heading_path"), F.lit(0)) <= 0).alias("missing_heading_count"),
    )
    return gaps.select(
        "total_chunks",
        ids.select("u").scalar().alias("unique_chunk_ids"),
        (ids.select("n").scalar() - ids.select("u").scalar()).alias("duplicate_chunk_id_count"),
        hashes.select("u").scalar().alias("unique_content_hashes"),
        (hashes.select("n").scalar() - hashes.select("u").scalar()).alias("duplicate_content_hash_count"),
        "blank_text_count",
        "missing_file_name_count",
        "missing_heading_count",
        files.scalar().alias("active_file_count"),
    )
