"""Corpus readers: folder scans, fingerprints, located blocks."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom import fixed
from citeloom.functions import text as tx


def read_files(spark: SparkSession, folder: str, pattern: str = "*.{txt,html}") -> DataFrame:
    """Files of a folder as scan entries; content is read by the executors."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("modified_at"),
        F.sha2(F.col("content"), 256).alias("sha256"),
        F.lit(True).alias("is_safe"),
        F.lit(True).alias("is_regular"),
    )


def scan(entries: DataFrame, decisions: DataFrame, *, max_files: int | None = fixed.MAX_SCAN_FILES) -> DataFrame:
    """Status of each folder entry, and whether the snapshot is complete.

    ``entries``: file_name, is_safe, is_regular. ``decisions``: file_name,
    status, failure_reason of the indexing attempt. An unsafe or irregular
    entry fails and leaves the snapshot incomplete; a failed index does not.
    More than ``max_files`` entries fail the whole scan (None: no ceiling).
    """
    unsafe, irregular = ~F.col("is_safe"), ~F.col("is_regular")
    n_entries = entries.agg(F.count("*")).scalar()
    all_safe = entries.agg(F.coalesce(F.bool_and(F.col("is_safe") & F.col("is_regular")), F.lit(True))).scalar()
    over = n_entries > max_files if max_files is not None else F.lit(False)
    return entries.join(decisions, "file_name", "left").select(
        "file_name",
        F.when(over | unsafe | irregular, "failed").otherwise(F.coalesce("status", F.lit("failed"))).alias("status"),
        F.when(over, "SCAN_LIMIT_EXCEEDED")
        .when(unsafe, "source entry is not a safe regular file")
        .when(irregular, "source entry is not a regular file")
        .otherwise(F.col("failure_reason"))
        .alias("failure_reason"),
        (all_safe & ~over).alias("snapshot_complete"),
    )


def inventory_changes(first: DataFrame, second: DataFrame) -> DataFrame:
    """Files whose (size, mtime, sha256) differ between two scans, or exist in one only."""
    a, b = first.alias("a"), second.alias("b")
    same = (
        F.col("a.size_bytes").eqNullSafe(F.col("b.size_bytes"))
        & F.col("a.modified_at").eqNullSafe(F.col("b.modified_at"))
        & F.col("a.sha256").eqNullSafe(F.col("b.sha256"))
    )
    return (
        a.join(b, F.col("a.path") == F.col("b.path"), "full_outer")
        .where(~same | F.col("a.path").isNull() | F.col("b.path").isNull())
        .select(
            F.coalesce("a.path", "b.path").alias("path"),
            F.when(F.col("a.path").isNull(), "added")
            .when(F.col("b.path").isNull(), "removed")
            .otherwise("changed")
            .alias("change"),
        )
    )


def inventory_verdict(first: DataFrame, second: DataFrame, expected_files: int) -> DataFrame:
    """One row: file_count, changed_count and the reason to reject, if any."""
    changed = inventory_changes(first, second).agg(F.count("*")).scalar()
    return (
        first.agg(F.count("*").alias("file_count"))
        .withColumn("changed_count", changed)
        .withColumn(
            "reject_reason",
            F.when(F.col("file_count") != expected_files, "FILE_COUNT_UNEXPECTED").when(
                F.col("changed_count") > 0, "SOURCE_CHANGED_DURING_SCAN"
            ),
        )
    )


def text_blocks(documents: DataFrame) -> DataFrame:
    """Non-blank lines of each text with their paragraph number.

    A document stays in the task that read it: split and explode, no shuffle.
    """
    line = tx.strip(F.col("line"))
    keep = [c for c in documents.columns if c != "text"]
    return (
        documents.select(*keep, F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
        .select(
            *keep,
            (F.col("pos") + 1).alias("paragraph_start"),
            (F.col("pos") + 1).alias("paragraph_end"),
            line.alias("text"),
        )
        .where(F.length("text") > 0)
    )


# Markup that holds no readable text, and the two block kinds that are kept.
_HIDDEN = r"(?s)<(script|style)\b[^>]*>.*?</\1>|<!--.*?-->"
_BLOCK = r"(?s)<(?:h[1-6]|p)\b[^>]*>.*?(?=</h[1-6]>|</p>|<h[1-6]\b|<p\b|</article>|$)"


def html_blocks(pages: DataFrame) -> DataFrame:
    """Headings and paragraphs of each page in order: page_id, block_no, level, text.

    ``level`` is 1-6 for a heading and NULL for a paragraph.
    """
    visible = F.regexp_replace("html", _HIDDEN, " ")
    blocks = pages.select(
        "page_id",
        F.posexplode(F.regexp_extract_all(visible, F.lit(f"({_BLOCK})"), 1)).alias("pos", "block"),
    )
    plain = tx.collapse_space(F.regexp_replace("block", r"(?s)<[^>]*>", " "))
    level = F.try_to_number(F.regexp_extract("block", r"^<h([1-6])", 1), F.lit("9")).cast("int")
    return blocks.select(
        "page_id", (F.col("pos") + 1).alias("block_no"), level.alias("level"), plain.alias("text")
    ).where(F.length("text") > 0)


def resource_reason(size_bytes: Column, pages: Column, paragraphs: Column, chars: Column) -> Column:
    """The first exceeded resource limit, or NULL."""
    return (
        F.when(size_bytes > fixed.MAX_FILE_BYTES, "FILE_SIZE_LIMIT")
        .when(pages > fixed.MAX_PAGES, "PAGE_LIMIT")
        .when(paragraphs > fixed.MAX_PARAGRAPHS, "PARAGRAPH_LIMIT")
        .when(chars > fixed.MAX_TEXT_CHARS, "TEXT_CHAR_LIMIT")
    )


def resource_limits(
    blocks: DataFrame, sizes: DataFrame, key: str = "version_id", limits: dict | None = None
) -> DataFrame:
    """Paragraph and character totals of each document with the limit it breaks."""
    limit = {
        "bytes": fixed.MAX_FILE_BYTES,
        "paragraphs": fixed.MAX_PARAGRAPHS,
        "chars": fixed.MAX_TEXT_CHARS,
        **(limits or {}),
    }
    totals = blocks.groupBy(key).agg(
        F.max("paragraph_end").alias("paragraphs"), F.sum(F.length("text")).alias("chars")
    )
    return sizes.join(totals, key, "left").select(
        key,
        "size_bytes",
        F.coalesce("paragraphs", F.lit(0)).cast("bigint").alias("paragraphs"),
        F.coalesce("chars", F.lit(0)).alias("chars"),
        F.when(F.col("size_bytes") > limit["bytes"], "FILE_SIZE_LIMIT")
        .when(F.col("paragraphs") > limit["paragraphs"], "PARAGRAPH_LIMIT")
        .when(F.col("chars") > limit["chars"], "TEXT_CHAR_LIMIT")
        .alias("reason"),
    )


def needs_ocr(pages: DataFrame, key: str = "document_id") -> DataFrame:
    """Per document: page count, characters, and whether OCR is needed.

    ``pages`` has one row per page with ``text``; a document without pages is
    a row whose ``page_no`` is NULL.
    """
    return (
        pages.groupBy(key)
        .agg(
            F.count("page_no").alias("page_count"),
            F.coalesce(F.sum(F.length(tx.strip(F.col("text")))), F.lit(0)).alias("chars"),
        )
        .withColumn(
            "needs_ocr",
            (F.col("page_count") == 0)
            | (F.col("chars") / F.greatest("page_count", F.lit(1)) < fixed.OCR_CHARS_PER_PAGE),
        )
    )


def all_versions_snapshot(chunks: DataFrame) -> DataFrame:
    """Every chunk of every version, for mismatch diagnosis."""
    return chunks


def version_snapshot(chunks: DataFrame, version_ids: DataFrame) -> DataFrame:
    """Chunks of the listed versions only; the version side is broadcast by size."""
    return chunks.join(version_ids.select("version_id").distinct(), "version_id", "left_semi")
