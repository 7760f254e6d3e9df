"""Safety columns: masking, safe-text predicates, citation rules."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom import fixed
from citeloom.functions import text as tx


def mask_secrets(text: Column) -> Column:
    """Credential-like values and absolute paths masked, in a fixed order."""
    masked = F.replace(text, F.lit("\x00"), F.lit(""))
    masked = F.regexp_replace(masked, fixed.SECRET_TOKEN, "[redacted]")
    masked = F.regexp_replace(masked, fixed.AUTH_TOKEN, "bearer [redacted]")
    masked = F.regexp_replace(masked, fixed.KEY_ASSIGNMENT, "[redacted]")
    return F.regexp_replace(masked, fixed.ABSOLUTE_PATH, "[path redacted]")


def holds_credential(text: Column) -> Column:
    """A token, a bearer value or a key assignment."""
    return reduce(lambda found, pattern: found | text.rlike(pattern), fixed.CREDENTIALS, F.lit(False))


def is_safe_text(text: Column) -> Column:
    """No control characters, absolute paths, secrets or provider stack words."""
    return F.coalesce(
        ~text.rlike(fixed.DANGEROUS_CONTROL)
        & ~text.rlike(fixed.ABSOLUTE_PATH)
        & ~holds_credential(text)
        & ~text.rlike(fixed.PROVIDER_STACK),
        F.lit(False),
    )


def is_safe_label(text: Column) -> Column:
    """The stricter rule for file names and headings: no line breaks either."""
    return (
        ~text.rlike(fixed.ANY_CONTROL) & ~text.rlike(fixed.ABSOLUTE_PATH) & ~holds_credential(text)
    )


def is_safe_id(value: Column) -> Column:
    return F.coalesce(value.rlike(fixed.SAFE_ID), F.lit(False))


def is_safe_timestamp(value: Column) -> Column:
    """The fixed shape, and a real calendar moment."""
    day = F.substring(value, 1, 10)
    clock = F.substring(value, 12, 8)
    real = (
        (F.date_format(F.try_to_date(day, "yyyy-MM-dd"), "yyyy-MM-dd") == day)
        & (F.substring(clock, 1, 2) <= "23")
        & (F.substring(clock, 4, 2) <= "59")
        & (F.substring(clock, 7, 2) <= "59")
    )
    return F.coalesce(value.rlike(fixed.SAFE_TIMESTAMP) & real, F.lit(False))


def safe_code(value: Column) -> Column:
    return F.when(value.rlike(fixed.SAFE_CODE), value)


def is_dangerous_question(question: Column) -> Column:
    lowered = tx.casefold(question)
    found = question.rlike(fixed.ABSOLUTE_PATH)
    for marker in fixed.DANGEROUS_MARKERS:
        found = found | lowered.contains(marker)
    return F.coalesce(found, F.lit(False))


def safe_excerpt(text: Column, *, redact_paths: bool, limit: int | None = fixed.EXCERPT_CHARS) -> Column:
    """Line breaks and tabs to one space, trimmed and cut; NULL when unsafe."""
    flat = tx.strip(F.regexp_replace(text, r"[\r\n\t]+", " "))
    shown = F.regexp_replace(flat, fixed.ABSOLUTE_PATH, "[path redacted]") if redact_paths else flat
    unsafe = text.rlike(fixed.DANGEROUS_CONTROL) | (F.length(flat) == 0) | holds_credential(flat)
    if not redact_paths:
        unsafe = unsafe | flat.rlike(fixed.ABSOLUTE_PATH)
    return F.when(~unsafe, F.substring(shown, 1, limit) if limit else shown)


def _range(start: Column, end: Column) -> Column:
    return F.coalesce((start > 0) & (end >= start), F.lit(False))


def valid_location(file_name: Column) -> Column:
    """PDF by page range only, DOCX by paragraph range or table only."""
    suffix = F.lower(file_name)
    page, paragraph = _range(F.col("page"), F.col("page_end")), _range(F.col("paragraph_start"), F.col("paragraph_end"))
    table = F.coalesce(F.col("table_id").rlike(fixed.SAFE_TABLE_ID), F.lit(False))
    no_page = F.col("page").isNull() & F.col("page_end").isNull()
    no_paragraph = F.col("paragraph_start").isNull() & F.col("paragraph_end").isNull()
    return F.coalesce(
        file_name.rlike(fixed.SAFE_BASENAME)
        & (
            (suffix.endswith(".pdf") & page & no_paragraph)
            | (suffix.endswith(".docx") & (paragraph | table) & no_page)
        ),
        F.lit(False),
    )


def _heading_fault(heading: Column) -> Column:
    return F.exists(
        heading,
        lambda h: h.isNull() | (F.length(tx.strip(h)) == 0) | ~is_safe_label(h) | h.rlike(r"[/\\]"),
    )


def citation_problem() -> Column:
    """The first broken rule of a citation row, or NULL."""
    positive = lambda name: F.col(name).isNotNull() & (F.col(name) < 1)
    name = F.col("file_name")
    suffix = F.lower(name)
    page = _range(F.col("page"), F.col("page_end"))
    paragraph = _range(F.col("paragraph_start"), F.col("paragraph_end"))
    excerpt = safe_excerpt(F.col("excerpt"), redact_paths=False, limit=None)
    return (
        F.when(F.col("reference_id").isNull() | ~F.col("reference_id").rlike(fixed.REFERENCE_ID), "REFERENCE_ID")
        .when(name.isNull() | ~name.rlike(fixed.SAFE_BASENAME) | ~is_safe_label(name), "FILE_NAME")
        .when(
            F.col("heading_path").isNull() | (F.size("heading_path") == 0) | _heading_fault(F.col("heading_path")),
            "HEADING_PATH",
        )
        .when(positive("page") | positive("page_end"), "PAGE")
        .when(positive("paragraph_start") | positive("paragraph_end"), "PARAGRAPH")
        .when(F.col("table_id").isNotNull() & ~F.col("table_id").rlike(fixed.SAFE_TABLE_ID), "TABLE_ID")
        .when(suffix.endswith(".pdf") & ~page, "PDF_NEEDS_PAGES")
        .when(
            suffix.endswith(".pdf") & (F.col("paragraph_start").isNotNull() | F.col("paragraph_end").isNotNull()),
            "PDF_WITH_PARAGRAPHS",
        )
        .when(
            suffix.endswith(".docx") & ~(paragraph | F.col("table_id").isNotNull()), "DOCX_NEEDS_PARAGRAPHS"
        )
        .when(
            suffix.endswith(".docx") & (F.col("page").isNotNull() | F.col("page_end").isNotNull()),
            "DOCX_WITH_PAGES",
        )
        .when(excerpt.isNull() | (F.length(excerpt) > fixed.EXCERPT_CHARS), "EXCERPT")
    )


def candidate_source_problem(reference_id: Column, file_name: Column, heading_path: Column) -> Column:
    return (
        F.when(reference_id.isNull() | ~reference_id.rlike(fixed.REFERENCE_ID), "REFERENCE_ID")
        .when(~file_name.rlike(fixed.SAFE_BASENAME) | ~is_safe_label(file_name), "FILE_NAME")
        .when((F.size(heading_path) == 0) | _heading_fault(heading_path), "HEADING_PATH")
    )


def contains_prompt(text: Column, prompt_lines: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for line in prompt_lines:
        if line.strip():
            found = found | text.contains(line)
    return found


def answer_text_failure(text: Column, prompt_lines: tuple[str, ...] = ()) -> Column:
    """NULL for a usable answer, else the class of its first fault.

    ``prompt_lines`` are the lines of the system prompt that must not leak.
    """
    return (
        F.when(tx.is_blank(text), "UNKNOWN")
        .when(contains_prompt(text, prompt_lines), "SYSTEM_PROMPT")
        .when(mask_secrets(text) != text, "SECRET_OR_PATH")
        .when(text.rlike(fixed.SOURCE_MARKER), "SOURCE_MARKER")
    )


def unsafe_chunk() -> Column:
    """Chunk metadata or text that must not be shown as evidence."""
    name = F.col("file_name")
    return (
        name.isNull()
        | ~name.rlike(fixed.SAFE_BASENAME)
        | ~is_safe_label(name)
        | (F.size("heading_path") <= 0)
        | F.exists("heading_path", lambda h: ~is_safe_text(h))
        | (F.length(tx.strip(F.col("text"))) == 0)
        | ~is_safe_text(F.col("text"))
    )
