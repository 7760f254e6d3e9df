"""Document versions: index decisions, state changes, eligibility, listings."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom import fixed
from citeloom.functions import safety as sf
from citeloom.functions import text as tx


def ascii_key(name: Column) -> Column:
    """File names match without regard to ASCII case only."""
    return F.translate(name, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def index_decisions(incoming: DataFrame, versions: DataFrame) -> DataFrame:
    """What to do with each incoming file: skip, in_progress, needs_ocr or index.

    ``incoming``: file_name, sha256, needs_ocr, force. Identical bytes that are
    live decide; of several, active beats indexing beats needs_ocr, then the
    smallest version_id. ``force`` always makes a new version.
    """
    order = (
        F.when(F.col("status") == "active", 0).when(F.col("status") == "indexing", 1).otherwise(2)
    )
    live = (
        versions.where(F.col("status").isin(*[s for s, _ in fixed.INDEX_ACTIONS]))
        .groupBy(ascii_key(F.col("file_name")).alias("file_key"), "sha256")
        .agg(F.min(F.struct(order.alias("o"), "version_id", "status")).alias("found"))
    )
    known = F.col("found").isNotNull() & ~F.col("force")
    fresh = F.when(F.col("needs_ocr"), "needs_ocr").otherwise("index")
    return (
        incoming.withColumn("file_key", ascii_key(F.col("file_name")))
        .join(live, ["file_key", "sha256"], "left")
        .select(
            "file_name",
            "sha256",
            F.when(known, tx.mapped(F.col("found.status"), fixed.INDEX_ACTIONS)).otherwise(fresh).alias("action"),
            F.when(known, F.col("found.version_id")).alias("existing_version_id"),
            F.when(known, F.col("found.status"))
            .otherwise(F.when(F.col("needs_ocr"), "needs_ocr").otherwise("indexing"))
            .alias("status"),
        )
    )


def activate(versions: DataFrame, targets: DataFrame) -> DataFrame:
    """Versions after publishing the targets: the old active one is superseded.

    ``targets``: version_id, at most one per document. Only ``indexing``
    versions activate; other targets change nothing (see
    :func:`activation_problems`). The result is written as one table, so both
    changes appear together.
    """
    chosen = versions.where("status = 'indexing'").join(targets.select("version_id").distinct(), "version_id", "left_semi")
    published = chosen.select("document_id", F.col("version_id").alias("published_id"))
    return versions.join(published, "document_id", "left").select(
        *[c for c in versions.columns if c != "status"],
        F.when(F.col("version_id") == F.col("published_id"), "active")
        .when(F.col("published_id").isNotNull() & (F.col("status") == "active"), "superseded")
        .otherwise(F.col("status"))
        .alias("status"),
    )


def activation_problems(versions: DataFrame, targets: DataFrame) -> DataFrame:
    held = targets.select("version_id").distinct().join(versions.select("version_id", "status"), "version_id", "left")
    return held.select(
        "version_id",
        F.when(F.col("status").isNull(), "UNKNOWN_VERSION")
        .when(F.col("status") != "indexing", "NOT_INDEXING")
        .alias("problem"),
    ).where("problem is not null")


def transitions(versions: DataFrame, commands: DataFrame) -> DataFrame:
    """Apply fail / mark_needs_ocr / begin_ocr_indexing commands to their versions.

    ``commands``: version_id, command, reason. Every command comes back with
    the status before and after and whether it was legal.
    """
    after = tx.mapped(
        F.concat_ws(":", "command", "status"), [(f"{c}:{s}", t) for c, s, t in fixed.VERSION_TRANSITIONS]
    )
    return (
        commands.join(versions.select("version_id", "status"), "version_id", "left")
        .withColumn("next_status", after)
        .select(
            "version_id",
            "command",
            F.col("status").alias("status_before"),
            F.coalesce("next_status", "status").alias("status_after"),
            F.when((F.col("command") == "fail") & F.col("next_status").isNotNull(), F.col("reason")).alias(
                "failure_reason"
            ),
            F.col("next_status").isNotNull().alias("legal"),
        )
    )


def deactivate_missing(versions: DataFrame, present: DataFrame, snapshot_complete: bool) -> DataFrame:
    """Versions after a scan: active ones whose file is gone become inactive.

    ``present``: file_name. An incomplete snapshot changes nothing.
    """
    if not snapshot_complete:
        return versions
    names = present.select(tx.casefold(F.col("file_name")).alias("name_key")).distinct().withColumn("here", F.lit(True))
    return (
        versions.withColumn("name_key", tx.casefold(F.col("file_name")))
        .join(names, "name_key", "left")
        .select(
            *[c for c in versions.columns if c != "status"],
            F.when((F.col("status") == "active") & F.col("here").isNull(), "inactive")
            .otherwise(F.col("status"))
            .alias("status"),
        )
    )


def list_documents(versions: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row per document: its active version, else the latest, with metadata.

    ``versions`` carries ``created_order`` (creation order).
    """
    shown = F.min_by(
        F.struct("version_id", "file_name", "status", "sha256", "created_order"),
        F.struct(F.when(F.col("status") == "active", 0).otherwise(1), -F.col("created_order")),
    )
    return (
        versions.groupBy("document_id")
        .agg(shown.alias("v"), F.count("*").alias("version_count"))
        .select("document_id", "v.*", "version_count")
        .join(metadata, "version_id", "left")
    )


# --- eligibility --------------------------------------------------------------


def profile_number(audience_scope: Column, as_of: Column) -> Column:
    """A number for each (scope, day), the same wherever it is computed."""
    scopes = F.array(*[F.lit(x) for x in fixed.AUDIENCE_SCOPES])
    return (F.unix_date(as_of) * len(fixed.AUDIENCE_SCOPES) + F.array_position(scopes, audience_scope) - 1).cast("int")


def request_profiles(requests: DataFrame) -> DataFrame:
    """Distinct (audience_scope, as_of) pairs with their profile number; few by nature."""
    return (
        requests.select("audience_scope", "as_of")
        .distinct()
        .withColumn("profile", profile_number(F.col("audience_scope"), F.col("as_of")))
    )


def eligible_versions(versions: DataFrame, metadata: DataFrame, profiles: DataFrame) -> DataFrame:
    """(profile, version_id): active, approved, in scope and in date.

    A request without a scope asks for all_staff. The scope test is an
    equi-join: each request is expanded to the one or two scopes it may see.
    """
    asked = F.when(F.col("audience_scope") == "unspecified", "all_staff").otherwise(F.col("audience_scope"))
    wanted = profiles.select(
        "profile", "as_of", F.explode(F.array_distinct(F.array(F.lit("all_staff"), asked))).alias("applicable_scope")
    )
    live = (
        versions.where("status = 'active'")
        .select("version_id")
        .join(metadata.where("business_status = 'approved'"), "version_id")
    )
    in_date = (F.col("effective_from").isNull() | (F.col("effective_from") <= F.col("as_of"))) & (
        F.col("review_due_at").isNull() | (F.col("review_due_at") >= F.col("as_of"))
    )
    return live.join(wanted, "applicable_scope").where(in_date).select("profile", "version_id")


def eligibility(versions: DataFrame, metadata: DataFrame, profiles: DataFrame) -> DataFrame:
    """Per request profile: how many versions are eligible, or why none is."""
    counts = eligible_versions(versions, metadata, profiles).groupBy("profile").agg(
        F.count("*").alias("eligible_count")
    )
    active = (
        versions.where("status = 'active'")
        .select("version_id")
        .join(metadata.select("version_id", "business_status"), "version_id", "left")
    )
    status_known = active.agg(
        F.coalesce(F.bool_and(F.coalesce(F.col("business_status") == "approved", F.lit(False))), F.lit(False))
    ).scalar()
    return (
        profiles.join(counts, "profile", "left")
        .withColumn("eligible_count", F.coalesce("eligible_count", F.lit(0)))
        .select(
            "profile",
            "audience_scope",
            "as_of",
            "eligible_count",
            F.when(F.col("eligible_count") > 0, F.lit(None).cast("string"))
            .when(status_known, "EVIDENCE_SCOPE_UNCLEAR")
            .otherwise("DOCUMENT_BUSINESS_STATUS_UNKNOWN")
            .alias("exclusion_reason"),
        )
    )


def with_profiles(chunks: DataFrame, eligible: DataFrame) -> DataFrame:
    """Chunks of versions some profile admits, with the array of those profiles."""
    admitted = eligible.groupBy("version_id").agg(F.sort_array(F.collect_set("profile")).alias("profiles"))
    return chunks.join(admitted, "version_id")


# --- metadata -----------------------------------------------------------------


def metadata_problem() -> Column:
    """The first broken rule of a metadata row (dates as text), or NULL."""
    owner = F.col("owner_role")
    return (
        F.when(~F.col("content_type").isin(*fixed.CONTENT_TYPES), "CONTENT_TYPE")
        .when(~F.col("applicable_scope").isin(*fixed.AUDIENCE_SCOPES), "APPLICABLE_SCOPE")
        .when(~F.col("business_status").isin(*fixed.BUSINESS_STATUSES), "BUSINESS_STATUS")
        .when(F.col("effective_from").isNotNull() & tx.iso_date(F.col("effective_from")).isNull(), "EFFECTIVE_FROM")
        .when(F.col("review_due_at").isNotNull() & tx.iso_date(F.col("review_due_at")).isNull(), "REVIEW_DUE_AT")
        .when(
            owner.isNotNull() & (tx.is_blank(owner) | (F.length(owner) > 80) | ~sf.is_safe_text(owner)), "OWNER_ROLE"
        )
        .when(
            F.col("supersedes_version_id").isNotNull() & ~sf.is_safe_id(F.col("supersedes_version_id")), "SUPERSEDES_ID"
        )
    )


def metadata_updates(updates: DataFrame, shown: DataFrame, versions: DataFrame) -> DataFrame:
    """Check metadata updates against the version each document shows.

    ``updates``: document_id, update_no and the metadata columns; ``shown``:
    document_id, version_id. The superseded version must be another version of
    the same document. Rows come back with their ``problem``.
    """
    owner = versions.select(
        F.col("version_id").alias("supersedes_version_id"), F.col("document_id").alias("superseded_document_id")
    )
    current = shown.select("document_id", F.col("version_id").alias("version_id"))
    return (
        updates.join(current, "document_id", "left")
        .join(owner, "supersedes_version_id", "left")
        .withColumn(
            "problem",
            F.when(F.col("version_id").isNull(), "UNKNOWN_DOCUMENT")
            .otherwise(metadata_problem())
        )
        .withColumn(
            "problem",
            F.coalesce(
                "problem",
                F.when(
                    F.col("supersedes_version_id").isNotNull()
                    & ~F.col("superseded_document_id").eqNullSafe(F.col("document_id")),
                    "SUPERSEDES_OTHER_DOCUMENT",
                ).when(F.col("supersedes_version_id") == F.col("version_id"), "SUPERSEDES_ITSELF"),
            ),
        )
    )


def upsert_metadata(existing: DataFrame, accepted: DataFrame) -> DataFrame:
    """Metadata after the accepted updates; the last update of a version wins."""
    columns = ["version_id", "content_type", "applicable_scope", "effective_from", "review_due_at", "business_status"]
    old = existing.select(*columns, F.lit(-1).cast("bigint").alias("update_no"))
    new = accepted.select(
        "version_id",
        "content_type",
        "applicable_scope",
        tx.iso_date(F.col("effective_from")).alias("effective_from"),
        tx.iso_date(F.col("review_due_at")).alias("review_due_at"),
        "business_status",
        F.col("update_no").cast("bigint").alias("update_no"),
    )
    last = F.max_by(F.struct(*columns[1:]), F.col("update_no")).alias("m")
    return old.unionByName(new).groupBy("version_id").agg(last).select("version_id", "m.*")
