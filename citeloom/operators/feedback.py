"""Feedback cases: projection, triage, grouping, review, promotion, retention."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom import fixed
from citeloom.functions import redaction as rd
from citeloom.functions import safety as sf
from citeloom.functions import text as tx
from citeloom.operators.conversations import reply_join

_NO_TEXT = "cast(array() as array<string>)"


def case_identity(message_id: Column, session_id: Column) -> dict[str, Column]:
    hashed = F.sha2(message_id, 256)
    return {
        "case_id": F.concat(F.lit("fc_"), F.substring(hashed, 1, 32)),
        "message_id_hash": hashed,
        "session_id_hash": F.sha2(session_id, 256),
    }


def event_id(case_id: Column, created_at: Column, helpful: Column, reason: Column) -> Column:
    raw = F.concat_ws("|", case_id, created_at, helpful.cast("int").cast("string"), F.coalesce(reason, F.lit("")))
    return F.concat(F.lit("fe_"), F.substring(F.sha2(raw, 256), 1, 32))


def citation_ids(trace_ids: Column, message_ids: Column) -> Column:
    """Trace ids first, else the message's own; cleaned, in order, distinct."""
    chosen = F.when(F.coalesce(F.size(trace_ids), F.lit(0)) > 0, trace_ids).otherwise(message_ids)
    clean = F.transform(chosen, tx.strip)
    usable = lambda v: (F.length(v) > 0) & (F.length(v) <= 160) & ~v.rlike(f"[{fixed.SPACE_CLASS}]")
    return F.array_distinct(F.filter(clean, usable))


# --- projection ---------------------------------------------------------------


def project_cases(messages: DataFrame, feedback: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Redacted cases of terminal replies, and the feedback event of each.

    ``now`` is the collection time (timestamp). Returns (cases, events).
    """
    joined = reply_join(messages, feedback).withColumns(
        case_identity(F.col("message_id"), F.col("session_id"))
    )
    question = F.when(tx.is_blank(F.col("question")), fixed.MISSING_QUESTION).otherwise(F.col("question"))
    # A generator of one row: what follows can't be merged into it, so a pair is redacted once.
    once = F.explode(F.array(rd.redact_interaction(question, F.col("content"))))
    redacted = joined.select("*", once.alias("redacted"))
    has_event = F.col("feedback").isNotNull()
    cases = redacted.select(
        "case_id",
        "message_id_hash",
        "session_id_hash",
        now.alias("collected_at"),
        F.col("redacted.question_text").alias("question_redacted"),
        F.col("redacted.answer_text").alias("answer_redacted"),
        rd.worst_status(F.col("redacted.question_status"), F.col("redacted.answer_status")).alias("redaction_status"),
        F.lit(fixed.REDACTOR_VERSION).alias("redaction_version"),
        F.col("redacted.flags").alias("redaction_flags"),
        F.col("status").alias("answer_status"),
        "reason_code",
        F.col("feedback.reason").alias("feedback_reason"),
        F.when(F.col("audience_scope").isin(*fixed.AUDIENCE_SCOPES), F.col("audience_scope"))
        .otherwise("unspecified")
        .alias("audience_scope"),
        (now + F.expr(f"interval {fixed.RETENTION_DAYS} days")).alias("retention_expires_at"),
        F.lit("unreviewed").alias("review_status"),
        F.lit("not_promoted").alias("promotion_status"),
        has_event.cast("int").alias("event_count"),
    )
    events = joined.where(has_event).select(
        event_id(
            F.col("case_id"),
            F.date_format("feedback.created_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"),
            F.col("feedback.helpful"),
            F.col("feedback.reason"),
        ).alias("event_id"),
        "case_id",
        F.col("feedback.helpful").alias("helpful"),
        F.col("feedback.reason").alias("feedback_reason"),
        F.col("feedback.created_at").alias("event_at"),
        F.lit("user_click").alias("source"),
        F.lit(1).alias("event_schema_version"),
    )
    return cases, events


def new_cases(cases: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases to insert (id unknown), and conflicts (known id, other identity)."""
    held = existing.select(
        "case_id",
        F.col("message_id_hash").alias("held_message"),
        F.col("session_id_hash").alias("held_session"),
    )
    conflicts = (
        cases.join(held, "case_id")
        .where("message_id_hash <> held_message or session_id_hash <> held_session")
        .select("case_id")
        .distinct()
    )
    return cases.join(existing.select("case_id"), "case_id", "left_anti"), conflicts


# --- triage -------------------------------------------------------------------


def triage_signals(
    reason: Column,
    answer_status: Column,
    latency_bucket: Column,
    *,
    high_risk: Column,
    version_mismatch: Column,
    citation_mismatch: Column,
    repeated_followup: Column,
) -> list[tuple[Column, Column, int]]:
    """(condition, reason label, weight) in reporting order."""
    weight = fixed.TRIAGE_WEIGHTS
    is_ = lambda *codes: F.coalesce(reason.isin(*codes), F.lit(False))
    failed = answer_status.isin("error", "refused")
    unverifiable = is_("ANSWER_NOT_VERIFIABLE", "unverifiable")
    failure_label = (
        F.when(answer_status == "error", "answer_error")
        .when(answer_status == "refused", "answer_refused")
        .otherwise("answer_unverifiable")
    )
    slow = is_("too_slow") | F.coalesce(latency_bucket.isin(*fixed.SLOW_BUCKETS), F.lit(False))
    return [
        (high_risk, F.lit("high_risk"), weight["high_risk"]),
        (version_mismatch | is_("version_mismatch"), F.lit("version_mismatch"), weight["version_mismatch"]),
        (citation_mismatch | is_("citation_mismatch"), F.lit("citation_mismatch"), weight["citation_mismatch"]),
        (failed | unverifiable, failure_label, weight["answer_failure"]),
        (is_("not_answered", "missing_step", "not_helpful"), F.lit("user_unhelpful"), weight["user_unhelpful"]),
        (repeated_followup, F.lit("repeated_followup"), weight["repeated_followup"]),
        (slow, F.lit("slow_response"), weight["slow_response"]),
    ]


def score_cases(cases: DataFrame) -> DataFrame:
    """Adds triage_score, triage_reasons and triage_priority.

    Needs reason_code, answer_status, latency_bucket and the boolean columns
    high_risk, version_mismatch, citation_mismatch, repeated_followup.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    signals = triage_signals(
        F.col("reason_code"),
        F.col("answer_status"),
        F.col("latency_bucket"),
        high_risk=flag("high_risk"),
        version_mismatch=flag("version_mismatch"),
        citation_mismatch=flag("citation_mismatch"),
        repeated_followup=flag("repeated_followup"),
    )
    score = F.lit(0)
    for condition, _, weight in signals:
        score = score + F.when(condition, weight).otherwise(0)
    return (
        cases.withColumn("triage_score", score)
        .withColumn("triage_reasons", F.array_compact(F.array(*[F.when(c, label) for c, label, _ in signals])))
        .withColumn(
            "triage_priority",
            F.when(flag("high_risk"), "P0")
            .when(F.col("triage_score") >= 7, "P1")
            .when(F.col("triage_score") >= 3, "P2")
            .otherwise("P3"),
        )
    )


def group_questions(cases: DataFrame) -> DataFrame:
    """One representative case per question, with the events of the whole group.

    The fingerprint ignores case, width, spaces and punctuation. Aggregates
    only: a question asked by a third of all users is combined map-side.
    """
    keep = F.struct("triage_priority", (-F.col("triage_score")).alias("neg"), "case_id")
    grouped = (
        cases.withColumn("fingerprint", tx.question_fingerprint(F.col("question_redacted")))
        .groupBy("fingerprint")
        .agg(
            F.min_by(F.struct("case_id", "triage_priority", "triage_score", "triage_reasons"), keep).alias("r"),
            F.sum("event_count").alias("event_count"),
            F.count("*").alias("case_count"),
        )
    )
    return grouped.select(
        "r.case_id",
        "fingerprint",
        "r.triage_priority",
        "r.triage_score",
        F.when(F.col("case_count") > 1, F.array_union("r.triage_reasons", F.array(F.lit("duplicate_question"))))
        .otherwise(F.col("r.triage_reasons"))
        .alias("triage_reasons"),
        "event_count",
        "case_count",
    ).orderBy("triage_priority", F.col("triage_score").desc(), "case_id")


def mark_success_sample(cases: DataFrame, one_in: int) -> DataFrame:
    """Mark a stable sample of successful cases for review."""
    bucket = F.conv(F.substring(F.sha2("case_id", 256), 1, 8), 16, 10).cast("bigint") % one_in
    sampled = (F.col("answer_status") == "answered") & (F.size("triage_reasons") == 0) & (bucket == 0)
    return cases.withColumn(
        "triage_reasons",
        F.when(
            sampled, F.array_union("triage_reasons", F.array(F.lit("random_success_sample")))
        ).otherwise(F.col("triage_reasons")),
    )


def run_counters(cases: DataFrame, events: DataFrame) -> DataFrame:
    """Counters of one projection run in one row."""
    counted = [F.count("*").alias("cases_seen")]
    counted += [
        F.count_if(F.col("redaction_status") == s).alias(f"redaction_{s}") for s in fixed.REDACTION_STATUSES
    ]
    counted += [F.count_if(F.col("triage_priority") == p).alias(p.lower()) for p in fixed.TRIAGE_PRIORITIES]
    return cases.agg(*counted).withColumn("events_seen", events.agg(F.count("*")).scalar())


# --- review -------------------------------------------------------------------


def review_queue(cases: DataFrame, *, limit: int = 50, **filters: str | None) -> DataFrame:
    """The review list: equality filters first, then the first ``limit`` rows.

    Filters: review_status, triage_priority, reason_code, answer_status,
    source_version.
    """
    if not 1 <= limit <= 100:
        raise ValueError("limit must be between 1 and 100")
    rows = cases
    for name, value in filters.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    return rows.orderBy("triage_priority", "collected_at", "case_id").limit(limit)


def safe_case_view(cases: DataFrame) -> DataFrame:
    """What a reviewer may see: no text unless redaction passed, safe codes only."""
    visible = F.col("redaction_status") == "passed"
    first_line = F.element_at(F.split("question_redacted", r"\r\n|[\n\r]", 2), 1)
    return cases.select(
        "case_id",
        F.when(visible, F.col("question_redacted")).alias("question"),
        F.when(visible, F.col("answer_redacted")).alias("answer"),
        F.when(visible, F.substring(tx.strip(first_line), 1, 120))
        .otherwise(fixed.HIDDEN_PREVIEW)
        .alias("question_preview"),
        "redaction_status",
        "answer_status",
        sf.safe_code(F.col("reason_code")).alias("reason_code"),
        F.when(visible, F.col("citation_count")).otherwise(0).alias("citation_count"),
        "triage_priority",
        "review_status",
        "promotion_status",
    )


def review_summary(cases: DataFrame) -> DataFrame:
    """Total and counts per priority, review and promotion status: key, count."""
    priority, review, promotion = "triage_priority", "review_status", "promotion_status"
    sets = cases.groupingSets([[], [priority], [review], [promotion]], priority, review, promotion)
    key = (
        F.when(F.col("level") == 7, "cases_total")
        .when(F.col("level") == 3, F.concat(F.lit("priority_"), F.col(priority)))
        .when(F.col("level") == 5, F.concat(F.lit("review_"), F.col(review)))
        .otherwise(F.concat(F.lit("promotion_"), F.col(promotion)))
    )
    return sets.agg(F.count("*").alias("count"), F.grouping_id().alias("level")).select(key.alias("key"), "count")


def apply_reviews(cases: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cases with the status of their latest review, and rejected review rows.

    Review ids must be new and belong to a known case.
    """
    seen = reviews.groupBy("review_id").agg(F.count("*").alias("n"))
    checked = (
        reviews.join(seen, "review_id")
        .join(cases.select("case_id", F.lit(True).alias("known")), "case_id", "left")
        .withColumn(
            "problem",
            F.when(F.col("n") > 1, "REVIEW_ID_EXISTS").when(F.col("known").isNull(), "UNKNOWN_CASE"),
        )
    )
    latest = (
        checked.where("problem is null")
        .groupBy("case_id")
        .agg(F.max_by("decision", F.struct("reviewed_at", "review_id")).alias("decision"))
    )
    updated = cases.join(latest, "case_id", "left").withColumn(
        "review_status",
        F.coalesce(tx.mapped(F.col("decision"), fixed.REVIEW_STATUS_BY_DECISION), F.col("review_status")),
    )
    return updated.drop("decision"), checked.where("problem is not null").select("review_id", "case_id", "problem")


# --- promotion ----------------------------------------------------------------


def review_gate_facts(reviews: DataFrame) -> DataFrame:
    """Per case, what the review gate looks at."""
    approved = (
        (F.col("decision") == "approve")
        & F.coalesce("evidence_ok", F.lit(False))
        & F.coalesce("points_ok", F.lit(False))
        & F.coalesce("safety_ok", F.lit(False))
    )
    return reviews.groupBy("case_id").agg(
        F.count("*").alias("review_count"),
        F.bool_or(F.col("decision") == "needs_adjudication").alias("adjudication"),
        F.bool_or(F.col("decision") == "reject").alias("rejected"),
        F.bool_or(approved).alias("approved"),
        F.bool_or(approved & (F.col("reviewer_role") == "clinical_reviewer")).alias("clinical"),
    )


def promotion_decisions(
    cases: DataFrame, reviews: DataFrame, evidence: DataFrame, corpus: DataFrame, target_split: str
) -> DataFrame:
    """Whether each case may enter an evaluation set, with the first blocking reason.

    ``evidence`` (case_id, evidence_valid, evidence_reason, necessary_count,
    atomic_points_ok, traceable) serves answered cases; ``corpus`` (case_id,
    full_corpus_checked, no_supporting_evidence, corpus_version) serves cases
    without an answer, which block when it is absent.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    no_answer = F.col("answer_status").isin("refused", "error") | F.coalesce(
        F.col("reason_code").isin("no_answer", "not_answered", "ANSWER_NOT_VERIFIABLE"), F.lit(False)
    )
    tuned = F.arrays_overlap("triage_reasons", F.array(F.lit("tuning_input"), F.lit("used_for_tuning")))
    unredacted = F.when(F.col("redaction_status") != "passed", "redaction_not_passed")
    corpus_fault = (
        F.when(F.col("has_corpus").isNull(), "negative_corpus_check_missing")
        .when(unredacted.isNotNull(), unredacted)
        .when(~flag("full_corpus_checked"), "full_corpus_check_missing")
        .when(~flag("no_supporting_evidence"), "supporting_evidence_found")
        .when(F.coalesce(F.length("corpus_version"), F.lit(0)) == 0, "corpus_version_missing")
    )
    evidence_fault = (
        F.when(F.col("has_evidence").isNull(), "evidence_check_missing")
        .when(unredacted.isNotNull(), unredacted)
        .when(~flag("evidence_valid"), F.coalesce("evidence_reason", F.lit("evidence_invalid")))
        .when(F.coalesce("necessary_count", F.lit(0)) == 0, "necessary_evidence_missing")
        .when(~flag("atomic_points_ok"), "atomic_points_missing")
        .when(~flag("traceable"), "traceability_missing")
        .when(F.coalesce(F.length("source_version"), F.lit(0)) == 0, "source_version_missing")
    )
    review_fault = (
        F.when(F.col("review_count").isNull(), "review_missing")
        .when(F.col("adjudication"), "review_adjudication_required")
        .when(F.col("rejected"), "review_rejected")
        .when(~F.col("approved"), "review_approval_missing")
        .when(F.col("triage_priority").isin("P0", "P1") & ~F.col("clinical"), "clinical_review_required")
    )
    fault = (
        F.when(F.lit(target_split not in fixed.PROMOTION_SPLITS), "invalid_target_split")
        .when(F.lit(target_split == "holdout") & tuned, "holdout_cannot_be_tuning_input")
        .otherwise(F.coalesce(F.when(no_answer, corpus_fault).otherwise(evidence_fault), review_fault))
    )
    return (
        cases.join(review_gate_facts(reviews), "case_id", "left")
        .join(evidence.withColumn("has_evidence", F.lit(True)), "case_id", "left")
        .join(corpus.withColumn("has_corpus", F.lit(True)), "case_id", "left")
        .select(
            "case_id",
            F.when(fault.isNull(), "golden_v2_candidate").otherwise("not_promoted").alias("status"),
            F.coalesce(fault, F.lit("review_approved")).alias("reason"),
        )
    )


def promotion_records(
    decisions: DataFrame, existing: DataFrame, *, set_id: str, version: str, split: str, manifest_id: str
) -> DataFrame:
    """Records of promotable cases that are not recorded yet."""
    raw = F.concat_ws("|", "case_id", *[F.lit(v) for v in (set_id, version, split, manifest_id)])
    return (
        decisions.where(F.col("status").isin("golden_v2_candidate", "golden_v2"))
        .select(
            F.concat(F.lit("pr_"), F.substring(F.sha2(raw, 256), 1, 32)).alias("promotion_id"),
            "case_id",
            F.lit(set_id).alias("target_set_id"),
            F.lit(version).alias("target_version"),
            F.lit(split).alias("target_split"),
            F.col("reason").alias("promotion_reason"),
            F.lit(manifest_id).alias("manifest_id"),
        )
        .join(existing.select("promotion_id").distinct(), "promotion_id", "left_anti")
    )


# --- bad cases ----------------------------------------------------------------


def open_bad_cases(feedback: DataFrame, existing: DataFrame) -> DataFrame:
    """One new bad case per (message, code) of unhelpful feedback, if not open yet."""
    return (
        feedback.where(~F.col("helpful") & F.col("reason").isNotNull())
        .select("message_id", tx.mapped(F.col("reason"), fixed.FEEDBACK_CODES).alias("code"))
        .where("code is not null")
        .distinct()
        .join(existing.select("message_id", "code"), ["message_id", "code"], "left_anti")
        .select(
            F.concat(F.lit("bc_"), F.substring(tx.sha(F.col("message_id"), F.col("code")), 1, 32)).alias("case_id"),
            "message_id",
            "code",
            F.lit("new").alias("status"),
        )
    )


def bad_case_lifecycle(bad_cases: DataFrame, log: DataFrame) -> DataFrame:
    """The status each case reaches by its transition log, with counts.

    ``log``: case_id, target_status, seq. A step is taken only from the status
    right before it, so the status after step n is reached at the first log
    entry for n that follows the entry taken for n - 1. Steps are windows over
    one arrangement of the log by case, and cases are joined once.
    """
    steps = fixed.BAD_CASE_STEPS
    of_case = Window.partitionBy("case_id")
    rows = log.select("case_id", "target_status", F.col("seq").cast("bigint").alias("seq"), F.lit(-1).cast("bigint").alias("at0"))
    for n, name in enumerate(steps[1:], 1):
        next_ = (F.col("target_status") == name) & (F.col("seq") > F.col(f"at{n - 1}"))
        rows = rows.withColumn(f"at{n}", F.min(F.when(next_, F.col("seq"))).over(of_case))
    last = len(steps) - 1
    reached = rows.groupBy("case_id").agg(
        F.count("*").alias("attempts"), F.max(sum(F.col(f"at{n}").isNotNull().cast("int") for n in range(1, last + 1))).alias("done")
    )
    done = F.coalesce("done", F.lit(0))
    names = F.array(*[F.lit(s) for s in steps])
    return bad_cases.select("case_id").join(reached, "case_id", "left").select(
        "case_id",
        F.element_at(names, done + 1).alias("status"),
        done.alias("accepted"),
        (F.coalesce("attempts", F.lit(0)) - done).alias("refused"),
    )


def bad_case_counts(bad_cases: DataFrame) -> DataFrame:
    return bad_cases.groupBy("code", "status").agg(F.count("*").alias("count"))


def bad_case_export(bad_cases: DataFrame) -> DataFrame:
    """Counts by code and by status: kind, value, count."""
    sets = bad_cases.groupingSets([["code"], ["status"]], "code", "status")
    return sets.agg(F.count("*").alias("count")).select(
        F.when(F.col("code").isNotNull(), "code").otherwise("status").alias("kind"),
        F.coalesce("code", "status").alias("value"),
        "count",
    )


# --- retention ----------------------------------------------------------------


def expired_cases(cases: DataFrame, now: Column) -> DataFrame:
    """Case ids whose retention text parses to a time not after ``now``.

    A text without an offset is UTC; one that does not parse is kept.
    """
    text = F.col("retention_expires_at").cast("string")
    with_zone = F.when(text.rlike(r"(?:Z|[+-]\d{2}:\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return cases.where(F.try_to_timestamp(with_zone) <= now).select("case_id")


def purge(expired: DataFrame, **tables: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without the expired cases, and one row of deleted counts."""
    kept = {name: table.join(expired, "case_id", "left_anti") for name, table in tables.items()}
    counts = [
        table.join(expired, "case_id", "left_semi").agg(F.count("*")).scalar().alias(f"{name}_deleted")
        for name, table in tables.items()
    ]
    return kept, expired.sparkSession.range(1).select(*counts)
