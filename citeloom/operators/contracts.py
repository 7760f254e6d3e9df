"""Contract checks: violations as rows, never exceptions."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom import fixed
from citeloom.functions import text as tx

HEX64 = "^[0-9a-fA-F]{64}$"


def violations(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) for every broken rule; a rule is a condition that means broken.

    One narrow pass: all rules of a row are tested where the row is read.
    """
    broken = F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
    return rows.select(key, F.explode(broken).alias("rule"))


def _outside(column: str, allowed) -> Column:
    return F.col(column).isNull() | ~F.col(column).isin(*allowed)


def _blank(column: str) -> Column:
    return tx.is_blank(F.col(column))


def _not_iso(column: str) -> Column:
    return _blank(column) | ~F.col(column).contains("T")


def _negative(column: str) -> Column:
    return F.col(column).isNull() | (F.col(column) < 0)


def case_violations(cases: DataFrame) -> DataFrame:
    """Feedback cases: identity, digests, times (text), domains and counts."""
    return violations(
        cases,
        "case_id",
        {
            "case_id": _blank("case_id"),
            "message_id_hash": ~F.coalesce(F.col("message_id_hash").rlike(HEX64), F.lit(False)),
            "session_id_hash": ~F.coalesce(F.col("session_id_hash").rlike(HEX64), F.lit(False)),
            "collected_at": _not_iso("collected_at"),
            "question_redacted": _blank("question_redacted"),
            "answer_redacted": _blank("answer_redacted"),
            "redaction_status": _outside("redaction_status", fixed.REDACTION_STATUSES),
            "answer_status": _outside("answer_status", fixed.ANSWER_STATUSES),
            "citation_count": _negative("citation_count"),
            "audience_scope": _outside("audience_scope", fixed.AUDIENCE_SCOPES),
            "retention_expires_at": _not_iso("retention_expires_at"),
            "triage_priority": _outside("triage_priority", fixed.TRIAGE_PRIORITIES),
            "triage_score": _negative("triage_score"),
            "review_status": _outside("review_status", fixed.REVIEW_STATUSES),
            "promotion_status": _outside("promotion_status", fixed.PROMOTION_STATUSES),
            "event_count": _negative("event_count"),
        },
    )


def event_violations(events: DataFrame) -> DataFrame:
    return violations(
        events,
        "event_id",
        {
            "event_id": _blank("event_id"),
            "case_id": _blank("case_id"),
            "helpful": F.col("helpful").isNull(),
            "feedback_reason": F.col("feedback_reason").isNotNull() & _blank("feedback_reason"),
            "event_at": _not_iso("event_at"),
            "source": _outside("source", fixed.FEEDBACK_SOURCES),
            "event_schema_version": F.col("event_schema_version").isNull() | (F.col("event_schema_version") < 1),
        },
    )


def review_violations(reviews: DataFrame) -> DataFrame:
    return violations(
        reviews,
        "review_id",
        {
            "review_id": _blank("review_id"),
            "case_id": _blank("case_id"),
            "reviewer_role": _outside("reviewer_role", fixed.REVIEWER_ROLES),
            "decision": _outside("decision", fixed.REVIEW_DECISIONS),
            "note_code": F.col("note_code").isNotNull() & _blank("note_code"),
            "review_version": _blank("review_version"),
            "reviewed_at": _not_iso("reviewed_at"),
        },
    )


def promotion_violations(records: DataFrame) -> DataFrame:
    names = ("promotion_id", "case_id", "target_set_id", "target_version", "promotion_reason", "manifest_id")
    rules = {name: _blank(name) for name in names}
    rules["target_split"] = _outside("target_split", fixed.PROMOTION_SPLITS)
    rules["promoted_at"] = _not_iso("promoted_at")
    return violations(records, "promotion_id", rules)


def version_violations(versions: DataFrame) -> DataFrame:
    return violations(
        versions,
        "version_id",
        {
            "version_id": _blank("version_id"),
            "sha256": ~F.coalesce(F.col("sha256").rlike(HEX64), F.lit(False)),
            "status": _outside("status", fixed.VERSION_STATUSES),
        },
    )


def arm_case_violations(cases: DataFrame, expected: DataFrame, arms: DataFrame) -> DataFrame:
    """Evaluation cases that break the four-arm contract: case_id, rule.

    ``cases``: case_id, case_type; ``expected``: case_id, source_id; ``arms``:
    case_id, arm, candidate_count, evidence_count.
    """
    ids = expected.groupBy("case_id").agg(F.count_distinct("source_id").alias("expected_n"))
    names = [a for a, _, _ in fixed.ARMS]
    held = arms.groupBy("case_id").agg(
        F.count_distinct("arm").alias("arm_n"),
        F.count_if(~F.col("arm").isin(*names)).alias("unknown_arms"),
        F.max("candidate_count").alias("max_candidates"),
        F.max("evidence_count").alias("max_evidence"),
    )
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    kind = F.col("case_type")
    return violations(
        cases.join(ids, "case_id", "left").join(held, "case_id", "left"),
        "case_id",
        {
            "case_type": _outside("case_type", ("answerable", "no_answer")),
            "answerable_without_expected": (kind == "answerable") & (n("expected_n") == 0),
            "no_answer_with_expected": (kind == "no_answer") & (n("expected_n") > 0),
            "arms_incomplete": (n("arm_n") != len(names)) | (n("unknown_arms") > 0),
            "too_many_candidates": n("max_candidates") > fixed.MAX_CANDIDATES,
            "too_much_evidence": n("max_evidence") > fixed.MAX_EVIDENCE,
        },
    )


def trace_violations(traces: DataFrame, candidates: DataFrame) -> DataFrame:
    """Diagnostic traces that break the contract: query_id, rule.

    ``traces``: query_id, strategy, retrieval_limit, rerank_limit, rrf_k,
    threshold, all_scores_captured, fusion_profile, vector_weight,
    lexical_weight; ``candidates`` from ``diagnostic_trace``.
    """
    chosen = F.col("selected")
    rank = F.col("selected_rank")
    score = F.col("rerank_score")
    finite = lambda c: ~F.isnan(c) & (F.abs(c) < float("inf"))
    facts = candidates.groupBy("query_id").agg(
        F.count("*").alias("n"),
        F.min("candidate_rank").alias("low"),
        F.max("candidate_rank").alias("high"),
        F.count_distinct("candidate_rank").alias("ranks"),
        F.count_if(~F.coalesce(F.col("source_id").rlike(fixed.DIAGNOSTIC_ID), F.lit(False))).alias("bad_ids"),
        F.count_if(chosen).alias("selected_n"),
        F.count_distinct(F.when(chosen, rank)).alias("selected_ranks"),
        F.max(F.when(chosen, rank)).alias("selected_high"),
        F.count_if(chosen & rank.isNull()).alias("selected_missing"),
        F.count_if(~chosen & rank.isNotNull()).alias("stray_ranks"),
        F.count_if(score.isNotNull() & ~(finite(score) & score.between(0.0, 1.0))).alias("bad_scores"),
        F.count_if(F.col("retrieval_score").isNotNull() & ~finite(F.col("retrieval_score"))).alias("bad_retrieval"),
        F.count_if(score.isNull()).alias("unscored"),
    )
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    limit = lambda c: F.col(c).isNull() | ~F.col(c).between(1, fixed.MAX_CANDIDATES)
    profile, weights = F.col("fusion_profile"), fixed.FUSION_WEIGHTS
    wrong_weights = F.lit(True)
    for name, (vector, lexical) in weights.items():
        same = F.col("vector_weight").eqNullSafe(F.lit(vector)) & F.col("lexical_weight").eqNullSafe(F.lit(lexical))
        wrong_weights = wrong_weights & ~(F.coalesce(profile == name, F.lit(False)) & same)
    return violations(
        traces.join(facts, "query_id", "left"),
        "query_id",
        {
            "strategy": _outside("strategy", fixed.TRACE_STRATEGIES),
            "retrieval_limit": limit("retrieval_limit"),
            "rerank_limit": limit("rerank_limit"),
            "rrf_k": F.col("rrf_k").isNull() | (F.col("rrf_k") < 1),
            "threshold": F.col("threshold").isNull() | ~F.col("threshold").between(0.0, 1.0),
            "fusion_weights": profile.isNotNull() & wrong_weights,
            "vector_profile": (F.col("strategy") == "vector") & profile.isNotNull() & (profile != "balanced"),
            "too_many_candidates": n("n") > fixed.MAX_CANDIDATES,
            "candidate_ranks": (n("n") > 0) & ((n("low") != 1) | (n("high") != n("n")) | (n("ranks") != n("n"))),
            "candidate_ids": n("bad_ids") > 0,
            "selected_ranks": (n("selected_missing") > 0)
            | (n("selected_ranks") != n("selected_n"))
            | (n("selected_high") != n("selected_n"))
            | (n("selected_n") > fixed.MAX_EVIDENCE),
            "stray_selected_rank": n("stray_ranks") > 0,
            "scores": (n("bad_scores") > 0) | (n("bad_retrieval") > 0),
            "scores_missing": F.col("all_scores_captured") & (n("unscored") > 0),
        },
    )
