import pytest
from pyspark.sql import functions as F

from citeloom.functions import metrics as mx
from citeloom.operators import arms, conversations, evaluation, feedback


def rows(spark, data, schema):
    return spark.createDataFrame(data, schema)


def test_four_arm_golden(spark):
    cases = rows(spark, [("c1", "fact", False), ("c2", "fact", False), ("c3", "no_answer", True)], "case_id string, type string, no_answer boolean")
    expected = rows(spark, [("c1", "a"), ("c2", "b")], "case_id string, source_id string")
    schema = "case_id string, arm string, rank int, source_id string"
    found = rows(spark, [("c1", "hybrid", 1, "a"), ("c2", "hybrid", 1, "x"), ("c2", "hybrid", 2, "b"), ("c3", "hybrid", 1, "z")], schema)
    shown = rows(spark, [("c1", "hybrid", 1, "a"), ("c2", "hybrid", 1, "x"), ("c3", "hybrid", 1, "z")], schema)
    facts = evaluation.case_facts(
        cases.withColumn("arm", F.lit("hybrid")), expected, found, shown, ["case_id", "arm"]
    ).withColumns({"answered": F.col("case_id") != "c3", "refused": F.col("case_id") == "c3"})
    report = {r["metric"]: (r["numerator"], r["denominator"], r["rate"]) for r in arms.arm_report(facts).collect()}
    assert report["recall_at_20"] == (2, 2, 1.0)
    assert report["recall_at_6"] == (1, 2, 0.5)
    assert report["mrr_at_20"] == (1.5, 2, 0.75)
    assert report["ndcg_at_6"] == (1.0, 2, 0.5)
    assert report["candidate_contamination"] == (1, 1, 1.0)


def test_wilson(spark):
    low, high = mx.wilson(F.col("n"), F.col("d"))
    table = rows(spark, [(1, 2), (0, 0), (5, 5)], "n int, d int").select(low.alias("l"), high.alias("h"))
    half, none, full = table.collect()
    assert (round(half["l"], 6), round(half["h"], 6)) == (0.094531, 0.905469)
    assert (none["l"], none["h"]) == (0.0, 0.0) and full["h"] == 1.0


def test_stable_distinct_before_k(spark):
    cases = rows(spark, [("c",)], "case_id string")
    expected = rows(spark, [("c", "a"), ("c", "b")], "case_id string, source_id string")
    ranked = rows(spark, [("c", 1, "x"), ("c", 2, "x"), ("c", 3, "a")], "case_id string, rank int, source_id string")
    got = evaluation.recall_precision(cases, expected, ranked, 2).first()
    assert (got["recall"], got["precision"]) == (0.5, 0.5)


def test_history_limits(spark):
    data = []
    for n in range(7):
        data += [("s", 2 * n, "user", f"u{n}", "submitted", None, "q" * 10), ("s", 2 * n + 1, "assistant", f"a{n}", "answered", f"u{n}", "r" * 10)]
    data.append(("s", 14, "user", "u9", "submitted", None, "open"))
    schema = "session_id string, ord int, role string, message_id string, status string, reply_to_message_id string, content string"
    table = rows(spark, data, schema).withColumn("created_at", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("ord") * 40_000))
    turns = conversations.complete_turns(table).orderBy("turn_no").collect()
    assert [t["assistant_message_id"] for t in turns] == ["a6", "a5", "a4", "a3", "a2"]
    assert [t["assistant_message_id"] for t in conversations.complete_turns(table, max_chars=45).orderBy("turn_no").collect()] == ["a6", "a5"]


@pytest.mark.parametrize(
    ("reason", "status", "risk", "want"),
    [
        (None, "answered", False, ("P3", 0)),
        ("not_answered", "answered", False, ("P2", 3)),
        ("version_mismatch", "refused", False, ("P1", 8)),
        (None, "error", True, ("P0", 9)),
    ],
)
def test_triage(spark, reason, status, risk, want):
    schema = "case_id string, reason_code string, answer_status string, latency_bucket string, high_risk boolean, version_mismatch boolean, citation_mismatch boolean, repeated_followup boolean"
    row = feedback.score_cases(rows(spark, [("c", reason, status, None, risk, False, False, False)], schema)).first()
    assert (row["triage_priority"], row["triage_score"]) == want


def test_lifecycle_takes_steps_in_order(spark):
    cases = rows(spark, [("a",), ("b",)], "case_id string")
    log = [("a", "fixed", 1), ("a", "triaged", 2), ("a", "triaged", 3), ("a", "fixed", 4), ("a", "closed", 5), ("b", "closed", 1)]
    got = {r["case_id"]: (r["status"], r["accepted"], r["refused"]) for r in feedback.bad_case_lifecycle(cases, rows(spark, log, "case_id string, target_status string, seq bigint")).collect()}
    assert got == {"a": ("fixed", 2, 3), "b": ("new", 0, 1)}


def test_bad_case_log_is_arranged_once(spark):
    log = [("a", "triaged", 5), ("a", "fixed", 3), ("a", "fixed", 7), ("a", "closed", 9), ("b", "fixed", 1), ("x", "triaged", 1)]
    cases = rows(spark, [("a",), ("b",), ("c",)], "case_id string")
    reached = feedback.bad_case_lifecycle(cases, rows(spark, log, "case_id string, target_status string, seq bigint"))
    got = {r["case_id"]: (r["status"], r["accepted"], r["refused"]) for r in reached.collect()}
    assert got == {"a": ("fixed", 2, 2), "b": ("new", 0, 1), "c": ("new", 0, 0)}
    plan = reached._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1
