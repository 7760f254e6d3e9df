"""Comparison of retrieval arms: rates, fusion, drops, root causes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom import fixed
from citeloom.functions import metrics as mx

ARM_NAMES = [name for name, _, _ in fixed.ARMS]
FALSE_DROP_REASONS = ("exact_duplicate", "near_duplicate", "heading_cap")


def arm_table(spark) -> DataFrame:
    return spark.createDataFrame(list(fixed.ARMS), "arm string, retrieval_strategy string, post_fusion_dedup boolean")


def expand_arms(cases: DataFrame) -> DataFrame:
    """Every case under each of the four arms; the arm list is an array literal."""
    arms = F.array(
        *[
            F.struct(
                F.lit(a).alias("arm"), F.lit(s).alias("retrieval_strategy"), F.lit(d).alias("post_fusion_dedup")
            )
            for a, s, d in fixed.ARMS
        ]
    )
    return cases.select(*cases.columns, F.explode(arms).alias("a")).select(*cases.columns, "a.*")


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def _rate(numerator: Column, denominator: Column) -> Column:
    return F.struct(
        F.round(numerator.cast("double"), 6).alias("numerator"),
        denominator.cast("bigint").alias("denominator"),
        F.round(mx.ratio(numerator, denominator).cast("double"), 6).alias("rate"),
    )


def arm_report(facts: DataFrame) -> DataFrame:
    """Metric lines per arm: arm, metric, numerator, denominator, rate.

    ``facts`` from ``case_facts`` keyed by (case_id, arm) with answered and
    refused. Means are rounded to six digits before they are divided.
    """
    answerable, no_answer = ~F.col("no_answer"), F.col("no_answer")
    total = lambda c: F.coalesce(F.sum(F.when(answerable, F.col(c))), F.lit(0))
    sums = facts.groupBy("arm").agg(
        _count(answerable).alias("answerable"),
        _count(no_answer).alias("no_answers"),
        total("hits_20").alias("hits_20"),
        total("hits_6").alias("hits_6"),
        total("expected_n").alias("expected"),
        total("evidence_n").alias("shown"),
        F.round(total("rr").cast("double"), 6).alias("rr"),
        F.round(total("ndcg_6").cast("double"), 6).alias("ndcg"),
        _count(answerable & F.col("answered")).alias("answered_n"),
        _count(answerable & F.col("answered") & (F.col("hits_6") > 0)).alias("grounded_n"),
        _count(no_answer & (F.col("candidates_n") > 0)).alias("dirty_candidates"),
        _count(no_answer & (F.col("evidence_n") > 0)).alias("dirty_evidence"),
        _count(no_answer & F.col("refused") & ~F.col("answered")).alias("refused_right"),
    )
    c = F.col
    lines = mx.long_form(
        recall_at_20=_rate(c("hits_20"), c("expected")),
        recall_at_6=_rate(c("hits_6"), c("expected")),
        precision_at_6=_rate(c("hits_6"), c("shown")),
        mrr_at_20=_rate(c("rr"), c("answerable")),
        ndcg_at_6=_rate(c("ndcg"), c("answerable")),
        availability=_rate(c("answered_n"), c("answerable")),
        grounded_success=_rate(c("grounded_n"), c("answerable")),
        candidate_contamination=_rate(c("dirty_candidates"), c("no_answers")),
        evidence_contamination=_rate(c("dirty_evidence"), c("no_answers")),
        correct_refusal=_rate(c("refused_right"), c("no_answers")),
    )
    return sums.select("arm", F.explode(lines).alias("m")).select("arm", "m.metric", "m.r.*")


def fusion_report(cases: DataFrame, expected: DataFrame, fusion: DataFrame) -> DataFrame:
    """Membership, survival and rank movement of answerable cases, in one row.

    ``fusion``: case_id, candidate_id, source_id, membership, vector_rank,
    lexical_rank, fused_rank. A fact is relevant when either of its ids is
    expected; survival counts against all expected ids. The last count is of
    facts past rank 20, whatever its traditional name suggests.
    """
    answerable = cases.where("not no_answer").select("case_id")
    wanted = expected.select("case_id", "source_id").distinct().join(answerable, "case_id", "left_semi")
    either = fusion.select(
        "case_id", "fused_rank", F.explode(F.array_distinct(F.array("candidate_id", "source_id"))).alias("source_id")
    )
    relevant = (
        either.join(wanted, ["case_id", "source_id"], "left_semi").select("case_id", "fused_rank").distinct()
    )
    judged = (
        fusion.join(answerable, "case_id", "left_semi")
        .join(relevant.withColumn("relevant", F.lit(True)), ["case_id", "fused_rank"], "left")
        .withColumn("relevant", F.coalesce("relevant", F.lit(False)))
    )
    member, hit = F.col("membership"), F.col("relevant")
    moved = F.col("fused_rank") - F.least("vector_rank", "lexical_rank")
    return judged.agg(
        *[_count(member == m).alias(m) for m in ("shared", "vector_only", "lexical_only")],
        _count(hit & (F.col("fused_rank") <= fixed.MAX_CANDIDATES)).alias("relevant_survived"),
        _count(hit & moved.isNotNull()).alias("displacement_count"),
        F.round(F.coalesce(F.avg(F.when(hit, moved)), F.lit(0.0)), 6).alias("displacement_mean"),
        _count(hit & (F.col("fused_rank") > fixed.MAX_CANDIDATES)).alias("relevant_facts_past_top20"),
    ).withColumn("relevant_total", wanted.agg(F.count("*")).scalar())


def drop_counts(drops: DataFrame) -> DataFrame:
    """Drops per arm and reason, all zero-filled, with the relevant drops.

    ``drops``: arm, reason, relevant. The headline is the hybrid row: other
    arms would count the same facts again.
    """
    table = (
        drops.groupBy("arm")
        .pivot("reason", list(fixed.DROP_REASONS))
        .agg(F.count(F.lit(1)))
        .join(drops.groupBy("arm").agg(_count(F.col("relevant")).alias("relevant_drops")), "arm")
    )
    return arm_table(drops.sparkSession).select("arm").join(table, "arm", "left").fillna(0).withColumn(
        "is_headline", F.col("arm") == "hybrid"
    )


def _per_case(facts: DataFrame, drops: DataFrame) -> DataFrame:
    """One row per case with what each arm held, from facts keyed by (case, arm)."""
    arm = F.col("arm")
    held = facts.groupBy("case_id", "no_answer").agg(
        *[_any(arm == a, F.col("hits_20") > 0).alias(f"{a}_has") for a in ARM_NAMES],
        *[_sum(arm == a, "candidates_n").alias(f"{a}_candidates") for a in ARM_NAMES],
        *[_sum(arm == a, "evidence_n").alias(f"{a}_evidence") for a in ARM_NAMES],
        _sum(arm == "hybrid_audit", "duplicate_noise").alias("audit_noise"),
    )
    false_drops = (
        drops.where(
            (arm == "hybrid")
            & (F.col("stage") == "post_rrf")
            & F.col("reason").isin(*FALSE_DROP_REASONS)
            & F.col("relevant")
        )
        .select("case_id")
        .distinct()
        .withColumn("relevant_drop", F.lit(True))
    )
    return held.join(false_drops, "case_id", "left").withColumn(
        "relevant_drop", F.coalesce("relevant_drop", F.lit(False))
    )


def _any(condition: Column, value: Column) -> Column:
    return F.coalesce(F.bool_or(F.when(condition, value)), F.lit(False))


def _sum(condition: Column, column: str) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(column))), F.lit(0))


def dedup_comparison(facts: DataFrame, drops: DataFrame) -> DataFrame:
    """Hybrid against its audit form: deltas, noise and false-drop cases."""
    rows = _per_case(facts, drops)
    c = F.col
    false_drop = ~c("no_answer") & c("relevant_drop") & c("hybrid_audit_has") & ~c("hybrid_has")
    return rows.agg(
        (F.sum("hybrid_candidates") - F.sum("hybrid_audit_candidates")).alias("candidate_count_delta"),
        (F.sum("hybrid_evidence") - F.sum("hybrid_audit_evidence")).alias("evidence_count_delta"),
        F.sum("audit_noise").alias("duplicate_noise_count"),
        _count(false_drop).alias("false_drop_case_count"),
    )


def case_signals(facts: DataFrame, drops: DataFrame) -> DataFrame:
    """The five degradation signals of each case."""
    c = F.col
    answerable = ~c("no_answer")
    return _per_case(facts, drops).select(
        "case_id",
        (answerable & ~c("vector_has") & (c("lexical_has") | c("hybrid_has"))).alias("vector_recall_missing"),
        (c("no_answer") & (c("lexical_candidates") > 0) & (c("vector_candidates") == 0)).alias(
            "lexical_contamination"
        ),
        (answerable & c("vector_has") & c("lexical_has") & ~c("hybrid_has")).alias("rrf_rank_displacement"),
        (answerable & c("relevant_drop") & c("hybrid_audit_has") & ~c("hybrid_has")).alias("dedup_false_drop"),
        (
            answerable
            & (c("audit_noise") > 0)
            & ~c("hybrid_audit_has")
            & (~c("hybrid_has") | (c("hybrid_audit_evidence") == 0))
        ).alias("duplicate_noise"),
    )


def root_causes(signals: DataFrame) -> DataFrame:
    """Labels for the signals that occur; one explicit label when none does."""
    counts = signals.agg(*[_count(F.col(s)).alias(s) for s in fixed.ROOT_CAUSES])
    found = F.filter(
        F.array(*[F.struct(F.lit(s).alias("code"), F.col(s).alias("n")) for s in fixed.ROOT_CAUSES]),
        lambda e: e["n"] > 0,
    )
    none = F.array(F.struct(F.lit("cannot_attribute").alias("code"), F.lit(0).cast("bigint").alias("n")))
    n = F.col("e.n")
    return counts.select(F.explode(F.when(F.size(found) > 0, found).otherwise(none)).alias("e")).select(
        "e.code",
        F.when(n >= fixed.ROOT_CAUSE_THRESHOLD, "high").when(n == 1, "medium").otherwise("low").alias("confidence"),
        n.alias("supporting_case_count"),
        F.when(n > 0, "investigate_in_separate_tuning_task")
        .otherwise("keep_baseline_and_collect_more_diagnostics")
        .alias("decision"),
    )


IDENTITY = ("set_id", "case_count", "set_checksum", "snapshot_hash")


def run_identity(cases: DataFrame, chunks: DataFrame, set_id: str) -> DataFrame:
    """Fingerprint of the inputs of a run, one row: set id, case count, set checksum, snapshot hash.

    Row hashes are summed as numbers in two halves, so the fingerprint needs
    no ordering and no list of all ids.
    """
    half = lambda text, start: F.conv(F.substring(F.sha2(text, 256), start, 8), 16, 10).cast("decimal(38,0)")

    def checksum(text: Column) -> Column:
        joined = F.concat_ws(":", F.count("*"), F.sum(half(text, 1)), F.sum(half(text, 9)))
        return F.sha2(joined, 256)

    snapshot = chunks.agg(checksum(F.concat_ws("\n", "version_id", "chunk_id", "content_hash"))).scalar()
    counted = cases.agg(
        F.count("*").alias("case_count"), checksum(F.concat_ws("\n", "case_id", "question")).alias("set_checksum")
    )
    return counted.select(F.lit(set_id).alias("set_id"), "case_count", "set_checksum", snapshot.alias("snapshot_hash"))


def identity_matches(actual: DataFrame, frozen: DataFrame) -> DataFrame:
    """The run's fingerprint against each frozen one (run, and the columns of IDENTITY).

    Every one of the four values has to agree; ``mismatches`` names those that don't.
    """
    wrong = [
        F.when(~F.col(name).eqNullSafe(F.col(f"frozen_{name}")), F.lit(name)) for name in IDENTITY
    ]
    # One row on the left.
    met = frozen.select("run", *[F.col(n).alias(f"frozen_{n}") for n in IDENTITY]).crossJoin(F.broadcast(actual))
    found = F.filter(F.array(*wrong), lambda name: name.isNotNull())
    return met.select("run", *IDENTITY, F.array_join(found, ",").alias("mismatches"), (F.size(found) == 0).alias("matches"))
