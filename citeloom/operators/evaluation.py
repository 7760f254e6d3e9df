"""Retrieval and answer metrics over long-form facts.

Facts are rows (case, rank, id), never arrays: cases(case_id, type,
no_answer), expected(case_id, source_id), candidates and evidence(case_id,
rank, source_id), outcomes(case_id, answered, refused, ...). Every report
first reduces them to one row per case, then to one row per report line.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom import fixed
from citeloom.functions import metrics as mx
from citeloom.functions import text as tx

RETRIEVAL_K = fixed.MAX_CANDIDATES
EVIDENCE_K = fixed.MAX_EVIDENCE


def distinct_ranks(ranked: DataFrame, keys: list[str]) -> DataFrame:
    """First rank of each id, renumbered without gaps, blank ids dropped."""
    first = (
        ranked.withColumn("source_id", tx.strip(F.col("source_id")))
        .where(F.length("source_id") > 0)
        .groupBy(*keys, "source_id")
        .agg(F.min("rank").alias("first_rank"))
    )
    order = Window.partitionBy(*keys).orderBy("first_rank", "source_id")
    return first.withColumn("rank", F.row_number().over(order)).drop("first_rank")


def case_facts(
    cases: DataFrame, expected: DataFrame, candidates: DataFrame, evidence: DataFrame, keys: list[str] | None = None
) -> DataFrame:
    """One row per case (and arm): hits, sizes, reciprocal rank and DCG.

    ``keys`` starts with case_id; expected ids are per case only.
    """
    keys = keys or ["case_id"]
    relevant = expected.select("case_id", "source_id").distinct().withColumn("relevant", F.lit(1))
    sizes = relevant.groupBy("case_id").agg(F.count("*").alias("expected_n"))

    def judged(rows: DataFrame, k: int) -> DataFrame:
        return (
            distinct_ranks(rows, keys)
            .where(F.col("rank") <= k)
            .join(relevant, ["case_id", "source_id"], "left")
        )

    hit = F.col("relevant").isNotNull()
    found = judged(candidates, RETRIEVAL_K).groupBy(*keys).agg(
        F.count("*").alias("candidates_n"),
        F.count_if(hit).alias("hits_20"),
        F.min(F.when(hit, F.col("rank"))).alias("first_hit"),
    )
    shown = judged(evidence, EVIDENCE_K).groupBy(*keys).agg(
        F.count("*").alias("evidence_n"),
        F.count_if(hit).alias("hits_6"),
        F.coalesce(F.sum(F.when(hit, 1.0 / mx.discount(F.col("rank")))), F.lit(0.0)).alias("dcg_6"),
    )
    zero = F.lit(0)
    joined = cases.join(sizes, "case_id", "left").join(found, keys, "left").join(shown, keys, "left")
    filled = {c: F.coalesce(c, zero) for c in ("expected_n", "candidates_n", "hits_20", "evidence_n", "hits_6")}
    ideal = mx.ideal_dcg(F.col("expected_n"), EVIDENCE_K)
    return (
        joined.withColumns(filled)
        .withColumn("rr", F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)))
        .withColumn(
            "ndcg_6", F.when(F.col("expected_n") > 0, F.coalesce("dcg_6", F.lit(0.0)) / ideal)
        )
        .drop("dcg_6")
    )


# --- single metrics -----------------------------------------------------------


def recall_precision(cases: DataFrame, expected: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """Recall@k and Precision@k of each case after stable distinct; 0 when empty."""
    relevant = expected.select("case_id", "source_id").distinct()
    size = relevant.groupBy("case_id").agg(F.count("*").alias("relevant_n"))
    top = distinct_ranks(ranked, ["case_id"]).where(F.col("rank") <= k)
    hits = (
        top.join(relevant.withColumn("hit", F.lit(1)), ["case_id", "source_id"], "left")
        .groupBy("case_id")
        .agg(F.count("*").alias("retrieved_n"), F.count("hit").alias("hits"))
    )
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    return cases.select("case_id").join(size, "case_id", "left").join(hits, "case_id", "left").select(
        "case_id",
        mx.ratio(n("hits"), n("relevant_n")).alias("recall"),
        mx.ratio(n("hits"), n("retrieved_n")).alias("precision"),
    )


def reciprocal_ranks(cases: DataFrame, expected: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """1 / rank of the first relevant id within k, 0 without one."""
    first = (
        distinct_ranks(ranked, ["case_id"])
        .where(F.col("rank") <= k)
        .join(expected.select("case_id", "source_id").distinct(), ["case_id", "source_id"])
        .groupBy("case_id")
        .agg(F.min("rank").alias("first_hit"))
    )
    return cases.select("case_id").join(first, "case_id", "left").select(
        "case_id", F.coalesce(1.0 / F.col("first_hit"), F.lit(0.0)).alias("reciprocal_rank")
    )


def graded_ndcg(asked: DataFrame, grades: DataFrame, ranked: DataFrame, k: int) -> DataFrame:
    """nDCG@k of each case with a graded id; ``asked``: case_id, topic; ``grades``: topic, source_id, relevance.

    An id is graded once a topic, for all cases that ask it (a case of its own is
    a topic of its own), so no pair of case and graded id is made. Gains are
    2^rel - 1 and the ideal ranks all graded ids, so the ideal needs only the k
    best of a topic. Of an id that several topics of a case grade, the best counts.
    """
    asked = asked.select("case_id", "topic").distinct()
    held = (
        grades.where(~tx.is_blank(F.col("source_id")))
        .groupBy("topic", tx.strip(F.col("source_id")).alias("source_id"))
        .agg(F.greatest(F.max("relevance").cast("double"), F.lit(0.0)).alias("relevance"))
    )

    def best(rows: DataFrame, key: str) -> DataFrame:
        order = Window.partitionBy(key).orderBy(F.col("relevance").desc(), "source_id")
        return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)

    def of_cases(rows: DataFrame) -> DataFrame:
        return rows.groupBy("case_id", "source_id").agg(F.max("relevance").alias("relevance"))

    ideal = (
        best(of_cases(asked.join(best(held, "topic").drop("place"), "topic")), "case_id")
        .groupBy("case_id")
        .agg(F.sum(mx.gain(F.col("relevance")) / mx.discount(F.col("place"))).alias("idcg"))
    )
    top = distinct_ranks(ranked, ["case_id"]).where(F.col("rank") <= k)
    graded = top.join(asked, "case_id").join(held, ["topic", "source_id"])
    got = (
        graded.groupBy("case_id", "source_id", "rank")
        .agg(F.max("relevance").alias("relevance"))
        .groupBy("case_id")
        .agg(F.sum(mx.gain(F.col("relevance")) / mx.discount(F.col("rank"))).alias("dcg"))
    )
    return ideal.join(got, "case_id", "left").select(
        "case_id",
        F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(0.0).alias("ndcg"),
    )


# --- reports ------------------------------------------------------------------


def _count(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def _total(column: str, condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(column))), F.lit(0))


def _as_lines(aggregated: DataFrame, keys: list[str], **metrics: Column) -> DataFrame:
    return aggregated.select(*keys, F.explode(mx.long_form(**metrics)).alias("m")).select(
        *keys, "m.metric", "m.r.*"
    )


def _retrieval_sums() -> list[Column]:
    answerable = ~F.col("no_answer")
    return [
        F.count("*").alias("cases"),
        _count(answerable).alias("answerable"),
        _count(F.col("no_answer")).alias("no_answers"),
        _total("hits_20", answerable).alias("hits_20"),
        _total("hits_6", answerable).alias("hits_6"),
        _total("expected_n", answerable).alias("expected"),
        _total("evidence_n", answerable).alias("shown"),
        F.coalesce(F.sum(F.when(answerable, F.col("rr"))), F.lit(0.0)).alias("rr"),
        F.coalesce(F.sum(F.when(answerable, F.col("ndcg_6"))), F.lit(0.0)).alias("ndcg"),
        _count(answerable & (F.col("expected_n") > 0)).alias("ndcg_cases"),
        _count(F.col("no_answer") & (F.col("evidence_n") > 0)).alias("negative"),
    ]


def _retrieval_lines() -> dict[str, Column]:
    c = F.col
    return {
        "recall_at_20": mx.rate(c("hits_20"), c("expected")),
        "recall_at_6": mx.rate(c("hits_6"), c("expected")),
        "precision_at_6": mx.rate(c("hits_6"), c("shown")),
        "mrr_at_20": mx.mean(c("rr"), c("answerable")),
        "ndcg_at_6": mx.mean(c("ndcg"), c("ndcg_cases")),
        "negative_evidence_rate": mx.rate(c("negative"), c("no_answers")),
    }


def industry_report(facts: DataFrame, outcomes: DataFrame, citations: DataFrame, expected: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """All retrieval, generation and safety rates, one line each.

    ``facts`` from :func:`case_facts` with type and no_answer; ``outcomes``:
    case_id, answered, refused, covered, citation_valid, visible;
    ``citations``: case_id, source_id (resolved); ``reviews``: case_id,
    unsafe - without it the unsafe rate is 0/0, never "safe".
    """
    cited = citations.select("case_id", "source_id").distinct()
    cited_facts = (
        cited.join(
            expected.select("case_id", "source_id").distinct().withColumn("hit", F.lit(1)),
            ["case_id", "source_id"],
            "left",
        )
        .groupBy("case_id")
        .agg(F.count("*").alias("cited_n"), F.count("hit").alias("cited_hits"))
    )
    joined = (
        facts.join(outcomes, "case_id")
        .join(cited_facts, "case_id", "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("cited_n", "cited_hits")})
    )
    answerable, answered, refused = ~F.col("no_answer"), F.col("answered"), F.col("refused")
    grounded = answered & F.col("covered") & F.col("citation_valid")
    sums = joined.agg(
        *_retrieval_sums(),
        _count(answered).alias("answered_n"),
        _count(answerable & grounded).alias("grounded_n"),
        _count(answerable & refused).alias("over_refused"),
        _total("cited_hits", answerable).alias("cited_hits_n"),
        _total("cited_n", answerable).alias("cited_total"),
        _count(answered & F.col("visible")).alias("visible_n"),
        _count(F.col("no_answer") & refused).alias("refused_right"),
    )
    if reviews is None:
        sums = sums.withColumns({"unsafe_n": F.lit(0), "reviewed": F.lit(0)})
    else:
        checked = reviews.agg(_count(F.col("unsafe")).alias("u"), F.count("*").alias("n"))
        sums = sums.withColumns(
            {"unsafe_n": checked.select("u").scalar(), "reviewed": checked.select("n").scalar()}
        )
    c = F.col
    return _as_lines(
        sums,
        [],
        **_retrieval_lines(),
        answer_availability=mx.rate(c("answered_n"), c("cases")),
        grounded_answer_success=mx.rate(c("grounded_n"), c("answerable")),
        answerable_over_refusal=mx.rate(c("over_refused"), c("answerable")),
        citation_precision=mx.rate(c("cited_hits_n"), c("cited_total")),
        citation_recall=mx.rate(c("cited_hits_n"), c("expected")),
        unsafe_answer_rate=mx.rate(c("unsafe_n"), c("reviewed")),
        runtime_citation_visibility=mx.rate(c("visible_n"), c("answered_n")),
        no_answer_refusal=mx.rate(c("refused_right"), c("no_answers")),
    )


def acceptance_report(results: DataFrame) -> DataFrame:
    """The short report in one row; latencies average over known finite values.

    ``results``: answered, refused, no_answer, covered, citation_valid,
    visible, first_status_latency_ms, answer_duration_ms.
    """
    c, answered = F.col, F.col("answered")
    finite = lambda name: F.when(~F.isnan(name) & (F.abs(name) < float("inf")), c(name))
    sums = results.agg(
        F.count("*").alias("total"),
        _count(answered).alias("answered_total"),
        _count(c("citation_valid")).alias("valid"),
        _count(answered & c("covered")).alias("grounded"),
        _count(answered & c("visible")).alias("visible"),
        _count(c("no_answer")).alias("no_answers"),
        _count(c("no_answer") & c("refused")).alias("refused"),
        F.avg(finite("first_status_latency_ms")).alias("first_status_latency_ms"),
        F.avg(finite("answer_duration_ms")).alias("answer_duration_ms"),
    )
    return sums.select(
        "total",
        "answered_total",
        mx.ratio(c("valid"), c("total")).alias("citation_accuracy"),
        mx.ratio(c("grounded"), c("answered_total")).alias("grounded_accuracy"),
        mx.ratio(c("refused"), c("no_answers")).alias("no_answer_refusal_rate"),
        mx.ratio(c("answered_total"), c("total")).alias("answer_availability_rate"),
        mx.ratio(c("visible"), c("answered_total")).alias("runtime_citation_visibility_rate"),
        "first_status_latency_ms",
        "answer_duration_ms",
    )


def question_types(spark) -> DataFrame:
    return spark.createDataFrame([(t,) for t in fixed.QUESTION_TYPES], "type string")


def outcome_by_type(facts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Metric lines for each of the six question types, absent types as zeros."""
    kinds = question_types(facts.sparkSession)
    answerable, answered, refused = ~F.col("no_answer"), F.col("answered"), F.col("refused")
    grounded = answered & F.col("covered") & F.col("citation_valid")
    sums = (
        facts.join(outcomes, "case_id")
        .groupBy("type")
        .agg(
            *_retrieval_sums(),
            _count(answered).alias("answered_n"),
            _count(answerable & refused).alias("over_refused"),
            _count(answerable & grounded).alias("grounded_n"),
            _count(F.col("no_answer") & refused).alias("refused_right"),
        )
    )
    filled = kinds.join(sums, "type", "left").fillna(0)
    c = F.col
    return _as_lines(
        filled,
        ["type"],
        answer_availability=mx.rate(c("answered_n"), c("cases")),
        answerable_over_refusal=mx.rate(c("over_refused"), c("answerable")),
        grounded_answer_success=mx.rate(c("grounded_n"), c("answerable")),
        **_retrieval_lines(),
        no_answer_refusal=mx.rate(c("refused_right"), c("no_answers")),
    )


def lexical_by_type(facts: DataFrame) -> DataFrame:
    """Retrieval lines per question type and overall, in one pass (rollup)."""
    kinds = question_types(facts.sparkSession).union(
        facts.sparkSession.createDataFrame([("overall",)], "type string")
    )
    known = F.col("type").isin(*fixed.QUESTION_TYPES)
    sums = (
        facts.withColumn("type", F.when(known, F.col("type")))
        .rollup("type")
        .agg(*_retrieval_sums(), F.grouping("type").alias("is_total"))
        .where("is_total = 1 or type is not null")
        .withColumn("type", F.when(F.col("is_total") == 1, "overall").otherwise(F.col("type")))
        .drop("is_total")
    )
    return _as_lines(kinds.join(sums, "type", "left").fillna(0), ["type"], **_retrieval_lines())


# --- evaluation sets ----------------------------------------------------------


def filter_cases(cases: DataFrame, known_sources: DataFrame, count: int) -> DataFrame:
    """The first ``count`` usable cases in order.

    ``cases``: case_no, question, reference_points, source_ids, type. All
    fields present and all ids known; then the first of each question keeps
    its place - even if its type turns out unknown - and only then types and
    blank points are checked.
    """
    known = known_sources.select(F.col("source_id").alias("id")).distinct().withColumn("ok", F.lit(True))
    unknown = (
        cases.select("case_no", F.explode("source_ids").alias("id"))
        .join(known, "id", "left_anti")
        .select("case_no")
        .distinct()
    )
    complete = cases.where(
        ~tx.is_blank(F.col("question")) & (F.size("reference_points") > 0) & (F.size("source_ids") > 0)
    ).join(unknown, "case_no", "left_anti")
    columns = ["case_no", "question", "reference_points", "source_ids", "type"]
    first = (
        complete.groupBy(tx.casefold(tx.collapse_space(F.col("question"))).alias("question_key"))
        .agg(F.min_by(F.struct(*columns), "case_no").alias("c"))
        .select("c.*")
    )
    points = F.filter(F.transform("reference_points", tx.strip), lambda p: F.length(p) > 0)
    return (
        first.withColumn("type", tx.mapped(tx.casefold(tx.strip(F.col("type"))), fixed.QUESTION_TYPE_ALIASES))
        .withColumn("reference_points", points)
        .where(F.col("type").isNotNull() & (F.size("reference_points") > 0))
        .withColumn("question", tx.strip(F.col("question")))
        .withColumn("source_ids", F.array_distinct("source_ids"))
        .orderBy("case_no")
        .limit(count)
    )


def type_quota(cases: DataFrame, count: int) -> DataFrame:
    """Per type: cases held, cases required, and whether the quota is met."""
    held = cases.groupBy("type").agg(F.count("*").alias("cases"))
    exact = count == 30
    required = 5 if exact else 1 if count >= len(fixed.QUESTION_TYPES) else 0
    have = F.coalesce("cases", F.lit(0))
    return question_types(cases.sparkSession).join(held, "type", "left").select(
        "type",
        have.alias("cases"),
        F.lit(required).alias("required"),
        (have == required if exact else have >= required).alias("met"),
    )


def normalise_sources(items: DataFrame) -> DataFrame:
    """Sources with their id, sorted aliases and place in line; blank text dropped.

    ``items``: position, source_id, reference_id, chunk_id, text, file_name,
    heading_path. The id is the first present of source, reference and chunk
    id, else ``S`` and the position.
    """
    present = lambda c: F.when(F.length(F.col(c)) > 0, F.col(c))
    source_id = F.coalesce(
        present("source_id"), present("reference_id"), present("chunk_id"), F.concat(F.lit("S"), F.col("position"))
    )
    aliases = F.array_sort(
        F.array_distinct(F.filter(F.array("reference_id", "chunk_id"), lambda a: ~tx.is_blank(a)))
    )
    return items.where(~tx.is_blank(F.col("text")) & ~tx.is_blank(source_id)).select(
        "position",
        tx.strip(source_id).alias("source_id"),
        aliases.alias("aliases"),
        tx.strip(F.col("text")).alias("text"),
        F.coalesce("file_name", F.lit("")).alias("file_name"),
        F.filter("heading_path", lambda h: ~tx.is_blank(h)).alias("heading_path"),
    )


def known_source_ids(sources: DataFrame) -> DataFrame:
    """Ids and aliases a case may cite."""
    return (
        sources.select("source_id")
        .union(sources.select(F.explode("aliases").alias("source_id")))
        .distinct()
    )


def stratified_sample(sources: DataFrame, count: int) -> DataFrame:
    """2 * count sources, one per (file, heading) group and round.

    A group can give at most as many rows as are asked for, so the group limit
    cuts a huge group in every task before it is shuffled.
    """
    wanted = 2 * count
    groups = ["file_name", "heading_path"]
    inside = Window.partitionBy(*groups).orderBy("position")
    first = sources.groupBy(*groups).agg(F.min("position").alias("group_position"))
    order = [F.col("round"), F.col("group_position")]
    return (
        sources.withColumn("round", F.row_number().over(inside))
        .where(F.col("round") <= wanted)
        .join(first, groups)
        .orderBy(*order)
        .limit(wanted)
    )


def resolve_citation_ids(cited: DataFrame, references: DataFrame) -> DataFrame:
    """Citation labels to source ids; labels without one are kept; distinct in order.

    ``cited``: case_id, position, citation_id; ``references``: case_id,
    reference_id, source_id.
    """
    named = references.select("case_id", F.col("reference_id").alias("citation_id"), "source_id")
    resolved = cited.join(named, ["case_id", "citation_id"], "left").withColumn(
        "resolved", F.when(~tx.is_blank(F.col("source_id")), tx.strip(F.col("source_id"))).otherwise(F.col("citation_id"))
    )
    return resolved.groupBy("case_id", F.col("resolved").alias("source_id")).agg(
        F.min("position").alias("position")
    )


def classify_sources(expected: DataFrame, active: DataFrame, aliases: DataFrame) -> DataFrame:
    """Each expected id as exact, alias or missing.

    ``expected``: case_id, source_id; ``active``: source_id; ``aliases``:
    source_id, target_id.
    """
    ids = expected.select("case_id", tx.strip(F.col("source_id")).alias("source_id")).where(
        F.length("source_id") > 0
    ).distinct()
    held = active.select(tx.strip(F.col("source_id")).alias("source_id")).distinct()
    alias = (
        aliases.select(tx.strip(F.col("source_id")).alias("source_id"), tx.strip(F.col("target_id")).alias("target_id"))
        .join(held.withColumnRenamed("source_id", "target_id"), "target_id")
        .select("source_id")
        .distinct()
        .withColumn("via_alias", F.lit(True))
    )
    return (
        ids.join(held.withColumn("here", F.lit(True)), "source_id", "left")
        .join(alias, "source_id", "left")
        .select(
            "case_id",
            "source_id",
            F.when(F.col("here"), "exact").when(F.col("via_alias"), "alias").otherwise("missing").alias("alignment"),
        )
    )


def alignment_summary(alignment: DataFrame, active: DataFrame) -> DataFrame:
    kind = F.col("alignment")
    missing_cases = alignment.where(kind == "missing").select("case_id").distinct().agg(F.count("*"))
    return alignment.agg(
        F.count("*").alias("expected_source_count"),
        F.count_if(kind == "exact").alias("exact_source_count"),
        F.count_if(kind == "alias").alias("alias_source_count"),
        F.count_if(kind == "missing").alias("missing_source_count"),
    ).select(
        active.select("source_id").distinct().agg(F.count("*")).scalar().alias("active_source_count"),
        "*",
        missing_cases.scalar().alias("cases_with_missing_sources"),
        (F.col("missing_source_count") == 0).alias("all_expected_sources_present"),
    )


def coerce_results(raw: DataFrame) -> DataFrame:
    """Result rows with only known codes, counts, finite numbers and a recomputed flag.

    Numbers arrive as text, as they do from a report file.
    """
    count = lambda c: F.when(F.col(c).rlike(r"^\d{1,18}$"), F.col(c).try_cast("bigint"))
    finite = F.col("highest_rerank_score").try_cast("double")
    known = lambda c, codes: F.when(F.col(c).isin(*codes), F.col(c))
    refused = F.coalesce("refused", F.lit(False))
    answered = F.coalesce(F.col("answered"), ~refused)
    fallback = F.coalesce("router_fallback", F.lit(False))
    return raw.select(
        "case_id",
        answered.alias("answered"),
        refused.alias("refused"),
        "reason_code",
        tx.generation_available(answered, refused, F.col("reason_code")).alias("generation_available"),
        count("candidate_count").alias("candidate_count"),
        count("evidence_count").alias("evidence_count"),
        F.when(~F.isnan(finite) & (F.abs(finite) < float("inf")), finite).alias("highest_rerank_score"),
        known("retrieval_status", fixed.RETRIEVAL_STATUSES).alias("retrieval_status"),
        known("retrieval_reason_code", fixed.RETRIEVAL_REASONS).alias("retrieval_reason_code"),
        known("answer_failure_code", fixed.ANSWER_FAILURE_CODES).alias("answer_failure_code"),
        known("answer_failure_detail", fixed.ANSWER_FAILURE_DETAILS).alias("answer_failure_detail"),
        fallback.alias("router_fallback"),
        F.when(fallback & (F.col("router_failure_code") == "ROUTER_UNAVAILABLE"), "ROUTER_UNAVAILABLE").alias(
            "router_failure_code"
        ),
    )


# --- semantic judgements ------------------------------------------------------


def semantic_problem(point_count: Column) -> Column:
    """The first broken rule of a judged row, or NULL.

    Columns: judge_status, verdicts (array of struct<index, status>),
    unsupported_claims_present, evidence_supports_answer.
    """
    indexes = F.transform("verdicts", lambda v: v["index"])
    passed = F.col("judge_status") == "passed"
    return (
        F.when(~F.col("judge_status").isin(*fixed.JUDGE_STATUSES), "JUDGE_STATUS")
        .when(F.exists("verdicts", lambda v: ~v["status"].isin(*fixed.POINT_STATUSES)), "POINT_STATUS")
        .when(~passed & (F.size("verdicts") > 0), "POINTS_WITHOUT_JUDGEMENT")
        .when(
            passed
            & (
                (F.size("verdicts") == 0)
                | F.col("unsupported_claims_present").isNull()
                | F.col("evidence_supports_answer").isNull()
            ),
            "INCOMPLETE",
        )
        .when(passed & (F.array_sort(indexes) != F.sequence(F.lit(1), F.greatest(point_count, F.lit(1)))), "POINT_INDEXES")
    )


def semantic_summary(judged: DataFrame) -> DataFrame:
    """Totals of valid rows: judged, unavailable, not applicable, grounded."""
    valid = judged.withColumn("problem", semantic_problem(F.col("point_count")))
    good, status = F.col("problem").isNull(), F.col("judge_status")
    covered = (F.size("verdicts") > 0) & F.forall("verdicts", lambda v: v["status"] == "covered")
    grounded = (status == "passed") & covered & ~F.col("unsupported_claims_present") & F.col("citation_valid")
    return valid.agg(
        F.count("*").alias("total"),
        _count(~good).alias("invalid_total"),
        _count(good & (status == "passed")).alias("judged_total"),
        _count(good & (status == "semantic_judge_unavailable")).alias("semantic_judge_unavailable_total"),
        _count(good & (status == "not_applicable")).alias("not_applicable_total"),
        _count(good & grounded).alias("semantic_grounded_success_total"),
    )
