"""Evaluation queries: metrics, reports, arms, sets, contracts."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom import fixed
from citeloom.catalogue import query, shared
from citeloom.catalogue.sqlbase import fold, sql
from citeloom.catalogue.tidy import tidy
from citeloom.functions import metrics as mx
from citeloom.functions import text as tx
from citeloom.operators import arms, contracts, evaluation, lexical, workflow
from citeloom.plans import assess
from citeloom.sources import tables as t


def expected(spark, folder):
    return shared.expected(spark, folder)


def cases(spark, folder):
    held = expected(spark, folder).select("case_id").distinct().withColumn("held", F.lit(True))
    kinds = F.array(*[F.lit(k) for k in fixed.QUESTION_TYPES[:5]])
    base = t.questions(spark, folder).select(F.col("query_id").alias("case_id"), "item_id", "question")
    return base.join(held, "case_id", "left").select(
        "case_id",
        "item_id",
        "question",
        F.col("held").isNull().alias("no_answer"),
        F.when(F.col("held").isNull(), "no_answer")
        .otherwise(F.element_at(kinds, (F.col("item_id") % 5 + 1).cast("int")))
        .alias("type"),
    )


def ids(rows, rank="rank"):
    """Ranked version ids of (case, arm) rows."""
    return rows.select("case_id", "arm", F.col(rank).alias("rank"), F.col("version_id").alias("source_id"))


def hybrid(spark, folder):
    """(candidates, evidence) of the hybrid arm as ranked ids."""
    candidates, shown, _drops, _facts = shared.arms(spark, folder)
    only = F.col("arm") == "hybrid"
    return ids(candidates.where(only)).drop("arm"), ids(shown.where(only), "rerank_rank").drop("arm")


def arm_facts(spark, folder):
    candidates, shown, _drops, _facts = shared.arms(spark, folder)
    facts = evaluation.case_facts(
        arms.expand_arms(cases(spark, folder)),
        expected(spark, folder),
        ids(candidates),
        ids(shown, "rerank_rank"),
        ["case_id", "arm"],
    )
    answered = F.col("evidence_n") > 0
    noise = assess.duplicate_noise(candidates)
    return (
        facts.withColumns({"answered": answered, "refused": ~answered})
        .join(noise, ["case_id", "arm"], "left")
        .fillna(0, ["duplicate_noise"])
    )


def outcomes(spark, folder):
    """Answer facts of each case, from its hybrid evidence and its number."""
    facts = arm_facts(spark, folder).where("arm = 'hybrid'")
    n = F.col("item_id")
    answered = F.col("answered") & (n % 11 != 3)
    return facts.select(
        "case_id",
        answered.alias("answered"),
        (~answered & (n % 7 != 2)).alias("refused"),
        (answered & (F.col("hits_6") > 0)).alias("covered"),
        (answered & (n % 4 != 1)).alias("citation_valid"),
        (answered & (n % 5 != 4)).alias("visible"),
    )


_OUT = """SELECT case_id, item_id, no_answer, type, expected_n, hits_20, hits_6, evidence_n, rr, ndcg_6, candidates_n,
   answered AND item_id % 11 <> 3 AS answered, NOT (answered AND item_id % 11 <> 3) AND item_id % 7 <> 2 AS refused,
   answered AND item_id % 11 <> 3 AND hits_6 > 0 AS covered, answered AND item_id % 11 <> 3 AND item_id % 4 <> 1 AS citation_valid,
   answered AND item_id % 11 <> 3 AND item_id % 5 <> 4 AS visible FROM arm_facts WHERE arm = 'hybrid'"""
_WILSON = """round(CASE WHEN d > 0 THEN n / d ELSE 0 END, 6) AS value,
  CASE WHEN iv THEN round(CASE WHEN d > 0 THEN greatest(0, (n / d + 3.8414588206941227 / (2 * d) - 1.959963984540054 * sqrt((n / d * (1 - n / d) + 3.8414588206941227 / (4 * d)) / d)) / (1 + 3.8414588206941227 / d)) ELSE 0 END, 6) END AS ci95_low,
  CASE WHEN iv THEN round(CASE WHEN d > 0 THEN least(1, (n / d + 3.8414588206941227 / (2 * d) + 1.959963984540054 * sqrt((n / d * (1 - n / d) + 3.8414588206941227 / (4 * d)) / d)) / (1 + 3.8414588206941227 / d)) ELSE 0 END, 6) END AS ci95_high"""
_SUMS = """count(*) AS cases, count(*) FILTER (NOT no_answer) AS answerable, count(*) FILTER (no_answer) AS no_answers, coalesce(sum(hits_20) FILTER (NOT no_answer), 0) AS h20,
  coalesce(sum(hits_6) FILTER (NOT no_answer), 0) AS h6, coalesce(sum(expected_n) FILTER (NOT no_answer), 0) AS ex, coalesce(sum(evidence_n) FILTER (NOT no_answer), 0) AS shown,
  coalesce(sum(rr) FILTER (NOT no_answer), 0) AS rr, coalesce(sum(ndcg_6) FILTER (NOT no_answer), 0) AS nd, count(*) FILTER (NOT no_answer AND expected_n > 0) AS ndc,
  count(*) FILTER (no_answer AND evidence_n > 0) AS neg"""
_RETRIEVAL = [
    ("recall_at_20", "h20", "ex", "true"),
    ("recall_at_6", "h6", "ex", "true"),
    ("precision_at_6", "h6", "shown", "true"),
    ("mrr_at_20", "rr", "answerable", "false"),
    ("ndcg_at_6", "nd", "ndc", "false"),
    ("negative_evidence_rate", "neg", "no_answers", "true"),
]


def _lines(keys: str, source: str, lines) -> str:
    parts = [
        f"SELECT {keys}'{m}' AS metric, ({n})::DOUBLE AS n, ({d})::BIGINT AS d, {iv} AS iv FROM {source}" for m, n, d, iv in lines
    ]
    return f"SELECT {keys}metric, round(n, 6) AS numerator, d AS denominator, {_WILSON} FROM ({' UNION ALL '.join(parts)})"


# --- single metrics -----------------------------------------------------------------

_HYB = "FROM arm_facts WHERE arm = 'hybrid'"


@query(
    "agg5_recall_precision",
    sql(
        f"""SELECT case_id, round(CASE WHEN expected_n > 0 THEN hits_6 / expected_n ELSE 0 END, 6) AS recall, round(CASE WHEN evidence_n > 0 THEN hits_6 / evidence_n ELSE 0 END, 6) AS precision {_HYB}""",
        "arm_facts",
    ),
)
def _(spark, folder):
    _c, shown = hybrid(spark, folder)
    return tidy(evaluation.recall_precision(cases(spark, folder), expected(spark, folder), shown, 6))


@query(
    "agg6_reciprocal_rank",
    sql(f"SELECT case_id, round(rr, 6) AS reciprocal_rank {_HYB}", "arm_facts"),
)
def _(spark, folder):
    found, _e = hybrid(spark, folder)
    return tidy(evaluation.reciprocal_ranks(cases(spark, folder), expected(spark, folder), found, 20))


@query(
    "agg7_graded_ndcg",
    """
  WITH s AS (SELECT q.vec_id AS q, c.vec_id AS c, round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[]))), 9) AS score FROM embeddings q, embeddings c),
       r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank FROM s QUALIFY rank <= 10),
       j AS (SELECT q.vec_id AS q, c.vec_id AS c, 1 + c.vec_id % 3 AS rel FROM embeddings q JOIN embeddings c ON q.label = c.label),
       i AS (SELECT q, sum((2 ** rel - 1) / log2(place + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY rel DESC) AS place FROM j QUALIFY place <= 10) GROUP BY q),
       d AS (SELECT q, sum((2 ** rel - 1) / log2(rank + 1)) AS dcg FROM r JOIN j USING (q, c) GROUP BY q)
  SELECT 'e' || q AS case_id, round(coalesce(dcg, 0) / idcg, 6) AS ndcg FROM i LEFT JOIN d USING (q)""",
)
def _(spark, folder):
    """Neighbours of each vector, graded by label and number."""
    from citeloom.operators import vectors

    queries, points = t.vector_queries(spark, folder), t.vector_points(spark, folder)
    n = t.load(spark, folder, "embeddings").count()
    ranked = vectors.vector_hits(queries, points, n_queries=n, k=10).select(
        F.col("query_id").alias("case_id"), "rank", F.col("chunk_id").alias("source_id")
    )
    # Judgements are by label: a point is relevant to every query of its label.
    asked = queries.select(F.col("query_id").alias("case_id"), F.col("label").alias("topic"))
    grades = points.select(
        F.col("label").alias("topic"), F.col("chunk_id").alias("source_id"), (F.col("vec_id") % 3 + 1).alias("relevance")
    )
    return tidy(evaluation.graded_ndcg(asked, grades, ranked, 10))


@query(
    "agg8_wilson_rates",
    f"""SELECT source, lang, n::BIGINT AS numerator, d AS denominator, {_WILSON} FROM (
      SELECT source, lang, count(*) FILTER (quality = 1) AS n, count(*) AS d, true AS iv FROM documents JOIN labels USING (doc_id) GROUP BY ALL)""",
)
def _(spark, folder):
    """Rate of good quality among labelled documents, by source and language."""
    rows = t.load(spark, folder, "documents").select("doc_id", "source", "lang").join(
        t.load(spark, folder, "labels"), "doc_id"
    )
    counted = rows.groupBy("source", "lang").agg(
        F.count_if(F.col("quality") == 1).alias("numerator"), F.count("*").alias("denominator")
    )
    r = mx.rate(F.col("numerator"), F.col("denominator"))
    return tidy(counted.select("source", "lang", "numerator", "denominator", r["value"].alias("value"), r["ci95_low"].alias("ci95_low"), r["ci95_high"].alias("ci95_high")))


# --- reports ----------------------------------------------------------------------------

_CITED = """SELECT e.case_id, count(*) AS cited_n, count(x.source_id) AS cited_hits FROM (SELECT DISTINCT case_id, source_id FROM arm_evidence_ids WHERE arm = 'hybrid' AND rank <= 2) e
  LEFT JOIN expected x ON x.query_id = e.case_id AND x.source_id = e.source_id GROUP BY 1"""


@query(
    "agg9_industry_report",
    sql(
        _lines(
            "",
            "s",
            [
                *_RETRIEVAL,
                ("answer_availability", "answered_n", "cases", "true"),
                ("grounded_answer_success", "grounded_n", "answerable", "true"),
                ("answerable_over_refusal", "over_n", "answerable", "true"),
                ("citation_precision", "ch", "cn", "true"),
                ("citation_recall", "ch", "ex", "true"),
                ("unsafe_answer_rate", "(SELECT count(*) FROM labels WHERE toxic = 1)", "(SELECT count(*) FROM labels)", "true"),
                ("runtime_citation_visibility", "visible_n", "answered_n", "true"),
                ("no_answer_refusal", "right_n", "no_answers", "true"),
            ],
        ),
        "arm_facts",
        extra={
            "o": _OUT,
            "k": _CITED,
            "s": f"""SELECT {_SUMS}, count(*) FILTER (answered) AS answered_n, count(*) FILTER (NOT no_answer AND answered AND covered AND citation_valid) AS grounded_n,
              count(*) FILTER (NOT no_answer AND refused) AS over_n, coalesce(sum(cited_hits) FILTER (NOT no_answer), 0) AS ch, coalesce(sum(cited_n) FILTER (NOT no_answer), 0) AS cn,
              count(*) FILTER (answered AND visible) AS visible_n, count(*) FILTER (no_answer AND refused) AS right_n FROM o LEFT JOIN k USING (case_id)""",
        },
    ),
)
def _(spark, folder):
    facts = arm_facts(spark, folder).where("arm = 'hybrid'").drop("answered", "refused")
    _c, shown = hybrid(spark, folder)
    cited = evaluation.distinct_ranks(shown, ["case_id"]).where("rank <= 2")
    reviews = t.load(spark, folder, "labels").select(
        F.col("doc_id").alias("case_id"), (F.col("toxic") == 1).alias("unsafe")
    )
    report = evaluation.industry_report(
        facts, outcomes(spark, folder), cited, expected(spark, folder), reviews
    )
    return tidy(report)


@query(
    "agg10_acceptance_report",
    sql(
        """SELECT count(*) AS total, count(*) FILTER (answered) AS answered_total, round(count(*) FILTER (citation_valid) / count(*), 6) AS citation_accuracy,
      round(CASE WHEN count(*) FILTER (answered) > 0 THEN count(*) FILTER (answered AND covered) / count(*) FILTER (answered) ELSE 0 END, 6) AS grounded_accuracy,
      round(CASE WHEN count(*) FILTER (no_answer) > 0 THEN count(*) FILTER (no_answer AND refused) / count(*) FILTER (no_answer) ELSE 0 END, 6) AS no_answer_refusal_rate,
      round(count(*) FILTER (answered) / count(*), 6) AS answer_availability_rate,
      round(CASE WHEN count(*) FILTER (answered) > 0 THEN count(*) FILTER (answered AND visible) / count(*) FILTER (answered) ELSE 0 END, 6) AS runtime_citation_visibility_rate,
      round(avg(CASE WHEN item_id % 6 <> 1 THEN 10 + item_id % 13 END), 6) AS first_status_latency_ms, round(avg(500e0 + item_id % 37), 6) AS answer_duration_ms FROM o""",
        "arm_facts",
        extra={"o": _OUT},
    ),
)
def _(spark, folder):
    n = F.col("item_id")
    known = cases(spark, folder).select("case_id", "no_answer", "item_id")
    results = outcomes(spark, folder).join(known, "case_id").withColumns(
        {
            "first_status_latency_ms": F.when(n % 6 != 1, (10 + n % 13).cast("double")),
            "answer_duration_ms": (500 + n % 37).cast("double"),
        }
    )
    return tidy(evaluation.acceptance_report(results))


_TYPES = "SELECT unnest(['fact', 'procedure', 'condition', 'prohibition', 'synthesis', 'no_answer']) AS type"


@query(
    "agg11_outcome_by_type",
    sql(
        _lines(
            "type, ",
            "s",
            [
                ("answer_availability", "answered_n", "cases", "true"),
                ("answerable_over_refusal", "over_n", "answerable", "true"),
                ("grounded_answer_success", "grounded_n", "answerable", "true"),
                *_RETRIEVAL,
                ("no_answer_refusal", "right_n", "no_answers", "true"),
            ],
        ),
        "arm_facts",
        extra={
            "o": _OUT,
            "kinds": _TYPES,
            "g": f"""SELECT type, {_SUMS}, count(*) FILTER (answered) AS answered_n, count(*) FILTER (NOT no_answer AND answered AND covered AND citation_valid) AS grounded_n,
              count(*) FILTER (NOT no_answer AND refused) AS over_n, count(*) FILTER (no_answer AND refused) AS right_n FROM o GROUP BY type""",
            "s": "SELECT type, "
            + ", ".join(
                f"coalesce({c}, 0) AS {c}"
                for c in "cases answerable no_answers h20 h6 ex shown rr nd ndc neg answered_n grounded_n over_n right_n".split()
            )
            + " FROM kinds LEFT JOIN g USING (type)",
        },
    ),
)
def _(spark, folder):
    facts = arm_facts(spark, folder).where("arm = 'hybrid'").drop("answered", "refused")
    return tidy(evaluation.outcome_by_type(facts, outcomes(spark, folder)))


_DIAG = {
    "dk": f"SELECT DISTINCT version_id, chunk_id, unnest(regexp_extract_all({fold('text')}, '[a-z0-9]+')) AS token FROM active_chunks",
    "dq": f"SELECT DISTINCT query_id, unnest(regexp_extract_all({fold('question')}, '[a-z0-9]+')) AS token FROM questions",
    "dn": "SELECT count(DISTINCT (version_id, chunk_id)) AS n FROM dk",
    "ddf": "SELECT token, count(*) AS df FROM dk GROUP BY 1",
    "dh": """SELECT query_id AS case_id, version_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, version_id, chunk_id) AS rank FROM (
      SELECT query_id, version_id, chunk_id, round(sum(ln((n + 1) / (df + 1)) + 1), 9) AS score FROM dq JOIN dk USING (token) JOIN ddf USING (token), dn GROUP BY ALL) QUALIFY rank <= 20""",
    "da": "SELECT case_id, source_id, row_number() OVER (PARTITION BY case_id ORDER BY f, source_id) AS rank FROM (SELECT case_id, version_id AS source_id, min(rank) AS f FROM dh GROUP BY ALL)",
    "de": "SELECT case_id, source_id, row_number() OVER (PARTITION BY case_id ORDER BY f, source_id) AS rank FROM (SELECT case_id, version_id AS source_id, min(rank) AS f FROM dh WHERE rank <= 6 GROUP BY ALL)",
    "dx": "SELECT query_id AS case_id, count(*) AS expected_n FROM expected GROUP BY 1",
    "df1": "SELECT a.case_id, count(x.source_id) AS hits_20, min(CASE WHEN x.source_id IS NOT NULL THEN rank END) AS fh FROM da a LEFT JOIN expected x ON x.query_id = a.case_id AND x.source_id = a.source_id GROUP BY 1",
    "df2": "SELECT a.case_id, count(*) AS evidence_n, count(x.source_id) AS hits_6, coalesce(sum(CASE WHEN x.source_id IS NOT NULL THEN 1 / log2(rank + 1) END), 0) AS dcg FROM de a LEFT JOIN expected x ON x.query_id = a.case_id AND x.source_id = a.source_id GROUP BY 1",
    "di": "SELECT case_id, sum(1 / log2(i + 1)) AS idcg FROM dx, range(1, 7) r(i) WHERE i <= expected_n GROUP BY 1",
    "do0": """SELECT c.case_id, type, no_answer, coalesce(expected_n, 0) AS expected_n, coalesce(hits_20, 0) AS hits_20, coalesce(hits_6, 0) AS hits_6, coalesce(evidence_n, 0) AS evidence_n, coalesce(1 / fh, 0) AS rr,
      CASE WHEN expected_n > 0 THEN coalesce(dcg, 0) / idcg END AS ndcg_6 FROM cases c LEFT JOIN dx USING (case_id) LEFT JOIN df1 USING (case_id) LEFT JOIN df2 USING (case_id) LEFT JOIN di USING (case_id)""",
    "kinds": _TYPES + " UNION ALL SELECT 'overall'",
    "g": f"SELECT type, {_SUMS} FROM do0 GROUP BY type UNION ALL SELECT 'overall', {_SUMS} FROM do0",
    "s": "SELECT type, "
    + ", ".join(f"coalesce({c}, 0) AS {c}" for c in "cases answerable no_answers h20 h6 ex shown rr nd ndc neg".split())
    + " FROM kinds LEFT JOIN g USING (type)",
}


@query(
    "agg12_lexical_by_type",
    sql(_lines("type, ", "s", _RETRIEVAL), "cases", "active_chunks", extra=_DIAG),
)
def _(spark, folder):
    hits = lexical.diagnostic_hits(
        t.questions(spark, folder), shared.diagnostic_index(spark, folder), n_queries=shared.question_count(spark, folder)
    ).select(F.col("query_id").alias("case_id"), "rank", F.col("version_id").alias("source_id"))
    facts = evaluation.case_facts(cases(spark, folder), expected(spark, folder), hits, hits.where("rank <= 6"))
    return tidy(evaluation.lexical_by_type(facts))


# --- arms ----------------------------------------------------------------------------------


@query(
    "jn16_arm_expansion",
    """SELECT 'q' || item_id AS case_id, arm, strategy AS retrieval_strategy, dedup AS post_fusion_dedup FROM benchmark,
     (VALUES ('vector', 'vector', true), ('lexical', 'lexical', true), ('hybrid', 'hybrid', true), ('hybrid_audit', 'hybrid', false)) a(arm, strategy, dedup)""",
)
def _(spark, folder):
    return arms.expand_arms(t.questions(spark, folder).select(F.col("query_id").alias("case_id")))


_ARM_LINES = [
    ("recall_at_20", "h20", "ex"),
    ("recall_at_6", "h6", "ex"),
    ("precision_at_6", "h6", "shown"),
    ("mrr_at_20", "round(rr, 6)", "answerable"),
    ("ndcg_at_6", "round(nd, 6)", "answerable"),
    ("availability", "av", "answerable"),
    ("grounded_success", "gr", "answerable"),
    ("candidate_contamination", "dc", "no_answers"),
    ("evidence_contamination", "neg", "no_answers"),
    ("correct_refusal", "cr", "no_answers"),
]


@query(
    "agg13_arm_report",
    sql(
        "SELECT arm, metric, round(n, 6) AS numerator, d AS denominator, round(CASE WHEN d > 0 THEN n / d ELSE 0 END, 6) AS rate FROM ("
        + " UNION ALL ".join(f"SELECT arm, '{m}' AS metric, ({n})::DOUBLE AS n, ({d})::BIGINT AS d FROM s" for m, n, d in _ARM_LINES)
        + ")",
        "arm_facts",
        extra={
            "s": f"""SELECT arm, {_SUMS}, count(*) FILTER (NOT no_answer AND answered) AS av, count(*) FILTER (NOT no_answer AND answered AND hits_6 > 0) AS gr,
              count(*) FILTER (no_answer AND candidates_n > 0) AS dc, count(*) FILTER (no_answer AND NOT answered) AS cr FROM arm_facts GROUP BY arm"""
        },
    ),
)
def _(spark, folder):
    return tidy(arms.arm_report(arm_facts(spark, folder)))


@query(
    "agg14_fusion_report",
    sql(
        """
  WITH j AS (SELECT f.*, EXISTS (SELECT 1 FROM expected x WHERE x.query_id = f.query_id AND x.source_id = f.version_id) AS hit, fused_rank - least(vector_rank, lexical_rank) AS moved
             FROM fused f JOIN cases c ON c.case_id = f.query_id WHERE NOT no_answer)
  SELECT count(*) FILTER (membership = 'shared') AS shared, count(*) FILTER (membership = 'vector_only') AS vector_only, count(*) FILTER (membership = 'lexical_only') AS lexical_only,
         count(*) FILTER (hit AND fused_rank <= 20) AS relevant_survived, count(*) FILTER (hit) AS displacement_count, round(coalesce(avg(moved) FILTER (hit), 0), 6) AS displacement_mean,
         count(*) FILTER (hit AND fused_rank > 20) AS relevant_facts_past_top20, (SELECT count(*) FROM expected) AS relevant_total FROM j""",
        "fused",
        "cases",
    ),
)
def _(spark, folder):
    facts = shared.arms(spark, folder)[3].select(
        F.col("query_id").alias("case_id"),
        "candidate_id",
        F.col("version_id").alias("source_id"),
        "membership",
        "vector_rank",
        "lexical_rank",
        "fused_rank",
    )
    return tidy(arms.fusion_report(cases(spark, folder), expected(spark, folder), facts))


_DROPS = {
    "relevant": "SELECT query_id AS case_id, source_id AS version_id FROM expected",
    "merges": """SELECT query_id AS case_id, version_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id, branch, content_hash ORDER BY rank) AS nth FROM branch_hits) WHERE nth > 1""",
    "drops": """SELECT arm, case_id, version_id, reason, 'post_rrf' AS stage FROM arm_decisions WHERE reason IS NOT NULL
      UNION ALL SELECT a.arm, case_id, version_id, 'rrf_content_hash_merge', 'rrf' FROM merges, (VALUES ('hybrid'), ('hybrid_audit')) a(arm)
      UNION ALL SELECT a.arm, query_id, version_id, 'top20_truncation', 'rrf' FROM fused, (VALUES ('hybrid'), ('hybrid_audit')) a(arm) WHERE fused_rank > 20""",
    "judged": "SELECT d.*, r.version_id IS NOT NULL AS hit FROM drops d LEFT JOIN relevant r USING (case_id, version_id)",
}


def judged_drops(spark, folder):
    relevant = expected(spark, folder).select("case_id", F.col("source_id").alias("version_id"), F.lit(True).alias("hit"))
    drops = shared.arms(spark, folder)[2]
    return drops.join(relevant, ["case_id", "version_id"], "left").withColumn("relevant", F.coalesce("hit", F.lit(False)))


@query(
    "agg15_drop_counts",
    sql(
        "SELECT arm, "
        + ", ".join(f"count(*) FILTER (reason = '{r}') AS {r}" for r in fixed.DROP_REASONS)
        + ", count(*) FILTER (hit) AS relevant_drops, arm = 'hybrid' AS is_headline FROM (VALUES ('vector'), ('lexical'), ('hybrid'), ('hybrid_audit')) a(arm) LEFT JOIN judged USING (arm) GROUP BY arm",
        "arm_decisions",
        "fused",
        "expected",
        extra=_DROPS,
    ),
)
def _(spark, folder):
    return tidy(arms.drop_counts(judged_drops(spark, folder)))


_SIGNALS = {
    **_DROPS,
    "fd": "SELECT DISTINCT case_id FROM judged WHERE arm = 'hybrid' AND stage = 'post_rrf' AND reason IN ('exact_duplicate', 'near_duplicate', 'heading_cap') AND hit",
    "noise": "SELECT case_id, count(*) - count(DISTINCT content_hash) AS noise FROM arm_candidates WHERE arm = 'hybrid_audit' GROUP BY 1",
    "pc": """SELECT case_id, no_answer, bool_or(hits_20 > 0) FILTER (arm = 'vector') AS v, bool_or(hits_20 > 0) FILTER (arm = 'lexical') AS l, bool_or(hits_20 > 0) FILTER (arm = 'hybrid') AS h, bool_or(hits_20 > 0) FILTER (arm = 'hybrid_audit') AS a,
      sum(candidates_n) FILTER (arm = 'vector') AS vc, sum(candidates_n) FILTER (arm = 'lexical') AS lc, sum(candidates_n) FILTER (arm = 'hybrid') AS hc, sum(candidates_n) FILTER (arm = 'hybrid_audit') AS ac,
      sum(evidence_n) FILTER (arm = 'hybrid') AS he, sum(evidence_n) FILTER (arm = 'hybrid_audit') AS ae FROM arm_facts GROUP BY ALL""",
    "sg": """SELECT pc.case_id, NOT no_answer AND NOT v AND (l OR h) AS vector_recall_missing, no_answer AND lc > 0 AND vc = 0 AS lexical_contamination, NOT no_answer AND v AND l AND NOT h AS rrf_rank_displacement,
      NOT no_answer AND fd.case_id IS NOT NULL AND a AND NOT h AS dedup_false_drop, NOT no_answer AND coalesce(noise, 0) > 0 AND NOT a AND (NOT h OR ae = 0) AS duplicate_noise
      FROM pc LEFT JOIN fd USING (case_id) LEFT JOIN noise USING (case_id)""",
}


@query(
    "agg16_dedup_comparison",
    sql(
        """SELECT (sum(hc) - sum(ac))::BIGINT AS candidate_count_delta, (sum(he) - sum(ae))::BIGINT AS evidence_count_delta, (SELECT coalesce(sum(noise), 0)::BIGINT FROM noise) AS duplicate_noise_count,
       (SELECT count(*) FROM sg WHERE dedup_false_drop) AS false_drop_case_count FROM pc""",
        "arm_facts",
        "arm_decisions",
        "fused",
        extra=_SIGNALS,
    ),
)
def _(spark, folder):
    return tidy(arms.dedup_comparison(arm_facts(spark, folder), judged_drops(spark, folder)))


@query(
    "agg17_case_signals",
    sql("SELECT * FROM sg", "arm_facts", "arm_decisions", "fused", extra=_SIGNALS),
)
def _(spark, folder):
    return arms.case_signals(arm_facts(spark, folder), judged_drops(spark, folder))


@query(
    "agg17_root_causes",
    sql(
        "SELECT code, CASE WHEN n >= 2 THEN 'high' ELSE 'medium' END AS confidence, n AS supporting_case_count, 'investigate_in_separate_tuning_task' AS decision FROM ("
        + " UNION ALL ".join(f"SELECT '{c}' AS code, count(*) FILTER ({c}) AS n FROM sg" for c in fixed.ROOT_CAUSES)
        + ") WHERE n > 0 UNION ALL SELECT 'cannot_attribute', 'low', 0, 'keep_baseline_and_collect_more_diagnostics' FROM sg HAVING count(*) FILTER ("
        + " OR ".join(fixed.ROOT_CAUSES)
        + ") = 0",
        "arm_facts",
        "arm_decisions",
        "fused",
        extra=_SIGNALS,
    ),
)
def _(spark, folder):
    return tidy(arms.root_causes(arms.case_signals(arm_facts(spark, folder), judged_drops(spark, folder))))


_CHECKSUM = "sha256(count(*) || ':' || sum(('0x' || substr(h, 1, 8))::BIGINT)::HUGEINT || ':' || sum(('0x' || substr(h, 9, 8))::BIGINT)::HUGEINT)"


@query(
    "jn17_run_identity",
    sql(
        f"""
  WITH c AS (SELECT case_id, sha256(case_id || chr(10) || question) AS h FROM cases),
       k AS (SELECT sha256(version_id || chr(10) || chunk_id || chr(10) || content_hash) AS h FROM active_chunks),
       d AS (SELECT h FROM c WHERE case_id NOT IN (SELECT 'q' || item_id FROM benchmark WHERE item_id % 7 = 0)),
       o AS (SELECT 'benchmark' AS set_id, (SELECT count(*) FROM c) AS case_count, (SELECT {_CHECKSUM} FROM c) AS set_checksum, (SELECT {_CHECKSUM} FROM k) AS snapshot_hash),
       f AS (SELECT 'unchanged' AS run, * FROM o UNION ALL SELECT 'other set', 'holdout', case_count, set_checksum, snapshot_hash FROM o
             UNION ALL SELECT 'fewer cases', set_id, (SELECT count(*) FROM d), (SELECT {_CHECKSUM} FROM d), snapshot_hash FROM o
             UNION ALL SELECT 'no chunks', set_id, case_count, set_checksum, sha256('0') FROM o)
  SELECT f.run, o.*, concat_ws(',', CASE WHEN f.set_id <> o.set_id THEN 'set_id' END, CASE WHEN f.case_count <> o.case_count THEN 'case_count' END,
         CASE WHEN f.set_checksum <> o.set_checksum THEN 'set_checksum' END, CASE WHEN f.snapshot_hash <> o.snapshot_hash THEN 'snapshot_hash' END) AS mismatches,
         f = row(f.run, o.set_id, o.case_count, o.set_checksum, o.snapshot_hash) AS matches FROM f, o""",
        "cases",
        "active_chunks",
    ),
)
def _(spark, folder):
    """The run against fingerprints frozen from the same inputs, another set, fewer cases and no chunks."""
    asked, chunks = cases(spark, folder), t.active_chunks(spark, folder)
    left_out = t.load(spark, folder, "benchmark").where("item_id % 7 = 0").select(F.concat(F.lit("q"), "item_id").alias("case_id"))
    fewer = asked.join(left_out, "case_id", "left_anti")
    actual = shared.kept(arms.run_identity(asked, chunks, "benchmark"), "run-identity")
    frozen = {
        "unchanged": actual,
        "other set": actual.withColumn("set_id", F.lit("holdout")),
        "fewer cases": arms.run_identity(fewer, chunks, "benchmark"),
        "no chunks": actual.withColumn("snapshot_hash", F.sha2(F.lit("0"), 256)),
    }
    rows = [df.withColumn("run", F.lit(run)) for run, df in frozen.items()]
    return tidy(arms.identity_matches(actual, reduce(DataFrame.unionByName, rows)))


# --- evaluation sets -------------------------------------------------------------------------


def _set(spark, folder):
    """Turns as generated evaluation cases, good and bad ones."""
    n = F.col("conv_id") * 10 + F.col("turn")
    kinds = F.array(*[F.lit(k) for k in ("fact", " Procedure ", "条件", "no-answer", "流程", "synthesis", "other")])
    return t.load(spark, folder, "conversations").where("role = 'user'").select(
        n.alias("case_no"),
        F.concat(F.lit("  "), "text").alias("question"),
        F.split("text", r"\.").alias("reference_points"),
        F.array(F.concat(F.lit("v"), n % 500), F.concat(F.lit("v"), F.col("conv_id"))).alias("source_ids"),
        F.element_at(kinds, (n % 7 + 1).cast("int")).alias("type"),
    )


@query(
    "flt8_filtered_cases",
    rf"""
  WITH c AS (SELECT conv_id * 10 + turn AS n, conv_id, '  ' || text AS q, string_split(text, '.') AS points FROM conversations WHERE role = 'user'),
       k AS (SELECT * FROM c WHERE trim(q) <> '' AND n % 500 < (SELECT count(*) FROM documents) AND conv_id < (SELECT count(*) FROM documents)),
       f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY {fold(r"trim(regexp_replace(q, '\s+', ' ', 'g'))")} ORDER BY n) = 1),
       p AS (SELECT n, conv_id, trim(q, ' ' || chr(10)) AS q, list_filter(list_transform(points, lambda x: trim(x, ' ' || chr(10))), lambda x: x <> '') AS points,
                    ['fact', 'procedure', NULL, 'no_answer', 'procedure', 'synthesis', NULL][n % 7 + 1] AS type FROM f)
  SELECT n AS case_no, q AS question, array_to_string(points, '|') AS reference_points, CASE WHEN n % 500 = conv_id THEN 'v' || conv_id ELSE 'v' || (n % 500) || '|v' || conv_id END AS source_ids, type
  FROM p WHERE type IS NOT NULL AND len(points) > 0 ORDER BY n LIMIT 200""",
)
def _(spark, folder):
    known = t.load(spark, folder, "documents").select(F.concat(F.lit("v"), "doc_id").alias("source_id"))
    return tidy(evaluation.filter_cases(_set(spark, folder), known, 200))


@query(
    "fn12_type_aliases",
    """SELECT conv_id * 10 + turn AS case_no, ['fact', 'procedure', NULL, 'no_answer', 'procedure', 'synthesis', NULL][(conv_id * 10 + turn) % 7 + 1] AS type FROM conversations WHERE role = 'user'""",
)
def _(spark, folder):
    rows = _set(spark, folder)
    return rows.select("case_no", tx.mapped(tx.casefold(tx.strip(F.col("type"))), fixed.QUESTION_TYPE_ALIASES).alias("type"))


@query(
    "agg28_type_quota",
    sql(
        f"SELECT type, count(c.case_id) AS cases, 5::BIGINT AS required, count(c.case_id) = 5 AS met FROM ({_TYPES}) t LEFT JOIN cases c USING (type) GROUP BY type",
        "cases",
    ),
)
def _(spark, folder):
    return tidy(evaluation.type_quota(cases(spark, folder), 30))


def _items(spark, folder):
    n = F.col("doc_id")
    docs = t.load(spark, folder, "documents")
    some = lambda k, c: F.when(n % k != 0, F.concat(F.lit(c), n))
    return docs.select(
        n.alias("position"),
        some(3, " s").alias("source_id"),
        F.when(n % 2 == 0, F.concat(F.lit("r"), n)).otherwise("").alias("reference_id"),
        some(5, "c").alias("chunk_id"),
        F.when(n % 50 == 7, "  ").otherwise(F.col("text")).alias("text"),
        "source",
        "lang",
    ).select(
        "position",
        "source_id",
        "reference_id",
        "chunk_id",
        "text",
        F.col("source").alias("file_name"),
        F.array("lang", F.lit(" ")).alias("heading_path"),
    )


_ITEMS = {
    "it": """SELECT doc_id AS position, CASE WHEN doc_id % 3 <> 0 THEN 's' || doc_id WHEN doc_id % 2 = 0 THEN 'r' || doc_id WHEN doc_id % 5 <> 0 THEN 'c' || doc_id ELSE 'S' || doc_id END AS source_id,
      list_sort(list_filter([CASE WHEN doc_id % 2 = 0 THEN 'r' || doc_id END, CASE WHEN doc_id % 5 <> 0 THEN 'c' || doc_id END], lambda x: x IS NOT NULL)) AS aliases, source AS file_name, lang
      FROM documents WHERE doc_id % 50 <> 7 AND trim(text) <> ''"""
}


@query(
    "prj8_normalised_sources",
    sql("SELECT position, source_id, array_to_string(aliases, '|') AS aliases, file_name, lang AS heading_path FROM it", extra=_ITEMS),
)
def _(spark, folder):
    rows = evaluation.normalise_sources(_items(spark, folder))
    return tidy(rows, "position", "source_id", "aliases", "file_name", "heading_path")


@query(
    "prj8_known_ids",
    sql("SELECT source_id FROM it UNION SELECT unnest(aliases) FROM it", extra=_ITEMS),
)
def _(spark, folder):
    return evaluation.known_source_ids(evaluation.normalise_sources(_items(spark, folder)))


@query(
    "win7_stratified_sample",
    sql(
        """SELECT position, source_id, round FROM (SELECT position, source_id, row_number() OVER (PARTITION BY file_name, lang ORDER BY position) AS round, min(position) OVER (PARTITION BY file_name, lang) AS first FROM it)
       ORDER BY round, first LIMIT 300""",
        extra=_ITEMS,
    ),
)
def _(spark, folder):
    rows = evaluation.stratified_sample(evaluation.normalise_sources(_items(spark, folder)), 150)
    return tidy(rows, "position", "source_id", "round")


@query(
    "set2_stable_ids",
    """SELECT conv_id, turn, string_agg(w, '|' ORDER BY p) AS ids FROM (SELECT conv_id, turn, w, min(p) AS p FROM (SELECT conv_id, turn, generate_subscripts(ws, 1) AS p, trim(unnest(ws)) AS w
       FROM (SELECT conv_id, turn, string_split(replace(text, chr(10), ' '), ' ') AS ws FROM conversations)) WHERE w <> '' GROUP BY ALL) GROUP BY ALL""",
)
def _(spark, folder):
    """Distinct words of each turn in order of appearance."""
    words = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")
    turns = t.load(spark, folder, "conversations")
    return tidy(turns.select("conv_id", "turn", tx.stable_ids(words).alias("ids")))


@query(
    "jn14_resolved_citations",
    sql(
        """
  WITH r AS (SELECT case_id, 'S' || rerank_rank AS label, version_id FROM arm_evidence WHERE arm = 'hybrid'),
       c AS (SELECT case_id, i AS position, 'S' || i AS label FROM cases, range(1, 7) g(i))
  SELECT case_id, coalesce(version_id, label) AS source_id, min(position) AS position FROM c LEFT JOIN r USING (case_id, label) GROUP BY ALL""",
        "arm_evidence",
        "cases",
    ),
)
def _(spark, folder):
    """Every case cites S1 to S6, whatever evidence it has."""
    cited = cases(spark, folder).select("case_id", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("position")).withColumn(
        "citation_id", F.concat(F.lit("S"), "position")
    )
    shown = shared.arms(spark, folder)[1].where("arm = 'hybrid'")
    refs = shown.select("case_id", "reference_id", F.col("version_id").alias("source_id"))
    return tidy(evaluation.resolve_citation_ids(cited, refs))


_ALIGN = {
    "act": "SELECT version_id FROM versions WHERE status = 'active'",
    "al": """SELECT e.query_id AS case_id, e.source_id, CASE WHEN e.source_id IN (FROM act) THEN 'exact' WHEN v.document_id % 3 <> 0 AND EXISTS (SELECT 1 FROM versions s WHERE s.document_id = v.document_id AND s.status = 'active') THEN 'alias' ELSE 'missing' END AS alignment
      FROM expected e JOIN versions v ON v.version_id = e.source_id""",
}


def _alignment(spark, folder):
    versions = t.versions(spark, folder)
    live = versions.where("status = 'active'").select(F.col("version_id").alias("source_id"), "document_id")
    aliases = versions.where("status = 'superseded' and document_id % 3 <> 0").select(
        "document_id", F.col("version_id").alias("old_id")
    ).join(live, "document_id").select(F.col("old_id").alias("source_id"), F.col("source_id").alias("target_id"))
    return evaluation.classify_sources(expected(spark, folder), live, aliases), live


@query("jn7_source_alignment", sql("SELECT * FROM al", "expected", "versions", extra=_ALIGN))
def _(spark, folder):
    return _alignment(spark, folder)[0]


@query(
    "agg4_alignment_summary",
    sql(
        """SELECT (SELECT count(*) FROM act) AS active_source_count, count(*) AS expected_source_count, count(*) FILTER (alignment = 'exact') AS exact_source_count, count(*) FILTER (alignment = 'alias') AS alias_source_count,
       count(*) FILTER (alignment = 'missing') AS missing_source_count, count(DISTINCT case_id) FILTER (alignment = 'missing') AS cases_with_missing_sources, count(*) FILTER (alignment = 'missing') = 0 AS all_expected_sources_present FROM al""",
        "expected",
        "versions",
        extra=_ALIGN,
    ),
)
def _(spark, folder):
    return tidy(evaluation.alignment_summary(*_alignment(spark, folder)))


# --- answers and judgements ----------------------------------------------------------------------


@query(
    "fn11_reference_points",
    f"""SELECT conv_id, turn, trim(text) <> '' AND contains({fold("text")}, {fold("trim(string_split(text, '.')[1])")}) AND contains({fold("text")}, 'on') AS covered FROM conversations""",
)
def _(spark, folder):
    points = F.array(F.split("text", r"\.")[0], F.lit(" ON "))
    turns = t.load(spark, folder, "conversations")
    return turns.select("conv_id", "turn", tx.covers_points(F.col("text"), points).alias("covered"))


@query(
    "fn17_generation_flags",
    """SELECT event_id, coalesce((a AND NOT r AND reason IS NULL) OR (r AND reason = 'MODEL_REFUSED'), false) AS available FROM (
     SELECT event_id, event_type IN ('view', 'click') AS a, event_type IN ('error', 'click') AS r, CASE WHEN event_id % 3 = 0 THEN 'MODEL_REFUSED' WHEN event_id % 7 = 1 THEN 'RAG_UNAVAILABLE' END AS reason FROM events)""",
)
def _(spark, folder):
    kind, n = F.col("event_type"), F.col("event_id")
    reason = F.when(n % 3 == 0, "MODEL_REFUSED").when(n % 7 == 1, "RAG_UNAVAILABLE")
    available = tx.generation_available(kind.isin("view", "click"), kind.isin("error", "click"), reason)
    return t.load(spark, folder, "events").select("event_id", available.alias("available"))


@query(
    "flt18_coerced_results",
    r"""SELECT 'r' || event_id AS case_id, event_type <> 'error' AS answered, event_type = 'error' AS refused, CASE WHEN event_id % 3 = 0 THEN 'MODEL_REFUSED' END AS reason_code,
      coalesce((event_type <> 'error' AND event_id % 3 <> 0) OR (event_type = 'error' AND event_id % 3 = 0), false) AS generation_available,
      CASE WHEN event_id % 5 <> 0 THEN event_id % 21 END AS candidate_count, CASE WHEN event_id % 4 <> 0 THEN event_id % 7 END AS evidence_count,
      CASE WHEN event_id % 6 NOT IN (0, 1) THEN round(value, 6) END AS highest_rerank_score, CASE event_id % 3 WHEN 0 THEN 'ready' WHEN 1 THEN 'refused' END AS retrieval_status,
      CASE event_id % 2 WHEN 0 THEN 'INSUFFICIENT_EVIDENCE' END AS retrieval_reason_code, CASE event_id % 2 WHEN 1 THEN 'ANSWER_TEXT_UNSAFE' END AS answer_failure_code,
      CASE event_id % 2 WHEN 1 THEN 'SECRET_OR_PATH' END AS answer_failure_detail, event_id % 9 = 0 AS router_fallback, CASE WHEN event_id % 18 = 0 THEN 'ROUTER_UNAVAILABLE' END AS router_failure_code FROM events""",
)
def _(spark, folder):
    n = F.col("event_id")
    odd = n % 2 == 1
    raw = t.load(spark, folder, "events").select(
        F.concat(F.lit("r"), n).alias("case_id"),
        F.lit(None).cast("boolean").alias("answered"),
        (F.col("event_type") == "error").alias("refused"),
        F.when(n % 3 == 0, "MODEL_REFUSED").alias("reason_code"),
        F.when(n % 5 == 0, "-4").otherwise((n % 21).cast("string")).alias("candidate_count"),
        F.when(n % 4 == 0, "many").otherwise((n % 7).cast("string")).alias("evidence_count"),
        F.when(n % 6 == 0, "NaN").when(n % 6 == 1, "Infinity").otherwise(F.col("value").cast("string")).alias("highest_rerank_score"),
        F.when(n % 3 == 0, "ready").when(n % 3 == 1, "refused").otherwise("lost").alias("retrieval_status"),
        F.when(odd, "free text").otherwise("INSUFFICIENT_EVIDENCE").alias("retrieval_reason_code"),
        F.when(odd, "ANSWER_TEXT_UNSAFE").otherwise("raw output").alias("answer_failure_code"),
        F.when(odd, "SECRET_OR_PATH").otherwise("raw output").alias("answer_failure_detail"),
        (n % 9 == 0).alias("router_fallback"),
        F.when(odd, "other").otherwise("ROUTER_UNAVAILABLE").alias("router_failure_code"),
    )
    return tidy(evaluation.coerce_results(raw))


@query(
    "agg18_semantic_summary",
    """
  WITH j AS (SELECT event_id % 4 + 1 AS points, ['passed', 'passed', 'passed', 'semantic_judge_unavailable', 'not_applicable', 'lost'][event_id % 6 + 1] AS status, event_id % 6 AS k, event_id % 5 AS f, event_type FROM events),
       v AS (SELECT *, status = 'lost' OR (status = 'passed' AND f IN (1, 2)) OR (status <> 'passed' AND f = 3) AS bad FROM j)
  SELECT count(*) AS total, count(*) FILTER (bad) AS invalid_total, count(*) FILTER (NOT bad AND status = 'passed') AS judged_total, count(*) FILTER (NOT bad AND status = 'semantic_judge_unavailable') AS semantic_judge_unavailable_total,
         count(*) FILTER (NOT bad AND status = 'not_applicable') AS not_applicable_total, count(*) FILTER (NOT bad AND status = 'passed' AND f <> 4 AND event_type NOT IN ('error', 'click')) AS semantic_grounded_success_total FROM v""",
)
def _(spark, folder):
    """Events as judgements: some repeat an index, miss a field or judge what was not run."""
    n = F.col("event_id")
    f = n % 5
    points = (n % 4 + 1).cast("int")
    status = F.element_at(
        F.array(*[F.lit(s) for s in ("passed", "passed", "passed", "semantic_judge_unavailable", "not_applicable", "lost")]),
        (n % 6 + 1).cast("int"),
    )
    verdict = F.when(f == 4, "uncertain").otherwise("covered")
    listed = F.transform(
        F.sequence(F.lit(1), points), lambda i: F.struct((i + F.when(f == 1, 1).otherwise(0)).alias("index"), verdict.alias("status"))
    )
    none = F.expr("cast(array() as array<struct<index: int, status: string>>)")
    judged = t.load(spark, folder, "events").select(
        status.alias("judge_status"),
        points.alias("point_count"),
        F.when((status == "passed") | (f == 3), listed).otherwise(none).alias("verdicts"),
        F.when(f == 2, F.lit(None).cast("boolean")).otherwise(F.col("event_type") == "error").alias("unsupported_claims_present"),
        F.lit(True).alias("evidence_supports_answer"),
        (F.col("event_type") != "click").alias("citation_valid"),
    )
    return tidy(evaluation.semantic_summary(judged))


# --- contracts -----------------------------------------------------------------------------------


@query(
    "flt12_case_contracts",
    sql(
        """
  WITH k AS (SELECT case_id, item_id, CASE WHEN item_id % 9 = 4 THEN 'maybe' WHEN item_id % 9 = 5 THEN 'answerable' WHEN no_answer THEN 'no_answer' ELSE 'answerable' END AS kind, expected_n FROM arm_facts WHERE arm = 'hybrid'),
       a AS (SELECT case_id, max(candidates_n + CASE WHEN item_id % 13 = 6 THEN 20 ELSE 0 END) AS c, max(evidence_n + CASE WHEN item_id % 17 = 7 THEN 7 ELSE 0 END) AS e FROM arm_facts GROUP BY 1)
  SELECT case_id, 'case_type' AS rule FROM k WHERE kind = 'maybe' UNION ALL SELECT case_id, 'answerable_without_expected' FROM k WHERE kind = 'answerable' AND expected_n = 0
  UNION ALL SELECT case_id, 'no_answer_with_expected' FROM k WHERE kind = 'no_answer' AND expected_n > 0 UNION ALL SELECT case_id, 'arms_incomplete' FROM k WHERE item_id % 7 = 3
  UNION ALL SELECT k.case_id, 'too_many_candidates' FROM k JOIN a USING (case_id) WHERE c > 20 UNION ALL SELECT k.case_id, 'too_much_evidence' FROM k JOIN a USING (case_id) WHERE e > 6""",
        "arm_facts",
    ),
)
def _(spark, folder):
    n = F.col("item_id")
    facts = arm_facts(spark, folder)
    kind = F.when(n % 9 == 4, "maybe").when(n % 9 == 5, "answerable").when(F.col("no_answer"), "no_answer").otherwise("answerable")
    counted = facts.where(~((n % 7 == 3) & (F.col("arm") == "vector"))).select(
        "case_id",
        "arm",
        (F.col("candidates_n") + F.when(n % 13 == 6, 20).otherwise(0)).alias("candidate_count"),
        (F.col("evidence_n") + F.when(n % 17 == 7, 7).otherwise(0)).alias("evidence_count"),
    )
    # The widest arm decides; the vector arm is missing for some cases only.
    every = facts.select(
        "case_id",
        F.lit("hybrid").alias("arm"),
        (F.col("candidates_n") + F.when(n % 13 == 6, 20).otherwise(0)).alias("candidate_count"),
        (F.col("evidence_n") + F.when(n % 17 == 7, 7).otherwise(0)).alias("evidence_count"),
    )
    rows = cases(spark, folder).select("case_id", kind.alias("case_type"))
    return contracts.arm_case_violations(rows, expected(spark, folder), counted.unionByName(every))


@query(
    "flt16_trace_contracts",
    sql(
        """
  WITH q AS (SELECT query_id, item_id, EXISTS (SELECT 1 FROM arm_evidence e WHERE e.case_id = query_id AND arm = 'hybrid') AS shown, (SELECT count(*) FROM arm_candidates c WHERE c.case_id = query_id AND arm = 'hybrid') AS n FROM questions)
  SELECT query_id, 'strategy' AS rule FROM q WHERE item_id % 8 = 1 UNION ALL SELECT query_id, 'retrieval_limit' FROM q WHERE item_id % 8 = 2 UNION ALL SELECT query_id, 'fusion_weights' FROM q WHERE item_id % 8 = 3
  UNION ALL SELECT query_id, 'candidate_ranks' FROM q WHERE item_id % 8 = 4 AND n > 0 UNION ALL SELECT query_id, 'scores_missing' FROM q WHERE item_id % 8 = 5 AND n > 0 UNION ALL SELECT query_id, 'selected_ranks' FROM q WHERE item_id % 8 = 6 AND shown
  UNION ALL SELECT query_id, 'candidate_ids' FROM q WHERE item_id % 8 = 7 AND n > 0""",
        "arm_evidence",
        "arm_candidates",
        "questions",
    ),
)
def _(spark, folder):
    """Traces of the hybrid strategy with one fault each, by question number."""
    from citeloom.operators import evidence

    _c, reranked, shown = shared.selected(spark, folder)
    n = F.col("item_id") % 8
    numbered = t.questions(spark, folder).select("query_id", "item_id")
    rank, first = F.col("candidate_rank"), F.col("candidate_rank") == 1
    trace = evidence.diagnostic_trace(reranked, shown).join(numbered, "query_id").withColumns(
        {
            "candidate_rank": F.when(n == 4, rank + 1).otherwise(rank),
            "rerank_score": F.when((n == 5) & first, F.lit(None).cast("double")).otherwise(F.col("rerank_score")),
            "selected_rank": F.when((n == 6) & F.col("selected"), F.col("selected_rank") + 1).otherwise(F.col("selected_rank")),
            "source_id": F.when((n == 7) & first, "bad id").otherwise(F.col("source_id")),
        }
    )
    headers = numbered.select(
        "query_id",
        F.when(n == 1, "lexical").otherwise("hybrid").alias("strategy"),
        F.when(n == 2, 21).otherwise(20).alias("retrieval_limit"),
        F.lit(6).alias("rerank_limit"),
        F.lit(60).alias("rrf_k"),
        F.lit(0.35).alias("threshold"),
        F.lit(True).alias("all_scores_captured"),
        F.lit("balanced").alias("fusion_profile"),
        F.when(n == 3, 2.0).otherwise(1.0).alias("vector_weight"),
        F.lit(1.0).alias("lexical_weight"),
    )
    return contracts.trace_violations(headers, trace)


# --- workflow ------------------------------------------------------------------------------------


def event_log(spark, folder):
    """Each terminal reply as the events that would have produced it."""
    replies = t.messages(spark, folder).where("role = 'assistant'")
    lines = F.split("content", "\n")
    n = F.size(lines)
    event = lambda seq, kind, text, stage=None: F.struct(
        seq.cast("int").alias("seq"), F.lit(kind).alias("type"), text.cast("string").alias("text"), F.lit(stage).cast("string").alias("stage")
    )
    none = F.lit(None)
    deltas = F.transform(lines, lambda line, i: event(i + 2, "answer_delta", F.concat(line, F.lit("\n"))))
    kind = F.when(F.col("status") == "error", "error").otherwise("final")
    last = F.struct(
        (n + 2).cast("int").alias("seq"), kind.alias("type"), none.cast("string").alias("text"), none.cast("string").alias("stage")
    )
    opening = F.array(
        event(F.lit(0), "status", none, "retrieving"),
        F.struct(F.lit(1).alias("seq"), F.lit("status").alias("type"), none.cast("string").alias("text"),
                 F.when(F.col("turn") % 4 == 1, "verifying").otherwise("validating").alias("stage")),
    )
    rows = replies.select(
        F.col("message_id").alias("request_id"), "status", "reason_code", "conv_id", "turn", "created_at",
        F.explode(F.concat(opening, deltas, F.array(last))).alias("e"),
    )
    terminal = F.col("e.type").isin("final", "error")
    return rows.select(
        "request_id",
        "e.seq",
        "e.type",
        "e.stage",
        "e.text",
        (F.col("e.seq") * 10 + F.col("conv_id") % 7).cast("bigint").alias("elapsed_ms"),
        F.when(terminal, F.col("status") == "refused").alias("refused"),
        F.when(terminal, F.col("reason_code")).alias("reason_code"),
        F.when(F.col("e.type") == "final", F.array(F.lit("S2"), F.lit("S1"), F.lit("S2")))
        .otherwise(F.expr("cast(array() as array<string>)"))
        .alias("citation_ids"),
        F.col("created_at").alias("event_time"),
    )


_FOLDED = """SELECT message_id AS request_id, string_agg(line || chr(10), '' ORDER BY i) AS answer, any_value(status) AS status, any_value(reason_code) AS reason_code, any_value(turn) AS turn, max(i) AS lines, any_value(conv_id) % 7 AS shift
  FROM (SELECT message_id, status, reason_code, turn, conv_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM stored_messages WHERE role = 'assistant') GROUP BY 1"""


@query(
    "agg30_event_fold",
    sql(
        """SELECT request_id, answer, trim(replace(answer, chr(10), ' ')) <> '' AND status <> 'refused' AS answered, status = 'refused' AS refused, reason_code, CASE WHEN status = 'error' THEN '' ELSE 'S2|S1' END AS citation_ids,
       shift AS first_status_ms, (lines + 2) * 10 + shift AS duration_ms, true AS well_formed, status = 'answered' AND trim(replace(answer, chr(10), ' ')) <> '' AS generation_available FROM f""",
        "stored_messages",
        extra={"f": _FOLDED},
    ),
)
def _(spark, folder):
    return tidy(workflow.fold_events(event_log(spark, folder)))


def usage(spark, folder):
    n = F.col("event_id")
    stages = F.array(*[F.lit(s) for s in ("routing", "retrieving", "generating", "verifying", "idle")])
    return t.load(spark, folder, "events").select(
        F.concat(F.lit("m"), "user_id", F.lit("-"), n % 4 + 1).alias("request_id"),
        F.element_at(stages, (n % 5 + 1).cast("int")).alias("stage"),
        F.when(n % 11 == 0, -5).otherwise(n % 100).alias("input_tokens"),
        F.when(n % 13 == 0, F.lit(None).cast("bigint")).otherwise(n % 40).alias("output_tokens"),
    )


_USAGE = {
    "u": """SELECT 'm' || user_id || '-' || (event_id % 4 + 1) AS request_id, ['routing', 'retrieving', 'generating', 'verifying', 'idle'][event_id % 5 + 1] AS stage,
      CASE WHEN event_id % 11 <> 0 THEN event_id % 100 ELSE 0 END AS i, CASE WHEN event_id % 13 <> 0 THEN event_id % 40 ELSE 0 END AS o FROM events WHERE event_id % 5 <> 4"""
}


@query(
    "agg29_usage_rollup",
    sql(
        """SELECT CASE WHEN grouping(request_id) = 1 THEN '(all)' ELSE request_id END AS request_id, CASE WHEN grouping(stage) = 1 THEN '(all)' ELSE stage END AS stage, count(*) AS calls, sum(i)::BIGINT AS input_tokens, sum(o)::BIGINT AS output_tokens
       FROM u GROUP BY ROLLUP (request_id, stage)""",
        extra=_USAGE,
    ),
)
def _(spark, folder):
    return tidy(workflow.usage_rollup(usage(spark, folder)))


@query(
    "agg33_request_summary",
    sql(
        """SELECT request_id, ['direct', 'verify', 'clarify'][turn % 3 + 1] AS route, status AS outcome,
       CASE WHEN turn % 4 = 1 AND status = 'answered' THEN 'passed' WHEN turn % 4 = 1 OR status = 'refused' THEN 'failed' ELSE 'not_run' END AS verifier_status,
       coalesce((SELECT count(*) FROM u WHERE u.request_id = f.request_id), 0) AS http_calls, (lines + 2) * 10 + shift AS elapsed_ms, reason_code FROM f""",
        "stored_messages",
        extra={"f": _FOLDED, **_USAGE},
    ),
)
def _(spark, folder):
    routes = t.messages(spark, folder).where("role = 'assistant'").select(
        F.col("message_id").alias("request_id"),
        F.element_at(F.array(F.lit("direct"), F.lit("verify"), F.lit("clarify")), (F.col("turn") % 3 + 1).cast("int")).alias("route"),
    )
    return tidy(workflow.request_summary(event_log(spark, folder), usage(spark, folder), routes))


@query(
    "fn21_router_labels",
    """SELECT 'r' || event_id AS request_id, CASE event_id % 5 WHEN 0 THEN 'direct' WHEN 1 THEN 'verify' WHEN 2 THEN 'clarify' END AS route,
     CASE event_id % 5 WHEN 0 THEN 'single_fact' WHEN 1 THEN 'multi_condition' WHEN 2 THEN 'ambiguous' END AS reason_code, event_id % 5 <= 2 AS valid FROM events""",
)
def _(spark, folder):
    n = F.col("event_id") % 5
    pick = lambda *v: F.element_at(F.array(*[F.lit(x) for x in v]), (n + 1).cast("int"))
    rows = t.load(spark, folder, "events").select(
        F.concat(F.lit("r"), "event_id").alias("request_id"),
        pick("direct/single_fact", "verify", "clarify", "direct", "other").alias("route"),
        pick("single_fact", "clear_multi_condition", "needs_clarification", "ambiguous", "single_fact").alias("reason_code"),
    )
    return workflow.normalise_routes(rows)
