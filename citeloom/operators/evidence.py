"""Rerank, relevance gate, citations, traces and evidence checks."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom import fixed
from citeloom.functions import safety as sf
from citeloom.functions import text as tx
from citeloom.operators import vectors
from citeloom.session import by_question


def rerank(candidates: DataFrame, scorer=None) -> DataFrame:
    """Candidates (with question and text) in rerank order: rerank_score, rerank_rank.

    Ties keep the candidate order. Scores are one row-wise function of the
    pair; only the numbering needs the question's rows together.
    """
    scored = vectors.rerank_scores(by_question(candidates), scorer)
    order = Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "rank")
    return scored.withColumn("rerank_rank", F.row_number().over(order))


def select_evidence(reranked: DataFrame, *, rerank_limit: int = fixed.MAX_EVIDENCE, diagnostic: bool = False) -> DataFrame:
    """The first evidence rows of each question, labelled S1..S6.

    The diagnostic form scores all candidates and keeps six whatever
    ``rerank_limit`` says.
    """
    limit = fixed.MAX_EVIDENCE if diagnostic else min(rerank_limit, fixed.MAX_EVIDENCE)
    return reranked.where(F.col("rerank_rank") <= limit).withColumn(
        "reference_id", F.concat(F.lit("S"), F.col("rerank_rank"))
    )


def relevance_gate(evidence: DataFrame, threshold: float = fixed.RELEVANCE_THRESHOLD) -> DataFrame:
    """Drop a question's evidence when even its best score is under the threshold.

    A question that passes keeps all its evidence, weak items included.
    """
    best = F.max("rerank_score").over(Window.partitionBy("query_id"))
    return evidence.withColumn("best_score", best).where(F.col("best_score") >= threshold).drop("best_score")


def retrieval_status(questions: DataFrame, candidates: DataFrame, reranked: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per question: candidate_count, evidence_count, highest_rerank_score, status, reason."""
    counts = candidates.groupBy("query_id").agg(F.count("*").alias("candidate_count"))
    kept = evidence.groupBy("query_id").agg(
        F.count("*").alias("evidence_count"), F.max("rerank_score").alias("highest_rerank_score")
    )
    ready = F.coalesce("evidence_count", F.lit(0)) > 0
    return (
        questions.select("query_id")
        .join(counts, "query_id", "left")
        .join(kept, "query_id", "left")
        .select(
            "query_id",
            F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"),
            F.coalesce("evidence_count", F.lit(0)).alias("evidence_count"),
            "highest_rerank_score",
            F.when(ready, "ready").otherwise("refused").alias("status"),
            F.when(~ready, "INSUFFICIENT_EVIDENCE").alias("reason_code"),
        )
    )


def diagnostic_trace(reranked: DataFrame, evidence: DataFrame) -> DataFrame:
    """Every candidate with scores, whether it was selected and at which rank."""
    chosen = evidence.select("query_id", "version_id", "chunk_id", F.col("rerank_rank").alias("selected_rank"))
    return reranked.join(chosen, ["query_id", "version_id", "chunk_id"], "left").select(
        "query_id",
        F.col("chunk_id").alias("source_id"),
        F.col("rank").alias("candidate_rank"),
        F.col("score").alias("retrieval_score"),
        "rerank_score",
        F.col("selected_rank").isNotNull().alias("selected"),
        "selected_rank",
    )


def retrieval_trace(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """Ordered candidate ids, evidence ids and the S-id map of each question."""
    listed = candidates.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).alias("c")
    )
    shown = evidence.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rerank_rank", "chunk_id", "reference_id"))).alias("e")
    )
    return listed.join(shown, "query_id", "left").select(
        "query_id",
        F.col("c.chunk_id").alias("candidate_source_ids"),
        F.coalesce("e.chunk_id", F.expr("cast(array() as array<string>)")).alias("evidence_source_ids"),
        F.map_from_arrays("e.reference_id", "e.chunk_id").alias("evidence_reference_map"),
    )


# --- citations ---------------------------------------------------------------


def citations(evidence: DataFrame, allowed: DataFrame | None = None) -> DataFrame:
    """One citation per S-id; a question with any unlocatable evidence gives none.

    ``allowed`` (query_id, reference_id) narrows the evidence first. The
    result has the failure in ``problem`` so refused answers stay visible.
    """
    rows = evidence if allowed is None else evidence.join(allowed, ["query_id", "reference_id"], "left_semi")
    heading = F.transform("heading_path", sf.mask_secrets)
    basename_ok = (
        ~F.col("file_name").rlike(fixed.ANY_CONTROL)
        & ~F.col("file_name").rlike(r"[/\\]")
        & ~F.col("file_name").rlike(r"^[A-Za-z]:[^\\/]")
    )
    file_name = sf.mask_secrets(F.col("file_name"))
    excerpt = sf.safe_excerpt(F.col("text"), redact_paths=True)
    heading_ok = (
        (F.size("heading_path") > 0)
        & (heading == F.col("heading_path"))
        & F.forall(
            "heading_path",
            lambda h: (F.length(tx.strip(h)) > 0) & ~h.rlike(fixed.ANY_CONTROL) & ~h.rlike(r"[/\\]"),
        )
    )
    problem = (
        F.when(~F.col("reference_id").rlike(fixed.REFERENCE_ID), "UNKNOWN_SOURCE")
        .when(~basename_ok, "UNSAFE_BASENAME")
        .when(~sf.valid_location(file_name), "UNLOCATABLE_SOURCE")
        .when(~heading_ok, "UNLOCATABLE_SOURCE")
        .when(excerpt.isNull(), "UNLOCATABLE_SOURCE")
    )
    whole = Window.partitionBy("query_id")
    first = Window.partitionBy("query_id", "reference_id").orderBy("rerank_rank")
    checked = (
        rows.withColumn("row_problem", problem)
        .withColumn("problem", F.min("row_problem").over(whole))
        .withColumn("nth", F.row_number().over(first))
        .where("nth = 1")
    )
    fine = F.col("problem").isNull()
    return checked.select(
        "query_id",
        "reference_id",
        "problem",
        F.when(fine, file_name).alias("file_name"),
        F.when(fine, F.col("heading_path")).alias("heading_path"),
        "page",
        "page_end",
        "paragraph_start",
        "paragraph_end",
        "table_id",
        F.when(fine, excerpt).alias("excerpt"),
    )


def candidate_sources(evidence: DataFrame) -> DataFrame:
    """The sources shown when no answer was generated, each with its validity."""
    name = sf.mask_secrets(F.element_at(F.split(F.replace("file_name", F.lit("\\"), F.lit("/")), "/"), -1))
    headings = F.transform("heading_path", sf.mask_secrets)
    return evidence.select(
        "query_id",
        F.lit(fixed.CANDIDATE_LABEL).alias("label"),
        "reference_id",
        name.alias("file_name"),
        headings.alias("heading_path"),
        sf.candidate_source_problem(F.col("reference_id"), name, headings).alias("problem"),
    )


def evidence_problem() -> Column:
    """Metadata that must not cross the prompt boundary: NULL when it may."""
    return F.when(
        F.col("file_name").isNull() | F.col("file_name").rlike(fixed.ANY_CONTROL), "UNSAFE_SOURCE_NAME"
    ).when(
        F.col("heading_path").isNull() | F.exists("heading_path", lambda h: h.isNull()), "INVALID_HEADING_PATH"
    )


def metadata_gate(evidence: DataFrame) -> DataFrame:
    """Per question: whether all its evidence may be used, and the first fault."""
    return (
        evidence.withColumn("fault", evidence_problem())
        .groupBy("query_id")
        .agg(
            F.count("*").alias("evidence_count"),
            F.bool_and(F.col("fault").isNull()).alias("usable"),
            F.min("fault").alias("problem"),
        )
    )


def still_eligible(evidence: DataFrame, eligible: DataFrame) -> DataFrame:
    """Per question: are all versions behind its evidence still eligible?

    ``eligible``: query_id, version_id (or version_id alone for all questions).
    """
    keys = [c for c in ("query_id", "version_id") if c in eligible.columns]
    held = eligible.select(*keys).distinct().withColumn("held", F.lit(True))
    used = evidence.select("query_id", "version_id").distinct()
    return (
        used.join(held, keys, "left")
        .groupBy("query_id")
        .agg(
            F.count("*").alias("versions_used"),
            F.count_if(F.col("held").isNull()).alias("versions_lost"),
        )
        .withColumn("still_eligible", F.col("versions_lost") == 0)
    )


def verify_claims(claims: DataFrame, answers: DataFrame, evidence: DataFrame) -> DataFrame:
    """Per question: may the answer stand, and on which source ids?

    ``claims``: query_id, claim_no, claim, verdict, source_ids; ``answers``:
    query_id, answer; ``evidence``: query_id, reference_id. Every claim must
    occur in the answer, be supported and cite known evidence, else the whole
    answer is refused with the first fault in claim order.
    """
    known = evidence.select("query_id", "reference_id").distinct()
    cited = claims.select("query_id", "claim_no", F.explode_outer("source_ids").alias("reference_id"))
    unknown = (
        cited.join(known.withColumn("known", F.lit(True)), ["query_id", "reference_id"], "left")
        .groupBy("query_id", "claim_no")
        .agg(F.bool_and(F.coalesce("known", F.lit(False))).alias("all_known"))
    )
    checked = (
        claims.join(answers, "query_id")
        .join(unknown, ["query_id", "claim_no"])
        .withColumn(
            "fault",
            F.when(
                ~tx.collapse_space(F.col("answer")).contains(tx.collapse_space(F.col("claim"))), "CLAIM_NOT_IN_ANSWER"
            )
            .when(F.col("verdict") != "supported", "CLAIM_UNSUPPORTED")
            .when(~F.col("all_known"), "SOURCE_UNKNOWN"),
        )
    )
    return (
        checked.groupBy("query_id")
        .agg(
            F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("claim_no"))).alias("fault"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("source_ids")))).alias("ids"),
        )
        .select(
            "query_id",
            F.col("fault").isNull().alias("verified"),
            "fault",
            F.when(F.col("fault").isNull(), F.col("ids")).alias("supported_source_ids"),
        )
    )


# --- resolving cited chunks against the corpus --------------------------------


def resolve_citations(cited: DataFrame, chunks: DataFrame) -> DataFrame:
    """Status of each case's cited chunks: all resolve, or none count.

    ``cited``: case_id, source_version, citation_chunk_ids. Checks run in a
    fixed order: missing version, missing ids, unsafe ids, ids of another
    version, missing chunks, unsafe chunk metadata.
    """
    ids = cited.select(
        "case_id", "source_version", F.posexplode("citation_chunk_ids").alias("pos", "chunk_id")
    )
    wanted = chunks.join(ids.select("chunk_id").distinct(), "chunk_id", "left_semi")
    # One row per cited chunk before joining: a chunk copied into very many
    # versions is reduced map-side to its smallest and largest version.
    span = wanted.groupBy("chunk_id").agg(F.min("version_id").alias("low"), F.max("version_id").alias("high"))
    exact = wanted.groupBy("chunk_id", F.col("version_id").alias("source_version")).agg(
        F.bool_or(sf.unsafe_chunk()).alias("unsafe")
    )
    per_case = (
        ids.join(exact, ["chunk_id", "source_version"], "left")
        .join(span, "chunk_id", "left")
        .groupBy("case_id")
        .agg(
            F.bool_and(F.col("unsafe").isNotNull()).alias("all_here"),
            F.bool_or(
                F.coalesce(
                    (F.col("low") != F.col("source_version")) | (F.col("high") != F.col("source_version")),
                    F.lit(False),
                )
            ).alias("any_elsewhere"),
            F.bool_or(F.coalesce("unsafe", F.lit(False))).alias("any_unsafe"),
        )
    )
    bad_id = F.exists(
        "citation_chunk_ids",
        lambda c: c.isNull()
        | (F.length(tx.strip(c)) == 0)
        | (F.length(c) > 160)
        | c.rlike(f"[{fixed.SPACE_CLASS}]"),
    )
    reason = (
        F.when(tx.is_blank(F.col("source_version")), "source_version_missing")
        .when(F.coalesce(F.size("citation_chunk_ids"), F.lit(0)) <= 0, "citation_ids_missing")
        .when(bad_id, "citation_ids_unsafe")
        .when(~F.col("all_here") & F.col("any_elsewhere"), "citation_version_mismatch")
        .when(~F.col("all_here"), "citation_chunk_missing")
        .when(F.col("any_unsafe"), "citation_metadata_unsafe")
    )
    status = (
        F.when(F.col("reason").isNull(), "available")
        .when(F.col("reason").isin("citation_ids_unsafe", "citation_metadata_unsafe"), "unsafe")
        .when(F.col("reason") == "citation_version_mismatch", "version_mismatch")
        .otherwise("unavailable")
    )
    return (
        cited.join(per_case, "case_id", "left")
        .withColumn("reason", reason)
        .select("case_id", status.alias("status"), F.col("reason").alias("reason_code"))
    )


def evidence_references(cited: DataFrame, resolved: DataFrame, chunks: DataFrame) -> DataFrame:
    """The cited chunks, in citation order, of cases whose evidence is available."""
    usable = cited.join(resolved.where("status = 'available'"), "case_id", "left_semi")
    ids = usable.select(
        "case_id",
        F.col("source_version").alias("version_id"),
        F.posexplode("citation_chunk_ids").alias("pos", "chunk_id"),
    )
    return ids.join(chunks, ["version_id", "chunk_id"]).select(
        "case_id",
        (F.col("pos") + 1).alias("position"),
        "chunk_id",
        "version_id",
        "file_name",
        "heading_path",
        "paragraph_start",
        "paragraph_end",
        F.substring("text", 1, fixed.EXCERPT_CHARS).alias("excerpt"),
    )
