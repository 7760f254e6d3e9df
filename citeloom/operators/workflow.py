"""Event logs and usage of answered requests."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom import fixed
from citeloom.functions import text as tx

EVENT_TYPES = ("status", "answer_delta", "final", "error")


def fold_events(events: DataFrame) -> DataFrame:
    """One outcome per request from its event log.

    ``events``: request_id, seq, elapsed_ms, type, stage, text, refused,
    reason_code, citation_ids. Deltas and the final text are joined in order;
    the last final or error event decides refusal and reason; citations stay
    distinct in order. A request is one answer, so its events are few.
    """
    kind = F.col("type")
    spoken = kind.isin("answer_delta", "final") & F.col("text").isNotNull()
    folded = events.groupBy("request_id").agg(
        F.min_by("elapsed_ms", F.when(kind == "status", F.col("seq"))).alias("first_status_ms"),
        F.max("elapsed_ms").alias("duration_ms"),
        F.array_sort(F.collect_list(F.when(spoken, F.struct("seq", "text")))).alias("parts"),
        F.array_sort(
            F.collect_list(F.when(kind.isin("answer_delta", "final"), F.struct("seq", "citation_ids")))
        ).alias("cited"),
        F.max_by("refused", F.when(kind == "final", F.col("seq"))).alias("refused"),
        F.max_by(
            F.when(kind == "error", F.coalesce("reason_code", F.lit("RAG_UNAVAILABLE"))).otherwise(F.col("reason_code")),
            F.when((kind == "error") | ((kind == "final") & F.col("reason_code").isNotNull()), F.col("seq")),
        ).alias("reason_code"),
        F.count_if(kind.isin("final", "error")).alias("terminal_events"),
        F.count_if(~kind.isin(*EVENT_TYPES)).alias("invalid_events"),
    )
    refused = F.coalesce("refused", F.lit(False))
    text = F.array_join("parts.text", "")
    answered = ~tx.is_blank(text) & ~refused
    ids = F.array_distinct(F.flatten(F.filter("cited.citation_ids", lambda c: c.isNotNull())))
    reason = F.when(~answered & F.col("reason_code").isNull() & ~refused, "RAG_UNAVAILABLE").otherwise(
        F.col("reason_code")
    )
    return folded.select(
        "request_id",
        text.alias("answer"),
        answered.alias("answered"),
        refused.alias("refused"),
        reason.alias("reason_code"),
        ids.alias("citation_ids"),
        "first_status_ms",
        "duration_ms",
        ((F.col("terminal_events") == 1) & (F.col("invalid_events") == 0)).alias("well_formed"),
        tx.generation_available(answered, refused, reason).alias("generation_available"),
    )


def usage_rollup(usage: DataFrame) -> DataFrame:
    """Calls and tokens per request and stage, with request totals (rollup).

    ``usage``: request_id, stage, input_tokens, output_tokens. Unknown stages
    are left out; negative or missing token numbers add nothing.
    """
    add = lambda c: F.coalesce(F.sum(F.when(F.col(c) >= 0, F.col(c))), F.lit(0))
    return (
        usage.where(F.col("stage").isin(*fixed.WORKFLOW_STAGES))
        .rollup("request_id", "stage")
        .agg(
            F.count("*").alias("calls"),
            add("input_tokens").alias("input_tokens"),
            add("output_tokens").alias("output_tokens"),
            F.grouping("request_id").alias("all_requests"),
            F.grouping("stage").alias("all_stages"),
        )
        .select(
            F.when(F.col("all_requests") == 1, "(all)").otherwise(F.col("request_id")).alias("request_id"),
            F.when(F.col("all_stages") == 1, "(all)").otherwise(F.col("stage")).alias("stage"),
            "calls",
            "input_tokens",
            "output_tokens",
        )
    )


def request_summary(events: DataFrame, usage: DataFrame, routes: DataFrame) -> DataFrame:
    """Route, outcome, verifier status, calls and elapsed time of each request.

    The verifier ran when a verifying stage was announced; it passed when the
    only terminal event is then an answer.
    """
    kind = F.col("type")
    terminal = kind.isin("final", "error")
    shape = events.groupBy("request_id").agg(
        F.coalesce(F.bool_or((kind == "status") & (F.col("stage") == "verifying")), F.lit(False)).alias("verifying"),
        F.count_if(terminal).alias("terminals"),
        F.max_by("type", F.when(terminal, F.col("seq"))).alias("last_terminal"),
        F.coalesce(F.bool_or((kind == "final") & F.col("refused")), F.lit(False)).alias("refused"),
        F.max("elapsed_ms").alias("elapsed_ms"),
        F.max_by("reason_code", F.when(terminal, F.col("seq"))).alias("reason_code"),
    )
    calls = usage.where(F.col("stage").isin(*fixed.WORKFLOW_STAGES)).groupBy("request_id").agg(
        F.count("*").alias("http_calls")
    )
    answered = (F.col("terminals") == 1) & (F.col("last_terminal") == "final") & ~F.col("refused")
    outcome = F.when(answered, "answered").when(F.col("refused"), "refused").otherwise("error")
    verifier = (
        F.when(F.col("verifying") & answered, "passed")
        .when(F.col("verifying") | F.col("refused"), "failed")
        .otherwise("not_run")
    )
    return (
        shape.join(calls, "request_id", "left")
        .join(routes.select("request_id", "route"), "request_id", "left")
        .select(
            "request_id",
            "route",
            outcome.alias("outcome"),
            verifier.alias("verifier_status"),
            F.coalesce("http_calls", F.lit(0)).alias("http_calls"),
            F.greatest("elapsed_ms", F.lit(0)).alias("elapsed_ms"),
            "reason_code",
        )
    )


def normalise_routes(decisions: DataFrame) -> DataFrame:
    """Router labels through the known aliases; a pair that does not match is invalid.

    ``decisions``: request_id, route, reason_code. The tables are fixed and
    small, so they are expressions, not joins.
    """
    route = F.coalesce(tx.mapped(F.col("route"), fixed.ROUTE_ALIASES), F.col("route"))
    reason = F.coalesce(tx.mapped(F.col("reason_code"), fixed.REASON_ALIASES), F.col("reason_code"))
    valid = F.coalesce(tx.mapped(route, fixed.ROUTE_REASONS) == reason, F.lit(False))
    return decisions.select(
        "request_id",
        F.when(valid, route).alias("route"),
        F.when(valid, reason).alias("reason_code"),
        valid.alias("valid"),
    )
