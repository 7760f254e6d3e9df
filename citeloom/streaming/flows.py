"""Keyed append flows as Structured Streaming jobs.

Each sink is append-only: a micro-batch adds the rows that are new to its
table, and the table's view decides between rows of one key. A batch that is
replayed after a failure adds nothing that changes the view, and any late
event is accepted, however late.
"""

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from citeloom import fixed
from citeloom.functions import text as tx
from citeloom.operators.conversations import FINAL, TERMINAL
from citeloom.operators.feedback import open_bad_cases


def _table(spark: SparkSession, path: str, schema) -> DataFrame:
    """A table that may not have been written yet."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    exists = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    return spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)


def _run(stream: DataFrame, checkpoint: str, handle, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


# --- events -------------------------------------------------------------------

EVENT = "event_id string, case_id string, helpful boolean, feedback_reason string, event_at timestamp"
_SAME = ("case_id", "helpful", "feedback_reason")


def append_events(
    stream: DataFrame, events_path: str, conflicts_path: str, checkpoint: str, *, available_now: bool = True
) -> StreamingQuery:
    """Store each event id once; a repeat that differs goes to the conflicts.

    ``stream`` has the columns of ``EVENT``.
    """
    schema = stream.schema

    def handle(batch: DataFrame, _: int) -> None:
        held = _table(batch.sparkSession, events_path, schema)
        fresh, conflicts = split_events(batch, held)
        # Conflicts are compared against the events before this batch's append.
        conflicts.write.mode("append").parquet(conflicts_path)
        fresh.write.mode("append").parquet(events_path)

    return _run(stream, checkpoint, handle, available_now)


def split_events(batch: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New events of a batch, and rows whose id is taken by a different event.

    Inside a batch the smallest event of an id is the one stored.
    """
    order = F.struct("event_at", "case_id", "helpful", F.coalesce("feedback_reason", F.lit("")))
    first = (
        batch.groupBy("event_id")
        .agg(F.min_by(F.struct(*[c for c in batch.columns if c != "event_id"]), order).alias("e"))
        .select("event_id", "e.*")
        .select(*batch.columns)
    )
    fresh = first.join(held.select("event_id"), "event_id", "left_anti")
    owner = held.select("event_id", F.struct(*_SAME).alias("owner")).unionByName(
        fresh.select("event_id", F.struct(*_SAME).alias("owner"))
    )
    conflicts = (
        batch.join(owner, "event_id").where(~F.struct(*_SAME).eqNullSafe(F.col("owner"))).select(*batch.columns)
    )
    return fresh, conflicts


def event_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("case_id").agg(F.count_distinct("event_id").alias("event_count"))


# --- feedback -----------------------------------------------------------------


def upsert_feedback(
    stream: DataFrame,
    messages: DataFrame,
    feedback_path: str,
    bad_cases_path: str,
    checkpoint: str,
    *,
    available_now: bool = True,
) -> StreamingQuery:
    """Latest feedback per final reply, opening a bad case for each reason given.

    ``stream``: event_id, message_id, helpful, reason, created_at. Read the
    result through :func:`latest_feedback`.
    """

    def handle(batch: DataFrame, _: int) -> None:
        valid = valid_feedback(batch, messages).persist()
        try:
            opened = _table(batch.sparkSession, bad_cases_path, "case_id string, message_id string, code string, status string")
            open_bad_cases(valid, opened).write.mode("append").parquet(bad_cases_path)
            latest_feedback(valid).write.mode("append").parquet(feedback_path)
        finally:
            valid.unpersist()

    return _run(stream, checkpoint, handle, available_now)


def valid_feedback(feedback: DataFrame, messages: DataFrame) -> DataFrame:
    """Feedback on final replies with a known reason; helpful feedback has none."""
    final = messages.where((F.col("role") == "assistant") & F.col("status").isin(*FINAL)).select("message_id")
    reasons = [r for r, _ in fixed.FEEDBACK_CODES]
    fine = F.col("reason").isNull() | (F.col("reason").isin(*reasons) & ~F.col("helpful"))
    return feedback.where(F.col("helpful").isNotNull() & fine).join(final, "message_id", "left_semi")


def latest_feedback(feedback: DataFrame) -> DataFrame:
    columns = ["event_id", "helpful", "reason", "created_at"]
    return (
        feedback.groupBy("message_id")
        .agg(F.max_by(F.struct(*columns), F.struct("created_at", "event_id")).alias("f"))
        .select("message_id", "f.*")
    )


# --- replies ------------------------------------------------------------------


def append_replies(
    stream: DataFrame, replies_path: str, checkpoint: str, *, available_now: bool = True
) -> StreamingQuery:
    """Terminal replies; read through :func:`first_reply`, where the first wins."""
    schema = stream.schema

    def handle(batch: DataFrame, _: int) -> None:
        held = _table(batch.sparkSession, replies_path, schema)
        terminal = batch.where(F.col("status").isin(*TERMINAL) & F.col("reply_to_message_id").isNotNull())
        first_reply(terminal).select(*batch.columns).join(
            held.select("reply_to_message_id"), "reply_to_message_id", "left_anti"
        ).select(*batch.columns).write.mode("append").parquet(replies_path)

    return _run(stream, checkpoint, handle, available_now)


def first_reply(replies: DataFrame) -> DataFrame:
    rest = [c for c in replies.columns if c != "reply_to_message_id"]
    return (
        replies.groupBy("reply_to_message_id")
        .agg(F.min_by(F.struct(*rest), F.struct("created_at", "message_id")).alias("m"))
        .select("reply_to_message_id", "m.*")
    )


# --- chat events --------------------------------------------------------------

OUTCOME = (
    "request_id string, answer string, answered boolean, refused boolean, reason_code string, "
    "citation_ids array<string>, well_formed boolean"
)
_EVENT_FIELDS = ("seq", "type", "text", "refused", "reason_code")


def _outcome(request_id: str, events: list[dict]) -> dict:
    events = sorted(events, key=lambda e: e["seq"])
    spoken = [e["text"] for e in events if e["type"] in ("answer_delta", "final") and e["text"] is not None]
    cited = [c for e in events if e["type"] in ("answer_delta", "final") for c in e["citation_ids"]]
    finals = [e for e in events if e["type"] == "final"]
    refused = bool(finals and finals[-1]["refused"])
    reasons = [
        e["reason_code"] or "RAG_UNAVAILABLE"
        for e in events
        if e["type"] == "error" or (e["type"] == "final" and e["reason_code"])
    ]
    answer = "".join(spoken)
    answered = bool(answer.strip()) and not refused
    reason = reasons[-1] if reasons else None
    if not answered and not refused and reason is None:
        reason = "RAG_UNAVAILABLE"
    terminals = [e for e in events if e["type"] in ("final", "error")]
    return {
        "request_id": request_id,
        "answer": answer,
        "answered": answered,
        "refused": refused,
        "reason_code": reason,
        "citation_ids": list(dict.fromkeys(cited)),
        "well_formed": len(terminals) == 1,
    }


def _folder(give_up_ms: int):
    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        events = json.loads(state.get[0]) if state.exists else []
        if state.hasTimedOut:
            # No terminal event came: report what is there and let go of the state.
            state.remove()
            yield pd.DataFrame([{**_outcome(key[0], events), "well_formed": False}])
            return
        received = state.getCurrentWatermarkMs()
        for frame in frames:
            received = max(received, int(frame["received_at"].to_numpy().max().astype("datetime64[ms]").astype("int64")))
            for packed in frame["event"].tolist():
                found = json.loads(packed)
                # Fields that are null are left out of the packed event.
                event = {name: found.get(name) for name in _EVENT_FIELDS}
                events.append(event | {"citation_ids": found.get("citation_ids") or []})
        last = max((e["seq"] for e in events if e["type"] in ("final", "error")), default=None)
        if last is not None and len({e["seq"] for e in events}) == last + 1:
            if state.exists:
                state.remove()
            yield pd.DataFrame({name: [value] for name, value in _outcome(key[0], events).items()})
        else:
            state.update((json.dumps(events),))
            state.setTimeoutTimestamp(received + give_up_ms)

    return fold


def fold_chat_events(stream: DataFrame, *, give_up_ms: int = 3_600_000) -> DataFrame:
    """Outcome of each request once its terminal event and all before it are in.

    ``stream``: request_id, seq (from 0), type, text, refused, reason_code,
    citation_ids. State is one request's events. The watermark is on the time
    of arrival, so no event is ever late; a request that never ends is given
    up an hour after its last news, which bounds the state.
    """
    return (
        # One column an event: a request has few rows, and each column of its frames costs more than they do.
        stream.select("request_id", F.to_json(F.struct(*_EVENT_FIELDS, "citation_ids")).alias("event"))
        .withColumn("received_at", F.current_timestamp())
        .withWatermark("received_at", "1 minute")
        .groupBy("request_id")
        .applyInPandasWithState(_folder(give_up_ms), OUTCOME, "events string", "append", "EventTimeTimeout")
    )
