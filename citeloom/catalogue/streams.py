"""Streaming queries: each runs its stream over the given tables to the end."""

from pyspark.sql import functions as F

from citeloom.catalogue import query
from citeloom.catalogue.evaluation import _FOLDED, event_log
from citeloom.catalogue.sqlbase import sql
from citeloom.catalogue.tidy import tidy
from citeloom.session import shared_dir
from citeloom.sources import tables as t
from citeloom.streaming import flows


def source(rows, name: str, files: int = 4):
    """Rows written as several files, read back as a stream of one file a batch."""
    spark = rows.sparkSession
    path = shared_dir(spark, name)
    rows.repartition(files).write.parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


@query(
    "str1_event_append",
    """
  WITH e AS (SELECT 'e' || (event_id - CASE WHEN event_id % 10 = 9 THEN 1 ELSE 0 END) AS event_id FROM events)
  SELECT count(*) AS stored, count(*) FILTER (n = 2) AS shared_ids FROM (SELECT event_id, count(*) AS n FROM e GROUP BY 1)""",
)
def _(spark, folder):
    """Every tenth event takes the id of the one before it."""
    n = F.col("event_id")
    rows = t.load(spark, folder, "events").select(
        F.concat(F.lit("e"), n - F.when(n % 10 == 9, 1).otherwise(0)).alias("event_id"),
        F.concat(F.lit("u"), "user_id").alias("case_id"),
        (F.col("event_type") == "view").alias("helpful"),
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("feedback_reason"),
        F.col("ts").cast("timestamp").alias("event_at"),
    )
    events, conflicts = shared_dir(spark, "events"), shared_dir(spark, "conflicts")
    flows.append_events(source(rows, "event-log"), events, conflicts, shared_dir(spark, "cp")).awaitTermination()
    stored = spark.read.schema(rows.schema).parquet(events)
    held = stored.groupBy("event_id").agg(F.count("*").alias("n"))
    shared = rows.groupBy("event_id").count().where("count = 2").select("event_id")
    # An id stored twice would show in the first count; ids sent twice in the second.
    return tidy(
        held.agg(F.sum("n").alias("stored")).withColumn(
            "shared_ids", shared.join(held, "event_id").agg(F.count("*")).scalar()
        )
    )


@query(
    "str2_latest_feedback",
    sql("SELECT message_id, event_id, helpful, reason FROM latest_clicks", "latest_clicks"),
)
def _(spark, folder):
    feedback, bad = shared_dir(spark, "feedback"), shared_dir(spark, "bad-cases")
    clicks = t.feedback_clicks(spark, folder).withColumn("created_at", F.col("created_at").cast("timestamp"))
    flows.upsert_feedback(
        source(clicks, "clicks"), t.messages(spark, folder), feedback, bad, shared_dir(spark, "cp")
    ).awaitTermination()
    return flows.latest_feedback(spark.read.parquet(feedback)).select("message_id", "event_id", "helpful", "reason")


@query(
    "str2_opened_bad_cases",
    sql("SELECT DISTINCT message_id, upper('user_feedback_' || reason) AS code FROM valid_clicks WHERE reason IS NOT NULL", "valid_clicks"),
)
def _(spark, folder):
    feedback, bad = shared_dir(spark, "feedback"), shared_dir(spark, "bad-cases")
    clicks = t.feedback_clicks(spark, folder).withColumn("created_at", F.col("created_at").cast("timestamp"))
    flows.upsert_feedback(
        source(clicks, "clicks"), t.messages(spark, folder), feedback, bad, shared_dir(spark, "cp")
    ).awaitTermination()
    return spark.read.parquet(bad).select("message_id", "code")


@query(
    "str3_chat_event_fold",
    sql(
        """SELECT request_id, answer, trim(replace(answer, chr(10), ' ')) <> '' AND status <> 'refused' AS answered, status = 'refused' AS refused, reason_code, CASE WHEN status = 'error' THEN '' ELSE 'S2|S1' END AS citation_ids, true AS well_formed FROM f""",
        "stored_messages",
        extra={"f": _FOLDED},
    ),
)
def _(spark, folder):
    out = shared_dir(spark, "outcomes")
    folded = flows.fold_chat_events(source(event_log(spark, folder), "chat-events", files=2))
    (
        folded.writeStream.format("parquet")
        .option("checkpointLocation", shared_dir(spark, "cp"))
        .trigger(availableNow=True)
        .start(out)
        .awaitTermination()
    )
    return tidy(spark.read.schema(folded.schema).parquet(out))


@query(
    "str4_reply_append",
    sql(
        """SELECT reply_to_message_id, message_id FROM retried WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY reply_to_message_id ORDER BY created_at, message_id) = 1""",
        "retried",
    ),
)
def _(spark, folder):
    replies = t.retried_messages(spark, folder).where("role = 'assistant'").select(
        "reply_to_message_id", "message_id", "session_id", "status", "created_at"
    )
    # Retries come later, so the originals fill the first file of the stream.
    path, out = shared_dir(spark, "replies"), shared_dir(spark, "stored")
    replies.where("not endswith(message_id, 'r')").coalesce(1).write.parquet(path)
    replies.where("endswith(message_id, 'r')").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(replies.schema).parquet(path)
    flows.append_replies(stream, out, shared_dir(spark, "cp")).awaitTermination()
    return flows.first_reply(spark.read.parquet(out)).select("reply_to_message_id", "message_id")
