"""Conversation queries: sessions, history, replies, sanitising."""

from pyspark.sql import functions as F

from citeloom import fixed
from citeloom.catalogue import query
from citeloom.catalogue.sqlbase import sql
from citeloom.catalogue.tidy import tidy
from citeloom.functions import safety as sf
from citeloom.operators import conversations as cv
from citeloom.sources import tables as t

_SAFE = r"""NOT (regexp_matches({0}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]') OR regexp_matches({0}, '(?i)(\b(sk|pk)-[A-Za-z0-9_-]+\b|\bbearer[\s:=_-]+[^\s,;]+|\b(api[_ -]?key|access[_ -]?token)\s*[:=]\s*[^\s,;]+)|\b(traceback|stack\s+trace|providererror)\b')
  OR regexp_matches({0}, '([A-Za-z]:[\\/])([^\\/\s]+[\\/])*[^\\/\s]+|(\\\\|//)[^\\/\s]+[\\/][^\\/\s]+|(^|[^A-Za-z0-9_:/])/([^/\s]+/)+[^/\s]+'))"""
_TITLE = rf"""CASE WHEN NOT {_SAFE.format("content")} THEN '{fixed.DEFAULT_TITLE}' WHEN length(trim(regexp_replace(content, '\s+', ' ', 'g'))) <= 40 THEN trim(regexp_replace(content, '\s+', ' ', 'g'))
  ELSE substr(trim(regexp_replace(content, '\s+', ' ', 'g')), 1, 39) || '…' END"""
_TIME = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


@query(
    "prj6_session_titles",
    sql(
        f"""SELECT session_id, coalesce({_TITLE}, '{fixed.DEFAULT_TITLE}') AS title FROM sessions LEFT JOIN
       (SELECT session_id, arg_min(content, turn) AS content FROM messages WHERE role = 'user' GROUP BY 1) USING (session_id)""",
        "sessions",
        "messages",
    ),
)
def _(spark, folder):
    return cv.session_titles(t.sessions(spark, folder), t.messages(spark, folder)).select("session_id", "title")


@query(
    "agg21_session_list",
    sql(
        f"""SELECT session_id, {_TIME.format("coalesce(m.last, s.created_at)")} AS last_activity_at, coalesce(n, 0) AS message_count
       FROM sessions s LEFT JOIN (SELECT session_id, count(*) AS n, max(created_at) AS last FROM messages GROUP BY 1) m USING (session_id)
       ORDER BY coalesce(m.last, s.created_at) DESC, s.created_at DESC, session_id DESC LIMIT 50""",
        "sessions",
        "messages",
    ),
)
def _(spark, folder):
    rows = cv.list_sessions(t.sessions(spark, folder), t.messages(spark, folder), 50)
    return tidy(rows, "session_id", "last_activity_at", "message_count")


@query(
    "top1_restored_messages",
    sql(
        f"SELECT session_id, message_id, role, status, {_TIME.format('created_at')} AS created_at FROM messages ORDER BY session_id, created_at, turn",
        "messages",
    ),
)
def _(spark, folder):
    return tidy(cv.session_messages(t.messages(spark, folder)), "session_id", "message_id", "role", "status", "created_at")


@query(
    "top2_ordered_history",
    "SELECT event_id, 'u' || user_id AS case_id, event_type FROM events ORDER BY user_id, ts, event_id",
)
def _(spark, folder):
    rows = t.load(spark, folder, "events").select("event_id", F.concat(F.lit("u"), "user_id").alias("case_id"), "ts", "event_type")
    return tidy(cv.ordered_history(rows, "case_id", "ts", "event_id"), "event_id", "case_id", "event_type")


_TURNS = {
    "o": """SELECT *, lag(role) OVER w AS ur, lag(message_id) OVER w AS um, lag(content) OVER w AS uc FROM messages WINDOW w AS (PARTITION BY session_id ORDER BY created_at, turn)""",
    "p": """SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, turn DESC) AS turn_no, length(uc) + length(content) AS n FROM o
      WHERE role = 'assistant' AND status IN ('answered', 'refused') AND ur = 'user' AND reply_to_message_id = um""",
    "tt": "SELECT *, sum(n) OVER (PARTITION BY session_id ORDER BY turn_no)::BIGINT AS total FROM p WHERE turn_no <= 5 QUALIFY total <= 2000",
}


@query(
    "win6_complete_turns",
    sql(
        "SELECT session_id, turn_no, um AS user_message_id, message_id AS assistant_message_id, status, total AS total_chars FROM tt",
        "messages",
        extra=_TURNS,
    ),
)
def _(spark, folder):
    rows = cv.complete_turns(t.messages(spark, folder), max_chars=2000)
    return tidy(rows, "session_id", "turn_no", "user_message_id", "assistant_message_id", "status", "total_chars")


_OPEN, _CLOSE = "<conversation-history>", "</conversation-history>"
_MASK = r"""regexp_replace(regexp_replace(regexp_replace({0}, '(?i)\b(sk|pk)-[A-Za-z0-9_-]+\b', '[redacted]', 'g'), '(?i)\bbearer[\s:=_-]+[^\s,;]+', 'bearer [redacted]', 'g'), '(?i)\b(api[_ -]?key|access[_ -]?token)\s*[:=]\s*[^\s,;]+', '[redacted]', 'g')"""


@query(
    "prj7_prompt_context",
    sql(
        f"""
  WITH q AS (SELECT session_id, '<current-question>' || {_MASK.format("arg_max(content, turn)")} || '</current-question>' AS cur FROM messages WHERE role = 'user' GROUP BY 1),
       l AS (SELECT session_id, turn_no, '用户问题：' || {_MASK.format("uc")} || chr(10) || '已验证回复：' || {_MASK.format("content")} AS lines FROM tt),
       f AS (SELECT l.*, sum(length(lines) + 1) OVER (PARTITION BY session_id ORDER BY turn_no) + length(cur) + {len(cv.PROMPT_PREFIX) + len(_OPEN) + len(_CLOSE) + 2} AS used FROM l JOIN q USING (session_id) QUALIFY used <= 1500),
       g AS (SELECT session_id, count(*) AS n, string_agg(lines, chr(10) ORDER BY turn_no) AS body FROM f GROUP BY 1)
  SELECT session_id, coalesce(n, 0) AS turns_used, '{cv.PROMPT_PREFIX.strip()}' || chr(10) || '{_OPEN}' || chr(10) || coalesce(body || chr(10), '') || '{_CLOSE}' || chr(10) || cur AS prompt FROM q LEFT JOIN g USING (session_id)""",
        "messages",
        extra=_TURNS,
    ),
)
def _(spark, folder):
    messages = t.messages(spark, folder)
    turns = cv.complete_turns(messages, max_chars=2000).withColumn("rewritten_question", F.lit(None).cast("string"))
    current = messages.where("role = 'user'").groupBy("session_id").agg(F.max_by("content", "ord").alias("question"))
    return tidy(cv.prompt_context(turns, current, budget=1500))


# --- replies ---------------------------------------------------------------------


_KEEP = {
    "tr": "SELECT message_id, reply_to_message_id, first_value(message_id) OVER w AS keeper_id, row_number() OVER w AS n FROM retried WHERE role = 'assistant' AND reply_to_message_id IS NOT NULL WINDOW w AS (PARTITION BY reply_to_message_id ORDER BY created_at DESC, turn DESC, message_id DESC)"
}


@query(
    "win5_latest_replies",
    sql(
        "SELECT message_id, role, reply_to_message_id FROM retried WHERE message_id NOT IN (SELECT message_id FROM tr WHERE n > 1)",
        "retried",
        extra=_KEEP,
    ),
)
def _(spark, folder):
    kept, _replaced = cv.keep_latest_replies(t.retried_messages(spark, folder))
    return kept.select("message_id", "role", "reply_to_message_id")


@query(
    "win5_moved_feedback",
    sql(
        """SELECT coalesce(keeper_id, message_id) AS message_id, arg_max(event_id, (created_at, event_id)) AS event_id, arg_max(helpful, (created_at, event_id)) AS helpful
       FROM clicks LEFT JOIN (FROM tr WHERE n > 1) USING (message_id) GROUP BY 1""",
        "retried",
        "clicks",
        extra=_KEEP,
    ),
)
def _(spark, folder):
    _kept, replaced = cv.keep_latest_replies(t.retried_messages(spark, folder))
    return cv.move_feedback(t.feedback_clicks(spark, folder), replaced).select("message_id", "event_id", "helpful")


@query(
    "jn10_reply_join",
    sql(
        """SELECT a.message_id, u.content AS question, c.event_id IS NOT NULL AS has_feedback, c.helpful, c.reason
       FROM messages a LEFT JOIN messages u ON u.message_id = a.reply_to_message_id AND u.role = 'user'
       LEFT JOIN (SELECT * FROM clicks QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY created_at DESC, event_id DESC) = 1) c ON c.message_id = a.message_id WHERE a.role = 'assistant'""",
        "messages",
        "clicks",
    ),
)
def _(spark, folder):
    rows = cv.reply_join(t.messages(spark, folder), t.feedback_clicks(spark, folder))
    return rows.select(
        "message_id",
        "question",
        F.col("feedback").isNotNull().alias("has_feedback"),
        F.col("feedback.helpful").alias("helpful"),
        F.col("feedback.reason").alias("reason"),
    )


# --- sanitising --------------------------------------------------------------------


def _damaged(spark, folder):
    """Stored messages with one fault each, by number; most are sound."""
    n = (F.col("conv_id") * 10 + F.col("turn")) % 23
    none = F.lit(None).cast("string")
    base = t.messages(spark, folder)
    when = lambda k, bad, good: F.when(n == k, bad).otherwise(good)
    return base.select(
        when(1, F.lit("bad id!"), F.col("message_id")).alias("message_id"),
        "session_id",
        when(2, F.lit("system"), F.col("role")).alias("role"),
        when(3, F.lit("lost"), F.col("status")).alias("status"),
        when(4, F.lit("2024-02-30 10:00:00"), F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).alias("created_at"),
        when(5, F.lit("  "), when(6, F.concat("content", F.lit(" api_key=abc")), F.col("content"))).alias("content"),
        when(7, F.lit(2), F.lit(0)).alias("citation_count"),
        when(8, F.lit(1), F.lit(0)).alias("bad_citations"),
        when(9, F.lit("WHATEVER"), F.col("reason_code")).alias("reason_code"),
        F.when((n == 10) & (F.col("role") == "assistant"), "A general note.").otherwise(none).alias("reference_answer"),
        when(11, F.lit("everyone"), F.col("audience_scope")).alias("audience_scope"),
        when(12, F.lit("Asked on its own?"), none).alias("rewritten_question"),
        when(13, F.lit("m0-0"), F.col("reply_to_message_id")).alias("reply_to_message_id"),
        F.lit(False).alias("has_summary"),
        F.col("message_id").alias("stored_id"),
    )


_DAMAGED = {
    "d": "SELECT *, (conv_id * 10 + turn) % 23 AS k FROM stored_messages",
    "x": f"""SELECT *, CASE WHEN k = 1 THEN 'ID' WHEN k IN (2, 3) THEN 'ROLE_OR_STATUS' WHEN k = 4 THEN 'TIMESTAMP' WHEN k IN (5, 6) THEN 'CONTENT' WHEN NOT {_SAFE.format("content")} THEN 'CONTENT' WHEN k = 8 THEN 'CITATIONS' WHEN k = 9 THEN 'REASON_CODE'
      WHEN k = 11 THEN 'AUDIENCE_SCOPE' WHEN k = 12 AND role = 'assistant' THEN 'REWRITTEN_QUESTION' WHEN k IN (7, 13) AND role = 'user' THEN 'USER_METADATA' WHEN k = 7 AND status IN ('refused', 'error') THEN 'CITED_NON_ANSWER' END AS problem FROM d""",
}


@query(
    "flt13_sanitised_messages",
    sql(
        f"""SELECT CASE WHEN k = 1 THEN 'invalid-message' ELSE message_id END AS message_id, session_id, CASE WHEN problem IS NULL THEN role ELSE 'assistant' END AS role,
       CASE WHEN problem IS NOT NULL THEN '{fixed.CORRUPTED_TEXT}' WHEN status = 'error' THEN '{fixed.SAFE_ERROR_TEXT}' ELSE content END AS content, CASE WHEN problem IS NULL THEN status ELSE 'error' END AS status,
       CASE WHEN problem IS NULL AND k = 12 THEN 'Asked on its own?' END AS rewritten_question, CASE WHEN problem IS NULL THEN reason_code ELSE 'CHAT_UNAVAILABLE' END AS reason_code,
       CASE WHEN k = 4 THEN '{fixed.EPOCH_TEXT}' ELSE {_TIME.format("created_at")} END AS created_at, CASE WHEN problem IS NULL AND k = 13 THEN 'm0-0' WHEN problem IS NULL THEN reply_to_message_id END AS reply_to_message_id,
       CASE WHEN problem IS NULL AND k = 10 AND role = 'assistant' AND status <> 'error' THEN 'A general note.' END AS reference_answer, problem FROM x""",
        "stored_messages",
        extra=_DAMAGED,
    ),
)
def _(spark, folder):
    return cv.sanitise_messages(_damaged(spark, folder))


@query(
    "flt14_sanitised_feedback",
    sql(
        """SELECT event_id, message_id, helpful, reason FROM clicks WHERE event_id % 6 NOT IN (0, 1, 2) AND NOT (event_id % 6 = 3 AND helpful)""",
        "clicks",
    ),
)
def _(spark, folder):
    """Clicks of which some have a bad id, a bad time, a bad reason or a reason too many."""
    n = F.col("event_id") % 6
    rows = t.feedback_clicks(spark, folder).select(
        "event_id",
        F.when(n == 0, F.concat(F.lit(" "), "message_id")).otherwise(F.col("message_id")).alias("message_id"),
        "helpful",
        F.when(n == 2, "because").when((n == 3) & F.col("helpful"), "too_slow").otherwise(F.col("reason")).alias("reason"),
        F.when(n == 1, "2024-01-01T25:00:00Z").otherwise("2024-01-01T23:00:00Z").alias("created_at"),
    )
    return cv.sanitise_feedback(rows).select("event_id", "message_id", "helpful", "reason")


# --- appends -----------------------------------------------------------------------


@query(
    "mnt12_user_appends",
    sql(
        f"""
  WITH i AS (SELECT conv_id, turn, 'n' || conv_id || '-' || turn AS message_id, CASE WHEN conv_id % 9 = 4 THEN 'nowhere' ELSE 's' || conv_id END AS session_id, CASE WHEN (conv_id + turn) % 7 = 2 THEN '  ' ELSE content END AS content, created_at FROM messages WHERE role = 'user'),
       c AS (SELECT *, CASE WHEN session_id = 'nowhere' THEN 'UNKNOWN_SESSION' WHEN trim(content) = '' THEN 'EMPTY_MESSAGE' WHEN NOT {_SAFE.format("content")} THEN 'UNSAFE_MESSAGE' END AS problem FROM i),
       f AS (SELECT session_id, arg_min(message_id, (created_at, message_id)) AS first_id FROM c WHERE problem IS NULL AND conv_id % 2 = 0 GROUP BY 1)
  SELECT message_id, session_id, CASE WHEN problem IS NULL THEN 'submitted' END AS status, problem, CASE WHEN message_id = first_id THEN {_TITLE} END AS session_title FROM c LEFT JOIN f USING (session_id)""",
        "messages",
    ),
)
def _(spark, folder):
    """User turns appended anew; odd conversations were already asked something."""
    asked = t.messages(spark, folder).where("role = 'user'")
    incoming = asked.select(
        F.concat(F.lit("n"), "conv_id", F.lit("-"), "turn").alias("message_id"),
        F.when(F.col("conv_id") % 9 == 4, "nowhere").otherwise(F.col("session_id")).alias("session_id"),
        F.when((F.col("conv_id") + F.col("turn")) % 7 == 2, "  ").otherwise(F.col("content")).alias("content"),
        "created_at",
    )
    return cv.append_user_messages(incoming, t.sessions(spark, folder), asked.where("conv_id % 2 = 1"))


@query(
    "mnt12_rewrites",
    sql(
        """SELECT message_id, rewritten_question, CASE WHEN trim(rewritten_question) = '' THEN 'EMPTY_MESSAGE' WHEN contains(rewritten_question, 'sk-') THEN 'UNSAFE_MESSAGE' WHEN role IS NULL THEN 'UNKNOWN_MESSAGE' WHEN role <> 'user' THEN 'NOT_A_USER_MESSAGE' END AS problem
       FROM (SELECT 'm' || conv_id || '-' || turn AS message_id, CASE turn % 5 WHEN 2 THEN ' ' WHEN 3 THEN 'use sk-abc' ELSE 'question ' || turn END AS rewritten_question FROM conversations) LEFT JOIN messages USING (message_id)""",
        "messages",
    ),
)
def _(spark, folder):
    n = F.col("turn") % 5
    rewrites = t.load(spark, folder, "conversations").select(
        F.concat(F.lit("m"), "conv_id", F.lit("-"), "turn").alias("message_id"),
        F.when(n == 2, " ").when(n == 3, "use sk-abc").otherwise(F.concat(F.lit("question "), "turn")).alias("rewritten_question"),
    )
    return cv.attach_rewrites(t.messages(spark, folder), rewrites)


@query(
    "str4_first_replies_batch",
    sql(
        """SELECT reply_to_message_id, message_id FROM retried WHERE role = 'assistant' AND reply_to_message_id NOT IN (SELECT reply_to_message_id FROM messages WHERE reply_to_message_id IS NOT NULL AND conv_id % 3 = 0)
       QUALIFY row_number() OVER (PARTITION BY reply_to_message_id ORDER BY created_at, message_id) = 1""",
        "retried",
    ),
)
def _(spark, folder):
    replies = t.retried_messages(spark, folder).where("role = 'assistant'")
    held = t.messages(spark, folder).where("role = 'assistant' and conv_id % 3 = 0")
    return cv.first_replies(replies, held).select("reply_to_message_id", "message_id")
