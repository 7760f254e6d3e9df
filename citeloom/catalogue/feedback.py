"""Feedback queries: redaction, cases, triage, review, promotion, retention."""

from pyspark.sql import functions as F

from citeloom import fixed
from citeloom.catalogue import query
from citeloom.catalogue.sqlbase import fold, sql
from citeloom.catalogue.tidy import tidy
from citeloom.functions import redaction as rd
from citeloom.functions import text as tx
from citeloom.operators import contracts, feedback as fb
from citeloom.session import spread
from citeloom.sources import tables as t

NOW = "2024-06-01 12:00:00"
_ID = "'fc_' || substr(sha256({0}), 1, 32)"


def now():
    return F.to_timestamp(F.lit(NOW))


def projected(spark, folder):
    return fb.project_cases(t.messages(spark, folder), t.feedback_clicks(spark, folder), now())


def scored(spark, folder):
    """Cases with triage; risk, follow-ups and latency come from the case id."""
    cases, _events = projected(spark, folder)
    nibble = lambda i: F.substring("case_id", i, 1)
    return fb.score_cases(
        cases.withColumns(
            {
                "high_risk": nibble(4) == "0",
                "repeated_followup": nibble(5).isin("1", "2"),
                "latency_bucket": F.when(nibble(6) < "4", "slow"),
                "version_mismatch": F.col("feedback_reason") == "version_mismatch",
                "citation_mismatch": F.col("feedback_reason") == "citation_mismatch",
            }
        )
    )


_CASES = {
    "fbk": "SELECT * FROM clicks QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY created_at DESC, event_id DESC) = 1",
    "cs": f"""SELECT {_ID.format("a.message_id")} AS case_id, sha256(a.message_id) AS message_id_hash, sha256(a.session_id) AS session_id_hash, trim(u.content) AS question, trim(a.content) AS answer, a.status, a.reason_code,
      f.reason AS feedback_reason, f.helpful, f.created_at AS event_at, f.event_id IS NOT NULL AS has_event FROM stored_messages a LEFT JOIN messages u ON u.message_id = a.reply_to_message_id AND u.role = 'user' LEFT JOIN fbk f ON f.message_id = a.message_id WHERE a.role = 'assistant'""",
    "sc0": """SELECT *, substr(case_id, 4, 1) = '0' AS risk, coalesce(feedback_reason = 'version_mismatch', false) AS vm, coalesce(feedback_reason = 'citation_mismatch', false) AS cm, status IN ('error', 'refused') AS failed,
      substr(case_id, 5, 1) IN ('1', '2') AS rep, substr(case_id, 6, 1) < '4' AS slow FROM cs""",
    "sc1": """SELECT *, (5 * risk::INT + 4 * vm::INT + 4 * cm::INT + 4 * failed::INT + 2 * rep::INT + slow::INT)::BIGINT AS score,
      list_filter([CASE WHEN risk THEN 'high_risk' END, CASE WHEN vm THEN 'version_mismatch' END, CASE WHEN cm THEN 'citation_mismatch' END, CASE WHEN failed THEN 'answer_' || status END, CASE WHEN rep THEN 'repeated_followup' END, CASE WHEN slow THEN 'slow_response' END], lambda x: x IS NOT NULL) AS reasons FROM sc0""",
    "sc": "SELECT *, CASE WHEN risk THEN 'P0' WHEN score >= 7 THEN 'P1' WHEN score >= 3 THEN 'P2' ELSE 'P3' END AS priority FROM sc1",
}
_NEED = ("stored_messages", "clicks")


# --- redaction -----------------------------------------------------------------------


def redacted_sql(text: str) -> str:
    """Stops, and the rules for mail, web and number; those for names and labels would show as a difference."""
    clean = rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"
    mail = rf"regexp_replace({clean}, '[^\s@]+@[^\s@]+\.[A-Za-z]{{2,}}($|[^\p{{L}}\p{{N}}_.-])', '[email]\1', 'g')"
    web = rf"regexp_replace({mail}, 'https?://[^\s]+', '[contact]', 'gi')"
    phone = rf"regexp_replace({web}, '(^|[^0-9])1[3-9][0-9]{{9}}($|[^0-9])', '\1[phone]\2', 'g')"
    number = rf"regexp_replace({phone}, '(^|[^0-9])([0-9]{{17}}[0-9Xx]|[0-9]{{15}})($|[^0-9])', '\1[id_number]\3', 'g')"
    file = rf"regexp_matches({clean}, '(?i)\[附件|data:(image|application)/|(^|\s)[^\s]+\.(jpg|jpeg|png|gif|pdf|docx?)($|[^\p{{L}}\p{{N}}_])')"
    why = f"CASE WHEN {text} IS NULL THEN 'invalid_input' WHEN {clean} = '' THEN 'empty_text' WHEN {file} THEN 'attachment' END"
    return f"""{{'why': {why}, 'shown': {number}, 'met': list_filter(['email', 'contact', 'phone', 'id_number'],
      lambda k: contains({number}, '[' || k || ']') AND NOT contains({text}, '[' || k || ']'))}}"""


def shown_sql(r: str) -> tuple[str, str]:
    """Status and text of what :func:`redacted_sql` found."""
    status = f"CASE WHEN {r}.why = 'empty_text' THEN 'review_required' WHEN {r}.why IS NOT NULL THEN 'blocked' ELSE 'passed' END"
    shown = f"CASE WHEN {r}.why = 'empty_text' THEN '{fixed.EMPTY_TEXT}' WHEN {r}.why IS NOT NULL THEN '{fixed.BLOCKED_TEXT}' ELSE {r}.shown END"
    return status, shown


@query(
    "fn15_redacted_documents",
    f"""WITH d AS (SELECT doc_id, {redacted_sql("text")} AS r FROM documents)
  SELECT doc_id, {shown_sql("r")[0]} AS status, {shown_sql("r")[1]} AS text, CASE WHEN r.why IS NOT NULL THEN r.why ELSE array_to_string(r.met, '|') END AS flags FROM d""",
)
def _(spark, folder):
    docs = spread(t.load(spark, folder, "documents")).withColumn("r", rd.redact_text(F.col("text")))
    return tidy(docs.select("doc_id", "r.status", "r.text", "r.flags"))


@query(
    "fn15_redacted_pairs",
    f"""WITH d AS (SELECT doc_id, split_part(text, chr(10), 1) AS line, text FROM documents),
  e AS (SELECT doc_id, {redacted_sql("line")} AS q, {redacted_sql("text")} AS a FROM d)
  SELECT doc_id, {shown_sql("q")[0]} AS question_status, {shown_sql("q")[1]} AS question_text, {shown_sql("a")[0]} AS answer_status, {shown_sql("a")[1]} AS answer_text,
    array_to_string(list_concat(
      CASE WHEN q.why IS NOT NULL THEN [q.why] ELSE q.met END,
      list_filter(CASE WHEN a.why IS NOT NULL THEN [a.why] ELSE a.met END, lambda f: NOT list_contains(CASE WHEN q.why IS NOT NULL THEN [q.why] ELSE q.met END, f))), '|') AS flags FROM e""",
)
def _(spark, folder):
    """Each document's first line as the question and its text as the answer."""
    docs = spread(t.load(spark, folder, "documents")).withColumn(
        "r", rd.redact_interaction(F.element_at(F.split("text", "\n"), 1), F.col("text"))
    )
    return tidy(docs.select("doc_id", "r.*"))


@query(
    "fn15_masked_numbers",
    r"""SELECT doc_id, regexp_matches(text, '(^|[^0-9])([0-9]{17}[0-9Xx]|[0-9]{15})($|[^0-9])') AS held_id_number, regexp_matches(text, '(^|[^0-9])(19|20)[0-9]{2}($|[^0-9])') AS held_year FROM documents""",
)
def _(spark, folder):
    """Which rule placeholders the fixed rules put where the SQL sees an identifier."""
    text = F.col("text")
    rows = t.load(spark, folder, "documents").select(
        "doc_id",
        text.rlike(fixed.ID_NUMBER).alias("held_id_number"),
        text.rlike(r"(?<!\d)(?:19|20)\d{2}(?!\d)").alias("held_year"),
        rd.mask_fixed_rules(text).alias("masked"),
    )
    # A masked text may not hold either any more; this fails the query if one does.
    clean = ~F.col("masked").rlike(fixed.ID_NUMBER)
    checked = F.when(clean, F.col("held_id_number")).otherwise(F.raise_error(F.lit("identifier left")).cast("boolean"))
    return rows.select("doc_id", checked.alias("held_id_number"), "held_year")


@query(
    "fn16_residual_identifiers",
    r"""
  WITH b AS (SELECT doc_id, regexp_replace(text, '\[[^\]]+\]', '', 'g') AS x FROM documents)
  SELECT doc_id, regexp_matches(x, '(^|[^0-9])1[3-9][0-9]{9}($|[^0-9])') OR regexp_matches(x, '(^|[^0-9])([0-9]{17}[0-9Xx]|[0-9]{15})($|[^0-9])')
         OR regexp_matches(x, '[^\s@]+@[^\s@]+\.[A-Za-z]{2,}($|[^\p{L}\p{N}_.-])') OR regexp_matches(x, '(?i)(^|[^\p{L}\p{N}_])(MRN|EMR|CASE|ADMISSION)[-_]?[A-Za-z0-9]{4,}($|[^\p{L}\p{N}_])')
         OR regexp_matches(x, '(?i)https?://[^\s]+(token|access_token|code|key)=[^\s&#]+') OR regexp_matches(x, '(?i)(^|[^\p{L}\p{N}_])(Bearer\s+[A-Za-z0-9._-]{11,}[A-Za-z0-9_]|(sk|key|token)[-_:=][A-Za-z0-9._-]{7,}[A-Za-z0-9_])($|[^\p{L}\p{N}_])')
         OR regexp_matches(x, '(^|[^A-Za-z])[A-Z]{2,8}[-_]?[0-9]{10,}') AS found FROM b""",
)
def _(spark, folder):
    docs = t.load(spark, folder, "documents")
    return docs.select("doc_id", rd.contains_identifier(F.col("text")).alias("found"))


@query(
    "fn13_question_fingerprints",
    rf"SELECT conv_id, turn, sha256(regexp_replace({fold('text')}, '[^\p{{L}}\p{{N}}]', '', 'g')) AS fingerprint FROM conversations",
)
def _(spark, folder):
    turns = t.load(spark, folder, "conversations")
    return turns.select("conv_id", "turn", tx.question_fingerprint(F.col("text")).alias("fingerprint"))


@query(
    "fn18_json_columns",
    """SELECT event_id, CASE WHEN event_id % 10 = 3 THEN 0 ELSE (props::JSON->>'k')::BIGINT END AS k, event_id % 10 <> 3 AS parsed FROM events""",
)
def _(spark, folder):
    """Event properties, a tenth of them broken, with zero as the fallback."""
    raw = F.when(F.col("event_id") % 10 == 3, F.concat(F.lit("{broken "), "props")).otherwise(F.col("props"))
    parsed = F.from_json(raw, "k bigint", {"mode": "PERMISSIVE"})["k"]
    rows = t.load(spark, folder, "events").select("event_id", parsed.alias("p"))
    return rows.select("event_id", F.coalesce("p", F.lit(0)).cast("bigint").alias("k"), F.col("p").isNotNull().alias("parsed"))


@query(
    "fn19_citation_ids",
    """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'u' || user_id || '|x' WHEN user_id = event_id % 7 THEN 'm' || user_id ELSE 'm' || user_id || '|m' || (event_id % 7) END AS ids FROM events""",
)
def _(spark, folder):
    n, user = F.col("event_id"), F.col("user_id")
    trace = F.when(
        n % 3 == 0,
        F.array(F.concat(F.lit(" u"), user), F.lit("x"), F.lit("two words"), F.lit("x"), F.lit(""), F.repeat(F.lit("y"), F.lit(161))),
    )
    own = F.array(F.concat(F.lit("m"), user), F.concat(F.lit("m"), n % 7))
    return tidy(t.load(spark, folder, "events").select("event_id", fb.citation_ids(trace, own).alias("ids")))


@query(
    "prj5_case_identity",
    sql(
        f"SELECT message_id, {_ID.format('message_id')} AS case_id, sha256(message_id) AS message_id_hash, sha256(session_id) AS session_id_hash FROM messages",
        "messages",
    ),
)
def _(spark, folder):
    rows = t.messages(spark, folder).withColumns(fb.case_identity(F.col("message_id"), F.col("session_id")))
    return rows.select("message_id", "case_id", "message_id_hash", "session_id_hash")


# --- projection and triage --------------------------------------------------------------


@query(
    "mnt9_projected_cases",
    sql(
        f"""SELECT case_id, message_id_hash, session_id_hash, '{NOW}' AS collected_at, question AS question_redacted, answer AS answer_redacted, 'passed' AS redaction_status, '' AS redaction_flags,
       status AS answer_status, reason_code, '2024-08-30 12:00:00' AS retention_expires_at, has_event::BIGINT AS event_count FROM cs""",
        *_NEED,
        extra=_CASES,
    ),
)
def _(spark, folder):
    cases, _events = projected(spark, folder)
    return tidy(
        cases, "case_id", "message_id_hash", "session_id_hash", "collected_at", "question_redacted", "answer_redacted",
        "redaction_status", "redaction_flags", "answer_status", "reason_code", "retention_expires_at", "event_count",
    )


@query(
    "mnt9_projected_events",
    sql(
        """SELECT 'fe_' || substr(sha256(case_id || '|' || strftime(event_at, '%Y-%m-%dT%H:%M:%S.%f') || '|' || helpful::INT || '|' || coalesce(feedback_reason, '')), 1, 32) AS event_id, case_id, helpful, feedback_reason FROM cs WHERE has_event""",
        *_NEED,
        extra=_CASES,
    ),
)
def _(spark, folder):
    _cases, events = projected(spark, folder)
    return events.select("event_id", "case_id", "helpful", "feedback_reason")


@query(
    "mnt9_new_cases",
    sql(
        "SELECT case_id, 'new' AS fate FROM cs WHERE substr(case_id, 4, 1) >= '4' UNION ALL SELECT case_id, 'conflict' FROM cs WHERE substr(case_id, 4, 1) < '2'",
        *_NEED,
        extra=_CASES,
    ),
)
def _(spark, folder):
    """A quarter of the cases is stored already, half of those under another session."""
    cases, _events = projected(spark, folder)
    head = F.substring("case_id", 4, 1)
    held = cases.where(head < "4").withColumn(
        "session_id_hash", F.when(head < "2", F.sha2("session_id_hash", 256)).otherwise(F.col("session_id_hash"))
    )
    fresh, conflicts = fb.new_cases(cases, held)
    return fresh.select("case_id", F.lit("new").alias("fate")).union(conflicts.select("case_id", F.lit("conflict")))


@query(
    "agg22_triage_scores",
    sql("SELECT case_id, score AS triage_score, array_to_string(reasons, '|') AS triage_reasons, priority AS triage_priority FROM sc", *_NEED, extra=_CASES),
)
def _(spark, folder):
    return tidy(scored(spark, folder), "case_id", "triage_score", "triage_reasons", "triage_priority")


@query(
    "agg23_question_groups",
    sql(
        rf"""
  WITH g AS (SELECT *, sha256(regexp_replace({fold("question")}, '[^\p{{L}}\p{{N}}]', '', 'g')) AS fp FROM sc),
       a AS (SELECT fp, arg_min(case_id, (priority, -score, case_id)) AS case_id, sum(has_event::INT)::BIGINT AS event_count, count(*) AS case_count FROM g GROUP BY fp)
  SELECT a.case_id, a.fp AS fingerprint, g.priority AS triage_priority, g.score AS triage_score, array_to_string(CASE WHEN case_count > 1 THEN list_append(reasons, 'duplicate_question') ELSE reasons END, '|') AS triage_reasons, a.event_count, a.case_count
  FROM a JOIN g USING (case_id)""",
        *_NEED,
        extra=_CASES,
    ),
)
def _(spark, folder):
    """Cases grouped by their question."""
    return tidy(fb.group_questions(scored(spark, folder)))


@query(
    "mnt11_success_sample",
    sql(
        """SELECT case_id, array_to_string(CASE WHEN status = 'answered' AND len(reasons) = 0 AND ('0x' || substr(sha256(case_id), 1, 8))::BIGINT % 3 = 0 THEN ['random_success_sample'] ELSE reasons END, '|') AS triage_reasons FROM sc""",
        *_NEED,
        extra=_CASES,
    ),
)
def _(spark, folder):
    return tidy(fb.mark_success_sample(scored(spark, folder), 3), "case_id", "triage_reasons")


@query(
    "agg31_run_counters",
    sql(
        """SELECT count(*) AS cases_seen, count(*) AS redaction_passed, 0::BIGINT AS redaction_review_required, 0::BIGINT AS redaction_blocked, count(*) FILTER (priority = 'P0') AS p0, count(*) FILTER (priority = 'P1') AS p1,
       count(*) FILTER (priority = 'P2') AS p2, count(*) FILTER (priority = 'P3') AS p3, count(*) FILTER (has_event) AS events_seen FROM sc""",
        *_NEED,
        extra=_CASES,
    ),
)
def _(spark, folder):
    _cases, events = projected(spark, folder)
    return tidy(fb.run_counters(scored(spark, folder), events))


# --- review ---------------------------------------------------------------------------------


def case_reviews(spark, folder):
    """Label rows as reviews of the message with the same number."""
    n = F.col("doc_id")
    message = F.concat(F.lit("m"), F.floor(n / 8), F.lit("-"), n % 8)
    return t.reviews(spark, folder).withColumn(
        "case_id", F.concat(F.lit("fc_"), F.substring(F.sha2(message, 256), 1, 32))
    )


_REVIEWS = {
    **_CASES,
    "rv": f"""SELECT 'rv_' || doc_id AS review_id, doc_id, {_ID.format("'m' || (doc_id // 8) || '-' || (doc_id % 8)")} AS case_id, CASE doc_id % 3 WHEN 0 THEN 'clinical_reviewer' WHEN 1 THEN 'product' ELSE 'engineering' END AS role,
      CASE WHEN quality = 1 THEN 'approve' WHEN toxic = 0 THEN 'needs_adjudication' ELSE 'reject' END AS decision, CASE WHEN doc_id % 5 <> 0 THEN quality = 1 END AS evidence_ok, quality = 1 AS points_ok, toxic = 0 AS safety_ok FROM labels""",
    "rs": """SELECT sc.*, CASE (SELECT arg_max(decision, doc_id) FROM rv WHERE rv.case_id = sc.case_id) WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' WHEN 'needs_adjudication' THEN 'adjudication_required' ELSE 'unreviewed' END AS review_status FROM sc""",
}


def reviewed(spark, folder):
    return fb.apply_reviews(scored(spark, folder), case_reviews(spark, folder))


@query(
    "mnt8_reviewed_cases",
    sql("SELECT case_id, review_status FROM rs", *_NEED, extra=_REVIEWS),
)
def _(spark, folder):
    return reviewed(spark, folder)[0].select("case_id", "review_status")


@query(
    "mnt8_review_problems",
    sql("SELECT review_id, case_id, 'UNKNOWN_CASE' AS problem FROM rv WHERE case_id NOT IN (SELECT case_id FROM sc)", *_NEED, extra=_REVIEWS),
)
def _(spark, folder):
    return reviewed(spark, folder)[1]


@query(
    "flt9_review_queue",
    sql(
        "SELECT case_id, priority AS triage_priority, status AS answer_status FROM rs WHERE review_status = 'unreviewed' AND status = 'refused' ORDER BY priority, case_id LIMIT 25",
        *_NEED,
        extra=_REVIEWS,
    ),
)
def _(spark, folder):
    cases, _bad = reviewed(spark, folder)
    queue = fb.review_queue(cases, limit=25, review_status="unreviewed", answer_status="refused")
    return queue.select("case_id", "triage_priority", "answer_status")


@query(
    "prj4_safe_case_view",
    sql(
        f"""SELECT case_id, CASE WHEN v THEN question END AS question, CASE WHEN v THEN answer END AS answer, CASE WHEN v THEN substr(trim(string_split(question, chr(10))[1]), 1, 120) ELSE '{fixed.HIDDEN_PREVIEW}' END AS question_preview,
       CASE WHEN v THEN 'passed' ELSE 'review_required' END AS redaction_status, status AS answer_status, CASE WHEN status = 'error' THEN NULL ELSE reason_code END AS reason_code, CASE WHEN v THEN 2 ELSE 0 END::BIGINT AS citation_count,
       priority AS triage_priority, review_status, 'not_promoted' AS promotion_status FROM (SELECT *, substr(case_id, 7, 1) > '3' AS v FROM rs)""",
        *_NEED,
        extra=_REVIEWS,
    ),
)
def _(spark, folder):
    """A quarter of the cases may not be shown, and error codes are malformed."""
    cases, _bad = reviewed(spark, folder)
    rows = cases.withColumns(
        {
            "redaction_status": F.when(F.substring("case_id", 7, 1) > "3", "passed").otherwise("review_required"),
            "reason_code": F.when(F.col("answer_status") == "error", "has space").otherwise(F.col("reason_code")),
            "citation_count": F.lit(2),
        }
    )
    return tidy(fb.safe_case_view(rows))


@query(
    "agg20_review_summary",
    sql(
        """SELECT 'cases_total' AS key, count(*) AS count FROM rs UNION ALL SELECT 'priority_' || priority, count(*) FROM rs GROUP BY priority UNION ALL SELECT 'review_' || review_status, count(*) FROM rs GROUP BY review_status
       UNION ALL SELECT 'promotion_not_promoted', count(*) FROM rs""",
        *_NEED,
        extra=_REVIEWS,
    ),
)
def _(spark, folder):
    return fb.review_summary(reviewed(spark, folder)[0])


# --- promotion ---------------------------------------------------------------------------------

_PROMOTED = {
    **_REVIEWS,
    "rg": """SELECT case_id, count(*) AS n, bool_or(decision = 'needs_adjudication') AS adj, bool_or(decision = 'reject') AS rej, bool_or(decision = 'approve' AND coalesce(evidence_ok, false) AND points_ok AND safety_ok) AS app,
      bool_or(decision = 'approve' AND coalesce(evidence_ok, false) AND points_ok AND safety_ok AND role = 'clinical_reviewer') AS clin FROM rv GROUP BY 1""",
    "pg": """SELECT sc.case_id, CASE WHEN status IN ('refused', 'error') THEN CASE WHEN e IN ('0', '1') THEN 'negative_corpus_check_missing' WHEN e = '2' THEN 'full_corpus_check_missing' WHEN e = '3' THEN 'supporting_evidence_found' WHEN e = '4' THEN 'corpus_version_missing' END
        ELSE CASE WHEN e = '0' THEN 'evidence_check_missing' WHEN e = '1' THEN 'citation_chunk_missing' WHEN e = '2' THEN 'necessary_evidence_missing' WHEN e = '3' THEN 'atomic_points_missing' WHEN e = '4' THEN 'traceability_missing' WHEN e = '5' THEN 'source_version_missing' END END AS f1,
      CASE WHEN n IS NULL THEN 'review_missing' WHEN adj THEN 'review_adjudication_required' WHEN rej THEN 'review_rejected' WHEN NOT app THEN 'review_approval_missing' WHEN priority IN ('P0', 'P1') AND NOT clin THEN 'clinical_review_required' END AS f2, rep
      FROM (SELECT *, substr(case_id, 8, 1) AS e FROM sc) sc LEFT JOIN rg USING (case_id)""",
    "pd": "SELECT case_id, CASE WHEN rep THEN 'holdout_cannot_be_tuning_input' ELSE coalesce(f1, f2) END AS fault FROM pg",
}


def decisions(spark, folder):
    """Holdout decisions; the checks behind each case follow from its id."""
    e = F.substring("case_id", 8, 1)
    cases = scored(spark, folder).withColumns(
        {
            "triage_reasons": F.when(
                F.col("repeated_followup"), F.array_append("triage_reasons", "tuning_input")
            ).otherwise(F.col("triage_reasons")),
            "source_version": F.when(e != "5", "v1"),
            "reason_code": F.lit(None).cast("string"),
        }
    )
    evidence = cases.where(e != "0").select(
        "case_id",
        (e != "1").alias("evidence_valid"),
        F.when(e == "1", "citation_chunk_missing").alias("evidence_reason"),
        F.when(e == "2", 0).otherwise(2).alias("necessary_count"),
        (e != "3").alias("atomic_points_ok"),
        (e != "4").alias("traceable"),
    )
    corpus = cases.where(~e.isin("0", "1")).select(
        "case_id",
        (e != "2").alias("full_corpus_checked"),
        (e != "3").alias("no_supporting_evidence"),
        F.when(e != "4", "corpus-1").alias("corpus_version"),
    )
    return fb.promotion_decisions(cases, case_reviews(spark, folder), evidence, corpus, "holdout")


@query(
    "mnt6_promotion_gate",
    sql(
        "SELECT case_id, CASE WHEN fault IS NULL THEN 'golden_v2_candidate' ELSE 'not_promoted' END AS status, coalesce(fault, 'review_approved') AS reason FROM pd", *_NEED, extra=_PROMOTED
    ),
)
def _(spark, folder):
    return decisions(spark, folder)


@query(
    "mnt7_promotion_records",
    sql(
        """SELECT 'pr_' || substr(sha256(case_id || '|set-1|v1|holdout|man-1'), 1, 32) AS promotion_id, case_id, 'set-1' AS target_set_id, 'v1' AS target_version, 'holdout' AS target_split, 'review_approved' AS promotion_reason, 'man-1' AS manifest_id
       FROM pd WHERE fault IS NULL AND substr(case_id, 9, 1) >= '4'""",
        *_NEED,
        extra=_PROMOTED,
    ),
)
def _(spark, folder):
    """Records of promotable cases, some of which were recorded before."""
    made = decisions(spark, folder)
    args = {"set_id": "set-1", "version": "v1", "split": "holdout", "manifest_id": "man-1"}
    none = spark.createDataFrame([], "promotion_id string")
    before = fb.promotion_records(made.where(F.substring("case_id", 9, 1) < "4"), none, **args)
    return fb.promotion_records(made, before, **args)


# --- bad cases -----------------------------------------------------------------------------------


def opened(spark, folder):
    from citeloom.streaming.flows import valid_feedback

    valid = valid_feedback(t.feedback_clicks(spark, folder), t.messages(spark, folder))
    none = spark.createDataFrame([], "message_id string, code string")
    return fb.open_bad_cases(valid, none)


def lifecycle(spark, folder):
    cases = opened(spark, folder)
    steps = F.array(*[F.lit(s) for s in ("triaged", "fixed", "regression_checked", "closed", "triaged")])
    clicks = t.feedback_clicks(spark, folder).where("reason is not null")
    log = clicks.select(
        "message_id",
        tx.mapped(F.col("reason"), fixed.FEEDBACK_CODES).alias("code"),
        F.element_at(steps, (F.col("event_id") % 5 + 1).cast("int")).alias("target_status"),
        F.col("event_id").alias("seq"),
    ).join(cases.select("message_id", "code", "case_id"), ["message_id", "code"]).select("case_id", "target_status", "seq")
    return cases, fb.bad_case_lifecycle(cases, log)


_BAD = {
    "bc": """SELECT DISTINCT message_id, upper('user_feedback_' || reason) AS code, 'bc_' || substr(sha256(message_id || chr(10) || upper('user_feedback_' || reason)), 1, 32) AS case_id FROM valid_clicks WHERE reason IS NOT NULL""",
    "lg": """SELECT case_id, ['triaged', 'fixed', 'regression_checked', 'closed', 'triaged'][event_id % 5 + 1] AS target, event_id AS seq FROM clicks JOIN bc ON bc.message_id = clicks.message_id AND bc.code = upper('user_feedback_' || reason)""",
    "s1": "SELECT case_id, min(seq) AS at1 FROM lg WHERE target = 'triaged' GROUP BY 1",
    "s2": "SELECT case_id, min(seq) AS at2 FROM lg JOIN s1 USING (case_id) WHERE target = 'fixed' AND seq > at1 GROUP BY 1",
    "s3": "SELECT case_id, min(seq) AS at3 FROM lg JOIN s2 USING (case_id) WHERE target = 'regression_checked' AND seq > at2 GROUP BY 1",
    "s4": "SELECT case_id, min(seq) AS at4 FROM lg JOIN s3 USING (case_id) WHERE target = 'closed' AND seq > at3 GROUP BY 1",
    "lc": """SELECT case_id, code, CASE WHEN at4 IS NOT NULL THEN 4 WHEN at3 IS NOT NULL THEN 3 WHEN at2 IS NOT NULL THEN 2 WHEN at1 IS NOT NULL THEN 1 ELSE 0 END AS done, (SELECT count(*) FROM lg WHERE lg.case_id = bc.case_id) AS n
      FROM bc LEFT JOIN s1 USING (case_id) LEFT JOIN s2 USING (case_id) LEFT JOIN s3 USING (case_id) LEFT JOIN s4 USING (case_id)""",
    "st": "SELECT *, ['new', 'triaged', 'fixed', 'regression_checked', 'closed'][done + 1] AS status FROM lc",
}


@query("mnt5_opened_bad_cases", sql("SELECT case_id, message_id, code, 'new' AS status FROM bc", "valid_clicks", extra=_BAD))
def _(spark, folder):
    return opened(spark, folder)


@query(
    "mnt5_bad_case_lifecycle",
    sql("SELECT case_id, status, done::BIGINT AS accepted, n - done AS refused FROM st", "valid_clicks", extra=_BAD),
)
def _(spark, folder):
    return tidy(lifecycle(spark, folder)[1])


def _current(spark, folder):
    cases, reached = lifecycle(spark, folder)
    return cases.drop("status").join(reached.select("case_id", "status"), "case_id")


@query(
    "agg19_bad_case_counts",
    sql("SELECT code, status, count(*) AS count FROM st GROUP BY ALL", "valid_clicks", extra=_BAD),
)
def _(spark, folder):
    return fb.bad_case_counts(_current(spark, folder))


@query(
    "snk5_bad_case_export",
    sql(
        "SELECT 'code' AS kind, code AS value, count(*) AS count FROM st GROUP BY code UNION ALL SELECT 'status', status, count(*) FROM st GROUP BY status", "valid_clicks", extra=_BAD
    ),
)
def _(spark, folder):
    return fb.bad_case_export(_current(spark, folder))


# --- retention and contracts ------------------------------------------------------------------------


def _aged(spark, folder):
    """Cases whose retention text is early, late, without offset or broken."""
    head = F.substring("case_id", 4, 1)
    text = (
        F.when(head < "4", "2024-08-01T00:00:00+00:00")
        .when(head < "8", "2024-09-01T12:00:00")
        .when(head < "c", "2024-12-01T00:00:00+00:00")
        .otherwise("someday")
    )
    return scored(spark, folder).withColumn("retention_expires_at", text)


@query(
    "mnt10_retention_purge",
    sql(
        """WITH gone AS (SELECT case_id, has_event FROM sc WHERE substr(case_id, 4, 1) < '8')
       SELECT (SELECT count(*) FROM gone) AS cases_deleted, (SELECT count(*) FROM gone WHERE has_event) AS events_deleted, (SELECT count(*) FROM rv WHERE case_id IN (SELECT case_id FROM gone)) AS reviews_deleted""",
        *_NEED,
        extra=_REVIEWS,
    ),
)
def _(spark, folder):
    cases = _aged(spark, folder)
    _cases, events = projected(spark, folder)
    expired = fb.expired_cases(cases, F.to_timestamp(F.lit("2024-09-01T12:00:00Z")))
    _kept, counts = fb.purge(expired, cases=cases, events=events, reviews=case_reviews(spark, folder))
    return counts


@query(
    "flt15_case_contracts",
    sql(
        """
  SELECT case_id, rule FROM sc, (VALUES ('0', 'message_id_hash'), ('1', 'redaction_status'), ('2', 'citation_count'), ('3', 'collected_at'), ('4', 'audience_scope'), ('5', 'triage_score')) r(h, rule) WHERE substr(case_id, 10, 1) = h""",
        *_NEED,
        extra=_CASES,
    ),
)
def _(spark, folder):
    h = F.substring("case_id", 10, 1)
    text = F.date_format("collected_at", "yyyy-MM-dd'T'HH:mm:ss")
    rows = scored(spark, folder).withColumns(
        {
            "message_id_hash": F.when(h == "0", "zz").otherwise(F.col("message_id_hash")),
            "redaction_status": F.when(h == "1", "fine").otherwise(F.col("redaction_status")),
            "citation_count": F.when(h == "2", -1).otherwise(0),
            "retention_expires_at": F.date_format("retention_expires_at", "yyyy-MM-dd'T'HH:mm:ss"),
            "audience_scope": F.when(h == "4", "everyone").otherwise(F.col("audience_scope")),
            "triage_score": F.when(h == "5", -1).otherwise(F.col("triage_score")),
            "collected_at": F.when(h == "3", "yesterday").otherwise(text),
        }
    )
    return contracts.case_violations(rows)


@query(
    "flt15_event_and_review_contracts",
    """SELECT 'e' || event_id AS id, 'source' AS rule FROM events WHERE event_id % 19 = 3 UNION ALL SELECT 'e' || event_id, 'event_schema_version' FROM events WHERE event_id % 23 = 4
     UNION ALL SELECT 'rv_' || doc_id, 'decision' FROM labels WHERE doc_id % 11 = 5 UNION ALL SELECT 'rv_' || doc_id, 'reviewed_at' FROM labels WHERE doc_id % 13 = 6
     UNION ALL SELECT 'pr_' || doc_id, 'target_split' FROM labels WHERE doc_id % 7 = 2""",
)
def _(spark, folder):
    n = F.col("event_id")
    events = t.load(spark, folder, "events").select(
        F.concat(F.lit("e"), n).alias("event_id"),
        F.concat(F.lit("u"), "user_id").alias("case_id"),
        F.lit(True).alias("helpful"),
        F.lit(None).cast("string").alias("feedback_reason"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("event_at"),
        F.when(n % 19 == 3, "robot").otherwise("user_click").alias("source"),
        F.when(n % 23 == 4, 0).otherwise(1).alias("event_schema_version"),
    )
    d = F.col("doc_id")
    text = F.date_format("reviewed_at", "yyyy-MM-dd'T'HH:mm:ss")
    reviews = case_reviews(spark, folder).withColumns(
        {
            "decision": F.when(d % 11 == 5, "perhaps").otherwise(F.col("decision")),
            "note_code": F.lit(None).cast("string"),
            "reviewed_at": F.when(d % 13 == 6, "noon").otherwise(text),
        }
    )
    records = t.load(spark, folder, "labels").select(
        F.concat(F.lit("pr_"), d).alias("promotion_id"),
        *[F.lit("x").alias(c) for c in ("case_id", "target_set_id", "target_version", "promotion_reason", "manifest_id")],
        F.when(d % 7 == 2, "train").otherwise("dev").alias("target_split"),
        F.lit("2024-01-01T00:00:00").alias("promoted_at"),
    )
    parts = [
        contracts.event_violations(events).toDF("id", "rule"),
        contracts.review_violations(reviews).toDF("id", "rule"),
        contracts.promotion_violations(records).toDF("id", "rule"),
    ]
    return parts[0].union(parts[1]).union(parts[2])
