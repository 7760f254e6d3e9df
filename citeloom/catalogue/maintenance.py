"""Table maintenance queries: versions, eligibility, metadata."""

from pyspark.sql import functions as F

from citeloom import fixed
from citeloom.catalogue import query
from citeloom.catalogue.sqlbase import sql
from citeloom.catalogue.tidy import tidy
from citeloom.functions import text as tx
from citeloom.operators import contracts, versions as vs
from citeloom.sources import tables as t

_LIVE = {
    "lv": """SELECT version_id, document_id, doc_id, file_name, sha256, CASE WHEN doc_id % 7 = 3 THEN 'indexing' WHEN doc_id % 7 = 4 THEN 'needs_ocr' ELSE status END AS status FROM versions"""
}


def mixed_versions(spark, folder):
    """Versions of which some are still indexing or wait for OCR."""
    n = F.col("doc_id") % 7
    return t.versions(spark, folder).withColumn(
        "status", F.when(n == 3, "indexing").when(n == 4, "needs_ocr").otherwise(F.col("status"))
    )


@query(
    "mnt1_index_decisions",
    sql(
        """
  WITH i AS (SELECT doc_id, upper(file_name) AS file_name, CASE WHEN doc_id % 5 = 2 THEN sha256('new' || doc_id) ELSE sha256 END AS sha256, doc_id % 11 = 5 AS ocr, doc_id % 13 = 6 AS force FROM versions),
       l AS (SELECT lower(file_name) AS k, sha256, arg_min(version_id, (o, version_id)) AS version_id, arg_min(status, (o, version_id)) AS status
             FROM (SELECT *, CASE status WHEN 'active' THEN 0 WHEN 'indexing' THEN 1 ELSE 2 END AS o FROM lv WHERE status IN ('active', 'indexing', 'needs_ocr')) GROUP BY ALL)
  SELECT i.file_name, i.sha256, CASE WHEN l.version_id IS NOT NULL AND NOT force THEN CASE l.status WHEN 'active' THEN 'skip' WHEN 'indexing' THEN 'in_progress' ELSE 'needs_ocr' END WHEN ocr THEN 'needs_ocr' ELSE 'index' END AS action,
         CASE WHEN NOT force THEN l.version_id END AS existing_version_id, CASE WHEN l.version_id IS NOT NULL AND NOT force THEN l.status WHEN ocr THEN 'needs_ocr' ELSE 'indexing' END AS status
  FROM i LEFT JOIN l ON l.k = lower(i.file_name) AND l.sha256 = i.sha256""",
        "versions",
        extra=_LIVE,
    ),
)
def _(spark, folder):
    n = F.col("doc_id")
    incoming = t.versions(spark, folder).select(
        F.upper("file_name").alias("file_name"),
        F.when(n % 5 == 2, F.sha2(F.concat(F.lit("new"), n), 256)).otherwise(F.col("sha256")).alias("sha256"),
        (n % 11 == 5).alias("needs_ocr"),
        (n % 13 == 6).alias("force"),
    )
    return vs.index_decisions(incoming, mixed_versions(spark, folder))


@query(
    "mnt2_activation",
    sql(
        """
  WITH c AS (SELECT document_id, version_id AS published FROM lv WHERE status = 'indexing' AND doc_id % 2 = 0)
  SELECT version_id, CASE WHEN version_id = published THEN 'active' WHEN published IS NOT NULL AND status = 'active' THEN 'superseded' ELSE status END AS status FROM lv LEFT JOIN c USING (document_id)""",
        "versions",
        extra=_LIVE,
    ),
)
def _(spark, folder):
    rows = mixed_versions(spark, folder)
    return vs.activate(rows, rows.where("doc_id % 2 = 0").select("version_id")).select("version_id", "status")


@query(
    "mnt2_activation_problems",
    sql(
        """SELECT version_id, CASE WHEN status IS NULL THEN 'UNKNOWN_VERSION' ELSE 'NOT_INDEXING' END AS problem FROM (SELECT 'v' || doc_id * 2 AS version_id FROM documents) LEFT JOIN lv USING (version_id) WHERE status IS NULL OR status <> 'indexing'""",
        "versions",
        extra=_LIVE,
    ),
)
def _(spark, folder):
    targets = t.load(spark, folder, "documents").select(F.concat(F.lit("v"), F.col("doc_id") * 2).alias("version_id"))
    return vs.activation_problems(mixed_versions(spark, folder), targets)


@query(
    "mnt3_transitions",
    sql(
        """
  WITH c AS (SELECT version_id, status, ['fail', 'mark_needs_ocr', 'begin_ocr_indexing'][doc_id % 3 + 1] AS command FROM lv),
       n AS (SELECT *, CASE WHEN command = 'fail' AND status IN ('indexing', 'needs_ocr') THEN 'failed' WHEN command = 'mark_needs_ocr' AND status = 'indexing' THEN 'needs_ocr' WHEN command = 'begin_ocr_indexing' AND status = 'needs_ocr' THEN 'indexing' END AS nxt FROM c)
  SELECT version_id, command, status AS status_before, coalesce(nxt, status) AS status_after, CASE WHEN command = 'fail' AND nxt IS NOT NULL THEN 'INDEX_FAILED' END AS failure_reason, nxt IS NOT NULL AS legal FROM n""",
        "versions",
        extra=_LIVE,
    ),
)
def _(spark, folder):
    rows = mixed_versions(spark, folder)
    names = F.array(F.lit("fail"), F.lit("mark_needs_ocr"), F.lit("begin_ocr_indexing"))
    commands = rows.select(
        "version_id", F.element_at(names, (F.col("doc_id") % 3 + 1).cast("int")).alias("command"), F.lit("INDEX_FAILED").alias("reason")
    )
    return vs.transitions(rows, commands)


@query(
    "jn8_deactivated_versions",
    sql("SELECT version_id, CASE WHEN status = 'active' AND document_id % 6 = 1 THEN 'inactive' ELSE status END AS status FROM versions", "versions"),
)
def _(spark, folder):
    rows = t.versions(spark, folder)
    present = rows.where("document_id % 6 <> 1").select(F.upper("file_name").alias("file_name"))
    return vs.deactivate_missing(rows, present, snapshot_complete=True).select("version_id", "status")


@query(
    "jn9_document_list",
    sql(
        """
  WITH s AS (SELECT * FROM lv QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY status = 'active' DESC, doc_id DESC) = 1), n AS (SELECT document_id, count(*) AS n FROM lv GROUP BY 1)
  SELECT document_id, version_id, file_name, status, sha256, n AS version_count, business_status, applicable_scope FROM s JOIN n USING (document_id) LEFT JOIN metadata USING (version_id)""",
        "versions",
        "metadata",
        extra=_LIVE,
    ),
)
def _(spark, folder):
    rows = vs.list_documents(mixed_versions(spark, folder), t.business_metadata(spark, folder))
    return tidy(rows, "document_id", "version_id", "file_name", "status", "sha256", "version_count", "business_status", "applicable_scope")


_ELIGIBLE = {
    "pr": "SELECT DISTINCT audience_scope, as_of FROM requests",
    "el": """SELECT audience_scope, as_of, version_id FROM pr JOIN metadata m ON applicable_scope IN ('all_staff', CASE audience_scope WHEN 'unspecified' THEN 'all_staff' ELSE audience_scope END)
      AND effective_from <= as_of AND review_due_at >= as_of JOIN versions v USING (version_id) WHERE v.status = 'active' AND business_status = 'approved'""",
}


@query(
    "jn1_eligible_versions",
    sql(
        "SELECT audience_scope, strftime(as_of, '%Y-%m-%d') AS as_of, version_id FROM el",
        "requests",
        "metadata",
        "versions",
        extra=_ELIGIBLE,
    ),
)
def _(spark, folder):
    profiles = vs.request_profiles(t.requests(spark, folder))
    rows = vs.eligible_versions(t.versions(spark, folder), t.business_metadata(spark, folder), profiles)
    return tidy(rows.join(profiles, "profile"), "audience_scope", "as_of", "version_id")


@query(
    "jn1_eligibility_reasons",
    sql(
        """SELECT audience_scope, strftime(as_of, '%Y-%m-%d') AS as_of, coalesce(n, 0) AS eligible_count,
       CASE WHEN n > 0 THEN NULL WHEN EXISTS (SELECT 1 FROM versions v LEFT JOIN metadata m USING (version_id) WHERE v.status = 'active' AND coalesce(business_status, '') <> 'approved') THEN 'DOCUMENT_BUSINESS_STATUS_UNKNOWN' ELSE 'EVIDENCE_SCOPE_UNCLEAR' END AS exclusion_reason
       FROM (SELECT audience_scope, as_of + 60 AS as_of FROM pr UNION SELECT * FROM pr) LEFT JOIN (SELECT audience_scope, as_of, count(*) AS n FROM (
         SELECT p.audience_scope, p.as_of, version_id FROM (SELECT audience_scope, as_of + 60 AS as_of FROM pr UNION SELECT * FROM pr) p JOIN metadata m ON applicable_scope IN ('all_staff', CASE p.audience_scope WHEN 'unspecified' THEN 'all_staff' ELSE p.audience_scope END)
         AND effective_from <= p.as_of AND review_due_at >= p.as_of JOIN versions v USING (version_id) WHERE v.status = 'active' AND business_status = 'approved') GROUP BY ALL) USING (audience_scope, as_of)""",
        "requests",
        "metadata",
        "versions",
        extra=_ELIGIBLE,
    ),
)
def _(spark, folder):
    """Every request day, and the same request sixty days later."""
    requests = t.requests(spark, folder)
    later = requests.withColumn("as_of", F.date_add("as_of", 60))
    profiles = vs.request_profiles(requests.unionByName(later))
    rows = vs.eligibility(t.versions(spark, folder), t.business_metadata(spark, folder), profiles)
    return tidy(rows, "audience_scope", "as_of", "eligible_count", "exclusion_reason")


# --- metadata ----------------------------------------------------------------------


def _updates(spark, folder):
    n = F.col("doc_id")
    day = F.date_format(F.date_add(F.to_date(F.lit("2024-03-01")), (n % 20).cast("int")), "yyyy-MM-dd")
    return t.load(spark, folder, "documents").select(
        F.floor(n / 2).cast("bigint").alias("document_id"),
        n.alias("update_no"),
        F.when(n % 17 == 1, "poem").otherwise("policy").alias("content_type"),
        F.when(n % 19 == 2, "everyone").otherwise("nurse").alias("applicable_scope"),
        F.when(n % 13 == 3, "2024-02-30").otherwise(day).alias("effective_from"),
        F.lit(None).cast("string").alias("review_due_at"),
        F.lit("approved").alias("business_status"),
        F.when(n % 23 == 4, "  ").alias("owner_role"),
        F.when(n % 5 == 0, F.concat(F.lit("v"), n)).when(n % 7 == 0, F.concat(F.lit("v"), n + 4)).alias("supersedes_version_id"),
    )


_UPDATED = {
    "up": """SELECT doc_id // 2 AS document_id, doc_id AS n, strftime(DATE '2024-03-01' + (doc_id % 20)::INTEGER, '%Y-%m-%d') AS day, CASE WHEN doc_id % 5 = 0 THEN doc_id WHEN doc_id % 7 = 0 THEN doc_id + 4 END AS sup FROM documents""",
    "ck": """SELECT up.*, v.version_id, CASE WHEN n % 17 = 1 THEN 'CONTENT_TYPE' WHEN n % 19 = 2 THEN 'APPLICABLE_SCOPE' WHEN n % 13 = 3 THEN 'EFFECTIVE_FROM' WHEN n % 23 = 4 THEN 'OWNER_ROLE'
      WHEN sup IS NOT NULL AND (sup // 2 <> document_id OR sup NOT IN (SELECT doc_id FROM documents)) THEN 'SUPERSEDES_OTHER_DOCUMENT' WHEN 'v' || sup = v.version_id THEN 'SUPERSEDES_ITSELF' END AS problem FROM up JOIN versions v USING (document_id) WHERE v.status = 'active'""",
}


def _checked(spark, folder):
    rows = t.versions(spark, folder)
    shown = rows.where("status = 'active'").select("document_id", "version_id")
    return vs.metadata_updates(_updates(spark, folder), shown, rows)


@query(
    "mnt4_metadata_problems",
    sql("SELECT document_id, n AS update_no, version_id, problem FROM ck", "versions", extra=_UPDATED),
)
def _(spark, folder):
    return tidy(_checked(spark, folder), "document_id", "update_no", "version_id", "problem")


@query(
    "mnt4_metadata_upsert",
    sql(
        """
  WITH l AS (SELECT version_id, arg_max(day, n) AS day FROM ck WHERE problem IS NULL GROUP BY 1)
  SELECT version_id, CASE WHEN l.version_id IS NOT NULL THEN 'nurse' ELSE m.applicable_scope END AS applicable_scope, coalesce(l.day, strftime(effective_from, '%Y-%m-%d')) AS effective_from,
         CASE WHEN l.version_id IS NULL THEN strftime(review_due_at, '%Y-%m-%d') END AS review_due_at, CASE WHEN l.version_id IS NOT NULL THEN 'approved' ELSE m.business_status END AS business_status
  FROM metadata m FULL JOIN l USING (version_id)""",
        "versions",
        "metadata",
        extra=_UPDATED,
    ),
)
def _(spark, folder):
    accepted = _checked(spark, folder).where("problem is null")
    rows = vs.upsert_metadata(t.business_metadata(spark, folder), accepted)
    return tidy(rows, "version_id", "applicable_scope", "effective_from", "review_due_at", "business_status")


@query(
    "fn20_iso_dates",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""",
)
def _(spark, folder):
    """Order dates as text, a third of them malformed in some way."""
    n = F.col("o_orderkey")
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    bad = F.when(n % 9 == 0, F.concat(F.substring(text, 1, 8), F.lit("31x"))).when(n % 9 == 3, F.lit("2023-02-29")).otherwise(
        F.date_format("o_orderdate", "yyyy/MM/dd")
    )
    rows = t.load(spark, folder, "orders").select("o_orderkey", F.when(n % 3 == 0, bad).otherwise(text).alias("text"))
    return tidy(rows.select("o_orderkey", tx.iso_date(F.col("text")).alias("day")))


@query(
    "flt15_version_contracts",
    sql(
        """SELECT version_id, 'status' AS rule FROM versions WHERE doc_id % 29 = 3 UNION ALL SELECT version_id, 'sha256' FROM versions WHERE doc_id % 31 = 4""",
        "versions",
    ),
)
def _(spark, folder):
    n = F.col("doc_id")
    rows = t.versions(spark, folder).withColumns(
        {
            "status": F.when(n % 29 == 3, "gone").otherwise(F.col("status")),
            "sha256": F.when(n % 31 == 4, "abc").otherwise(F.col("sha256")),
        }
    )
    return contracts.version_violations(rows)
