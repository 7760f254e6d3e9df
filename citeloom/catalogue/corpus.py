"""Corpus queries: scans, blocks, chunks, stores, staging, quality."""

from pyspark.sql import functions as F

from citeloom import fixed
from citeloom.catalogue import query
from citeloom.catalogue.sqlbase import fold, sql
from citeloom.catalogue.tidy import tidy
from citeloom.functions import text as tx
from citeloom.operators import chunking, headings, quality
from citeloom.session import shared_dir
from citeloom.sources import catalogue as sets
from citeloom.sources import corpus, store
from citeloom.sources import tables as t

# --- scans -------------------------------------------------------------------


def _entries(spark, folder):
    active = t.versions(spark, folder).where("status = 'active'")
    return active.select(
        "file_name",
        (F.col("doc_id") % 50 != 7).alias("is_safe"),
        (F.col("doc_id") % 70 != 3).alias("is_regular"),
        F.when(F.col("doc_id") % 31 == 1, "failed")
        .when(F.col("n_chars") < 20, "needs_ocr")
        .otherwise("active")
        .alias("status"),
        F.when(F.col("doc_id") % 31 == 1, "INDEX_FAILED").alias("failure_reason"),
    )


@query(
    "src1_corpus_scan",
    sql(
        """
  SELECT file_name,
         CASE WHEN doc_id % 50 = 7 OR doc_id % 70 = 3 OR doc_id % 31 = 1 THEN 'failed' WHEN n_chars < 20 THEN 'needs_ocr' ELSE 'active' END AS status,
         CASE WHEN doc_id % 50 = 7 THEN 'source entry is not a safe regular file' WHEN doc_id % 70 = 3 THEN 'source entry is not a regular file'
              WHEN doc_id % 31 = 1 THEN 'INDEX_FAILED' END AS failure_reason,
         NOT EXISTS (SELECT 1 FROM versions WHERE status = 'active' AND (doc_id % 50 = 7 OR doc_id % 70 = 3)) AS snapshot_complete
  FROM versions WHERE versions.status = 'active'""",
        "versions",
    ),
)
def _(spark, folder):
    rows = _entries(spark, folder)
    return corpus.scan(
        rows.select("file_name", "is_safe", "is_regular"),
        rows.select("file_name", "status", "failure_reason"),
        max_files=None,
    )


def _inventories(spark, folder):
    base = t.versions(spark, folder).select(
        F.concat_ws("/", "file_name", "version_id").alias("path"),
        F.col("n_chars").alias("size_bytes"),
        F.col("doc_id").alias("modified_at"),
        "sha256",
        "doc_id",
    )
    first = base.where("doc_id % 101 <> 5").drop("doc_id")
    second = (
        base.where("doc_id % 103 <> 6")
        .withColumn("modified_at", F.when(F.col("doc_id") % 97 == 1, F.lit(-1)).otherwise(F.col("modified_at")))
        .drop("doc_id")
    )
    return first, second


@query(
    "src2_inventory_changes",
    sql(
        """
  SELECT file_name || '/' || version_id AS path, CASE WHEN doc_id % 101 = 5 THEN 'added' WHEN doc_id % 103 = 6 THEN 'removed' ELSE 'changed' END AS change
  FROM versions
  WHERE (doc_id % 101 = 5) <> (doc_id % 103 = 6) OR (doc_id % 101 <> 5 AND doc_id % 103 <> 6 AND doc_id % 97 = 1)""",
        "versions",
    ),
)
def _(spark, folder):
    return corpus.inventory_changes(*_inventories(spark, folder))


@query(
    "src2_inventory_verdict",
    sql(
        """
  SELECT (SELECT count(*) FROM documents WHERE doc_id % 101 <> 5) AS file_count,
         (SELECT count(*) FROM documents WHERE (doc_id % 101 = 5) <> (doc_id % 103 = 6) OR (doc_id % 101 <> 5 AND doc_id % 103 <> 6 AND doc_id % 97 = 1)) AS changed_count,
         CASE WHEN (SELECT count(*) FROM documents WHERE doc_id % 101 <> 5) <> 5000 THEN 'FILE_COUNT_UNEXPECTED' END AS reject_reason"""
    ),
)
def _(spark, folder):
    return tidy(corpus.inventory_verdict(*_inventories(spark, folder), expected_files=5000))


@query(
    "src3_text_blocks",
    sql("SELECT version_id, paragraph AS paragraph_start, paragraph AS paragraph_end, text FROM lines", "lines"),
)
def _(spark, folder):
    blocks = corpus.text_blocks(t.document_texts(spark, folder))
    return tidy(blocks, "version_id", "paragraph_start", "paragraph_end", "text")


@query(
    "src3_html_blocks",
    r"""
  WITH visible AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script\b[^>]*>.*?</script>', ' ', 'g'),
                     '(?s)<style\b[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS h FROM pages),
       parts AS (SELECT page_id, unnest(p) AS part, generate_subscripts(p, 1) AS n
                 FROM (SELECT page_id, string_split(regexp_replace(regexp_replace(h, '(<(?:h[1-6]|p)\b[^>]*>)', chr(1) || '\1', 'g'),
                                '</h[1-6]>|</p>|</article>', chr(2), 'g'), chr(1)) AS p FROM visible)),
       blocks AS (SELECT page_id, n - 1 AS block_no, string_split(part, chr(2))[1] AS b FROM parts WHERE n > 1)
  SELECT page_id, block_no, CASE WHEN b LIKE '<h%' THEN substr(b, 3, 1)::BIGINT END AS level,
         trim(regexp_replace(regexp_replace(b, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text
  FROM blocks WHERE trim(regexp_replace(regexp_replace(b, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) <> ''""",
)
def _(spark, folder):
    return tidy(corpus.html_blocks(t.load(spark, folder, "pages")))


# --- limits ------------------------------------------------------------------


@query(
    "flt2_resource_limits",
    sql(
        """
  SELECT version_id, n_chars AS size_bytes, coalesce(p, 0) AS paragraphs, coalesce(c, 0) AS chars,
         CASE WHEN n_chars > 20000 THEN 'FILE_SIZE_LIMIT' WHEN coalesce(p, 0) > 60 THEN 'PARAGRAPH_LIMIT' WHEN coalesce(c, 0) > 8000 THEN 'TEXT_CHAR_LIMIT' END AS reason
  FROM versions LEFT JOIN (SELECT version_id, max(paragraph) AS p, sum(length(text))::BIGINT AS c FROM lines GROUP BY ALL) USING (version_id)""",
        "lines",
    ),
)
def _(spark, folder):
    sizes = t.versions(spark, folder).select("version_id", F.col("n_chars").alias("size_bytes"))
    blocks = corpus.text_blocks(t.document_texts(spark, folder))
    limits = {"bytes": 20000, "paragraphs": 60, "chars": 8000}
    return tidy(corpus.resource_limits(blocks, sizes, limits=limits))


def _pages(spark, folder):
    """Ten lines make a page."""
    blocks = corpus.text_blocks(t.document_texts(spark, folder))
    return blocks.withColumn("page", F.ceil(F.col("paragraph_start") / 10).cast("int"))


@query(
    "flt3_needs_ocr",
    sql(
        """
  SELECT version_id, max(page) AS page_count, sum(length(text))::BIGINT AS chars, sum(length(text)) / max(page) < 20 AS needs_ocr
  FROM (SELECT version_id, text, ceil(paragraph / 10)::BIGINT AS page FROM lines) GROUP BY ALL""",
        "lines",
    ),
)
def _(spark, folder):
    # A page per ten lines; pages without text still count.
    pages = _pages(spark, folder)
    per_page = pages.groupBy("version_id", "page").agg(F.array_join(F.collect_list("text"), "").alias("text"))
    count = pages.groupBy("version_id").agg(F.max("page").alias("n"))
    every = count.select("version_id", F.explode(F.sequence(F.lit(1), "n")).alias("page_no"))
    filled = every.join(per_page.withColumnRenamed("page", "page_no"), ["version_id", "page_no"], "left").fillna(
        "", ["text"]
    )
    return tidy(corpus.needs_ocr(filled, "version_id"))


# --- snapshots and look-ups ----------------------------------------------------


@query(
    "src7_active_snapshot",
    sql("SELECT version_id, chunk_id, content_hash FROM active_chunks", "active_chunks"),
)
def _(spark, folder):
    active = t.versions(spark, folder).where("status = 'active'")
    return corpus.version_snapshot(t.chunks(spark, folder), active).select("version_id", "chunk_id", "content_hash")


@query(
    "src8_all_version_snapshot",
    sql("SELECT version_id, chunk_id, content_hash, file_name, heading AS heading_path FROM chunks", "chunks"),
)
def _(spark, folder):
    rows = corpus.all_versions_snapshot(t.chunks(spark, folder))
    return rows.select(
        "version_id", "chunk_id", "content_hash", "file_name", F.concat_ws("/", "heading_path").alias("heading_path")
    )


@query(
    "src9_active_by_file",
    sql(
        """
  SELECT upper(k.file_name) AS file_name, v.version_id, v.sha256, v.version_id IS NOT NULL AS found
  FROM (SELECT 'doc-' || item_id * 7 || '.docx' AS file_name FROM benchmark) k
  LEFT JOIN versions v ON v.status = 'active' AND lower(v.file_name) = lower(k.file_name)""",
        "versions",
    ),
)
def _(spark, folder):
    names = t.load(spark, folder, "benchmark").select(
        F.upper(F.concat(F.lit("doc-"), F.col("item_id") * 7, F.lit(".docx"))).alias("file_name")
    )
    return store.active_by_file(names, t.versions(spark, folder))


@query(
    "src9_keyed_reads",
    sql(
        """
  SELECT k.version_id, v.file_name, v.sha256, v.status, m.business_status
  FROM (SELECT 'v' || item_id * 13 AS version_id FROM benchmark) k LEFT JOIN versions v USING (version_id) LEFT JOIN metadata m USING (version_id)""",
        "versions",
        "metadata",
    ),
)
def _(spark, folder):
    keys = t.load(spark, folder, "benchmark").select(
        F.concat(F.lit("v"), F.col("item_id") * 13).alias("version_id")
    )
    held = store.look_up(keys, t.versions(spark, folder), "version_id", ["file_name", "sha256", "status"])
    return store.look_up(held, t.business_metadata(spark, folder), "version_id", ["business_status"])


# --- stores --------------------------------------------------------------------


def _changed(spark, folder):
    """A republish of every tenth document: its chunks with a marked hash."""
    rows = t.chunks(spark, folder).where("document_id % 10 = 3")
    return rows.withColumn("content_hash", F.concat(F.lit("new-"), "content_hash"))


@query(
    "snk1_chunk_upsert",
    sql(
        """
  SELECT version_id, chunk_id, CASE WHEN document_id % 10 = 3 THEN 'new-' || content_hash ELSE content_hash END AS content_hash FROM chunks""",
        "chunks",
    ),
)
def _(spark, folder):
    path = shared_dir(spark, "store")
    store.write_store(t.chunks(spark, folder).where("document_id % 20 <> 3"), path, buckets=16)
    store.upsert(spark, path, _changed(spark, folder), buckets=16)
    return store.read_store(spark, path).select("version_id", "chunk_id", "content_hash")


@query(
    "snk1_upsert_problems",
    """
  SELECT 'v1' AS version_id, 'c' || (vec_id // 3) AS chunk_id, 'DUPLICATE_CHUNK_ID' AS problem FROM embeddings GROUP BY vec_id // 3 HAVING count(*) > 1
  UNION ALL SELECT 'v1', 'c' || (vec_id // 3), 'VECTOR_DIMENSION' FROM embeddings WHERE label = 4""",
)
def _(spark, folder):
    points = t.load(spark, folder, "embeddings").select(
        F.lit("v1").alias("version_id"),
        F.concat(F.lit("c"), F.floor(F.col("vec_id") / 3)).alias("chunk_id"),
        F.when(F.col("label") == 4, F.slice("embedding", 1, 10)).otherwise(F.col("embedding")).alias("embedding"),
    )
    return store.upsert_problems(points, 64)


@query(
    "snk2_staging_publish",
    sql(
        f"""
  SELECT '{fixed.STAGING_VERSION}' AS version_id, chunk_id, CASE WHEN document_id % 2 = 0 THEN 'published' ELSE 'held' END AS origin
  FROM active_chunks WHERE document_id % 2 = 1 OR document_id % 4 = 0 OR document_id % 6 = 0""",
        "active_chunks",
    ),
)
def _(spark, folder):
    chunks = t.active_chunks(spark, folder)
    held = chunks.where("document_id % 2 = 1 or document_id % 4 = 0").select(
        F.lit(fixed.STAGING_VERSION).alias("version_id"), "chunk_id", F.lit("held").alias("origin")
    )
    incoming = chunks.where("document_id % 2 = 0 and (document_id % 4 = 0 or document_id % 6 = 0)").select(
        F.lit(fixed.STAGING_VERSION).alias("source_version"), "chunk_id", F.lit("published").alias("origin")
    )
    return store.publish(held, incoming, fixed.STAGING_VERSION)


@query(
    "snk3_delete_version",
    sql(
        "SELECT version_id, chunk_id, content_hash FROM chunks WHERE NOT (status = 'superseded' AND document_id % 3 = 0)",
        "chunks",
    ),
)
def _(spark, folder):
    path = shared_dir(spark, "store")
    store.write_store(t.chunks(spark, folder), path, buckets=16)
    gone = t.versions(spark, folder).where("status = 'superseded' and document_id % 3 = 0")
    store.delete_version(spark, path, gone.select("version_id", "document_id"), buckets=16)
    return store.read_store(spark, path).select("version_id", "chunk_id", "content_hash")


# --- evaluation sets and scenarios ----------------------------------------------


def _set_cases(spark, folder):
    return t.load(spark, folder, "benchmark").select(
        F.concat(F.lit("set-"), F.col("item_id") % 8).alias("set_id"),
        F.col("item_id").alias("case_no"),
        F.col("text").alias("question"),
        F.split("text", r"\. ").alias("reference_points"),
        F.array(F.concat(F.lit("v"), F.col("item_id"))).alias("source_ids"),
        F.lit("fact").alias("type"),
    )


@query(
    "src5_set_checksums",
    r"""
  WITH c AS (SELECT 'set-' || (item_id % 8) AS set_id, item_id,
                    sha256('{"case_no":' || item_id || ',"question":' || to_json(text) || ',"reference_points":' || to_json(string_split(text, '. '))
                           || ',"source_ids":["v' || item_id || '"],"type":"fact"}') AS digest FROM benchmark)
  SELECT set_id, count(*) AS case_count, sha256(string_agg(digest, chr(10) ORDER BY item_id)) AS checksum, set_id IN ('set-0', 'set-1', 'set-2') AS intact
  FROM c GROUP BY set_id""",
)
def _(spark, folder):
    cases = _set_cases(spark, folder)
    # Three sets are stored with their checksum, the others with a stale one.
    stored = sets.set_checksums(cases).select(
        "set_id",
        F.when(F.col("set_id").isin("set-0", "set-1", "set-2"), F.col("checksum")).otherwise("stale").alias("checksum"),
    )
    return tidy(sets.verify_sets(cases, stored), "set_id", "case_count", "checksum", "intact")


def _scenarios(spark, folder):
    turns = t.load(spark, folder, "conversations")
    asked = turns.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("question"))
    told = turns.where("role = 'assistant'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("answer"))
    kinds = F.array(*[F.lit(k) for k in (*fixed.SCENARIO_TYPES, "other")])
    refused = F.col("conv_id") % 6 == 0
    question = F.col("question")
    return asked.join(told, "conv_id").select(
        F.concat(
            F.lit("scn-"), F.when(F.col("conv_id") % 20 == 19, F.col("conv_id") - 1).otherwise(F.col("conv_id"))
        ).alias("scenario_id"),
        F.element_at(kinds, (F.col("conv_id") % 8 + 1).cast("int")).alias("type"),
        question.alias("question"),
        F.upper(question).alias("standalone_question"),
        F.when(refused & (F.col("conv_id") % 12 == 0), "").otherwise(F.col("answer")).alias("answer"),
        refused.alias("refused"),
        F.split("answer", " ").alias("evidence_terms"),
    )


@query(
    "src6_scenario_problems",
    rf"""
  WITH a AS (SELECT conv_id, arg_min(text, turn) AS q FROM conversations WHERE role = 'user' GROUP BY 1),
       b AS (SELECT conv_id, arg_min(text, turn) AS answer FROM conversations WHERE role = 'assistant' GROUP BY 1),
       s AS (SELECT 'scn-' || CASE WHEN conv_id % 20 = 19 THEN conv_id - 1 ELSE conv_id END AS scenario_id, conv_id % 8 AS kind, q AS question,
                    conv_id % 6 = 0 AS refused, CASE WHEN conv_id % 12 = 0 THEN '' ELSE answer END AS answer, string_split(answer, ' ') AS terms
             FROM a JOIN b USING (conv_id)),
       k AS (SELECT DISTINCT scenario_id, key FROM (SELECT scenario_id, trim(regexp_replace({fold("question")}, '\s+', ' ', 'g')) AS key FROM s
             UNION ALL SELECT scenario_id, trim(regexp_replace({fold("upper(question)")}, '\s+', ' ', 'g')) FROM s)),
       kk AS (SELECT scenario_id, key FROM (SELECT scenario_id, conv, key FROM (SELECT scenario_id, row_number() OVER () AS conv,
              list_distinct([trim(regexp_replace({fold("question")}, '\s+', ' ', 'g')), trim(regexp_replace({fold("upper(question)")}, '\s+', ' ', 'g'))]) AS keys FROM s), unnest(keys) u(key)))
  SELECT DISTINCT scenario_id, problem FROM (
    SELECT scenario_id, 'TYPE' AS problem FROM s WHERE kind = 7
    UNION ALL SELECT scenario_id, 'QUESTION' FROM s WHERE trim(question) = ''
    UNION ALL SELECT scenario_id, 'EVIDENCE_TERMS' FROM s WHERE list_bool_or(list_transform(terms, lambda x: trim(x) = ''))
    UNION ALL SELECT scenario_id, 'EVIDENCE_TERMS_REPEATED' FROM s WHERE len(list_distinct(list_transform(terms, lambda x: lower(trim(x))))) <> len(terms)
    UNION ALL SELECT scenario_id, 'ANSWER_OF_REFUSED' FROM s WHERE refused AND answer <> ''
    UNION ALL SELECT scenario_id, 'SCENARIO_ID_REPEATED' FROM s GROUP BY scenario_id HAVING count(*) > 1
    UNION ALL SELECT scenario_id, 'QUESTION_REPEATED' FROM (SELECT *, min(scenario_id) OVER (PARTITION BY key) AS first_id, count(*) OVER (PARTITION BY key) AS n FROM kk) WHERE n > 1 AND scenario_id <> first_id)""",
)
def _(spark, folder):
    return sets.scenario_problems(_scenarios(spark, folder)).distinct()


@query("snk4_write_once_report")
def _(spark, folder):
    path = shared_dir(spark, "report")
    report = quality.chunk_integrity(t.active_chunks(spark, folder))
    sets.write_once(report, path)
    return spark.read.schema(report.schema).json(path)


# --- headings -------------------------------------------------------------------


def _levelled(spark, folder):
    """Short lines are headings: level 1, or 2 when their length is odd."""
    blocks = corpus.text_blocks(t.document_texts(spark, folder))
    size = F.length("text")
    return blocks.select(
        "version_id",
        F.col("paragraph_start").alias("block_no"),
        F.when(size < 60, F.when(size % 2 == 1, 2).otherwise(1)).alias("level"),
        "text",
    )


@query(
    "win8_heading_paths",
    sql(
        """
  WITH b AS (SELECT version_id, paragraph AS block_no, text, CASE WHEN length(text) < 60 THEN 1 + length(text) % 2 END AS level FROM lines),
       h AS (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY block_no) AS n FROM b WHERE level IS NOT NULL),
       -- A second-level heading without a parent takes the first place, as does any later one that follows it there.
       r AS (SELECT *, last_value(CASE WHEN level = 1 OR n = 1 THEN text END IGNORE NULLS) OVER (PARTITION BY version_id ORDER BY block_no) AS root,
                    level = 1 OR n = 1 AS is_root FROM h),
       p AS (SELECT version_id, block_no, CASE WHEN is_root THEN text ELSE root || '|' || text END AS path FROM r)
  SELECT b.version_id, b.block_no, b.text,
         coalesce(last_value(p.path IGNORE NULLS) OVER (PARTITION BY b.version_id ORDER BY b.block_no), '正文') AS heading_path
  FROM b LEFT JOIN p USING (version_id, block_no) QUALIFY b.level IS NULL""",
        "lines",
    ),
)
def _(spark, folder):
    return tidy(headings.carry_headings(_levelled(spark, folder), "version_id"))


@query(
    "win8_page_headings",
    r"""
  WITH visible AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<script\b[^>]*>.*?</script>', ' ', 'g'),
                     '(?s)<style\b[^>]*>.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS h FROM pages),
       parts AS (SELECT page_id, unnest(p) AS part, generate_subscripts(p, 1) AS n
                 FROM (SELECT page_id, string_split(regexp_replace(regexp_replace(h, '(<(?:h[1-6]|p)\b[^>]*>)', chr(1) || '\1', 'g'),
                                '</h[1-6]>|</p>|</article>', chr(2), 'g'), chr(1)) AS p FROM visible)),
       b AS (SELECT page_id, n - 1 AS block_no, string_split(part, chr(2))[1] LIKE '<h%' AS is_heading,
                    trim(regexp_replace(regexp_replace(string_split(part, chr(2))[1], '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM parts WHERE n > 1),
       l AS (SELECT *, last_value(CASE WHEN is_heading AND length(text) BETWEEN 1 AND 200 THEN text END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY block_no) AS path FROM b WHERE text <> '')
  SELECT page_id, block_no, text, coalesce(path, '正文') AS heading_path FROM l WHERE NOT is_heading""",
)
def _(spark, folder):
    blocks = corpus.html_blocks(t.load(spark, folder, "pages"))
    return tidy(headings.carry_headings(blocks, "page_id", conservative=True))


@query(
    "jn12_page_outline",
    sql(
        """
  WITH b AS (SELECT version_id, ceil(paragraph / 10)::BIGINT AS page, paragraph AS ordinal, text, 1 + length(text) % 2 AS level FROM lines WHERE length(text) < 60),
       h AS (SELECT *, row_number() OVER (PARTITION BY version_id ORDER BY ordinal) AS n FROM b),
       r AS (SELECT *, last_value(CASE WHEN level = 1 OR n = 1 THEN text END IGNORE NULLS) OVER (PARTITION BY version_id ORDER BY ordinal) AS root, level = 1 OR n = 1 AS is_root FROM h),
       e AS (SELECT version_id, page, count(*) AS entries, arg_max(CASE WHEN is_root THEN text ELSE root || '|' || text END, ordinal) AS path FROM r GROUP BY ALL),
       pages AS (SELECT version_id, unnest(range(1, m + 1)) AS page FROM (SELECT version_id, max(ceil(paragraph / 10)::BIGINT) AS m FROM lines GROUP BY 1))
  SELECT version_id, page, CASE WHEN coalesce(entries, 0) > 1 THEN '正文'
           ELSE coalesce(last_value(path IGNORE NULLS) OVER (PARTITION BY version_id ORDER BY page), '正文') END AS heading_path,
         coalesce(entries, 0) > 1 AS ambiguous
  FROM pages LEFT JOIN e USING (version_id, page)""",
        "lines",
    ),
)
def _(spark, folder):
    blocks = _pages(spark, folder)
    count = blocks.groupBy("version_id").agg(F.max("page").alias("n"))
    pages = count.select("version_id", F.explode(F.sequence(F.lit(1), "n")).alias("page"))
    outline = blocks.where(F.length("text") < 60).select(
        "version_id",
        F.col("paragraph_start").alias("ordinal"),
        (F.length("text") % 2 + 1).alias("level"),
        F.col("text").alias("title"),
        "page",
    )
    return tidy(headings.page_headings(pages, outline, "version_id"))


# --- chunking -------------------------------------------------------------------


def _packed(spark, folder):
    return chunking.chunk_documents(chunking.line_documents(t.document_texts(spark, folder)))


# The packing of one document, one step per row: take a piece, or close a chunk.
_PACK = """
  pieces AS (SELECT version_id, row_number() OVER (PARTITION BY version_id ORDER BY paragraph, k) AS n, paragraph, piece
             FROM (SELECT version_id, paragraph, k, substr(text, 1 + (k - 1) * 800, 800) AS piece
                   FROM (SELECT version_id, paragraph, text, unnest(range(1, 2 + (length(text) - 1) // 800)) AS k FROM lines))),
  walk AS (
    SELECT version_id, 1::BIGINT AS n, '' AS cur, NULL::BIGINT AS a, NULL::BIGINT AS z, false AS fresh, '' AS carry, NULL::BIGINT AS carry_place,
           piece AS rest, paragraph AS place, NULL::BIGINT AS last, NULL::VARCHAR AS closed, NULL::BIGINT AS ca, NULL::BIGINT AS cz, 0::BIGINT AS step
    FROM pieces WHERE n = 1
    UNION ALL
    SELECT w.version_id,
           CASE WHEN w.over OR w.left_over <> '' THEN w.n ELSE w.n + 1 END,
           CASE WHEN w.over THEN '' ELSE w.grown END,
           CASE WHEN w.over THEN NULL ELSE w.new_a END, CASE WHEN w.over THEN NULL ELSE w.place END, NOT w.over,
           CASE WHEN w.over THEN right(w.cur, 120) ELSE '' END, CASE WHEN w.over THEN w.last END,
           CASE WHEN w.over THEN w.rest WHEN w.left_over <> '' THEN w.left_over ELSE p.piece END,
           CASE WHEN w.over OR w.left_over <> '' THEN w.place ELSE p.paragraph END,
           CASE WHEN w.over THEN w.last ELSE w.place END,
           CASE WHEN w.over THEN w.cur END, CASE WHEN w.over THEN w.a END, CASE WHEN w.over THEN w.z END, w.step + 1
    FROM (SELECT *, fresh AND length(cur) + length(rest) > 800 AS over,
                 CASE WHEN cur = '' THEN carry ELSE cur END || substr(rest, 1, 800 - length(CASE WHEN cur = '' THEN carry ELSE cur END)) AS grown,
                 substr(rest, 801 - length(CASE WHEN cur = '' THEN carry ELSE cur END)) AS left_over,
                 coalesce(a, CASE WHEN cur = '' AND carry <> '' THEN carry_place END, place) AS new_a
          FROM walk WHERE rest IS NOT NULL) w
    LEFT JOIN pieces p ON p.version_id = w.version_id AND p.n = w.n + 1),
  packed AS (SELECT version_id, step, closed AS text, ca AS paragraph_start, cz AS paragraph_end FROM walk WHERE closed IS NOT NULL
             UNION ALL SELECT version_id, step, cur, a, z FROM walk WHERE rest IS NULL AND fresh)"""


@query(
    "win9_packed_chunks",
    sql("", "lines").rstrip()
    + f""", {_PACK}
  SELECT version_id, row_number() OVER (PARTITION BY version_id ORDER BY step) AS chunk_no, text, paragraph_start, paragraph_end, sha256(text) AS content_hash FROM packed""",
)
def _(spark, folder):
    rows = _packed(spark, folder)
    return tidy(rows, "version_id", "chunk_no", "text", "paragraph_start", "paragraph_end", "content_hash")


@query(
    "win10_capped_pieces",
    sql(
        """
  SELECT version_id, paragraph, k AS piece_no, trim(substr(text, 1 + (k - 1) * 128, 128)) AS text, length(trim(substr(text, 1 + (k - 1) * 128, 128))) AS token_count
  FROM (SELECT version_id, paragraph, text, unnest(range(1, 2 + (length(text) - 1) // 128)) AS k FROM lines)
  WHERE trim(substr(text, 1 + (k - 1) * 128, 128)) <> ''""",
        "lines",
    ),
)
def _(spark, folder):
    elements = corpus.text_blocks(t.document_texts(spark, folder)).select(
        "version_id", F.col("paragraph_start").alias("paragraph"), "text", F.lit("text").alias("content_kind")
    )
    return tidy(chunking.capped_pieces(elements, "version_id", "paragraph", max_tokens=128))


@query("win10_table_pieces")
def _(spark, folder):
    """Documents with many lines as tables: the first line is the header row."""
    tables = t.document_texts(spark, folder).select("version_id", "text", F.lit("table").alias("content_kind"))
    return tidy(chunking.capped_pieces(tables, "version_id"))


@query(
    "win11_staging_ids",
    sql(
        f"""
  SELECT version_id, ordinal, content_hash, sha256('{fixed.STAGING_VERSION}' || chr(10) || source_sha || chr(10) || provenance || chr(10) || ordinal || chr(10) || content_hash) AS chunk_id
  FROM (SELECT l.version_id, v.sha256 AS source_sha, sha256(l.file_name || ':' || l.paragraph) AS provenance, sha256(l.text) AS content_hash,
               row_number() OVER (PARTITION BY l.version_id ORDER BY l.paragraph) - 1 AS ordinal
        FROM lines l JOIN versions v USING (version_id) WHERE v.status = 'active')""",
        "lines",
    ),
)
def _(spark, folder):
    versions = t.versions(spark, folder).where("status = 'active'")
    sources = versions.select("version_id", F.col("sha256").alias("source_sha256"))
    pieces = (
        corpus.text_blocks(t.document_texts(spark, folder))
        .join(sources, "version_id")
        .withColumn(
            "provenance_digest", F.sha2(F.concat_ws(":", "file_name", F.col("paragraph_start")), 256)
        )
    )
    rows = chunking.staging_ids(pieces, ["paragraph_start"])
    return tidy(rows, "version_id", "ordinal", "content_hash", "chunk_id")


@query(
    "jn11_locators",
    sql(
        r"""
  WITH k AS (SELECT version_id, paragraph, regexp_replace(replace(lower(text), 'ß', 'ss'), '[\s\p{P}\p{S}]', '', 'g') AS key FROM lines)
  SELECT version_id, paragraph AS element_no, CASE WHEN key <> '' THEN paragraph END AS paragraph_start, CASE WHEN key <> '' THEN paragraph END AS paragraph_end FROM k""",
        "lines",
    ),
)
def _(spark, folder):
    """All blocks as elements: each must be found again at its own paragraph."""
    keyed = corpus.text_blocks(t.document_texts(spark, folder)).select(
        "version_id", F.col("paragraph_start").alias("paragraph"), tx.locator_key(F.col("text")).alias("key")
    )
    documents = keyed.groupBy("version_id").agg(
        F.array_sort(F.collect_list(F.struct("paragraph", "key"))).alias("b")
    ).select(
        "version_id",
        F.transform("b", lambda b: F.struct(b["key"].alias("key"), b["paragraph"].alias("paragraph"))).alias("blocks"),
        F.transform("b", lambda b: F.struct(b["paragraph"].alias("element_no"), b["key"].alias("key"))).alias("elements"),
    )
    return tidy(chunking.locate_elements(documents))


# --- text functions over the corpus ----------------------------------------------


@query(
    "fn7_sentences",
    sql(
        r"""
  SELECT version_id, unnest(regexp_extract_all(text, '[^。；\n]*[。；\n]|[^。；\n]+')) AS piece FROM versions""",
        "versions",
    ),
)
def _(spark, folder):
    docs = t.document_texts(spark, folder)
    return docs.select("version_id", F.explode(tx.sentences(F.col("text"))).alias("piece"))


@query(
    "fn7_hard_pieces",
    sql(
        """
  SELECT version_id, k AS piece_no, substr(text, 1 + (k - 1) * 500, 500) AS piece
  FROM (SELECT version_id, text, unnest(range(1, 2 + (length(text) - 1) // 500)) AS k FROM versions WHERE text <> '')""",
        "versions",
    ),
)
def _(spark, folder):
    docs = t.document_texts(spark, folder)
    pieces = docs.select("version_id", F.posexplode(tx.hard_pieces(F.col("text"), 500)).alias("pos", "piece"))
    return tidy(pieces.select("version_id", (F.col("pos") + 1).alias("piece_no"), "piece"))


@query(
    "fn8_merged_locators",
    sql(
        """
  SELECT version_id, page, min(paragraph) AS paragraph_start, max(paragraph) AS paragraph_end, CASE WHEN count(DISTINCT kind) = 1 THEN min(kind) END AS table_id
  FROM (SELECT version_id, paragraph, ceil(paragraph / 10)::BIGINT AS page, 'table-' || (1 + length(text) % 2) AS kind FROM lines) GROUP BY version_id, page""",
        "lines",
    ),
)
def _(spark, folder):
    parts = _pages(spark, folder).select(
        "version_id",
        F.col("page").alias("group_page"),
        "page",
        F.col("page").alias("page_end"),
        "paragraph_start",
        "paragraph_end",
        F.concat(F.lit("table-"), F.length("text") % 2 + 1).alias("table_id"),
    )
    rows = chunking.merge_locators(parts, "version_id", "group_page")
    return tidy(rows, "version_id", "page", "paragraph_start", "paragraph_end", "table_id")


@query(
    "fn9_heading_titles",
    sql(
        r"""
  SELECT version_id, paragraph, CASE WHEN length(t) BETWEEN 1 AND 200 THEN t END AS title
  FROM (SELECT version_id, paragraph, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM lines)""",
        "lines",
    ),
)
def _(spark, folder):
    blocks = corpus.text_blocks(t.document_texts(spark, folder))
    title = tx.heading_title(F.col("text")).alias("title")
    return tidy(blocks.select("version_id", F.col("paragraph_start").alias("paragraph"), title))


@query(
    "fn10_locator_keys",
    sql(
        rf"""
  SELECT version_id, paragraph, regexp_replace({fold("text")}, '[\s\p{{P}}\p{{S}}]', '', 'g') AS key FROM lines""",
        "lines",
    ),
)
def _(spark, folder):
    blocks = corpus.text_blocks(t.document_texts(spark, folder))
    key = tx.locator_key(F.col("text")).alias("key")
    return tidy(blocks.select("version_id", F.col("paragraph_start").alias("paragraph"), key))


# --- quality --------------------------------------------------------------------

_KIND = """CASE WHEN length(text) < 60 THEN 'heading' WHEN regexp_matches(text, '[0-9]') THEN 'table' WHEN regexp_matches(text, '[#%$]') THEN 'textbox' ELSE 'paragraph' END"""
_AUDIT = {
    "kinds": f"SELECT file_name, paragraph, text, length(text) AS n, {_KIND} AS kind FROM lines WHERE status = 'active'",
    "got": "SELECT file_name, sum(n)::BIGINT AS extracted_chars FROM kinds WHERE kind IN ('paragraph', 'table') AND NOT (kind = 'table' AND n > 400) GROUP BY 1",
    "held": """SELECT file_name, count(*) FILTER (kind IN ('paragraph', 'heading')) AS paragraph_count, coalesce(sum(n) FILTER (kind = 'paragraph'), 0)::BIGINT AS paragraph_chars,
      count(*) FILTER (kind = 'heading') AS heading_count, count(*) FILTER (kind = 'textbox') AS textbox_count, coalesce(sum(n) FILTER (kind = 'textbox'), 0)::BIGINT AS textbox_chars,
      count(DISTINCT paragraph // 5) FILTER (kind = 'table') AS table_count, count(*) FILTER (kind = 'table') AS nonempty_cell_count,
      coalesce(sum(n) FILTER (kind = 'table'), 0)::BIGINT AS table_chars FROM kinds GROUP BY 1""",
    "audit0": """SELECT held.*, coalesce(extracted_chars, 0) AS extracted_chars,
      list_filter([CASE WHEN coalesce(extracted_chars, 0) < paragraph_chars THEN 'paragraph_text_not_covered' END,
        CASE WHEN table_chars > 0 AND coalesce(extracted_chars, 0) < paragraph_chars + table_chars THEN 'table_text_not_covered' END,
        CASE WHEN textbox_chars > 0 AND coalesce(extracted_chars, 0) < paragraph_chars + table_chars + textbox_chars THEN 'textbox_text_not_covered' END], lambda x: x IS NOT NULL) AS reasons
      FROM held LEFT JOIN got USING (file_name)""",
    "audit": "SELECT *, CASE WHEN len(reasons) > 0 THEN 'blocked' ELSE 'pass' END AS coverage_status FROM audit0",
    "candidates": """SELECT file_name, 'docling' AS backend, text, n, paragraph FROM kinds WHERE NOT (kind = 'textbox' AND n > 300)
      UNION ALL SELECT file_name, 'legacy', text, n, paragraph FROM kinds WHERE kind <> 'heading'""",
    "sizes": """SELECT file_name, coalesce(sum(n) FILTER (backend = 'docling'), 0)::BIGINT AS docling_chars, count(*) FILTER (backend = 'docling') AS docling_chunk_count,
      coalesce(sum(n) FILTER (backend = 'legacy'), 0)::BIGINT AS fallback_chars, count(*) FILTER (backend = 'legacy') AS fallback_chunk_count FROM candidates GROUP BY 1""",
    "coverage": """SELECT *, CASE WHEN len(why) > 0 THEN 'blocked' ELSE 'pass' END AS status FROM (
      SELECT file_name, expected_chars, d AS docling_chars, f AS fallback_chars, dn AS docling_chunk_count, fn AS fallback_chunk_count,
        list_concat(list_filter([CASE WHEN dn = 0 THEN 'docling_no_chunks' END, CASE WHEN expected_chars > 0 AND d < expected_chars THEN 'docling_coverage_below_audit' END,
          CASE WHEN fn > 0 AND expected_chars > 0 AND f < expected_chars THEN 'fallback_coverage_below_audit' END], lambda x: x IS NOT NULL),
          CASE WHEN coverage_status = 'blocked' AND expected_chars > 0 AND d < expected_chars THEN reasons ELSE [] END) AS why,
        list_filter([CASE WHEN dn > 0 THEN 'docling' END, CASE WHEN fn > 0 THEN 'legacy' END], lambda x: x IS NOT NULL) AS backends, coverage_status AS audit_status
      FROM (SELECT audit.*, CASE WHEN paragraph_chars + table_chars + textbox_chars > 0 THEN paragraph_chars + table_chars + textbox_chars ELSE extracted_chars END AS expected_chars,
              coalesce(docling_chars, 0) AS d, coalesce(fallback_chars, 0) AS f, coalesce(docling_chunk_count, 0) AS dn, coalesce(fallback_chunk_count, 0) AS fn
            FROM audit LEFT JOIN sizes USING (file_name)))""",
}


def _kinds(spark, folder):
    size = F.length("text")
    kind = (
        F.when(size < 60, "heading")
        .when(F.col("text").rlike("[0-9]"), "table")
        .when(F.col("text").rlike("[#%$]"), "textbox")
        .otherwise("paragraph")
    )
    return t.active_chunks(spark, folder).select(
        "file_name",
        "paragraph_start",
        kind.alias("content_kind"),
        F.concat(F.lit("table-"), F.floor(F.col("paragraph_start") / 5)).alias("table_id"),
        "text",
        "heading_path",
        "chunk_id",
        "content_hash",
    )


def _extracted(kinds):
    kind, size = F.col("content_kind"), F.length("text")
    return kinds.where(kind.isin("paragraph", "table") & ~((kind == "table") & (size > 400)))


def _audit(spark, folder):
    kinds = _kinds(spark, folder)
    return quality.structure_audit(kinds, _extracted(kinds))


def _candidates(spark, folder):
    kinds = _kinds(spark, folder)
    kind, size = F.col("content_kind"), F.length("text")
    first = kinds.where(~((kind == "textbox") & (size > 300))).withColumn("backend", F.lit("docling"))
    return first.unionByName(kinds.where(kind != "heading").withColumn("backend", F.lit("legacy")))


def _coverage(spark, folder):
    return quality.compare_coverage(_audit(spark, folder), _candidates(spark, folder))


@query(
    "agg24_structure_audit",
    sql(
        "SELECT * EXCLUDE (reasons), array_to_string(reasons, '|') AS blocking_reasons FROM audit", "lines", extra=_AUDIT
    ),
)
def _(spark, folder):
    return tidy(_audit(spark, folder))


@query(
    "agg25_coverage",
    sql(
        """SELECT file_name, expected_chars, docling_chars, fallback_chars, docling_chunk_count, fallback_chunk_count,
       array_to_string(backends, '|') AS available_backends, array_to_string(why, '|') AS blocking_reasons, status FROM coverage""",
        "lines",
        extra=_AUDIT,
    ),
)
def _(spark, folder):
    return tidy(_coverage(spark, folder))


@query(
    "agg25_active_backend",
    sql(
        """SELECT file_name, CASE WHEN p IS NULL THEN 'docling' END AS active_backend, p AS problem FROM (
       SELECT file_name, CASE WHEN status <> 'pass' THEN 'COVERAGE_BLOCKED' WHEN len(backends) = 0 THEN 'NO_BACKEND' WHEN NOT list_contains(backends, 'docling') THEN 'BACKEND_UNAVAILABLE' END AS p FROM coverage)""",
        "lines",
        extra=_AUDIT,
    ),
)
def _(spark, folder):
    return quality.choose_backend(_coverage(spark, folder), "docling")


@query(
    "jn13_run_report",
    sql(
        """SELECT file_name, severity, reason FROM (
       SELECT file_name, 'blocking' AS severity, unnest(why) AS reason FROM coverage
       UNION ALL SELECT file_name, 'blocking', 'extraction_audit_not_recovered' FROM coverage WHERE audit_status = 'blocked' AND status <> 'pass'
       UNION ALL SELECT file_name, 'warning', 'extraction_audit_gap_recovered_by_candidate' FROM coverage WHERE audit_status = 'blocked' AND status = 'pass'
       UNION ALL SELECT file_name, 'warning', 'docling_unavailable' FROM coverage WHERE length(file_name) = 9
       UNION ALL SELECT file_name, 'warning', 'primary_tokenizer_fallback' FROM coverage WHERE docling_chunk_count > 10)""",
        "lines",
        extra=_AUDIT,
    ),
)
def _(spark, folder):
    coverage = _coverage(spark, folder)
    backends = coverage.select(
        "file_name",
        F.when(F.length("file_name") == 9, "docling_unavailable").alias("error_code"),
        (F.col("docling_chunk_count") > 10).alias("used_tokenizer_fallback"),
    )
    return quality.run_report(coverage, _audit(spark, folder), backends)


@query(
    "agg26_candidate_summary",
    sql(
        """SELECT backend, count(*) AS count, count(DISTINCT file_name) AS files_with_candidates, max(n) AS max_token_count, 0::BIGINT AS empty_chunk_count,
       count(*) FILTER (n > 512) AS token_over_limit_count, count(*) AS source_retraceable_count, 0::BIGINT AS duplicate_chunk_id_count,
       count(*) - count(DISTINCT text) AS duplicate_content_hash_count, count(*) || '/' || count(*) AS source_retraceable_rate FROM candidates GROUP BY backend""",
        "lines",
        extra=_AUDIT,
    ),
)
def _(spark, folder):
    rows = _candidates(spark, folder).withColumn("token_count", F.length("text"))
    return tidy(quality.candidate_summary(rows))


@query(
    "agg27_extraction_summary",
    sql(
        f"""SELECT (SELECT count(*) FROM versions WHERE status = 'active') AS file_count, count(*) AS audited_file_count,
       (SELECT count(*) FROM versions WHERE status = 'active') - count(*) AS blocked_file_count, {", ".join(f"sum({c})::BIGINT AS {c}" for c in quality.AUDIT_COUNTS)},
       count(*) FILTER (coverage_status = 'pass') AS status_pass, count(*) FILTER (coverage_status = 'blocked') AS status_blocked, 0::BIGINT AS status_unknown
       FROM audit WHERE heading_count < 3""",
        "lines",
        extra=_AUDIT,
    ),
)
def _(spark, folder):
    manifest = t.versions(spark, folder).where("status = 'active'")
    return tidy(quality.extraction_summary(manifest, _audit(spark, folder).where("heading_count < 3")))


@query(
    "agg3_chunk_integrity",
    sql(
        """SELECT count(*) AS total_chunks, count(DISTINCT chunk_id) AS unique_chunk_ids, count(*) - count(DISTINCT chunk_id) AS duplicate_chunk_id_count,
       count(DISTINCT content_hash) AS unique_content_hashes, count(*) - count(DISTINCT content_hash) AS duplicate_content_hash_count, 0::BIGINT AS blank_text_count,
       0::BIGINT AS missing_file_name_count, 0::BIGINT AS missing_heading_count, count(DISTINCT file_name) AS active_file_count FROM active_chunks""",
        "active_chunks",
    ),
)
def _(spark, folder):
    return tidy(quality.chunk_integrity(t.active_chunks(spark, folder)))


# --- staging files ---------------------------------------------------------------


@query(
    "snk6_candidate_files",
    sql(
        """SELECT backend, sha256(file_name) AS source_sha256, count(*) AS count, count(*) AS lines_read FROM candidates GROUP BY ALL""",
        "lines",
        extra=_AUDIT,
    ),
)
def _(spark, folder):
    path = shared_dir(spark, "candidates")
    rows = _candidates(spark, folder).select(
        "backend", F.sha2("file_name", 256).alias("source_sha256"), "file_name", "chunk_id", "text"
    )
    manifest = store.write_candidates(rows, path, buckets=8)
    schema = "source_sha256 string, file_name string, chunk_id string, text string, backend string, source_bucket int"
    read = store.candidate_manifest(store.read_candidates(spark, path, schema)).withColumnRenamed("count", "lines_read")
    return manifest.join(read, ["backend", "source_sha256"], "left")


@query(
    "src4_candidate_load",
    sql(
        f"""SELECT DISTINCT subject, problem FROM (
       SELECT file_name AS subject, 'FILE_NOT_COVERED' AS problem FROM f WHERE document_id % 11 = 1
       UNION ALL SELECT file_name, 'COVERAGE_NOT_PASSING' FROM f WHERE document_id % 11 <> 1 AND document_id % 13 = 2
       UNION ALL SELECT file_name, 'COUNT_MISMATCH' FROM f LEFT JOIN c USING (file_name) WHERE document_id % 11 <> 1 AND (document_id % 17 = 3 OR coalesce(n, 0) = 0)
       UNION ALL SELECT 'extra-' || document_id || '.docx', 'FILE_NOT_IN_MANIFEST' FROM f WHERE document_id % 19 = 4
       UNION ALL SELECT 'extra-' || document_id || '.docx', 'COUNT_MISMATCH' FROM f WHERE document_id % 19 = 4
       UNION ALL SELECT chunk_id, 'SOURCE_VERSION_MISMATCH' FROM active_chunks WHERE paragraph = 23
       UNION ALL SELECT chunk_id, 'CONTENT_HASH_MISMATCH' FROM active_chunks WHERE paragraph = 29
       UNION ALL SELECT chunk_id, 'DUPLICATE_CHUNK_ID' FROM active_chunks WHERE paragraph = 31)""",
        "active_chunks",
        extra={
            "f": "SELECT file_name, document_id FROM versions WHERE status = 'active'",
            "c": "SELECT file_name, count(*) AS n FROM active_chunks GROUP BY 1",
        },
    ),
)
def _(spark, folder):
    """Real candidates against a manifest with faults of every kind."""
    chunks = t.active_chunks(spark, folder)
    paragraph = F.col("paragraph_start")
    rows = chunks.select(
        F.lit("legacy").alias("backend"),
        "file_name",
        F.when(paragraph == 23, "other").otherwise(fixed.STAGING_VERSION).alias("source_version"),
        "chunk_id",
        "text",
        F.when(paragraph == 29, F.lit("0" * 64)).otherwise(F.col("content_hash")).alias("content_hash"),
        paragraph.alias("paragraph"),
    )
    repeats = rows.where("paragraph = 31").withColumn("file_name", F.lit("repeated.docx"))
    files = t.versions(spark, folder).where("status = 'active'").select("file_name", "document_id")
    counts = chunks.groupBy("file_name").agg(F.count("*").alias("n"))
    document = F.col("document_id")
    held = files.join(counts, "file_name", "left").where(document % 11 != 1).select(
        "file_name",
        F.lit("legacy").alias("backend"),
        (F.coalesce("n", F.lit(0)) + F.when(document % 17 == 3, 1).otherwise(0)).alias("count"),
        F.when(document % 13 == 2, "blocked").otherwise("pass").alias("coverage_status"),
    )
    extra = files.where(document % 19 == 4).select(
        F.concat(F.lit("extra-"), document, F.lit(".docx")).alias("file_name"),
        F.lit("legacy").alias("backend"),
        F.lit(1).cast("bigint").alias("count"),
        F.lit("pass").alias("coverage_status"),
    )
    return store.load_problems(
        rows.unionByName(repeats), held.unionByName(extra), files.select("file_name"), "legacy"
    )
