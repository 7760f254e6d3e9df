"""Shared SQL views of the checks, in the dialect of the checking database.

Each view is written apart from the Spark code that it checks.
"""

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}


def view(name: str, *needs: str, sql: str) -> None:
    VIEWS[name] = (needs, sql)


def sql(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """The body under the views it names and everything those need."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in VIEWS[name][0]:
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [
        f"{n} AS {'' if 'RECURSION' in VIEWS[n][1] else 'MATERIALIZED '}({VIEWS[n][1].replace('--RECURSION', '')})"
        for n in ordered
    ]
    parts += [f"{n} AS {'' if 'RECURSION' in s else 'MATERIALIZED '}({s})" for n, s in (extra or {}).items()]
    if body.lstrip().startswith("WITH"):
        body = f"SELECT * FROM ({body})"
    return f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body


FOLD = "replace(lower({0}), 'ß', 'ss')"


def fold(expression: str) -> str:
    return FOLD.format(expression)


def near_views(prefix: str, lists: str, same: str, *needs: str) -> dict[str, tuple[tuple[str, ...], str]]:
    """Views that end in ``{prefix}_near`` (content_hash, kept_hashes): near-equal texts that share a list.

    Two keys are near when twice the characters in their matching blocks is at
    least 85 % of both lengths. Blocks are found largest first, the earliest of
    equals, then left and right of it; in a text of 200 characters or more a
    character that makes over 1 % of it cannot start a block, only extend one;
    where nothing can start one, what both begin with is the block.
    Pairs that lengths, shared neighbouring characters or the edit distance rule
    out come first (what blocks leave out is an edit each; the distance is one of
    bytes, so letters beyond ASCII are made one of its characters).
    """
    p = prefix
    return {
        f"{p}_keys": (
            ("active_chunks", *needs),
            rf"""SELECT content_hash, any_value(regexp_replace({fold("text")}, '[^\p{{L}}\p{{N}}_]', '', 'g')) AS key
  FROM active_chunks WHERE content_hash IN (SELECT content_hash FROM {lists}) GROUP BY content_hash""",
        ),
        f"{p}_met": (
            (f"{p}_keys",),
            f"""SELECT DISTINCT x.content_hash AS lh, y.content_hash AS rh FROM {lists} x JOIN {lists} y ON {same} AND y.rank < x.rank AND x.content_hash <> y.content_hash""",
        ),
        f"{p}_grams": (
            (f"{p}_keys",),
            f"SELECT content_hash, substr(key, i, 2) AS g, count(*) AS n FROM (SELECT content_hash, key, unnest(range(1, length(key))) AS i FROM {p}_keys) GROUP BY ALL",
        ),
        f"{p}_likely": (
            (f"{p}_met", f"{p}_grams"),
            f"""WITH m AS (SELECT lh, rh, a.key AS a, b.key AS b, length(a.key) + length(b.key) AS total FROM {p}_met JOIN {p}_keys a ON a.content_hash = lh JOIN {p}_keys b ON b.content_hash = rh
      WHERE 2 * least(length(a.key), length(b.key)) >= 0.85 * (length(a.key) + length(b.key))),
    s AS (SELECT lh, rh, sum(least(x.n, y.n)) AS shared FROM m JOIN {p}_grams x ON x.content_hash = lh JOIN {p}_grams y ON y.content_hash = rh AND y.g = x.g GROUP BY ALL)
  SELECT lh, rh, a, b, string_split(a, '') AS la, string_split(b, '') AS lb FROM m LEFT JOIN s USING (lh, rh) WHERE a <> b AND coalesce(shared, 0) >= total / 2 - 0.225 * total - 1.001
    AND levenshtein(regexp_replace(a, '[^\\x00-\\x7F]', '~', 'g'), regexp_replace(b, '[^\\x00-\\x7F]', '~', 'g')) <= 0.15 * total + 0.001""",
        ),
        f"{p}_cells": (
            (f"{p}_likely",),
            f"""WITH l AS (SELECT lh, rh, i, la[i + 1] AS c FROM (SELECT lh, rh, la, unnest(range(len(la))) AS i FROM {p}_likely)),
    r AS (SELECT lh, rh, j, lb[j + 1] AS c, len(lb) AS n FROM (SELECT lh, rh, lb, unnest(range(len(lb))) AS j FROM {p}_likely)),
    k AS (SELECT lh, rh, c FROM r GROUP BY lh, rh, c, n HAVING n < 200 OR count(*) <= n // 100 + 1),
    e AS (SELECT lh, rh, i, j FROM r JOIN k USING (lh, rh, c) JOIN l USING (lh, rh, c)),
    g AS (SELECT *, i - row_number() OVER (PARTITION BY lh, rh, i - j ORDER BY i) AS core FROM e)
  SELECT lh, rh, i, j, row_number() OVER (PARTITION BY lh, rh, i - j, core ORDER BY i) AS run FROM g""",
        ),
        f"{p}_blocks": (
            (f"{p}_cells",),
            f"""--RECURSION
  SELECT lh, rh, 0::BIGINT AS alo, len(la)::BIGINT AS ahi, 0::BIGINT AS blo, len(lb)::BIGINT AS bhi, 0::BIGINT AS size FROM {p}_likely
  UNION ALL
  SELECT lh, rh, CASE side WHEN 0 THEN alo ELSE i + e + 1 END, CASE side WHEN 0 THEN i - k - d + 1 ELSE ahi END,
         CASE side WHEN 0 THEN blo ELSE j + e + 1 END, CASE side WHEN 0 THEN j - k - d + 1 ELSE bhi END, CASE side WHEN 0 THEN d + k + e ELSE 0 END
  FROM (
    SELECT lh, rh, alo, ahi, blo, bhi, m.i AS i, m.j AS j, m.k AS k,
           coalesce(list_position([la[m.i - m.k + 1 - t] = lb[m.j - m.k + 1 - t] FOR t IN range(0, least(m.i - m.k + 1 - alo, m.j - m.k + 1 - blo))], false) - 1,
                    least(m.i - m.k + 1 - alo, m.j - m.k + 1 - blo)) AS d,
           coalesce(list_position([la[m.i + 2 + t] = lb[m.j + 2 + t] FOR t IN range(0, least(ahi - 1 - m.i, bhi - 1 - m.j))], false) - 1,
                    least(ahi - 1 - m.i, bhi - 1 - m.j)) AS e
    FROM (SELECT s.lh, s.rh, alo, ahi, blo, bhi,
                 coalesce(arg_min({{'i': i, 'j': j, 'k': least(run, i - alo + 1, j - blo + 1)}}, (-least(run, i - alo + 1, j - blo + 1), i, j)) FILTER (i IS NOT NULL),
                          {{'i': alo - 1, 'j': blo - 1, 'k': 0::BIGINT}}) AS m
          FROM {p}_blocks s LEFT JOIN {p}_cells c ON c.lh = s.lh AND c.rh = s.rh AND i >= alo AND i < ahi AND j >= blo AND j < bhi
          WHERE alo < ahi AND blo < bhi GROUP BY s.lh, s.rh, alo, ahi, blo, bhi)
    JOIN {p}_likely USING (lh, rh)
  ), (VALUES (0), (1)) t(side) WHERE d + k + e > 0""",
        ),
        f"{p}_near": (
            (f"{p}_blocks",),
            f"""SELECT lh AS content_hash, list(rh) AS kept_hashes FROM (
    SELECT lh, rh FROM {p}_blocks JOIN {p}_likely USING (lh, rh) GROUP BY lh, rh, a, b HAVING 2 * sum(size) >= 0.85 * (length(a) + length(b))
    UNION SELECT lh, rh FROM {p}_met JOIN {p}_keys a ON a.content_hash = lh JOIN {p}_keys b ON b.content_hash = rh WHERE a.key = b.key) GROUP BY 1""",
        ),
    }


view(
    "versions",
    sql="""
  SELECT 'v' || doc_id AS version_id, doc_id, doc_id // 2 AS document_id, 'doc-' || (doc_id // 2) || '.docx' AS file_name,
         sha256(text) AS sha256, lang, source, n_chars, text,
         CASE WHEN doc_id = max(doc_id) OVER (PARTITION BY doc_id // 2) THEN 'active' ELSE 'superseded' END AS status
  FROM documents""",
)
view(
    "lines",
    "versions",
    sql="""
  SELECT version_id, doc_id, document_id, file_name, status, source, lang, paragraph, trim(line) AS text
  FROM (SELECT *, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) AS paragraph FROM versions)
  WHERE trim(line) <> ''""",
)
view(
    "chunks",
    "lines",
    sql="""
  SELECT version_id, doc_id, document_id, file_name, status, source, lang, paragraph, text,
         source || '/' || lang AS heading,
         sha256(file_name || chr(10) || source || '/' || lang || chr(10) || paragraph || chr(10) || paragraph || chr(10) || text) AS chunk_id,
         sha256(text) AS content_hash
  FROM lines""",
)
view("active_chunks", "chunks", sql="SELECT * FROM chunks WHERE status = 'active'")
view(
    "metadata",
    sql="""
  SELECT 'v' || doc_id AS version_id, doc_id, CASE WHEN toxic = 1 THEN 'nurse' ELSE 'all_staff' END AS applicable_scope,
         DATE '2024-01-01' + (doc_id % 60)::INTEGER AS effective_from,
         DATE '2024-01-01' + (doc_id % 60)::INTEGER + 45 AS review_due_at,
         CASE WHEN quality = 1 THEN 'approved' ELSE 'draft' END AS business_status
  FROM labels""",
)
view(
    "questions",
    sql=r"""
  SELECT 'q' || item_id AS query_id, item_id, trim(regexp_replace(text, '[\x00-\x1f\x7f]', '', 'g')) AS question, text AS passage
  FROM benchmark""",
)
view(
    "requests",
    "questions",
    sql="""
  SELECT query_id, item_id, question, ['unspecified', 'nurse', 'doctor', 'all_staff'][item_id % 4 + 1] AS audience_scope,
         DATE '2024-01-20' + (item_id % 3 * 20)::INTEGER AS as_of
  FROM questions""",
)
view(
    "expected",
    "questions",
    sql="""
  SELECT q.query_id, 'v' || d.doc_id AS source_id FROM questions q JOIN documents d ON contains(d.text, q.passage)""",
)
view(
    "cases",
    "questions",
    "expected",
    sql="""
  SELECT query_id AS case_id, item_id, question, NOT EXISTS (SELECT 1 FROM expected e WHERE e.query_id = q.query_id) AS no_answer,
         CASE WHEN NOT EXISTS (SELECT 1 FROM expected e WHERE e.query_id = q.query_id) THEN 'no_answer'
              ELSE ['fact', 'procedure', 'condition', 'prohibition', 'synthesis'][item_id % 5 + 1] END AS type
  FROM questions q""",
)
# --- lexical branch ----------------------------------------------------------
view(
    "chunk_tokens",
    "active_chunks",
    sql="""
  SELECT version_id, chunk_id, 'text' AS field, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM active_chunks
  UNION ALL
  SELECT version_id, chunk_id, 'heading', unnest(regexp_extract_all(lower(source || ' ' || lang), '[a-z0-9]+')) FROM active_chunks""",
)
view(
    "postings",
    "chunk_tokens",
    sql="SELECT version_id, chunk_id, field, token, count(*) AS tf FROM chunk_tokens GROUP BY ALL",
)
view(
    "question_tokens",
    "questions",
    sql="SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(question), '[a-z0-9]+')) AS token FROM questions",
)
view(
    "lexical_hits",
    "postings",
    "question_tokens",
    sql="""
  WITH df AS (SELECT token, count(DISTINCT (version_id, chunk_id)) AS df FROM postings GROUP BY token),
       w AS (SELECT version_id, chunk_id, token, sum(CASE field WHEN 'text' THEN 1 ELSE 2 END * (1 + ln(tf))) AS w
             FROM postings GROUP BY ALL),
       n AS (SELECT count(*) AS n FROM active_chunks),
       s AS (SELECT query_id, version_id, chunk_id, round(sum((ln((n + 1) / (df + 1)) + 1) * w), 9) AS score
             FROM question_tokens JOIN df USING (token) JOIN w USING (token), n GROUP BY ALL),
       r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, version_id, chunk_id) AS rank FROM s)
  SELECT * FROM r WHERE rank <= 20""",
)
# --- vector branch -----------------------------------------------------------
view(
    "chunk_buckets",
    "active_chunks",
    sql="""
  SELECT version_id, chunk_id, bucket, count(*) AS n
  FROM (SELECT version_id, chunk_id, ('0x' || substr(sha256(token), 1, 8))::BIGINT % 1024 AS bucket
        FROM (SELECT version_id, chunk_id, unnest(regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[一-鿿]|[a-z0-9]+')) AS token FROM active_chunks))
  GROUP BY ALL""",
)
view(
    "question_buckets",
    "questions",
    sql="""
  SELECT query_id, bucket, count(*) AS n
  FROM (SELECT query_id, ('0x' || substr(sha256(token), 1, 8))::BIGINT % 1024 AS bucket
        FROM (SELECT query_id, unnest(regexp_extract_all(replace(lower(question), 'ß', 'ss'), '[一-鿿]|[a-z0-9]+')) AS token FROM questions))
  GROUP BY ALL""",
)
view(
    "hash_scores",
    "chunk_buckets",
    "question_buckets",
    sql="""
  WITH cl AS (SELECT version_id, chunk_id, sqrt(sum(n * n)) AS l FROM chunk_buckets GROUP BY ALL),
       ql AS (SELECT query_id, sqrt(sum(n * n)) AS l FROM question_buckets GROUP BY ALL)
  SELECT query_id, version_id, chunk_id, round(d / (ql.l * cl.l), 9) AS score
  FROM (SELECT query_id, version_id, chunk_id, sum(q.n * c.n) AS d FROM question_buckets q JOIN chunk_buckets c USING (bucket) GROUP BY ALL)
  JOIN cl USING (version_id, chunk_id) JOIN ql USING (query_id)""",
)
view(
    "vector_hits",
    "hash_scores",
    sql="""
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, version_id, chunk_id) AS rank FROM hash_scores)
  WHERE rank <= 20""",
)
# --- fusion ------------------------------------------------------------------
view(
    "branch_hits",
    "vector_hits",
    "lexical_hits",
    sql="""
  SELECT h.*, c.content_hash, c.file_name, c.heading
  FROM (SELECT 'vector' AS branch, * FROM vector_hits UNION ALL BY NAME SELECT 'lexical' AS branch, * FROM lexical_hits) h
  JOIN active_chunks c USING (version_id, chunk_id)""",
)
view(
    "branch_ranks",
    "branch_hits",
    sql="""
  SELECT *, row_number() OVER (PARTITION BY query_id, branch ORDER BY rank) AS branch_rank
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, branch, content_hash ORDER BY rank) AS nth FROM branch_hits) WHERE nth = 1""",
)
view(
    "fused",
    "branch_ranks",
    sql="""
  WITH j AS (
    SELECT coalesce(v.query_id, l.query_id) AS query_id, coalesce(v.content_hash, l.content_hash) AS content_hash,
           coalesce(v.version_id, l.version_id) AS version_id, coalesce(v.chunk_id, l.chunk_id) AS chunk_id,
           coalesce(v.file_name, l.file_name) AS file_name, coalesce(v.heading, l.heading) AS heading,
           v.branch_rank AS vector_rank, l.branch_rank AS lexical_rank,
           coalesce(1e0 / (60 + v.branch_rank), 0e0) + coalesce(1e0 / (60 + l.branch_rank), 0e0) AS rrf_score
    FROM (FROM branch_ranks WHERE branch = 'vector') v
    FULL JOIN (FROM branch_ranks WHERE branch = 'lexical') l ON v.query_id = l.query_id AND v.content_hash = l.content_hash)
  SELECT *, CASE WHEN vector_rank IS NOT NULL AND lexical_rank IS NOT NULL THEN 'shared'
                 WHEN vector_rank IS NOT NULL THEN 'vector_only' ELSE 'lexical_only' END AS membership,
         row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, version_id, chunk_id, content_hash) AS fused_rank
  FROM j""",
)
view(
    "hybrid_hits",
    "fused",
    "vector_hits",
    sql="""
  SELECT query_id, version_id, chunk_id, content_hash, file_name, heading, rrf_score AS score, fused_rank AS rank FROM fused
  WHERE fused_rank <= 20 AND query_id IN (SELECT query_id FROM lexical_hits)
  UNION ALL
  SELECT query_id, version_id, chunk_id, content_hash, file_name, heading, score, rank FROM branch_hits
  WHERE branch = 'vector' AND query_id NOT IN (SELECT query_id FROM lexical_hits)""",
)
# --- arms --------------------------------------------------------------------
view(
    "arm_lists",
    "hybrid_hits",
    "branch_hits",
    sql="""
  SELECT query_id AS case_id, branch AS arm, version_id, chunk_id, content_hash, file_name, heading, score, rank FROM branch_hits
  UNION ALL SELECT query_id, a.arm, version_id, chunk_id, content_hash, file_name, heading, score, rank
  FROM hybrid_hits, (VALUES ('hybrid'), ('hybrid_audit')) a(arm)""",
)
VIEWS |= near_views("arm", "arm_lists", "x.case_id = y.case_id AND x.arm = y.arm", "arm_lists")


def greedy_fold(name: str, lists: str, near: str, keys: str, where: str) -> str:
    """The decisions of a list in rank order; ``keys`` tell lists apart, and ``head`` is a hit's heading."""
    same = " AND ".join(f"l.{k} = f.{k}" for k in keys.split(", "))
    own = ", ".join(f"f.{k}" for k in keys.split(", "))
    return f"""--RECURSION
  SELECT DISTINCT {keys}, 0::BIGINT AS rank, []::VARCHAR[] AS hashes, []::VARCHAR[] AS heads,
         NULL::VARCHAR AS version_id, NULL::VARCHAR AS chunk_id, NULL::VARCHAR AS content_hash, NULL::VARCHAR AS reason, NULL::VARCHAR AS kept_candidate_id
  FROM {lists} WHERE {where}
  UNION ALL
  SELECT {keys}, rank, CASE WHEN reason IS NULL THEN list_append(hashes, content_hash) ELSE hashes END,
         CASE WHEN reason IS NULL THEN list_append(heads, head) ELSE heads END, version_id, chunk_id, content_hash, reason,
         CASE reason WHEN 'exact_duplicate' THEN content_hash WHEN 'near_duplicate' THEN alike[1] WHEN 'heading_cap' THEN hashes[list_position(heads, head)] END
  FROM (SELECT *, CASE WHEN list_contains(hashes, content_hash) THEN 'exact_duplicate' WHEN len(alike) > 0 THEN 'near_duplicate'
                       WHEN len([h FOR h IN heads IF h = head]) >= 2 THEN 'heading_cap' WHEN len(hashes) >= 20 THEN 'top20_truncation' END AS reason
        FROM (SELECT {own}, l.rank, f.hashes, f.heads, l.version_id, l.chunk_id, l.content_hash, l.head,
                     [h FOR h IN f.hashes IF list_contains(coalesce(n.kept_hashes, []), h)] AS alike
              FROM {name} f JOIN {lists} l ON {same} AND l.rank = f.rank + 1 LEFT JOIN {near} n ON n.content_hash = l.content_hash))"""


view("arm_heads", "arm_lists", sql="SELECT *, file_name || '/' || heading AS head FROM arm_lists")
# The fold without the near-text test: nothing is near anything.
view("nothing_near", sql="SELECT NULL::VARCHAR AS content_hash, NULL::VARCHAR[] AS kept_hashes WHERE false")
view("arm_fold", "arm_heads", "arm_near", sql=greedy_fold("arm_fold", "arm_heads", "arm_near", "case_id, arm", "arm <> 'hybrid_audit'"))
view("hash_fold", "arm_heads", "nothing_near", sql=greedy_fold("hash_fold", "arm_heads", "nothing_near", "case_id, arm", "arm = 'vector'"))
view(
    "arm_decisions",
    "arm_fold",
    sql="""
  SELECT case_id, arm, rank, version_id, chunk_id, content_hash, reason, kept_candidate_id FROM arm_fold WHERE rank > 0
  UNION ALL
  SELECT case_id, arm, rank, version_id, chunk_id, content_hash, CASE WHEN rank > 20 THEN 'top20_truncation' END, NULL
  FROM arm_lists WHERE arm = 'hybrid_audit'""",
)
view(
    "arm_candidates",
    "arm_decisions",
    sql="""
  SELECT case_id, arm, version_id, chunk_id, content_hash, row_number() OVER (PARTITION BY case_id, arm ORDER BY rank) AS rank
  FROM arm_decisions WHERE reason IS NULL""",
)
view(
    "arm_reranked",
    "arm_candidates",
    "hash_scores",
    sql="""
  SELECT c.*, coalesce(s.score, 0) AS rerank_score,
         row_number() OVER (PARTITION BY case_id, arm ORDER BY coalesce(s.score, 0) DESC, c.rank) AS rerank_rank
  FROM arm_candidates c LEFT JOIN hash_scores s ON s.query_id = c.case_id AND s.version_id = c.version_id AND s.chunk_id = c.chunk_id""",
)
view(
    "arm_evidence",
    "arm_reranked",
    sql="""
  SELECT * FROM (SELECT *, max(rerank_score) OVER (PARTITION BY case_id, arm) AS best FROM arm_reranked WHERE rerank_rank <= 6) WHERE best >= 0.35""",
)
_ranked = """SELECT case_id, arm, source_id, row_number() OVER (PARTITION BY case_id, arm ORDER BY first_rank, source_id) AS rank
  FROM (SELECT case_id, arm, version_id AS source_id, min({rank}) AS first_rank FROM {table} GROUP BY ALL)"""
view("arm_candidate_ids", "arm_candidates", sql=_ranked.format(rank="rank", table="arm_candidates"))
view("arm_evidence_ids", "arm_evidence", sql=_ranked.format(rank="rerank_rank", table="arm_evidence"))
view(
    "arm_facts",
    "arm_candidate_ids",
    "arm_evidence_ids",
    "cases",
    "arm_evidence",
    sql="""
  WITH e AS (SELECT query_id AS case_id, count(*) AS expected_n FROM expected GROUP BY ALL),
       c AS (SELECT r.case_id, arm, count(*) AS candidates_n, count(x.source_id) AS hits_20, min(CASE WHEN x.source_id IS NOT NULL THEN rank END) AS first_hit
             FROM arm_candidate_ids r LEFT JOIN expected x ON x.query_id = r.case_id AND x.source_id = r.source_id WHERE rank <= 20 GROUP BY ALL),
       s AS (SELECT r.case_id, arm, count(*) AS evidence_n, count(x.source_id) AS hits_6, coalesce(sum(CASE WHEN x.source_id IS NOT NULL THEN 1 / log2(rank + 1) END), 0) AS dcg
             FROM arm_evidence_ids r LEFT JOIN expected x ON x.query_id = r.case_id AND x.source_id = r.source_id WHERE rank <= 6 GROUP BY ALL),
       ideal AS (SELECT case_id, sum(1 / log2(i + 1)) AS idcg FROM e, range(1, 7) t(i) WHERE i <= expected_n GROUP BY ALL),
       a AS (SELECT * FROM (VALUES ('vector'), ('lexical'), ('hybrid'), ('hybrid_audit')) v(arm))
  SELECT k.case_id, k.item_id, k.type, k.no_answer, a.arm, coalesce(expected_n, 0) AS expected_n, coalesce(candidates_n, 0) AS candidates_n, coalesce(hits_20, 0) AS hits_20,
         coalesce(evidence_n, 0) AS evidence_n, coalesce(hits_6, 0) AS hits_6, coalesce(1 / first_hit, 0) AS rr,
         CASE WHEN expected_n > 0 THEN coalesce(dcg, 0) / idcg END AS ndcg_6,
         coalesce(evidence_n, 0) > 0 AS answered
  FROM cases k CROSS JOIN a LEFT JOIN e USING (case_id) LEFT JOIN c USING (case_id, arm) LEFT JOIN s USING (case_id, arm) LEFT JOIN ideal USING (case_id)""",
)
# --- conversations -----------------------------------------------------------
view(
    "messages",
    sql="""
  SELECT 'm' || conv_id || '-' || turn AS message_id, 's' || conv_id AS session_id, conv_id, turn, role, text AS content,
         CASE WHEN role = 'user' THEN 'submitted' WHEN (conv_id * 7 + turn) % 10 = 0 THEN 'error'
              WHEN (conv_id * 7 + turn) % 10 IN (1, 2) THEN 'refused' ELSE 'answered' END AS status,
         CASE WHEN role = 'assistant' THEN 'm' || conv_id || '-' || (turn - 1) END AS reply_to_message_id,
         TIMESTAMP '2024-01-01' + to_minutes(conv_id * 60 + turn) AS created_at
  FROM conversations WHERE role IN ('user', 'assistant')""",
)
view(
    "stored_messages",
    "messages",
    sql="""
  SELECT *, CASE status WHEN 'refused' THEN 'INSUFFICIENT_EVIDENCE' WHEN 'error' THEN 'PROVIDER_UNAVAILABLE' END AS reason_code FROM messages""",
)
view(
    "retried",
    "messages",
    sql="""
  SELECT * FROM messages UNION ALL BY NAME
  SELECT * REPLACE (message_id || 'r' AS message_id, created_at + INTERVAL 30 SECOND AS created_at) FROM messages WHERE role = 'assistant' AND conv_id % 5 = 0""",
)
view(
    "sessions",
    sql="""
  SELECT DISTINCT 's' || conv_id AS session_id, conv_id, TIMESTAMP '2024-01-01' + to_minutes(conv_id * 60) AS created_at FROM conversations""",
)
view(
    "clicks",
    sql="""
  SELECT event_id, 'm' || user_id || '-' || (event_id % 4 + 1) AS message_id, event_type = 'view' AS helpful,
         CASE event_type WHEN 'error' THEN 'not_answered' WHEN 'click' THEN 'missing_step' WHEN 'signup' THEN 'version_mismatch'
              WHEN 'purchase' THEN 'citation_mismatch' END AS reason, ts AS created_at
  FROM events""",
)
view(
    "valid_clicks",
    "clicks",
    "messages",
    sql="""
  SELECT c.* FROM clicks c JOIN messages m USING (message_id) WHERE m.role = 'assistant' AND m.status IN ('answered', 'refused')""",
)
view(
    "latest_clicks",
    "valid_clicks",
    sql="""
  SELECT * FROM valid_clicks QUALIFY row_number() OVER (PARTITION BY message_id ORDER BY created_at DESC, event_id DESC) = 1""",
)
