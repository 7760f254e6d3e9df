"""Retrieval queries: tokens, branches, fusion, evidence, citations."""

from pyspark.sql import functions as F

from citeloom import fixed
from citeloom.catalogue import query
from citeloom.catalogue.shared import branches, diagnostic_index, hash_index, lexical_index, question_count, selected
from citeloom.catalogue.sqlbase import fold, greedy_fold, near_views, sql
from citeloom.catalogue.tidy import tidy
from citeloom.functions import safety as sf
from citeloom.functions import text as tx
from citeloom.operators import dedup, evidence, fusion, lexical, vectors
from citeloom.plans import ask
from citeloom.sources import tables as t


# --- questions and tokens --------------------------------------------------------


@query(
    "prj1_clean_questions",
    r"""
  SELECT item_id, q AS question, length(q) BETWEEN 1 AND 1000 AS valid FROM (SELECT item_id, trim(regexp_replace(text, '[\x00-\x1f\x7f]', '', 'g')) AS q FROM benchmark)""",
)
def _(spark, folder):
    cleaned = tx.clean_question(F.col("text"))
    rows = t.load(spark, folder, "benchmark").select("item_id", cleaned.alias("question"))
    valid = tx.question_problem(F.col("question")).isNull()
    return rows.withColumn("valid", valid)


@query(
    "prj2_query_variants",
    r"""
  WITH q AS (SELECT item_id, trim(regexp_replace(text, '[\x00-\x1f\x7f]', '', 'g')) || ' (hd , CRRT)' AS q FROM benchmark),
       n AS (SELECT item_id, q, regexp_replace(trim(regexp_replace(q, '\s+', ' ', 'g')), '\s+([,.;:!?])', '\1', 'g') AS n FROM q)
  SELECT item_id, q AS original, n AS normalised, replace(replace(n, '(hd, CRRT)', '(血液透析, CRRT)'), 'CRRT)', '连续性肾脏替代治疗)') AS aliased,
         'HD→血液透析|CRRT→连续性肾脏替代治疗' AS aliases_applied FROM n""",
)
def _(spark, folder):
    """Every question gets a bracket with two aliases and a stray space."""
    original = F.concat(tx.clean_question(F.col("text")), F.lit(" (hd , CRRT)"))
    rows = t.load(spark, folder, "benchmark").select("item_id", original.alias("original"))
    rows = rows.withColumn("normalised", tx.normalise_query(F.col("original")))
    aliased, applied = tx.apply_aliases(F.col("normalised"))
    return tidy(rows.select("item_id", "original", "normalised", aliased.alias("aliased"), applied.alias("aliases_applied")))


@query(
    "flt17_dangerous_questions",
    rf"""
  SELECT doc_id, regexp_matches(text, '([A-Za-z]:[\\/])([^\\/\s]+[\\/])*[^\\/\s]+|(\\\\|//)[^\\/\s]+[\\/][^\\/\s]+|(^|[^A-Za-z0-9_:/])/([^/\s]+/)+[^/\s]+')
         OR contains({fold("text")}, 'api_key') OR contains({fold("text")}, 'access_token') OR contains({fold("text")}, 'bearer ') OR contains({fold("text")}, 'sk-') AS dangerous
  FROM documents""",
)
def _(spark, folder):
    docs = t.load(spark, folder, "documents")
    return docs.select("doc_id", sf.is_dangerous_question(F.col("text")).alias("dangerous"))


@query(
    "fn1_lexical_tokens",
    """
  SELECT doc_id, token, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS token FROM documents) GROUP BY ALL""",
)
def _(spark, folder):
    docs = t.load(spark, folder, "documents")
    tokens = docs.select("doc_id", F.explode(tx.lexical_tokens(F.col("text"))).alias("token"))
    return tokens.groupBy("doc_id", "token").agg(F.count("*").alias("n"))


@query(
    "fn2_diagnostic_tokens",
    f"SELECT DISTINCT doc_id, unnest(regexp_extract_all({fold('text')}, '[a-z0-9]+')) AS token FROM documents",
)
def _(spark, folder):
    docs = t.load(spark, folder, "documents")
    return docs.select("doc_id", F.explode(tx.diagnostic_tokens(F.col("text"))).alias("token"))


@query(
    "fn3_hash_embedding",
    rf"""
  WITH b AS (SELECT conv_id, turn, bucket, count(*) AS n FROM (SELECT conv_id, turn, ('0x' || substr(sha256(token), 1, 8))::BIGINT % 1024 AS bucket
             FROM (SELECT conv_id, turn, unnest(regexp_extract_all({fold("text")}, '[一-鿿]|[a-z0-9]+')) AS token FROM conversations)) GROUP BY ALL)
  SELECT 'm' || conv_id || '-' || turn AS message_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY conv_id, turn)), 6) AS weight FROM b""",
)
def _(spark, folder):
    texts = t.load(spark, folder, "conversations").select(
        F.concat(F.lit("m"), "conv_id", F.lit("-"), "turn").alias("message_id"), "text"
    )
    return tidy(vectors.hash_vector(texts, "message_id"))


@query(
    "fn4_hash_scores",
    rf"""
  WITH m AS (SELECT conv_id, turn, role, ('0x' || substr(sha256(token), 1, 8))::BIGINT % 1024 AS bucket
             FROM (SELECT conv_id, turn, role, unnest(regexp_extract_all({fold("text")}, '[一-鿿]|[a-z0-9]+')) AS token FROM conversations)),
       b AS (SELECT conv_id, turn, bucket, count(*) AS n FROM m GROUP BY ALL),
       l AS (SELECT conv_id, turn, sqrt(sum(n * n)) AS l FROM b GROUP BY ALL),
       p AS (SELECT a.conv_id, a.turn FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant' AND u.role = 'user')
  SELECT p.conv_id, p.turn, round(coalesce((SELECT sum(x.n * y.n) FROM b x JOIN b y USING (bucket) WHERE x.conv_id = p.conv_id AND x.turn = p.turn AND y.conv_id = p.conv_id AND y.turn = p.turn - 1)
           / (la.l * lu.l), 0), 6) AS score
  FROM p LEFT JOIN l la ON la.conv_id = p.conv_id AND la.turn = p.turn LEFT JOIN l lu ON lu.conv_id = p.conv_id AND lu.turn = p.turn - 1""",
)
def _(spark, folder):
    """Score every reply against the user turn before it."""
    turns = t.load(spark, folder, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    pairs = turns.where("role = 'assistant'").join(asked, ["conv_id", "turn"])
    return tidy(pairs.select("conv_id", "turn", vectors.hash_score(F.col("question"), F.col("text")).alias("score")))


@query(
    "fn5_near_text_keys",
    sql(rf"SELECT version_id, regexp_replace({fold('text')}, '[^\p{{L}}\p{{N}}_]', '', 'g') AS near_key FROM versions", "versions"),
)
def _(spark, folder):
    docs = t.document_texts(spark, folder)
    return docs.select("version_id", tx.near_text_key(F.col("text")).alias("near_key"))


@query("fn6_similar_neighbours")
def _(spark, folder):
    """Near-equality of each block and the one after it in its document; columns decide all but texts of like length."""
    import pandas as pd
    from pyspark.sql import Window
    from pyspark.sql.types import BooleanType

    @F.pandas_udf(BooleanType())
    def near(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([a is not None and dedup.similar(a, b) for a, b in zip(left, right)], dtype=bool)

    order = Window.partitionBy("version_id").orderBy("paragraph_start")
    blocks = t.chunks(spark, folder).select("version_id", "paragraph_start", tx.near_text_key(F.col("text")).alias("key"))
    pairs = blocks.withColumn("next", F.lead("key").over(order)).where("next is not null")
    open_ = (F.col("key") != F.col("next")) & dedup.lengths_allow(F.length("key"), F.length("next"))
    undecided = near(F.when(open_, F.col("key")), F.when(open_, F.col("next")))
    return tidy(pairs.select("version_id", "paragraph_start", F.when(open_, undecided).otherwise(F.col("key") == F.col("next")).alias("similar")))


# --- lexical ---------------------------------------------------------------------


@query(
    "jn2_lexical_matches",
    sql(
        """
  SELECT query_id, token, count(*) FILTER (field = 'text') AS text_chunks, count(*) FILTER (field = 'heading') AS heading_chunks, sum(tf)::BIGINT AS occurrences
  FROM question_tokens JOIN postings USING (token) GROUP BY ALL""",
        "postings",
        "question_tokens",
    ),
)
def _(spark, folder):
    rows = lexical.match_statistics(t.questions(spark, folder), t.active_chunks(spark, folder))
    return tidy(rows)


@query(
    "agg1_lexical_hits",
    sql("SELECT query_id, version_id, chunk_id, round(score, 6) AS score, rank FROM lexical_hits", "lexical_hits"),
)
def _(spark, folder):
    hits = lexical.lexical_hits(
        t.questions(spark, folder), lexical_index(spark, folder), n_queries=question_count(spark, folder)
    )
    return tidy(hits)


@query(
    "agg2_diagnostic_hits",
    sql(
        f"""
  WITH k AS (SELECT DISTINCT version_id, chunk_id, unnest(regexp_extract_all({fold("text")}, '[a-z0-9]+')) AS token FROM active_chunks),
       q AS (SELECT DISTINCT query_id, unnest(regexp_extract_all({fold("question")}, '[a-z0-9]+')) AS token FROM questions),
       n AS (SELECT count(DISTINCT (version_id, chunk_id)) AS n FROM k), df AS (SELECT token, count(*) AS df FROM k GROUP BY 1),
       s AS (SELECT query_id, version_id, chunk_id, round(sum(ln((n + 1) / (df + 1)) + 1), 9) AS score FROM q JOIN k USING (token) JOIN df USING (token), n GROUP BY ALL)
  SELECT query_id, version_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, version_id, chunk_id) AS rank
  FROM s QUALIFY rank <= 20""",
        "active_chunks",
        "questions",
    ),
)
def _(spark, folder):
    hits = lexical.diagnostic_hits(
        t.questions(spark, folder), diagnostic_index(spark, folder), n_queries=question_count(spark, folder)
    )
    return tidy(hits)


# --- vectors ---------------------------------------------------------------------

_DENSE = """
  WITH s AS (SELECT q.vec_id AS q, c.vec_id AS c, c.label, round(list_dot_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[])
               / (sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(c.embedding::DOUBLE[], c.embedding::DOUBLE[]))), 9) AS score
             FROM embeddings q, embeddings c)"""


@query(
    "jn3_vector_search",
    _DENSE
    + """
  SELECT 'e' || q AS query_id, 'v1' AS version_id, 'c' || lpad(c::VARCHAR, 8, '0') AS chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY q ORDER BY score DESC, c) AS rank
  FROM s QUALIFY rank <= 10""",
)
def _(spark, folder):
    queries = t.vector_queries(spark, folder)
    n = t.load(spark, folder, "embeddings").count()
    return tidy(vectors.vector_hits(queries, t.vector_points(spark, folder), n_queries=n, k=10))


@query(
    "flt11_vector_problems",
    """
  SELECT 'v1' AS version_id, 'c' || lpad((vec_id - CASE WHEN vec_id % 10 = 9 THEN 1 ELSE 0 END)::VARCHAR, 8, '0') AS chunk_id,
         CASE WHEN label = 3 THEN 'VECTOR_DIMENSION' ELSE 'VECTOR_NOT_FINITE' END AS problem FROM embeddings WHERE label = 3 OR label = 5
  UNION ALL SELECT 'v1', 'c' || lpad((vec_id - 1)::VARCHAR, 8, '0'), 'VECTOR_REPEATED' FROM embeddings WHERE vec_id % 10 = 9""",
)
def _(spark, folder):
    """Vectors with a short, a non-finite and a repeated one among them."""
    shifted = F.col("vec_id") - F.when(F.col("vec_id") % 10 == 9, 1).otherwise(0)
    broken = (
        F.when(F.col("label") == 3, F.slice("embedding", 1, 63))
        .when(F.col("label") == 5, F.transform("embedding", lambda x, i: F.when(i == 7, F.lit(float("nan"))).otherwise(x)))
        .otherwise(F.col("embedding"))
    )
    points = t.load(spark, folder, "embeddings").select(
        F.lit("v1").alias("version_id"),
        F.format_string("c%08d", shifted).alias("chunk_id"),
        broken.alias("embedding"),
    )
    return vectors.check_vectors(points, 64)


@query(
    "udf1_embedding_batches",
    rf"""
  WITH b AS (SELECT item_id, bucket, count(*) AS n FROM (SELECT item_id, ('0x' || substr(sha256(token), 1, 8))::BIGINT % 1024 AS bucket
             FROM (SELECT item_id, unnest(regexp_extract_all({fold("text")}, '[一-鿿]|[a-z0-9]+')) AS token FROM benchmark)) GROUP BY ALL)
  SELECT item_id, 1024::BIGINT AS dimension, round(max(n) / sqrt(sum(n * n)), 6) AS peak, count(*) AS filled FROM b GROUP BY item_id""",
)
def _(spark, folder):
    rows = vectors.embed(t.load(spark, folder, "benchmark"), "item_id")
    return tidy(
        rows.select(
            "item_id",
            F.size("embedding").alias("dimension"),
            F.array_max("embedding").alias("peak"),
            F.size(F.filter("embedding", lambda x: x > 0)).cast("bigint").alias("filled"),
        )
    )


@query(
    "udf2_rerank_pairs",
    """
  SELECT a.conv_id, a.turn, round(least(length(a.text), length(u.text)) / greatest(length(a.text), length(u.text)), 6) AS rerank_score
  FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1 WHERE a.role = 'assistant' AND u.role = 'user'""",
)
def _(spark, folder):
    """A caller's own scorer: how close the two lengths are."""
    turns = t.load(spark, folder, "conversations")
    asked = turns.where("role = 'user'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    pairs = turns.where("role = 'assistant'").join(asked, ["conv_id", "turn"])

    def scorer(batch):
        return [min(len(q), len(a)) / max(len(q), len(a)) for q, a in batch]

    return tidy(vectors.rerank_scores(pairs, scorer).select("conv_id", "turn", "rerank_score"))


@query(
    "jn3_hash_search",
    sql("SELECT query_id, version_id, chunk_id, round(score, 6) AS score, rank FROM vector_hits", "vector_hits"),
)
def _(spark, folder):
    hits = vectors.hash_hits(
        t.questions(spark, folder), hash_index(spark, folder), n_queries=question_count(spark, folder)
    )
    return tidy(hits)


# --- fusion ----------------------------------------------------------------------


@query(
    "jn4_rrf_fusion",
    sql(
        "SELECT query_id, version_id, chunk_id, round(rrf_score, 6) AS score, fused_rank AS rank FROM fused WHERE fused_rank <= 20",
        "fused",
    ),
)
def _(spark, folder):
    merged = fusion.fused_hits(fusion.fuse(*branches(spark, folder)))
    return tidy(merged, "query_id", "version_id", "chunk_id", "score", "rank")


@query(
    "win3_fusion_facts",
    sql(
        "SELECT query_id, content_hash AS candidate_id, membership, vector_rank, lexical_rank, fused_rank, round(rrf_score, 6) AS rrf_score FROM fused",
        "fused",
    ),
)
def _(spark, folder):
    facts = fusion.fuse(*branches(spark, folder))
    return tidy(
        facts, "query_id", "candidate_id", "membership", "vector_rank", "lexical_rank", "fused_rank", "rrf_score"
    )


@query(
    "win3_fusion_drops",
    sql(
        """
  SELECT query_id, content_hash AS candidate_id, 'rrf_content_hash_merge' AS reason, content_hash AS kept_candidate_id, chunk_id AS source_id
  FROM (SELECT *, row_number() OVER (PARTITION BY query_id, branch, content_hash ORDER BY rank) AS nth FROM branch_hits) WHERE nth > 1
  UNION ALL SELECT query_id, content_hash, 'top20_truncation', NULL, chunk_id FROM fused WHERE fused_rank > 20""",
        "fused",
    ),
)
def _(spark, folder):
    vector, words = branches(spark, folder)
    drops = fusion.fusion_drops(vector, words, fusion.fuse(vector, words))
    return tidy(drops, "query_id", "candidate_id", "reason", "kept_candidate_id", "source_id")


@query(
    "win4_branch_facts",
    sql(
        "SELECT query_id, branch, content_hash AS candidate_id, rank, round(score, 6) AS retrieval_score, chunk_id AS source_id FROM branch_hits",
        "branch_hits",
    ),
)
def _(spark, folder):
    vector, words = branches(spark, folder)
    facts = fusion.branch_facts(vector, "vector").unionByName(fusion.branch_facts(words, "lexical"))
    return tidy(facts, "query_id", "branch", "candidate_id", "rank", "retrieval_score", "source_id")


@query(
    "flt1_active_hits",
    sql(
        """
  SELECT query_id, version_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM lexical_hits
  WHERE version_id IN (SELECT version_id FROM versions WHERE document_id % 3 <> 0)""",
        "lexical_hits",
    ),
)
def _(spark, folder):
    """The second check: a third of the documents was withdrawn after the search."""
    hits = lexical.lexical_hits(
        t.questions(spark, folder), lexical_index(spark, folder), n_queries=question_count(spark, folder)
    )
    still = t.versions(spark, folder).where("document_id % 3 <> 0")
    return tidy(fusion.active_only(hits, still), "query_id", "version_id", "chunk_id", "rank")


# --- deduplication ----------------------------------------------------------------


_DECISIONS = """
  SELECT case_id AS query_id, content_hash AS candidate_id, rank, reason IS NULL AS kept,
         CASE WHEN reason IS NULL THEN sum(CASE WHEN reason IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY rank)::BIGINT END AS kept_rank, reason, kept_candidate_id
  FROM {0} WHERE arm = '{1}' AND rank > 0"""


@query("win2_greedy_dedup", sql(_DECISIONS.format("arm_fold", "hybrid"), "arm_fold"))
def _(spark, folder):
    hits = fusion.choose_strategy("hybrid", *branches(spark, folder))
    rows = dedup.deduplicate(hits)
    return tidy(rows, "query_id", "candidate_id", "rank", "kept", "kept_rank", "reason", "kept_candidate_id")


@query(
    "win2_hash_heading_dedup",
    sql(_DECISIONS.format("hash_fold", "vector"), "hash_fold"),
)
def _(spark, folder):
    """The fold without the near-text test, on a branch that repeats hashes."""
    vector, _unused = branches(spark, folder)
    rows = dedup.deduplicate(vector, near_text=False)
    return tidy(rows, "query_id", "candidate_id", "rank", "kept", "kept_rank", "reason", "kept_candidate_id")


@query(
    "win2b_heading_diversity",
    sql(
        """
  WITH h AS (SELECT *, row_number() OVER (PARTITION BY query_id, file_name, heading ORDER BY fused_rank) AS nth FROM fused WHERE fused_rank <= 20),
       p AS (SELECT *, count(*) FILTER (nth <= 2) OVER (PARTITION BY query_id ORDER BY fused_rank) AS place FROM h)
  SELECT query_id, content_hash AS candidate_id, fused_rank AS rank, nth <= 2 AS kept, CASE WHEN nth <= 2 THEN place END AS kept_rank,
         CASE WHEN nth > 2 THEN 'heading_cap' END AS reason FROM p""",
        "fused",
    ),
)
def _(spark, folder):
    hits = fusion.fused_hits(fusion.fuse(*branches(spark, folder)))
    return tidy(dedup.heading_diversity(hits), "query_id", "candidate_id", "rank", "kept", "kept_rank", "reason")


# --- governed retrieval -------------------------------------------------------------

_GOVERNED = {
    "live": "SELECT version_id, m.* EXCLUDE (version_id, doc_id) FROM versions v JOIN metadata m USING (version_id) WHERE v.status = 'active' AND business_status = 'approved'",
    "may": """SELECT query_id, version_id FROM requests JOIN live ON applicable_scope IN ('all_staff', CASE audience_scope WHEN 'unspecified' THEN 'all_staff' ELSE audience_scope END)
      AND effective_from <= as_of AND review_due_at >= as_of""",
    "gw": """SELECT version_id, chunk_id, token, sum(CASE field WHEN 'text' THEN 1 ELSE 2 END * (1 + ln(tf))) AS w FROM postings GROUP BY ALL""",
    "gn": "SELECT query_id, count(*) AS n FROM may JOIN active_chunks USING (version_id) GROUP BY 1",
    "gdf": "SELECT query_id, token, count(*) AS df FROM question_tokens JOIN gw USING (token) JOIN may USING (query_id, version_id) GROUP BY ALL",
    "gl": """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, version_id, chunk_id) AS rank FROM (
      SELECT query_id, version_id, chunk_id, round(sum((ln((n + 1) / (df + 1)) + 1) * w), 9) AS score FROM question_tokens JOIN gdf USING (query_id, token) JOIN gn USING (query_id)
      JOIN gw USING (token) JOIN may USING (query_id, version_id) GROUP BY ALL) QUALIFY rank <= 20""",
    "gv": """SELECT query_id, version_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, version_id, chunk_id) AS rank
      FROM hash_scores JOIN may USING (query_id, version_id) QUALIFY rank <= 20""",
    "gb": """SELECT h.*, c.content_hash, c.file_name, c.heading FROM (SELECT 'v' AS branch, * FROM gv UNION ALL BY NAME SELECT 'l' AS branch, * FROM gl) h JOIN active_chunks c USING (version_id, chunk_id)""",
    "gr": """SELECT *, row_number() OVER (PARTITION BY query_id, branch ORDER BY rank) AS br FROM (SELECT *, row_number() OVER (PARTITION BY query_id, branch, content_hash ORDER BY rank) AS nth FROM gb) WHERE nth = 1""",
    "gf": """SELECT query_id, content_hash, arg_min(version_id, branch = 'l') AS version_id, arg_min(chunk_id, branch = 'l') AS chunk_id, arg_min(file_name || '/' || heading, branch = 'l') AS head,
      sum(1e0 / (60 + br)) AS score FROM gr GROUP BY ALL""",
    "gh": """SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, version_id, chunk_id, content_hash) AS rank FROM gf QUALIFY rank <= 20""",
}
_GOVERNED |= {n: body for n, (_, body) in near_views("g", "gh", "x.query_id = y.query_id").items()}
_GOVERNED["gk"] = greedy_fold("gk", "gh", "g_near", "query_id", "true")


#: The lexical branch asks the cleaned question, its normalised form and that with its aliases replaced.
_VARIANTS = r"""
  WITH n AS (SELECT query_id, question AS q, regexp_replace(trim(regexp_replace(question, '\s+', ' ', 'g')), '\s+([,.;:!?，。！？；：、）》】』」’”])', '\1', 'g') AS n FROM questions),
       v AS (SELECT query_id, unnest([q, n, ALIASED]) AS q FROM n)
  SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(q), '[a-z0-9]+')) AS token FROM v"""


def _aliased(column: str) -> str:
    """Aliases replaced in turn; twice, since RE2 can't look around and so takes the space between two of them."""
    for alias, canonical in fixed.QUERY_ALIASES:
        if alias.isascii():
            for _ in range(2):
                column = rf"regexp_replace({column}, '(^|[^A-Za-z0-9]){alias}([^A-Za-z0-9]|$)', '\1{canonical}\2', 'gi')"
        else:
            column = f"replace({column}, '{alias}', '{canonical}')"
    return column


_NORMALISED = {"variant_tokens": _VARIANTS.replace("ALIASED", _aliased("n"))}
_NORMALISED |= {name: body.replace("question_tokens", "variant_tokens") for name, body in _GOVERNED.items()}


def _candidates(extra: dict[str, str]) -> str:
    return sql(
        "SELECT query_id, version_id, chunk_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM gk JOIN gh USING (query_id, version_id, chunk_id, rank) WHERE reason IS NULL",
        "requests",
        "metadata",
        "postings",
        "question_tokens",
        "hash_scores",
        extra=extra,
    )


@query("jn5_governed_candidates", _candidates(_GOVERNED))
def _(spark, folder):
    """Hybrid candidates of each request from the versions it may see."""
    rows = ask.retrieve(
        t.requests(spark, folder),
        t.chunks(spark, folder),
        t.versions(spark, folder),
        t.business_metadata(spark, folder),
        strategy="hybrid",
        n_queries=question_count(spark, folder),
    )
    return tidy(rows, "query_id", "version_id", "chunk_id", "score", "rank")


@query("jn5_normalised_strategy", _candidates(_NORMALISED))
def _(spark, folder):
    rows = ask.retrieve(
        t.requests(spark, folder),
        t.chunks(spark, folder),
        t.versions(spark, folder),
        t.business_metadata(spark, folder),
        strategy="hybrid_normalized",
        n_queries=question_count(spark, folder),
    )
    return tidy(rows, "query_id", "version_id", "chunk_id", "score", "rank")


# --- rerank, gate, evidence -----------------------------------------------------------


def located(spark, folder, rows):
    """Evidence with the locator columns of its chunks."""
    none = F.lit(None).cast("int")
    places = t.active_chunks(spark, folder).select("version_id", "chunk_id", "paragraph_start", "paragraph_end")
    return (
        rows.drop("paragraph_start", "paragraph_end")
        .join(places, ["version_id", "chunk_id"])
        .withColumns({"page": none, "page_end": none, "table_id": F.lit(None).cast("string")})
    )


_HYBRID = "(FROM arm_evidence WHERE arm = 'hybrid')"


@query(
    "win1_rerank_evidence",
    sql(
        """
  SELECT case_id AS query_id, 'S' || rerank_rank AS reference_id, version_id, chunk_id, round(rerank_score, 6) AS rerank_score
  FROM arm_reranked WHERE arm = 'hybrid' AND rerank_rank <= 6""",
        "arm_reranked",
    ),
)
def _(spark, folder):
    _c, reranked, _e = selected(spark, folder)
    rows = evidence.select_evidence(reranked)
    return tidy(rows, "query_id", "reference_id", "version_id", "chunk_id", "rerank_score")


@query(
    "flt10_relevance_gate",
    sql(
        f"SELECT case_id AS query_id, 'S' || rerank_rank AS reference_id, chunk_id, round(rerank_score, 6) AS rerank_score FROM {_HYBRID}",
        "arm_evidence",
    ),
)
def _(spark, folder):
    _c, _r, shown = selected(spark, folder)
    return tidy(shown, "query_id", "reference_id", "chunk_id", "rerank_score")


@query(
    "win4_diagnostic_trace",
    sql(
        """
  SELECT r.case_id AS query_id, r.chunk_id AS source_id, r.rank AS candidate_rank, round(r.rerank_score, 6) AS rerank_score, e.rerank_rank IS NOT NULL AS selected, e.rerank_rank AS selected_rank
  FROM (FROM arm_reranked WHERE arm = 'hybrid') r LEFT JOIN (FROM arm_evidence WHERE arm = 'hybrid') e USING (case_id, version_id, chunk_id)""",
        "arm_evidence",
    ),
)
def _(spark, folder):
    _c, reranked, shown = selected(spark, folder)
    rows = evidence.diagnostic_trace(reranked, shown)
    return tidy(rows, "query_id", "source_id", "candidate_rank", "rerank_score", "selected", "selected_rank")


@query(
    "agg32_retrieval_diagnostics",
    sql(
        """
  WITH c AS (SELECT case_id, count(*) AS n FROM arm_candidates WHERE arm = 'hybrid' GROUP BY 1), e AS (SELECT case_id, count(*) AS n, max(rerank_score) AS top FROM arm_evidence WHERE arm = 'hybrid' GROUP BY 1)
  SELECT query_id, coalesce(c.n, 0) AS candidate_count, coalesce(e.n, 0) AS evidence_count, round(top, 6) AS highest_rerank_score,
         CASE WHEN e.n > 0 THEN 'ready' ELSE 'refused' END AS status, CASE WHEN e.n IS NULL THEN 'INSUFFICIENT_EVIDENCE' END AS reason_code
  FROM questions LEFT JOIN c ON c.case_id = query_id LEFT JOIN e ON e.case_id = query_id""",
        "arm_evidence",
    ),
)
def _(spark, folder):
    candidates, reranked, shown = selected(spark, folder)
    return tidy(evidence.retrieval_status(t.questions(spark, folder), candidates, reranked, shown))


@query(
    "prj10_retrieval_trace",
    sql(
        """
  WITH e AS (SELECT case_id, string_agg(chunk_id, '|' ORDER BY rerank_rank) AS ids, string_agg('S' || rerank_rank || '=' || chunk_id, '|' ORDER BY rerank_rank) AS map FROM arm_evidence WHERE arm = 'hybrid' GROUP BY 1)
  SELECT c.case_id AS query_id, string_agg(chunk_id, '|' ORDER BY rank) AS candidate_source_ids, coalesce(any_value(e.ids), '') AS evidence_source_ids, any_value(e.map) AS evidence_reference_map
  FROM arm_candidates c LEFT JOIN e USING (case_id) WHERE arm = 'hybrid' GROUP BY 1""",
        "arm_evidence",
    ),
)
def _(spark, folder):
    candidates, _r, shown = selected(spark, folder)
    rows = evidence.retrieval_trace(candidates, shown)
    pairs = F.transform(F.map_entries("evidence_reference_map"), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return tidy(rows.withColumn("evidence_reference_map", pairs))


_LOCATED = {
    "ev": f"SELECT e.case_id, 'S' || rerank_rank AS reference_id, rerank_rank, c.* FROM {_HYBRID} e JOIN active_chunks c USING (version_id, chunk_id)",
    "shown": r"""SELECT *, trim(regexp_replace(text, '[\r\n\t]+', ' ', 'g')) AS flat FROM ev""",
    "checked": r"""SELECT *, CASE WHEN regexp_matches(flat, '(?i)(\b(sk|pk)-[A-Za-z0-9_-]+\b|\bbearer[\s:=_-]+[^\s,;]+|\b(api[_ -]?key|access[_ -]?token)\s*[:=]\s*[^\s,;]+)') THEN 'UNLOCATABLE_SOURCE' END AS fault FROM shown""",
}


@query(
    "prj3_citations",
    sql(
        r"""
  SELECT case_id AS query_id, reference_id, p AS problem, CASE WHEN p IS NULL THEN file_name END AS file_name, CASE WHEN p IS NULL THEN source || '|' || lang END AS heading_path,
         paragraph AS paragraph_start, paragraph AS paragraph_end, CASE WHEN p IS NULL THEN substr(flat, 1, 300) END AS excerpt
  FROM (SELECT *, min(fault) OVER (PARTITION BY case_id) AS p FROM checked)""",
        "arm_evidence",
        extra=_LOCATED,
    ),
)
def _(spark, folder):
    _c, _r, shown = selected(spark, folder)
    rows = evidence.citations(located(spark, folder, shown))
    return tidy(
        rows,
        "query_id",
        "reference_id",
        "problem",
        "file_name",
        "heading_path",
        "paragraph_start",
        "paragraph_end",
        "excerpt",
    )


@query(
    "prj9_candidate_sources",
    sql(
        f"SELECT case_id AS query_id, '{fixed.CANDIDATE_LABEL}' AS label, reference_id, file_name, source || '|' || lang AS heading_path, NULL::VARCHAR AS problem FROM ev",
        "arm_evidence",
        extra=_LOCATED,
    ),
)
def _(spark, folder):
    _c, _r, shown = selected(spark, folder)
    return tidy(evidence.candidate_sources(shown))


@query(
    "flt7_metadata_gate",
    sql(
        "SELECT case_id AS query_id, count(*) AS evidence_count, true AS usable, NULL::VARCHAR AS problem FROM ev GROUP BY 1",
        "arm_evidence",
        extra=_LOCATED,
    ),
)
def _(spark, folder):
    _c, _r, shown = selected(spark, folder)
    return tidy(evidence.metadata_gate(shown))


@query(
    "set1_still_eligible",
    sql(
        """
  SELECT case_id AS query_id, count(*) AS versions_used, count(*) FILTER (document_id % 4 = 0) AS versions_lost, count(*) FILTER (document_id % 4 = 0) = 0 AS still_eligible
  FROM (SELECT DISTINCT case_id, version_id, document_id FROM ev) GROUP BY 1""",
        "arm_evidence",
        extra=_LOCATED,
    ),
)
def _(spark, folder):
    _c, _r, shown = selected(spark, folder)
    eligible = t.versions(spark, folder).where("status = 'active' and document_id % 4 <> 0").select("version_id")
    return tidy(evidence.still_eligible(shown, eligible))


@query(
    "jn15_claim_verification",
    sql(
        r"""
  WITH a AS (SELECT case_id, string_agg(flat, chr(10) ORDER BY rerank_rank) AS answer FROM shown GROUP BY 1),
       c AS (SELECT case_id, rerank_rank AS claim_no, CASE WHEN paragraph % 9 = 2 THEN 'not said' ELSE flat END AS claim, CASE WHEN paragraph % 7 = 3 THEN 'unsupported' ELSE 'supported' END AS verdict,
                    CASE WHEN paragraph % 11 = 5 THEN 'S9' ELSE reference_id END AS cited, reference_id FROM shown),
       f AS (SELECT c.*, CASE WHEN NOT contains(trim(regexp_replace(answer, '\s+', ' ', 'g')), trim(regexp_replace(claim, '\s+', ' ', 'g'))) THEN 'CLAIM_NOT_IN_ANSWER'
                              WHEN verdict <> 'supported' THEN 'CLAIM_UNSUPPORTED' WHEN cited = 'S9' THEN 'SOURCE_UNKNOWN' END AS fault FROM c JOIN a USING (case_id)),
       g AS (SELECT case_id, arg_min(fault, claim_no) FILTER (fault IS NOT NULL) AS fault, string_agg(DISTINCT cited, '|' ORDER BY cited) AS ids FROM f GROUP BY 1)
  SELECT case_id AS query_id, fault IS NULL AS verified, fault, CASE WHEN fault IS NULL THEN ids END AS supported_source_ids FROM g""",
        "arm_evidence",
        extra=_LOCATED,
    ),
)
def _(spark, folder):
    """Answers quoting their evidence; some claims are wrong, unsupported or miscited."""
    _c, _r, shown = selected(spark, folder)
    rows = located(spark, folder, shown)
    place = F.col("paragraph_start")
    flat = tx.strip(F.regexp_replace("text", r"[\r\n\t]+", " "))
    answers = rows.groupBy("query_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rerank_rank", flat.alias("flat")))), lambda r: r["flat"]), "\n").alias("answer")
    )
    claims = rows.select(
        "query_id",
        F.col("rerank_rank").alias("claim_no"),
        F.when(place % 9 == 2, "not said").otherwise(flat).alias("claim"),
        F.when(place % 7 == 3, "unsupported").otherwise("supported").alias("verdict"),
        F.array(F.when(place % 11 == 5, F.lit("S9")).otherwise(F.col("reference_id"))).alias("source_ids"),
    )
    return tidy(evidence.verify_claims(claims, answers, shown))


# --- text safety ------------------------------------------------------------------------

_PATH = r"([A-Za-z]:[\\/])([^\\/\s]+[\\/])*[^\\/\s]+|(\\\\|//)[^\\/\s]+[\\/][^\\/\s]+([\\/][^\\/\s]+)*|(^|[^A-Za-z0-9_:/])/([^/\s]+/)+[^/\s]+"
_SECRET = r"(?i)(\b(sk|pk)-[A-Za-z0-9_-]+\b|\bbearer[\s:=_-]+[^\s,;]+|\b(api[_ -]?key|access[_ -]?token)\s*[:=]\s*[^\s,;]+)"
_LEAK = ("Released under the MIT License.",)


@query(
    "flt4_safe_texts",
    rf"""
  SELECT 'p' || page_id AS id, NOT (regexp_matches(html, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]') OR regexp_matches(html, '{_PATH}') OR regexp_matches(html, '{_SECRET}')
         OR regexp_matches(html, '(?i)\b(traceback|stack\s+trace|providererror)\b')) AS safe FROM pages
  UNION ALL
  SELECT 'd' || doc_id, NOT (regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]') OR regexp_matches(text, '{_PATH}') OR regexp_matches(text, '{_SECRET}')
         OR regexp_matches(text, '(?i)\b(traceback|stack\s+trace|providererror)\b')) FROM documents""",
)
def _(spark, folder):
    pages = t.load(spark, folder, "pages").select(F.concat(F.lit("p"), "page_id").alias("id"), F.col("html").alias("text"))
    docs = t.load(spark, folder, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text")
    return pages.union(docs).select("id", sf.is_safe_text(F.col("text")).alias("safe"))


@query(
    "fn14_masked_texts",
    r"""
  SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)\b(sk|pk)-[A-Za-z0-9_-]+\b', '[redacted]', 'g'),
         '(?i)\bbearer[\s:=_-]+[^\s,;]+', 'bearer [redacted]', 'g'), '(?i)\b(api[_ -]?key|access[_ -]?token)\s*[:=]\s*[^\s,;]+', '[redacted]', 'g'),
         '[A-Za-z]:[\\/](?:[^\\/\s]+[\\/])*[^\\/\s]+|(?:\\\\|//)[^\\/\s]+[\\/][^\\/\s]+(?:[\\/][^\\/\s]+)*', '[path redacted]', 'g'),
         '(^|[^A-Za-z0-9_:/])/(?:[^/\s]+/)+[^/\s]+', '\1[path redacted]', 'g') AS masked FROM documents""",
)
def _(spark, folder):
    return t.load(spark, folder, "documents").select("doc_id", sf.mask_secrets(F.col("text")).alias("masked"))


@query(
    "flt6_answer_gate",
    rf"""
  SELECT doc_id, CASE WHEN trim(text) = '' THEN 'UNKNOWN' WHEN contains(text, '{_LEAK[0]}') THEN 'SYSTEM_PROMPT' WHEN regexp_matches(text, '{_SECRET}') OR regexp_matches(text, '{_PATH}') THEN 'SECRET_OR_PATH'
         WHEN regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])s[0-9]+($|[^A-Za-z0-9_])') THEN 'SOURCE_MARKER' END AS failure FROM documents""",
)
def _(spark, folder):
    """Documents as answers; a licence line stands for the prompt that must not leak."""
    docs = t.load(spark, folder, "documents")
    return docs.select("doc_id", sf.answer_text_failure(F.col("text"), _LEAK).alias("failure"))


def _citation_rows(spark, folder):
    """Chunks as citation rows with faults of every kind, by document."""
    n = F.col("document_id") % 16
    rows = t.active_chunks(spark, folder)
    number = F.col("paragraph_start")
    none = F.lit(None).cast("int")
    pdf = n.isin(8, 9, 10)
    return rows.select(
        "chunk_id",
        F.when(n == 1, "S7").otherwise("S1").alias("reference_id"),
        F.when(n == 2, F.concat(F.lit("dir/"), "file_name"))
        .when(n == 3, "notes.txt")
        .when(pdf, F.replace("file_name", F.lit(".docx"), F.lit(".pdf")))
        .otherwise(F.col("file_name"))
        .alias("file_name"),
        F.when(n == 4, F.expr("cast(array() as array<string>)"))
        .when(n == 5, F.array(F.lit("a/b")))
        .otherwise(F.col("heading_path"))
        .alias("heading_path"),
        F.when(n == 6, 0).when(n.isin(9, 10, 11), number).otherwise(none).alias("page"),
        F.when(n.isin(9, 10, 11), number).otherwise(none).alias("page_end"),
        F.when(n.isin(8, 9, 12), none).otherwise(number).alias("paragraph_start"),
        F.when(n.isin(8, 9, 12), none).when(n == 13, number - 1).otherwise(number).alias("paragraph_end"),
        F.when(n == 7, "table-0").when(n == 14, "table-3").alias("table_id"),
        F.col("text").alias("excerpt"),
    )


@query(
    "flt5_citation_rules",
    sql(
        rf"""
  SELECT chunk_id, CASE document_id % 16 WHEN 1 THEN 'REFERENCE_ID' WHEN 2 THEN 'FILE_NAME' WHEN 3 THEN 'FILE_NAME' WHEN 4 THEN 'HEADING_PATH' WHEN 5 THEN 'HEADING_PATH' WHEN 6 THEN 'PAGE'
           WHEN 7 THEN 'TABLE_ID' WHEN 8 THEN 'PDF_NEEDS_PAGES' WHEN 10 THEN 'PDF_WITH_PARAGRAPHS' WHEN 11 THEN 'DOCX_WITH_PAGES' WHEN 12 THEN 'DOCX_NEEDS_PARAGRAPHS'
           WHEN 13 THEN CASE WHEN paragraph = 1 THEN 'PARAGRAPH' ELSE 'DOCX_NEEDS_PARAGRAPHS' END
           ELSE CASE WHEN length(text) > 300 OR regexp_matches(text, '{_SECRET}') OR regexp_matches(text, '{_PATH}') THEN 'EXCERPT' END END AS problem
  FROM active_chunks""",
        "active_chunks",
    ),
)
def _(spark, folder):
    return _citation_rows(spark, folder).select("chunk_id", sf.citation_problem().alias("problem"))


@query(
    "jn6_evidence_resolution",
    sql(
        rf"""
  WITH f AS (SELECT * FROM chunks WHERE paragraph <= 2), c AS (SELECT document_id, version_id, list(chunk_id ORDER BY paragraph) AS ids FROM f WHERE status = 'active' GROUP BY ALL),
       o AS (SELECT document_id, list(chunk_id ORDER BY paragraph) AS ids FROM f WHERE status = 'superseded' GROUP BY 1),
       k AS (SELECT c.document_id, CASE WHEN c.document_id % 9 = 1 THEN '' ELSE c.version_id END AS sv,
                    CASE c.document_id % 9 WHEN 2 THEN [] WHEN 3 THEN ['two words'] WHEN 4 THEN coalesce(o.ids, []) WHEN 5 THEN list_append(c.ids, 'nowhere') ELSE c.ids END AS ids FROM c LEFT JOIN o USING (document_id)),
       i AS (SELECT document_id, sv, unnest(ids) AS id FROM k),
       j AS (SELECT document_id, bool_and(EXISTS (SELECT 1 FROM chunks x WHERE x.chunk_id = id AND x.version_id = sv)) AS here,
                    bool_or(EXISTS (SELECT 1 FROM chunks x WHERE x.chunk_id = id AND x.version_id <> sv)) AS elsewhere,
                    bool_or(EXISTS (SELECT 1 FROM chunks x WHERE x.chunk_id = id AND x.version_id = sv AND (regexp_matches(x.text, '{_SECRET}') OR regexp_matches(x.text, '{_PATH}')))) AS unsafe FROM i GROUP BY 1),
       r AS (SELECT k.document_id, CASE WHEN sv = '' THEN 'source_version_missing' WHEN len(ids) = 0 THEN 'citation_ids_missing' WHEN list_contains(ids, 'two words') THEN 'citation_ids_unsafe'
                  WHEN NOT here AND elsewhere THEN 'citation_version_mismatch' WHEN NOT here THEN 'citation_chunk_missing' WHEN unsafe THEN 'citation_metadata_unsafe' END AS reason FROM k LEFT JOIN j USING (document_id))
  SELECT 'case-' || document_id AS case_id, CASE WHEN reason IS NULL THEN 'available' WHEN reason IN ('citation_ids_unsafe', 'citation_metadata_unsafe') THEN 'unsafe'
         WHEN reason = 'citation_version_mismatch' THEN 'version_mismatch' ELSE 'unavailable' END AS status, reason AS reason_code FROM r""",
        "chunks",
    ),
)
def _(spark, folder):
    return evidence.resolve_citations(cited_cases(spark, folder), t.chunks(spark, folder))


def cited_cases(spark, folder):
    """One case per document citing its first blocks; several cite badly."""
    chunks, live = t.chunks(spark, folder), t.versions(spark, folder).select("version_id", "status")
    firsts = (
        chunks.where("paragraph_start <= 2")
        .join(live, "version_id")
        .groupBy("document_id", "version_id", "status")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("paragraph_start", "chunk_id"))), lambda c: c["chunk_id"]).alias("ids"))
    )
    old = firsts.where("status = 'superseded'").select("document_id", F.col("ids").alias("old_ids"))
    n = F.col("document_id") % 9
    empty = F.expr("cast(array() as array<string>)")
    ids = (
        F.when(n == 2, empty)
        .when(n == 3, F.array(F.lit("two words")))
        .when(n == 4, F.coalesce("old_ids", empty))
        .when(n == 5, F.array_append("ids", "nowhere"))
        .otherwise(F.col("ids"))
    )
    return (
        firsts.where("status = 'active'")
        .join(old, "document_id", "left")
        .select(
            F.concat(F.lit("case-"), "document_id").alias("case_id"),
            F.when(n == 1, "").otherwise(F.col("version_id")).alias("source_version"),
            ids.alias("citation_chunk_ids"),
        )
    )


@query(
    "jn6_evidence_references",
    sql(
        rf"""
  WITH f AS (SELECT * FROM chunks WHERE paragraph <= 2 AND status = 'active' AND document_id % 9 IN (0, 6, 7, 8)),
       b AS (SELECT document_id, bool_or(regexp_matches(text, '{_SECRET}') OR regexp_matches(text, '{_PATH}')) AS bad FROM f GROUP BY 1)
  SELECT 'case-' || document_id AS case_id, row_number() OVER (PARTITION BY document_id ORDER BY paragraph) AS position, chunk_id, file_name, substr(text, 1, 300) AS excerpt
  FROM f JOIN b USING (document_id) WHERE NOT bad""",
        "chunks",
    ),
)
def _(spark, folder):
    cited, chunks = cited_cases(spark, folder), t.chunks(spark, folder)
    rows = evidence.evidence_references(cited, evidence.resolve_citations(cited, chunks), chunks)
    return tidy(rows, "case_id", "position", "chunk_id", "file_name", "excerpt")
