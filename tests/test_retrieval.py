import difflib
import math
from urllib.parse import unquote, urlparse

import embedders
import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import FOLDER
from pyspark.sql import functions as F

from citeloom.catalogue import QUERIES, load_all
from citeloom.functions import text as tx
from citeloom.operators import dedup, evidence, fusion, lexical, segments, vectors
from citeloom.plans import ask as plan

load_all()

CHUNK = "version_id string, chunk_id string, text string, heading_path array<string>, profiles array<int>"


def chunk_table(spark, rows):
    return spark.createDataFrame([(v, c, t, h, [0]) for v, c, t, h in rows], CHUNK)


def ask(spark, *texts):
    rows = [(f"q{i}", 0, t, [t]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "query_id string, profile int, question string, queries array<string>")


def test_heading_beats_text_and_ties_by_id(spark):
    table = chunk_table(
        spark,
        [("v1", "heading", "流程说明", ["透析"]), ("v1", "text", "透析流程说明", ["流程"])],
    )
    hits = lexical.lexical_hits(ask(spark, "透析"), lexical.lexical_index(table), n_queries=1).orderBy("rank").collect()
    assert [h["chunk_id"] for h in hits] == ["heading", "text"]
    same = chunk_table(spark, [("v1", "c2", "透析", []), ("v2", "c1", "透析", []), ("v1", "c1", "透析", [])])
    hits = lexical.lexical_hits(ask(spark, "透析"), lexical.lexical_index(same), n_queries=1).orderBy("rank").collect()
    assert [(h["version_id"], h["chunk_id"]) for h in hits] == [("v1", "c1"), ("v1", "c2"), ("v2", "c1")]


@pytest.mark.parametrize("rounds", [False, True])
def test_top_k_equals_brute_force(spark, monkeypatch, rounds):
    if rounds:
        monkeypatch.setattr(segments, "BLOCK_QUERIES", 3)
        monkeypatch.setattr(segments, "ROUND_BLOCKS", 2)
    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(rng.choice(words, rng.integers(1, 12))) for _ in range(300)]
    table = chunk_table(spark, [(f"v{i % 5}", f"c{i:03d}", t, ["w1"] if i % 9 == 0 else []) for i, t in enumerate(texts)])
    queries = [" ".join(rng.choice(words, 4)) for _ in range(17)]
    packed = segments.build_segments(
        lexical.tokenised(table), {"text_tokens": 1.0, "heading_tokens": 2.0}, "log_tf", rows_per_segment=200
    )
    found = lexical.lexical_hits(ask(spark, *queries), packed, n_queries=len(queries), k=5).collect()
    n, held = len(texts), [set(t.split()) | ({"w1"} if i % 9 == 0 else set()) for i, t in enumerate(texts)]
    for q, query in enumerate(queries):
        scores = []
        for i, t in enumerate(texts):
            score = 0.0
            for token in set(query.split()):
                df = sum(token in h for h in held)
                idf = math.log((n + 1) / (df + 1)) + 1
                tf = t.split().count(token)
                score += idf * (1 + math.log(tf)) if tf else 0
                score += 2 * idf if token == "w1" and i % 9 == 0 else 0
            if score > 0:
                scores.append((-round(score, 9), f"v{i % 5}", f"c{i:03d}"))
        want = [(v, c) for _, v, c in sorted(scores)[:5]]
        got = sorted((r for r in found if r["query_id"] == f"q{q}"), key=lambda r: r["rank"])
        assert [(r["version_id"], r["chunk_id"]) for r in got] == want


def test_indexes_are_read_a_few_segments_at_a_time(spark):
    """A reader takes a row group at once, and a segment is a row of megabytes."""
    table = chunk_table(spark, [("v1", f"c{i:03d}", f"w{i} x", []) for i in range(400)]).coalesce(1)
    rows_a_batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows_a_batch)
    spark.conf.set(rows_a_batch, "10")
    try:
        indexes = plan.written_indexes(table)
    finally:
        spark.conf.set(rows_a_batch, before)
    for index in indexes:
        held = [pq.ParquetFile(unquote(urlparse(f).path)).metadata for f in index.inputFiles()]
        groups = [m.row_group(i).num_rows for m in held for i in range(m.num_row_groups)]
        assert sum(groups) == 40
        assert max(groups) <= 8


def test_profiles_hide_chunks(spark):
    rows = [("v1", "a", "x y", [], [1]), ("v2", "b", "x", [], [0, 1]), ("v3", "c", "x", [], [0])]
    table = spark.createDataFrame(rows, CHUNK)
    asked = spark.createDataFrame([("q0", 0, ["x"]), ("q1", 1, ["x"])], "query_id string, profile int, queries array<string>")
    got = {(r["query_id"], r["chunk_id"]) for r in lexical.lexical_hits(asked, lexical.lexical_index(table), n_queries=2).collect()}
    assert got == {("q0", "b"), ("q0", "c"), ("q1", "a"), ("q1", "b")}


HIT = "query_id string, version_id string, chunk_id string, content_hash string, file_name string, heading_path array<string>, text string, score double, rank int"


def hits(spark, rows):
    return spark.createDataFrame(
        [("q", v, c, h, f"{v}.docx", [head], text, float(score), n) for n, (v, c, h, head, text, score) in enumerate(rows, 1)],
        HIT,
    )


def test_fusion(spark):
    vector = hits(spark, [("v1", "a", "h1", "x", "t1", 0.9), ("v1", "b", "h1", "x", "t1", 0.8), ("v1", "c", "h2", "x", "t2", 0.7)])
    words = hits(spark, [("v2", "d", "h2", "x", "t2", 5), ("v2", "e", "h1", "x", "t1", 4)])
    rows = fusion.fuse(vector, words).orderBy("fused_rank").collect()
    # h1 takes one rank in the vector branch, so h2 is second there.
    assert [(r["content_hash"], r["vector_rank"], r["lexical_rank"]) for r in rows] == [("h1", 1, 2), ("h2", 2, 1)]
    assert all(abs(r["rrf_score"] - (1 / 61 + 1 / 62)) < 1e-15 for r in rows)
    assert [r["chunk_id"] for r in rows] == ["a", "c"]
    drops = fusion.fusion_drops(vector, words, fusion.fuse(vector, words)).collect()
    assert [(d["source_id"], d["reason"]) for d in drops] == [("b", "rrf_content_hash_merge")]


def test_empty_lexical_branch_keeps_vector_scores(spark):
    vector = hits(spark, [("v1", "a", "h1", "x", "t1", 0.9)])
    rows = fusion.choose_strategy("hybrid", vector, vector.limit(0)).collect()
    assert [(r["chunk_id"], r["score"]) for r in rows] == [("a", 0.9)]
    rows = fusion.choose_strategy("hybrid", vector.limit(0), vector).collect()
    assert abs(rows[0]["score"] - 1 / 61) < 1e-15


def test_dedup_reasons(spark):
    near = "the quick brown fox jumps over the lazy dog"
    rows = [
        ("v1", "a", "h1", "x", near, 9),
        ("v1", "b", "h1", "y", "other", 8),
        ("v1", "c", "h2", "y", near + "s", 7),
        ("v1", "d", "h3", "x", "12345", 6),
        ("v1", "e", "h4", "x", "abcde", 5),
        ("v1", "f", "h5", "z", "zzzz", 4),
    ]
    got = {r["chunk_id"]: (r["kept"], r["reason"], r["kept_candidate_id"]) for r in dedup.deduplicate(hits(spark, rows), limit=2).collect()}
    assert got == {
        "a": (True, None, None),
        "b": (False, "exact_duplicate", "h1"),
        "c": (False, "near_duplicate", "h1"),
        "d": (True, None, None),
        "e": (False, "heading_cap", "h1"),
        "f": (False, "top20_truncation", None),
    }


def test_decisions_in_rank_order(spark):
    """Random lists against the rules applied hit by hit."""
    rng = np.random.default_rng(11)
    texts = ["the quick brown fox jumps", "the quick brown fox jumped", "some other words here", "some other words there", "12345", "zz"]
    rows = []
    for n in range(30):
        text = texts[rng.integers(len(texts))] if rng.random() < 0.7 else f"text number {n} of its own {rng.integers(10**6)}"
        rows.append((f"v{rng.integers(4)}", f"c{n}", f"h-{text}" if rng.random() < 0.8 else f"h{n}", "xyz"[rng.integers(3)], text, 30 - n))
    table = hits(spark, rows)
    keys = {r["chunk_id"]: r["k"] for r in table.select("chunk_id", tx.near_text_key(F.col("text")).alias("k")).collect()}
    kept, want = [], {}
    for version, chunk, content, heading, _, _ in rows:
        copy = [k for k in kept if k[0] == content]
        near = [k for k in kept if dedup.similar(keys[chunk], k[2])]
        under = [k for k in kept if k[1] == (version, heading)]
        reason = "exact_duplicate" if copy else "near_duplicate" if near else "heading_cap" if len(under) > 1 else "top20_truncation" if len(kept) >= 8 else None
        winner = (copy or near or (under if len(under) > 1 else []) or [(None,)])[0][0]
        want[chunk] = (reason, winner)
        if reason is None:
            kept.append((content, (version, heading), keys[chunk]))
    got = {r["chunk_id"]: (r["reason"], r["kept_candidate_id"]) for r in dedup.deduplicate(table, limit=8).collect()}
    assert got == want
    with pytest.raises(ValueError):
        dedup.deduplicate(table, limit=21)


def test_similar_is_the_ratio():
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefgh "))
    for _ in range(400):
        a = "".join(rng.choice(letters, rng.integers(1, 260)))
        b = list(a)
        for _ in range(rng.integers(0, max(2, len(a) // 5))):
            b[rng.integers(0, len(b))] = str(rng.choice(letters))
        b = "".join(b)
        assert dedup.similar(a, b) == (a == b or difflib.SequenceMatcher(None, a, b).ratio() >= 0.85)


def test_gate_and_labels(spark):
    rows = [("q1", "c1", 0.349, 1), ("q1", "c2", 0.1, 2), ("q2", "c3", 0.35, 1), ("q2", "c4", 0.01, 2)]
    table = spark.createDataFrame(rows, "query_id string, chunk_id string, rerank_score double, rerank_rank int")
    shown = evidence.relevance_gate(evidence.select_evidence(table)).collect()
    assert sorted((r["chunk_id"], r["reference_id"]) for r in shown) == [("c3", "S1"), ("c4", "S2")]


def test_hash_embedding_and_batches(spark):
    texts = spark.createDataFrame([(i, f"token{i} token{i} other") for i in range(70)], "id int, text string")
    rows = vectors.embed(texts, "id", embedders.strict).collect()
    assert len(rows) == 70 and all(abs(sum(x * x for x in r["embedding"]) - 1) < 1e-9 for r in rows)
    score = texts.select(vectors.hash_score(F.col("text"), F.col("text")).alias("s")).first()["s"]
    assert score == 1.0


def test_wrong_embedding_count_fails(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string").coalesce(1)
    with pytest.raises(Exception, match="embedding count"):
        vectors.embed(texts, "id", embedders.short).collect()


def test_longest_common_subsequence_rules_out_only_what_the_ratio_does():
    draw = np.random.default_rng(11)

    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            now = [0]
            for j, y in enumerate(b):
                now.append(row[j] + 1 if x == y else max(row[j + 1], now[j]))
            row = now
        return row[-1]

    for _ in range(200):
        a, b = ("".join(draw.choice(list("abcé😀"), draw.integers(0, 40))) for _ in range(2))
        assert dedup.longest_common(a, b) == plain(a, b)
    for _ in range(400):
        a = "".join(draw.choice(list("abcd"), draw.integers(80, 260)))
        b = list(a)
        for at in draw.integers(0, len(b), draw.integers(0, len(b) // 3)):
            b[at] = str(draw.choice(list("abcd")))
        b = "".join(b)[draw.integers(0, 20) :]
        assert dedup.similar(a, b) == (difflib.SequenceMatcher(None, a, b).ratio() >= 0.85)


def test_bounds_leave_runs_unread():
    """A question whose best chunks lie in one run reads that run and few others."""
    import pyarrow as pa

    texts = [["rare"] * 3 + ["common"] if 128 <= i < 192 else ["common"] for i in range(640)]
    lists = pa.array(texts, pa.list_(pa.string()))
    columns = segments._inverted([lists], [1.0], "log_tf")
    columns |= {"v": pa.array(["v"] * 640), "c": pa.array([f"c{i:03d}" for i in range(640)]), "p": pa.array([[0]] * 640)}
    batch = pa.RecordBatch.from_arrays(
        [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in columns.values()], list(columns)
    )
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    segment = segments._Segment(sink.getvalue().to_pybytes())
    read = []
    postings = segment.postings
    segment.postings = lambda runs: read.append(len(runs)) or postings(runs)
    entries = pa.array([{"query_id": "q", "profile": 0, "f": f, "w": w} for f, w in (("rare", 5.0), ("common", 1.0))])
    block = segments._SparseBlock(entries, 20)
    found = block.found(segment)
    assert {int(i) for _, at, _ in found for i in at if i in range(128, 148)} == set(range(128, 148))
    # Eleven runs of postings in all; those without the rare word can't reach the twentieth score.
    assert sum(read) <= 4


def test_identity_names_every_value_that_differs(spark):
    from citeloom.operators import arms

    kind = "set_id string, case_count long, set_checksum string, snapshot_hash string"
    actual = spark.createDataFrame([("a", 3, "x", "y")], kind)
    frozen = spark.createDataFrame(
        [("same", "a", 3, "x", "y"), ("set", "b", 3, "x", "y"), ("all", "b", 4, "z", "w"), ("unset", "a", 3, "x", None)], f"run string, {kind}"
    )
    rows = {r.run: (r.mismatches, r.matches) for r in arms.identity_matches(actual, frozen).collect()}
    assert rows == {
        "same": ("", True), "set": ("set_id", False), "all": ("set_id,case_count,set_checksum,snapshot_hash", False), "unset": ("snapshot_hash", False),
    }


def test_texts_of_unlike_length_are_apart():
    for a, b in [("a" * 4, "a" * 400), ("a" * 400, "a" * 4), ("", "a" * 90), ("ab" * 40, "ba" * 100)]:
        assert not dedup.similar(a, b)
        assert dedup.longest_common(a, b, 101) == -1


def test_neighbours_of_any_length_compare_as_the_plain_ratio_does(spark):
    from pyspark.sql import Window

    from citeloom.functions import text as tx
    from citeloom.sources import tables as t

    after = F.lead("text").over(Window.partitionBy("version_id").orderBy("paragraph_start"))
    blocks = t.chunks(spark, FOLDER).withColumn("after", after).where("after is not null").limit(300)
    blocks = blocks.select("version_id", "paragraph_start", tx.near_text_key(F.col("text")), tx.near_text_key(F.col("after")))
    found = {(r.version_id, r.paragraph_start): r.similar for r in QUERIES["fn6_similar_neighbours"](spark, FOLDER).collect()}
    for version, start, a, b in blocks.collect():
        assert found[version, start] == (difflib.SequenceMatcher(None, a, b).ratio() >= 0.85)


@pytest.mark.parametrize("rounds", [False, True])
def test_dense_search_in_single_precision_loses_nothing(spark, monkeypatch, rounds):
    if rounds:
        for name, value in {"BLOCK_QUERIES": 3, "ROUND_BLOCKS": 2, "DENSE_BLOCKS": 2, "DENSE_QUERIES": 4, "SEGMENT_ROWS": 16}.items():
            monkeypatch.setattr(segments, name, value)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(12, 24))
    # Copies, copies that differ beyond single precision, and a vector that is not a number.
    points = np.vstack([base, base, base + 1e-8 * rng.normal(size=base.shape), rng.normal(size=(30, 24)), np.full((1, 24), np.nan)])
    rows = [("v1", f"c{i:03d}", [0] if i % 5 else [1], p.tolist()) for i, p in enumerate(points)]
    table = spark.createDataFrame(rows, "version_id string, chunk_id string, profiles array<int>, embedding array<double>")
    asked = [(f"q{i:02d}", i % 2, p.tolist()) for i, p in enumerate(base)]
    queries = spark.createDataFrame(asked, "query_id string, profile int, embedding array<double>")
    hits = vectors.vector_hits(queries, table, n_queries=len(asked), k=4)
    found = sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 9)) for r in hits.collect())
    unit = points / np.linalg.norm(points, axis=1, keepdims=True)
    expected = []
    for name, profile, p in asked:
        scores = np.round(unit[:-1] @ (np.array(p) / np.linalg.norm(p)), 9)
        ranked = sorted((-s, c) for s, (_, c, held, _) in zip(scores, rows) if profile in held)[:4]
        expected += [(name, n, c, round(-s, 9)) for n, (s, c) in enumerate(ranked, 1)]
    assert found == sorted(expected)


def test_grades_by_topic_are_those_of_pairs(spark):
    from citeloom.operators import evaluation

    asked = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 3), ("d", None)], "case_id string, topic int")
    graded = [(1, "x", 3), (1, "y", 1), (1, "x", 2), (2, "y", 2), (2, "z", -1), (1, " ", 9), (3, "w", 0), (None, "x", 5)]
    grades = spark.createDataFrame(graded, "topic int, source_id string, relevance int")
    ranked = spark.createDataFrame([("a", 1, "z"), ("a", 2, "y"), ("a", 3, "x"), ("b", 1, "x"), ("c", 1, "w")], "case_id string, rank int, source_id string")
    rows = evaluation.graded_ndcg(asked, grades, ranked, 2)
    assert "BroadcastNestedLoop" not in rows._jdf.queryExecution().executedPlan().toString()
    gain = lambda *rels: sum((2**r - 1) / math.log2(i + 2) for i, r in enumerate(rels))
    found = {r.case_id: r.ndcg for r in rows.collect()}
    assert found == pytest.approx({"a": gain(0, 2) / gain(3, 2), "b": gain(3) / gain(3, 1), "c": 0.0})


def test_common_words_are_scored_in_bounded_memory():
    import tracemalloc

    import numpy as np
    import pyarrow as pa
    from citeloom.operators import segments

    rng = np.random.default_rng(4)
    rows, words, n = 4096, 40, 120
    tokens = pa.array([[f"t{k}" for k in np.flatnonzero(rng.random(words) < 0.9)] for _ in range(rows)])
    columns = {
        "v": pa.array([f"v{k // 9}" for k in range(rows)]),
        "c": pa.array([f"c{k}" for k in range(rows)]),
        "p": pa.array([[0]] * rows, pa.list_(pa.int32())),
        **segments._inverted([tokens], [1.0], "log_tf"),
    }
    lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in columns.values()]
    batch = pa.RecordBatch.from_arrays(lists, list(columns))
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    segment = segments._Segment(sink.getvalue().to_pybytes())
    asked = [(f"q{q}", 0, f"t{k}", float(1 + rng.random())) for q in range(n) for k in range(words)]
    block = segments._SparseBlock(pa.array([dict(zip(("query_id", "profile", "f", "w"), x)) for x in asked]), 20)
    tracemalloc.start()
    found = block.found(segment)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 160e6
    held = np.zeros((rows, words))
    for k, row in enumerate(tokens.to_pylist()):
        held[k, [int(t[1:]) for t in row]] = 1
    for q in (0, n - 1):
        name = block.queries[q].as_py()
        weight = [w for who, _, _, w in asked if who == name]
        want = sorted(np.round(held @ weight, 9))[::-1][:20]
        got = sorted((s for who, _, part in found if who == q for s in part), reverse=True)[:20]
        np.testing.assert_allclose(got, want, atol=2e-9)
