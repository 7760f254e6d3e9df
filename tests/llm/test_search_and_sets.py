import random
import textwrap

import numpy as np
from brute import documents
from pyspark.sql import functions as F
from citeloom.llm import licences, lines, topk


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_topk_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 5)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 70)
    rng = np.random.default_rng(3)
    points = rng.normal(size=(300, 24)).astype("f4")
    points[100:130] = points[7]
    points[::3, 4:] *= 0.02
    rows = [(i, [float(x) for x in p], 0) for i, p in enumerate(points)]
    rows += [(1000, None, 0), (1001, [1.0, None], 0), (1002, [float("nan")], 0), (1003, [float("inf")], 0)]
    rows += [(None, [1.0] * 24, 0), (150, [2.0] * 3, 0), (151, [], 0), (40, [float(x) for x in points[40]], 0)]
    found = topk.nearest(
        topk.integer_vectors(vectors(spark, rows)), topk.integer_vectors(vectors(spark, rows)).filter("vec_id % 20 = 0"), 5
    ).collect()
    usable = [(i, np.floor(256 * np.pad(np.array(e, float), (0, 24 - len(e)))).astype(int)) for i, e, _ in rows if i is None or i < 1000]
    for q in range(0, 300, 20):
        own = dict(usable)[q]
        scored = sorted((-int(own @ v), i is None, i or 0) for i, v in usable if i != q)[:5]
        got = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q and r.twin == 1)
        assert got == [(k + 1, None if n else i, -s) for k, (s, n, i) in enumerate(scored)]


def test_topk_of_few(spark):
    few = topk.integer_vectors(vectors(spark, [(0, [1.0], 0), (50, [2.0], 0), (51, [3.0], 0)]))
    assert topk.nearest(few, few.filter("vec_id % 50 = 0"), 5).count() == 4
    none = few.filter("vec_id < 0")
    assert topk.nearest(none, none, 5).collect() == []


def test_licences(spark):
    mit = dict((len(t), t) for n, t in licences.TEMPLATES if n == "MIT")
    long = mit[max(mit)]
    rows = [
        (1, "some lines of prose\nReleased under the MIT License.\nand a few more"),
        (2, "Licensed  under -- the APACHE license, version 2.0"),
        (3, "one\n\n" + "\n".join(textwrap.wrap(long, 60)) + "\n\ntwo"),
        (4, "This licence is mine alone."),
        (5, None),
        (6, ""),
        (7, "word " * 5000),
        (8, "released under the mit license released under the mit license"),
        (1, "some lines of prose\nReleased under the MIT License.\nand a few more"),
        (None, "Licensed under CC BY-NC 4.0."),
    ]
    found = licences.licence_passages(documents(spark, rows, words="1", P="2", row="3")).collect()
    got = sorted(((r.doc_id, r.kind, r.place, r.licence) for r in found), key=str)
    assert got == sorted(
        [
            (1, "line", 1, "MIT"),
            (1, "line", 1, "MIT"),
            (2, "line", 0, "Apache-2.0"),
            (3, "paragraph", 1, "MIT"),
            (3, "text", 0, "MIT"),
            (None, "line", 0, "CC-BY-NC-4.0"),
        ],
        key=str,
    )
    assert licences.licence_passages(documents(spark, [])).collect() == []


def test_bounds_never_lose_a_match():
    for size in range(1, 60):
        low, high = licences.bounds(size)
        for n in range(1, 120):
            best = 2 * min(n, size) / (n + size)
            assert (best >= licences.LEAST) <= (low <= n <= high)


def wanted_lines(rows):
    """Lines that go, by comparing each with all earlier ones."""
    seen, gone = [], set()
    for key, i, t in sorted(((i is not None, i or 0), i, t) for i, t in rows if t is not None):
        for n, line in enumerate(t.split("\n")):
            words = set(line.lower().split(" ")) - {""}
            if not words:
                continue
            if any(len(words & s) * 100 >= len(words | s) * 80 and p != (key, n) for p, s in seen):
                gone.add((i, n))
            seen.append(((key, n), words))
    return gone


def test_lines_against_all_pairs(spark):
    rng = random.Random(4)
    pool = [f"w{n}" for n in range(60)]
    bases = [rng.sample(pool, rng.choice((1, 2, 4, 5, 6, 9, 12, 20, 40))) for _ in range(14)]
    rows = []
    for i in range(70):
        body = []
        for _ in range(rng.randrange(1, 6)):
            words = list(rng.choice(bases))
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                words[rng.randrange(len(words))] = rng.choice(pool)
            rng.shuffle(words)
            body.append(" ".join(w.upper() if rng.random() < 0.2 else w for w in words))
        rows.append((i, "\n".join(body)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "x" * 20_000), (104, "ü ö\n  ö ü "), (None, "ü ö")]
    docs = documents(spark, rows, Gone="1", KEPT="2")
    gone = wanted_lines(rows)
    left = lines.without_repeated_lines(docs.repartition(3))
    assert left.columns == docs.columns
    found = {r.doc_id: r.text for r in left.collect()}
    assert len(found) == len(rows)
    for i, t in rows:
        kept = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in gone)
        assert found[i] == kept, i


def test_lines_of_an_empty_table(spark):
    assert lines.without_repeated_lines(documents(spark, [])).collect() == []


def test_lines_of_rows_that_share_an_id(spark):
    same, other = "one two three four five", "six seven eight nine ten"
    # A null id is before 7, and lines of one id are in the order of line numbers: ``same`` stays at line 0.
    rows = [
        (None, f"alpha beta\n{same}\ngamma delta"),
        (None, f"epsilon zeta\neta theta\n{same} "),
        (None, f"{same}\n{other}\niota kappa"),
        (7, f"lambda mu\n{other} \nnu xi"),
        (7, "omicron pi\nrho sigma\nnu xi"),
        (7, "tau upsilon\nphi chi\nnu xi"),
    ]
    left = lines.without_repeated_lines(documents(spark, rows).coalesce(1), ("had", "lost")).collect()
    assert sorted((r.text for r in left)) == sorted(
        [
            "alpha beta\ngamma delta",
            "epsilon zeta\neta theta",
            f"{same}\n{other}\niota kappa",
            "lambda mu\nnu xi",
            "omicron pi\nrho sigma",
            "tau upsilon\nphi chi",
        ]
    )
    assert sorted((r.had, r.lost) for r in left) == [(3, 0)] + [(3, 1)] * 5


def test_words_of_the_own_row_confirm_a_pair(spark):
    # Nine of ten words in common, under one id, at one line number.
    words = [f"w{k}" for k in range(10)]
    rows = [(None, " ".join(words)), (None, " ".join([*words[:9], "other"])), (None, "quite another line")]
    left = lines.without_repeated_lines(documents(spark, rows).coalesce(1)).collect()
    assert sorted(r.text for r in left) == sorted(["", "quite another line", rows[0][1]])


def test_words_are_put_in_order_once_and_postings_shuffled_once(spark):
    docs = documents(spark, [(1, "a b c\nd  e"), (2, " a b c d")]).withColumn("row", F.monotonically_increasing_id())
    found = lines.sets_of_lines(docs, lines.rarity(docs))
    assert found._jdf.queryExecution().optimizedPlan().toString().count("array_distinct") == 1
    sets = lines.distinct_sets(found).withColumn("asks", F.lit(True) & (F.col("n") > 0))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("false", "-1")):
            spark.conf.set(k, v)
        plan = lines.meeting(lines.written(sets, "sets"), 0)._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert "ReusedExchange" in plan
