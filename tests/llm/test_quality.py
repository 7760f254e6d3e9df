import random

import numpy as np
from brute import documents
from citeloom.llm import quality


def test_gradient_separates_ordered_grades():
    rng = np.random.default_rng(1)
    n, width = 600, 30
    hidden = rng.normal(size=width)
    x = rng.normal(size=(n, width))
    score = x @ hidden
    grade = np.digitize(score, np.quantile(score, [0.3, 0.6]))
    text, feature = np.nonzero(x)
    model = quality.fit(text, feature, x[text, feature], grade)
    tails = 1 / (1 + np.exp(model.thresholds - np.bincount(text, model.weights[feature] * x[text, feature], n)[:, None]))
    assert model.thresholds[0] < model.thresholds[1]
    assert np.mean((tails > 0.5).sum(axis=1) == grade) > 0.95


def tables(spark, n=400):
    rng = random.Random(5)
    good = "calm river stone garden letter winter music paper window bridge".split()
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(good, k=rng.randrange(20, 80))
        kind = i % 4
        if kind == 0:
            words = [w.upper() + "!!" for w in words]
        if kind == 1:
            words[::6] = ["idiot"] * len(words[::6])
        rows.append((i, " ".join(words)))
        labels.append((i, int(kind != 0), int(kind == 1)))
    return rows, labels


def test_held_out(spark):
    rows, labels = tables(spark)
    marks = spark.createDataFrame(labels[:200] + [(None, 1, 1), (3, None, 0), (9999, 1, 0)], "doc_id long, quality int, toxic int")
    docs = documents(spark, rows, Tail_1="1", feature="2")
    left = quality.selected(docs, marks)
    assert left.columns == docs.columns
    kept = {r.doc_id for r in left.collect()}
    new = [i for i, _ in rows[200:]]
    right = [(i in kept) == (i % 4 > 1) for i in new]
    assert sum(right) >= 0.97 * len(right)


def test_odd_tables(spark):
    rows, labels = tables(spark, 40)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = documents(spark, [*rows, (None, None), (7, ""), (7, ""), (8, "x" * 100_000), (9, " \n\t ")])
    model = quality.trained(docs, none)
    found = quality.graded(docs, model, ["a", "b"]).collect()
    assert len(found) == 45 and len({(r.a, r.b) for r in found}) == 1
    one = spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    assert quality.selected(docs, one).count() == 45
    assert quality.selected(documents(spark, []), one).collect() == []


def test_sample_is_bounded(spark):
    rows, labels = tables(spark, 60)
    marks = spark.createDataFrame(labels * 3, "doc_id long, quality int, toxic int")
    docs = documents(spark, rows * 3)
    a, b = (quality.trained(docs.repartition(n), marks, sample=20) for n in (2, 3))
    assert np.allclose(a.thresholds, b.thresholds) and np.allclose(a.weights, b.weights, atol=1e-5)


def test_rare_grades_are_drawn_whole():
    assert quality.SAMPLE >= 12_000
    assert quality.quotas(np.array([14_094, 10_423, 77_722]), 12_000).tolist() == [4000, 4000, 4000]
    assert quality.quotas(np.array([2766, 900, 15_670]), 12_000).tolist() == [2766, 900, 8334]
    assert quality.quotas(np.array([3, 0, 2]), 12_000).tolist() == [3, 0, 2]


def test_rare_grade_in_the_sample(spark, monkeypatch):
    rows, labels = tables(spark, 400)
    # One toxic text in 40: a uniform draw of 40 labels holds about one of them.
    rare = [x for x in labels if not x[2] or x[0] % 40 == 1]
    seen = []
    monkeypatch.setattr(quality, "fit", lambda *a, stands_for=None, **b: seen.append((a[3], stands_for)))
    marks = spark.createDataFrame(rare, "doc_id long, quality int, toxic int")
    quality.trained(documents(spark, rows), marks, sample=40)
    [(grade, stands_for)] = seen
    assert np.bincount(grade).tolist() == [15, 10, 15]
    assert np.allclose(np.bincount(grade) * stands_for, [100, 10, 200])


def test_weights_of_a_draw_are_those_of_copies():
    rng = np.random.default_rng(2)
    x, grade = rng.normal(size=(90, 5)), np.repeat([0, 1, 2], 30)
    text, feature = np.nonzero(x)
    drawn = quality.fit(text, feature, x[text, feature], grade, stands_for=np.array([1, 1, 4]))
    copies = np.concatenate([np.arange(90), *[np.arange(60, 90)] * 3])
    text, feature = np.nonzero(x[copies])
    whole = quality.fit(text, feature, x[copies][text, feature], grade[copies])
    assert np.allclose(drawn.weights, whole.weights, atol=1e-3) and np.allclose(drawn.thresholds, whole.thresholds, atol=1e-3)


def test_packed_numbers_are_read_in_place():
    import pyarrow as pa

    rows = [np.array([1, 2, 3], "<i4").tobytes(), b"", np.array([4], "<i4").tobytes()]
    column = pa.chunked_array([pa.array(rows[:1], pa.binary()), pa.array([b"zzzz", *rows[1:]], pa.binary()).slice(1)])
    assert quality.values_of(column, "<i4").tolist() == [1, 2, 3, 4]
    assert quality.values_of(pa.chunked_array([], pa.binary()), "<f4").tolist() == []


def test_fit_holds_no_memory_of_arrow(spark, monkeypatch):
    import pyarrow as pa
    from conftest import FOLDER

    docs, labels = (spark.read.parquet(f"{FOLDER}/{n}.parquet") for n in ("documents", "labels"))
    held, whole = [], quality.fit

    def fit(text, feature, value, *rest, **more):
        held.append((feature.flags.owndata, value.flags.owndata, pa.total_allocated_bytes()))
        return whole(text, feature, value, *rest, rounds=1, **more)

    monkeypatch.setattr(quality, "fit", fit)
    before = pa.total_allocated_bytes()
    quality.trained(docs, labels)
    assert held == [(True, True, before)]
