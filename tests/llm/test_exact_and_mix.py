import hashlib
from collections import defaultdict

import pytest
from brute import documents
from citeloom.llm import exact_dedup, mixing


def copies(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    return sorted(
        (
            (i, max((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest())
            for t, ids in groups.items()
            for i in ids
        ),
        key=str,
    )


def test_copies_at_every_depth(spark):
    base = "abcdefgh" * 700
    rows = [(0, None), (1, ""), (2, "x"), (3, "x"), (4, "é" * 40), (5, "é" * 40 + "e")]
    n = 10
    for size in (63, 64, 65, 255, 256, 257, 1023, 1024, 1025, 4096, 4097, 5600):
        rows += [(n, base[:size]), (n + 1, base[:size]), (n + 2, base[: size - 1] + "#"), (n + 3, base[:size] + "#")]
        n += 4
    rows += [(None, "null id"), (None, "null id"), (500, "same row"), (500, "same row")]
    found = exact_dedup.copy_groups(documents(spark, rows, KEEP_ID="7")).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found), key=str) == copies(rows)
    assert all(r.kept == (r.doc_id == r.keep_id) for r in found)


def test_copies_of_an_empty_table(spark):
    assert exact_dedup.copy_groups(documents(spark, [])).collect() == []


def targets(sizes, weights=(1, 2, 3), limit=3):
    """Share out, take off what is above a limit, share that again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    target, left, going = dict.fromkeys(names, 0.0), float(sum(sizes.values())), list(names)
    while left > 1e-9 and going:
        total = sum(weight[s] for s in going)
        for s in going:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(going):
            if target[s] > limit * sizes[s]:
                left += target[s] - limit * sizes[s]
                target[s] = limit * sizes[s]
                going.remove(s)
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1, "c": 5, None: 2}, {"a": 100}, {"x": 1, "y": 1, "z": 998}, {"a": 0, "b": 3}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    assert found == pytest.approx(targets(sizes))


def test_mix(spark):
    rows = [(i, "w " * (i % 7), ("a", "b", None)[i % 3]) for i in range(300)] + [(None, "x y", "b"), (5, None, "a")]
    docs = documents(spark, rows, SIZE="1", copies="2", turn="3")
    taken = mixing.with_copies(docs, ("s1", "s2", "s3", "s4")).collect()
    assert len(taken) == len(rows) and all(0 <= r.s4 <= 3 for r in taken)
    assert all(r.s1 == len((r.text or "").split()) for r in taken)
    for source in ("a", "b", None):
        own = [r for r in taken if r.source == source]
        assert sum(r.s1 * r.s4 for r in own) == pytest.approx(own[0].s3, rel=0.25)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.s4 for r in taken)
    again = {(r.doc_id, r.text): r.s4 for r in mixing.with_copies(docs.repartition(5), ("s1", "s2", "s3", "s4")).collect()}
    assert again == {(r.doc_id, r.text): r.s4 for r in taken}


def test_mix_of_an_empty_table(spark):
    assert mixing.mixed(documents(spark, [])).collect() == []
    assert mixing.mixed(documents(spark, [(1, ""), (2, None)])).collect() == []
