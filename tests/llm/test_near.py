import itertools
import random
from collections import Counter

import numpy as np
import pytest
from brute import documents, groups, shingles, weighted_jaccard
from citeloom.llm import minhash
from citeloom.llm.components import components


def words(rng, n):
    return [f"w{rng.randrange(4000)}" for _ in range(n)]


def changed(rng, base, edits):
    out = list(base)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"n{rng.randrange(10**6)}"
    return " ".join(out)


def test_similarity_and_estimate():
    rng = random.Random(2)
    base = words(rng, 150)
    texts = [" ".join(base), " ".join(base * 2), changed(rng, base, 2), " ".join(base[:90]), "alone here", ""]
    sets = [shingles(t) for t in texts]
    owner, shingle, weight = minhash.weighted_shingles([minhash.plain_words(t) for t in texts])
    got = [(shingle[owner == k], weight[owner == k]) for k in range(len(texts))]
    marks = minhash.signatures(owner, shingle, weight, len(texts), m=4096)
    for i, j in itertools.combinations(range(5), 2):
        exact = weighted_jaccard(sets[i], sets[j])
        assert minhash.similarity(got[i], got[j]) == pytest.approx(exact)
        assert np.mean(marks[i] == marks[j]) == pytest.approx(exact, abs=0.04)


def table_of(seed):
    rng = random.Random(seed)
    rows, n = [], 0
    for _ in range(12):
        base = words(rng, rng.choice((30, 80, 200)))
        for _ in range(rng.choice((1, 1, 3, 6))):
            rows.append((n, changed(rng, base, rng.choice((0, 0, 1, 1, 2, 4)))))
            n += 1
    passage = " ".join(words(rng, 60))
    rows += [(n + k, passage + " " + " ".join(words(rng, 40))) for k in range(8)]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "two words"), (904, "Two  WORDS"), (905, "three short words")]
    rows += [(906, "same row here"), (906, "same row here"), (None, "null id of its own"), (None, "null id of its own")]
    return rows


def wanted(rows):
    sets = [shingles(t or "") for _, t in rows]
    pairs = [
        (i, j)
        for i, j in itertools.combinations(range(len(rows)), 2)
        if (not sets[i] and not sets[j]) or weighted_jaccard(sets[i], sets[j]) >= 0.8
    ]
    root = groups(pairs, range(len(rows)))
    out = {}
    for i in range(len(rows)):
        out.setdefault(root[i], []).append(rows[i][0])
    return sorted(sorted(map(str, g)) for g in out.values())


def test_classes_against_brute_force(spark):
    rows = table_of(7)
    docs = documents(spark, rows, Node="1", BANDS="2").repartition(3)
    found = minhash.classes(docs)[1].collect()
    assert len(found) == len(rows)
    by = {}
    for r in found:
        by.setdefault(r.keeper, []).append(r)
    assert sorted(sorted(str(r.doc_id) for r in g) for g in by.values()) == wanted(rows)
    for g in by.values():
        assert {r.class_size for r in g} == {len(g)} and sum(r.row == r.keeper for r in g) == 1
    left = minhash.one_of_each(docs)
    assert left.columns == docs.columns and left.count() == len(by)


def test_large_group_of_variants(spark):
    rng = random.Random(3)
    base = words(rng, 120)
    rows = [(i, changed(rng, base, rng.choice((1, 2, 3, 4)))) for i in range(120)]
    found = minhash.classes(documents(spark, rows))[1].collect()
    by = {}
    for r in found:
        by.setdefault(r.keeper, []).append(str(r.doc_id))
    assert sorted(map(sorted, by.values())) == wanted(rows)


def test_pairs_of_a_group_are_walked_once(spark, monkeypatch):
    rng = random.Random(3)
    base = words(rng, 120)
    rows = [(i, changed(rng, base, rng.choice((1, 2, 3, 4)))) for i in range(120)]
    linked, walked, verify, join = [], [], minhash.verified, minhash.components

    def verified(pairs, texts):
        found = minhash.written(verify(pairs, texts), "counted")
        linked.append(found.count())
        return found

    def joined(links):
        walked.append(links.count())
        return join(links)

    monkeypatch.setattr(minhash, "verified", verified)
    monkeypatch.setattr(minhash, "components", joined)
    found = minhash.classes(documents(spark, rows))[1].collect()
    by = {}
    for r in found:
        by.setdefault(r.keeper, []).append(str(r.doc_id))
    sets = minhash._sets([t for _, t in rows])
    alike = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if minhash.similarity(sets[i], sets[j]) >= 0.8]
    expected = {}
    for i, root in groups(alike, range(len(rows))).items():
        expected.setdefault(root, []).append(str(i))
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, expected.values()))
    assert len(linked) == len(walked) == 3 and walked[0] == linked[0] > len(rows)
    assert all(w < len(rows) + new for w, new in zip(walked[1:], linked[1:]))


def test_variants_without_links_are_not_paired(spark, monkeypatch):
    rng = random.Random(5)
    base = words(rng, 150)
    rows = [(i, changed(rng, base, rng.choice((0, 1, 2)) if i % 2 else rng.choice((5, 6, 7)))) for i in range(240)]
    rows += [(1000 + i, changed(rng, base, 5) + " " + "x y z x y z x y z") for i in range(20)]
    made, plain = [], minhash.verified

    def counted(pairs, texts):
        made.append(pairs.count())
        return plain(pairs, texts)

    monkeypatch.setattr(minhash, "verified", counted)
    found = minhash.classes(documents(spark, rows))[1].collect()
    by = {}
    for r in found:
        by.setdefault(r.keeper, []).append(str(r.doc_id))
    sets = minhash._sets([t for _, t in rows])
    alike = [(i, j) for i, j in itertools.combinations(range(len(rows)), 2) if minhash.similarity(sets[i], sets[j]) >= 0.8]
    root = groups(alike, range(len(rows)))
    expected = {}
    for i, (doc_id, _) in enumerate(rows):
        expected.setdefault(root[i], []).append(str(doc_id))
    assert sorted(map(sorted, by.values())) == sorted(map(sorted, expected.values()))
    assert made[-1] < 4 * len(rows)


def test_own_shingles_bound_the_similarity():
    rng = random.Random(6)
    for _ in range(300):
        common = [(rng.randrange(1, 4), rng.randrange(1, 4)) for _ in range(rng.randrange(1, 12))]
        x = {("c", k): v for k, (v, _) in enumerate(common)} | {("x", k): rng.randrange(1, 4) for k in range(rng.randrange(4))}
        y = {("c", k): v for k, (_, v) in enumerate(common)} | {("y", k): rng.randrange(1, 4) for k in range(rng.randrange(4))}
        a, b = (sum(v for (s, _), v in z.items() if s != "c") / sum(z.values()) for z in (x, y))
        assert weighted_jaccard(Counter(x), Counter(y)) <= 2 / ((1 + a) / (1 - a) + (1 + b) / (1 - b)) + 1e-9


def test_empty_table(spark):
    assert minhash.classes(documents(spark, []))[1].collect() == []


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)]
    links += [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(60)]
    links = [(a, b) for a, b in links if a != b]
    found = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == groups(links, {x for pair in links for x in pair})


def test_bits_of_short_texts_are_independent():
    # Sets of 4 and 5 shingles, 4 in common: 0.8 alike.
    rng, n = np.random.default_rng(8), 5000
    sets = rng.integers(0, 2**63, (n, 5)).astype(np.uint64)

    def bits(size):
        owner = np.repeat(np.arange(n), size)
        found = minhash.signatures(owner, sets[:, :size].ravel(), np.ones(n * size), n)
        return minhash.sketch(found)

    apart = (bits(4) != bits(5)).sum(axis=1)
    assert abs(apart.mean() - minhash.REGISTERS / 10) < 0.5
    assert (apart > minhash.MOST_APART).sum() <= 1
