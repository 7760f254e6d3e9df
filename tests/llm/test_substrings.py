import random

from brute import documents, repeated_bytes
from citeloom.llm import substrings


def test_cover_holds_every_difference():
    differences = {(a - b) % substrings.PERIOD for a in substrings.COVER for b in substrings.COVER}
    assert differences == set(range(substrings.PERIOD))


def check(spark, rows):
    found = substrings.without_repeats(documents(spark, rows).repartition(3)).collect()
    wanted = repeated_bytes([(t or "").encode() for _, t in rows], substrings.LENGTH)
    by_id = {i: (len((t or "").encode()), left, runs) for (i, t), (left, runs) in zip(rows, wanted)}
    assert len(found) == len(rows)
    for r in found:
        assert (r.n_bytes, bytes(r.kept), [(s.start, s.end) for s in r.spans]) == by_id[r.doc_id], r.doc_id


def test_against_brute_force(spark):
    random.seed(4)
    letters = lambda n: "".join(random.choices("abcé ", k=n))
    shared = [letters(n) for n in (190, 199, 200, 201, 260, 700)]
    rows = [(0, None), (1, ""), (2, letters(150)), (3, "x" * 1000), (4, "ab" * 90), (5, "ab" * 101)]
    for i in range(6, 60):
        parts = [letters(random.choice((0, 3, 50, 140, 400)))]
        for _ in range(random.choice((0, 0, 1, 2, 3))):
            body = random.choice(shared)
            a = random.randrange(0, 60)
            parts += [body[a:] if random.random() < 0.4 else body, letters(random.choice((0, 1, 60)))]
        rows.append((i, "".join(parts)))
    rows += [(100, rows[40][1]), (101, rows[41][1] + "z")]
    check(spark, rows)


def test_strings_do_not_reach_across_texts(spark):
    check(spark, [(0, "a" * 150), (1, "a" * 150), (2, "b" * 199), (3, "b" * 199)])


def test_empty_table(spark):
    assert substrings.without_repeats(documents(spark, [])).collect() == []


def test_repeated_rows_and_null_ids(spark):
    text = "".join(random.Random(1).choices("abcdefgh", k=300))
    found = substrings.without_repeats(documents(spark, [(None, text), (7, text), (7, text)])).collect()
    assert sorted((r.doc_id is None, bytes(r.kept)) for r in found) == [(False, b""), (False, b""), (True, b"")]
