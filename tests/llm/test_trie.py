import hashlib
import random
import zlib
from collections import defaultdict

from citeloom.llm import trie as t
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, DEPTH int, key string"


def turns_of(rows):
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            convs[conv].append((turn is not None, turn or 0, digest, role, text))
    return {c: [x[3:] for x in sorted(xs)] for c, xs in convs.items()}


def family(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - int(c - 5 * int(c / 5)), [])[:h] + own[h:]
    return out


def brute(convs):
    """Every node by its sequence of turns, subtrees by comparing all of them."""
    members, ends = defaultdict(set), defaultdict(list)
    for c, turns in convs.items():
        ends[tuple(turns)].append(c)
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
    under = defaultdict(list)
    for node in members:
        for d in range(len(node) + 1):
            under[node[:d]].append(node)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    return sorted(
        (
            min(of), len(node), min(members[node[:-1]]) if node else -1, len(of), children[node],
            sum(not children[x] for x in under[node]),
            sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under[node] if x),
            hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest(),
        )
        for node, of in members.items()
    )


def found(df):
    return sorted(tuple(-1 if x is None else x for x in r) for r in df.collect())


def frame(spark, rows, n=3):
    return spark.createDataFrame([(*x, 1, "x") for x in rows], SCHEMA).repartition(n)


def built(df):
    turns, ids = t.rebuilt(t.entries(df))
    keys = t.prefix_table(turns, "own", "known", "turn", "digest", "id")
    ends = ids.join(keys.groupBy("conv_id").agg(F.max("depth").alias("n")), "conv_id", "left")
    return t.node_rows(keys, ends.select("conv_id", F.coalesce("n", F.lit(0)).alias("n")))


def some_rows(draw, n):
    """Conversations that share first turns to all depths, ends inside of others among them."""
    stems = [[(draw.choice("ua"), f"é{draw.randrange(3)}") for _ in range(14)] for _ in range(4)]
    rows = []
    for c in range(n):
        stem = draw.choice(stems)[: draw.randrange(15)]
        rest = [(draw.choice(["u", "a", None]), draw.choice(["x", "yy", None, ""])) for _ in range(draw.choice([0, 0, 1, 3]))]
        rows += [(c if draw.random() < 0.98 else None, k if k else draw.choice([0, None]), *x) for k, x in enumerate(stem + rest)]
    return rows


def test_random_tries(spark):
    rows = some_rows(random.Random(1), 160) + [(-3, 1, "u", "é1"), (-4, 1, "u", "é1"), (-4, 1, "u", "é1")]
    convs = turns_of(rows)
    df = frame(spark, rows)
    assert found(built(df)) == brute(family(convs))


def test_a_conversation_over_many_tasks(spark):
    rows = [(5, i, "u", f"text {i % 50}") for i in range(600)] + [(c, i, "u", f"text {i % 50}") for c in (6, 7, 30) for i in range(40 * c)]
    rows += [(50 + c, i, "s", "the same") for c in range(30) for i in range(2)]
    df = frame(spark, rows, 8)
    assert found(t.prefix_trie(df)) == brute(turns_of(rows))


def test_edges_of_the_table(spark):
    assert found(t.prefix_trie(frame(spark, [(None, 1, "u", "x")]))) == []
    # All turns may go: no family head, and fewer turns of its own than are left out.
    rows = [(c, 0, "u", "x") for c in (3, 8, 13, 1001)]
    assert found(built(frame(spark, rows))) == brute(family(turns_of(rows)))


def test_two_fattest_numbers(spark):
    pairs = [(a, b) for a in range(40) for b in range(a + 1, 41)]
    rows = spark.createDataFrame(pairs, "a int, b int").select("a", "b", t.fattest(F.col("a"), F.col("b")).alias("f")).collect()
    assert all(r.f == max(range(r.a + 1, r.b + 1), key=lambda x: x & -x) for r in rows)


def test_pieces_of_a_conversation_are_put_together():
    class Row:
        def __init__(self, **k):
            self.__dict__.update(k)

    borders = [
        Row(part=0, first_conv=1, conv_id=2, opening=False, depth=2, key=t._key(5), total=7),
        Row(part=2, first_conv=2, conv_id=2, opening=True, depth=3, key=t._key(11), total=1),
        Row(part=3, first_conv=2, conv_id=4, opening=False, depth=1, key=t._key(9), total=2),
        Row(part=4, first_conv=5, conv_id=5, opening=True, depth=1, key=t._key(9), total=2),
    ]
    assert t.carried(borders) == {2: (2, 5, 7), 3: (5, (5 * pow(t.BASE, 3, t.MODULUS) + 11) % t.MODULUS, 8)}
