"""Small helpers: odd tables, and results worked out the plain way."""

from collections import Counter, defaultdict

from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def documents(spark, rows, **extra):
    """A documents table of (doc_id, text) or (doc_id, text, source) rows."""
    full = [(r[0], r[1], None, r[2] if len(r) > 2 else "a", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, DOCS)
    for name, value in extra.items():
        df = df.selectExpr("*", f"{value} AS `{name}`")
    return df


def repeated_bytes(texts, length):
    """(left, runs) of every text when each byte of a repeated string of ``length`` goes."""
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs, at = [], 0
        while (start := gone.find(1, at)) >= 0:
            end = gone.find(0, start)
            at = end if end >= 0 else len(t)
            runs.append((start, at))
        out.append((bytes(b for b, g in zip(t, gone) if not g), runs))
    return out


def shingles(text, size=5):
    words = text.lower().split()
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def weighted_jaccard(a, b):
    """Probability Jaccard, straight from its definition."""
    every = set(a) | set(b)
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in every) for d in set(a) & set(b))


def groups(pairs, nodes):
    """The smallest node each node is connected to."""
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    root = {}
    for node in sorted(nodes):
        todo = [node] if node not in root else []
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = node
                todo += near[x]
    return root
