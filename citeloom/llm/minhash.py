"""Near-duplicates by ProbMinHash, banding and verification.

A text is its five-word shingles, weighted by how often they occur. For every
shingle a Poisson process with that rate, seeded by the shingle, drops arrivals
into the registers of a signature; a register keeps its earliest arrival, and a
process ends as soon as its next arrival would be later than every register's.
Two registers agree with the probability Jaccard similarity of the weights,
which is the plain Jaccard similarity where shingles occur once.

Texts with the same words are one representative. Representatives that agree in
a whole band of registers meet in a bucket. In a first turn the members of a
bucket are compared with its smallest and largest member: as many pairs as
members. Links found so make components. In a second turn the members outside a
bucket's main component meet a few more of its members, drawn by a hash, so that
a large group of variants closes up without its pairs being made. The last turn
compares all pairs of a bucket that are still in different components and whose
signatures don't rule a link out. In a bucket where those would be many pairs a
member, the shingles of its members are counted first: what a text alone holds
is missing from every other, which bounds its similarity to all of them at once.
Every pair is verified on the texts by the exact similarity.

Recall: a pair at similarity 0.8 shares none of the 25 bands of 5 registers
with a probability of 5e-5, and less above.

Defined cases: a null text is an empty one; texts without words are copies of
each other; a text of fewer than five words is one shingle; repeated rows are
copies; rows with a null id are grouped under the smallest row of their class,
and null is the smallest id; an empty table gives no rows; other columns pass
through :func:`one_of_each`.
"""

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.components import components
from citeloom.llm.registry import query, table
from citeloom.llm.rolling import TEXT, mix
from citeloom.llm.texts import joined, runs, slices
from citeloom.llm.written import fresh, written

SHINGLE = 5
LEAST = 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Bits that differ at a similarity of 0.8: 12.5 on average with a deviation of 3.4; more than this rule it out.
MOST_APART = 30
LEADERS = 6
#: Pairs a member above which a bucket's shingles are counted before its pairs are made.
CROWD = 4
COLUMNS = ("row", "node", "bands", "bits_1", "bits_2")
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def plain_words(text: str | None) -> bytes:
    """The words of a text, in lower case, one space apart."""
    return " ".join((text or "").lower().split()).encode()


def weighted_shingles(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, weight) of texts from :func:`plain_words`, in order of text and shingle."""
    data, starts = joined(texts)
    begin, end = runs((data != 32) & (data != 10))
    doc = np.searchsorted(starts, begin, "right") - 1
    words = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(words) - words
    count = np.where(words > 0, np.maximum(words - size + 1, 1), 0)
    owner = np.repeat(np.arange(len(texts)), count)
    place = first[owner] + np.arange(len(owner)) - (np.cumsum(count) - count)[owner]
    last = np.minimum(place + size, (first + words)[owner]) - 1
    hashes = TEXT.windows(TEXT.sums(data), begin[place], end[last])
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return owner[at], hashes[at], np.diff(np.append(at, len(owner))).astype(np.float64)


def signatures(text: np.ndarray, shingle: np.ndarray, weight: np.ndarray, n: int, m: int = REGISTERS) -> np.ndarray:
    """ProbMinHash signatures (n, m) of weighted sets; texts without shingles get zeros."""
    earliest = np.full(n * m, np.inf)
    chosen = np.zeros(n * m, np.uint64)
    time = np.zeros(len(text))
    state = shingle.copy()
    while len(text):
        state = state + _GOLDEN
        bits = mix(state)
        # 52 bits make an exponential waiting time, another draw the register.
        time = time - np.log1p(-((bits >> np.uint64(12)).astype(np.float64) / 2.0**52)) / weight
        place = text * m + (mix(bits ^ _GOLDEN) % np.uint64(m)).astype(np.int64)
        np.minimum.at(earliest, place, time)
        won = time == earliest[place]
        chosen[place[won]] = shingle[won]
        # Later arrivals only come later: done where all registers are earlier.
        going = time < earliest.reshape(n, m).max(axis=1)[text]
        text, shingle, weight, time, state = (x[going] for x in (text, shingle, weight, time, state))
    return (mix(chosen) >> np.uint64(32)).astype(np.uint32).reshape(n, m)


def sketch(found: np.ndarray) -> np.ndarray:
    """One bit a register, from a hash of its shingle and its number: a shingle in many registers has bits of its own in each."""
    return (mix(found + np.arange(1, found.shape[1] + 1, dtype=np.uint64) * _GOLDEN) & np.uint64(1)).astype(np.uint8)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two weighted sets (shingles in order, weights).

    Sum over common elements d of 1 / sum_e max(x_e / x_d, y_e / y_d). With the
    elements in order of y/x, the maximum is the first up to the place of d
    and the second after, so running sums do.
    """
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    x, y = a[1][i], b[1][j]
    order = np.argsort(y / x, kind="stable")
    x, y = x[order], y[order]
    only_x, only_y = a[1].sum() - x.sum(), b[1].sum() - y.sum()
    up_to = np.cumsum(x)
    after = y.sum() - np.cumsum(y)
    return float((1 / ((up_to + only_x) / x + (after + only_y) / y)).sum())


def node_of(words: bytes) -> int:
    """A 64-bit name of the words of a text."""
    return int.from_bytes(hashlib.blake2b(words, digest_size=8).digest(), "little", signed=True)


def signed(docs: DataFrame, names: list[str]) -> DataFrame:
    """``docs`` with a node, the keys of its bands and one bit a register, in the columns ``names``."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, size in slices(batch.column(at)):
                part = batch.slice(start, size)
                texts = [plain_words(t) for t in part.column(at).to_pylist()]
                found = signatures(*weighted_shingles(texts), size)
                keys = np.zeros((size, BANDS), np.uint64)
                for k in range(ROWS):
                    keys = mix(keys + found[:, k::ROWS] + np.arange(1, BANDS + 1, dtype=np.uint64) * _GOLDEN)
                bits = np.zeros((size, 128), np.uint8)
                bits[:, :REGISTERS] = sketch(found)
                bits = np.packbits(bits, axis=1).view("<i8")
                used = np.array([bool(t) for t in texts])
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns,
                        pa.array([node_of(t) for t in texts], pa.int64()),
                        pa.array([row.view(np.int64) if u else [] for u, row in zip(used, keys)], pa.list_(pa.int64())),
                        pa.array(bits[:, 0]),
                        pa.array(bits[:, 1]),
                    ],
                    [*part.schema.names, *names],
                )

    kinds = (T.LongType(), T.ArrayType(T.LongType()), T.LongType(), T.LongType())
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds))])
    return docs.mapInArrow(run, schema)


def _sets(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Weighted sets of texts; one that comes often is worked out once."""
    places = {t: k for k, t in enumerate(dict.fromkeys(texts))}
    owner, shingle, weight = weighted_shingles([plain_words(t) for t in places])
    bounds = np.searchsorted(owner, np.arange(len(places) + 1))
    found = [(shingle[i:j], weight[i:j]) for i, j in zip(bounds, bounds[1:])]
    return [found[places[t]] for t in texts]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, size in slices(batch["text_a"]):
            part = batch.slice(start, size)
            sides = zip(*(_sets(part[name].to_pylist()) for name in ("text_a", "text_b")))
            yield part.select(["a", "b"]).filter(pa.array([similarity(x, y) >= LEAST for x, y in sides]))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) whose texts are similar; ``texts`` has one text a node."""
    # Pairs grow with the documents too.
    pairs = pairs.hint("merge").join(texts.toDF("a", "text_a"), "a")
    both = pairs.hint("merge").join(texts.toDF("b", "text_b"), "b")
    return both.mapInArrow(_verify, "a long, b long")


def _united(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _stars(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, root) of the components of ``links``, and one link (a, b) a node, to its root, that joins the same nodes."""
    roots = components(links)
    return roots, roots.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def _split(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members, with their component, of the bands that hold several components."""
    placed = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high")
    return written(placed.join(several.select("band"), "band"), "split-bands")


def _pairs(one: DataFrame, tried: list[DataFrame]) -> DataFrame:
    """Each pair once, the smaller node first, without those compared before."""
    ordered = one.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return written(ordered.join(_united(tried), ["a", "b"], "left_anti") if tried else ordered, "near-pairs")


def _shingle_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, size in slices(batch["text"]):
            part = batch.slice(start, size)
            owner, shingle, weight = weighted_shingles([plain_words(t) for t in part["text"].to_pylist()])
            node = part["node"].to_numpy()[owner]
            yield pa.RecordBatch.from_arrays(
                [pa.array(node), pa.array(shingle.view(np.int64)), pa.array(weight.astype(np.int64))],
                ["node", "shingle", "weight"],
            )


def _own(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, total, plain, own, rest_1, rest_2) of ``nodes``.

    The weight of each, whether no shingle repeats, the weight of what it alone
    holds, and 128 parity bits of its other shingles.
    """
    wanted = texts.join(nodes.hint("merge"), "node", "left_semi")
    rows = written(wanted.mapInArrow(_shingle_rows, "node long, shingle long, weight long"), "shingles")
    place = F.xxhash64("shingle").bitwiseAND(127).cast("int")
    flips = [F.when(F.shiftright(place, 6) == k, F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(63))).otherwise(0) for k in (0, 1)]
    totals = rows.groupBy("node").agg(
        F.sum("weight").alias("total"),
        (F.max("weight") == 1).alias("plain"),
        F.bit_xor(flips[0]).alias("all_1"),
        F.bit_xor(flips[1]).alias("all_2"),
    )
    # Counts are combined where rows are read, so a shingle of all variants is one row a task.
    once = rows.groupBy("shingle").agg(
        F.count(F.lit(1)).alias("n"), F.any_value("node").alias("node"), F.any_value("weight").alias("weight")
    )
    own = once.filter("n = 1").groupBy("node").agg(
        F.sum("weight").alias("own"), F.bit_xor(flips[0]).alias("own_1"), F.bit_xor(flips[1]).alias("own_2")
    )
    return totals.join(own, "node", "left").selectExpr(
        "node",
        "total",
        "plain",
        "coalesce(own, 0L) AS own",
        "all_1 ^ coalesce(own_1, 0L) AS rest_1",
        "all_2 ^ coalesce(own_2, 0L) AS rest_2",
    )


def may_link(x: str, y: str) -> Column:
    """False for two members of :func:`_own` that can't be similar.

    Where no shingle repeats, the common ones are at most what either has left
    without its own; and what only one holds is at least the own of both and one
    more for each parity bit that differs. With weights, for shares a and b that are own, each term
    of the similarity is at most ``2 / ((1 + a) / x_d + (1 + b) / y_d)``, a
    concave function, so their sum is at most ``2 / (f(a) + f(b))`` with
    ``f(a) = (1 + a) / (1 - a)``.
    """
    left = F.least(F.expr(f"{x}.total - {x}.own"), F.expr(f"{y}.total - {y}.own"))
    apart = F.expr(f"{x}.own + {y}.own + bit_count({x}.rest_1 ^ {y}.rest_1) + bit_count({x}.rest_2 ^ {y}.rest_2)")
    both = F.expr(f"{x}.total + {y}.total")
    sets = F.least(left, (both - apart) / 2) * (1 + LEAST) >= both * LEAST - 1e-6
    f = [F.expr(f"({z}.total + {z}.own) / nullif({z}.total - {z}.own, 0)") for z in (x, y)]
    weights = F.coalesce(f[0] + f[1] <= 2 / LEAST + 1e-6, F.lit(False))
    return F.when(F.expr(f"{x}.plain AND {y}.plain"), sets).otherwise(weights)


def _thinned(split: DataFrame, texts: DataFrame) -> DataFrame:
    """``split`` with the columns of :func:`_own` for the members of crowded bands, less those that are similar to none there."""
    sizes = split.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"))
    pairs = (F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2
    crowded = sizes.groupBy("band").agg(F.sum("n").alias("members"), pairs.alias("pairs"))
    crowded = written(crowded.filter(F.col("pairs") > CROWD * F.col("members")).select("band"), "crowded")
    here = written(split.join(crowded, "band", "left_semi").select("node").distinct(), "crowd")
    own = written(_own(here, texts), "own")
    placed = split.join(crowded.withColumn("crowded", F.lit(True)), "band", "left").join(own, "node", "left")
    # Another text holds none of what is its own.
    alone = F.col("own") > F.col("total") * (1 - LEAST) + 1e-6
    return placed.filter(~F.coalesce(F.col("crowded") & alone, F.lit(False))).drop("crowded")


def near_links(rows: DataFrame) -> DataFrame:
    """Links (a, b) that join all near-duplicate nodes of ``rows`` (node, text, bands, bits).

    Those of the last turn are verified pairs. Of the turns before, each node has one, to the root of what verified
    pairs join: a large group has many pairs, and none is walked again in later turns.
    """
    nodes = rows.select("node", "bands", "bits_1", "bits_2").dropDuplicates(["node"])
    members = written(nodes.withColumn("band", F.explode("bands")).drop("bands"), "bands")
    ends = members.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    members = written(members.join(ends, "band"), "shared-bands")
    # Both sides grow with the documents: a merge join at every size.
    wanted = members.select("node").distinct().hint("merge")
    texts = written(rows.select("node", "text").join(wanted, "node", "left_semi").dropDuplicates(["node"]), "near-texts")
    star = [members.select(F.col("node").alias("a"), F.col(x).alias("b")) for x in ("low", "high")]
    tried = [_pairs(_united(star), [])]
    roots, stars = _stars(written(verified(tried[0], texts), "near-links"))
    members = members.drop("low", "high")
    split = _split(members, roots)
    drawn = [F.min_by("node", F.xxhash64(F.lit(k), "node")) for k in range(LEADERS)]
    sizes = split.groupBy("band", "root").agg(F.count(F.lit(1)).alias("n"), F.array(*drawn).alias("leaders"))
    main = sizes.groupBy("band").agg(F.max(F.struct("n", "root", "leaders")).alias("m"))
    outside = split.join(main, "band").filter("root <> m.root")
    met = outside.select(F.col("node").alias("a"), F.explode(F.array_distinct("m.leaders")).alias("b"))
    tried.append(_pairs(met, tried))
    roots, stars = _stars(stars.unionByName(written(verified(tried[1], texts), "near-links")))
    split = _thinned(_split(members, roots), texts)
    # Nodes share many bands; a pair is made at the first of them only.
    split = split.join(rows.select("node", F.array_sort("bands").alias("bands")).dropDuplicates(["node"]), "node")
    first = F.array_min(F.array_intersect("x.bands", "y.bands"))
    # One bit a register differs in half of those that disagree.
    apart = F.bit_count(F.expr("x.bits_1 ^ y.bits_1")) + F.bit_count(F.expr("x.bits_2 ^ y.bits_2"))
    # Two members that were counted were counted together.
    counted = F.coalesce(may_link("x", "y"), F.lit(True)) | F.expr("x.total IS NULL OR y.total IS NULL")
    rest = split.alias("x").join(
        split.alias("y"),
        F.expr("x.band = y.band AND x.node < y.node AND x.root <> y.root")
        & (apart <= MOST_APART)
        & counted
        & (first == F.col("x.band")),
    )
    rest = _pairs(rest.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")), tried)
    return stars.unionByName(written(verified(rest, texts), "near-links"))


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame, str]:
    """``docs`` written once with a row number, and (row, keeper, class_id, class_size) of every row."""
    row, *names = fresh(docs.columns, "row", "node", "bands", "bits_1", "bits_2")
    kept = written(signed(docs, names).withColumn(row, F.monotonically_increasing_id()), "signed")
    rows = kept.select(
        F.col("doc_id"), F.col("text"), *(F.col(x).alias(y) for x, y in zip([row, *names], COLUMNS))
    )
    roots = components(near_links(rows))
    placed = rows.select("doc_id", "row", "node").join(roots, "node", "left")
    placed = placed.select("doc_id", "row", F.coalesce("root", "node").alias("root"))
    first = placed.groupBy("root").agg(
        F.min(F.struct("doc_id", "row")).alias("first"), F.count(F.lit(1)).alias("class_size")
    )
    found = placed.join(first, "root").select(
        "doc_id",
        "row",
        F.col("first.row").alias("keeper"),
        F.col("first.doc_id").alias("class_id"),
        "class_size",
    )
    return kept, found, row


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each class of near-duplicates, with the columns it came with."""
    kept, found, row = classes(docs)
    dropped = found.filter("row <> keeper").select(F.col("row").alias(row))
    return kept.join(written(dropped, "dropped"), row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


@query("op4_near_dedup")
def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near-duplicates of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return classes(docs)[1].select("doc_id", "class_id", "class_size", (F.col("row") == F.col("keeper")).alias("kept"))
