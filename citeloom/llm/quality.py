"""Quality grades by ordinal regression on hashed text.

A cumulative-link model: one weight a feature, shared by all grades, gives a
score s, and ordered thresholds t1 < t2 give P(grade >= k) = 1 / (1 + exp(tk - s)).
Features are hashed words, the kinds of character that follow each other, and
how much of a text repeats. The model is fitted on a bounded sample of labelled
rows (``SAMPLE``, drawn by a hash of the id, as many of each grade as there are
until the bound is shared out evenly) and applied where texts are read;
documents are never shuffled. A row weighs as many labels of its grade as it
stands for, so the drawing doesn't change the shares of the grades.

Grades come from the labels: 0 for bad quality, 1 for good but toxic, 2 for
good. Documents are selected when P(grade >= 2) is at least one half.

Defined cases: a null text is an empty one and is scored without features; a
label with a null, or for an unknown document, is not used; of several labels
of a document the lowest grade counts; with no labels, or only one grade, every
document gets the same probabilities, by the shares of the grades; repeated
rows are scored alike; other columns pass through :func:`selected`.
"""

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.registry import query, table
from citeloom.llm.rolling import TEXT, mix
from citeloom.llm.texts import bodies, joined, runs, slices
from citeloom.llm.written import fresh

#: Most labelled rows that the model is fitted on.
SAMPLE = 12_000
GRADES = 3
WORD_BITS = 17
KINDS = 12
STEPS = 12  # of shares of repeated words and phrases
WIDTH = (1 << WORD_BITS) + KINDS**3 + 2 * (STEPS + 1)
PHRASE = 3
BEGINNINGS = (4, 6)
#: Features that the fit works on at once: what it makes for them is small beside the features.
BLOCK = 1 << 20


def _kind_table() -> np.ndarray:
    kind = np.full(256, 9, np.uint8)
    for k, members in enumerate((b" ", b"\n\r", b"\t\x0b\x0c", b".,;:", b"!?", b"|", b"%&*#$@^~")):
        kind[np.frombuffer(members, np.uint8)] = k
    kind[ord("0") : ord("9") + 1] = 7
    kind[ord("A") : ord("Z") + 1] = 8
    kind[ord("a") : ord("z") + 1] = 10
    kind[128:] = 11
    return kind


KIND = _kind_table()
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of all features that are not zero."""
    data, starts = joined(texts)
    n, kinds = len(texts), KIND[data]
    word_from, word_to = runs((kinds == 7) | (kinds == 8) | (kinds >= 10))
    sums = TEXT.sums(LOWER[data])
    words = TEXT.windows(sums, word_from, word_to)
    doc = np.searchsorted(starts, word_from, "right") - 1
    parts = []
    # Whole words, and their beginnings: forms of a rare word share those.
    for length in (None, *BEGINNINGS):
        hashes, of = words, doc
        if length is not None:
            longer = word_to - word_from > length
            of = doc[longer]
            hashes = TEXT.windows(sums, word_from[longer], word_from[longer] + length) + np.uint64(length)
        codes, counts = np.unique((of << WORD_BITS) | (mix(hashes) >> np.uint64(64 - WORD_BITS)).astype(np.int64), return_counts=True)
        at, weight = codes >> WORD_BITS, 1 + np.log(counts)
        weight /= np.sqrt(np.bincount(at, weight**2, n))[at]
        parts.append((at, codes & ((1 << WORD_BITS) - 1), weight))
    # Kinds of three characters in a row, within a text.
    owner = np.repeat(np.arange(n), np.diff(starts))
    code = kinds[:-2].astype(np.int64) * KINDS**2 + kinds[1:-1] * np.int64(KINDS) + kinds[2:]
    inside = owner[:-2] == owner[2:]
    grid = np.bincount((owner[:-2] * KINDS**3 + code)[inside], minlength=n * KINDS**3).reshape(n, -1)
    at, what = np.nonzero(grid)
    parts.append((at, what + (1 << WORD_BITS), np.sqrt(grid[at, what] / grid.sum(axis=1)[at])))
    # Shares of words and of phrases that are repeats.
    base = (1 << WORD_BITS) + KINDS**3
    for k, (size, hashes) in enumerate(((1, words), (PHRASE, None))):
        if hashes is None:
            first = np.arange(max(0, len(words) - size + 1))
            first = first[doc[first] == doc[first + size - 1]]
            hashes, of = TEXT.windows(sums, word_from[first], word_to[first + size - 1]), doc[first]
        else:
            of = doc
        total = np.bincount(of, minlength=n)
        order = np.lexsort((hashes, of))
        same = (hashes[order][1:] == hashes[order][:-1]) & (of[order][1:] == of[order][:-1])
        repeats = np.bincount(of[order][1:][same], minlength=n)
        some = np.flatnonzero(total)
        share = repeats[some] / total[some]
        step = np.minimum(share * STEPS, STEPS).astype(np.int64)
        parts.append((some, base + k * (STEPS + 1) + step, np.ones(len(some))))
    return tuple(np.concatenate(x) for x in zip(*parts))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, texts: list[bytes]) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... of every text."""
        text, feature, value = features(texts)
        score = np.bincount(text, self.weights[feature] * value, len(texts))
        return 1 / (1 + np.exp(np.clip(self.thresholds - score[:, None], -50, 50)))


def fit(
    text: np.ndarray,
    feature: np.ndarray,
    value: np.ndarray,
    grade: np.ndarray,
    rounds: int = 250,
    decay: float = 5e-6,
    stands_for: np.ndarray | None = None,
) -> Model:
    """Weights and thresholds by full-batch Adam on the mean log likelihood.

    ``stands_for`` has the labels that one text of each grade stands for.
    """
    each = np.ones(GRADES) if stands_for is None else stands_for
    counts = np.bincount(grade, minlength=GRADES) * each
    n, texts = counts.sum(), len(grade)
    blocks = [slice(k, k + BLOCK) for k in range(0, len(text), BLOCK)]
    tail = (n - np.cumsum(counts)[:-1] + 0.5) / (n + 1)
    cuts = -np.log(tail / (1 - tail))
    cuts = np.maximum.accumulate(cuts + np.arange(GRADES - 1) * 1e-6)
    weights = np.zeros(WIDTH)
    if np.count_nonzero(counts) < 2:
        return Model(weights, cuts)
    # cuts = first, then logs of the gaps: always in order.
    free = np.concatenate([cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))])
    state = [np.zeros((2, WIDTH)), np.zeros((2, len(free)))]
    balance = ((n / (np.count_nonzero(counts) * np.maximum(counts, 1))) ** 0.6 * each)[grade]
    for turn in range(1, rounds + 1):
        cuts = free[0] + np.concatenate([np.zeros(1), np.cumsum(np.exp(free[1:]))])
        score, by_weight = np.zeros(texts), decay * weights
        for b in blocks:
            score += np.bincount(text[b], weights[feature[b]] * value[b], texts)
        # P(grade <= k) at the thresholds above and below each grade.
        edge = np.concatenate([np.full(1, -50.0), cuts, np.full(1, 50.0)])
        high = 1 / (1 + np.exp(np.clip(score - edge[grade + 1], -50, 50)))
        low = 1 / (1 + np.exp(np.clip(score - edge[grade], -50, 50)))
        slope_high, slope_low = high * (1 - high), low * (1 - low)
        scale = balance / np.maximum(high - low, 1e-12) / n
        by_score = (slope_high - slope_low) * scale  # of minus the log likelihood
        by_cut = np.zeros(GRADES - 1)
        np.add.at(by_cut, np.minimum(grade, GRADES - 2), np.where(grade < GRADES - 1, -slope_high * scale, 0))
        np.add.at(by_cut, np.maximum(grade - 1, 0), np.where(grade > 0, slope_low * scale, 0))
        tails = np.cumsum(by_cut[::-1])[::-1]
        for b in blocks:
            by_weight += np.bincount(feature[b], by_score[text[b]] * value[b], WIDTH)
        gradients = (by_weight, np.concatenate([tails[:1], tails[1:] * np.exp(free[1:])]))
        for values, gradient, moments, rate in zip((weights, free), gradients, state, (0.1, 0.05)):
            moments[0] += 0.1 * (gradient - moments[0])
            moments[1] += 0.01 * (gradient**2 - moments[1])
            values -= rate * (moments[0] / (1 - 0.9**turn)) / (np.sqrt(moments[1] / (1 - 0.99**turn)) + 1e-8)
    cuts = free[0] + np.concatenate([np.zeros(1), np.cumsum(np.exp(free[1:]))])
    return Model(weights.astype(np.float32), cuts)


def grades(labels: DataFrame) -> DataFrame:
    """(doc_id, grade) from quality and toxic marks."""
    grade = F.when(F.col("quality") == 0, 0).when(F.col("toxic") != 0, 1).otherwise(2)
    whole = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    return whole.groupBy("doc_id").agg(F.min(grade).alias("grade"))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, size in slices(batch["text"]):
            part = batch.slice(start, size)
            text, feature, value = features(bodies(part["text"]))
            order = np.argsort(text, kind="stable")
            bounds = np.searchsorted(text[order], np.arange(size + 1))
            ids, values = feature[order].astype("<i4"), value[order].astype("<f4")
            yield pa.RecordBatch.from_arrays(
                [
                    part["grade"],
                    pa.array([ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()),
                    pa.array([values[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary()),
                ],
                ["grade", "features", "values"],
            )


def quotas(counts: np.ndarray, sample: int) -> np.ndarray:
    """Labels to draw of each grade: all of a rare one, and what is left evenly of the others."""
    found, left = np.zeros(len(counts), np.int64), sample
    for k, grade in enumerate(np.argsort(counts, kind="stable")):
        found[grade] = min(counts[grade], left // (len(counts) - k))
        left -= found[grade]
    return found


def values_of(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """The numbers packed in a binary column, one row after the other, without a copy of a chunk."""
    parts = []
    for chunk in column.chunks:
        if len(chunk):
            ends = np.frombuffer(chunk.buffers()[1], "<i4")[chunk.offset : chunk.offset + len(chunk) + 1]
            parts.append(np.frombuffer(chunk.buffers()[2] or b"", "u1")[ends[0] : ends[-1]].view(kind))
    return parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, kind), *parts])


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model fitted on at most ``sample`` labelled documents."""
    marks, counts = grades(labels), np.zeros(GRADES, np.int64)
    for row in marks.groupBy("grade").count().collect():
        counts[row["grade"]] = row["count"]
    quota = quotas(counts, sample)
    by_id = (F.xxhash64("doc_id"), "doc_id")
    parts = [marks.filter(F.col("grade") == k).orderBy(*by_id).limit(int(n)) for k, n in enumerate(quota)]
    drawn = reduce(DataFrame.unionByName, parts)
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("grade", "text")
    # Repeated documents can't push the rows beyond their bound.
    found = rows.mapInArrow(_sparse, "grade int, features binary, values binary")
    found = found.orderBy(F.xxhash64("features", "values"), "grade", "features").limit(sample)
    # No row becomes a Python object.
    taken = found.toArrow()
    grade = taken["grade"].to_numpy().astype(np.int64)
    sizes = pc.binary_length(taken["features"]).to_numpy() // 4
    feature, value = (
        np.require(values_of(taken[name], kind), requirements="O") for name, kind in (("features", "<i4"), ("values", "<f4"))
    )
    # The arrays own their numbers, so that Arrow's memory goes back before the fit; it would be held ever after.
    del taken
    pa.default_memory_pool().release_unused()
    text = np.repeat(np.arange(len(grade), dtype=np.int32), sizes)
    return fit(text, feature, value, grade, stands_for=counts / np.maximum(quota, 1))


def graded(docs: DataFrame, model: Model, tails: list[str]) -> DataFrame:
    """``docs`` and P(grade >= k) in the columns ``tails``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, size in slices(batch.column(at)):
                part = batch.slice(start, size)
                found = shared.value.tails(bodies(part.column(at)))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, *(pa.array(found[:, k]) for k in range(GRADES - 1))],
                    [*part.schema.names, *tails],
                )

    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.DoubleType()) for c in tails)])
    return docs.mapInArrow(run, schema)


def selected(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """Documents whose top grade has a probability of at least ``least``."""
    tails = fresh(docs.columns, "tail_1", "tail_2")
    return graded(docs, trained(docs, labels), tails).filter(F.col(tails[-1]) >= least).drop(*tails)


@query("op2_quality_grades")
def op2_quality_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and tail probabilities of every document."""
    docs = table(spark, sf_dir, "documents")
    model = trained(docs, table(spark, sf_dir, "labels"))
    return graded(docs.select("doc_id", "text"), model, ["p_at_least_1", "p_at_least_2"]).select(
        "doc_id",
        (F.col("p_at_least_1") + F.col("p_at_least_2")).alias("expected_grade"),
        "p_at_least_1",
        "p_at_least_2",
        (F.col("p_at_least_2") >= 0.5).alias("selected"),
    )
