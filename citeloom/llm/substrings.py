"""Removal of repeated substrings by blockwise suffix sorting with a difference cover.

Two suffixes are tied when they share their first ``LENGTH`` bytes; every byte
of a tied prefix goes, wherever the other suffix is. Only ties are asked for,
so suffixes are compared by fingerprints of their prefixes, not letter by letter.

A difference cover is a set of residues modulo ``PERIOD`` such that, for any
two places, some shift below the period moves both onto the cover. A prefix of
200 bytes therefore holds, at the same shift as its partner, a sampled place
with 68 more bytes. So the sampled places (9 % of all) are ranked first, by
their 68 bytes, and a suffix whose samples all have ranks of their own is
settled: no other can tie with it. The rest are sorted, one bucket at a time, in
``PASSES`` passes over the text that is left, so the space for suffixes stays a
fraction of the text. A bucket is chosen by a second fingerprint, independent
of the one that is sorted: prefixes taken for equal agree in both.

Texts are packed into blocks, and a block sends each fingerprint once with a
mark if it met it twice, so the most common string costs a row a block. Buckets
are numbered by the size of the table and answer with one bit a fingerprint.

Defined cases: a null text is empty; texts below 200 bytes lose nothing by
themselves; strings never reach across texts; repeated rows repeat each other's
bytes and lose them all; an empty table gives no rows; other columns are not
read, and ``doc_id`` may be null or repeated.
"""

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.registry import query, table
from citeloom.llm.rolling import Rolling
from citeloom.llm.texts import bodies, slices
from citeloom.llm.written import written

LENGTH = 200
PERIOD = 133
#: A perfect difference set: every residue but 0 is one difference of two members (fixed values).
COVER = (1, 10, 11, 13, 27, 31, 68, 75, 83, 110, 115, 121)
SAMPLE = LENGTH - PERIOD + 1
PASSES = 4
#: Bytes of text whose samples go to one bucket.
BUCKET = 16 << 20
_FIRST, _SECOND = Rolling(5), Rolling(6)


def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in blocks: ids, sizes and bytes of a run of rows."""
    for batch in batches:
        for start, size in slices(batch["text"]):
            part = batch.slice(start, size)
            texts = bodies(part["text"])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([part["doc_id"].to_pylist()], pa.list_(pa.int64())),
                    pa.array([np.array([len(t) for t in texts], "<i8").tobytes()]),
                    pa.array([b"".join(texts)], pa.binary()),
                ],
                ["ids", "sizes", "body"],
            )


def _read(body: bytes, sizes: bytes) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.frombuffer(sizes, "<i8")
    return np.frombuffer(body, np.uint8), np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths)])


def sample_places(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, text) of the sampled places that have ``SAMPLE`` bytes after them, in order."""
    lengths = np.diff(starts)
    periods = np.maximum(0, -(-(lengths - SAMPLE + 1) // PERIOD))
    text = np.repeat(np.arange(len(lengths)), periods)
    turn = np.arange(len(text)) - (np.cumsum(periods) - periods)[text]
    offset = (turn[:, None] * PERIOD + np.array(COVER)).ravel()
    text = np.repeat(text, len(COVER))
    inside = offset + SAMPLE <= lengths[text]
    return (offset + starts[text])[inside], text[inside]


def _prints(data: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent fingerprints of ``length`` bytes from each place."""
    return tuple(h.windows(h.sums(data), places, places + length) for h in (_FIRST, _SECOND))


def _unique(prints: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(fingerprints, buckets, met twice) once each, by bucket and fingerprint; and where each went."""
    order = np.lexsort((prints, bucket))
    p, b = prints[order], bucket[order]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (b[1:] != b[:-1])
    at = np.flatnonzero(new)
    went = np.empty(len(p), np.int64)
    went[order] = np.cumsum(new) - 1
    return p[at], b[at], np.diff(np.append(at, len(p))) > 1, went


SENT = "bucket long, block long, prints binary, twice binary"


def _send(block: int, prints: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    p, b, twice, _ = _unique(prints, bucket)
    names, first = np.unique(b, return_index=True)
    bounds = np.append(first, len(b))
    pieces = list(zip(bounds, bounds[1:]))
    return pa.RecordBatch.from_arrays(
        [
            pa.array(names.astype(np.int64)),
            pa.array(np.full(len(names), block, np.int64)),
            pa.array([p[i:j].astype("<u8").tobytes() for i, j in pieces], pa.binary()),
            pa.array([np.packbits(twice[i:j]).tobytes() for i, j in pieces], pa.binary()),
        ],
        ["bucket", "block", "prints", "twice"],
    )


def _sort_bucket(rows: pa.Table) -> pa.Table:
    """One bit a fingerprint: whether it was sent twice or by two blocks."""
    sent = [np.frombuffer(x.as_py(), "<u8") for x in rows["prints"]]
    tied = [np.unpackbits(np.frombuffer(x.as_py(), np.uint8), count=len(s)) for x, s in zip(rows["twice"], sent)]
    prints, tied = np.concatenate(sent), np.concatenate(tied).astype(bool)
    order = np.argsort(prints)
    same = prints[order][1:] == prints[order][:-1]
    tied[order[1:][same]] = True
    tied[order[:-1][same]] = True
    bounds = np.cumsum([0, *map(len, sent)])
    return pa.table(
        {
            "bucket": rows["bucket"],
            "block": rows["block"],
            "tied": pa.array([np.packbits(tied[i:j]).tobytes() for i, j in zip(bounds, bounds[1:])], pa.binary()),
        }
    )


def _ties(sent: DataFrame) -> DataFrame:
    return sent.groupBy("bucket").applyInArrow(_sort_bucket, "bucket long, block long, tied binary")


def _by_block(ties: DataFrame) -> DataFrame:
    """(block, answers): the bits of a block in the order of its buckets; as many as the block sent."""
    return ties.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", "tied"))).alias("answers"))


def _answer(answers: list[dict] | None, prints: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Whether each fingerprint is tied."""
    p, b, _, went = _unique(prints, bucket)
    counts = np.unique(b, return_counts=True)[1]
    bits = [np.unpackbits(np.frombuffer(a["tied"], np.uint8), count=n) for a, n in zip(answers or [], counts)]
    return np.concatenate([*bits, np.zeros(0, np.uint8)]).astype(bool)[went]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield batch.slice(row, 1).to_pylist()[0]


def _of_samples(row: dict, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    data, starts = _read(row["body"], row["sizes"])
    places, text = sample_places(starts)
    prints, other = _prints(data, places, SAMPLE)
    return starts, places, text, prints, (other % np.uint64(buckets)).astype(np.int64)


def open_suffixes(starts: np.ndarray, places: np.ndarray, text: np.ndarray, tied: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last (inclusive) of each run of suffixes whose prefixes hold a tied sample."""
    p, t = places[tied], text[tied]
    first = np.maximum(p - PERIOD + 1, starts[t])
    last = np.minimum(p, starts[t + 1] - LENGTH)
    use = last >= first
    first, last, t = first[use], last[use], t[use]
    # Both ends grow with the place, so runs that touch follow each other.
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] > last[:-1] + 1) | (t[1:] != t[:-1])
    at = np.flatnonzero(new)
    return first[at], last[np.append(at[1:] - 1, len(last) - 1)] if len(at) else last


def _places(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    sizes = last - first + 1
    return np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())


def _of_suffixes(row: dict, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place in the block, fingerprint, pass, bucket) of the suffixes to sort."""
    first, size = np.frombuffer(row["first"], "<i8"), np.frombuffer(row["count"], "<i8")
    data = np.frombuffer(row["open"], np.uint8)
    held = np.cumsum(size + LENGTH - 1) - (size + LENGTH - 1)
    local = _places(held, held + size - 1)
    prints, other = _prints(data, local, LENGTH)
    turn = (other % np.uint64(PASSES)).astype(np.int64)
    return _places(first, first + size - 1), prints, turn, (other // np.uint64(PASSES) % np.uint64(buckets)).astype(np.int64)


def _covered(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes covered by prefixes that start at ``places`` (in order)."""
    if not len(places):
        return places, places
    gap = np.flatnonzero(places[1:] > places[:-1] + LENGTH)
    return places[np.append(0, gap + 1)], places[np.append(gap, len(places) - 1)] + LENGTH


def repeated_spans(blocks: DataFrame, total: int) -> DataFrame:
    """(block, starts, ends): the runs of bytes of each block that are in repeated strings."""
    buckets = max(1, ceil(total / BUCKET))

    def samples(batches):
        for row in _rows(batches):
            _, _, _, prints, bucket = _of_samples(row, buckets)
            yield _send(row["block"], prints, bucket)

    def left_open(batches):
        for row in _rows(batches):
            starts, places, text, prints, bucket = _of_samples(row, buckets)
            first, last = open_suffixes(starts, places, text, _answer(row["answers"], prints, bucket))
            if len(first):
                data = np.frombuffer(row["body"], np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["block"]]),
                        pa.array([first.astype("<i8").tobytes()]),
                        pa.array([(last - first + 1).astype("<i8").tobytes()]),
                        pa.array([data[_places(first, last + LENGTH - 1)].tobytes()], pa.binary()),
                    ],
                    ["block", "first", "count", "open"],
                )

    ranked = written(_ties(blocks.mapInArrow(samples, SENT)), "sample-ties")
    found = blocks.join(_by_block(ranked), "block").mapInArrow(
        left_open, "block long, first binary, count binary, open binary"
    )
    suffixes = written(found, "open-suffixes")
    # The suffixes left may be more than the samples were: as many buckets a pass as keep them as small.
    left = suffixes.agg(F.sum(F.length("open"))).first()[0] or 0
    deep = max(1, ceil(left / PASSES / (BUCKET // 8)))
    answers = None
    for turn in range(PASSES):

        def one_pass(batches, turn=turn):
            for row in _rows(batches):
                _, prints, own, bucket = _of_suffixes(row, deep)
                yield _send(row["block"], prints[own == turn], bucket[own == turn])

        part = written(_ties(suffixes.mapInArrow(one_pass, SENT)), "suffix-ties")
        part = part.withColumn("bucket", F.col("bucket") + turn * deep)
        answers = part if answers is None else answers.unionByName(part)

    def spans(batches):
        for row in _rows(batches):
            places, prints, turn, bucket = _of_suffixes(row, deep)
            tied = _answer(row["answers"], prints, bucket + turn * deep)
            starts, ends = _covered(places[tied])
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["block"]]), pa.array([starts.tolist()], pa.list_(pa.int64())), pa.array([ends.tolist()], pa.list_(pa.int64()))],
                ["block", "starts", "ends"],
            )

    return suffixes.join(_by_block(answers), "block").mapInArrow(spans, "block long, starts array<long>, ends array<long>")


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a text: what is left of it, and what went."""
    for row in _rows(batches):
        data, bounds = _read(row["body"], row["sizes"])
        starts = np.array(row["starts"] or [], np.int64)
        ends = np.array(row["ends"] or [], np.int64)
        # A run may go from the end of a text to the start of the next: cut it there.
        text = np.searchsorted(bounds, starts, "right") - 1
        gone = np.zeros(len(data) + 1, np.int64)
        np.add.at(gone, starts, 1)
        np.add.at(gone, ends, -1)
        kept = np.cumsum(gone[:-1]) == 0
        n = len(bounds) - 1
        spans = [[] for _ in range(n)]
        for t, s, e in zip(text.tolist(), starts.tolist(), ends.tolist()):
            while s < e:
                stop = min(e, int(bounds[t + 1]))
                if stop > s:
                    spans[t].append({"start": s - int(bounds[t]), "end": stop - int(bounds[t])})
                s, t = stop, t + 1
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(row["ids"], pa.int64()),
                pa.array(np.diff(bounds)),
                pa.array([data[i:j][kept[i:j]].tobytes() for i, j in zip(bounds, bounds[1:])], pa.binary()),
                pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ],
            ["doc_id", "n_bytes", "kept", "spans"],
        )


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, kept, spans): bytes left of every text, and the runs taken out."""
    packed = docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(
        pack, "ids array<long>, sizes binary, body binary"
    )
    blocks = written(packed.withColumn("block", F.monotonically_increasing_id()), "blocks")
    total = blocks.agg(F.sum(F.length("body"))).first()[0] or 0
    spans = written(repeated_spans(blocks, total), "repeated-spans")
    return blocks.join(spans, "block", "left").mapInArrow(
        _unpack, "doc_id long, n_bytes long, kept binary, spans array<struct<start: long, end: long>>"
    )


@query("op6_repeated_substrings")
def op6_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
