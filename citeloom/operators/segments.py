"""Exact top-k scoring of every question against every chunk, without pairs.

A join of questions and postings would write one row per matching
(question, chunk) pair. Here chunks are packed, partition by partition, into
segments (a few thousand chunks each, counted features in columnar form);
questions are packed into blocks of a few hundred. A segment meets a block in
one task, which scores them in memory and passes on only rows that can still
reach the top k. So the shuffle carries about ``k`` rows per question and
task, whatever the number of chunks, and memory is bounded by one segment
times one block.

Segments of counted features are inverted: postings by feature, in runs of
``RUN`` chunks, each run with the largest weight in it. A question's sum of such
bounds is what a run can reach at best. The most promising runs are scored
first; runs that can't reach the k-th best score by then are never read. The
result is exact. Segments are worth keeping: nothing in them depends on the
questions, and searching them splits no text.
"""

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.session import shared_dir, write_table

SEGMENT_ROWS = 4096
BLOCK_QUERIES = 512
# Questions have at most 1000 characters, so this many are a bounded broadcast.
ROUND_BLOCKS = 8
#: A dense block holds so many times the questions, each one vector, and scores so many at once.
DENSE_BLOCKS = 8
DENSE_QUERIES = 512
SCORE_DIGITS = 9
#: Chunks under one bound, and how many runs are scored before bounds are tested.
RUN = 64
FIRST_RUNS = 2
#: About so many postings are scored at once.
POSTINGS = 1 << 20
#: A segment is a row of megabytes. Parquet looks at its sizes every 100 rows, and a reader takes a row group at once: left
#: alone, tasks that write or read hundreds of segments hold them all. They are compressed already.
WIDE_ROWS = {
    "compression": "none",
    "parquet.enable.dictionary": "false",
    "parquet.page.row.count.limit": "1",
    "parquet.page.size.row.check.min": "1",
    "parquet.page.size.row.check.max": "1",
    "parquet.block.row.count.limit": "8",
}


def build_segments(
    chunks: DataFrame,
    fields: dict[str, float],
    weighting: str,
    *,
    rows_per_segment: int = SEGMENT_ROWS,
) -> DataFrame:
    """Pack chunks into segments; no shuffle, and worth writing once as Parquet.

    ``chunks`` has ``version_id``, ``chunk_id``, ``profiles`` (the eligibility
    profiles that admit the chunk) and one array column per field. Weights:
    ``log_tf`` gives boost * (1 + ln tf) summed over fields; ``cosine`` gives
    unit-length counts; ``dense`` takes the single field as a vector. Beside
    each segment stands how many of its chunks every profile admits.
    """
    names = list(fields)
    boosts = [float(fields[n]) for n in names]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows_per_segment):
                part = batch.slice(start, rows_per_segment)
                columns = {n: part.column(i) for i, n in enumerate("vcp")}
                if weighting == "dense":
                    columns["x"] = part.column(3)
                else:
                    columns |= _inverted([part.column(3 + i) for i in range(len(names))], boosts, weighting)
                # One row of lists: they differ in length.
                lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in columns.values()]
                segment = pa.RecordBatch.from_arrays(lists, list(columns))
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, segment.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                    writer.write_batch(segment)
                found = pc.list_flatten(columns["p"]).value_counts().to_pylist()
                sizes = [{"profile": x["values"], "n": x["counts"]} for x in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                        pa.array([sizes], pa.list_(pa.struct([("profile", pa.int32()), ("n", pa.int64())]))),
                    ],
                    ["segment", "sizes"],
                )

    return chunks.select("version_id", "chunk_id", "profiles", *names).mapInArrow(
        pack, "segment binary, sizes array<struct<profile:int,n:bigint>>"
    )


def write_segments(segments: DataFrame, name: str) -> DataFrame:
    """Write segments as a table of their own and return a DataFrame that reads it, a few of them at a time."""
    return write_table(segments, shared_dir(segments.sparkSession, name), options=WIDE_ROWS)


def sizes(segments: DataFrame) -> DataFrame:
    """(profile, n): the chunks that each profile admits."""
    return segments.select(F.inline("sizes")).groupBy("profile").agg(F.sum("n").alias("n"))


def frequencies(segments: DataFrame, wanted: DataFrame, *, n_queries: int) -> DataFrame:
    """(profile, f, df): chunks of a profile that have a feature, for the features ``wanted`` (f).

    Counted on the postings of a segment; the shuffle carries one row per
    segment, profile and wanted feature.
    """
    n_blocks = max(1, -(-n_queries // BLOCK_QUERIES))
    blocks = (
        wanted.select(F.col("f").cast("string").alias("f"))
        .distinct()
        .groupBy(F.pmod(F.xxhash64("f"), F.lit(n_blocks)).cast("int").alias("block"))
        .agg(F.collect_list(F.struct("f")).alias("entries"))
    )
    found = _met(segments, blocks, n_blocks, _count, "profile int, f string, df bigint")
    return found.groupBy("profile", "f").agg(F.sum("df").alias("df"))


def top_k(segments: DataFrame, features: DataFrame, k: int, *, n_queries: int) -> DataFrame:
    """The ``k`` best chunks of each question: query_id, version_id, chunk_id, score, rank.

    ``features`` is long: query_id (string), profile (int), f, w - or, for dense
    segments, query_id, profile, x (the vector). Scores are rounded to nine
    digits before ranking; ties go to the smaller version_id, then chunk_id.
    Only scores above zero count for sparse features.
    """
    dense = "x" in features.columns
    n_blocks = max(1, -(-n_queries // (BLOCK_QUERIES * (DENSE_BLOCKS if dense else 1))))
    payload = ["query_id", "profile", "x"] if dense else ["query_id", "profile", F.col("f").cast("string").alias("f"), "w"]
    blocks = (
        features.select(
            F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)).cast("int").alias("block"),
            F.struct(*payload).alias("entry"),
        )
        .groupBy("block")
        .agg(F.collect_list("entry").alias("entries"))
    )
    search = _search(_DenseBlock if dense else _SparseBlock, k)
    found = _met(segments, blocks, n_blocks, search, "query_id string, version_id string, chunk_id string, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "version_id", "chunk_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _met(segments: DataFrame, blocks: DataFrame, n_blocks: int, work, schema: str) -> DataFrame:
    """``work`` on every segment with every block."""
    if n_blocks <= ROUND_BLOCKS:
        return _round(segments, blocks, 0, n_blocks, work, schema)
    # Too many questions to broadcast at once: keep both sides as tables
    # and read the segments once per round. Still exact, still no shuffle
    # of chunks.
    spark = segments.sparkSession
    segments = write_segments(segments, "segments")
    blocks = write_table(blocks, shared_dir(spark, "questions"))
    rounds = range(0, n_blocks, ROUND_BLOCKS)
    return reduce(
        DataFrame.unionByName,
        [_round(segments, blocks, first, min(first + ROUND_BLOCKS, n_blocks), work, schema) for first in rounds],
    )


def _round(segments: DataFrame, blocks: DataFrame, first: int, end: int, work, schema: str) -> DataFrame:
    """Every segment with the blocks ``first`` to ``end - 1``."""
    grid = segments.select("segment", F.explode(F.sequence(F.lit(first), F.lit(end - 1))).alias("block"))
    held = blocks.where(F.col("block").between(first, end - 1))
    return grid.join(F.broadcast(held), "block").select("block", "entries", "segment").mapInArrow(work, schema)


# --- inside the tasks --------------------------------------------------------


def _inverted(lists: list, boosts: list[float], weighting: str) -> dict[str, pa.Array]:
    """Each chunk's features counted and weighted, as postings by feature.

    ``f`` features; ``fr`` end of each one's runs; ``rn`` number of a run, ``rb`` its
    largest weight, ``re`` end of its postings; ``at`` place of a chunk, ``w`` weight.
    """
    rows = len(lists[0])
    parents, values, boost = [], [], []
    for column, factor in zip(lists, boosts):
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        parent = pc.list_parent_indices(column).to_numpy(zero_copy_only=False).astype(np.int64)
        parents.append(parent)
        values.append(pc.list_flatten(column))
        boost.append(np.full(len(parent), factor))
    encoded = pa.concat_arrays(values).dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    parent, factor = np.concatenate(parents), np.concatenate(boost)
    # Count per (feature, chunk, field): fields differ in their boost.
    field = np.concatenate([np.full(len(p), i) for i, p in enumerate(parents)]) if len(lists) > 1 else 0
    key, first, tf = np.unique((codes * rows + parent) * len(lists) + field, return_index=True, return_counts=True)
    cell = key // len(lists)
    if weighting == "log_tf":
        weight = factor[first] * (1.0 + np.log(tf))
        cell, inverse = np.unique(cell, return_inverse=True)
        weight = np.bincount(inverse, weights=weight, minlength=len(cell)) if len(cell) else weight
    else:
        length = np.sqrt(np.bincount(cell % rows, weights=tf.astype(float) ** 2, minlength=rows))
        weight = tf / length[cell % rows]
    feature, at = cell // rows, cell % rows
    runs_of = feature * (rows // RUN + 1) + at // RUN
    starts = np.flatnonzero(np.diff(runs_of, prepend=-1))
    largest = np.maximum.reduceat(weight, starts) if len(starts) else weight
    per_feature = np.bincount(feature[starts], minlength=len(encoded.dictionary))
    return {
        "f": encoded.dictionary.cast(pa.string()),
        "fr": pa.array(np.cumsum(per_feature).astype(np.int32)),
        "rn": pa.array((at[starts] // RUN).astype(np.int32)),
        "rb": pa.array(largest.astype(np.float64)),
        "re": pa.array(np.append(starts[1:], len(cell)).astype(np.int32) if len(starts) else np.zeros(0, np.int32)),
        "at": pa.array(at.astype(np.int32)),
        "w": pa.array(weight.astype(np.float64)),
    }


def _spread(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number of the ranges, and the range it is from."""
    sizes = ends - starts
    owner = np.repeat(np.arange(len(sizes)), sizes)
    first = np.cumsum(sizes) - sizes
    return np.arange(len(owner)) - first[owner] + starts[owner], owner


class _Segment:
    def __init__(self, payload: bytes) -> None:
        batch = pa.ipc.open_stream(payload).read_next_batch()
        self.columns = {n: batch.column(n).flatten() for n in batch.schema.names}
        self.version, self.chunk = self.columns["v"], self.columns["c"]
        self.rows = len(self.version)
        order = pc.sort_indices(
            pa.table({"v": self.version, "c": self.chunk}),
            sort_keys=[("v", "ascending"), ("c", "ascending")],
        ).to_numpy()
        self.order = np.empty(self.rows, np.int64)
        self.order[order] = np.arange(self.rows)
        self._unit = None
        profiles = self.columns["p"]
        self._owner = pc.list_parent_indices(profiles).to_numpy(zero_copy_only=False)
        self._profile = pc.list_flatten(profiles).to_numpy(zero_copy_only=False)

    def profiles(self) -> np.ndarray:
        return np.unique(self._profile)

    def admitted(self, profile: int) -> np.ndarray:
        mask = np.zeros(self.rows, bool)
        mask[self._owner[self._profile == profile]] = True
        return mask

    def unit_rows(self) -> tuple[np.ndarray, np.ndarray]:
        """Its vectors at unit length, in double and in single precision; worked out once."""
        if self._unit is None:
            unit = _unit_rows(self.columns["x"])
            self._unit = unit, unit.astype(np.float32)
        return self._unit

    def numbers(self, name: str) -> np.ndarray:
        return self.columns[name].to_numpy(zero_copy_only=False)

    def runs(self, wanted: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Runs of the wanted features that are here, and which feature each is of."""
        code = pc.index_in(wanted, value_set=self.columns["f"]).fill_null(-1).to_numpy(zero_copy_only=False)
        here = np.flatnonzero(code >= 0)
        ends = self.numbers("fr").astype(np.int64)
        run, which = _spread(np.concatenate([[0], ends])[code[here]], ends[code[here]])
        return run, here[which]

    def postings(self, runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Postings of the runs, and which run each is of."""
        ends = self.numbers("re").astype(np.int64)
        return _spread(np.concatenate([[0], ends])[runs], ends[runs])


class _Best:
    """The running k-th best score of each question of one block in this task."""

    def __init__(self, n_queries: int, k: int) -> None:
        self.k = k
        self.top = np.full((n_queries, k), -np.inf)

    def offer(self, q: int, scores: np.ndarray, usable: np.ndarray, order: np.ndarray) -> np.ndarray:
        """Positions worth passing on: at most k, none below the k-th best so far."""
        at = np.flatnonzero(usable & (scores >= self.top[q].min()))
        if len(at) > self.k:
            at = at[np.lexsort((order[at], -scores[at]))[: self.k]]
        if len(at):
            pool = np.concatenate([self.top[q], scores[at]])
            self.top[q] = np.partition(pool, len(pool) - self.k)[-self.k :]
        return at


def _result(block, segment: _Segment, rows: list) -> pa.RecordBatch | None:
    if not rows:
        return None
    which = np.concatenate([np.broadcast_to(q, len(at)) for q, at, _ in rows])
    at = np.concatenate([a for _, a, _ in rows])
    score = np.concatenate([s for _, _, s in rows])
    take = pa.array(at)
    return pa.RecordBatch.from_arrays(
        [
            block.queries.take(pa.array(which)).cast(pa.string()),
            segment.version.take(take).cast(pa.string()),
            segment.chunk.take(take).cast(pa.string()),
            pa.array(score, pa.float64()),
        ],
        ["query_id", "version_id", "chunk_id", "score"],
    )


class _SparseBlock:
    def __init__(self, entries: pa.StructArray, k: int) -> None:
        ids, self.queries = _codes(entries.field("query_id"))
        f, self.vocabulary = _codes(entries.field("f"))
        w = entries.field("w").to_numpy(zero_copy_only=False)
        self.profile = np.zeros(len(self.queries), np.int64)
        self.profile[ids] = entries.field("profile").to_numpy(zero_copy_only=False)
        order = np.lexsort((ids, f))
        self.asker, self.weight = ids[order], w[order]
        self.edges = np.searchsorted(f[order], np.arange(len(self.vocabulary) + 1))
        self.best = _Best(len(self.queries), k)

    def found(self, segment: _Segment) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(question, places, scores) worth passing on; runs that can't reach the k best aren't read."""
        run, feature = segment.runs(self.vocabulary)
        number, largest = segment.numbers("rn")[run].astype(np.int64), segment.numbers("rb")[run]
        ask, of = _spread(self.edges[feature], self.edges[feature + 1])
        n_runs, n = segment.rows // RUN + 1, len(self.queries)
        cell = self.asker[ask] * n_runs + number[of]
        reach = np.bincount(cell, weights=self.weight[ask] * largest[of], minlength=n * n_runs).reshape(n, n_runs)
        # Sums in another order may differ in their last digits.
        reach += 1e-7
        usable = {p: segment.admitted(p) for p in np.unique(self.profile)}
        out = []
        # So many runs and no more: most may be tied.
        some = min(FIRST_RUNS, n_runs)
        first = np.zeros(reach.shape, bool)
        np.put_along_axis(first, np.argpartition(-reach, some - 1, axis=1)[:, :some], True, axis=1)
        done = np.zeros_like(first)
        for chosen in (first, None):
            if chosen is None:
                chosen = (reach >= self.best.top.min(axis=1)[:, None]) & ~done
            chosen &= reach > 1e-7
            done |= chosen
            take = chosen.ravel()[cell]
            out += self._scored(segment, ask[take], run[of[take]], usable)
        return out

    def _scored(self, segment: _Segment, ask: np.ndarray, run: np.ndarray, usable: dict) -> list:
        """Questions without a score above zero are left out; postings are taken a bounded number at a time."""
        if not len(run):
            return []
        sums = np.zeros(len(self.queries) * segment.rows)
        place_of, weight_of = segment.numbers("at"), segment.numbers("w")
        sizes = np.diff(segment.numbers("re"), prepend=0)[run]
        piece = np.cumsum(sizes, dtype=np.int64) // POSTINGS
        for part in np.split(np.arange(len(run)), np.flatnonzero(np.diff(piece)) + 1):
            posting, of = segment.postings(run[part])
            asked = ask[part][of]
            # One after the other, so that sums don't depend on the pieces.
            np.add.at(sums, self.asker[asked] * segment.rows + place_of[posting], weight_of[posting] * self.weight[asked])
        scores = np.round(sums, SCORE_DIGITS, out=sums).reshape(len(self.queries), segment.rows)
        out = []
        for q in np.flatnonzero(scores.any(axis=1)):
            at = np.flatnonzero(scores[q])
            score = scores[q][at]
            ok = self.best.offer(q, score, usable[self.profile[q]][at] & (score > 0), segment.order[at])
            if len(ok):
                out.append((q, at[ok], score[ok]))
        return out


class _DenseBlock:
    def __init__(self, entries: pa.StructArray, k: int) -> None:
        self.queries = entries.field("query_id")
        self.profile = entries.field("profile").to_numpy(zero_copy_only=False)
        self.matrix = _unit_rows(entries.field("x"))
        self.rough = self.matrix.astype(np.float32)
        self.k, self.top = k, np.full((len(self.queries), k), -np.inf)

    def found(self, segment: _Segment) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(questions, places, scores) worth passing on; only what is in reach by single precision is scored exactly."""
        unit, rough = segment.unit_rows()
        admitted = {p: segment.admitted(p) for p in np.unique(self.profile)}
        parts = []
        for start in range(0, len(self.queries), DENSE_QUERIES):
            rows = slice(start, start + DENSE_QUERIES)
            parts.append(self._reached(rows, rough, admitted))
        q, at = (np.concatenate(x) for x in zip(*parts))
        score = np.concatenate(
            [np.zeros(0)]
            + [np.einsum("ij,ij->i", self.matrix[q[i : i + 65536]], unit[at[i : i + 65536]]) for i in range(0, len(q), 65536)]
        )
        score = np.round(score, SCORE_DIGITS)
        keep = score >= self.top.min(axis=1)[q]
        q, at, score = q[keep], at[keep], score[keep]
        order = np.lexsort((segment.order[at], -score, q))
        q, at, score = q[order], at[order], score[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, "left")
        keep = place < self.k
        q, at, score, place = q[keep], at[keep], score[keep], place[keep]
        if not len(q):
            return []
        touched, row = np.unique(q, return_inverse=True)
        pool = np.full((len(touched), 2 * self.k), -np.inf)
        pool[:, : self.k] = self.top[touched]
        pool[row, self.k + place] = score
        self.top[touched] = np.partition(pool, self.k, axis=1)[:, self.k :]
        return [(q, at, score)]

    def _reached(self, rows: slice, rough: np.ndarray, admitted: dict) -> tuple[np.ndarray, np.ndarray]:
        """(questions, places) that rounding in single precision leaves within the k best."""
        scores = self.rough[rows] @ rough.T
        # Products of unit vectors: each of the sum's terms is rounded once, and the sum after each.
        slack = (rough.shape[1] + 8) * 2.0**-23 + 10.0**-SCORE_DIGITS
        for profile, usable in admitted.items():
            if not usable.all():
                scores[np.ix_(self.profile[rows] == profile, ~usable)] = np.nan
        floor = self.top[rows].min(axis=1)
        new = np.flatnonzero(floor == -np.inf)
        if len(new) and scores.shape[1] >= self.k:
            first = np.where(np.isnan(scores[new]), -np.inf, scores[new])
            floor[new] = np.partition(first, -self.k, axis=1)[:, -self.k]
        q, at = np.nonzero(scores >= (floor - slack)[:, None].astype(np.float32))
        return q + rows.start, at


def _codes(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    encoded = values.dictionary_encode()
    return encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64), encoded.dictionary


def _unit_rows(vectors: pa.ListArray) -> np.ndarray:
    flat = pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(len(vectors), -1)
    length = np.sqrt((matrix**2).sum(axis=1, keepdims=True))
    return matrix / np.where(length == 0, 1.0, length)


def _blocks(batches: Iterator[pa.RecordBatch], make) -> Iterator[tuple]:
    """(block, segment) of every row; a block is made once a task, a segment once for all rows on end that hold it."""
    made: dict[int, object] = {}
    last = segment = None
    for batch in batches:
        ids, entries, payloads = (batch.column(i) for i in range(3))
        for row in range(batch.num_rows):
            key = ids[row].as_py()
            if key not in made:
                made[key] = make(entries.slice(row, 1).flatten())
            payload = payloads[row].as_py()
            if payload != last:
                last, segment = payload, _Segment(payload)
            yield made[key], segment


def _search(make_block, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, segment in _blocks(batches, lambda entries: make_block(entries, k)):
            result = _result(block, segment, block.found(segment))
            if result is not None:
                yield result

    return run


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for wanted, segment in _blocks(batches, lambda entries: entries.field("f")):
        run, feature = segment.runs(wanted)
        posting, of = segment.postings(run)
        feature, at = feature[of], segment.numbers("at")[posting]
        for profile in segment.profiles():
            counts = np.bincount(feature[segment.admitted(profile)[at]], minlength=len(wanted))
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(some), profile, np.int32)),
                    wanted.take(pa.array(some)).cast(pa.string()),
                    pa.array(counts[some].astype(np.int64)),
                ],
                ["profile", "f", "df"],
            )


def admit_all() -> Column:
    """The ``profiles`` column of chunks that every question may see."""
    return F.array(F.lit(0))
