"""Post-fusion deduplication and diversity limits."""

import difflib
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom import fixed
from citeloom.functions import text as tx
from citeloom.operators.fusion import candidate_id
from citeloom.session import shared_dir, write_table

#: Characters between two looks at what is still in reach.
_LOOK = 32


def similar(left: str, right: str, *, autojunk: bool = True) -> bool:
    """Near-equal texts; the argument order is (candidate, kept)."""
    if left == right:
        return True
    need = ceil(fixed.NEAR_DUPLICATE_RATIO * (len(left) + len(right)) / 2 - 1e-6)
    if need > min(len(left), len(right)):
        return False
    if longest_common(left, right, need) < need:
        return False
    return difflib.SequenceMatcher(None, left, right, autojunk=autojunk).ratio() >= fixed.NEAR_DUPLICATE_RATIO


@lru_cache(64)
def _places(text: str) -> dict[str, int]:
    """For each character of a text, a number with the bits of its places set."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    found = np.unique(codes)
    bits = np.packbits(codes == found[:, None], axis=1, bitorder="little")
    return {chr(c): int.from_bytes(b.tobytes(), "little") for c, b in zip(found.tolist(), bits)}


def longest_common(left: str, right: str, need: int = 0) -> int:
    """Length of the longest common subsequence, all of ``left`` at once in the bits of one number.

    The matching blocks of a ratio are such a subsequence, so the ratio is at
    most twice this length over the length of both. Where ``need`` is out of
    reach, -1: the part of such a subsequence that lies in the first ``i``
    characters of ``right`` leaves few of them out, and as few of ``left``.
    """
    if need > min(len(left), len(right)):
        return -1
    places, every, spare = _places(left), (1 << len(left)) - 1, len(left) - need
    open_ = every
    for i, character in enumerate(right, 1):
        hit = open_ & places.get(character, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & every
        if not i % _LOOK:
            width = min(i + spare, len(left))
            if width - (open_ & ((1 << width) - 1)).bit_count() < i - (len(right) - need):
                return -1
    return len(left) - open_.bit_count()


def _near_rows(autojunk: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(batch["left"].to_pylist(), batch["right"].to_pylist())
            near = pa.array([similar(a, b, autojunk=autojunk) for a, b in pairs], pa.bool_())
            yield batch.select(["candidate", "kept"]).filter(near)

    return run


def near_keys(lists: DataFrame, *, autojunk: bool = True) -> DataFrame:
    """(candidate, kept): digests of different keys that are near, of the pairs met in ``lists``.

    ``lists``: query_id, rank, content_hash, key, digest. A pair is decided
    once, in however many lists it stands. Lengths decide most of them here, and
    the longest common subsequence most others before the ratio is worked out.
    """
    texts = lists.groupBy("digest").agg(F.min("key").alias("key"))
    open_pairs = _pairs(lists).where("candidate <> kept").select("candidate", "kept").distinct()
    met = open_pairs.join(texts.select(F.col("digest").alias("candidate"), F.col("key").alias("left")), "candidate")
    met = met.join(texts.select(F.col("digest").alias("kept"), F.col("key").alias("right")), "kept")
    # A pair is heavy work for its size: a fixed number of partitions keeps them over all cores. (A filter would be
    # moved before the repartitioning.)
    cores = lists.sparkSession.sparkContext.defaultParallelism
    met = met.select("candidate", "kept", "left", "right").repartition(cores, "candidate", "kept")
    return met.mapInArrow(_near_rows(autojunk), "candidate string, kept string")


def lengths_allow(left: Column, right: Column) -> Column:
    """Texts of these lengths can be near."""
    return 2 * F.least(left, right) >= fixed.NEAR_DUPLICATE_RATIO * (left + right) - 1e-6


def _pairs(lists: DataFrame) -> DataFrame:
    """(query_id, rank, with_rank, candidate, kept): every hit with the earlier ones of its list whose length allows it."""
    narrow = lists.select("query_id", "rank", "content_hash", "digest", F.length("key").alias("size"))
    ours, kept = narrow.alias("a"), narrow.alias("b")
    pairs = ours.join(
        kept,
        F.expr("a.query_id = b.query_id AND b.rank < a.rank AND a.content_hash <> b.content_hash")
        & lengths_allow(F.col("a.size"), F.col("b.size")),
    )
    return pairs.select(
        "a.query_id", "a.rank", F.col("b.rank").alias("with_rank"), F.col("a.digest").alias("candidate"), F.col("b.digest").alias("kept")
    )


def near_pairs(hits: DataFrame, *, autojunk: bool = True) -> DataFrame:
    """(query_id, rank, near): for a hit, the earlier ranks of its question with a near text.

    Pairs are those of one question's list (at most 40 hits), by digest of what
    is compared; texts meet only in :func:`near_keys`.
    """
    key = tx.near_text_key(F.col("text"))
    lists = hits.select("query_id", "rank", "content_hash", key.alias("key")).withColumn("digest", F.sha2("key", 256))
    spark = hits.sparkSession
    lists = write_table(lists, shared_dir(spark, "near-lists"))
    # A row a near pair: far fewer than hits, and read for every list.
    decided = write_table(near_keys(lists, autojunk=autojunk), shared_dir(spark, "near-keys")).withColumn("decided", F.lit(True))
    pairs = _pairs(lists).join(decided, ["candidate", "kept"], "left")
    near = pairs.where((F.col("candidate") == F.col("kept")) | F.col("decided"))
    return near.groupBy("query_id", "rank").agg(F.collect_list("with_rank").alias("near"))


def _decided(held: Column, hit: Column, limit: int) -> Column:
    """The fold's next state: kept hits, and the decisions so far."""
    kept = held["kept"]

    def first(test) -> Column:
        return F.try_element_at(F.filter(kept, test), F.lit(1))["candidate_id"]

    copy = first(lambda k: k["content_hash"] == hit["content_hash"])
    alike = first(lambda k: F.array_contains(hit["near"], k["rank"]))
    under = F.filter(kept, lambda k: k["heading"] == hit["heading"])
    full = F.when(F.size(under) >= fixed.MAX_PER_HEADING, F.get(under, F.lit(0))["candidate_id"])
    reason = (
        F.when(copy.isNotNull(), "exact_duplicate")
        .when(alike.isNotNull(), "near_duplicate")
        .when(full.isNotNull(), "heading_cap")
        .when(F.size(kept) >= limit, "top20_truncation")
    )
    entry = F.struct(
        hit["rank"].alias("rank"), hit["candidate_id"].alias("candidate_id"), hit["content_hash"].alias("content_hash"), hit["heading"].alias("heading")
    )
    decision = F.struct(
        hit["version_id"].alias("version_id"),
        hit["chunk_id"].alias("chunk_id"),
        hit["candidate_id"].alias("candidate_id"),
        hit["rank"].alias("rank"),
        reason.alias("reason"),
        F.coalesce(copy, alike, full).alias("kept_candidate_id"),
    )
    return F.struct(
        F.when(reason.isNull(), F.concat(kept, F.array(entry))).otherwise(kept).alias("kept"),
        F.concat(held["done"], F.array(decision)).alias("done"),
    )


_START = (
    "named_struct('kept', cast(array() as array<struct<rank:int,candidate_id:string,content_hash:string,"
    "heading:struct<file_name:string,heading_path:array<string>>>>), 'done', cast(array() as array<struct<version_id:string,"
    "chunk_id:string,candidate_id:string,rank:int,reason:string,kept_candidate_id:string>>))"
)


def deduplicate(
    hits: DataFrame,
    *,
    limit: int = fixed.MAX_CANDIDATES,
    near_text: bool = True,
    autojunk: bool = True,
) -> DataFrame:
    """Keep-or-drop decision of every hit, in rank order.

    A hit is dropped when its hash was kept, when its text is near a kept one,
    when its heading already has two, or when ``limit`` are kept; a dropped
    hit changes nothing for later ones. The decisions are a fold over the
    question's candidate list, an array of at most 40 hits; which texts are
    near is known before. ``near_text=False`` leaves that test out.
    """
    fixed.bounded(limit)
    ranked = hits.withColumn("rank", F.col("rank").cast("int"))
    none = F.expr("cast(array() as array<int>)")
    if near_text:
        ranked = ranked.join(near_pairs(ranked, autojunk=autojunk), ["query_id", "rank"], "left")
        ranked = ranked.withColumn("near", F.coalesce("near", none))
    else:
        ranked = ranked.withColumn("near", none)
    hit = F.struct(
        "rank",
        "version_id",
        "chunk_id",
        candidate_id().alias("candidate_id"),
        "content_hash",
        F.struct("file_name", "heading_path").alias("heading"),
        "near",
    )
    lists = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(hit)).alias("hits"))
    folded = F.aggregate("hits", F.expr(_START), lambda held, h: _decided(held, h, limit), lambda held: held["done"])
    rows = lists.select("query_id", F.inline(folded))
    kept = F.col("reason").isNull()
    place = F.sum(F.when(kept, 1).otherwise(0)).over(Window.partitionBy("query_id").orderBy("rank"))
    return rows.select(
        "query_id",
        "version_id",
        "chunk_id",
        "candidate_id",
        "rank",
        kept.alias("kept"),
        F.when(kept, place).cast("int").alias("kept_rank"),
        "reason",
        "kept_candidate_id",
    )


def without_dedup(hits: DataFrame, *, limit: int = fixed.MAX_CANDIDATES) -> DataFrame:
    """The audit form: rank decides alone, and only the limit drops."""
    kept = F.col("rank") <= limit
    return hits.select(
        "query_id",
        "version_id",
        "chunk_id",
        candidate_id().alias("candidate_id"),
        F.col("rank").cast("int").alias("rank"),
        kept.alias("kept"),
        F.when(kept, F.col("rank")).cast("int").alias("kept_rank"),
        F.when(~kept, "top20_truncation").alias("reason"),
        F.lit(None).cast("string").alias("kept_candidate_id"),
    )


def heading_diversity(hits: DataFrame, *, limit: int = fixed.MAX_CANDIDATES) -> DataFrame:
    """The window form for hash-unique hits without the near-text test.

    After fusion hashes are unique, so "two per heading, then the limit" is
    two row numbers over the same question partition.
    """
    per_heading = Window.partitionBy("query_id", "file_name", "heading_path").orderBy("rank")
    by_rank = Window.partitionBy("query_id").orderBy("rank")
    fits = F.col("nth_of_heading") <= fixed.MAX_PER_HEADING
    place = F.sum(F.when(fits, 1).otherwise(0)).over(by_rank)
    kept = fits & (F.col("place") <= limit)
    return (
        hits.withColumn("nth_of_heading", F.row_number().over(per_heading))
        .withColumn("first_of_heading", F.first(candidate_id()).over(per_heading))
        .withColumn("place", place)
        .select(
            "query_id",
            "version_id",
            "chunk_id",
            candidate_id().alias("candidate_id"),
            F.col("rank").cast("int").alias("rank"),
            kept.alias("kept"),
            F.when(kept, F.col("place")).cast("int").alias("kept_rank"),
            F.when(~fits, "heading_cap").when(~kept, "top20_truncation").alias("reason"),
            F.when(~fits, F.col("first_of_heading")).alias("kept_candidate_id"),
        )
    )


def retained(hits: DataFrame, decisions: DataFrame) -> DataFrame:
    """The kept hits with their new rank; both sides are keyed by question."""
    keys = ["query_id", "version_id", "chunk_id"]
    kept = decisions.where("kept").select(*keys, F.col("kept_rank").alias("new_rank"))
    return hits.join(kept, keys).withColumn("rank", F.col("new_rank")).drop("new_rank")


def drop_facts(decisions: DataFrame) -> DataFrame:
    return decisions.where(~F.col("kept")).select(
        "query_id",
        "candidate_id",
        "reason",
        F.lit("post_rrf").alias("stage"),
        "kept_candidate_id",
        F.col("chunk_id").alias("source_id"),
        "version_id",
    )
