"""The trie of all conversations, built as a z-fast trie.

A node is a sequence of first turns; its prefix key is a rolling hash of 127
bits over the digests of its turns. Only compacted nodes are kept: ends of
conversations and branches. Each is stored under its handle, the prefix as long
as the 2-fattest number of its edge (the one number between its parent's depth
and its own that is divisible by the largest power of two).

Conversations are inserted in batches. A batch first finds the exit node of
each conversation by fat binary search: at level i, from the highest down, the
one multiple of 2^i left in the search interval is looked up among the handles;
a hit moves the interval's start to the depth of the node found, a miss its end
before the handle. A level touches only prefixes of its own depths, so all
levels together read each prefix once. The exit edge then tells how far the
conversation follows the trie. New compacted nodes are where conversations leave
it, where they end, and where those of a batch part from each other beyond it;
edges, and with them handles, follow. At the end edges are expanded to one row
per depth, with sums over subtrees: a node's own value is booked on its smallest
member at its depth, so that a subtree's sum is a suffix sum along members.

Prefix keys are made by sorting turns over all tasks; a conversation with a large
share of all turns spans several, and its pieces are shifted by what comes before
(the driver gets one row per task for that). All tables between steps are written.

Defined cases: rows with a null id belong to no conversation; null roles and
texts are empty; rows go by turn, nulls first, then by SHA-256 of length of role,
role and text; equal rows all count; an empty table has no nodes, not even a
root; other columns are not read.
"""

from collections.abc import Callable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.llm.ordered import in_order
from citeloom.llm.registry import query, table
from citeloom.llm.written import written

MODULUS = (1 << 127) - 1
BASE = 0x5BD1E9955BD1E9955BD1E9955BD1E995 % MODULUS
#: Shares of all conversations, in sixteenths, that are inserted together.
BATCHES = ((0, 1), (1, 4), (4, 16))
HEADS = 8
NO_ENDS = sha256(b"").hexdigest()

PREFIXES = "conv_id long, depth int, key binary, parent binary, size long, total long, part int, opening boolean, first_conv long"
PREFIXES_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("depth", pa.int32()), ("key", pa.binary()), ("parent", pa.binary())]
    + [("size", pa.int64()), ("total", pa.int64()), ("part", pa.int32()), ("opening", pa.bool_()), ("first_conv", pa.int64())]
)


def _key(value: int) -> bytes:
    return value.to_bytes(16, "big")


def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted turns to prefix keys within a task, and at last one row (first_conv not null) on where the task ends."""
    conv = first = part = None
    depth, value, total, opening = 0, 0, 0, True
    for batch in batches:
        out = []
        for conv_id, digest, size, part in zip(*(batch[n].to_pylist() for n in ("conv_id", "digest", "size", "part"))):
            if conv_id != conv:
                opening, first = first is None, conv_id if first is None else first
                conv, depth, value, total = conv_id, 0, 0, 0
            before = _key(value)
            value = (value * BASE + int.from_bytes(digest[:16], "big")) % MODULUS
            depth, total = depth + 1, total + size
            out.append((conv_id, depth, _key(value), before, size, total, part, opening, None))
        if out:
            yield _batch(out)
    if first is not None:
        yield _batch([(conv, depth, _key(value), None, 0, total, part, opening, first)])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), PREFIXES_ARROW)], schema=PREFIXES_ARROW)


def shifted(before: dict[int, tuple[int, int, int]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Prefixes of a task's first conversation, moved behind the (depth, hash, total) it has in earlier tasks."""

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for conv_id, depth, key, parent, size, total, part, opening, first in zip(*(c.to_pylist() for c in batch.columns)):
                n, value, held = before.get(part, (0, 0, 0))
                old = value * pow(BASE, depth - 1, MODULUS)
                parent = _key((old + int.from_bytes(parent, "big")) % MODULUS)
                key = _key((old * BASE + int.from_bytes(key, "big")) % MODULUS)
                out.append((conv_id, n + depth, key, parent, size, held + total, part, opening, first))
            if out:
                yield _batch(out)

    return move


def carried(borders: list) -> dict[int, tuple[int, int, int]]:
    """What each task's first conversation has in earlier tasks, from one border row a task."""
    held: dict[int, tuple[int, int, int]] = {}
    conv, state = None, (0, 0, 0)
    for b in sorted(borders, key=lambda b: b.part):
        goes_on = conv is not None and b.first_conv == conv
        if goes_on:
            held[b.part] = state
        own = (b.depth, int.from_bytes(b.key, "big"), b.total)
        if b.opening and goes_on:
            n, value, total = state
            own = (n + own[0], (value * pow(BASE, own[0], MODULUS) + own[1]) % MODULUS, total + own[2])
        conv, state = b.conv_id, own
    return held


def prefix_table(rows: DataFrame, *order: str) -> DataFrame:
    """(conv_id, depth, key, parent, size, total) of rows (conv_id, digest, size) in ``order``, written."""
    local = in_order(rows, "conv_id", *order).select("conv_id", "digest", "size", "part").mapInArrow(prefixes, PREFIXES)
    local = written(local, "trie-local")
    before = carried(local.filter("first_conv IS NOT NULL").collect())
    turns = local.filter("first_conv IS NULL")
    moved = turns.filter("opening").mapInArrow(shifted(before), PREFIXES)
    every = turns.filter("NOT opening").unionByName(moved)
    return written(every.select("conv_id", "depth", "key", "parent", "size", "total"), "trie-prefixes")


def fattest(low: Column, high: Column) -> Column:
    """The number in (low, high] that is divisible by the largest power of two."""
    bits = F.length(F.bin(low.bitwiseXOR(high))) - 1
    return F.call_function("shiftleft", F.call_function("shiftright", high, bits), bits)


def relinked(nodes: DataFrame, table: DataFrame) -> DataFrame:
    """Compacted nodes (depth, key, rep) with their edges: low, handle, handle_key, turn_key. Written.

    ``low`` is the parent's depth, ``turn_key`` the prefix one turn longer than the parent.
    """
    own = table.join(nodes.select(F.col("rep").alias("conv_id")).distinct(), "conv_id", "left_semi")
    along = Window.partitionBy("conv_id").orderBy("depth")
    path = own.join(nodes, ["depth", "key"]).select("conv_id", "depth", "key", "rep")
    edges = path.withColumn("low", F.coalesce(F.lag("depth").over(along), F.lit(0))).filter("conv_id = rep")
    edges = edges.withColumn("handle", fattest(F.col("low"), F.col("depth"))).drop("conv_id")
    at = own.select(F.col("conv_id").alias("rep"), F.col("depth").alias("at"), F.col("key").alias("found"))
    asked = edges.select("rep", "depth", "key", F.explode(F.array_distinct(F.array("handle", F.col("low") + 1))).alias("at"))
    keys = asked.join(at, ["rep", "at"]).groupBy("depth", "key").agg(F.map_from_entries(F.collect_list(F.struct("at", "found"))).alias("keys"))
    linked = edges.join(keys, ["depth", "key"])
    return written(
        linked.select(
            "depth", "key", "rep", "low", "handle",
            F.element_at("keys", F.col("handle")).alias("handle_key"),
            F.element_at("keys", F.col("low") + 1).alias("turn_key"),
        ),
        "trie-nodes",
    )


def exits(nodes: DataFrame, own: DataFrame, ends: DataFrame, table: DataFrame, longest: int) -> DataFrame:
    """(conv_id, n, m): conversations ``ends`` follow the trie for ``m`` of their ``n`` turns.

    ``own`` are their prefixes; the interval (a, b] holds the depths still possible.
    """
    found = ends.select(
        "conv_id", "n", F.lit(0).alias("a"), F.col("n").alias("b"),
        F.lit(None).cast("binary").alias("v_key"), F.lit(0).alias("v_low"), F.lit(None).cast("long").alias("v_rep"),
    )
    for i in reversed(range(longest.bit_length())):
        step = 1 << i
        probe = (F.col("b") - F.col("b") % step).cast("int")
        found = found.withColumn("f", F.when(probe > F.col("a"), probe))
        keys = own.filter(F.col("depth") % (2 * step) == step).select("conv_id", F.col("depth").alias("f"), F.col("key").alias("probe_key"))
        handles = nodes.filter(F.col("handle") % (2 * step) == step).select(
            F.col("handle").alias("f"), F.col("handle_key").alias("probe_key"),
            F.col("depth").alias("e"), F.col("key").alias("e_key"), F.col("low").alias("e_low"), F.col("rep").alias("e_rep"),
        )
        hits = keys.join(handles, ["f", "probe_key"])
        found = found.join(hits.drop("probe_key"), ["conv_id", "f"], "left")
        hit, miss = F.col("e").isNotNull(), F.col("f").isNotNull() & F.col("e").isNull()
        found = found.select(
            "conv_id", "n",
            F.when(hit, F.col("e")).otherwise(F.col("a")).alias("a"),
            F.when(miss, F.col("f") - 1).otherwise(F.col("b")).cast("int").alias("b"),
            *[F.when(hit, F.col(f"e_{x}")).otherwise(F.col(f"v_{x}")).alias(f"v_{x}") for x in ("key", "low", "rep")],
        )
    found = written(found, "trie-exits")
    # A conversation that has all of the node found leaves the trie on the edge of its next turn, if there is one.
    here = own.select("conv_id", F.col("depth").alias("a"), F.col("key").alias("a_key"))
    found = found.join(here, ["conv_id", "a"], "left")
    passed = F.col("v_key").isNull() | F.coalesce(F.col("a_key") == F.col("v_key"), F.lit(False))
    found = found.withColumn("next", F.when(passed, F.col("a") + 1))
    then = own.select("conv_id", F.col("depth").alias("next"), F.col("key").alias("next_key"))
    edges = nodes.select(
        (F.col("low") + 1).alias("next"), F.col("turn_key").alias("next_key"), F.col("depth").alias("w_high"), F.col("rep").alias("w_rep")
    )
    met = found.join(then.join(edges, ["next", "next_key"]), ["conv_id", "next"], "left")
    low = F.when(F.col("next").isNotNull(), F.col("a")).otherwise(F.col("v_low"))
    high = F.when(F.col("next").isNull(), F.col("a")).otherwise(F.col("w_high"))
    edge = met.select(
        "conv_id", "n", low.alias("low"), F.least(high, F.col("n")).alias("high"),
        F.when(F.col("next").isNull(), F.col("v_rep")).otherwise(F.col("w_rep")).alias("rep"),
    )
    edge = written(edge, "trie-edges")
    walked = (
        own.select("conv_id", "depth", "key")
        .join(edge.filter("rep IS NOT NULL"), "conv_id")
        .filter("depth > low AND depth <= high")
        .select("conv_id", "depth", "key", "rep")
    )
    same = walked.join(table.select(F.col("conv_id").alias("rep"), "depth", "key"), ["rep", "depth", "key"])
    reach = same.groupBy("conv_id").agg(F.max("depth").alias("m"))
    return written(edge.join(reach, "conv_id", "left").select("conv_id", "n", F.coalesce("m", "low").alias("m")), "trie-matched")


def inserted(nodes: DataFrame | None, own: DataFrame, matched: DataFrame) -> DataFrame:
    """(depth, key, rep) of all compacted nodes once the conversations ``matched`` are in."""
    rows = own.select("conv_id", "depth", "key", "parent").join(matched, "conv_id").filter("depth >= m")
    marked = rows.filter("depth = m OR depth = n").select("depth", "key", "conv_id")
    # Within the batch and beyond the trie: a prefix with two different next ones.
    parted = (
        rows.filter("depth > m + 1")
        .groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("key"))
        .agg(F.min("key").alias("least"), F.max("key").alias("most"), F.min("conv_id").alias("conv_id"))
        .filter("least <> most")
        .select("depth", "key", "conv_id")
    )
    every = marked.unionByName(parted).withColumnRenamed("conv_id", "rep")
    if nodes is not None:
        every = every.unionByName(nodes.select("depth", "key", "rep"))
    return every.groupBy("depth", "key").agg(F.min("rep").alias("rep"))


def compacted(table: DataFrame, ends: DataFrame) -> DataFrame:
    """(depth, key, rep) of the compacted nodes of all conversations, inserted batch by batch. Written."""
    longest = ends.agg(F.max("n")).first()[0] or 0
    place = F.pmod(F.xxhash64("conv_id"), F.lit(BATCHES[-1][1]))
    nodes = None
    for low, high in BATCHES:
        part = (place >= low) & (place < high)
        own, of = table.filter(part), ends.filter(part & (F.col("n") > 0))
        if nodes is None:
            matched = of.select("conv_id", "n", F.lit(0).alias("m"))
        else:
            matched = exits(relinked(nodes, table), own, of, table, longest)
        nodes = written(inserted(nodes, own, matched), "trie-compacted")
    return nodes


def ends_digests(ended: DataFrame) -> DataFrame:
    """(depth, key, ends_sha256) of (depth, key, conv_id): ids in order stream through one digest a node."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha, out = None, sha256(), []

        def batch() -> pa.RecordBatch:
            depths, keys, found = zip(*out)
            return pa.RecordBatch.from_arrays(
                [pa.array(depths, pa.int32()), pa.array(keys, pa.binary()), pa.array(found, pa.string())], ["depth", "key", "ends_sha256"]
            )

        for rows in batches:
            for depth, key, conv_id in zip(*(rows[n].to_pylist() for n in ("depth", "key", "conv_id"))):
                if (depth, key) != node:
                    if node is not None:
                        out.append((*node, sha.hexdigest()))
                    node, sha = (depth, key), sha256(str(conv_id).encode())
                else:
                    sha.update(f",{conv_id}".encode())
            if len(out) > 5_000:
                yield batch()
                out = []
        if node is not None:
            out.append((*node, sha.hexdigest()))
            yield batch()

    rows = ended.select("depth", "key", "conv_id").repartition("depth", "key").sortWithinPartitions("depth", "key", "conv_id")
    return rows.mapInArrow(digest, "depth int, key binary, ends_sha256 string")


def node_rows(table: DataFrame, ends: DataFrame) -> DataFrame:
    """One row per node of the trie of the prefixes ``table``, whose conversations have ``ends`` (conv_id, n)."""
    nodes = compacted(table, ends)
    along = Window.partitionBy("conv_id").orderBy("depth")
    path = table.join(nodes.select("depth", "key"), ["depth", "key"]).select(
        "conv_id", "depth", "key", "total",
        F.coalesce(F.lag("depth").over(along), F.lit(0)).alias("low"),
        F.coalesce(F.lag("key").over(along), F.lit(b"")).alias("low_key"),
        F.coalesce(F.lag("total").over(along), F.lit(0).cast("long")).alias("low_total"),
    )
    path = written(path, "trie-paths")
    # All members of a node agree on everything but themselves.
    known = path.groupBy("depth", "key").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("rep"),
        *[F.min(c).alias(c) for c in ("total", "low", "low_key", "low_total")],
    )
    known = written(known, "trie-known")
    children = known.groupBy(F.col("low").alias("depth"), F.col("low_key").alias("key")).agg(F.count(F.lit(1)).alias("n_children"))
    value = (F.col("n_convs") - 1) * (F.col("total") - F.col("low_total"))
    booked = known.join(children, ["depth", "key"], "left").select(
        F.col("rep").alias("conv_id"), "depth", value.alias("value"), F.col("n_children").isNull().cast("long").alias("leaf")
    )
    below = along.orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    zero = F.lit(0).cast("long")
    sums = path.join(booked, ["conv_id", "depth"], "left").select(
        "depth", "key",
        F.sum(F.coalesce("value", zero)).over(below).alias("saved"), F.sum(F.coalesce("leaf", zero)).over(below).alias("leaves"),
    )
    sums = sums.groupBy("depth", "key").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("n_leaves"))
    root = (
        ends.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("rep"))
        .crossJoin(booked.agg(F.coalesce(F.sum("value"), zero).alias("saved"), F.greatest(F.coalesce(F.sum("leaf"), zero), zero + 1).alias("n_leaves")))
        .filter("n_convs > 0")
        .select(
            F.lit(0).alias("depth"), F.lit(b"").alias("key"), "rep", "n_convs", "saved", "n_leaves",
            F.lit(-1).alias("low"), F.lit(None).cast("binary").alias("low_key"), zero.alias("low_total"),
        )
    )
    every = known.join(sums, ["depth", "key"]).drop("total").unionByName(root)
    ended = table.join(ends, "conv_id").filter("depth = n").select("depth", "key", "conv_id")
    ended = ended.unionByName(ends.filter("n = 0").select(F.col("n").alias("depth"), F.lit(b"").alias("key"), "conv_id"))
    every = every.join(children, ["depth", "key"], "left").join(ends_digests(ended), ["depth", "key"], "left")
    above = every.select(F.col("depth").alias("low"), F.col("key").alias("low_key"), F.col("rep").alias("above"))
    every = written(every.join(above, ["low", "low_key"], "left"), "trie-summed")
    # Edges are expanded along the smallest member of the node they lead to.
    spread = every.filter("depth > 0").withColumn("high", F.col("depth")).withColumn("depth", F.explode(F.sequence(F.col("low") + 1, F.col("high"))))
    spread = spread.withColumnRenamed("rep", "conv_id").drop("key")
    turns = spread.join(table.select("conv_id", "depth", "size", "total"), ["conv_id", "depth"])
    whole = F.col("depth") == F.col("high")
    over = (F.col("n_convs") - 1) * (F.col("total") - F.col("size") - F.col("low_total"))
    rows = turns.select(
        "conv_id",
        F.col("depth").cast("long"),
        F.when(F.col("depth") == F.col("low") + 1, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        F.when(whole, F.coalesce("n_children", zero)).otherwise(zero + 1).alias("n_children"),
        "n_leaves",
        (F.col("saved") - over).alias("saved_tokens"),
        F.when(whole, F.coalesce("ends_sha256", F.lit(NO_ENDS))).otherwise(NO_ENDS).alias("ends_sha256"),
    )
    top = every.filter("depth = 0").select(
        F.col("rep").alias("conv_id"), F.col("depth").cast("long"), F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", zero).alias("n_children"), "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )
    return rows.unionByName(top)


def entries(conversations: DataFrame) -> DataFrame:
    """(conv_id, known, turn, digest, size, id) of all turns; ``id`` tells equal rows apart. Written."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    return written(
        conversations.filter("conv_id IS NOT NULL").select(
            F.col("conv_id").cast("long"),
            F.col("turn").isNotNull().alias("known"),
            F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
            F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
            F.octet_length(text).cast("long").alias("size"),
            F.monotonically_increasing_id().alias("id"),
        ),
        "trie-turns",
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations as they are."""
    turns = entries(conversations)
    table = prefix_table(turns, "known", "turn", "digest", "id")
    ends = written(table.groupBy("conv_id").agg(F.max("depth").alias("n")), "trie-ends")
    return node_rows(table, ends)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of every conversation after the head of its family's first one, and all ids.

    Only the first ``HEADS`` turns of a conversation are numbered; where its own
    turns go on is told by the last one left out.
    """
    order = Window.partitionBy("conv_id").orderBy("known", "turn", "digest", "id")
    heads = turns.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= HEADS)
    heads = written(heads, "trie-heads")
    ids = turns.select("conv_id").distinct()
    ids = ids.withColumn("h", (F.crc32(F.col("conv_id").cast("string")) % (HEADS + 1)).cast("int"))
    first = F.col("conv_id") - F.col("conv_id") % 5
    taken = (
        ids.select(F.col("conv_id").alias("of"), "h", first.alias("conv_id"))
        .join(heads, "conv_id")
        .filter("place <= h")
        .select(F.col("of").alias("conv_id"), F.lit(0).alias("own"), "known", "turn", "digest", "size", "id")
    )
    mark = F.struct("known", "turn", "digest", "id")
    cut = heads.select("conv_id", F.col("place").alias("h"), mark.alias("cut"))
    cuts = ids.join(cut, ["conv_id", "h"], "left").filter("h = 0 OR cut IS NOT NULL")
    rest = (
        turns.join(cuts, "conv_id")
        .filter((F.col("h") == 0) | (mark > F.col("cut")))
        .select("conv_id", F.lit(1).alias("own"), "known", "turn", "digest", "size", "id")
    )
    return taken.unionByName(rest), ids.select("conv_id")


SQL = """
WITH RECURSIVE t AS (
  SELECT conv_id, coalesce(text, '') AS text, coalesce(role, '') AS role, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), ids AS (
  SELECT conv_id, conv_id::VARCHAR AS name FROM (SELECT DISTINCT conv_id FROM t)
), h AS (
  SELECT conv_id, xor(list_reduce(
      list_transform(range(1, length(name) + 1), lambda i: ascii(name[i])::BIGINT),
      lambda crc, b: list_reduce(range(0, 8), lambda v, k: xor(v >> 1, CASE WHEN v & 1 = 1 THEN 3988292384 ELSE 0 END), xor(crc, b)),
      4294967295), 4294967295) % 9 AS h
  FROM ids
), built AS (
  SELECT h.conv_id, 0 AS own, place, role, text FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 5 AND place <= h
  UNION ALL SELECT h.conv_id, 1, place, role, text FROM h JOIN t ON t.conv_id = h.conv_id AND place > h
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, place) AS depth, sha256(length(role) || ':' || role || text) AS turn,
         octet_length(encode(text)) AS size FROM built
), paths AS (
  SELECT conv_id, 0::BIGINT AS depth, '' AS node, NULL::VARCHAR AS above, 0::BIGINT AS size FROM ids
  UNION ALL
  SELECT p.conv_id, t.depth, sha256(p.node || t.turn), p.node, t.size FROM paths p JOIN turns t ON t.conv_id = p.conv_id AND t.depth = p.depth + 1
), ends AS (
  SELECT node, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS members
  FROM (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS is_end FROM paths) WHERE is_end GROUP BY node
), nodes AS (
  SELECT node, any_value(above) AS above, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size FROM paths GROUP BY node, depth
), children AS (SELECT above AS node, count(*) AS n_children FROM nodes WHERE above IS NOT NULL GROUP BY above
), sums AS (
  SELECT p.node, sum((x.n_convs - 1) * x.size)::BIGINT AS saved_tokens, count(*) FILTER (c.node IS NULL) AS n_leaves
  FROM paths p JOIN nodes x ON x.conv_id = p.conv_id AND x.depth >= p.depth LEFT JOIN children c ON c.node = x.node GROUP BY p.node
)
SELECT n.conv_id, n.depth, a.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens,
       sha256(coalesce(members, '')) AS ends_sha256
FROM nodes n JOIN sums USING (node) LEFT JOIN nodes a ON a.node = n.above LEFT JOIN children c ON c.node = n.node LEFT JOIN ends e ON e.node = n.node
"""


@query("op12_prefix_trie", SQL)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, ids = rebuilt(entries(table(spark, sf_dir, "conversations")))
    keys = prefix_table(turns, "own", "known", "turn", "digest", "id")
    lengths = keys.groupBy("conv_id").agg(F.max("depth").alias("n"))
    ends = ids.join(lengths, "conv_id", "left").select("conv_id", F.coalesce("n", F.lit(0)).alias("n"))
    return node_rows(keys, written(ends, "trie-ends"))
