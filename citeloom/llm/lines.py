"""Line dedup by an exact set-similarity join.

A line is the set of its lower-case words (what spaces separate). A line goes
when an earlier line, in the order of ``doc_id``, line number and row, has a
Jaccard similarity of 0.8 or more with it, whether or not that line stays. Rows
are numbered when the documents are written, and lines are named by that number.

Lines with the same set are one, named by two 64-bit hashes, with the earliest
place. The words of a set are put in order of rarity: counts of all words of
the corpus, summed in 65,536 hash buckets, make a table of one level a bucket,
so its size is fixed and any count only moves a word in the order. Two sets of
sizes a and b with similarity t share at least ``t / (1 + t) * (a + b)`` words,
so they share one among the first ``n - ceil(t * n) + 1`` of each (prefix
filter); sizes must be within t of each other (length filter); the place of
that shared word bounds what can follow (positional filter); and words in one
set only each flip a bit of a 128-bit parity sketch, so too many flipped bits
rule a pair out. What is left is verified on the words themselves.

A group of thousands of variants of a line would make all its pairs. So each
set is first compared with the earliest and the preceding set that hold one of
its few rarest words; only sets for which that finds no earlier match are
joined with all others.

Defined cases: a null text stays null; a line without words stays; rows that
share an id, or have none, are documents of their own: similar lines at the same
line number are in the order of the rows; a null id is before any other; a text
whose lines all go becomes empty; an empty table gives no rows; other columns
pass through :func:`without_repeated_lines`, whatever their names.
"""

from functools import reduce
from math import floor, log2

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.llm.registry import query, table
from citeloom.llm.written import dropped, fresh, written

PERCENT = 80
BUCKETS = 1 << 16
RAREST = 4
#: Turns in which the postings are shuffled, a part of all words in each (a power of two): a turn's disk is freed before the next.
PARTS = 2
SEED = 42


def words_of(line: Column) -> Column:
    """The words, repeats included."""
    words = F.split(F.lower(line), " ")
    spaced = line.contains("  ") | line.startswith(" ") | line.endswith(" ") | (line == "")
    return F.when(spaced, F.array_remove(words, "")).otherwise(words)


def exploded(docs: DataFrame) -> DataFrame:
    """(row, doc_id, line_no, line) of all lines."""
    return docs.filter("text IS NOT NULL").select(
        "row", "doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line")
    )


def rarity(docs: DataFrame) -> Column:
    """A level for each bucket of word hashes: three steps for each doubling of its count."""
    words = docs.select(F.explode(F.split(F.lower(F.replace("text", F.lit("\n"), F.lit(" "))), " ")).alias("w"))
    bucket = F.xxhash64("w").bitwiseAND(BUCKETS - 1).cast("int")
    levels = [1] * BUCKETS
    for row in words.groupBy(bucket.alias("bucket")).count().collect():
        levels[row["bucket"]] = min(126, 1 + floor(3 * log2(row["count"] + 1)))
    # A constant array: folded once, then read by place.
    return F.split(F.lit(",".join(str(x << 56) for x in levels)), ",").cast("array<bigint>")


def ordered(words: Column, levels: Column) -> Column:
    """A word's level and 56 bits of its hash in one number; in order, rarest first."""

    def key(w: Column) -> Column:
        h = F.xxhash64(w)
        found = F.get(levels, h.bitwiseAND(BUCKETS - 1).cast("int")).bitwiseOR(F.shiftrightunsigned(h, 8))
        # Known not to be null, the numbers are told apart and sorted as they are, not as objects.
        return F.coalesce(found, F.lit(0).cast("long"))

    return F.sort_array(F.array_distinct(F.transform(words, key)))


def needed(size: Column) -> Column:
    """Fewest words of a set of ``size`` that a similar set holds."""
    return F.ceil(size * PERCENT / 100 - 1e-9).cast("int")


def sets_of_lines(docs: DataFrame, levels: Column) -> DataFrame:
    """(row, doc_id, line_no, k1, k2, n, bits, prefix) of the lines that have words."""
    # Lines without words are found on the text: a filter on the sets would work them out once more.
    lines = exploded(docs).filter(F.trim("line") != "")
    keys = lines.select("row", "doc_id", "line_no", ordered(words_of(F.col("line")), levels).alias("words"))

    def parity(half: int) -> Column:
        """Half of 128 bits; each word flips one of them, chosen by seven bits of its hash."""

        def flip(w: Column) -> Column:
            mine = F.shiftright(w, 6).bitwiseXOR(F.lit(1 - half).cast("long")).bitwiseAND(1)
            return F.call_function("shiftleft", mine, w.bitwiseAND(63).cast("int"))

        return F.aggregate("words", F.lit(0).cast("long"), lambda held, w: held.bitwiseXOR(flip(w)))

    size = F.size("words")
    return keys.select(
        "row",
        "doc_id",
        "line_no",
        F.xxhash64("words").alias("k1"),
        F.xxhash64(F.lit(SEED), "words").alias("k2"),
        size.alias("n"),
        parity(0).alias("bits"),
        parity(1).alias("more_bits"),
        F.slice("words", F.lit(1), size - needed(size) + 1).alias("prefix"),
    )


def distinct_sets(lines: DataFrame) -> DataFrame:
    """One row a set, with its earliest place."""
    return lines.groupBy("k1", "k2").agg(
        F.min(F.struct("doc_id", "line_no", "row")).alias("first"),
        F.any_value("n").alias("n"),
        F.any_value("bits").alias("bits"),
        F.any_value("more_bits").alias("more_bits"),
        F.any_value("prefix").alias("prefix"),
    )


Posting = tuple[Column, Column, Column, Column]


def may_match(a: Posting, b: Posting) -> Column:
    """Length, positional and parity filters on two postings (n, place, bits, more_bits) of one word."""
    (n_a, place_a, bits_a, more_a), (n_b, place_b, bits_b, more_b) = a, b
    both = n_a + n_b
    overlap = F.ceil(both * PERCENT / (100 + PERCENT) - 1e-9)
    reach = 1 + F.least(n_a - place_a, n_b - place_b)
    sizes = F.least(n_a, n_b) * 100 >= F.greatest(n_a, n_b) * PERCENT
    # Each word that only one set has flips one bit.
    apart = F.bit_count(bits_a.bitwiseXOR(bits_b)) + F.bit_count(more_a.bitwiseXOR(more_b))
    return sizes & (reach >= overlap) & (apart <= both - 2 * overlap)


def of(struct: str) -> Posting:
    return F.col(f"{struct}.n"), F.col(f"{struct}.place"), F.col(f"{struct}.bits"), F.col(f"{struct}.more_bits")


def postings(sets: DataFrame, most: int | None, *columns: str) -> DataFrame:
    """(word, k1, n, bits, place) for the words of the prefixes, or the rarest ``most`` of them."""
    words = F.col("prefix") if most is None else F.slice("prefix", 1, most)
    rows = sets.select("k1", "n", "bits", "more_bits", *columns, F.posexplode(words).alias("at", "word"))
    return rows.select("word", "k1", "n", "bits", "more_bits", (F.col("at") + 1).alias("place"), *columns)


def neighbours(sets: DataFrame) -> DataFrame:
    """(later, earlier): each set with the earliest and the preceding one for its rarest words."""
    rows = postings(sets, RAREST, "first").withColumn("me", F.struct("n", "place", "bits", "more_bits"))
    by_place = Window.partitionBy("word").orderBy("first.doc_id", "first.line_no", "first.row")
    other = F.struct("k1", "n", "place", "bits", "more_bits")
    near = rows.select(
        "k1", "me", F.first(other).over(by_place).alias("head"), F.lag(other).over(by_place).alias("previous")
    ).filter("previous IS NOT NULL")
    both = F.array(*[F.when(may_match(of("me"), of(x)), F.col(f"{x}.k1")) for x in ("head", "previous")])
    found = near.select(F.col("k1").alias("later"), F.explode(F.array_compact(both)).alias("earlier"))
    return found.filter("later <> earlier").distinct()


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """(later) of the pairs (later, earlier) whose words are similar."""
    wanted = pairs.select(F.col("later").alias("k1")).union(pairs.select("earlier")).distinct()
    places = written(sets.select("k1", "first.row", "first.line_no").join(wanted, "k1"), "line-places")
    here = places.groupBy("row").agg(F.collect_list(F.struct("k1", "line_no")).alias("asked"))
    # Places grow with the documents: a merge join at every size.
    texts = (
        docs.filter("text IS NOT NULL")
        .join(here.hint("merge"), "row")
        .select(F.split("text", "\n", -1).alias("lines"), F.explode("asked").alias("a"))
        .select("a.k1", F.get("lines", F.col("a.line_no")).alias("line"))
        .select("k1", F.array_distinct(F.array_remove(F.split(F.lower("line"), " "), "")).alias("words"))
    )
    texts = written(texts, "line-words")
    met = pairs.join(texts.toDF("later", "x"), "later").join(texts.toDF("earlier", "y"), "earlier")
    common = F.size(F.array_intersect("x", "y"))
    similar = common * 100 >= (F.size("x") + F.size("y") - common) * PERCENT
    return met.filter(similar).select("later").distinct()


def meeting(sets: DataFrame, part: int) -> DataFrame:
    """(one, other): sets, one of which asks at least, that may be similar by a word of this part of all words."""
    # Sizes, places and the flag travel in one number: rows are many.
    packed = F.expr("shiftleft(shiftleft(CAST(n AS BIGINT), 30) | place, 1) | CAST(asks AS BIGINT)")
    rows = postings(sets, None, "asks").filter(F.col("word").bitwiseAND(PARTS - 1) == part)
    rows = rows.select("word", "k1", "bits", "more_bits", packed.alias("packed"))

    def unpacked(x: str) -> Posting:
        place = F.expr(f"CAST(shiftright({x}.packed, 1) & 1073741823 AS INT)")
        return F.expr(f"CAST(shiftright({x}.packed, 31) AS INT)"), place, F.col(f"{x}.bits"), F.col(f"{x}.more_bits")

    # No condition is on one side only, so both sides are the same rows and are shuffled once.
    meet = F.expr("a.word = b.word AND a.k1 < b.k1 AND (a.packed | b.packed) & 1 = 1")
    met = rows.alias("a").join(rows.alias("b"), meet & may_match(unpacked("a"), unpacked("b")))
    return met.select(F.col("a.k1").alias("one"), F.col("b.k1").alias("other")).distinct()


def repeated_lines(docs: DataFrame) -> DataFrame:
    """(row, gone): the line numbers that go, for the rows of (row, doc_id, text) that lose any."""
    whole = written(sets_of_lines(docs, rarity(docs)), "line-sets")
    sets = written(distinct_sets(whole), "distinct-sets")
    # From here lines need their names only.
    lines = written(whole.select("row", "line_no", "k1", "k2"), "line-names")
    dropped(whole)
    pairs = written(neighbours(sets), "line-pairs")
    matched = written(verified(pairs, sets, docs), "lines-matched")
    known = matched.select(F.col("later").alias("k1"), F.lit(False).alias("asks"))
    # Marked and written apart, so that this shuffle is gone before the postings are dealt out.
    marked = written(sets.join(known, "k1", "left").withColumn("asks", F.coalesce("asks", F.lit(True))), "marked-sets")
    dropped(sets)
    sets = marked
    parts = [written(meeting(sets, part), "sets-met") for part in range(PARTS)]
    met = reduce(DataFrame.unionByName, parts).distinct()
    places = sets.select("k1", "asks", "first")
    placed = met.join(places.toDF("one", "asks", "place"), "one").join(places.toDF("other", "other_asks", "where"), "other")
    after = F.col("where") < F.col("place")
    pairs = placed.filter(F.when(after, F.col("asks")).otherwise(F.col("other_asks"))).select(
        F.when(after, F.col("one")).otherwise(F.col("other")).alias("later"),
        F.when(after, F.col("other")).otherwise(F.col("one")).alias("earlier"),
    )
    more = written(verified(written(pairs, "line-pairs"), sets, docs), "lines-matched")
    going = matched.unionByName(more).distinct().select(F.col("later").alias("k1"), F.lit(True).alias("going"))
    marks = sets.select("k1", "k2", "first").join(going, "k1", "left")
    placed = lines.join(marks, ["k1", "k2"])
    elsewhere = (F.col("row") != F.col("first.row")) | (F.col("line_no") != F.col("first.line_no"))
    return placed.filter(F.col("going") | elsewhere).groupBy("row").agg(
        F.collect_set("line_no").alias("gone")
    )


def without_repeated_lines(docs: DataFrame, counts: tuple[str, str] | None = None) -> DataFrame:
    """``docs`` with the lines gone from ``text``; ``counts`` names columns for lines there were and went."""
    names = counts or tuple(fresh(docs.columns, "n_lines", "n_removed"))
    row, gone, kept = fresh([*docs.columns, *names], "row", "gone", "kept")
    docs, columns = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-docs"), docs.columns
    whole = docs.select(F.col(row).alias("row"), "doc_id", "text")
    lost = written(repeated_lines(whole), "lines-gone").toDF(row, gone)
    lines = F.split("text", "\n", -1)
    places = F.sequence(F.lit(0), F.size(lines) - 1)
    joined = docs.join(lost, row, "left")
    left = F.when(F.col(gone).isNull(), places).otherwise(F.array_except(places, F.col(gone)))
    texts = F.array_join(F.transform(F.col(kept), lambda i: F.get(lines, i)), "\n")
    result = joined.withColumn(kept, F.when(F.col("text").isNotNull(), left))
    result = result.withColumn(names[0], F.coalesce(F.size(lines), F.lit(0)).cast("long"))
    result = result.withColumn(names[1], F.col(names[0]) - F.coalesce(F.size(kept), F.lit(0)))
    result = result.withColumn("text", F.when(F.col(names[1]) == 0, F.col("text")).otherwise(texts))
    return result.select(*[F.col(f"`{c}`") for c in columns], *(counts or ()))


SQL = r"""
WITH lined AS (
  SELECT doc_id, unnest(range(len(lines)))::INTEGER AS line_no, unnest(lines) AS line
  FROM (SELECT doc_id, str_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL)
), worded AS (
  SELECT doc_id, line_no, list_sort(list_distinct([w FOR w IN str_split(lower(line), ' ') IF w <> ''])) AS words FROM lined
), sets AS (
  SELECT words, len(words) AS n, min((doc_id, line_no)) AS first, row_number() OVER (ORDER BY words) AS id FROM worded WHERE len(words) > 0 GROUP BY words
), tokens AS (SELECT id, n, first, unnest(words) AS word FROM sets),
counted AS (SELECT word, count(*) AS c FROM tokens GROUP BY word),
placed AS (SELECT id, n, first, word, row_number() OVER (PARTITION BY id ORDER BY c, word) AS place FROM tokens JOIN counted USING (word)),
prefixes AS (SELECT * FROM placed WHERE place <= n - ceil(n * 0.8 - 1e-9) + 1),
pairs AS (
  SELECT DISTINCT a.id AS later, b.id AS earlier FROM prefixes a JOIN prefixes b ON a.word = b.word AND b.first < a.first
  WHERE least(a.n, b.n) >= 0.8 * greatest(a.n, b.n)
), going AS (
  SELECT DISTINCT later AS id FROM pairs JOIN sets x ON x.id = later JOIN sets y ON y.id = earlier
  WHERE len(list_intersect(x.words, y.words)) * 100 >= (x.n + y.n - len(list_intersect(x.words, y.words))) * 80
), lost AS (
  SELECT doc_id, line_no FROM worded JOIN sets USING (words) WHERE id IN (SELECT id FROM going) OR (doc_id, line_no) <> first
), left_over AS (
  SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (x.line_no IS NOT NULL) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY l.line_no) FILTER (x.line_no IS NULL), '') AS body
  FROM lined l LEFT JOIN lost x ON l.doc_id = x.doc_id AND l.line_no = x.line_no GROUP BY l.doc_id
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(body) AS kept_sha256
FROM documents LEFT JOIN left_over USING (doc_id)
"""


@query("op9_line_dedup", SQL)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return without_repeated_lines(docs, ("n_lines", "n_removed")).select(
        "doc_id", "n_lines", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256")
    )
