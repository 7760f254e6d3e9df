"""Secrets whose parts are apart: identifiers, secrets and endpoints linked within a scope.

Three fixed patterns (assign, access, hex) give base spans, which always stay.
Weak patterns give candidates that alone mean little: a named account or
another key id (``identifier``), a short or mixed run of characters
(``secret``), an address of a service (``endpoint``). A candidate is reported
only where complementary parts meet: a secret wants an identifier or an
endpoint, an identifier or an endpoint wants a secret. Parts meet when they lie
in one scope, which is a run of lines without a blank one, at most ``REACH``
code points apart. Base spans are parts too: an access id identifies, an
assignment is a secret, and so is a hex run that holds letters and digits.

The link is an interval join of rows: candidates, widened by ``REACH``, meet
the parts of the other sorts by document row, scope and bin of ``REACH`` code
points. As parts of one pattern don't overlap, a bin holds a bounded number of
them, so the join grows with the text and not with its square. Only rows with
complementary parts take part, with a number given when the spans were written.

Defined cases: a null text is an empty one; offsets count code points; repeated
rows, and rows with null or repeated ids, are each judged alone; candidates that
touch a base span are left out; an empty table gives no rows; columns other
than ``doc_id`` and ``text`` are not read.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from citeloom.llm.registry import query, table
from citeloom.llm.spans import matches
from citeloom.llm.written import written

BASE = ("assign", "access", "hex")
WEAK = ("identifier", "secret", "endpoint")
KINDS = BASE + WEAK
REACH = 300

# Patterns without looking around, so that SQL engines read them alike.
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.=-]+"
ASSIGNED = r"^[A-Za-z_]+[\"']?\x20*[:=]\x20*[\"']?"
ACCESS = r"AKIA[A-Z0-9]+"
#: Greedy runs: those of 16 and more are the same as all runs, less the shorter ones.
HEX = r"[0-9a-f]{16,}"
IDENTIFIER = (
    r"(?i:username|user|login|account|client_?id|key_?id|tenant)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._@+-]{3,}"
    r"|A(?:SIA|ROA|IDA|GPA)[A-Z0-9]{12,}"
)
#: A named short value, or a run that is_mixed tests.
SECRET = r"(?i:password|passwd|passphrase|pwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?[^\x00-\x20\"']{6,}|[A-Za-z0-9+/_-]{20,}"
NAMED = r"^[A-Za-z_]+[\"']?\x20*[:=]"
ENDPOINT = (
    r"(?:https?|ftps?|sftp|ssh|postgres|postgresql|mysql|mongodb|redis|amqps?|ldaps?|smtp|s3)://[^\x00-\x20\"'<>]+"
    r"|(?i:host|hostname|server|endpoint|url)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9._:/-]{4,}"
    r"|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}(?::[0-9]{1,5})?"
)
BLANK_LINE = r"\n[\x20\t\r]*\n"

SPAN = "array<struct<start:int,place:int,end:int>>"


def spans_of(text: Column, kind: str, pattern: str, sign: str, test) -> Column:
    """Matches that pass, as (start, place, end); ``sign`` is a cheap test that every text with a match passes."""
    kept = F.filter(matches(text, pattern), lambda x: test(x["body"]))
    found = F.transform(
        kept, lambda x: F.struct(x["start"], F.lit(KINDS.index(kind)).alias("place"), x["end"].alias("end"))
    )
    return F.when(text.rlike(sign), found).otherwise(F.array().cast(SPAN))


def is_mixed(body: Column) -> Column:
    return body.rlike("[0-9]") & body.rlike("[A-Z]") & body.rlike("[a-z]")


def base_spans(text: Column) -> Column:
    return F.array_sort(
        F.concat(
            spans_of(text, "assign", ASSIGN, "[:=]", lambda b: F.length(F.regexp_replace(b, ASSIGNED, "")) >= 12),
            spans_of(text, "access", ACCESS, "AKIA[A-Z0-9]", lambda b: F.length(b) >= 18),
            spans_of(text, "hex", HEX, "[0-9a-f]{16}", lambda b: F.lit(True)),
        )
    )


def weak_spans(text: Column) -> Column:
    return F.concat(
        spans_of(text, "identifier", IDENTIFIER, "[:=]|A(?:SIA|ROA|IDA|GPA)[A-Z0-9]", lambda b: F.lit(True)),
        spans_of(text, "secret", SECRET, r"[:=]|[A-Za-z0-9+/_-]{20}", lambda b: b.rlike(NAMED) | is_mixed(b)),
        spans_of(text, "endpoint", ENDPOINT, r"[:=]|[0-9]\.[0-9]", lambda b: F.lit(True)),
    )


def solid_hex(text: Column, span: Column) -> Column:
    """Whether a hex run holds letters and digits; numbers alone are no secrets."""
    body = F.substring(text, span["start"] + 1, span["end"] - span["start"])
    return body.rlike("[0-9]") & body.rlike("[a-f]")


def parts_of_documents(docs: DataFrame) -> DataFrame:
    """(row, doc_id, base, weak, helping, breaks), written: spans by document row, and where blank lines are."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text"))).withColumn("weak", weak_spans(F.col("text")))
    apart = F.filter(
        "weak", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"]))
    )
    helping = F.filter(
        "base", lambda b: (b["place"] != KINDS.index("hex")) | solid_hex(F.col("text"), b)
    )
    breaks = F.transform(matches(F.col("text"), BLANK_LINE), lambda x: x["start"])
    some = F.size("weak") > 0
    return written(
        rows.select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            "base",
            F.when(some, apart).otherwise(F.col("weak")).alias("weak"),
            F.when(some, helping).otherwise(F.array().cast(SPAN)).alias("helping"),
            F.when(some & F.col("text").rlike(BLANK_LINE), breaks).otherwise(F.array().cast("array<int>")).alias("breaks"),
        ),
        "secret-parts",
    )


def role(place: Column) -> Column:
    """What a part is in a credential: 0 identifier, 1 secret, 2 endpoint."""
    roles = {"assign": 1, "access": 0, "hex": 1, "identifier": 0, "secret": 1, "endpoint": 2}
    return F.element_at(F.array(*[F.lit(roles[k]) for k in KINDS]), place + 1)


def scoped(parts: DataFrame) -> DataFrame:
    """(row, scope, start, place, end, weak) of the rows that hold complementary parts."""
    every = F.concat(
        F.transform("weak", lambda s: F.struct(s["start"], s["place"], s["end"], F.lit(True).alias("weak"))),
        F.transform("helping", lambda s: F.struct(s["start"], s["place"], s["end"], F.lit(False).alias("weak"))),
        F.transform(
            "breaks", lambda b: F.struct(b.alias("start"), F.lit(-1).alias("place"), b.alias("end"), F.lit(False).alias("weak"))
        ),
    )
    secret = F.exists("weak", lambda s: role(s["place"]) == 1) | F.exists("helping", lambda s: role(s["place"]) == 1)
    other = F.exists("weak", lambda s: role(s["place"]) != 1) | F.exists("helping", lambda s: role(s["place"]) != 1)
    rows = parts.filter((F.size("weak") > 0) & secret & other).select("row", F.explode(every).alias("p")).select("row", "p.*")
    # A break ends the scope before it; parts don't span lines, so none starts before and ends behind one.
    in_order = Window.partitionBy("row").orderBy("start", "place").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("scope", F.sum((F.col("place") < 0).cast("int")).over(in_order)).filter("place >= 0")


def linked(parts: DataFrame, reach: int = REACH) -> DataFrame:
    """(row, start, place, end) of the weak candidates that complementary parts stand by."""

    def bins(first: Column, last: Column) -> Column:
        return F.explode(F.sequence(F.floor(first / reach), F.floor(last / reach)))

    rows = written(scoped(parts), "secret-scopes")
    asking = rows.filter("weak").withColumn("bin", bins(F.col("start") - reach, F.col("end") + reach))
    asking = asking.withColumn("is_secret", role(F.col("place")) == 1)
    offered = rows.select(
        "row",
        "scope",
        F.col("start").alias("from"),
        F.col("end").alias("to"),
        (role(F.col("place")) != 1).alias("is_secret"),
        bins(F.col("start"), F.col("end") - 1).alias("bin"),
    )
    near = (F.col("from") <= F.col("end") + reach) & (F.col("start") <= F.col("to") + reach)
    # A part that isn't a secret answers those that are, and the other way round.
    met = asking.alias("a").join(
        offered.alias("o"),
        (F.col("a.row") == F.col("o.row"))
        & (F.col("a.scope") == F.col("o.scope"))
        & (F.col("a.bin") == F.col("o.bin"))
        & (F.col("a.is_secret") == F.col("o.is_secret"))
        & near,
        "left_semi",
    )
    return met.select("row", "start", "place", "end").distinct()


def secret_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added): arrays of (start, place, end), where place numbers ``KINDS``."""
    parts = parts_of_documents(docs)
    added = linked(parts).groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "place", "end"))).alias("added"))
    return parts.select("row", "doc_id", "base").join(added, "row", "left").select(
        "doc_id", "base", F.coalesce("added", F.array().cast(SPAN)).alias("added")
    )


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat_ws(":", F.element_at(kinds, s["place"] + 1), s["start"].cast("string"), s["end"].cast("string")),
        ),
        ",",
    )


def _sql() -> str:
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def found(place: int, pattern: str, test: str) -> str:
        return f"""
  SELECT row, {place} AS place, body, befores[k] + length(gaps[k]) AS start, befores[k] + length(gaps[k]) + length(body) AS stop FROM (
    SELECT row, unnest(bodies) AS body, generate_subscripts(bodies, 1) AS k, gaps,
      list_concat([0], list_transform(range(1, len(bodies) + 1), lambda n: list_sum(list_transform(gaps[1:n], lambda g: length(g)))::BIGINT
        + list_sum(list_transform(bodies[1:n], lambda b: length(b)))::BIGINT)) AS befores
    FROM (SELECT row, regexp_extract_all(text, {quoted(pattern)}) AS bodies,
                 string_split_regex(text, {quoted(pattern)}) AS gaps FROM d)
  ) WHERE {test}"""

    mixed = "regexp_matches(body, '[0-9]') AND regexp_matches(body, '[A-Z]') AND regexp_matches(body, '[a-z]')"
    parts = [
        found(0, ASSIGN, f"length(regexp_replace(body, {quoted(ASSIGNED)}, '')) >= 12"),
        found(1, ACCESS, "length(body) >= 18"),
        found(2, HEX, "true"),
        found(3, IDENTIFIER, "true"),
        found(4, SECRET, f"regexp_matches(body, {quoted(NAMED)}) OR ({mixed})"),
        found(5, ENDPOINT, "true"),
        found(-1, BLANK_LINE, "true"),
    ]
    names = "[" + ", ".join(quoted(k) for k in KINDS) + "]"
    return f"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents
), found AS ({" UNION ALL ".join(parts)}
), scoped AS (
  SELECT *, sum((place < 0)::INT) OVER (PARTITION BY row ORDER BY start, place ROWS UNBOUNDED PRECEDING) AS scope,
         CASE WHEN place IN (0, 4) THEN true WHEN place IN (1, 3, 5) THEN false
              WHEN place = 2 AND regexp_matches(body, '[0-9]') AND regexp_matches(body, '[a-f]') THEN true END AS secret
  FROM found
), weak AS (
  SELECT * FROM scoped w WHERE place > 2
    AND NOT EXISTS (SELECT 1 FROM scoped b WHERE b.row = w.row AND b.place BETWEEN 0 AND 2 AND b.start < w.stop AND w.start < b.stop)
), parts AS (
  SELECT * FROM weak UNION ALL SELECT * FROM scoped WHERE place BETWEEN 0 AND 2 AND secret IS NOT NULL
), linked AS (
  SELECT row, start, place, stop FROM weak w WHERE EXISTS (
    SELECT 1 FROM parts o WHERE o.row = w.row AND o.scope = w.scope AND o.secret <> w.secret
      AND o.start <= w.stop + {REACH} AND w.start <= o.stop + {REACH})
), every AS (
  SELECT row, start, place, stop FROM linked UNION ALL SELECT row, start, place, stop FROM found WHERE place BETWEEN 0 AND 2
), listed AS (
  SELECT row, count(*) FILTER (place = 0) AS a, count(*) FILTER (place = 1) AS k, count(*) FILTER (place = 2) AS h,
         string_agg({names}[place + 1] || ':' || start || ':' || stop, ',' ORDER BY start, place) FILTER (place < 3) AS base,
         string_agg({names}[place + 1] || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans
  FROM every GROUP BY row
)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (row)
"""


@query("op13_secret_links", _sql())
def op13_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["place"] == k)).cast("long").alias(f"n_{BASE[k]}")

    return found.select(
        "doc_id",
        *[count(k) for k in range(len(BASE))],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
