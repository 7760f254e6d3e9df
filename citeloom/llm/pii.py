"""Personal data by weak supervision: labelers vote, a trained classifier decides.

Four fixed patterns (email, ip, card, phone) give base spans, which always
stay. A wider pattern proposes more: what a secret word and = or : name, long
runs that mix kinds of character (``secret``) and loosely grouped numbers
(``number``). Labelers of three sorts
vote on each proposal for, against or not at all: regular expressions on its
shape, gazetteers of the words before it, and its context. Expectation
maximisation over the counts of vote patterns estimates how reliable each
labeler is, without any labels, and its posteriors train a logistic
classifier on votes and shape, which settles every proposal. Proposals that
touch a base span only teach.

Places come from lengths alone: a text split at a pattern, and the matches of
the same pattern, add up to the text. Everything that sees rows is a column
function; the driver gets counts of patterns of votes, of which there are at
most ``3 ** 5 * 24`` however large the table.

Defined cases: a null text is an empty one; offsets count code points; matches
of one kind never overlap, those of different kinds may; long runs of digits or
dots are matched without recursion; repeated rows are found alike; a table
without proposals, or empty, gives base spans only; other columns are not read.
"""

from dataclasses import dataclass
from math import exp, log

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import spans as places
from citeloom.llm.registry import query, table
from citeloom.llm.written import written

KINDS = ("email", "ip", "card", "phone", "secret", "number")
LOCAL = "A-Za-z0-9._%+-"
#: Possessive quantifiers: nothing that follows could use what they give back, and they need no stack.
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
#: A run of digits is entered at its start only; from within it no more would be found.
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
SECRET_WORDS = "password|passwd|pwd|secret|token|key|apikey|credential|credentials|passwort|contraseña|clave|mot de passe"
#: What follows a secret word and = or :, without quotes and closing marks. The first test is cheap and rules out most places.
NAMED = (
    rf"(?<=[=:\s\"'])(?<=[=:][ \t]{{0,3}}[\"']?)(?<=(?<!\p{{L}})(?iu:{SECRET_WORDS})[\"']?[ \t]{{0,3}}[=:][ \t]{{0,3}}[\"']?)"
    r"[^\s\"']*[^\s\"',;.)]"
)
#: Long runs of the letters of keys that hold two kinds of character, with their padding.
RUN = "A-Za-z0-9_+/-"
LONG = rf"(?<![{RUN}])(?!(?:[a-z]++|[A-Z]++|[0-9]++|[_+/-]++)(?![{RUN}]))[{RUN}]{{15,}}[A-Za-z0-9_]={{0,2}}"
WIDE = (
    r"(?<![A-Za-z0-9_])[+(]?[0-9][0-9 ().\-/]{4,}[0-9](?![A-Za-z0-9_])"
    rf"|{NAMED}|{LONG}|(?<![A-Za-z0-9_])[A-Za-z_]*+[0-9][A-Za-z0-9_]{{11,}}+"
)
NUMBER_WORDS = (
    "phone|telephone|tel|mobile|cell|call|fax|card|account|ssn|passport|iban|telefon|handy|konto|teléfono|móvil|"
    "tarjeta|cuenta|téléphone|portable|carte|compte"
)
OTHER_WORDS = "version|page|chapter|figure|table|isbn|invoice|order|item|no|nr|year|seite|kapitel|página|capítulo|chapitre|v"
VOTES = ("shape", "base", "words", "place", "other")
#: Weights of the votes in the first guess only.
TRUST = (1, 2, 2, 1, 2)
NEAR = 40


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, body, before>> of all matches, from left to right; ``before`` is of the same gap."""
    found = places.matches(text, pattern)

    def with_before(all_found: Column) -> Column:
        return F.zip_with(
            all_found,
            F.slice(F.split(text, pattern, -1), 1, F.size(all_found)),
            lambda x, gap: F.struct(x["start"], x["end"], x["body"], F.right(gap, F.lit(NEAR)).alias("before")),
        )

    return places.let(found, with_before)


def only_digits(body: Column) -> Column:
    return F.regexp_replace(body, "[^0-9]", "")


def passes_luhn(digits: Column) -> Column:
    """Every second digit from the right counts double, less 9 when over 9."""

    def worth(place: Column) -> Column:
        digit = F.substring(digits, place, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return F.when((F.length(digits) - place) % 2 == 1, twice).otherwise(digit)

    places = F.sequence(F.lit(1), F.length(digits))
    return F.aggregate(places, F.lit(0), lambda total, place: total + worth(place)) % 10 == 0


def in_byte(part: Column) -> Column:
    bare = F.ltrim(part, F.lit("0"))
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


def base_spans(text: Column) -> Column:
    """array<struct<start, place, end>> of the base kinds, in order; place numbers the kind."""

    def kept(kind: str, pattern: str, sign: str, test) -> Column:
        found = F.filter(matches(text, pattern), test)
        spans = F.transform(
            found, lambda x: F.struct(x["start"], F.lit(KINDS.index(kind)).alias("place"), x["end"].alias("end"))
        )
        return F.when(text.rlike(sign), spans).otherwise(F.array().cast("array<struct<start:int,place:int,end:int>>"))

    def is_card(x: Column) -> Column:
        digits = only_digits(x["body"])
        return F.length(digits).between(14, 19) & passes_luhn(digits)

    return F.array_sort(
        F.concat(
            kept("email", EMAIL, "@", lambda x: F.lit(True)),
            kept("ip", IP, r"[0-9]\.[0-9]", lambda x: F.forall(F.split(x["body"], r"\."), in_byte)),
            kept("card", CARD, "[0-9]", is_card),
            kept("phone", PHONE, r"\+[0-9]", lambda x: F.length(only_digits(x["body"])).between(10, 15)),
        )
    )


def proposals(text: Column, base: Column) -> Column:
    """array<struct<start, place, end, bodies' traits and votes>> of the wide pattern."""

    def vote(good: Column, bad: Column) -> Column:
        return F.when(good, 1).when(bad, -1).otherwise(0)

    def judged(x: Column) -> Column:
        body, before = x["body"], F.lower(x["before"])
        digits = F.length(only_digits(body))
        secret = body.rlike("[A-Za-z]")
        hexes = body.rlike("^(?:[0-9a-f]{16,}|[0-9A-F]{16,})$")
        grouped = body.rlike(r"^(?:[+(].*|[0-9]{3}[-. ][0-9]{2,4}[-. ][0-9]{4}|[0-9]{4}(?:[ -][0-9]{4}){2,3})$")
        word = r"(?:^|[^\p{L}])(?:%s)[^\p{L}\n]{0,6}$"
        return F.struct(
            x["start"],
            F.when(secret, KINDS.index("secret")).otherwise(KINDS.index("number")).alias("place"),
            x["end"].alias("end"),
            # A bounded trait: six steps of length for each sort of proposal, and whether it is grouped.
            (
                F.least(F.floor(F.length(body) / 5), F.lit(5)).cast("int")
                + F.when(secret, 6).otherwise(0)
                + F.when(body.rlike(r"[ ()./-]"), 12).otherwise(0)
            ).alias("trait"),
            F.array(
                vote(F.when(secret, hexes).otherwise(grouped), F.when(secret, digits < 2).otherwise(digits < 7)),
                vote(F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])), F.lit(False)),
                vote(before.rlike(word % f"{SECRET_WORDS}|{NUMBER_WORDS}"), F.lit(False)),
                vote(before.rlike(r"[=:]\s*[\"']?$"), before.rlike(r"[0-9%$€£#./-]\s?$")),
                vote(F.lit(False), before.rlike(word % OTHER_WORDS)),
            ).alias("votes"),
        )

    some = F.transform(matches(text, WIDE), judged)
    none = F.array().cast("array<struct<start:int,place:int,end:int,trait:int,votes:array<int>>>")
    return F.when(text.rlike(rf"[0-9=:]|[{RUN}]{{16}}"), some).otherwise(none)


@dataclass
class Judge:
    """A logistic classifier on votes and trait."""

    bias: float
    votes: list[dict[int, float]]
    traits: dict[int, float]

    def score(self, votes: list[int], trait: int) -> float:
        known = sum(weights.get(vote, 0.0) for weights, vote in zip(self.votes, votes))
        return self.bias + known + self.traits.get(trait, 0.0)

    def column(self, proposal: Column) -> Column:
        def pick(value: Column, weights: dict[int, float]) -> Column:
            found = F.lit(0.0)
            for key, weight in weights.items():
                found = F.when(value == key, weight).otherwise(found)
            return found

        total = F.lit(self.bias) + pick(proposal["trait"], self.traits)
        for k, weights in enumerate(self.votes):
            total = total + pick(F.element_at(proposal["votes"], k + 1), weights)
        return total


def _sigmoid(x: float) -> float:
    return 1 / (1 + exp(-max(-40.0, min(40.0, x))))


def posteriors(patterns: list[Row], rounds: int = 60) -> list[float]:
    """P(personal) of each vote pattern by expectation maximisation.

    A labeler votes for, against or not at all with probabilities of its own in
    each class, smoothed by one vote each way. The first guess is a balance
    of the votes, which fixes the classes' names.
    """
    guess = [_sigmoid(sum(w * v for w, v in zip(TRUST, p["votes"]))) for p in patterns]
    for _ in range(rounds):
        share = [1.0, 1.0]
        tables = [[{v: 1.0 for v in (-1, 0, 1)} for _ in VOTES] for _ in range(2)]
        for row, yes in zip(patterns, guess):
            for kind, weight in ((1, yes), (0, 1 - yes)):
                share[kind] += row["n"] * weight
                for held, vote in zip(tables[kind], row["votes"]):
                    held[vote] += row["n"] * weight
        guess = [
            _sigmoid(
                log(share[1] / share[0])
                + sum(
                    log(a[v] / sum(a.values())) - log(b[v] / sum(b.values()))
                    for a, b, v in zip(tables[1], tables[0], row["votes"])
                )
            )
            for row in patterns
        ]
    return guess


def train(patterns: list[Row], rounds: int = 300, rate: float = 0.5, decay: float = 1e-3) -> Judge:
    """The classifier from counts ``n`` of (votes, trait), by gradient descent on soft labels."""
    judge = Judge(0.0, [{1: 0.0, -1: 0.0} for _ in VOTES], {})
    total = sum(p["n"] for p in patterns)
    if not total:
        return Judge(-1.0, judge.votes, {})
    # Labelers err in other ways on keys than on numbers, so each sort has its own expectations.
    sorts = [[p for p in patterns if p["trait"] % 12 // 6 == k] for k in (0, 1)]
    patterns = [p for of in sorts for p in of]
    # Patterns of votes weigh by the root of their count: a common one doesn't drown the rest.
    weights = [p["n"] ** 0.5 for p in patterns]
    wanted = [y for of in sorts for y in posteriors(of)]
    scale = rate / sum(weights)
    for _ in range(rounds):
        error = [w * (y - _sigmoid(judge.score(p["votes"], p["trait"]))) for p, y, w in zip(patterns, wanted, weights)]
        judge.bias += scale * sum(error)
        steps: dict = {}
        for p, e in zip(patterns, error):
            for k, vote in enumerate(p["votes"]):
                if vote:
                    steps[k, vote] = steps.get((k, vote), 0.0) + e
            steps["trait", p["trait"]] = steps.get(("trait", p["trait"]), 0.0) + e
        for (k, value), step in steps.items():
            held = judge.traits if k == "trait" else judge.votes[k]
            held[value] = held.get(value, 0.0) * (1 - decay) + scale * step
    return judge


def personal_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added): arrays of (start, place, end), where place numbers ``KINDS``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", text.alias("text")).withColumn("base", base_spans(F.col("text")))
    found = found.withColumn("proposed", proposals(F.col("text"), F.col("base"))).drop("text")
    found = written(found, "personal-spans")
    counts = (
        found.filter(F.size("proposed") > 0)
        .select(F.explode("proposed").alias("p"))
        .groupBy("p.votes", "p.trait")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    judge = train(sorted(counts.collect(), key=lambda r: (r["votes"], r["trait"])))
    apart = F.filter(
        "proposed",
        lambda p: (judge.column(p) >= 0) & (F.element_at(p["votes"], VOTES.index("base") + 1) == 0),
    )
    added = F.transform(apart, lambda p: F.struct(p["start"], p["place"], p["end"]))
    return found.select("doc_id", "base", added.alias("added"))


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


@query("op8_personal_data")
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_spans(table(spark, sf_dir, "documents"))

    def count(k: int) -> Column:
        return F.size(F.filter("base", lambda s: s["place"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    return found.select(
        "doc_id",
        *[count(k) for k in range(4)],
        F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
        listed(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )
