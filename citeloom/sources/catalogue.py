"""Evaluation sets and scenario catalogues: strict loading."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom import fixed
from citeloom.functions import text as tx

SCENARIO = (
    "struct<scenario_id: string, type: string, question: string, standalone_question: string, "
    "answer: string, refused: boolean, evidence_terms: array<string>>"
)


def canonical_case() -> Column:
    """One case as canonical JSON: fields in alphabetical order, none left out."""
    return F.to_json(
        F.struct("case_no", "question", "reference_points", "source_ids", "type"), {"ignoreNullFields": "false"}
    )


def set_checksums(cases: DataFrame) -> DataFrame:
    """Checksum of each set over its cases in order: set_id, case_count, checksum.

    Each case is digested in its own row; the set's digest is over the digests
    in case order. A set holds at most 1000 cases.
    """
    return (
        cases.select("set_id", "case_no", F.sha2(canonical_case(), 256).alias("digest"))
        .groupBy("set_id")
        .agg(F.array_sort(F.collect_list(F.struct("case_no", "digest"))).alias("d"))
        .select(
            "set_id",
            F.size("d").alias("case_count"),
            F.sha2(F.concat_ws("\n", F.col("d.digest")), 256).alias("checksum"),
        )
    )


def verify_sets(cases: DataFrame, stored: DataFrame) -> DataFrame:
    """Sets with whether their stored checksum (set_id, checksum) still holds."""
    expected = stored.select("set_id", F.col("checksum").alias("stored"))
    return set_checksums(cases).join(expected, "set_id", "left").withColumn(
        "intact", F.coalesce(F.col("checksum") == F.col("stored"), F.lit(False))
    )


def read_scenarios(spark: SparkSession, path: str) -> DataFrame:
    """Scenarios of version-one catalogue files (multi-line JSON)."""
    files = spark.read.schema(f"schema_version int, scenarios array<{SCENARIO}>").json(
        path, multiLine=True, mode="FAILFAST"
    )
    bad = F.when(
        ~F.col("schema_version").eqNullSafe(1), F.raise_error(F.lit("scenario schema_version must be 1"))
    ).otherwise(F.col("scenarios"))
    return files.select(F.explode(bad).alias("s")).select("s.*")


def scenario_problems(scenarios: DataFrame) -> DataFrame:
    """Broken rules: scenario_id, problem.

    Questions are compared folded and with single spaces, the standalone form
    included, and may not be shared between scenarios.
    """
    blank = lambda c: tx.is_blank(F.col(c))
    terms = F.transform("evidence_terms", lambda t: F.lower(tx.strip(t)))
    answered = ~tx.is_blank(F.col("answer"))
    rules = F.array_compact(
        F.array(
            F.when(blank("scenario_id"), "SCENARIO_ID"),
            F.when(F.col("type").isNull() | ~F.col("type").isin(*fixed.SCENARIO_TYPES), "TYPE"),
            F.when(blank("question"), "QUESTION"),
            F.when(blank("standalone_question"), "STANDALONE_QUESTION"),
            F.when(F.col("refused").isNull(), "REFUSED"),
            F.when(F.coalesce(F.size("evidence_terms"), F.lit(0)) <= 0, "EVIDENCE_TERMS"),
            F.when(F.exists("evidence_terms", tx.is_blank), "EVIDENCE_TERMS"),
            F.when(F.size(F.array_distinct(terms)) != F.size(terms), "EVIDENCE_TERMS_REPEATED"),
            F.when(~F.col("refused") & ~answered, "ANSWER_MISSING"),
            F.when(F.col("refused") & answered, "ANSWER_OF_REFUSED"),
        )
    )
    own = scenarios.select("scenario_id", F.explode(F.array_distinct(rules)).alias("problem"))
    ids = (
        scenarios.groupBy("scenario_id")
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .select("scenario_id", F.lit("SCENARIO_ID_REPEATED").alias("problem"))
    )
    asked = scenarios.select(
        "scenario_id",
        F.explode(
            F.array_distinct(
                F.array(
                    tx.collapse_space(tx.casefold(F.col("question"))),
                    tx.collapse_space(tx.casefold(F.col("standalone_question"))),
                )
            )
        ).alias("question_key"),
    )
    shared = asked.groupBy("question_key").agg(
        F.count("*").alias("n"), F.min("scenario_id").alias("first_id")
    ).where("n > 1")
    repeated = (
        asked.join(shared, "question_key")
        .where("scenario_id <> first_id")
        .select("scenario_id", F.lit("QUESTION_REPEATED").alias("problem"))
        .distinct()
    )
    return own.unionByName(ids).unionByName(repeated)


def write_once(report: DataFrame, path: str) -> None:
    """Write a report; an existing one is never replaced."""
    report.write.mode("errorifexists").json(path)
