"""Tables that several queries start from, made and written once a session.

They are told apart by the state of their input: a table that was changed since
is made anew.
"""

from pyspark.sql import DataFrame, SparkSession

from citeloom.operators import dedup, fusion, lexical, vectors
from citeloom.operators.segments import write_segments
from citeloom.plans import ask, assess
from citeloom.session import shared_dir, write_table
from citeloom.sources import tables as t

_KEPT: dict[tuple, object] = {}


INDEXES = ("hash-index", "lexical-index", "diagnostic-index")


def _state(spark: SparkSession, folder: str) -> tuple:
    """Name, length and time of change of every input table."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*.parquet")
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(path)
    return tuple(sorted((str(x.getPath()), x.getLen(), x.getModificationTime()) for x in found))


def _once(spark: SparkSession, folder: str, name: str, make):
    key = (spark.sparkContext.applicationId, _state(spark, folder), name)
    if key not in _KEPT:
        _KEPT[key] = make()
    return _KEPT[key]


def forget() -> None:
    """Make the next query search again; indexes are kept, as they hold nothing of the questions."""
    for key in [k for k in _KEPT if k[-1] not in INDEXES]:
        del _KEPT[key]


def hash_index(spark, folder) -> DataFrame:
    make = vectors.hash_index
    return _once(spark, folder, "hash-index", lambda: write_segments(make(t.active_chunks(spark, folder)), "hash-index"))


def lexical_index(spark, folder) -> DataFrame:
    make = lexical.lexical_index
    return _once(spark, folder, "lexical-index", lambda: write_segments(make(t.active_chunks(spark, folder)), "lexical-index"))


def diagnostic_index(spark, folder) -> DataFrame:
    make = lexical.diagnostic_index
    return _once(spark, folder, "diagnostic-index", lambda: write_segments(make(t.active_chunks(spark, folder)), "diagnostic-index"))


def kept(df: DataFrame, name: str) -> DataFrame:
    return write_table(df, shared_dir(df.sparkSession, name))


def question_count(spark, folder) -> int:
    return t.load(spark, folder, "benchmark").count()


def expected(spark, folder) -> DataFrame:
    """(case_id, source_id): the versions that hold each benchmark passage."""

    def make():
        rows = t.expected_sources(spark, folder)
        return kept(rows.selectExpr("query_id AS case_id", "version_id AS source_id"), "expected")

    return _once(spark, folder, "expected", make)


def branches(spark, folder) -> tuple[DataFrame, DataFrame]:
    """Vector and lexical hits of every benchmark question on active chunks."""
    return _once(
        spark,
        folder,
        "branches",
        lambda: ask.both_branches(
            t.questions(spark, folder),
            t.active_chunks(spark, folder),
            (hash_index(spark, folder), lexical_index(spark, folder)),
            n_queries=question_count(spark, folder),
        ),
    )


def selected(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(candidates, reranked, gated evidence) of the hybrid strategy."""

    def make():
        vector, words = branches(spark, folder)
        combined = fusion.choose_strategy("hybrid", vector, words)
        candidates = kept(dedup.retained(combined, dedup.deduplicate(combined)), "candidates")
        reranked, shown = ask.evidence_table(candidates, t.questions(spark, folder))
        reranked = kept(reranked, "reranked")
        return candidates, reranked, kept(ask.gate(reranked), "evidence")

    return _once(spark, folder, "selected", make)


def arms(spark, folder) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(candidates, evidence, drops, fusion facts) of all four arms."""

    def make():
        questions = t.questions(spark, folder)
        candidates, drops, facts = assess.arms_from(*branches(spark, folder))
        candidates = kept(candidates, "arm-candidates")
        evidence = kept(assess.arm_evidence(candidates, questions), "arm-evidence")
        return candidates, evidence, kept(drops, "arm-drops"), facts

    return _once(spark, folder, "arms", make)
