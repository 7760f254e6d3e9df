"""Derived tables: what stays where it is read, and passages against plain search."""

import pytest
from conftest import FOLDER

from citeloom.sources import tables as t


@pytest.fixture
def large(spark):
    """As if every table were too large for Spark to broadcast on its own."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield spark
    spark.conf.set(key, before)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_of_active_chunks_and_passages_are_not_shuffled(large):
    for rows in (t.active_chunks(large, FOLDER), t.expected_sources(large, FOLDER)):
        assert "SortMergeJoin" not in plan(rows) and "ShuffledHashJoin" not in plan(rows)


@pytest.mark.parametrize("limit", [None, 0])
def test_passages_are_found_as_by_plain_search(large, tmp_path, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(t, "BROADCAST_BYTES", limit)
    texts = ["one two three four", "xone two threex\nfour", "", None, "a b c d e f g h i j k l", "b c d e f g h i j k", "two three", "one two two two three"]
    passages = ["one two three", "two", "a b c d e f g h i j", "c d e f g h i j k l", "e two three", "three\nfour", "one two two", "one two two t", "two two", ""]
    large.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    large.createDataFrame(list(enumerate(passages)), "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    found = sorted((r.query_id, r.version_id) for r in t.expected_sources(large, str(tmp_path)).collect())
    assert found == sorted((f"q{i}", f"v{d}") for i, p in enumerate(passages) for d, x in enumerate(texts) if x is not None and p in x)
