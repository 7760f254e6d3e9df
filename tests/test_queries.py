"""Registered queries against their SQL on the smallest tables."""

import compare
import pytest
from conftest import FOLDER

from citeloom import catalogue

catalogue.load_all()

SAMPLE = (
    "src1_corpus_scan src3_html_blocks win8_heading_paths win9_packed_chunks jn12_page_outline snk1_chunk_upsert "
    "snk3_delete_version agg25_coverage agg1_lexical_hits jn2_lexical_matches win3_fusion_facts win2_hash_heading_dedup "
    "jn5_governed_candidates prj3_citations jn6_evidence_resolution agg9_industry_report agg13_arm_report agg17_case_signals "
    "win6_complete_turns win5_latest_replies flt13_sanitised_messages mnt1_index_decisions mnt4_metadata_upsert "
    "win2_greedy_dedup agg15_drop_counts flt8_filtered_cases src6_scenario_problems jn15_claim_verification fn11_reference_points "
    "mnt6_promotion_gate mnt5_bad_case_lifecycle agg23_question_groups mnt10_retention_purge str2_latest_feedback str3_chat_event_fold"
).split()


@pytest.mark.parametrize("name", SAMPLE)
def test_matches_sql(spark, con, name):
    assert compare.difference(catalogue.QUERIES[name](spark, FOLDER), con, catalogue.ORACLES[name]) is None


def test_every_oracle_has_a_query():
    assert set(catalogue.ORACLES) <= set(catalogue.QUERIES)
    assert len(catalogue.QUERIES) > 140


def test_no_identifier_survives_redaction(spark):
    from pyspark.sql import functions as F

    from citeloom.functions import redaction as rd

    rows = catalogue.QUERIES["fn15_redacted_documents"](spark, FOLDER)
    assert rows.where((F.col("status") == "passed") & rd.contains_identifier(F.col("text"))).count() == 0
