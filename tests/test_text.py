import unicodedata

from pyspark.sql import functions as F

from citeloom import fixed
from citeloom.functions import redaction as rd
from citeloom.functions import safety as sf
from citeloom.functions import text as tx
from citeloom.operators import chunking


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("r")).first()
    return row["r"]


def text(spark, value, function):
    return one(spark, function(F.col("t")), t=value)


def test_lexical_tokens(spark):
    assert text(spark, "CRRT 2.0：血液透析", tx.lexical_tokens) == ["crrt", "2", "0", "血液", "液透", "透析"]
    assert text(spark, "a 血 b", tx.lexical_tokens) == ["a", "b"]


def test_diagnostic_tokens(spark):
    assert text(spark, "Straße 血液", tx.diagnostic_tokens) == ["strasse", "血", "液", "血液"]


def test_questions(spark):
    assert text(spark, "透析\x00流程\x7f ", tx.clean_question) == "透析流程"
    limit = lambda c: tx.question_problem(tx.clean_question(c))
    assert text(spark, "问" * 1000, limit) is None
    assert text(spark, "问" * 1001, limit) == "QUESTION_TOO_LONG"
    assert text(spark, " \t\n", limit) == "EMPTY_QUESTION"
    assert text(spark, "透析　，  低血压？", tx.normalise_query) == "透析, 低血压?"


def test_aliases(spark):
    aliased, applied = tx.apply_aliases(F.col("t"))
    assert one(spark, aliased, t="血透 HD CRRT") == "血液透析 血液透析 连续性肾脏替代治疗"
    assert one(spark, applied, t="血透 HD CRRT") == ["血透→血液透析", "HD→血液透析", "CRRT→连续性肾脏替代治疗"]
    assert one(spark, aliased, t="HDX xHD") == "HDX xHD"


def test_folding_and_nfkc_match_python(spark):
    samples = ["Straße ẞ", "ΑΣ ς", "ﬁne Ｆ", "İx", "µ ſ", "plain", "éÉ", "e\u0301", "Ⅷ", "ŉ"]
    rows = spark.createDataFrame([(s,) for s in samples], "t string").select(
        "t", tx.casefold(F.col("t")).alias("f"), tx.nfkc(F.col("t")).alias("n")
    )
    for row in rows.collect():
        assert row["f"] == row["t"].casefold()
        assert row["n"] == unicodedata.normalize("NFKC", row["t"])


def test_whitespace_is_what_python_strips(spark):
    spaces = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
    assert set(spaces) == set(fixed.SPACE_CHARS)
    assert text(spark, spaces + "a b" + spaces, tx.strip) == "a b"
    assert text(spark, "a" + spaces + "b", tx.collapse_space) == "a b"


def test_sentences_rejoin(spark):
    value = "一。二；三\n四"
    pieces = text(spark, value, tx.sentences)
    assert pieces == ["一。", "二；", "三\n", "四"] and "".join(pieces) == value
    assert text(spark, "abcdefg", lambda c: tx.hard_pieces(c, 3)) == ["abc", "def", "g"]


def test_masking(spark):
    masked = text(spark, "see C:\\a\\b.txt and /etc/x/y, sk-abc1 api_key=zz bearer tok", sf.mask_secrets)
    assert masked == "see [path redacted] and [path redacted] [redacted] [redacted] bearer [redacted]"
    assert text(spark, "plain\ntext", sf.is_safe_text) is True


def test_timestamps(spark):
    assert text(spark, "2024-02-29 23:59:59", sf.is_safe_timestamp) is True
    assert text(spark, "2023-02-29T10:00:00Z", sf.is_safe_timestamp) is False


def test_redaction_shares_placeholders(spark):
    pair = rd.redact_interaction(F.col("q"), F.col("a"))
    row = one(spark, pair, q="患者姓名：张三丰 目前如何", a="患者张三 电话13812345678，护士李四 处理")
    assert row["question_text"].startswith("[患者-1]")
    assert "[phone]" in row["answer_text"] and "[人员-1]" in row["answer_text"]
    assert "13812345678" not in row["answer_text"] and row["answer_status"] == "passed"
    again = one(spark, pair, q="患者张三如何", a="患者张三应休息，患者如何")
    assert again["question_text"] == "患者[患者-1]如何"
    assert again["answer_text"] == "患者[患者-1]应休息,患者如何"


def test_redaction_numbers_names_over_both_texts(spark):
    pair = rd.redact_interaction(F.col("q"), F.col("a"))
    row = one(spark, pair, q="药师姓名：王芳应复核。患者患者张三 如何", a="药师李四与患者王五 和患者王芳")
    # A stop word keeps its match whole, so the name behind it is not met; 王芳 keeps the first stand-in.
    assert row["question_text"] == "[人员-1]应复核。患者患者张三 如何"
    assert row["answer_text"] == "药师[人员-2]与患者[患者-1] 和患者[人员-1]"
    assert row["flags"] == ["staff_name", "patient_name"]


def test_redaction_values_keep_the_stand_in_of_the_rule_that_met_them_first(spark):
    pair = rd.redact_interaction(F.col("q"), F.col("a"))
    row = one(spark, pair, q="住址：U@B.com", a="mail u@b.com or v@b.com, 13812345678")
    assert row["question_text"] == "[address]" and row["answer_text"] == "mail [address] or [email], [phone]"
    assert row["flags"] == ["address", "email", "phone"]


def test_redaction_reports_a_stopped_text_alone(spark):
    pair = rd.redact_interaction(F.col("q"), F.col("a"))
    row = one(spark, pair, q="[附件1] 患者张三", a="患者李四 2020-01-02")
    assert row["question_status"] == "blocked" and row["answer_text"] == "患者[患者-1] [date]"
    assert row["flags"] == ["attachment", "patient_name", "date"]
    nothing = spark.createDataFrame([(None, "")], "q string, a string").select(pair.alias("r")).first()["r"]
    assert (nothing["question_status"], nothing["answer_status"]) == ("blocked", "review_required")
    assert nothing["flags"] == ["invalid_input", "empty_text"]


def test_redaction_keeps_to_columns(spark):
    plan = spark.range(1).select(rd.redact_text(F.concat(F.lit("患者张三"), F.col("id").cast("string"))).alias("r"))
    shown = plan._jdf.queryExecution().executedPlan().toString()
    # The only Python left is NFKC of unusual characters.
    assert "_redact" not in shown and shown.count("ArrowEvalPython") <= 1


def test_redaction_stops(spark):
    status = lambda v: text(spark, v, lambda c: rd.redact_text(c)["status"])
    assert status("[附件1] 请看") == "blocked"
    assert status("   ") == "review_required"
    assert status("编号 AB1234567890123") == "review_required"
    assert status("nothing here") == "passed"


def test_packing():
    def block(text, heading="h", at=1):
        return {
            "text": text, "heading_path": [heading], "page": None, "page_end": None,
            "paragraph_start": at, "paragraph_end": at, "table_id": None,
        }

    chunks = chunking.pack_document([block("a" * 700, at=1), block("b" * 300, at=2), block("c" * 50, "k", 3)], 800, 120)
    assert [len(c["text"]) for c in chunks] == [700, 420, 50]
    assert chunks[1]["text"] == "a" * 120 + "b" * 300
    assert (chunks[1]["paragraph_start"], chunks[1]["paragraph_end"]) == (1, 2)
    assert chunks[2]["heading_path"] == ["k"] and chunks[2]["text"] == "c" * 50
    long = chunking.pack_document([block("x" * 2000)], 800, 120)
    assert all(len(c["text"]) <= 800 for c in long)
    assert len("".join(c["text"][120:] if i else c["text"] for i, c in enumerate(long))) == 2000


def test_capped_pieces():
    assert chunking.split_capped("一。" * 10, "text", 8) == ["一。" * 4, "一。" * 4, "一。" * 2]
    table = "head\n" + "r" * 9
    assert chunking.split_capped(table, "table", 10) == ["head", "head\nrrrrr", "head\nrrrr"]
    assert chunking.split_capped("h" * 12 + "\nrow", "table", 10) == ["h" * 10, "hh"]


def test_locators_move_forward(spark):
    schema = (
        "version_id string, blocks array<struct<key: string, paragraph: int>>, elements array<struct<element_no: int, key: string>>"
    )
    document = ("v", [("abc", 1), ("abc", 4), ("def", 9)], [(1, "abc"), (2, "abcd"), (3, "abc"), (4, "ef")])
    rows = chunking.locate_elements(spark.createDataFrame([document], schema)).collect()
    assert [(r[1], r[2], r[3]) for r in rows] == [(1, 1, 1), (2, 4, 9), (3, None, None), (4, 9, 9)]


def test_few_documents_are_python_objects_at_once():
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"n": list(range(1000))})
    parts = list(chunking._slices(iter([batch, batch.slice(0, 0), batch.slice(990)])))
    assert max(p.num_rows for p in parts) <= chunking._AT_ONCE
    assert [n for p in parts for n in p["n"].to_pylist()] == [*range(1000), *range(990, 1000)]
