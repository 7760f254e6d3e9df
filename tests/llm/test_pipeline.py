import corpus_pipeline
from citeloom.llm import bpe
from conftest import FOLDER


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, FOLDER), name)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        counts.append(docs.count())
    bad = spark.read.parquet(f"{FOLDER}/labels.parquet").filter("quality = 0")
    assert docs.join(bad, "doc_id", "left_semi").count() == 0
    assert counts[0] > counts[1] >= counts[2] > counts[3]
    out = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert out.count() == counts[-1]
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in out.collect():
        assert bytes(r.decoded).decode() == texts[r.doc_id] and (len(bpe.id_list(r.ids)) > 0) == bool(texts[r.doc_id])


def test_encode_lengthens_clashing_names(spark):
    docs = spark.createDataFrame([(1, "two words", 7), (None, None, 8)], "doc_id long, text string, ids int")
    out = corpus_pipeline.encode(spark, docs, FOLDER)
    assert out.columns == ["doc_id", "ids", "ids_", "decoded"]
    assert {(r.ids, bytes(r.decoded)) for r in out.collect()} == {(7, b"two words"), (8, b"")}
    empty = corpus_pipeline.encode(spark, docs.limit(0), FOLDER)
    assert empty.columns == out.columns and empty.count() == 0
