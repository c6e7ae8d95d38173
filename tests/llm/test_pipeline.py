"""The pipeline stage by stage, and its registration."""

import __spark_entry__
import corpus_pipeline
from netpanel.llm import langid
from netpanel.llm.common import materialize


def test_stages(spark, docs):
    have, counts = docs, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        have = materialize(stage(spark, have, ""), name)
        assert have.columns == docs.columns
        counts.append(have.count())
    assert counts == sorted(counts, reverse=True)
    out = corpus_pipeline.STAGES[-1][1](spark, have, "")
    assert {r.doc_id for r in out.select("doc_id").distinct().collect()} == {r.doc_id for r in have.select("doc_id").distinct().collect()}


def test_empty(spark, empty, tmp_path):
    empty.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_texts_stay_where_no_language_can_be_learned(spark):
    rows = [(1, "two words", None), (2, "12 34", None), (None, "Ärger", None), (4, None, None), (5, "", None)]
    got = langid.known_only(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    assert sorted(r.text for r in got) == ["two words", "Ärger"]


def test_registered():
    q = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in q) for k in range(1, 11)] == [1] * 10 and "pipeline" in q
    assert set(__spark_entry__.oracle_sql()) <= set(q)
