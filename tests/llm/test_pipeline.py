"""Every stage of the pipeline against what its operator says of its input."""

from lendmill.llm import language_id, mixing, toxicity
from lendmill.llm.registry import LLM_QUERIES, LLM_SQL

from .test_join import brute


def test_stages(spark, sf, tmp_path):
    import corpus_pipeline as cp

    folder = sf
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    columns, steps = docs.columns, []
    for name, stage in cp.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        steps.append((docs, spark.read.parquet(f"{tmp_path}/{name}")))
        docs = steps[-1][1]
    assert all(after.columns == columns for _, after in steps[:-1])
    ids = [({r.doc_id for r in a.select("doc_id").collect()}, {r.doc_id for r in b.select("doc_id").collect()}) for a, b in steps]
    model = toxicity.fit_toxicity(spark.read.parquet(f"{folder}/documents.parquet"), labels)
    assert ids[0][1] == {r.doc_id for r in toxicity.score_toxicity(steps[0][0], model).filter("predicted = 0").collect()}
    found = language_id.identify(steps[1][0], language_id.fit_language_id(steps[1][0]))
    assert ids[1][1] == {r.doc_id for r in found.filter("lang_pred <> 'und'").collect()}
    rows = [(r.doc_id, r.text) for r in steps[2][0].collect()]
    assert ids[2][1] == {c if n else i for i, n, c in brute(rows)}
    assert ids[3][1] == {r.doc_id for r in mixing.mixed_report(steps[3][0]).collect()}
    assert ids[4][1] == ids[3][1]
    # Where documents are cut depends on which tails a task holds; that every token is packed once does not.
    whole = lambda pieces: sorted(map(tuple, pieces.groupBy("doc_id", "doc_tokens").sum("length").collect()))
    assert whole(cp.run(spark, folder)) == whole(steps[-1][1])


def test_registered_queries_have_the_contract_s_columns():
    assert {name.split("_")[0] for name in LLM_QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(LLM_SQL) <= set(LLM_QUERIES)
