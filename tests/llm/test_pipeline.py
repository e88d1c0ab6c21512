"""Each stage of the corpus pipeline against its brute-force version on the stage's own input."""

import corpus_pipeline as cp
from tests.conftest import SF0001
from tests.llm.test_operators import brute_components, brute_winnow


def test_stages(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    steps = [docs]
    for name, stage in cp.STAGES[:-1]:
        steps.append(cp.written(stage(spark, steps[-1], SF0001), f"test-{name}"))
        assert steps[-1].columns == docs.columns
        assert steps[-1].exceptAll(steps[-2]).isEmpty()  # whole rows, none made
    ids = [{r.doc_id for r in s.collect()} for s in steps]
    texts = {r.doc_id: r.text for r in steps[2].collect()}
    assert ids[3] == {d for d, (_, _, kept) in brute_components(texts, 5).items() if kept}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF0001}/benchmark.parquet").collect()]
    texts = {r.doc_id: r.text for r in steps[3].collect()}
    assert ids[4] == {d for d, r in brute_winnow(texts, items).items() if not r[3]}
    good = {r.doc_id for r in spark.read.parquet(f"{SF0001}/labels.parquet").where("quality = 1 and toxic = 0").collect()}
    assert len(good & ids[1] - ids[2]) <= 0.05 * len(good & ids[1])  # clean documents stay
    assert {r.doc_id for r in cp.run(spark, SF0001).collect()} == ids[4]


def test_empty_and_repeated(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").limit(20)
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF0001).count() == 0
    twice = cp.near_dedup(spark, docs.union(docs), SF0001)
    assert twice.count() == cp.near_dedup(spark, docs, SF0001).count()
