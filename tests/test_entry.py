from tests.conftest import SF0001


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["id", "split", "label", "prediction", "p1", "score"]


def test_every_oracle_has_a_query():
    import __spark_entry__ as E
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.oracle_sql()) >= 40


def test_smote_rows_on_segment(spark):
    import numpy as np
    from rareflag.operators.balance import smote
    from rareflag.sources.tables import read_table
    e = read_table(spark, SF0001, "embeddings", ["vec_id", "embedding", "label"])
    s = smote(e, "label", "embedding", id_col="vec_id").collect()
    vecs = {r.vec_id: np.asarray(r.embedding, dtype=float) for r in e.collect()}
    for r in s[:50]:
        x, n = vecs[r.base_id], vecs[r.neighbor_id]
        assert np.allclose(np.asarray(r.embedding), x + r.u * (n - x))
