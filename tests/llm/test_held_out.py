"""What the learned operators make of documents that they did not learn from."""

from siftmail.llm import registry

SF = "/root/testdata/sf0.1"
Q = registry.queries()


def test_language(spark):
    truth = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    got = Q["op9_language_id"](spark, SF).toPandas().merge(truth, on="doc_id")
    own = got[got.held_out & got.lang.notna()]
    assert len(own) > 2000 and (own.lang == own.lang_pred).mean() > 0.99
    assert got.score.between(0, 1).all()


def test_toxicity(spark):
    truth = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic").toPandas()
    got = Q["op4_toxicity"](spark, SF).toPandas()
    assert len(got) == 10_000 and got.score.between(0, 1).all() and ((got.score >= 0.3) == (got.predicted == 1)).all()
    own = got[got.held_out].merge(truth, on="doc_id")
    assert own[own.toxic == 1].predicted.mean() > 0.8 and own[own.toxic == 0].predicted.mean() < 0.03


def test_language_model(spark):
    got = Q["op8_hidden_markov"](spark, "/root/testdata/sf0.01").toPandas()
    own = got[got.held_out]
    assert len(own) > 150 and own.score.sum() / own.n_tokens.sum() > own.base_score.sum() / own.n_tokens.sum() + 0.1
