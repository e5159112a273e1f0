"""op4: toxicity of every document, learned from the labels of three of four folds."""

from pyspark.sql import functions as F

from .common import fold, table
from .toxic_lexicon import fit, toxicity


def labelled(spark, sf_dir, docs, max_docs=20_000):
    """Texts with labels, outside the held-out fold: a sample by a hash of the id at a rate that gives ``max_docs``, all
    where there are fewer. Its ids are few enough to broadcast, so no text moves."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("label_id"), "toxic").where(fold(F.col("doc_id"), 4) != 2)
    rate = min(1.0, max_docs / max(1, labels.count()))
    some = labels.where(F.pmod(F.xxhash64("label_id"), F.lit(1_000_000)) < F.lit(int(rate * 1_000_000)))
    return docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("label_id")).select("text", "toxic")


def op4_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(labelled(spark, sf_dir, docs))
    scored = docs.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), toxicity(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


QUERIES = {"op4_toxicity": op4_toxicity}
SQL: dict[str, str] = {}
