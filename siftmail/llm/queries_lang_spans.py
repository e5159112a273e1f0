"""op9: the language of every document, learned from three of four folds."""

from pyspark.sql import functions as F

from .common import fold, table
from .lang_spans import fit, language_of


def op9_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold(F.col("doc_id"), 4) != 2))
    return docs.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), language_of(F.col("text"), model).alias("p")).select(
        "doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score")
    )


QUERIES = {"op9_language_id": op9_language_id}
SQL: dict[str, str] = {}
