"""op8: the hidden Markov model's log probability of every document, learned from four of five folds."""

from pyspark.sql import functions as F

from .common import fold, table
from .hidden_markov import score


def op8_hidden_markov(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = score(docs, fold(F.col("doc_id"), 5) != 1)
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op8_hidden_markov": op8_hidden_markov}
SQL: dict[str, str] = {}
