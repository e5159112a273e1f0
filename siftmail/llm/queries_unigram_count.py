"""op10: unigram piece counts of every document."""

import public_tokenizers
from pyspark.sql import functions as F

from .common import table
from .unigram_count import piece_counts, vocabulary


def op10_token_counts(spark, sf_dir, path=None):
    pieces = vocabulary(path or public_tokenizers.path("piece_bpe_32k.model"))
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), piece_counts(F.col("text"), pieces).alias("c")).select(
        "doc_id", "n_bytes", F.col("c.n_tokens").alias("n_tokens"), F.col("c.score").alias("score")
    )


QUERIES = {"op10_token_counts": op10_token_counts}
SQL: dict[str, str] = {}
