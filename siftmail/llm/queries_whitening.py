"""op12: whitening of all embeddings."""

from .common import table
from .whitening import whiten


def op12_whitening(spark, sf_dir):
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {"op12_whitening": op12_whitening}
SQL: dict[str, str] = {}
