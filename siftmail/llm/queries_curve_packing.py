"""op1: all documents packed into sequences of 1024 tokens."""

import public_tokenizers
from pyspark.sql import functions as F

from .chunked_bpe import ranks_from_json
from .common import table
from .curve_packing import pack


def op1_curve_packing(spark, sf_dir, path=None):
    ranks = ranks_from_json(path or public_tokenizers.path("byte_bpe_50k.json"))
    pieces = pack(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op1_curve_packing": op1_curve_packing}
SQL: dict[str, str] = {}
