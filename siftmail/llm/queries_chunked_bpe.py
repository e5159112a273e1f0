"""op5: byte-level BPE of every document, and back."""

import public_tokenizers
from pyspark.sql import functions as F

from .chunked_bpe import decode, encode, ranks_from_tiktoken
from .common import table


def op5_chunked_bpe(spark, sf_dir, path=None):
    ranks = ranks_from_tiktoken(path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    both = decode(encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN), ranks)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op5_chunked_bpe": op5_chunked_bpe}
SQL: dict[str, str] = {}
