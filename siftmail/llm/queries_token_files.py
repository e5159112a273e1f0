"""op13: ids of every document as flat files, and what these files hold."""

import uuid

import public_tokenizers
from pyspark.sql import functions as F

from .common import own, scratch_dir, table
from .token_files import read_tokens, write_words


def op13_token_files(spark, sf_dir, path=None):
    with open(path or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    out = f"{scratch_dir(spark)}/siftmail-token-files-{uuid.uuid4().hex}"
    own([out])  # released with the scratch tables
    write_words(table(spark, sf_dir, "documents"), spec, out, end_id=2)
    return read_tokens(spark, out).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op13_token_files": op13_token_files}
SQL: dict[str, str] = {}
