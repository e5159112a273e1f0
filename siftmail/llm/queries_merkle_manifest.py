"""op11: a manifest of all documents, a proof for each, and proofs held against changed texts."""

from pyspark.sql import functions as F

from .common import fold as remainder
from .common import table
from .merkle_manifest import LEVELS, folded, leaf_digest, manifest


def op11_merkle_manifest(spark, sf_dir, height=LEVELS):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("grp"), "lang", "n_chars", "text")
    fields = [F.col(c) for c in ("doc_id", "grp", "lang", "n_chars")]
    shown = F.when(remainder(F.col("doc_id"), 2) == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    # what a reader presents: the leaf of the text as it is now
    payload = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lower(F.hex(leaf_digest(*fields, shown))))
    _, leaves = manifest(docs.select("grp", "doc_id", leaf_digest(*fields, F.col("text")).alias("digest"), payload.alias("payload")), ["doc_id"], height=height)
    out = folded(leaves.withColumn("presented", F.unhex(F.substring_index("payload", ":", -1))), "presented")
    text = lambda c: F.lower(F.hex(c))
    return out.select(
        F.nullif(F.substring_index("payload", ":", 1), F.lit("")).cast("long").alias("doc_id"), text("digest").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
        "proof_sha256", text("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


QUERIES = {"op11_merkle_manifest": op11_merkle_manifest}
SQL: dict[str, str] = {}
