"""op6: every document stored as FLAC, read back and described; a stream that could not be read says why in ``error``."""

from pyspark.sql import functions as F

from .common import table
from .media import with_flac, with_pcm


def op6_flac_media(spark, sf_dir):
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    n = F.octet_length("raw")
    pad = F.when((n > 0) & (n % 64 == 0), 0).otherwise(64 - n % 64)
    docs = table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw"))
    padded = docs.select("doc_id", n.cast("long").alias("n_bytes"), F.concat("raw", F.substring(F.lit(bytes(64)), F.lit(1), pad)).alias("payload"))
    back = with_pcm(with_flac(padded))
    payload = F.unhex(F.array_join(F.transform("blocks", lambda b: F.hex(b["pcm"])), ""))
    out = back.select("doc_id", "n_bytes", "media", "feature", "error", payload.alias("payload"))
    return out.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), "feature", "error",
    )


QUERIES = {"op6_flac_media": op6_flac_media}
SQL: dict[str, str] = {}
