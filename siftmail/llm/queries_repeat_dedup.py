"""op7: repeated 200-byte strings removed from all documents."""

from pyspark.sql import functions as F

from .common import table
from .repeat_dedup import remove_repeats, text_key


def op7_suffix_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = remove_repeats(docs).select("id", "x", "n_removed", "n_spans", F.sha2("kept", 256).alias("cut_sha256"))
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", *text_key(docs), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("sha256"))
    zero = F.lit(0).cast("long")
    return rows.join(cut, ["id", "x"], "left").select(
        "doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("cut_sha256", "sha256").alias("kept_sha256")
    )


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
SQL = {
    "op7_suffix_dedup": r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (SELECT r, i, md5(substring(h, 2 * i + 1, 400)) AS m FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d)),
rep AS (SELECT r, i FROM k QUALIFY count(*) OVER (PARTITION BY m) > 1),
isl AS (SELECT r, i, sum(CASE WHEN i > p + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS g
        FROM (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS p FROM rep)),
spans AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM isl GROUP BY r, g),
cut AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS z FROM spans),
s AS (SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substring(h, (2 * z + 1)::BIGINT, (2 * (a - z))::BIGINT), '' ORDER BY a) AS head
      FROM cut JOIN d USING (r) GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(head, '') || substring(h, (2 * coalesce(last, 0) + 1)::BIGINT))) AS kept_sha256
FROM d LEFT JOIN s USING (r)"""
}
