"""op2: host-level quality rules over all documents."""

from .common import table
from .host_rules import judge


def op2_host_rules(spark, sf_dir):
    out = judge(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_docs", "host_failed", "host_failing")


QUERIES = {"op2_host_rules": op2_host_rules}

SQL = {
    "op2_host_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^ \x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \x09-\x0D]')) AS lines,
             len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols FROM d),
win AS (SELECT r, i, words[i] AS a, words[i + 1] AS b, words[i + 2] AS c
        FROM (SELECT r, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
rep AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM win) WHERE n > 1),
cov AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY r),
f AS (SELECT d.r, d.doc_id, d.host, len(words)::BIGINT AS n_words,
             coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
             n_symbols::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM d JOIN w USING (r) LEFT JOIN cov USING (r)),
g AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
             n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 20 * n_words
               OR 100 * n_dup_lines > 30 * n_lines AS rule_failed FROM f),
h AS (SELECT host, count(*) AS host_docs, count(*) FILTER (rule_failed) AS host_failed FROM g GROUP BY host),
t AS (SELECT sum(host_failed)::DOUBLE / sum(host_docs) AS m, count(*) AS k, sum(host_docs)::DOUBLE AS n,
             sum(host_failed::DOUBLE * host_failed / host_docs) / sum(host_docs) AS q FROM h),
p AS (SELECT m, greatest(1.0, least(1e6, m * (1 - m) / greatest(q - m * m - m * (1 - m) * k / n, 1e-9) - 1)) AS s FROM t),
r AS (SELECT host, host_docs, host_failed, m, (host_failed + m * s) / (host_docs + s) AS rate, s FROM h, p),
v AS (SELECT host, host_docs, host_failed, low * (1 - m) > 3 * m * (1 - low) AS host_failing
      FROM (SELECT *, greatest(0.0, rate - 1.645 * sqrt(rate * (1 - rate) / (host_docs + s + 1))) AS low FROM r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT host_failing AS kept, host_docs::BIGINT AS host_docs, host_failed::BIGINT AS host_failed, host_failing
FROM g JOIN v ON g.host IS NOT DISTINCT FROM v.host"""
}
