"""op3: near duplicates of all documents on 2-word shingles."""

from .common import table
from .minmax_dedup import near_duplicates


def op3_minmax_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, percent=80)


QUERIES = {"op3_minmax_dedup": op3_minmax_dedup}

SQL = {
    "op3_minmax_dedup": r"""
WITH RECURSIVE w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \x09-\x0D]+') AS words FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) = 1 THEN words
    ELSE list_distinct(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
r(node, reach) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.node, CASE WHEN e.a = r.reach THEN e.b ELSE e.a END FROM r JOIN e ON e.a = r.reach OR e.b = r.reach),
c AS (SELECT node, min(reach) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN c ON c.node = d.doc_id"""
}
