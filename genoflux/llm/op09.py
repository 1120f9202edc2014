"""Query op9_ngram_jaccard_join and its SQL."""

from .common import read
from .ngram_join import jaccard_components


def op9_ngram_jaccard_join(spark, sf_dir):
    return jaccard_components(read(spark, sf_dir, "documents"), 5, "0.8")


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS n_both FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM o JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)),
c AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT c.a, l.v FROM c JOIN l ON l.u = c.b),
m AS (SELECT a, min(b) AS component_id FROM c GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.a = d.doc_id
"""
