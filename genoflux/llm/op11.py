"""Query op11_warc and its SQL."""

from .common import read
from .warc import archived


def op11_warc(spark, sf_dir):
    return archived(read(spark, sf_dir, "pages"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM q),
t AS (SELECT *, payload_bytes >= 100 AND (page_id > first OR (page_id IS NULL AND first IS NOT NULL)) AS again FROM r)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first END AS refers_to
FROM t
"""
