"""Query op13_merkle and its SQL."""

from pyspark.sql import functions as F

from .common import read
from .merkle import manifest

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op13_merkle(spark, sf_dir):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    claimed = F.when(tampered, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    return manifest(read(spark, sf_dir, "documents"), claimed).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def _coded(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE CAST(strlen(CAST({value} AS VARCHAR)) AS VARCHAR) || ':' || CAST({value} AS VARCHAR) END"


def _leaf(text: str) -> str:
    return f"sha256({' || '.join(map(_coded, ('doc_id', 'source', 'lang', 'n_chars', text)))})"


def _sql(levels: int = 7) -> str:
    """Trees of up to 16 ** levels leaves a source and as many sources."""
    # crc32 bit by bit: the digits' bits, lowest first, shifted through the register
    bits = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_transform(range(8), lambda k: (ascii(c) >> k) & 1)))"
    crc = f"xor(list_reduce(list_prepend(4294967295, {bits}), lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384)), 4294967295)"
    lower = f"CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN translate(text, '{UPPER}', '{LOWER}') ELSE text END"
    out = [
        f"d AS (SELECT *, row_number() OVER () AS r, {_leaf('text')} AS leaf, {_leaf('low')} AS claimed FROM (SELECT *, {lower} AS low FROM documents))",
        "s0 AS (SELECT r, source AS g, row_number() OVER w - 1 AS pos, count(*) OVER (PARTITION BY source) AS n, leaf AS h FROM d WINDOW w AS (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, r))",
    ]

    def tree(t: str, last: int) -> None:
        for i in range(last):
            out.append(f"{t}{i}p AS (SELECT x.*, coalesce((SELECT string_agg(y.h, '' ORDER BY y.pos) FROM {t}{i} y WHERE y.g IS NOT DISTINCT FROM x.g AND y.pos // 16 = x.pos // 16 AND y.pos < x.pos), '') AS l, coalesce((SELECT string_agg(y.h, '' ORDER BY y.pos) FROM {t}{i} y WHERE y.g IS NOT DISTINCT FROM x.g AND y.pos // 16 = x.pos // 16 AND y.pos > x.pos), '') AS r2 FROM {t}{i} x WHERE n > 1)")
            out.append(f"{t}{i + 1} AS (SELECT NULL AS r, g, pos // 16 AS pos, any_value((n + 15) // 16) AS n, sha256(string_agg(h, '' ORDER BY pos)) AS h FROM {t}{i} WHERE n > 1 GROUP BY g, pos // 16)")
        out.append(f"{t}top AS ({' UNION ALL '.join(f'SELECT g, h FROM {t}{i} WHERE n = 1' for i in range(last + 1))})")

    tree("s", levels)
    out.append("u0 AS (SELECT g AS r, 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos, count(*) OVER () AS n, h FROM stop)")
    tree("u", levels)

    def fold(t: str, base: str, key: str, last: int, proof: str, node: str) -> str:
        """Adds a tree's levels to the proof and the folded nodes of base, whose g and pos are those of its leaves."""
        for i in range(last):
            out.append(f"{t}f{i} AS (SELECT b.* REPLACE (b.proof || coalesce(p.l || p.r2, '') AS proof, CASE WHEN p.pos IS NULL THEN b.node ELSE sha256(p.l || b.node || p.r2) END AS node, b.pos // 16 AS pos) FROM {base} b LEFT JOIN {t}{i}p p ON p.g IS NOT DISTINCT FROM b.g AND p.pos = b.pos)")
            base = f"{t}f{i}"
        return base

    out.append("b0 AS (SELECT d.doc_id, d.leaf, s0.g, s0.pos, '' AS proof, d.claimed AS node FROM d JOIN s0 USING (r))")
    low = fold("s", "b0", "g", levels, "proof", "node")
    out.append(f"b1 AS (SELECT b.doc_id, b.leaf, t.h AS subroot, 0 AS g, u.pos, b.proof, b.node FROM {low} b JOIN stop t ON t.g IS NOT DISTINCT FROM b.g JOIN u0 u ON u.r IS NOT DISTINCT FROM b.g)")
    high = fold("u", "b1", "g", levels, "proof", "node")
    return f"WITH {', '.join(out)} SELECT b.doc_id, b.leaf, b.subroot, r.h AS root, sha256(b.proof) AS proof_sha256, b.node AS folded_root, b.node = r.h AS verified FROM {high} b CROSS JOIN utop r"


SQL = _sql()
