"""The derived views and operators as DuckDB SQL, for the oracle."""

from __future__ import annotations

_BASE = "substr('ACGT', CAST(({}) % 4 + 1 AS INT), 1)"
_PART = {"core": "true", "recomb": "inside", "clonal": "NOT inside"}


def _summary_columns() -> str:
    out = ["CAST(count(*) AS BIGINT) AS core_len", "CAST(count(*) FILTER (differ) AS BIGINT) AS core_diff"]
    for part, w in _PART.items():
        for n, k in (("4d", "4D"), ("1d", "1D")):
            out += [f"CAST(count(*) FILTER ({w} AND site_type = '{k}') AS BIGINT) AS {part}_len_{n}", f"CAST(count(*) FILTER ({w} AND site_type = '{k}' AND differ) AS BIGINT) AS {part}_diff_{n}"]
        for t in ("n", "m", "nn"):
            out += [f"CAST(count(*) FILTER ({w} AND site_type = '1D' AND differ AND mut_type = '{t}') AS BIGINT) AS {part}_mut_{t}", f"CAST(coalesce(sum({t}) FILTER ({w} AND site_type = '1D'), 0) AS BIGINT) AS {part}_{t}"]
    return ", ".join(out)


#: name: (SQL, names it needs)
VIEWS: dict[str, tuple[str, list[str]]] = {
    "calls": (f"""SELECT r_name AS species, l_suppkey AS sample_id, p_brand AS contig, l_partkey AS location, {_BASE.format("l_partkey")} AS ref_base,
        CASE WHEN min(l_quantity) >= 46 THEN {_BASE.format("l_partkey + 1")} WHEN min(l_quantity) <= 1 THEN {_BASE.format("l_partkey + 2")} ELSE {_BASE.format("l_partkey")} END AS allele
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey
        GROUP BY r_name, l_suppkey, p_brand, l_partkey""", []),
    "sites": ("""SELECT p_brand AS contig, p_partkey AS location, CAST(row_number() OVER (ORDER BY p_brand, p_partkey) - 1 AS BIGINT) AS core_pos,
        CASE p_partkey % 3 WHEN 0 THEN '4D' WHEN 1 THEN '1D' ELSE 'other' END AS site_type FROM part""", []),
    "mutations": (f"""SELECT contig, location, {_BASE.format("b")} AS base, CASE site_type WHEN '4D' THEN 's' ELSE CASE (location + b) % 7 WHEN 0 THEN 'n' WHEN 1 THEN 'nn' ELSE 'm' END END AS mut_type
        FROM sites, (SELECT unnest([0, 1, 2, 3]) AS b) WHERE b <> location % 4 AND site_type <> 'other'""", ["sites"]),
    "opps": ("""SELECT contig, location, count(*) FILTER (mut_type = 's') AS s, count(*) FILTER (mut_type = 'n') AS n, count(*) FILTER (mut_type = 'm') AS m, count(*) FILTER (mut_type = 'nn') AS nn
        FROM mutations GROUP BY contig, location""", ["mutations"]),
    "counted": ("SELECT species, contig, location, ref_base, allele, count(*) AS n FROM calls GROUP BY ALL", ["calls"]),
    "grouped": ("SELECT species, contig, location, ref_base, count(*) AS n_alleles, list({'a': allele, 'n': n} ORDER BY allele) AS a FROM counted GROUP BY ALL", ["counted"]),
    "majors": ("""SELECT species, contig, location, ref_base, n_alleles, a, CASE n_alleles WHEN 1 THEN 'mono' WHEN 2 THEN 'bi' ELSE 'multi' END AS site_class,
        CASE WHEN n_alleles = 1 THEN a[1].a WHEN n_alleles = 2 THEN CASE WHEN a[1].n > a[2].n OR (a[1].n = a[2].n AND a[1].a = ref_base) THEN a[1].a ELSE a[2].a END END AS major FROM grouped""", ["grouped"]),
    "alleles": ("""SELECT species, contig, location, ref_base, n_alleles, site_class, major,
        CASE WHEN n_alleles = 1 THEN ref_base WHEN n_alleles = 2 THEN CASE WHEN major = a[1].a THEN a[2].a ELSE a[1].a END END AS alt FROM majors""", ["majors"]),
    "genotypes": ("""SELECT c.species, c.contig, c.location, sample_id, CASE WHEN c.ref_base <> major THEN 1 - CAST(allele <> c.ref_base AS INT) ELSE CAST(allele <> c.ref_base AS INT) END AS genotype
        FROM calls c JOIN alleles a ON (c.species, c.contig, c.location) = (a.species, a.contig, a.location) WHERE site_class <> 'multi'""", ["calls", "alleles"]),
    "snvtypes": ("""SELECT a.species, a.contig, a.location, a.alt, mut_type FROM alleles a LEFT JOIN mutations m ON m.contig = a.contig AND m.location = a.location AND m.base = a.alt WHERE site_class = 'bi'""", ["alleles", "mutations"]),
    "pairs": ("""SELECT DISTINCT a.species, a.sample_id AS sample_1, b.sample_id AS sample_2 FROM calls a JOIN calls b ON a.species = b.species AND a.contig = b.contig AND a.location = b.location AND a.sample_id < b.sample_id""", ["calls"]),
    "transfers": ("""SELECT species, sample_1, sample_2, start_pos, CAST(least(start_pos + t.n // 10, t.n - 1) AS BIGINT) AS end_pos FROM (
        SELECT species, sample_1, sample_2, unnest([(37 * sample_1 + 11 * sample_2) % n, ((37 * sample_1 + 11 * sample_2) % n + n // 20) % n]) AS start_pos, n FROM pairs, (SELECT count(*) AS n FROM part) WHERE (sample_1 + sample_2) % 3 <> 0) t""", ["pairs"]),
    "psites": ("""SELECT a.species, a.sample_id AS sample_1, b.sample_id AS sample_2, a.contig, a.location, a.genotype <> b.genotype AS differ
        FROM genotypes a JOIN genotypes b ON a.species = b.species AND a.contig = b.contig AND a.location = b.location AND a.sample_id < b.sample_id""", ["genotypes"]),
    "annotated": ("""SELECT p.*, s.core_pos, s.site_type, t.mut_type, o.n, o.m, o.nn,
        EXISTS (SELECT 1 FROM transfers x WHERE x.species = p.species AND x.sample_1 = p.sample_1 AND x.sample_2 = p.sample_2 AND s.core_pos BETWEEN x.start_pos AND x.end_pos) AS inside
        FROM psites p JOIN sites s ON s.contig = p.contig AND s.location = p.location LEFT JOIN snvtypes t ON t.species = p.species AND t.contig = p.contig AND t.location = p.location
        LEFT JOIN opps o ON o.contig = p.contig AND o.location = p.location""", ["psites", "sites", "snvtypes", "opps", "transfers"]),
    "summary": (f"SELECT species, sample_1, sample_2, {_summary_columns()} FROM annotated GROUP BY species, sample_1, sample_2", ["annotated"]),
    "half": ("""SELECT species, sample_a, sample_b, count(*) FILTER (NOT d) / count(*) AS frac FROM (
        SELECT a.species, a.sample_id AS sample_a, b.sample_id AS sample_b, a.contig, bool_or(a.allele <> b.allele) AS d FROM calls a JOIN calls b ON a.species = b.species AND a.contig = b.contig AND a.location = b.location AND a.sample_id < b.sample_id
        GROUP BY ALL) GROUP BY species, sample_a, sample_b""", ["calls"]),
    "samples": ("SELECT DISTINCT species, sample_id FROM calls", ["calls"]),
    "similarity": ("SELECT * FROM half UNION ALL SELECT species, sample_b, sample_a, frac FROM half UNION ALL SELECT species, sample_id, sample_id, 1.0 FROM samples", ["half", "samples"]),
    "clades": ("SELECT sample_id, CASE WHEN sample_id % 4 <> 0 THEN 'major' ELSE 'minor' END AS clade FROM samples", ["samples"]),
    "classes": ("""SELECT species, sample_1, sample_2, unnest([{'mut_class': 'all', 'kn': clonal_diff_1d, 'ln': CAST(clonal_len_1d AS DOUBLE)}, {'mut_class': 'missense', 'kn': clonal_mut_m, 'ln': clonal_m / 3},
        {'mut_class': 'nonsense', 'kn': clonal_mut_n, 'ln': clonal_n / 3}], recursive := true), clonal_diff_4d AS ks, CAST(clonal_len_4d AS DOUBLE) AS ls FROM summary""", ["summary"]),
    "thin": ("""SELECT *, ks - ks_a AS ks_b, ls * 0.5 AS ls_a, ls * 0.5 AS ls_b, ks_a / greatest(ls * 0.5, 1e-12) AS ds_a, (ks - ks_a) / greatest(ls * 0.5, 1e-12) AS ds_b FROM (
        SELECT *, CAST(coalesce(list_sum(list_transform(range(0, (ks + 31) // 32), lambda i: bit_count(('0x' || substr(md5(concat_ws('|', '42', species, sample_1, sample_2, i)), 1, 8))::BIGINT & ((1::BIGINT << CAST(least(32, ks - 32 * i) AS INT)) - 1)))), 0) AS BIGINT) AS ks_a FROM classes)""", ["classes"]),
    "edges": ("""SELECT list_append(list_transform(range(0, 6), lambda i: lo * pow(hi / lo, i / 6)), hi) AS e FROM (SELECT min(ds_a) FILTER (ds_a > 0) AS lo, max(ds_a) FILTER (ds_a > 0) AS hi FROM thin)""", ["thin"]),
    "binned": ("""SELECT *, CASE WHEN ds_a >= e[1] AND ds_a <= e[-1] THEN CAST(greatest(len(list_filter(e, lambda v: v < ds_a)) - 1, 0) AS BIGINT) END AS bin FROM thin, edges""", ["thin", "edges"]),
    "curve": ("""SELECT mut_class, bin, CAST(sum(kn) AS BIGINT) AS kn, sum(ln) AS ln, CAST(sum(ks_a) AS BIGINT) AS ks_a, CAST(sum(ks_b) AS BIGINT) AS ks_b, sum(ls_a) AS ls_a, sum(ls_b) AS ls_b, count(*) AS n_pairs,
        CASE WHEN sum(ls_a) > 0 THEN sum(ks_a) / sum(ls_a) END AS ds_x, CASE WHEN sum(ln) > 0 AND sum(ls_b) > 0 AND sum(ks_b) > 0 THEN (sum(kn) / sum(ln)) / (sum(ks_b) / sum(ls_b)) END AS r_hat
        FROM binned WHERE bin IS NOT NULL GROUP BY mut_class, bin""", ["binned"]),
}


def sql(body: str, *views: str) -> str:
    """WITH the views named and all that they need."""
    order: list[str] = []

    def need(v: str):
        for x in VIEWS[v][1]:
            need(x)
        if v not in order:
            order.append(v)

    for v in views:
        need(v)
    head = ", ".join(f"{v} AS MATERIALIZED ({VIEWS[v][0]})" for v in order)
    return f"WITH {head} {body}" if order else body
