"""Registered genomics queries against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from genoflux.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: One query of each family; the rest are compared by the driver.
CHECKED = ["s1_s2_unpivot_and_decode", "s8_clades", "a2_a3_a4_a5_site_alleles", "a6_genotypes", "a9_a13_core_positions", "j1_j2_pair_differences", "j3_core_segments", "j5_u4_clonal_pairs", "j13_recombined_pairs", "g1_to_g8_pair_summary", "x1_x2_block_summary", "e3_general_thinning", "e11_binned_curve", "r1_r4_species_rates", "f1_f7_j18_purifying_loss", "v2_v3_v4_p14_labelled_sites", "k2_spearman", "f9_f10_two_class_fit", "j14_deduplicated_pairs", "a11_codon_annotation", "k3_c9_p_values", "j10_pair_similarity", "s13_species"]


def same(a, b):
    if a is None or b is None or a != a or b != b:
        return (a is None or a != a) and (b is None or b != b)
    if isinstance(a, float) or isinstance(b, float):
        return math.isclose(float(a), float(b), rel_tol=1e-6, abs_tol=2e-6)
    return a == b


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    got = registry.QUERIES[name](spark, SF)
    want = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    key = lambda r: tuple(repr(x) for x in r if not isinstance(x, float))
    left = sorted((tuple(r) for r in got.select(*names).collect()), key=key)
    right = sorted(want.fetchall(), key=key)
    assert len(left) == len(right)
    assert all(same(x, y) for a, b in zip(left, right) for x, y in zip(a, b))


def test_every_query_is_registered_once():
    assert len(registry.QUERIES) >= 80
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
