"""Pairs are summed where their first sample's rows lie: no row a pair and site is shuffled."""

import random
import re

import pytest
from pyspark.sql import functions as F

from genoflux.operators import pairs as P
from genoflux.operators import sites as S
from genoflux.plans.fixture import Fixture

SMALL = "/root/testdata/sf0.001"
_CALL = "species string, contig string, location long, sample_id long, ref_base string, allele string"


def _above(df, node: str) -> str:
    plan = re.sub(r"#\d+L?", "", df._jdf.queryExecution().executedPlan().toString())
    assert node in plan
    return plan[: plan.index(node)]


@pytest.fixture(scope="module")
def made(spark):
    """Calls of up to four alleles, the reference's among them or not, types and opportunities of their sites, and segments of some pairs."""
    rng = random.Random(3)
    calls = [(sp, "c", x, i, "A", rng.choice("ACGT"[: x % 4 + 1] if x % 5 else "CG")) for sp in "st" for x in range(150) for i in range(7) if rng.random() < 0.7]
    sites = [("c", x, x, rng.choice(["1D", "4D", "other"])) for x in range(150)]
    mutations = [("c", x, b, rng.choice(["s", "n", "m", "nn"])) for x in range(150) for b in "CGT"]
    seg = [(sp, a, b, lo, lo + 30) for sp in "st" for a in range(7) for b in range(a + 1, 7) if (a + b) % 3 for lo in (10 * a, 10 * a + 15, 100)]
    calls, sites, mutations = spark.createDataFrame(calls, _CALL), spark.createDataFrame(sites, "contig string, location long, core_pos long, site_type string"), spark.createDataFrame(mutations, "contig string, location long, base string, mut_type string")
    x = S.called_sites(calls).join(sites, ["contig", "location"]).join(S.effects(mutations), ["contig", "location"], "left")
    rows = P.dealt(P.partners(x.withColumn("mut_type", F.when(F.col("site_class") == "bi", F.expr("effects[alt]")))))
    return calls, sites, mutations, rows, spark.createDataFrame(seg, "species string, sample_1 long, sample_2 long, start_pos long, end_pos long")


def _sorted(df):
    return sorted(tuple(r) for r in df.collect())


def test_summary_agrees_with_plain_path(made):
    calls, sites, mutations, rows, seg = made
    alleles = S.site_alleles(calls)
    g = S.genotypes(calls, alleles).join(sites, ["contig", "location"]).join(S.opportunities(mutations), ["contig", "location"], "left")
    g = g.join(S.snv_types(alleles, mutations).select(*S.SITE, "mut_type"), S.SITE, "left")
    want = P.summary(P.in_segments(P.pair_sites(None, g, ("core_pos", "site_type", "n", "m", "nn", "mut_type")), seg))
    found = P.partnered_summary(rows, seg)
    assert _sorted(found.select(want.columns)) == _sorted(want)
    one = lambda lo: F.struct(lo.cast("long").alias("lo"), (lo + 30).cast("long").alias("hi"))
    made_in_row = F.when((F.col("sample_1") + F.col("sample_2")) % 3 != 0, F.array(*(one(lo) for lo in (10 * F.col("sample_1"), 10 * F.col("sample_1") + 15, F.lit(100)))))
    assert _sorted(P.partnered_summary(rows, made_in_row).select(want.columns)) == _sorted(want)
    core = [c for c in want.columns if c in P.PAIR or c.startswith("core_")]
    assert _sorted(P.partnered_counts(P.partnered(rows), P.PAIR).select(core)) == _sorted(want.select(core))


def test_pairs_meet_at_any_called_site(made):
    calls, rows = made[0], made[3]
    a, b = (calls.select("species", "location", F.col("sample_id").alias(f"sample_{i}")) for i in (1, 2))
    assert _sorted(P.met_pairs(rows)) == _sorted(a.join(b, ["species", "location"]).where("sample_1 < sample_2").select(*P.PAIR).distinct())


@pytest.mark.parametrize("view", ["partnered_summary", "pairs", "transfers"])
def test_pairs_are_not_shuffled(spark, view):
    node = "Generate explode(concat(alike, unlike))" if view != "partnered_summary" else "Generate inline(concat(transform(alike"
    assert "Exchange" not in _above(getattr(Fixture(spark, SMALL), view)(), node)


def test_core_counts_of_pairs_are_not_shuffled(spark):
    assert "Exchange" not in _above(Fixture(spark, SMALL).core_totals(*P.PAIR), "Generate inline(concat(transform(alike")


def test_segments_of_a_table_are_all_that_is_shuffled(made):
    rows, seg = made[3], made[4]
    assert "Exchange" not in _above(P.partnered_summary(rows, seg), "Generate inline(concat(transform(alike")


def test_fine_rates_shuffle_no_row_a_pair(spark):
    from genoflux.plans.registry import QUERIES

    plan = QUERIES["r3_fine_recombined_rates"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and "sample_2" in line]


def test_sites_of_calls_are_listed_without_lambdas_over_calls(spark):
    """Alleles are counted as calls are listed; a count within each call of a site was worked out again in every later filter."""
    calls = spark.createDataFrame([("s", "c", 1, i, "A", a) for i, a in enumerate("CCG")] + [("s", "c", 2, i, "A", a) for i, a in enumerate("ACG")], _CALL)
    got = {r.location: r for r in S.called_sites(calls).collect()}
    assert (got[1].site_class, got[1].major, got[1].alt, [c.is_ref for c in got[1].calls]) == ("bi", "C", "G", [False] * 3)
    assert (got[2].site_class, got[2].n_alleles, [c.sample_id for c in got[2].calls]) == ("multi", 3, [0, 1, 2])
    assert "lambda c" not in S.called_sites(calls).where("size(calls) > 1")._jdf.queryExecution().optimizedPlan().toString()


def test_similarity_agrees_with_masks_and_shuffles_no_pair(spark, made):
    calls, sites = made[0].withColumn("contig", F.concat("contig", F.col("location") % 3)), made[1]
    x = P.agreement(P.dealt(P.contig_partners(S.called_sites(calls))))
    at = calls.join(sites.select("location", "core_pos"), "location")
    d = P.contig_differences(at).groupBy("species", "sample_a", "sample_b").agg((F.count_if(~F.col("d")) / F.count("*")).alias("frac"))
    assert _sorted(x) == _sorted(d)
    plan = Fixture(spark, SMALL).similarity()._jdf.queryExecution().executedPlan().toString()
    assert not [line for line in plan.splitlines() if "Exchange" in line and ("sample_b" in line or "sample_2" in line)]


def test_ids_are_shuffled_as_distances_whatever_their_range(spark):
    """in 8 bytes an id and two lists a row, partners filled the disk at 60 copies."""
    gaps = [1, (1 << 14) - 1, 1 << 14, (1 << 30) - 1, 1 << 30, 1 << 62]
    groups = [(f"{lo}", [lo, lo + gap // 2, lo + gap]) for lo in (-(1 << 63), -5, 7) for gap in gaps] + [("wide", [-(1 << 63), 0, (1 << 63) - 1]), ("same", [4, 4, 9])]
    calls = [(f"{sp}-{k}", "c", k, i, "A", "CA"[j % 2]) for k, (sp, ids) in enumerate(groups) for j, i in enumerate(ids)]
    x = S.called_sites(spark.createDataFrame(calls, _CALL)).select("*", F.lit("1D").alias("site_type"), F.lit("m").alias("mut_type"), F.col("location").alias("core_pos"), *(F.lit(1).alias(t) for t in P.TYPES))
    plain = P.partners(x)
    rows = P.dealt(plain)
    assert _sorted(P.partnered(rows)) == _sorted(P.partnered(plain)) and rows.count() == 2 * len(groups)
    assert sorted(rows.columns) == sorted(plain.columns)
    narrow = P._narrowed(plain)
    assert dict(narrow.dtypes)["near"] == "array<smallint>" and dict(narrow.dtypes)["mid"] == "array<int>"
    assert narrow.where("near is not null").count() and narrow.where("mid is not null").count() and narrow.where("alike is not null").count()


def test_species_counts_shuffle_narrow_partners(spark):
    plan = Fixture(spark, SMALL).partnered_summary()._jdf.queryExecution().executedPlan().toString()
    assert "as smallint" in plan


def test_calls_are_not_shuffled_for_their_suppliers(spark):
    """without a broadcast, calls were shuffled by supplier and by location again after they lay by location."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = re.sub(r"#\d+L?", "", Fixture(spark, SMALL)._located_calls()._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange hashpartitioning" not in plan[: plan.index("REPARTITION_BY_NUM")]


def test_calls_at_untyped_sites_are_not_dealt_for_points(spark):
    """points read 1D and 4D sites alone, a third of the calls is at others."""
    fx = Fixture(spark, SMALL)
    x = fx.typed_totals(*P.PAIR)
    plan = re.sub(r"#\d+L?", "", x._jdf.queryExecution().optimizedPlan().toString())
    assert "& 3)" in plan[plan.index("RepartitionByExpression") :]
    both = "core_len_4d > 0 or core_len_1d > 0"
    assert _sorted(x) == _sorted(fx.core_totals(*P.PAIR).where(both).select(x.columns))
