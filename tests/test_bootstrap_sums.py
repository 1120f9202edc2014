"""Draws are spread over tasks, and summed with their classes in columns; edges with repeats."""

from pyspark.sql import functions as F

from genoflux.functions import expressions as X
from genoflux.operators import estimators as E
from genoflux.operators import models as M

_SUMMARY = "species string, sample_1 long, sample_2 long, clonal_diff_1d long, clonal_len_1d long, clonal_mut_m long, clonal_m long, clonal_mut_n long, clonal_n long, clonal_diff_4d long, clonal_len_4d long"


def test_draws_are_spread_by_number(spark):
    sizes = spark.createDataFrame([("g", 1000)], "g string, size long")
    plan = E._part_draws(sizes, "g", 2, 1)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "REPARTITION_BY_COL" not in plan  # the latter is merged into one task


def test_sums_of_columns_are_sums_of_rows(spark):
    rows = [("ab"[i % 2], i, i + 1, i % 5, i % 7, i % 3, 3 * (i % 4), i % 2, i % 3, (i * 7) % 90, 60 + i % 9) for i in range(200)]
    s = spark.createDataFrame(rows, _SUMMARY)
    ids = ("species", "sample_1", "sample_2")
    tall = E.split_by_thinning(E.by_class(s), 0.5, F.lit(42), *ids)
    wide = E.split_by_thinning(E.beside(s, [*ids]), 0.5, F.lit(42), *ids)
    edges = F.array(*(F.lit(0.01 * 2.0**i) for i in range(7)))
    tall, wide = tall.withColumn("bin", E.bin_of("ds_a", edges)), wide.withColumn("bin", E.bin_of("ds_a", edges, 6))
    key, cols = ["species", "mut_class"], ["bin", "kn", "ks_a", "ks_b", "n_pairs", "ds_x", "r_hat"]
    show = lambda d: sorted([tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in d.select(*key, *cols).collect()], key=repr)
    assert show(E.pooled_bins(tall, key)) == show(E.pooled_sums(E.class_sums(wide, ["species", "bin"]), key)) != []
    early = E.class_sums(wide.withColumn("early", M.is_early(0.3)), ["species", "early"]).where("early")
    shares = lambda d: sorted((*r[:3], round(r.mean_ds, 9), round(r.alpha2, 9)) for r in d.select(*key, "n_pairs", "mean_ds", "alpha2").collect())
    assert shares(M.early_share(tall, key, 0.3)) == shares(M.early_share_of_sums(early, key)) != []


def test_short_and_long_counts_are_thinned_alike(spark):
    import hashlib

    got = spark.range(0, 100).select("id", X.thinned_half("id", F.lit(42), F.lit("k")).alias("a")).collect()
    word = lambda i: int(hashlib.md5(f"42|k|{i}".encode()).hexdigest()[:8], 16)
    want = lambda k: sum(bin(word(i) & ((1 << min(32, k - 32 * i)) - 1)).count("1") for i in range((k + 31) // 32))
    assert all(r.a == want(r.id) for r in got)


def test_equal_count_edges_keep_repeats_where_asked(spark):
    df = spark.createDataFrame([(1.0,)] * 3 + [(2.0,)] * 8 + [(5.0,)], "x double")
    assert E.quantile_edges(df, [], "x", 4, repeats=True).first().e == [1.0, 1.75, 2.0, 2.0, 5.0]
    assert E.quantile_edges(df, [], "x", 4).first().e == [1.0, 1.75, 2.0, 5.0]
