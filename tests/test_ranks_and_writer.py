"""Ranks without a window over a whole group, and writes that end early."""

import random

import pytest
from pyspark.sql import functions as F

from genoflux.operators import stats as K
from genoflux.sources import tables as T


@pytest.mark.parametrize("keys", [["k"], []])
def test_mean_ranks_across_parts(spark, keys):
    """One group with most rows, ties that a range's end would fall among, and a value on a third of all rows."""
    rng = random.Random(2)
    rows = [("hot", rng.choice([0.0, rng.random(), rng.randint(1, 30) / 10])) for _ in range(3000)] + [("a", 1.0), ("b", 2.0), ("b", 2.0)]
    got = K.mean_ranks(spark.createDataFrame(rows, "k string, v double"), keys, "v").collect()
    want = {}
    for k in {r[0] for r in rows} if keys else {None}:
        mine = sorted(v for g, v in rows if k is None or g == k)
        places = {}
        for i, v in enumerate(mine):
            places.setdefault(v, []).append(i + 1)
        want |= {(k, v): sum(p) / len(p) for v, p in places.items()}
    assert {(r.k if keys else None, r.v): r["rank"] for r in got} == want and len(got) == len(want)


def test_spearman_of_ties(spark):
    rng = random.Random(3)
    rows = [(g, rng.randint(0, 5) / 2, rng.randint(0, 4) / 2) for g in "ab" for _ in range(200)] + [("a", None, 1.0), ("c", 1.0, 2.0)]
    got = {r.k: r for r in K.grouped_corr(spark.createDataFrame(rows, "k string, x double, y double"), ["k"], "x", "y", "spearman").collect()}
    for g in "ab":
        mine = [(x, y) for k, x, y in rows if k == g and x is not None]
        rank = lambda vs: [sum(w < v for w in vs) + (vs.count(v) + 1) / 2 for v in vs]
        a, b = rank([x for x, _ in mine]), rank([y for _, y in mine])
        ma, mb = sum(a) / len(a), sum(b) / len(b)
        r = sum((p - ma) * (q - mb) for p, q in zip(a, b)) / (sum((p - ma) ** 2 for p in a) * sum((q - mb) ** 2 for q in b)) ** 0.5
        assert abs(got[g].r - r) < 1e-9 and got[g].n == len(mine)
    assert got["c"].n == 1


def test_exact_quantiles(spark):
    """One hot group, values that repeat, single rows and nulls, against numpy."""
    import numpy as np

    rng = random.Random(6)
    rows = [("hot", rng.choice([0.0, rng.random(), float(rng.randint(1, 9))])) for _ in range(2501)] + [("one", 4.0), ("two", 1.0), ("two", 2.0), ("two", None), ("none", None)]
    df, shares = spark.createDataFrame(rows, "k string, v double"), [0.0, 0.025, 0.25, 0.5, 0.975, 1.0]
    got = {r.k: r.quantiles for r in K.exact_quantiles(df, ["k"], "v", shares).collect()}
    assert set(got) == {"hot", "one", "two"}
    for k, q in got.items():
        assert np.allclose(q, np.quantile([v for g, v in rows if g == k and v is not None], shares))
    (whole,) = K.exact_quantiles(df, [], "v", shares).collect()
    assert np.allclose(whole.quantiles, np.quantile([v for _, v in rows if v is not None], shares))
    assert K.exact_quantiles(df.limit(0), ["k"], "v", shares).collect() == []


def test_no_window_over_a_whole_group(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 1.0)], "k string, x double, y double")
    plan = K.grouped_corr(df, ["k"], "x", "y", "spearman")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line]
    assert windows and all("_part" in line for line in windows)


def test_a_write_that_fails_is_taken_up_again(spark, tmp_path):
    path = f"{tmp_path}/table"
    good = spark.range(40).select(F.concat(F.lit("s"), F.col("id") % 4).alias("species"), F.col("id").alias("v"))
    bad = good.withColumn("v", F.when((F.col("species") == "s2") & (F.col("v") > 20), F.raise_error("lost")).otherwise(F.col("v")).cast("long"))
    T.write_by_species(good.where("species = 's0'"), path)
    assert [r.species for r in T.finished(spark, path).collect()] == ["s0"]
    with pytest.raises(Exception, match="lost"):
        T.write_by_species(T.unfinished(bad, T.finished(spark, path)), path)
    assert [r.species for r in T.finished(spark, path).collect()] == ["s0"]
    T.write_by_species(T.unfinished(good, T.finished(spark, path)), path)
    assert sorted(r.species for r in T.finished(spark, path).collect()) == ["s0", "s1", "s2", "s3"]
    back = spark.read.schema("v long, species string").parquet(path)
    assert sorted(map(tuple, back.select("species", "v").collect())) == sorted(map(tuple, good.collect()))


def test_a_cache_that_failed_is_made_again(spark, tmp_path):
    path = f"{tmp_path}/cache"
    with pytest.raises(Exception, match="lost"):
        T.cached_table(spark, path, lambda: spark.range(10).select(F.raise_error(F.lit("lost")).cast("long").alias("v")))
    assert T.cached_table(spark, path, lambda: spark.range(3)).count() == 3
    assert T.cached_table(spark, path, lambda: spark.range(9)).count() == 3
    assert T.finished(spark, f"{tmp_path}/none").collect() == []
