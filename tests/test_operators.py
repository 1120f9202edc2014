"""Hand-made cases: ties, edges, planted parameters, greedy selections, codons and the shipped tables' golden facts."""

import glob
import itertools
import math
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from genoflux.functions import expressions as X
from genoflux.operators import estimators as E
from genoflux.operators import models as M
from genoflux.operators import pairs as P
from genoflux.operators import prevalence as V
from genoflux.operators import sites as S
from genoflux.operators import stats as K
from genoflux.sources import schemas
from genoflux.sources import tables as T
from genoflux.sources.scratch import kept

#: Folders of shipped pair tables, {} for close, clonal and typical; the test is left out where it is unset.
GOLDEN = os.environ.get("GOLDEN_PAIRS", "")


def test_allele_ties(spark):
    rows = [("s", "c", i, "A", x) for i, xs in enumerate(["AC", "CG", "AAC", "CCA", "GG", "ACG"]) for x in xs]
    got = {r.location: (r.site_class, r.major, r.alt) for r in S.site_alleles(spark.createDataFrame(rows, "species string, contig string, location long, ref_base string, allele string")).collect()}
    assert got == {0: ("bi", "A", "C"), 1: ("bi", "G", "C"), 2: ("bi", "A", "C"), 3: ("bi", "C", "A"), 4: ("mono", "G", "A"), 5: ("multi", None, None)}


def test_codons(spark):
    genes = spark.createDataFrame([("g", "c", 1, 6, "+"), ("h", "c", 11, 13, "-")], "gene_id string, contig string, start long, end long, strand string")
    text = dict(enumerate("GGTTAA", 1)) | dict(zip(range(11, 14), "ACC"))  # - strand reads GGT
    bases = spark.createDataFrame([("c", i, b) for i, b in text.items()], "contig string, location long, base string")
    got = {r.location: r for r in S.annotated_genes(genes, bases).collect()}
    assert got[3].site_type == "4D" and got[3].s == 3
    assert got[1].site_type == "1D" and got[1].n == 0  # AGT CGT TGT are sense
    assert got[4].nn == 3  # AAA CAA GAA from a stop
    assert got[6].site_type == "2D" and got[6].mut == {"C": "nn", "G": "s", "T": "nn"}
    assert got[11].site_type == "4D" and got[13].site_type == "1D"


def test_overlapping_segments_equal_their_union(spark):
    sites = spark.createDataFrame([("s", 1, 2, i) for i in range(300)], "species string, sample_1 long, sample_2 long, core_pos long")
    seg = lambda xs: spark.createDataFrame([("s", 1, 2, a, b) for a, b in xs], "species string, sample_1 long, sample_2 long, start_pos long, end_pos long")
    inside = lambda xs: {r.core_pos for r in P.in_segments(sites, seg(xs)).where("inside").collect()}
    assert inside([(10, 100), (50, 130), (131, 131), (299, 299)]) == set(range(10, 132)) | {299}
    mask = P.segment_blocks(seg([(0, 63), (64, 64), (130, 191), (128, 128)])).collect()
    bits = {r.block * 64 + i for r in mask for i in range(64) if r.seg >> i & 1}
    assert bits == set(range(0, 65)) | {128} | set(range(130, 192))


def test_greedy_selections(spark):
    rng = random.Random(3)
    ids = list(range(12))
    frac = {(a, b): round(rng.random(), 3) for a, b in itertools.combinations(ids, 2)}
    full = [("s", a, b, 1.0 if a == b else frac[min(a, b), max(a, b)]) for a in ids for b in ids]
    sim = spark.createDataFrame(full, "species string, sample_a long, sample_b long, frac double").cache()
    f = {(a, b): x for _, a, b, x in full}
    pairs = [p for p in itertools.combinations(ids, 2) if rng.random() < 0.5]
    kept = []
    for p in sorted(pairs):
        if all(f[p[0], q[0]] <= 0.2 for q in kept):
            kept.append(p)
    df = spark.createDataFrame([("s", a, b) for a, b in pairs], "species string, sample_1 long, sample_2 long")
    got = P.deduplicated_pairs(df, sim, 0.2, lambda d: d.cache())
    assert sorted((r.sample_1, r.sample_2) for r in got.collect()) == kept
    chosen = [0]
    for i in ids[1:]:
        if max(f[i, j] for j in chosen) < 0.5:
            chosen.append(i)
    samples = spark.createDataFrame([("s", i) for i in ids], "species string, sample_id long")
    seed = samples.where("sample_id = 0")
    assert sorted(r.sample_id for r in P.unrelated_samples(samples, sim, seed, 0.5, lambda d: d.cache()).collect()) == chosen
    assert P.unrelated_samples(samples, sim, seed.where("false"), 0.5, lambda d: d.cache()).count() == 0


def test_bins(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, 2.0, 4.0, 8.0, 9.0)], "x double")
    e = F.array(*map(F.lit, (1.0, 2.0, 4.0, 8.0)))
    assert [r[0] for r in df.select(E.bin_of("x", e)).collect()] == [None, 0, 0, 1, 2, None]
    one = spark.createDataFrame([(3.0,), (3.0,)], "x double").agg(E.log_edges("x", 2).alias("e")).first().e
    assert one == [3.0, 3.0, 3.0]
    assert spark.createDataFrame([], "x double").agg(E.log_edges("x", 2).alias("e")).first().e is None


def test_thinning(spark):
    df = spark.createDataFrame([(i, k) for i, k in enumerate([0, 1, 31, 32, 33, 1000, None])], "i long, k long")
    got = df.select("k", X.thinned_half("k", "i").alias("a"), X.thinned("k", 0.3, "i").alias("b")).collect()
    assert got[0].a == got[0].b == got[-1].a == 0
    assert all(0 <= r.a <= (r.k or 0) and 0 <= r.b <= (r.k or 0) for r in got)
    big = spark.range(400).select(X.thinned_half(F.lit(100), "id").alias("a"), X.thinned(F.lit(100), 0.3, "id").alias("b")).agg(F.avg("a"), F.var_samp("a"), F.avg("b"), F.var_samp("b")).first()
    assert abs(big[0] - 50) < 1 and 18 < big[1] < 33 and abs(big[2] - 30) < 1 and 15 < big[3] < 28


def test_fit_recovers_planted_parameter(spark):
    s = 3e4
    curve = spark.range(1, 12).select(F.lit("a").alias("k"), F.pow(F.lit(10.0), F.col("id") / 2 - 6).alias("ds_x"), F.lit(1000).alias("kn"), F.lit(1000).alias("ks_b"))
    curve = curve.withColumn("r_hat", X.purifying_curve("ds_x", 0.8, s))
    fit = M.fit_one(curve, ["k"], lambda ds, p: X.purifying_curve(ds, 0.8, p), 1e-3, 1e7).first()
    assert abs(math.log(fit.param / s)) < 2 * math.log(fit.step) + 1e-3 and fit.loss < 1e-5
    assert M.fit_one(curve.limit(2), ["k"], lambda ds, p: X.purifying_curve(ds, 0.8, p), 1e-3, 1e7).count() == 0


def test_model_edges(spark):
    r = spark.range(1).select(X.decay(F.lit(0.0)).alias("z"), X.three_class_curve(F.lit(1e-4), F.lit(0.8), F.lit(0.3), 1.0, 2.0).alias("n"), X.ratio(F.lit(1), F.lit(0)).alias("d")).first()
    assert r.z == 1.0 and r.n is None and r.d is None


def test_poisson_interval(spark):
    got = {r.n: (r.k_lo, r.k_hi) for r in V.poisson_interval(spark.createDataFrame([(n, 100) for n in (0, 1, 5, 50)], "n long, total long")).collect()}
    for n, (lo, hi) in got.items():
        c, p, want = 0.0, math.exp(-n), []
        for q in (0.025, 0.975):
            k, c, p = 0, math.exp(-n), math.exp(-n)
            while c < q - 1e-12:
                k += 1
                p *= n / k
                c += p
            want.append(k)
        assert (lo, hi) == tuple(want)


def test_labels_and_folding(spark):
    df = spark.createDataFrame([(1, 20), (2, 20), (10, 20), (12, 20), (19, 20), (0, 0)], "alt_count long, covered long")
    got = [(r.alt_count, r.label) for r in V.folded(df).withColumn("label", V.label()).collect()]
    assert got == [(1, "singleton"), (2, "(0,10%]"), (10, "(10,50%]"), (8, "(10,50%]"), (1, "singleton"), (0, None)]


def test_correlation_p(spark):
    x = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]
    y = [2.0, 1.0, 4.0, 3.0, 7.0, 5.0]
    r = K.grouped_corr(spark.createDataFrame(list(zip(["a"] * 6, x, y)), "k string, x double, y double"), ["k"], "x", "y").first()
    assert r.n == 6 and abs(r.r - 0.7936) < 2e-3 and abs(r.p - 0.0593) < 2e-3
    assert abs(K.incomplete_beta(2, 3, 0.4) - 0.5248) < 1e-4


def test_density_matches_direct_sum(spark):
    rng = random.Random(1)
    pts = [(rng.gauss(0, 1), rng.gauss(0, 2)) for _ in range(60)]
    got = K.density(spark.createDataFrame(pts, "x double, y double"), "x", "y", 400).collect()
    n = len(pts)
    mx, my = sum(p[0] for p in pts) / n, sum(p[1] for p in pts) / n
    vx, vy = sum((p[0] - mx) ** 2 for p in pts) / (n - 1), sum((p[1] - my) ** 2 for p in pts) / (n - 1)
    vxy = sum((p[0] - mx) * (p[1] - my) for p in pts) / (n - 1)
    h2, det = n ** (-1 / 3), vx * vy - vxy * vxy
    dens = lambda a, b: sum(math.exp(-(vy * (a - x) ** 2 - 2 * vxy * (a - x) * (b - y) + vx * (b - y) ** 2) / det / h2 / 2) for x, y in pts) / (n * 2 * math.pi * h2 * math.sqrt(det))
    assert abs(max(r.density for r in got) - max(dens(*p) for p in pts)) < 2e-3


def direct_density(pts, at):
    """The kernel sum of all points, and the kernel's peak."""
    n = len(pts)
    mx, my = sum(p[0] for p in pts) / n, sum(p[1] for p in pts) / n
    vx, vy = sum((p[0] - mx) ** 2 for p in pts) / (n - 1), sum((p[1] - my) ** 2 for p in pts) / (n - 1)
    vxy = sum((p[0] - mx) * (p[1] - my) for p in pts) / (n - 1)
    h2, det = n ** (-1 / 3), vx * vy - vxy * vxy
    peak = 1 / (2 * math.pi * h2 * math.sqrt(det))
    return [peak / n * sum(math.exp(-(vy * (a - x) ** 2 - 2 * vxy * (a - x) * (b - y) + vx * (b - y) ** 2) / det / h2 / 2) for x, y in pts) for a, b in at], peak


@pytest.mark.parametrize("kind", ["round", "slanted", "far apart"])
def test_point_density_is_within_its_bound(spark, kind):
    rng = random.Random(kind)
    pts = [(rng.gauss(0, 1), rng.gauss(0, 2)) for _ in range(300)]
    if kind == "slanted":
        pts = [(x, 0.9 * x + 0.1 * y) for x, y in pts]
    if kind == "far apart":
        pts = [(x + 40 * (k % 3), y) for k, (x, y) in enumerate(pts)] + [pts[0]] * 40
    rows = [(k, *p) for k, p in enumerate(pts)] + [(-1, None, 1.0), (-2, 1.0, None)]
    got = {r.k: r.density for r in K.point_density(spark.createDataFrame(rows, "k long, x double, y double"), ["k"], "x", "y").collect()}
    want, peak = direct_density(pts, pts)
    assert sorted(got) == list(range(len(pts)))
    assert max(abs(got[k] - w) for k, w in enumerate(want)) < 2e-4 * peak


def test_point_density_edges(spark):
    at = lambda rows: [r.density for r in K.point_density(spark.createDataFrame(rows, "k long, x double, y double"), ["k"], "x", "y").collect()]
    assert at([]) == [] and at([(1, 0.0, 0.0)]) == [None]
    assert at([(k, float(k), 1.0) for k in range(5)]) == [None] * 5 and at([(k, 1.0, float(k)) for k in range(5)]) == [None] * 5


def test_fit_reads_columns_of_the_key_and_leaves_out_undefined_bins(spark):
    rows = [("a", 0.8, 10.0 ** (i / 2 - 6), 1000, 1000, 3e4) for i in range(1, 12)] + [("b", 0.5, 10.0 ** (i / 2 - 6), 1000, 1000, 2e3) for i in range(1, 12)]
    curve = spark.createDataFrame(rows, "k string, fd double, ds_x double, kn long, ks_b long, s double").withColumn("r_hat", X.purifying_curve("ds_x", F.col("fd"), F.col("s")))
    odd = curve.where("k = 'b'").limit(1).withColumn("kn", F.lit(0).cast("long"))  # no weight
    fits = {r.k: r for r in M.fit_one(curve.unionByName(odd), ["k"], lambda ds, p: X.purifying_curve(ds, F.col("fd"), p), 1e-3, 1e7).collect()}
    assert abs(math.log(fits["a"].param / 3e4)) < 0.05 and abs(math.log(fits["b"].param / 2e3)) < 0.05
    none = M.fit_one(curve, ["k"], lambda ds, p: F.when(p < 0, ds), 1e-3, 1e7)  # a model without a value
    assert none.count() == 0


@pytest.mark.skipif(not (GOLDEN and glob.glob(GOLDEN.format("close"))), reason="shipped tables are not there")
def test_golden_tables(spark):
    close, clonal, typical = (T.read_pairs(spark, GOLDEN.format(k), s) for k, s in (("close", schemas.CLOSE), ("clonal", schemas.CLONAL), ("typical", schemas.TYPICAL)))
    assert (close.count(), clonal.count(), typical.count()) == (1529, 802, 840)
    both = close.unionByName(T.as_clonal(clonal), allowMissingColumns=True)
    r = close.agg(F.bool_and(F.expr("recomb_len_4d + clonal_len_4d = core_len_4d")), F.bool_and(F.expr("clonal_n + clonal_m + clonal_nn = 3 * clonal_len_1d"))).first()
    assert all(r) and both.where("recomb_len_4d is null").count() == 802
    # one of the clonal tables' species is left out
    listed = T.all_pairs(close, clonal, os.environ.get("GOLDEN_BLACKLIST", "").split(","))
    assert listed.count() == 2232 and listed.where("recomb_len_4d is null").count() == 703
    pooled = listed.agg(F.sum("clonal_diff_4d") / F.sum("clonal_len_4d"), F.sum("clonal_diff_1d") / F.sum("clonal_len_1d"), F.count_if(F.col("clonal_diff_4d") == 0)).first()
    assert math.isclose(pooled[0], 9.41174e-05, rel_tol=1e-5) and math.isclose(pooled[1], 6.99247e-05, rel_tol=1e-5) and pooled[2] == 2
    counts = {"syn": ("clonal_diff_4d", "clonal_len_4d"), "mis": ("clonal_mut_m", F.col("clonal_m") / 3)}
    bins = {r.bin: r for r in E.binned_rates(listed, X.ratio("clonal_diff_4d", "clonal_len_4d") / 3, counts, (1e-6, 1e-2, 40)).collect()}
    assert sorted(bins) == list(range(2, 22))
    assert (bins[2].n_pairs, bins[12].n_pairs, bins[21].n_pairs) == (6, 201, 9)
    for bin_, column, want in ((2, "syn_rate", -5.288591), (2, "syn_se", 0.153546), (12, "syn_rate", -4.243358), (12, "syn_se", 0.007446), (12, "mis_rate", -4.331630), (21, "syn_rate", -3.336479)):
        assert abs(bins[bin_][column] - want) < 1e-6


def test_rates_of_the_published_sums(spark):
    """Bins 2 and 12 of the published tables from pairs with the same sums, on 40 edges over a third of dS."""
    rows = []
    for n, k, sites in ((6, 8, 1554823), (201, 3402, 59578862)):
        cuts = [i * k // n for i in range(n + 1)]  # each pair has its share of the sites for its share of the differences
        rows += [(b - a, b * sites // k - a * sites // k) for a, b in zip(cuts, cuts[1:])]
    rows += [(0, 10**6), (1, 1), (7, 0)]  # below, above, and without a site
    pairs = spark.createDataFrame(rows, "k long, sites long")
    got = {r.bin: r for r in E.binned_rates(pairs, X.ratio("k", "sites") / 3, {"syn": ("k", "sites")}, (1e-6, 1e-2, 40)).collect()}
    assert sorted(got) == [2, 12] and (got[2].n_pairs, got[12].n_pairs) == (6, 201)
    for bin_, rate, se in ((2, -5.288591, 0.153546), (12, -4.243358, 0.007446)):
        assert abs(got[bin_].syn_rate - rate) < 1e-6 and abs(got[bin_].syn_se - se) < 1e-6


def test_early_share_at_the_published_threshold(spark):
    """Pairs at 3e-5 or above and those without divergence count for nothing."""
    rows = [("a", 10, 1e6, 20, 1e6, 2e-5), ("a", 10, 1e6, 20, 1e6, 1e-5), ("a", 900, 1e3, 1, 1e6, 3e-5), ("a", 900, 1e3, 1, 1e6, 0.0)]
    t = spark.createDataFrame(rows, "mut_class string, kn long, ln double, ks_b long, ls_b double, ds_a double")
    r = M.early_share(t, ["mut_class"], 3e-5).first()
    assert r.n_pairs == 2 and abs(r.mean_ds - 1.5e-5) < 1e-12 and abs(r.alpha2 - 0.5) < 1e-12


def test_matrix_and_cache(spark, tmp_path):
    (tmp_path / "m.csv").write_text("1,0.5\n0.5,1\n")
    index = spark.createDataFrame([(0, "a"), (1, "b")], "position int, sample_id string")
    got = {(r.sample_a, r.sample_b): r.frac for r in T.read_matrix(spark, str(tmp_path / "m.csv"), index).collect()}
    assert got == {("a", "a"): 1.0, ("a", "b"): 0.5, ("b", "a"): 0.5, ("b", "b"): 1.0}
    made = []
    make = lambda: made.append(1) or spark.range(3)
    for _ in range(2):
        assert T.cached_table(spark, str(tmp_path / "cache"), make).count() == 3
    assert len(made) == 1


def test_bootstrap_draws(spark):
    df = spark.createDataFrame([("a", i) for i in range(7)] + [("b", i) for i in range(3)], "g string, i long")
    d = E.resampled(df, "g", ["i"], 4, 1, kept)
    assert {(r.g, r["count"]) for r in d.groupBy("g", "rep").count().collect()} == {("a", 7), ("b", 3)}
    # more rows than a part: each replicate draws as many as there are, all rows alike, and each draw has its own number
    n, reps = 3 * E.PART + 17, 60
    big = E.resampled(spark.range(n).selectExpr("'g' as g", "id as i", "id * 2 as v"), "g", ["i"], reps, 1, kept)
    rows = big.collect()
    assert len(rows) == n * reps == len({(r.rep, r.draw) for r in rows}) and all(r.v == 2 * r.i for r in rows)
    assert all(c == n for c in Counter(r.rep for r in rows).values())
    times = Counter(r.i for r in rows)
    mean = sum(times.values()) / n
    spread = sum((times[i] - mean) ** 2 for i in range(n)) / n
    assert mean == reps and 0.8 * reps < spread < 1.2 * reps  # Poisson-like: variance near the mean
    parts = Counter((r.rep, r.i // E.PART) for r in rows)
    assert {len([1 for p in range(4) if parts[k, p]]) for k in range(reps)} == {4} and len({parts[k, 0] for k in range(reps)}) > 10
    w = E.poisson_weights(spark.range(3000).withColumnRenamed("id", "i"), ["i"], 1, 1).agg(F.sum("weight")).first()[0]
    assert abs(w - 3000) < 200
