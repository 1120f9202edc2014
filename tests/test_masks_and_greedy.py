"""Masks against the plain joins, and greedy selection by ranges against a loop."""

import random

import pytest
from pyspark.sql import functions as F

from genoflux.operators import pairs as P
from genoflux.operators import prevalence as V
from genoflux.plans.fixture import Fixture
from genoflux.plans import registry
from genoflux.sources.scratch import kept

SF = "/root/testdata/sf0.001"
EDGES = "species string, earlier long, later long"


def greedy(n, edges):
    before = {}
    for a, b in edges:
        before.setdefault(b, set()).add(a)
    stays = set()
    for i in range(n):
        if not before.get(i, set()) & stays:
            stays.add(i)
    return stays


@pytest.mark.parametrize("shape", ["chain", "random", "star", "none", "dense"])
def test_independent_set_by_ranges(spark, shape):
    rng = random.Random(shape)
    n = 150
    edges = {
        "chain": [(i, i + 1) for i in range(n - 1)],
        "random": [tuple(sorted(rng.sample(range(n), 2))) for _ in range(300)],
        "star": [(0, i) for i in range(1, n)] + [(i, n - 1) for i in range(1, n - 1)],
        "none": [],
        "dense": [(i, j) for i in range(40) for j in range(i + 1, 40) if rng.random() < 0.7],
    }[shape]
    writes = []

    def write(df):
        writes.append(1)
        return kept(df)

    # a second species with other ids, and a repeated conflict
    items = spark.createDataFrame([("a", i) for i in range(n)] + [("b", 10 * i) for i in range(5)], "species string, id long")
    conflicts = spark.createDataFrame([("a", *e) for e in edges + edges[:3]] + [("b", 0, 10), ("b", 10, 20)], EDGES)
    got = P.independent(items, conflicts, write, width=16)
    assert sorted(map(tuple, got.collect())) == [("a", i) for i in sorted(greedy(n, edges))] + [("b", i) for i in (0, 20, 30, 40)]
    rounds = (len(writes) - 3) / 3  # numbered rows, ids and edges first; three tables a round
    assert rounds <= -(-n // 16)


def test_rounds_do_not_follow_a_chain(spark):
    writes = []
    items = spark.range(600).selectExpr("'a' as species", "id")
    conflicts = spark.range(599).selectExpr("'a' as species", "id as earlier", "id + 1 as later")
    got = P.independent(items, conflicts, lambda df: writes.append(1) or kept(df), width=200)
    assert got.count() == 300 and len(writes) <= 3 + 3 * 3


def test_conflicts_are_between_first_samples(spark):
    """Each species' conflicts are at most its similarity rows, though pairs number their square."""
    ids = [("a", i) for i in range(20)]
    sim = spark.createDataFrame([("a", i, j, 1.0 if i == j else 0.5) for i in range(20) for j in range(20)], "species string, sample_a long, sample_b long, frac double")
    pairs = spark.createDataFrame([("a", i, j) for i in range(20) for j in range(i + 1, 20)], "species string, sample_1 long, sample_2 long")
    c = P.sample_conflicts(spark.createDataFrame(ids, "species string, id long"), sim, F.col("frac") > 0.2)
    assert c.count() == 190
    assert [tuple(r) for r in P.deduplicated_pairs(pairs, sim, 0.2, kept).collect()] == [("a", 0, 1)]
    assert P.deduplicated_pairs(pairs.limit(0), sim, 0.2, kept).collect() == []


def test_masks_give_the_plain_rows(spark):
    fx = Fixture(spark, SF)
    sites = fx.sites()
    plain = P.in_segments(fx.pair_sites().join(sites, ["contig", "location"]), fx.transfers()).where("inside").select(*P.PAIR, "core_pos")
    masks = P.segment_sites(fx.sample_blocks(), fx.transfers())
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, masks.select(*plain.columns).collect())) != []
    plain = P.in_reference_segments(fx.pair_sites(), registry._reference_segments(fx)).where("inside").select(*P.PAIR, "contig", "location")
    masks = registry.QUERIES["j4_g9_reference_segments"](spark, SF)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, masks.collect())) != []
    plain = P.summary(P.in_reference_segments(fx.site_table(), registry._reference_segments(fx)))
    masks = registry.QUERIES["g9_reference_summary"](spark, SF)
    assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, masks.select(*plain.columns).collect())) != []
    for pairs in (None, fx.pairs().where("sample_1 % 2 = 0")):
        plain = V.clonal_snvs(fx.pair_sites() if pairs is None else P.pair_sites(pairs, fx.genotypes()))
        masks = registry._at_sites(fx, V.clonal_positions(fx.sample_blocks(), pairs))
        assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, masks.collect())) != []


def test_reference_segments_at_edges(spark):
    """Ends in gaps, in other windows, on sites, and outside all of them."""
    rng = random.Random(4)
    locations = sorted(rng.sample(range(1, 900), 70))
    at = {("c", x): i for i, x in enumerate(locations)} | {("d", x): 70 + i for i, x in enumerate([5, 300])}
    sites = spark.createDataFrame([(*k, v) for k, v in at.items()], "contig string, location long, core_pos long")
    ends = [(c, a, a + rng.choice([0, 1, 15, 64, 500])) for c in "cde" for a in [0, 4, 5, 63, 64, 128, 299, 300, 301, 899, 2000, *rng.sample(locations, 8)]]
    segments = spark.createDataFrame([("s", i, -1, *e) for i, e in enumerate(ends)], "species string, sample_1 long, sample_2 long, contig string, ref_start long, ref_end long")
    want = {}
    for i, (c, a, b) in enumerate(ends):
        inside = [p for (k, x), p in at.items() if k == c and a <= x <= b]
        if inside:
            want[i] = (min(inside), max(inside))
    for width in (16, 64, 256):
        assert {r.sample_1: (r.start_pos, r.end_pos) for r in P.core_segments(segments, sites, width).collect()} == want
    assert len(want) >= 20


def test_counters_of_positions(spark):
    """All 64 positions, the topmost bit among them, against a count of rows."""
    rng = random.Random(9)
    rows = [("s", p, i, rng.randint(0, 1)) for p in range(130) for i in range(11) if rng.random() < 0.8]
    g = spark.createDataFrame(rows, "species string, core_pos long, sample_id long, genotype int")
    samples = spark.createDataFrame([("s", i) for i in range(9)], "species string, sample_id long")
    got = {}
    for r in V.block_counts(P.sample_blocks(g), samples).collect():
        for bit in range(64):
            got[64 * r.block + bit] = (r.alt_counts[bit], r.covereds[bit])
    for p in range(130):
        mine = [v for _, q, i, v in rows if q == p and i < 9]
        assert got[p] == (sum(mine), len(mine))
