"""Pairs meet their segments as lists: no row is made for a segment's length or for a site that a pair does not share."""

from pyspark.sql import functions as F

from genoflux.operators import pairs as P

FAR = 10**12  # a row a block of such a segment would not fit anywhere
_PAIR = "species string, sample_1 long, sample_2 long"


def _segments(spark, rows):
    return spark.createDataFrame(rows, f"{_PAIR}, start_pos long, end_pos long")


def test_long_segments_of_plain_sites(spark):
    sites = spark.createDataFrame([("s", 1, 2, i) for i in range(200)], f"{_PAIR}, core_pos long")
    seg = _segments(spark, [("s", 1, 2, 150, FAR), ("s", 1, 2, 5, 5), ("s", 1, 3, 0, FAR)])
    got = {r.core_pos for r in P.in_segments(sites, seg).where("inside").collect()}
    assert got == {5, *range(150, 200)}
    ref = seg.withColumnsRenamed({"start_pos": "ref_start", "end_pos": "ref_end"}).withColumn("contig", F.lit("c"))
    at = sites.withColumnRenamed("core_pos", "location").withColumn("contig", F.when(F.col("location") < 180, "c").otherwise("d"))
    assert {r.location for r in P.in_reference_segments(at, ref).where("inside").collect()} == {5, *range(150, 180)}


def test_long_segments_of_blocks(spark):
    n = 200
    g = spark.range(n).selectExpr("'s' as species", "id as core_pos", "explode(array(1L, 2L, 3L)) as sample_id").withColumn("genotype", (F.col("core_pos") % F.col("sample_id") == 0).cast("int"))
    blocks = P.sample_blocks(g)
    seg = _segments(spark, [("s", 1, 2, 130, FAR), ("s", 1, 2, 64, 64), ("s", 3, 1, 190, FAR)])
    got = sorted((r.sample_1, r.sample_2, r.core_pos) for r in P.segment_sites(blocks, seg).collect())
    assert got == sorted([(1, 2, x) for x in (64, *range(130, n))] + [(3, 1, x) for x in range(190, n)])
    sites = spark.range(n).selectExpr("id as core_pos", "if(id % 2 = 0, '4D', '1D') as site_type", "1L as n", "2L as m", "0L as nn")
    types = spark.createDataFrame([("s", 131, "m")], "species string, core_pos long, mut_type string")
    fixed, seen = P.site_blocks(sites, types)
    row = {(r.sample_1, r.sample_2): r for r in P.block_summary(None, blocks, fixed, seen, seg).collect()}
    inside = [64, *range(130, n)]
    r = row[1, 2]
    assert (r.core_len, r.core_diff, r.recomb_len_4d, r.recomb_len_1d) == (n, n // 2, sum(x % 2 == 0 for x in inside), sum(x % 2 for x in inside))
    assert (r.recomb_mut_m, r.clonal_mut_m, r.core_mut_m, r.core_m, r.recomb_m) == (1, 0, 1, n, 2 * r.recomb_len_1d)
    assert row[1, 3].recomb_len_4d == row[2, 3].recomb_len_4d == 0  # (3, 1) is not (1, 3)
    totals = P.core_counts(P.pair_masks(None, blocks, fixed, seen), ["species"]).collect()[0]
    assert all(totals[c] == sum(r[c] for r in row.values()) for c in totals.asDict() if c != "species")


def test_wanted_pairs_in_either_order(spark):
    g = spark.createDataFrame([("s", "c", x, i, (x + i) % 2) for x in range(3) for i in (1, 2, 3)], "species string, contig string, location long, sample_id long, genotype int")
    wanted = spark.createDataFrame([("s", 2, 1), ("s", 2, 3)], _PAIR)
    got = sorted((r.sample_1, r.sample_2, r.location, r.differ) for r in P.pair_sites(wanted, g).collect())
    assert got == [(a, b, x, True) for a, b in ((2, 1), (2, 3)) for x in range(3)]
    assert P.pair_sites(None, g).count() == 9
