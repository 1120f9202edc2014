"""Pairwise differences, intervals and pair summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .estimators import numbered, spread

PAIR = ["species", "sample_1", "sample_2"]
TYPES = ("n", "m", "nn")


def pair_sites(pairs: DataFrame | None, genotypes: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """Plain path: one row for each pair and site that both samples cover, and whether they differ there. pairs: those wanted, or None for
    all pairs of samples of one species. carry: columns of `genotypes` that are the same for all samples at a site.

    Genotypes meet at their site, so rows made are those of the result; what is wanted of them is a join on the pair."""
    key = ["species", "contig", "location"]
    a = genotypes.select(*key, *carry, F.col("sample_id").alias("sample_1"), F.col("genotype").alias("g1"))
    b = genotypes.select(*key, F.col("sample_id").alias("sample_2"), F.col("genotype").alias("g2"))
    x = a.join(b, key).where("sample_1 < sample_2").select(*PAIR, "contig", "location", *carry, (F.col("g1") != F.col("g2")).alias("differ"))
    if pairs is None:
        return x
    wanted = pairs.select("species", F.least("sample_1", "sample_2").alias("sample_1"), F.greatest("sample_1", "sample_2").alias("sample_2"), (F.col("sample_1") > F.col("sample_2")).alias("_flip"))
    x = x.join(wanted, PAIR)
    first, second = (F.when(F.col("_flip"), F.col(p)).otherwise(F.col(q)) for p, q in (("sample_2", "sample_1"), ("sample_1", "sample_2")))
    return x.select("species", first.alias("sample_1"), second.alias("sample_2"), "contig", "location", *carry, "differ")


def _lists(segments: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """keys, segs: the closed segments of a key as an array of struct(lo, hi). A segment stays one entry, however long it is."""
    return segments.groupBy(*keys).agg(F.collect_set(F.struct(F.col(start).cast("long").alias("lo"), F.col(end).cast("long").alias("hi"))).alias("segs"))


def _with_lists(rows: DataFrame, lists: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Rows meet the segments of their pair. The lists are the lesser side by far, so theirs is the side that is hashed, and rows are not sorted."""
    return rows.join(lists.hint("shuffle_hash"), keys, how)


def in_segments(sites: DataFrame, segments: DataFrame) -> DataFrame:
    """Adds `inside`: core_pos lies in any closed segment of the pair (overlaps count once). One join on the pair: neither side grows
    with the length of the segments."""
    x = _with_lists(sites, _lists(segments, PAIR, "start_pos", "end_pos"), PAIR, "left")
    return x.withColumn("inside", F.expr("coalesce(exists(segs, s -> core_pos between s.lo and s.hi), false)")).drop("segs")


def in_reference_segments(sites: DataFrame, segments: DataFrame) -> DataFrame:
    """As `in_segments`, on (contig, location) with segments contig, ref_start, ref_end."""
    key = [*PAIR, "contig"]
    x = _with_lists(sites, _lists(segments, key, "ref_start", "ref_end"), key, "left")
    return x.withColumn("inside", F.expr("coalesce(exists(segs, s -> location between s.lo and s.hi), false)")).drop("segs")


def _sum(value, when: Column | None = None) -> Column:
    value = F.lit(1) if value is None else F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.sum(value if when is None else F.when(when, value)), F.lit(0)).cast("long")


def summary(annotated: DataFrame) -> DataFrame:
    """Lengths, differences, observed mutations and opportunities of each pair, whole, recombined and clonal.

    annotated: pair, differ, site_type, inside, mut_type (of the SNV's alt base), n, m, nn (opportunities).
    """
    is1, is4, d, inside = F.col("site_type") == "1D", F.col("site_type") == "4D", F.col("differ"), F.col("inside")
    out = [_sum(None).alias("core_len"), _sum(None, d).alias("core_diff")]
    for part, where in (("core", F.lit(True)), ("recomb", inside), ("clonal", ~inside)):
        for name, kind in (("4d", is4), ("1d", is1)):
            out += [_sum(None, where & kind).alias(f"{part}_len_{name}"), _sum(None, where & kind & d).alias(f"{part}_diff_{name}")]
        for t in TYPES:
            out += [_sum(None, where & is1 & d & (F.col("mut_type") == t)).alias(f"{part}_mut_{t}"), _sum(t, where & is1).alias(f"{part}_{t}")]
    return annotated.groupBy(*PAIR).agg(*out)


# --- 64-site blocks ------------------------------------------------------------------------------------------------


def _mask(when: Column) -> Column:
    return F.coalesce(F.bit_or(F.when(when, F.expr("shiftleft(1L, cast(core_pos % 64 as int))"))), F.lit(0).cast("long"))


def sample_blocks(genotypes: DataFrame) -> DataFrame:
    """Two masks for each sample and block of 64 core positions: covered and alt. genotypes has core_pos."""
    g = genotypes.withColumn("block", F.expr("core_pos div 64"))
    return g.groupBy("species", "block", "sample_id").agg(_mask(F.lit(True)).alias("cov"), _mask(F.col("genotype") == 1).alias("alt"))


def site_blocks(sites: DataFrame, types: DataFrame) -> DataFrame:
    """Masks of site types, of SNV types by species, and two bit planes of each opportunity count. sites: core_pos, site_type, n, m,
    nn; types: species, core_pos, mut_type."""
    s = sites.withColumn("block", F.expr("core_pos div 64"))
    planes = [_mask(F.col(t).bitwiseAND(F.lit(1 << p)) > 0).alias(f"{t}{p}") for t in TYPES for p in (0, 1)]
    fixed = s.groupBy("block").agg(_mask(F.col("site_type") == "1D").alias("is_1d"), _mask(F.col("site_type") == "4D").alias("is_4d"), *planes)
    seen = types.withColumn("block", F.expr("core_pos div 64")).groupBy("species", "block").agg(*(_mask(F.col("mut_type") == t).alias(f"t_{t}") for t in TYPES))
    return fixed, seen


def segment_blocks(segments: DataFrame) -> DataFrame:
    """The mask of each pair's segments in each block; overlapping segments merge by bit_or. A row for each block of a segment, so for short
    ones; `segment_mask` gives the same for blocks that are there."""
    s = segments.select(*PAIR, "start_pos", "end_pos", F.explode(F.expr("sequence(start_pos div 64, end_pos div 64)")).alias("block"))
    low, high = F.greatest(F.col("start_pos") - F.col("block") * 64, F.lit(0)), F.least(F.col("end_pos") - F.col("block") * 64, F.lit(63))
    s = s.withColumn("low", low.cast("int")).withColumn("high", high.cast("int"))
    mask = F.expr("shiftleft(shiftrightunsigned(-1L, 63 - (high - low)), low)")
    return s.withColumn("mask", mask).groupBy(*PAIR, "block").agg(F.bit_or("mask").alias("seg"))


def segment_mask() -> Column:
    """The mask of `segs` (of `_lists`; null: none) in `block`: bits from the first position inside to the last, for each that touches it."""
    bits = "shiftleft(shiftrightunsigned(-1L, cast(63 - (least(s.hi - block * 64, 63) - greatest(s.lo - block * 64, 0)) as int)), cast(greatest(s.lo - block * 64, 0) as int))"
    touches = "s.lo <= block * 64 + 63 and s.hi >= block * 64 and s.lo <= s.hi"
    return F.expr(f"coalesce(aggregate(segs, 0L, (m, s) -> m | if({touches}, {bits}, 0L)), 0L)")


def core_segments(segments: DataFrame, sites: DataFrame, width: int = 256) -> DataFrame:
    """Segments in reference coordinates (pair, contig, ref_start, ref_end, closed) as closed segments of core positions, start_pos and
    end_pos; those without a core site are left out. sites: contig, location, core_pos, which ascends by location within a contig.

    The core positions of a contig's window of `width` locations are one range, so a segment's are found by one row a window: whole
    windows by their first and last, those at its ends by the locations in them.
    """
    window = lambda c: F.floor(F.col(c) / width)
    index = sites.groupBy("contig", window("location").alias("window")).agg(F.min("core_pos").alias("first"), F.max("core_pos").alias("last"), F.sort_array(F.collect_list("location")).alias("at"))
    s = segments.select(*PAIR, "contig", "ref_start", "ref_end").distinct().withColumn("window", F.explode(F.sequence(window("ref_start"), window("ref_end"))))
    x = s.join(index, ["contig", "window"])
    low = F.when(F.col("ref_start") <= F.col("window") * width, F.col("first")).otherwise(F.col("first") + F.expr("size(filter(at, l -> l < ref_start))"))
    high = F.when(F.col("ref_end") >= (F.col("window") + 1) * width - 1, F.col("last")).otherwise(F.col("first") + F.expr("size(filter(at, l -> l <= ref_end))") - 1)
    x = x.select(*PAIR, "contig", "ref_start", "ref_end", low.alias("low"), high.alias("high")).where("low <= high")
    return x.groupBy(*PAIR, "contig", "ref_start", "ref_end").agg(F.min("low").alias("start_pos"), F.max("high").alias("end_pos"))


def unfolded(masks: DataFrame, mask: str = "mask") -> DataFrame:
    """core_pos of each set bit of `mask` in place of block and mask."""
    bits = F.explode(F.expr(f"filter(sequence(0, 63), i -> (shiftrightunsigned({mask}, i) & 1) = 1)"))
    return masks.where(F.col(mask) != 0).withColumn("_bit", bits).withColumn("core_pos", F.col("block") * 64 + F.col("_bit")).drop("block", "_bit", mask)


def _sides(blocks: DataFrame, carry: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The masks of either sample of a pair: c1 and a1, c2 and a2; the first side has `carry` too."""
    return tuple(blocks.select("species", "block", F.col("sample_id").alias(f"sample_{i}"), F.col("cov").alias(f"c{i}"), F.col("alt").alias(f"a{i}"), *(carry if i == 1 else ())) for i in (1, 2))


def segment_sites(blocks: DataFrame, segments: DataFrame) -> DataFrame:
    """pair, core_pos: the positions that both samples of a pair cover inside its segments (pair, start_pos, end_pos). blocks: of
    `sample_blocks`. A row a pair and block that both cover meets the pair's segments, and only what is inside is unfolded."""
    a, b = _sides(blocks)
    x = a.join(b, ["species", "block"]).where("sample_1 < sample_2 and (c1 & c2) != 0").select(*PAIR, "block", F.expr("c1 & c2").alias("both"))
    flip = F.col("sample_1") > F.col("sample_2")
    s = segments.select("species", F.least("sample_1", "sample_2").alias("sample_1"), F.greatest("sample_1", "sample_2").alias("sample_2"), flip.alias("_flip"), "start_pos", "end_pos")
    x = _with_lists(x, _lists(s, [*PAIR, "_flip"], "start_pos", "end_pos"), PAIR, "inner")
    first, second = (F.when(F.col("_flip"), F.col(p)).otherwise(F.col(q)) for p, q in (("sample_2", "sample_1"), ("sample_1", "sample_2")))
    x = x.withColumn("mask", segment_mask().bitwiseAND(F.col("both"))).where("mask != 0")
    return unfolded(x.select("species", first.alias("sample_1"), second.alias("sample_2"), "block", "mask"))


def difference_masks(blocks: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """species, block, mask: the positions at which some pair of `pairs` differs; None: any two samples of the species, which is
    where both alleles are seen, so that no pair is formed at all."""
    if pairs is None:
        seen = blocks.groupBy("species", "block").agg(F.bit_or("alt").alias("alt"), F.bit_or(F.expr("cov & ~alt")).alias("other"))
        return seen.select("species", "block", F.expr("alt & other").alias("mask")).where("mask != 0")
    a, b = _sides(blocks)
    x = pairs.select(*PAIR).join(a, ["species", "sample_1"]).join(b, ["species", "block", "sample_2"])
    return x.groupBy("species", "block").agg(F.bit_or(F.expr("(a1 ^ a2) & c1 & c2")).alias("mask")).where("mask != 0")


#: Masks of a row of `pair_masks` beside its counts n_both and n_diff.
_SITES = ("both_1d", "both_4d", "diff_1d", "diff_4d", *(f"mut_{t}" for t in TYPES), *(f"{t}{p}" for t in TYPES for p in (0, 1)))


def pair_masks(pairs: DataFrame | None, blocks: DataFrame, fixed: DataFrame, seen: DataFrame) -> DataFrame:
    """pair, block, n_both, n_diff and _SITES: 64 sites a row. Site and SNV types are joined to a sample's blocks before pairs are formed.
    pairs: those wanted, or None for all pairs of samples of one species that share a covered site, which takes one join less."""
    kinds = ("is_1d", "is_4d", *(f"t_{t}" for t in TYPES), *(f"{t}{p}" for t in TYPES for p in (0, 1)))
    a, b = _sides(blocks.join(fixed, "block").join(seen, ["species", "block"], "left"), kinds)
    b = b.select("species", "block", "sample_2", "c2", "a2")
    if pairs is None:
        x = a.join(b, ["species", "block"]).where("sample_1 < sample_2 and (c1 & c2) != 0")
    else:
        x = pairs.join(a, ["species", "sample_1"]).join(b, ["species", "block", "sample_2"])
    x = x.withColumn("both", F.expr("c1 & c2")).withColumn("diff", F.expr("(a1 ^ a2) & c1 & c2"))
    masks = {f"{w}_{k}": f"{w} & is_{k}" for w in ("both", "diff") for k in ("1d", "4d")}
    masks |= {f"mut_{t}": f"diff & is_1d & coalesce(t_{t}, 0L)" for t in TYPES} | {f"{t}{p}": f"both & is_1d & {t}{p}" for t in TYPES for p in (0, 1)}
    return x.select(*PAIR, "block", F.expr("bit_count(both)").alias("n_both"), F.expr("bit_count(diff)").alias("n_diff"), *(F.expr(e).alias(m) for m, e in masks.items()))


def _bits(part: str, mask: str) -> list[Column]:
    """Sums of the sites of _SITES within a mask."""
    count = lambda e, name: F.coalesce(F.sum(F.expr(e)), F.lit(0)).cast("long").alias(f"{part}_{name}")
    out = [count(f"bit_count({w}_{k} & {mask})", f"{n}_{k}") for k in ("4d", "1d") for w, n in (("both", "len"), ("diff", "diff"))]
    for t in TYPES:
        out += [count(f"bit_count(mut_{t} & {mask})", f"mut_{t}"), count(f"bit_count({t}0 & {mask}) + 2 * bit_count({t}1 & {mask})", t)]
    return out


def core_counts(masks: DataFrame, keys: list[str]) -> DataFrame:
    """Columns core_ of `block_summary`, summed over `keys` of `pair_masks`: no segment is read, and for fewer keys than a pair's no row a pair
    is shuffled."""
    return masks.groupBy(*keys).agg(F.sum("n_both").alias("core_len"), F.sum("n_diff").alias("core_diff"), *_bits("core", "-1L"))


def block_summary(pairs: DataFrame | None, blocks: DataFrame, fixed: DataFrame, seen: DataFrame, segments: DataFrame) -> DataFrame:
    """`summary` from masks: 64 sites a row, all in bit_count and AND. pairs: of `pair_masks`. A row a pair and block meets the segments of
    its pair as a list, so rows don't grow with the length of segments, and that join's shuffle is the aggregation's too."""
    x = _with_lists(pair_masks(pairs, blocks, fixed, seen), _lists(segments, PAIR, "start_pos", "end_pos"), PAIR, "left").withColumn("seg", segment_mask())
    g = x.groupBy(*PAIR).agg(F.sum("n_both").cast("long").alias("core_len"), F.sum("n_diff").cast("long").alias("core_diff"), *_bits("recomb", "seg"), *_bits("clonal", "~seg"))
    whole = lambda c: (F.col(f"recomb_{c}") + F.col(f"clonal_{c}")).alias(f"core_{c}")
    names = [f"{n}_{k}" for k in ("4d", "1d") for n in ("len", "diff")] + [c for t in TYPES for c in (f"mut_{t}", t)]
    return g.select(*PAIR, "core_len", "core_diff", *map(whole, names), *(f"{part}_{c}" for part in ("recomb", "clonal") for c in names)).where("core_len > 0")


def contig_differences(calls: DataFrame) -> DataFrame:
    """species, sample_a, sample_b (the lesser first), contig, d: whether their alleles differ anywhere on it, for contigs with a site
    that both cover. calls: species, contig, core_pos, sample_id, allele.

    A sample's 64 sites of a block are three masks, coverage and two bits of the base, so a pair costs one row a block and contig.
    """
    base = F.expr("instr('ACGT', allele)") - 1
    m = calls.select("species", "contig", "sample_id", "core_pos", F.expr("core_pos div 64").alias("block"), base.alias("b"))
    m = m.groupBy("species", "contig", "block", "sample_id").agg(_mask(F.lit(True)).alias("cov"), _mask(F.col("b").bitwiseAND(F.lit(1)) > 0).alias("b0"), _mask(F.col("b").bitwiseAND(F.lit(2)) > 0).alias("b1"))
    a, b = (m.select("species", "contig", "block", F.col("sample_id").alias(f"sample_{s}"), *(F.col(c).alias(f"{c}_{s}") for c in ("cov", "b0", "b1"))) for s in "ab")
    x = a.join(b, ["species", "contig", "block"]).where("sample_a < sample_b and (cov_a & cov_b) != 0")
    differ = F.expr("((b0_a ^ b0_b) | (b1_a ^ b1_b)) & cov_a & cov_b") != 0
    return x.groupBy("species", "sample_a", "sample_b", "contig").agg(F.bool_or(differ).alias("d"))


# --- partners of a sample ------------------------------------------------------------------------------------------


def _flags() -> Column:
    """What a pair's row needs of its site in 12 bits: 1D, 4D, the SNV's type, opportunities in two bits each, and multi-allelic. SNV types and
    opportunities count at 1D sites alone."""
    is1 = F.col("site_type") == "1D"
    bits = [is1, F.col("site_type") == "4D", *(is1 & (F.col("mut_type") == t) for t in TYPES), F.col("site_class") == "multi"]
    at = (0, 1, 2, 3, 4, 11)
    out = sum((F.when(b, 1 << i).otherwise(0) for i, b in zip(at, bits)), F.lit(0))
    return sum((F.when(is1, F.shiftleft(F.coalesce(F.col(t), F.lit(0)).cast("int"), 5 + 2 * i)).otherwise(0) for i, t in enumerate(TYPES)), out).cast("long")


def _later(sites: DataFrame, carry: list[str], same: str) -> DataFrame:
    """A row a call that has a partner: species, sample_1, `carry`, and the ids of later samples called at the site for which `same` holds of
    c and _own, and for which it does not. A site's samples are listed once for each of them, so there are no more rows than calls."""
    x = sites.where(F.size("calls") > 1).select("species", *carry, "calls", F.posexplode("calls").alias("_i", "_own")).where("_i < size(calls) - 1")
    x = x.select("species", *carry, "_own", F.expr("slice(calls, _i + 2, size(calls))").alias("_later"))
    return x.select("species", F.col("_own.sample_id").alias("sample_1"), *carry, *(F.expr(f"filter(_later, c -> {e}).sample_id").alias(n) for n, e in (("alike", same), ("unlike", f"not ({same})"))))


def partners(sites: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """A row a call that has a partner: species, sample_1, at (core_pos, _flags), and the later samples called at the site: `alike` with
    the same genotype (at multi-allelic sites, all), `unlike` with the other. sites: of `sites.called_sites`, with core_pos, site_type, mut_type,
    n, m, nn. carry: columns of a site that its rows bring along.

    What is shuffled for a pair at a site is one id. All rows of a pair lie with its first sample: dealt by (species, sample_1), pairs are
    summed where they lie.
    """
    x = sites.select("species", (F.expr("core_pos * 4096") + _flags()).alias("at"), *carry, "calls")
    return _later(x, ["at", *carry], "at & 2048 != 0 or c.is_ref = _own.is_ref")


def contig_partners(sites: DataFrame) -> DataFrame:
    """As `partners`, by allele and with the contig alone. sites: of `sites.called_sites`, with contig."""
    return _later(sites.select("species", "contig", "calls"), ["contig"], "c.allele = _own.allele")


def agreement(rows: DataFrame) -> DataFrame:
    """species, sample_a, sample_b (the lesser first), frac: the share of contigs on which both are called somewhere that show no difference in
    allele. rows: of `contig_partners`, dealt, so that no row a pair or a pair and contig is shuffled. Where contigs are numbered from 0 (long), 64 of
    a pair's are two masks of a row; named ones are a row each."""
    met = partnered(rows, "contig")
    if dict(met.dtypes)["contig"] == "bigint":
        bit = F.expr("shiftleft(1L, cast(contig % 64 as int))")
        met = met.groupBy(*PAIR, F.expr("contig div 64").alias("block")).agg(F.bit_or(bit).alias("met"), F.bit_or(F.when(F.col("differ"), bit).otherwise(F.lit(0).cast("long"))).alias("d"))
        n, alike = F.sum(F.bit_count("met")), F.sum(F.bit_count(F.expr("met & ~d")))
    else:
        met = met.groupBy(*PAIR, "contig").agg(F.bool_or("differ").alias("d"))
        n, alike = F.count("*"), F.count_if(~F.col("d"))
    return met.groupBy("species", F.col("sample_1").alias("sample_a"), F.col("sample_2").alias("sample_b")).agg((alike / n).alias("frac"))


#: Types a row's later ids are written in, with what a distance from its first sample stays below.
_NARROW = {"near": ("smallint", 1 << 14), "mid": ("int", 1 << 30)}


def _narrowed(rows: DataFrame) -> DataFrame:
    """Rows of `_later` with ids of type long, as they are shuffled: an id is its distance from sample_1, doubled, and odd in `unlike`, in one array
    of the first type of _NARROW that holds the row's widest. A row wider than all keeps its two lists."""
    span = F.expr("try_subtract(greatest(array_max(alike), array_max(unlike)), sample_1)")
    lists, fits = [], F.lit(False)
    for name, (kind, below) in _NARROW.items():
        codes = F.expr(f"concat(transform(alike, x -> cast((x - sample_1) * 2 as {kind})), transform(unlike, x -> cast((x - sample_1) * 2 + 1 as {kind})))")
        lists.append(F.when(~fits & F.coalesce(span < below, F.lit(False)), codes).alias(name))
        fits = fits | F.coalesce(span < below, F.lit(False))
    wide = [F.when(~fits, F.col(c)).alias(c) for c in ("alike", "unlike")]
    return rows.select(*(c for c in rows.columns if c not in ("alike", "unlike")), *lists, *wide)


def _widened(rows: DataFrame) -> DataFrame:
    """`alike` and `unlike` of rows of `_narrowed`."""
    codes = F.expr("coalesce(transform(near, c -> cast(c as bigint)), transform(mid, c -> cast(c as bigint)))")
    x = rows.withColumn("_codes", codes)
    lists = {n: F.expr(f"coalesce({n}, transform(filter(_codes, c -> (c & 1) = {odd}), c -> sample_1 + shiftright(c, 1)))") for n, odd in (("alike", 0), ("unlike", 1))}
    return x.withColumns(lists).drop("_codes", *_NARROW)


def dealt(rows: DataFrame) -> DataFrame:
    """Rows dealt by their first sample, to as many tasks as are set: a row becomes many, so they are not to be merged. Partners whose ids are
    longs are shuffled in fewer bytes."""
    to = lambda x: x.repartition(spread(rows.sparkSession), "species", "sample_1")
    if dict(rows.dtypes).get("alike") == dict(rows.dtypes).get("unlike") == "array<bigint>" and dict(rows.dtypes)["sample_1"] == "bigint":
        return _widened(to(_narrowed(rows)))
    return to(rows)


def partnered(rows: DataFrame, at: str = "at", carry: tuple[str, ...] = ()) -> DataFrame:
    """pair, at, carry, differ: a row a pair and site both are called at, multi-allelic sites included. rows: of `partners`, or of `contig_partners`
    (at: contig)."""
    met = F.expr("inline(concat(transform(alike, s -> struct(s as sample_2, false as differ)), transform(unlike, s -> struct(s as sample_2, true as differ))))")
    return rows.select("species", "sample_1", at, *carry, met).select(*PAIR, at, *carry, "differ")


def met_pairs(rows: DataFrame) -> DataFrame:
    """Pairs that are called at one site at least. rows: of `partners`, dealt, so that this is no shuffle."""
    return rows.select("species", "sample_1", F.explode(F.concat("alike", "unlike")).alias("sample_2")).distinct()


#: Counts of a row of `partnered`: name, the first of its bits, the number of bits, and whether only differences count.
_COUNTS = [("len_4d", 1, 1, False), ("diff_4d", 1, 1, True), ("len_1d", 0, 1, False), ("diff_1d", 0, 1, True)]
_COUNTS += [c for i, t in enumerate(TYPES) for c in ((f"mut_{t}", 2 + i, 1, True), (t, 5 + 2 * i, 2, False))]


def _counted(weight: Column) -> list[Column]:
    """Sums of a row's counts times `weight`."""
    d = F.when(F.col("differ"), weight).otherwise(F.lit(0).cast("long"))
    bits = lambda i, n: F.shiftright("at", i).bitwiseAND(F.lit((1 << n) - 1))
    return [F.sum(weight).alias("len"), F.sum(d).alias("diff"), *(F.sum(bits(i, n) * (d if only else weight)).alias(c) for c, i, n, only in _COUNTS)]


def partnered_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """`core_counts` from rows of `partnered`."""
    g = rows.where("(at & 2048) = 0").groupBy(*keys).agg(*_counted(F.lit(1).cast("long")))
    return g.select(*keys, *(F.col(c).alias(f"core_{c}") for c in ("len", "diff", *(c for c, *_ in _COUNTS))))


def partnered_summary(rows: DataFrame, segments: DataFrame | Column | None, within: Column | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """`summary` from rows of `partners`, dealt. segments: pair, start_pos, end_pos, or the array of struct(lo, hi) as an expression of the pair; None
    where `within` tells whether a site is inside, by the pair, at and `carry`.

    The segments of a pair in a table are dealt to where its rows lie and come first among them; nothing else is shuffled. Each sum holds two
    counters of 32 bits, that of all sites and that of sites inside.
    """
    x = partnered(rows, carry=carry).where("(at & 2048) = 0")
    if segments is None:
        x = x.withColumn("segs", F.lit(None))
    elif isinstance(segments, Column):
        x = x.withColumn("segs", segments)
    else:
        lists = dealt(_lists(segments, PAIR, "start_pos", "end_pos"))
        empty = lambda t: F.lit(None).cast(t)
        x = x.withColumn("segs", empty(lists.schema["segs"].dataType)).unionByName(lists.select(*PAIR, empty("long").alias("at"), empty("boolean").alias("differ"), "segs"))
        w = Window.partitionBy("sample_1", "sample_2", "species").orderBy(F.asc_nulls_first("at")).rowsBetween(Window.unboundedPreceding, 0)
        x = x.withColumn("segs", F.last("segs", True).over(w)).where("at is not null")
    inside = F.expr("coalesce(exists(segs, s -> shiftright(at, 12) between s.lo and s.hi), false)") if segments is not None else F.coalesce(within, F.lit(False))
    g = x.withColumn("_w", F.when(inside, F.lit(1 + (1 << 32))).otherwise(F.lit(1).cast("long"))).groupBy(*PAIR).agg(*_counted(F.col("_w")))
    # the row's own count is whole, as what is inside is never more than what is
    all_, recomb = (lambda c: F.col(c).bitwiseAND(F.lit(0xFFFFFFFF))), (lambda c: F.shiftrightunsigned(c, 32))
    names = [c for c, *_ in _COUNTS]
    parts = {"core": all_, "recomb": recomb, "clonal": lambda c: all_(c) - recomb(c)}
    return g.select(*PAIR, all_("len").alias("core_len"), all_("diff").alias("core_diff"), *(of(c).cast("long").alias(f"{part}_{c}") for part, of in parts.items() for c in names))


# --- choosing pairs ------------------------------------------------------------------------------------------------


def canonical(df: DataFrame, a: str = "sample_1", b: str = "sample_2") -> DataFrame:
    """Pairs with the lesser sample first."""
    return df.select("species", F.least(a, b).alias("sample_1"), F.greatest(a, b).alias("sample_2"), *(c for c in df.columns if c not in ("species", a, b)))


def clonal_pairs(close: DataFrame, recombining: DataFrame) -> DataFrame:
    """Close pairs that are in no recombining pair, in either order."""
    return canonical(close).join(canonical(recombining).select(*PAIR).distinct(), PAIR, "left_anti")


def with_similarity(pairs: DataFrame, similarity: DataFrame) -> DataFrame:
    s = similarity.select("species", F.col("sample_a").alias("sample_1"), F.col("sample_b").alias("sample_2"), "frac")
    return pairs.join(s, PAIR)


def any_recombined(similarity: DataFrame, threshold: float) -> DataFrame:
    return similarity.groupBy("species").agg(F.bool_or(F.col("frac") <= threshold).alias("any_recombined"))


def hash_order(seed: int, *cols: str) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in cols)))


def sampled_pairs(similarity: DataFrame, n: int, seed: int, threshold: float | None = None) -> DataFrame:
    """n pairs of distinct samples of each species in seeded hash order, distinct by construction."""
    p = similarity.where("sample_a < sample_b")
    p = p if threshold is None else p.where(F.col("frac") <= threshold)
    p = p.select("species", F.col("sample_a").alias("sample_1"), F.col("sample_b").alias("sample_2"))
    rank = F.row_number().over(Window.partitionBy("species").orderBy(hash_order(seed, *PAIR), "sample_1", "sample_2"))
    return p.withColumn("rank", rank).where(F.col("rank") <= n).select(*PAIR, F.col("rank").cast("long").alias("rank"))


#: Items of one group that a task settles on its own.
RANGE = 1024


def _settled(rows):
    """One range of items in order: stays (true), goes (false), or waits for an earlier range (null). rows: row_id, earlier (null in an
    item's own row), waits."""
    import pandas as pd

    own = rows[rows["earlier"].isna()].sort_values("row_id")
    before: dict = {}
    for later, earlier in rows.loc[rows["earlier"].notna(), ["row_id", "earlier"]].itertuples(index=False):
        before.setdefault(later, []).append(int(earlier))
    stays: dict = {}
    for item, waits in zip(own["row_id"], own["waits"]):
        found = {stays[e] for e in before.get(item, ())}
        stays[item] = False if True in found else None if waits or None in found else True
    return pd.DataFrame({"species": own["species"], "row_id": own["row_id"], "stays": pd.array([stays[i] for i in own["row_id"]], "boolean")})


def independent(items: DataFrame, conflicts: DataFrame, write, width: int = RANGE) -> DataFrame:
    """The lexicographically first independent set of each species: an item stays when no earlier kept item conflicts with it.

    items: species, id; conflicts: species, earlier, later (ids). Items are numbered in order of id and dealt to ranges of `width`. In a
    round each range is settled in one task, as far as it doesn't wait for items of earlier ranges, and what conflicts with kept items
    is dropped from later ranges. The first range that is open is settled whole, so there are no more rounds than a species has
    ranges, however long its chains of conflicts. `write` keeps a round's tables.
    """
    ids = write(numbered(items.select("species", "id").distinct(), "species", ["id"], write).select("species", "id", "row_id"))
    named = lambda c: ids.select("species", F.col("id").alias(c), F.col("row_id").alias(f"{c}_row"))
    edges = conflicts.join(named("earlier"), ["species", "earlier"]).join(named("later"), ["species", "later"])
    edges = write(edges.select("species", F.col("earlier_row").alias("earlier"), F.col("later_row").alias("later")).where("earlier < later"))
    range_of = lambda c: F.expr(f"{c} div {width}")
    left, kept = ids.select("species", "row_id"), None
    while not left.isEmpty():
        near = range_of("earlier") == range_of("later")
        far = edges.where(~near).select("species", F.col("later").alias("row_id")).distinct().withColumn("waits", F.lit(True))
        own = left.join(far, ["species", "row_id"], "left").select("species", "row_id", F.lit(None).cast("long").alias("earlier"), F.coalesce("waits", F.lit(False)).alias("waits"))
        rows = own.unionByName(edges.where(near).select("species", F.col("later").alias("row_id"), "earlier", F.lit(False).alias("waits")))
        schema = f"species {dict(items.dtypes)['species']}, row_id long, stays boolean"
        done = write(rows.groupBy("species", range_of("row_id")).applyInPandas(_settled, schema))
        stays = done.where("stays").select("species", "row_id")
        kept = stays if kept is None else kept.unionByName(stays)
        out = edges.join(stays.withColumnRenamed("row_id", "earlier"), ["species", "earlier"], "left_semi").select("species", F.col("later").alias("row_id")).distinct()
        left = write(done.where("stays is null").select("species", "row_id").join(out, ["species", "row_id"], "left_anti"))
        if not left.isEmpty():
            edges = write(edges.join(left.withColumnRenamed("row_id", "earlier"), ["species", "earlier"], "left_semi").join(left.withColumnRenamed("row_id", "later"), ["species", "later"], "left_semi"))
    return ids.join(kept if kept is not None else left, ["species", "row_id"], "left_semi").select("species", "id")


def sample_conflicts(samples: DataFrame, similarity: DataFrame, too_close: Column) -> DataFrame:
    """species, earlier, later: pairs of `samples` (species, id) that are too close, each once."""
    c = similarity.where(too_close & (F.col("sample_a") < F.col("sample_b"))).select("species", F.col("sample_a").alias("earlier"), F.col("sample_b").alias("later"))
    for end in ("earlier", "later"):
        c = c.join(samples.select("species", F.col("id").alias(end)), ["species", end], "left_semi")
    return c


def deduplicated_pairs(pairs: DataFrame, similarity: DataFrame, threshold: float, write) -> DataFrame:
    """Greedy in order of (sample_1, sample_2): a pair stays if its first sample has similarity of at most `threshold` (below 1) to the
    first sample of every pair kept before.

    A sample's similarity to itself is 1, so of the pairs of one first sample only the least can stay, and whether it does depends on
    first samples alone. So conflicts are between first samples: no more rows than `similarity` has, however many pairs there are.
    """
    first = write(pairs.groupBy("species", "sample_1").agg(F.min("sample_2").alias("sample_2")))
    ids = first.select("species", F.col("sample_1").alias("id"))
    stays = independent(ids, sample_conflicts(ids, similarity, F.col("frac") > threshold), write)
    return first.join(stays.withColumnRenamed("id", "sample_1"), ["species", "sample_1"], "left_semi").select(*PAIR)


def unrelated_samples(samples: DataFrame, similarity: DataFrame, seed_set: DataFrame, threshold: float, write) -> DataFrame:
    """Grow a sample set: in order of id, a sample joins if its similarity to all included is below `threshold`. A species whose
    seed set is empty admits nobody."""
    key = ["species", "sample_id"]
    near = similarity.where((F.col("frac") >= threshold) & (F.col("sample_a") != F.col("sample_b"))).select("species", "sample_a", "sample_b")
    seeded = seed_set.select("species").distinct()
    touched = near.join(seed_set.select("species", F.col("sample_id").alias("sample_a")), ["species", "sample_a"], "left_semi").select("species", F.col("sample_b").alias("sample_id")).distinct()
    pool = samples.select(*key).join(seeded, "species", "left_semi").join(seed_set.select(*key), key, "left_anti").join(touched, key, "left_anti")
    pool = write(pool.withColumnRenamed("sample_id", "id"))
    grown = independent(pool, sample_conflicts(pool, similarity, F.col("frac") >= threshold), write)
    return seed_set.select(*key).unionByName(grown.withColumnRenamed("id", "sample_id"))


def clonal_selection(clonal: DataFrame, similarity: DataFrame, samples: DataFrame, write, floor: int = 5) -> tuple[DataFrame, DataFrame]:
    """Clonal pairs and samples that prevalence is counted on: species of `floor` pairs or more (G11), one pair of each clonal
    cluster (J14), the floor again, and the samples of those pairs grown by unrelated ones (J15)."""

    def enough(pairs: DataFrame) -> DataFrame:
        return pairs.join(pairs.groupBy("species").count().where(F.col("count") >= floor).select("species"), "species", "left_semi")

    similarity = write(similarity)
    kept = write(enough(write(deduplicated_pairs(write(enough(clonal)), similarity, 0.2, write))))
    first = write(kept.select("species", F.explode(F.array("sample_1", "sample_2")).alias("sample_id")).distinct())
    return kept, write(unrelated_samples(samples, similarity, first, 0.5, write))
