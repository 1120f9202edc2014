"""Divergence estimators, binning, Poisson rates and the bootstrap."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import col, finite_positive, ratio, thinned, thinned_half, word32
from .stats import exact_quantiles

EPS = 1e-12
#: Draws that one row of the draw table stands for before it is unfolded.
BLOCK = 10_000
#: Rows of a group that are drawn from where they lie.
PART = 256


def naive(df: DataFrame) -> DataFrame:
    """dS, dN and dN/dS of the core, recombined and clonal parts of each pair."""
    out = df
    for part in ("core", "recomb", "clonal"):
        ds, dn = ratio(f"{part}_diff_4d", f"{part}_len_4d"), ratio(f"{part}_diff_1d", f"{part}_len_1d")
        out = out.withColumns({f"{part}_ds": ds, f"{part}_dn": dn, f"{part}_dnds": ratio(dn, ds)})
    return out


def halves(diffs, opps, *key) -> tuple[Column, Column]:
    """Poisson thinning at one half: two independent rates of the same sites."""
    a = thinned_half(diffs, *key)
    return ratio(a, col(opps) / 2), ratio(col(diffs) - a, col(opps) / 2)


def split_by_thinning(df: DataFrame, p: float, *key) -> DataFrame:
    """ks_a ~ Bin(ks, p), ks_b the rest, lengths split alike, ds_a and ds_b with lengths of EPS at least. df: kn, ln, ks, ls."""
    a = thinned_half("ks", *key) if p == 0.5 else thinned("ks", p, *key)
    out = df.withColumn("ks_a", a).withColumn("ks_b", F.col("ks") - F.col("ks_a")).withColumn("ls_a", F.col("ls") * p).withColumn("ls_b", F.col("ls") * (1 - p))
    return out.withColumn("ds_a", F.col("ks_a") / F.greatest("ls_a", F.lit(EPS))).withColumn("ds_b", F.col("ks_b") / F.greatest("ls_b", F.lit(EPS)))


CLASSES = ("all", "missense", "nonsense")


def _class_counts(part: str) -> dict[str, tuple]:
    """Mutations and opportunities of each class: all (1D differences), missense and nonsense (opportunities / 3)."""
    return {"all": (f"{part}_diff_1d", F.col(f"{part}_len_1d").cast("double")), "missense": (f"{part}_mut_m", F.col(f"{part}_m") / 3), "nonsense": (f"{part}_mut_n", F.col(f"{part}_n") / 3)}


def by_class(df: DataFrame, part: str = "clonal") -> DataFrame:
    """One row for each pair and mutation class: all (1D differences), missense and nonsense (opportunities / 3)."""
    rows = F.array(*(F.struct(F.lit(k).alias("mut_class"), F.col(n).alias("kn"), ln.alias("ln")) for k, (n, ln) in _class_counts(part).items()))
    keys = [c for c in df.columns if c in ("species", "sample_1", "sample_2", "rep")]
    return df.select(*keys, F.explode(rows).alias("c"), F.col(f"{part}_diff_4d").alias("ks"), F.col(f"{part}_len_4d").cast("double").alias("ls")).select(*keys, "c.*", "ks", "ls")


#: Columns of `beside` that differ by class.
BESIDE = [f"{c}_{k}" for k in CLASSES for c in ("kn", "ln")]


def beside(df: DataFrame, keys: list[str], part: str = "clonal") -> DataFrame:
    """`by_class` with the classes in columns (BESIDE), ks and ls: a row a pair, so that a pair is drawn, thinned and binned once."""
    cols = [x.alias(f"{c}_{k}") for k, (n, ln) in _class_counts(part).items() for c, x in (("kn", F.col(n)), ("ln", ln))]
    return df.select(*keys, *cols, F.col(f"{part}_diff_4d").alias("ks"), F.col(f"{part}_len_4d").cast("double").alias("ls"))


def class_sums(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, mut_class, some (whether ln is above 0), n, ds and the sums that `pooled_bins` takes, of rows of `beside` after thinning. Rows
    are summed before they are dealt to classes; pairs with and without opportunities stay apart."""
    some = sum((F.when(F.col(f"ln_{k}") > 0, 1 << i).otherwise(0) for i, k in enumerate(CLASSES)), F.lit(0))
    g = df.groupBy(*keys, some.alias("_some")).agg(*(F.sum(c).alias(c) for c in (*BESIDE, "ks_a", "ks_b", "ls_a", "ls_b")), F.sum("ds_a").alias("ds"), F.count("*").alias("n"))
    return classed(g, keys)


def classed(g: DataFrame, keys: list[str]) -> DataFrame:
    """`class_sums` of sums by keys and _some (a bit for each class whose ln is above 0): a row a class."""
    rows = F.array(*(F.struct(F.lit(k).alias("mut_class"), (F.col("_some").bitwiseAND(F.lit(1 << i)) > 0).alias("some"), F.col(f"kn_{k}").alias("kn"), F.col(f"ln_{k}").alias("ln")) for i, k in enumerate(CLASSES)))
    return g.select("*", F.inline(rows)).select(*keys, "mut_class", "some", "n", "ds", "kn", "ln", "ks_a", "ks_b", "ls_a", "ls_b")


def pooled_sums(sums: DataFrame, keys: list[str]) -> DataFrame:
    """`pooled_bins` of rows of `class_sums`."""
    g = sums.where("bin is not null").groupBy(*keys, "bin").agg(*(F.sum(c).alias(c) for c in ("kn", "ln", "ks_a", "ks_b", "ls_a", "ls_b")), F.sum("n").alias("n_pairs"))
    return _with_rates(g)


def _with_rates(g: DataFrame) -> DataFrame:
    return g.withColumn("ds_x", ratio("ks_a", "ls_a")).withColumn("r_hat", ratio(ratio("kn", "ln"), ratio("ks_b", "ls_b")))


def log_edges(x, n_bins: int) -> Column:
    """Aggregate: n_bins + 1 log-spaced edges over the positive values; the last is their maximum exactly."""
    pos = F.when(col(x) > 0, col(x))
    low, high = F.min(pos), F.max(pos)
    inner = F.transform(F.sequence(F.lit(0), F.lit(n_bins - 1)), lambda i: low * F.pow(high / low, i / n_bins))
    return F.when(low.isNotNull(), F.concat(inner, F.array(high)))


def quantile_edges(df: DataFrame, keys: list[str], x: str, n_bins: int, repeats: bool = False) -> DataFrame:
    """keys, e: equal-count edges of the positive values without repeats; keys with fewer than three are left out. repeats: all n_bins + 1
    edges of every key, as they fall."""
    q = exact_quantiles(df.where(F.col(x) > 0), keys, x, [i / n_bins for i in range(n_bins + 1)])
    if repeats:
        return q.select(*keys, F.col("quantiles").alias("e"))
    return q.select(*keys, F.array_distinct("quantiles").alias("e")).where(F.size("e") >= 3)


def auto_bin_count(n, target: int, low: int, high: int, per_bin: int) -> Column:
    """n // target between low and high; 0 if n is below per_bin * low."""
    return F.when(col(n) < per_bin * low, 0).otherwise(F.least(F.greatest(F.floor(col(n) / target), F.lit(low)), F.lit(high))).cast("long")


def bin_of(x, edges, n_bins: int | None = None) -> Column:
    """Right-closed bin of x, from 0; the lowest edge is in bin 0; null outside. n_bins: where the number of edges is known, n_bins + 1, no
    array is filtered."""
    x, e = col(x), col(edges)
    less = F.size(F.filter(e, lambda v: v < x)) if n_bins is None else sum((F.when(F.get(e, F.lit(i)) < x, 1).otherwise(0) for i in range(n_bins + 1)), F.lit(0))
    return F.when((x >= F.element_at(e, 1)) & (x <= F.element_at(e, -1)), F.greatest(less - 1, F.lit(0))).cast("long")


def pooled_bins(df: DataFrame, keys: list[str], min_pairs: int = 1, strict: bool = False) -> DataFrame:
    """Sums in each bin, dS_x from one half and R from the other. df: bin, kn, ln, ks_a, ks_b, ls_a, ls_b.

    strict leaves pairs without opportunities or without differences in the second half out first, which biases R down.
    """
    df = df.where("bin is not null")
    if strict:
        df = df.where("ln > 0 and ls_b > 0 and ks_b > 0")
    g = df.groupBy(*keys, "bin").agg(*(F.sum(c).alias(c) for c in ("kn", "ln", "ks_a", "ks_b", "ls_a", "ls_b")), F.count("*").alias("n_pairs"))
    return _with_rates(g.where(F.col("n_pairs") >= min_pairs))


def species_means(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One bin for each species (and class) over pairs with dS_a above 0, in order of dS_x."""
    keys = keys or ["species"]
    return pooled_bins(df.where("ds_a > 0").withColumn("bin", F.lit(0).cast("long")), keys).drop("bin").orderBy("ds_x", *keys)


def enough_bins(curves: DataFrame, least: int = 3) -> DataFrame:
    """Curves of species that have `least` bins in some class."""
    ok = curves.groupBy("species", "mut_class").count().where(F.col("count") >= least).select("species").distinct()
    return curves.join(ok, "species", "left_semi")


def usable(df: DataFrame, x: str = "ds_x", r: str = "r_hat") -> DataFrame:
    return df.where(finite_positive(x, r))


# --- rates ---------------------------------------------------------------------------------------------------------


def poisson_rate(k, n) -> tuple[Column, Column]:
    """Aggregates: log rate and its standard error, ln(sum k / sum n) and 1 / sqrt(sum k); null if no event or an exposure of 0."""
    k, n = col(k), col(n)
    ok = (F.sum(k) > 0) & (F.min(n) > 0)
    return F.when(ok, F.log(F.try_divide(F.sum(k), F.sum(n)))), F.when(ok, F.try_divide(F.lit(1.0), F.sqrt(F.sum(k))))


def binned_rates(df: DataFrame, x, counts: dict[str, tuple], edges: tuple[float, float, int], keys: list[str] | None = None) -> DataFrame:
    """Log10 rates and errors of each (count, exposure) in log bins (open on both sides) with at least two pairs."""
    low, high, n = edges
    step = math.log(high / low) / (n - 1)
    e = F.array(*(F.lit(low * math.exp(i * step)) for i in range(n)))
    rows = df.withColumn("_x", col(x)).withColumn("_e", e).withColumn("bin", F.size(F.filter("_e", lambda v: v < F.col("_x"))) - 1)
    rows = rows.where((F.col("bin") >= 0) & (F.col("bin") < n - 1)).where(F.col("_x") < F.element_at("_e", F.col("bin") + 2))
    out = []
    for name, (k, ln) in counts.items():
        rate, se = poisson_rate(k, ln)
        out += [(rate * math.log10(math.e)).alias(f"{name}_rate"), (se * math.log10(math.e)).alias(f"{name}_se")]
    return rows.groupBy(*(keys or []), F.col("bin").cast("long").alias("bin")).agg(F.count("*").alias("n_pairs"), *out).where("n_pairs >= 2")


# --- bootstrap -----------------------------------------------------------------------------------------------------


def numbered(df: DataFrame, group: str, order: list[str], write) -> DataFrame:
    """Adds a dense row id within each group in order, and the group's size, without a window over a whole group: rows are dealt by
    range and numbered within a part, and a small table of counts (a row for each group and part) gives each part's first number.
    `write` keeps the dealt rows, so that both readings of them agree."""
    dealt = write(df.repartitionByRange(group, *order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(group)
    before = F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    first = counts.select(group, "_part", F.coalesce(before, F.lit(0)).alias("_first"), F.sum("_n").over(w).alias("n_rows"))
    at = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order)) - 1
    return dealt.withColumn("_at", at).join(first, [group, "_part"]).withColumn("row_id", (F.col("_first") + F.col("_at")).cast("long")).drop("_part", "_at", "_first")


def spread(spark) -> int:
    """For few rows, each of which becomes many: they are spread by number, as adaptive execution would merge them into one task."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _part_draws(sizes: DataFrame, group: str, replicates: int, seed: int) -> DataFrame:
    """group, part, draws (array of rep, m): how many of a replicate's n draws fall on each part of a group, counted map-side. A group
    of one part has all n there."""
    reps = F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))
    each = sizes.select(group, "size", reps.alias("rep"))
    blocks = F.explode(F.expr(f"sequence(0L, (size - 1) div {BLOCK}L)"))
    many = each.where(F.col("size") > PART).select("*", blocks.alias("_block")).repartition(spread(sizes.sparkSession), group, "rep", "_block")
    many = many.select(group, "size", "rep", F.explode(F.expr(f"sequence(_block * {BLOCK}L, least(size, (_block + 1) * {BLOCK}L) - 1)")).alias("draw"))
    row = F.shiftright(word32(F.lit(seed), F.lit("part"), group, "rep", "draw") * F.col("size"), 32)
    many = many.groupBy(group, "rep", F.floor(row / PART).alias("part")).agg(F.count("*").alias("m"))
    one = each.where(F.col("size") <= PART).select(group, "rep", F.lit(0).cast("long").alias("part"), F.col("size").alias("m"))
    return many.unionByName(one).groupBy(group, "part").agg(F.collect_list(F.struct("rep", "m")).alias("draws"))


def resampled(df: DataFrame, group: str, order: list[str], replicates: int, seed: int, write, carry: list[str] | None = None) -> DataFrame:
    """n-of-n draws with replacement of each group: rep, draw, and the drawn rows. write: see `numbered`. carry: the columns of the drawn rows
    that are wanted; None: all.

    A group's rows lie in parts of PART. First only the number of a replicate's draws that fall on each part is drawn, then each part
    draws that many of its own rows, where they lie. So rows are shuffled once, whatever the number of replicates, and what is
    shuffled for a replicate is a count a part. draw is the part times 2^32 and the draw's number in it.
    """
    n = numbered(df, group, order, write)
    rows = F.sort_array(F.collect_list(F.struct("row_id", *([c for c in df.columns if c != group] if carry is None else carry)))).alias("rows")
    parts = write(n.groupBy(group, F.expr(f"row_id div {PART}L").alias("part")).agg(rows, F.max("n_rows").alias("size")))
    sizes = parts.groupBy(group).agg(F.max("size").alias("size"))
    x = parts.drop("size").join(_part_draws(sizes, group, replicates, seed), [group, "part"])
    x = x.repartition(spread(df.sparkSession), group, "part")
    x = x.select(group, "part", "rows", F.explode("draws").alias("d")).select(group, "part", "rows", "d.rep", "d.m")
    number = lambda j: F.col("part") * (1 << 32) + j
    at = lambda j: F.shiftright(word32(F.lit(seed), group, "rep", number(j)) * F.size("rows"), 32).cast("int") + 1
    drawn = F.transform(F.sequence(F.lit(0).cast("long"), F.col("m") - 1), lambda j: F.struct(number(j).alias("draw"), F.element_at("rows", at(j)).alias("row")))
    x = x.select(group, "rep", F.explode(drawn).alias("x")).select(group, "rep", "x.draw", "x.row.*")
    return x.drop("row_id")


def poisson_weights(df: DataFrame, key: list[str], replicates: int, seed: int, zeros: bool = False) -> DataFrame:
    """The scale option: each row has a Poisson(1) weight in each replicate, with no draw table and no join. zeros: rows of weight 0 stay."""
    u = word32(F.lit(seed), "rep", *key) / float(1 << 32)
    cdf, p, total = [], math.exp(-1), 0.0
    for k in range(12):
        total += p
        cdf.append(total)
        p /= k + 1
    out = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep")).withColumn("_u", u)
    weight = sum((F.when(F.lit(c) <= F.col("_u"), 1).otherwise(0) for c in cdf), F.lit(0)).cast("long")
    out = out.withColumn("weight", weight).drop("_u")
    return out if zeros else out.where("weight > 0")


def intervals(df: DataFrame, keys: list[str], x: str, log_scale: bool) -> DataFrame:
    """Median and 95 % interval over replicates, nulls and NaN left out; in log space where log_scale."""
    v = F.when(F.isnan(F.col(x)), None).otherwise(F.col(x))
    v = F.when(v > 0, F.log(v)) if log_scale else v
    q = df.groupBy(*keys).agg(F.percentile(v, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975))).alias("q"))
    out = [F.col("q")[i] for i in range(3)]
    out = [F.exp(c) for c in out] if log_scale else out
    return q.select(*keys, out[1].alias("r_med"), out[0].alias("r_lo"), out[2].alias("r_hi"))
