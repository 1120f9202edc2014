"""Correlations with p-values, density and ordering (K1 to K6)."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..sources.scratch import kept


def grouped_corr(df: DataFrame, keys: list[str], x: str, y: str, method: str = "pearson") -> DataFrame:
    """n, r and two-sided p for each key (all rows if there is none). Spearman ranks ties by their mean."""
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    if method == "spearman":
        df = kept(df)
        for c in (x, y):
            df = df.join(mean_ranks(df, keys, c), [*keys, c]).drop(c).withColumnRenamed("rank", c)
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.corr(x, y).alias("r"))
    return g.withColumn("p", corr_p("r", "n"))


def counted_values(df: DataFrame, keys: list[str], c: str) -> DataFrame:
    """keys, c, times, before: each value of `c`, how many rows of its key have it, and how many have a lesser one.

    Equal values are counted first, map-side, so ties never meet as rows. The values are then dealt by range, so that no window and no
    buffer holds a whole key: before are the rows of the key in earlier parts and those of lesser values in the same part.
    """
    values = df.groupBy(*keys, c).agg(F.count("*").alias("times"))
    dealt = kept(values.repartitionByRange(*keys, c).withColumn("_part", F.spark_partition_id()))
    w = Window.partitionBy(*keys, "_part").orderBy(c)
    earlier = F.coalesce(F.sum("times").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = dealt.groupBy(*keys, "_part").agg(F.sum("times").alias("_rows"))
    rows = F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))  # a row a part
    parts = parts.select(*keys, "_part", F.coalesce(rows, F.lit(0)).alias("_before"))
    ranked = dealt.withColumn("_earlier", earlier).join(parts, [*keys, "_part"])
    return ranked.select(*keys, c, "times", (F.col("_before") + F.col("_earlier")).alias("before"))


def mean_ranks(df: DataFrame, keys: list[str], c: str) -> DataFrame:
    """keys, c, rank: the mean rank of each value of `c` within its key, from 1."""
    return counted_values(df, keys, c).select(*keys, c, (F.col("before") + (F.col("times") + 1) / 2).alias("rank"))


def exact_quantiles(df: DataFrame, keys: list[str], c: str, shares: list[float]) -> DataFrame:
    """keys, quantiles: those of `c` at each of `shares`, between two neighbours by their distance; nulls are left out.

    The rank sought of each share lies on one value, or between two: these are found by the counts of lesser values, so a key's
    buffer holds two values a share, however many rows there are.
    """
    v = kept(counted_values(df.where(F.col(c).isNotNull()), keys, c))
    sizes = v.groupBy(*keys).agg((F.max(F.col("before") + F.col("times")) - 1).alias("_last"))
    sought = [F.col("_last") * F.lit(float(p)) for p in shares]
    at = lambda rank: F.max(F.when((F.col("before") <= rank) & (rank < F.col("before") + F.col("times")), F.col(c).cast("double")))
    both = [F.struct(at(F.floor(p)).alias("low"), at(F.ceil(p)).alias("high")) for p in sought]
    g = v.join(sizes, keys) if keys else v.crossJoin(sizes)  # one row
    g = g.groupBy(*keys, "_last").agg(*(b.alias(f"_{i}") for i, b in enumerate(both)))
    return g.select(*keys, F.array(*(F.col(f"_{i}.low") + (F.col(f"_{i}.high") - F.col(f"_{i}.low")) * (p - F.floor(p)) for i, p in enumerate(sought))).alias("quantiles"))


def _beta_cf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            c = 1 + num / c
            d = 1 / (d if abs(d) > tiny else tiny)
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_cf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_cf(b, a, 1 - x) / b


@F.pandas_udf(DoubleType())
def corr_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p of a correlation under no association; null for n < 3 or no r. Runs on one row a group."""

    def one(r, n):
        if r is None or r != r or n < 3:
            return None
        if abs(r) >= 1:
            return 0.0
        return incomplete_beta((n - 2) / 2, 0.5, 1 - r * r)

    return pd.Series([one(a, b) for a, b in zip(r, n)], dtype="float64")


def _moments(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"), F.var_samp(x).alias("vx"), F.var_samp(y).alias("vy"), F.covar_samp(x, y).alias("vxy"), F.count("*").alias("total"))


def _cells(df: DataFrame, moments: DataFrame, x: str, y: str, cells: int) -> DataFrame:
    """gx, gy, n, mx, my: occupied cells with the number and mean of their points."""
    cell = lambda c, a, b: F.coalesce(F.least(F.floor(F.try_divide(F.col(c) - F.col(a), F.col(b) - F.col(a)) * cells), F.lit(cells - 1)), F.lit(0))
    return df.crossJoin(F.broadcast(moments)).groupBy(cell(x, "x0", "x1").alias("gx"), cell(y, "y0", "y1").alias("gy")).agg(F.count("*").alias("n"), F.avg(x).alias("mx"), F.avg(y).alias("my"))


def _kernel_sum():
    """Aggregate over sources (n2, mx2, my2) of their kernels at (mx, my), by the moments' bandwidth."""
    h2 = F.pow(F.col("total"), F.lit(-1 / 3))
    det = F.col("vx") * F.col("vy") - F.col("vxy") * F.col("vxy")
    dx, dy = F.col("mx") - F.col("mx2"), F.col("my") - F.col("my2")
    q = (F.col("vy") * dx * dx - 2 * F.col("vxy") * dx * dy + F.col("vx") * dy * dy) / F.when(det != 0, det) / h2
    return F.sum(F.col("n2") * F.exp(-q / 2)) / F.first(F.col("total") * 2 * math.pi * h2 * F.sqrt(F.when(det > 0, det)))


def density(df: DataFrame, x: str, y: str, cells: int = 64) -> DataFrame:
    """Gaussian kernel density (Scott's bandwidth) at each occupied cell of a cells-by-cells grid: gx, gy, n, density.

    Points are summed in cells first, so the kernel sum is over at most cells ** 4 pairs of cells whatever the input.
    """
    df = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    s = _moments(df, x, y)
    g = _cells(df, s, x, y, cells)
    pairs = g.crossJoin(F.broadcast(g.select(F.col("n").alias("n2"), F.col("mx").alias("mx2"), F.col("my").alias("my2")))).crossJoin(F.broadcast(s))
    return pairs.groupBy("gx", "gy", "n").agg(_kernel_sum().alias("density"))


#: Of `point_density`: terms of each expansion, side of a cell in bandwidths, and how many cells away a source still counts.
ORDER, SIDE, REACH = 3, 0.25, 22
_POWERS = [(a, b) for a in range(ORDER + 1) for b in range(ORDER + 1)]


def stencil() -> list[tuple]:
    """(d, g_0, .. g_2 ORDER): derivatives of exp(-t t / 2) at t = d SIDE, for each distance in cells up to REACH."""
    out = []
    for d in range(-REACH, REACH + 1):
        t, he = d * SIDE, [1.0, d * SIDE]
        while len(he) <= 2 * ORDER:
            he.append(t * he[-1] - (len(he) - 1) * he[-2])
        out.append((d, *((-1) ** k * he[k] * math.exp(-t * t / 2) for k in range(2 * ORDER + 1))))
    return out


def _spread() -> Column:
    """The stencil as an array of structs, for F.inline."""
    return F.array(*(F.struct(F.lit(d).cast("long").alias("d"), *(F.lit(v).alias(f"g{k}") for k, v in enumerate(g))) for d, *g in stencil()))


def _translated(power: int, moment) -> Column:
    """What sources of moments moment(0), moment(1), .. add to a target's coefficient of `power`, at the stencil's distance."""
    return sum((moment(a) * F.col(f"g{a + power}") * ((-1) ** a / math.factorial(a) / math.factorial(power)) for a in range(ORDER + 1)), F.lit(0.0))


def _whitened(df: DataFrame, x: str, y: str) -> DataFrame:
    """df with its cell (i, j), the place in it (u, v, from its middle, in bandwidths) and the kernel's norm; Scott's bandwidth."""
    h = F.pow(F.col("total"), F.lit(-1 / 6))
    rest = F.col("vy") - F.try_divide(F.col("vxy") * F.col("vxy"), F.col("vx"))
    dx = F.col(x) - F.col("x0")
    to = {"u": F.try_divide(dx, F.sqrt("vx") * h), "v": F.try_divide(F.col(y) - F.col("y0") - dx * F.try_divide(F.col("vxy"), F.col("vx")), F.sqrt(F.when(rest > 0, rest)) * h)}
    out = df.crossJoin(F.broadcast(_moments(df, x, y))).withColumns(to)  # one row
    out = out.withColumns({"i": F.floor(F.col("u") / SIDE), "j": F.floor(F.col("v") / SIDE), "norm": F.col("total") * 2 * math.pi * h * h * F.sqrt(F.col("vx") * F.when(rest > 0, rest))})
    return out.withColumns({"u": F.col("u") - (F.col("i") + 0.5) * SIDE, "v": F.col("v") - (F.col("j") + 0.5) * SIDE})


def point_density(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys and the Gaussian kernel density (Scott's bandwidth, full covariance) at each point; one row a point.

    Points are put on axes in which the kernel is round and of width 1, in cells of a quarter of it. A cell's points are summed to moments
    up to the third power on either axis; those of cells within 22 on either axis are turned into the coefficients of a polynomial of the
    target's cell, one axis after the other, and a point reads its own cell's polynomial. So rows made are the points, and 45 a cell and
    axis; cells are never more than points and grow with the third root of their number.

    Error: at most 2e-4 of the kernel's peak, 1 / (2 pi h h sqrt(det)), where a kernel density can reach the peak itself. An axis adds at most
    3 / 4! (1/8)^4 for the sources' expansion and 4.8e-5 for the target's (derivatives of exp(-t t / 2) are at most 1.09 sqrt(k!)), both
    twice; what is further off than 22 cells is below exp(-5.5^2 / 2) = 3e-7.

    Rows without x or y are left out. Where all points lie on a line, and for fewer than three, the density is null.
    """
    points = _whitened(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y), x, y)
    moments = [F.sum(F.pow("u", F.lit(a)) * F.pow("v", F.lit(b))).alias(f"m{a}_{b}") for a, b in _POWERS]
    cells = kept(points.where("i is not null and j is not null").groupBy("i", "j").agg(*moments))
    across = cells.select("*", F.inline(_spread())).groupBy((F.col("i") + F.col("d")).alias("i"), "j")
    across = across.agg(*(F.sum(_translated(p, lambda a, b=b: F.col(f"m{a}_{b}"))).alias(f"a{p}_{b}") for p, b in _POWERS))
    targets = cells.select("i", F.col("j").alias("to"), F.inline(_spread())).withColumn("j", F.col("to") - F.col("d"))
    local = targets.join(across, ["i", "j"]).groupBy("i", F.col("to").alias("j"))
    local = local.agg(*(F.sum(_translated(q, lambda b, p=p: F.col(f"a{p}_{b}"))).alias(f"l{p}_{q}") for p, q in _POWERS))
    value = sum((F.col(f"l{p}_{q}") * F.pow("u", F.lit(p)) * F.pow("v", F.lit(q)) for p, q in _POWERS), F.lit(0.0))
    return points.join(local, ["i", "j"], "left").select(*keys, F.try_divide(value, F.col("norm")).alias("density"))


def top_n(df: DataFrame, by: list[str], n: int | None = None, desc: bool = True) -> DataFrame:
    first, *rest = by
    out = df.orderBy(F.desc(first) if desc else F.asc(first), *rest)
    return out.limit(n) if n is not None else out
