"""Column expressions: safe division, model curves, hashed randomness, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def ratio(num, den) -> Column:
    """num / den, null where den is not above 0."""
    return F.when(col(den) > 0, col(num) / col(den))


def finite_positive(*cols) -> Column:
    """All are above 0, and neither infinite nor NaN."""
    out = F.lit(True)
    for c in cols:
        out = out & (col(c) > 0) & (col(c) < float("inf")) & ~F.isnan(col(c).cast("double"))
    return out


def good_bin(min_pairs: int) -> Column:
    """The quality mask of bins: enough pairs, positive counts, finite positive x and R."""
    return (F.col("n_pairs") >= min_pairs) & (F.col("kn") > 0) & (F.col("ks_b") > 0) & finite_positive("ds_x", "r_hat")


def word32(*parts) -> Column:
    """32 random bits from md5 of the parts joined by '|'."""
    text = F.concat_ws("|", *(col(p).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def thinned_half(k, *key) -> Column:
    """Binomial(k, 1/2): set bits among k hashed ones, 32 a hash. 0 for k of 0 or null."""
    k = F.coalesce(col(k).cast("long"), F.lit(0))
    words = F.sequence(F.lit(0), F.greatest(F.ceil(k / 32) - 1, F.lit(0)).cast("int"))
    text = lambda i: F.concat_ws("|", *(col(p).cast("string") for p in key), i.cast("string"))
    bits = lambda i: F.conv(F.substring(F.md5(text(i)), 1, 8), 16, 10).cast("long")
    last = lambda i: F.least(F.lit(32), F.greatest(F.lit(0), k - i * 32)).cast("int")
    set_bits = lambda i: F.bit_count(bits(i).bitwiseAND((F.pow(F.lit(2.0), last(i)) - 1).cast("long"))).cast("long")
    many = F.aggregate(F.transform(words, set_bits), F.lit(0).cast("long"), lambda a, x: a + x)
    # most counts are few: none is hashed for 0, and one hash needs no array
    return F.when(k == 0, F.lit(0).cast("long")).when(k <= 32, set_bits(F.lit(0))).otherwise(many)


def thinned(k, p: float, *key) -> Column:
    """Binomial(k, p): hashed uniforms below p, one hash a trial."""
    k = F.coalesce(col(k).cast("long"), F.lit(0))
    cut = int(p * (1 << 32))
    trials = F.when(k > 0, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.expr("cast(array() as array<long>)"))
    text = lambda i: F.concat_ws("|", *(col(x).cast("string") for x in key), i.cast("string"))
    return F.size(F.filter(trials, lambda i: F.conv(F.substring(F.md5(text(i)), 1, 8), 16, 10).cast("long") < cut)).cast("long")


def log_logistic(ds, mid, k) -> Column:
    return 1 / (1 + F.exp(-col(k) * (F.log10(col(ds)) - F.log10(col(mid)))))


def recombination_model(ds, fr, theta, clonal, recombined) -> Column:
    """struct(ds, dnds): the mixture of clonal divergence ds and a recombined fraction fr at divergence theta."""
    total = col(ds) * (1 - col(fr)) + col(theta) * col(fr)
    dn = col(ds) * (1 - col(fr)) * col(clonal) + col(theta) * col(fr) * col(recombined)
    return F.struct(total.alias("ds"), (dn / total).alias("dnds"))


def decay(x) -> Column:
    """(1 - e^-x) / x, by its series near 0."""
    x = col(x)
    return F.when(F.abs(x) < 1e-12, 1 - x / 2).otherwise(-F.expm1(-x) / x)


def purifying_curve(ds, fd, s_by_mu) -> Column:
    """(1 - fd) + fd (1 - e^-x) / x with x = s ds / 2."""
    return (1 - col(fd)) + col(fd) * decay(col(s_by_mu) * col(ds) / 2)


def three_class_curve(ds, alpha0, alpha1, s1, s2) -> Column:
    """Neutral, weak and strong classes; null where the strong share is negative."""
    alpha2 = 1 - col(alpha0) - col(alpha1)
    value = col(alpha0) + col(alpha1) * decay(col(s1) * col(ds) / 2) + alpha2 * decay(col(s2) * col(ds) / 2)
    return F.when(alpha2 >= 0, value)


def two_class_curve(ds, fd, alpha2, s1, s2) -> Column:
    """Deleterious share fd of which alpha2 is strong (as a share of all)."""
    weak = F.greatest(col(fd) - col(alpha2), F.lit(0.0))
    return 1 - col(fd) + weak * decay(col(s1) * col(ds) / 2) + col(alpha2) * decay(col(s2) * col(ds) / 2)


def linear_errors(x, err, base: float = 10.0, num_se: float = 2.0) -> Column:
    """struct(value, below, above) on the linear scale of a log-scale value and its standard error."""
    v = F.pow(F.lit(base), col(x))
    return F.struct(v.alias("value"), (v - F.pow(F.lit(base), col(x) - num_se * col(err))).alias("below"), (F.pow(F.lit(base), col(x) + num_se * col(err)) - v).alias("above"))


def pretty_species(name, keep_number: bool = False, suffixes: dict[str, str] | None = None) -> Column:
    """The first two parts of a species name, with the third in parentheses where asked for and there is one. Of given names, a blank
    and the suffix follow. A name of one part stays."""
    parts = F.split(col(name), "_")
    out = F.array_join(F.slice(parts, 1, 2), " ")
    if keep_number:
        out = F.when(F.size(parts) >= 3, F.concat(out, F.lit(" ("), F.get(parts, 2), F.lit(")"))).otherwise(out)
    for k, v in (suffixes or {}).items():
        out = F.when(col(name) == k, F.concat(out, F.lit(f" {v}"))).otherwise(out)
    return out


def significant(p, level: float = 0.001) -> Column:
    return col(p) < level
