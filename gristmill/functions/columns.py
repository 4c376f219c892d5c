"""Column expressions that the operators share. Missing is NULL; NaN and infinities become NULL at ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# fixed values: the rational approximations of Wichura's AS241 for the inverse normal
AS241_A = (3.3871328727963666080, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3)
AS241_B = (1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3)
AS241_C = (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4)
AS241_D = (1.0, 2.05319162663775882187, 1.67638483018380384940, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9)
AS241_E = (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7)
AS241_F = (1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15)


def finite(c: Column) -> Column:
    """The value, or NULL for NaN and infinities."""
    return F.when(~(F.isnan(c) | (F.abs(c) == float("inf"))), c)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation as an aggregate; NULL where a side has no variance."""
    return F.try_divide(F.covar_pop(x, y), F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))


def compounded(c: Column) -> Column:
    """Product of (1 + x) minus 1 over a group; missing values are left out."""
    return F.exp(F.sum(F.log1p(c))) - 1


def average_rank(keys: list[str], value: str) -> Column:
    """Rank within keys from 1, ties sharing the mean of their ranks."""
    return F.rank().over(W.partitionBy(*keys).orderBy(value)) + (F.count(F.lit(1)).over(W.partitionBy(*keys, value)) - 1) / 2.0


def bucket(rank0: Column, n: Column, buckets: int) -> Column:
    """min(rank0 * buckets div n, buckets - 1) for ranks from 0."""
    return F.least(F.floor(rank0 * buckets / n), F.lit(buckets - 1)).cast("int")


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal distribution (AS241)."""

    def ratio(up: tuple, down: tuple, r: Column) -> Column:
        def horner(cs: tuple) -> Column:
            out = F.lit(cs[-1])
            for c in reversed(cs[:-1]):
                out = out * r + F.lit(c)
            return out

        return horner(up) / horner(down)

    q = p - 0.5
    tail = F.sqrt(-F.ln(F.least(p, 1 - p)))
    far = F.when(tail <= 5, ratio(AS241_C, AS241_D, tail - 1.6)).otherwise(ratio(AS241_E, AS241_F, tail - 5.0))
    return F.when(F.abs(q) <= 0.425, q * ratio(AS241_A, AS241_B, 0.180625 - q * q)).when((p > 0) & (p < 1), F.signum(q) * far)


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, without negative zero."""
    return df.select(*[(F.round(F.col(c), digits) + F.lit(0.0)).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])
