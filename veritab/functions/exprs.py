"""Column expressions shared by the operators.

Everything here returns a ``pyspark.sql.Column`` built from built-in
functions, so it stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values that must match the reference's results.
EPS_REL = 1e-10        # added to |reference mean| / |reference std| in numeric drift
EPS_SHARE = 1e-10      # replaces a zero category share in categorical drift
DRIFT_THRESHOLD = 0.1  # dataset drift is detected above this mean score
TWO_POW_32 = 4294967296.0

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType, T.BooleanType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)


def qcol(name: str) -> Column:
    """Column by name, safe for names with dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric_type(dt: T.DataType) -> bool:
    return isinstance(dt, NUMERIC_TYPES)


def as_double(name: str, dt: T.DataType) -> Column:
    """Numeric column as DOUBLE with NaN mapped to NULL (booleans become 0/1)."""
    c = qcol(name).cast("double")
    if isinstance(dt, FLOAT_TYPES):
        c = F.nanvl(c, F.lit(None).cast("double"))
    return c


def as_category(name: str, dt: T.DataType) -> Column:
    """Any column as a STRING category; NaN in float columns becomes NULL."""
    if isinstance(dt, FLOAT_TYPES):
        return F.nanvl(qcol(name).cast("double"), F.lit(None).cast("double")).cast("string")
    return qcol(name).cast("string")


def corrected_skew(x: Column) -> Column:
    """Bias-corrected sample skewness (the pandas ``skew``).

    NULL for fewer than 3 values, 0 for a constant column.
    """
    n = F.count(x).cast("double")
    g1 = F.skewness(x)
    corr = g1 * F.sqrt(n * (n - 1)) / (n - 2)
    return (F.when(n < 3, F.lit(None).cast("double"))
            .when(F.stddev_samp(x) == 0, F.lit(0.0))
            .otherwise(corr))


def pairwise_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both are present.

    NULL (never an error) when either side is constant.
    """
    both = x.isNotNull() & y.isNotNull()
    sx = F.stddev_samp(F.when(both, x))
    sy = F.stddev_samp(F.when(both, y))
    return F.try_divide(F.covar_samp(x, y), sx * sy)


def row_hash32(key: Column, seed: int = 42) -> Column:
    """Deterministic 32-bit hash in [0, 2^32) of ``key`` and ``seed``.

    md5 is used because an independent engine can compute the same value
    (``('0x'||substr(md5(k||':42'),1,8))::bigint`` in DuckDB), which makes
    splits and folds checkable row by row.
    """
    hexpart = F.substring(F.md5(F.concat(key.cast("string"), F.lit(f":{seed}"))), 1, 8)
    return F.conv(hexpart, 16, 10).cast("bigint")


def keyed_hash32(df: DataFrame, key: str | None, seed: int = 42) -> Column:
    """``row_hash32`` of the key; rows without a key, or with a NULL one, by
    the hash of the whole row, so that NULL keys spread like any others."""
    rows = whole_row_hash32(df, seed)
    return rows if key is None else F.coalesce(row_hash32(qcol(key), seed), rows)


def whole_row_hash32(df: DataFrame, seed: int = 42) -> Column:
    """32-bit hash of the whole row (equal rows share it), JVM-native xxhash64."""
    return F.pmod(F.xxhash64(*[qcol(c) for c in df.columns], F.lit(seed)), F.lit(1 << 32))
