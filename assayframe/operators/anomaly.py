"""Anomaly scores over whole columns; statistics are one broadcast row, or literals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import col, require
from .derive import with_statistics
from .selection import order_statistics


def anomaly(df: DataFrame, columns: list[str], method: str = "zscore", approx: bool = False) -> DataFrame:
    """c_anom_z = (x - mean) / sample deviation, c_anom_mad = 0.6745 (x - median) / MAD, or c_anom_ratio = x / mean.

    A divisor of zero gives null. Medians are exact (see selection) and literals of the plan; approx takes them from sketches.
    """
    require(df, columns)
    x = lambda c: col(c).cast("double")
    if method == "zscore":
        out = with_statistics(df, {f"_m{k}": F.avg(x(c)) for k, c in enumerate(columns)} | {f"_s{k}": F.stddev_samp(x(c)) for k, c in enumerate(columns)})
        new = {f"{c}_anom_z": F.try_divide(x(c) - F.col(f"_m{k}"), F.col(f"_s{k}")) for k, c in enumerate(columns)}
    elif method == "mad":
        if approx:
            median = lambda v: F.percentile_approx(v, F.lit(0.5), F.lit(10000))
            out = with_statistics(df, {f"_m{k}": median(x(c)) for k, c in enumerate(columns)})
            out = with_statistics(out, {f"_s{k}": median(F.abs(x(c) - F.col(f"_m{k}"))) for k, c in enumerate(columns)})
        else:
            middle = order_statistics(df, {c: x(c) for c in columns}, [0.5])
            number = lambda v: F.lit(v).cast("double")
            spread = order_statistics(df, {c: F.abs(x(c) - number(middle[c][0])) for c in columns}, [0.5])
            out = df.withColumns({f"_m{k}": number(middle[c][0]) for k, c in enumerate(columns)} | {f"_s{k}": number(spread[c][0]) for k, c in enumerate(columns)})
        new = {f"{c}_anom_mad": F.try_divide(0.6745 * (x(c) - F.col(f"_m{k}")), F.col(f"_s{k}")) for k, c in enumerate(columns)}
    elif method == "ratio":
        out = with_statistics(df, {f"_m{k}": F.avg(x(c)) for k, c in enumerate(columns)})
        new = {f"{c}_anom_ratio": F.try_divide(x(c), F.col(f"_m{k}")) for k, c in enumerate(columns)}
    else:
        raise ValueError(f"method must be zscore, mad or ratio, not {method!r}")
    return out.withColumns(new).select(*df.columns, *new)
