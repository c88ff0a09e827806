"""The flagship analysis: parse detection limits, form ratios, aggregate, score by deviations, rank."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.anomaly import anomaly
from ..operators.cleaning import parse_detection_limits
from ..operators.derive import compute_ratios
from ..operators.filters import rank_by_metric
from ..operators.relational import aggregate_by


def anomalous_groups(df: DataFrame, assays: list[str], ratio: str, group: str, n: int = 10) -> DataFrame:
    """The n groups whose mean ratio deviates most upwards from the median group, one plan from scan to limit."""
    a, b = ratio.split("/")
    name = f"{a}_over_{b}"
    means = df.transform(parse_detection_limits, assays).transform(compute_ratios, [ratio]).select(group, name)
    scored = anomaly(aggregate_by(means, group, "mean"), [name], "mad")
    return rank_by_metric(scored, f"{name}_anom_mad", n, [group])
