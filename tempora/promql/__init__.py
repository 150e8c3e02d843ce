"""A metric query language compiled to DataFrames: a whole step grid is one plan."""

from tempora.promql.engine import Engine, MetricError

__all__ = ["Engine", "MetricError"]
