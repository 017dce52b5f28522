"""Evidence-graph analytics on Spark: DataFrame operators, plans and queries."""

__version__ = "0.1.0"
