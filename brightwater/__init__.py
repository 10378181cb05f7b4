"""Analytics on Spark: relational, search, graph, vector, spatial and incremental operators."""


def register(spark, *names: str) -> None:
    """Make the dialect's functions callable in spark.sql (see functions/surface.py)."""
    from .functions.surface import register as make

    make(spark, *names)
