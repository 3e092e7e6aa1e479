"""Configuration-sized tables: what may be broadcast, and the check that it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a rule, account or alias table that a household configures.
CONFIG_ROWS = 10_000


def config_table(df: DataFrame, most: int = CONFIG_ROWS) -> DataFrame:
    """``df`` to broadcast; more than ``most`` rows are refused, as they can't be a configuration."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a configuration table has over {most} rows")
    return F.broadcast(df)
