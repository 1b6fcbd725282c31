"""Column access by exact name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(name: str) -> Column:
    """A top-level column whatever its name holds: dots, spaces and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")
