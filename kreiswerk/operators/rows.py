"""Single evaluation of expensive expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed(df: DataFrame, *columns: Column | str) -> DataFrame:
    """``df.select(columns)``, with every column evaluated exactly once per row.

    Filters over a projection, and the emptiness test Spark adds under an explode, are moved below
    the projection together with a second copy of the expressions they test. Parsing a page twice
    or three times is what that means here, so the row is passed through a generator, which
    filters do not cross.
    """
    return df.select(F.explode(F.array(F.struct(*columns))).alias("row")).select("row.*")
