"""As-of joins: the last right row before each left row.

Spark has none. Both sides are one table dealt by ranges of (key, time); a window finds the last right row within a range, and
a running maximum over the small table of ranges tells what came before it. No pairs are made, and one key may hold most rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plethora.operators.order_stats import running_max


def asof(left: DataFrame, right: DataFrame, key: str, time: str, inclusive: bool = False, take: str | None = None, out: str = "prev") -> DataFrame:
    """left with out: the time (or the column `take`) of the last right row of its key before it (or at its time, if inclusive). time: a long."""
    take = take or time
    marked = left.withColumns({"_right": F.lit(None).cast(right.schema[time].dataType), "_take": F.lit(None).cast(right.schema[take].dataType), "_side": F.lit(0)})
    other = right.select(F.col(key), F.col(time), F.col(time).alias("_right"), F.col(take).alias("_take"), F.lit(1).alias("_side"))
    both = marked.unionByName(other, allowMissingColumns=True)
    last = F.when(F.col("_right").isNotNull(), F.struct("_right", "_take"))
    found = running_max(both, [key], [F.asc(time)], {"_found": last}, inclusive, ties=True)
    return found.where("_side = 0").withColumn(out, F.col("_found")["_take"]).drop("_right", "_take", "_side", "_found")
