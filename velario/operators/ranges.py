"""Key ranges of a fixed number of rows, for writing a table in steps."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velario.session import saved


def numbered(df: DataFrame, key: str) -> DataFrame:
    """``(key, __number)``: the 0-based place of each key in order, exactly.

    A global ``row_number`` would sort everything in one task. Spark range-partitions
    the keys, of any type that has an order; each part is numbered by itself, and
    the parts' sizes (one row each) give the offsets. The parts are written first,
    for sizes and numbers must speak of the same cuts.
    """
    parts = saved(df.select(key).repartitionByRange(key).withColumn("__part", F.spark_partition_id()), "ordered_keys")
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    # one row per part: the only window here without a partition is over those
    offsets = sizes.select("__part", F.coalesce(F.sum("__size").over(
        Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(key)) - 1
    return parts.withColumn("__inside", inside).join(offsets, "__part").select(
        key, (F.col("__offset") + F.col("__inside")).alias("__number"))


def range_bounds(df: DataFrame, key: str, rows_per_range: int) -> DataFrame:
    """``(range, upto, n_rows)``: the key of the last row of each range of n rows."""
    return (numbered(df.select(key).where(F.col(key).isNotNull()), key)
            .groupBy(F.floor(F.col("__number") / rows_per_range).alias("range"))
            .agg(F.max(key).alias("upto"), F.count(F.lit(1)).alias("n_rows")))


def next_bound(df: DataFrame, key: str, last, count: int) -> DataFrame:
    """The key of the ``count``-th row after ``last`` (or of the last row there is)."""
    rest = df.select(key).where(F.col(key).isNotNull())
    if last is not None:
        rest = rest.where(F.col(key) > F.lit(last).cast(df.schema[key].dataType))
    return rest.orderBy(key).limit(count).agg(F.max(key).alias("upto"))
