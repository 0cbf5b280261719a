"""Keys that nobody declared: unique columns, and columns whose values another one holds.

All values of all columns are brought together once: for each value, the set of columns
it stands in. Equal sets are counted, so what follows is as small as the number of
different sets, and the pairs of columns in each say how many values two columns share.
A column is a key if its values are all different; column a refers to key b if all values
of a are among those of b. Values are compared within kinds (whole numbers, text, dates).
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, IntegralType, StringType, TimestampNTZType, TimestampType

from velario.session import saved
from velario.sources.tables import FOREIGN_KEY_ROWS


def _kind(data_type):
    if isinstance(data_type, IntegralType) or isinstance(data_type, DecimalType) and not data_type.scale:
        return "n"
    kinds = {"s": StringType, "d": DateType, "t": (TimestampType, TimestampNTZType)}
    return next((k for k, types in kinds.items() if isinstance(data_type, types)), None)


def comparable(df: DataFrame) -> list:
    """The columns that can be keys by their type."""
    return [f.name for f in df.schema.fields if _kind(f.dataType)]


def shared_values(tables: dict, columns=None) -> tuple:
    """The columns as (table, column) and ``(a, b, n)``: values that columns a and b, by
    number, have in common; n of a with itself is its number of different values."""
    names, parts = [], []
    for table, df in sorted(tables.items()):
        kinds = {f.name: _kind(f.dataType) for f in df.schema.fields}
        cells = []
        for column in (columns or {}).get(table, comparable(df)):
            cells.append(F.struct(F.lit(len(names)).alias("place"), F.concat(
                F.lit(kinds[column]), F.col(column).cast("string")).alias("value")))
            names.append((table, column))
        if cells:
            parts.append(df.select(F.inline(F.array(*cells))).where("value is not null").distinct())
    if not parts:
        raise ValueError("no column that could be a key")
    by_value = reduce(DataFrame.unionByName, parts).groupBy("value").agg(F.sort_array(F.collect_set("place")).alias("places"))
    sets = saved(by_value.groupBy("places").agg(F.count(F.lit(1)).alias("n")), "column_sets")
    pairs = sets.select(F.explode("places").alias("a"), "places", "n").select("a", F.explode("places").alias("b"), "n")
    return names, pairs.groupBy("a", "b").agg(F.sum("n").alias("n"))


def discover(tables: dict, columns=None) -> tuple:
    """``(table, column, n_rows, n_values, n_distinct, is_key)`` of each column, and the
    foreign keys ``(t1, c1, t2, c2)``, as ``Constraints`` declares them.

    A key has no null and no value twice. A column without a value refers to nothing.
    """
    names, pairs = shared_values(tables, columns)
    spark = pairs.sparkSession
    pairs = saved(pairs, "column_pairs")
    measured = []
    for table in sorted({t for t, _ in names}):
        own = [(i, c) for i, (t, c) in enumerate(names) if t == table]
        counts = tables[table].agg(F.count(F.lit(1)).alias("n_rows"), *[F.count(F.col(c)).alias(f"v{i}") for i, c in own])
        measured.append(counts.select(F.inline(F.array(*[F.struct(
            F.lit(i).alias("place"), F.lit(table).alias("table"), F.lit(c).alias("column"), F.col("n_rows"),
            F.col(f"v{i}").alias("n_values")) for i, c in own]))))
    alone = pairs.where("a = b").select(F.col("a").alias("place"), F.col("n").alias("n_distinct"))
    found = reduce(DataFrame.unionByName, measured).join(alone, "place", "left").withColumn(
        "n_distinct", F.coalesce("n_distinct", F.lit(0).cast("bigint")))
    found = saved(found.withColumn("is_key", (F.col("n_rows") > 0) & (F.col("n_distinct") == F.col("n_rows"))), "columns_measured")
    child = found.select(F.col("place").alias("a"), F.col("table").alias("t1"), F.col("column").alias("c1"), "n_distinct")
    parent = found.where("is_key").select(F.col("place").alias("b"), F.col("table").alias("t2"), F.col("column").alias("c2"))
    held = pairs.where("a <> b").join(child, "a").join(parent, "b").where("n = n_distinct")
    return found.drop("place"), held.select(*spark.createDataFrame([], FOREIGN_KEY_ROWS).columns)
