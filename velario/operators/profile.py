"""Counting, sampling and emptying columns."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def existing(df: DataFrame, columns):
    """The requested columns the table has, in the requested order."""
    return [c for c in columns if c in df.columns]


def profile(df: DataFrame, columns=None, approximate=False) -> DataFrame:
    """``(column, n_rows, n_values, n_distinct)`` for each column.

    Without ``columns`` only rows are counted: ``(None, n_rows, None, None)``.
    Exact distinct counts group each column by itself, which reads that column alone
    and shuffles each task's distinct values with their numbers of rows; one pass for
    all columns would shuffle rows as wide as all of them. ``df`` should be a stored
    table, or be saved before. ``approximate`` is one pass without a shuffle of values.
    """
    if not columns:
        return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
            F.lit(None).cast("string").alias("column"), "n_rows",
            F.lit(None).cast("bigint").alias("n_values"), F.lit(None).cast("bigint").alias("n_distinct"))
    if not approximate:
        return reduce(DataFrame.unionByName, [_exact(df, c) for c in columns])
    # Positions rather than names in the aliases: a column may be called anything.
    measures = [F.count(F.lit(1)).alias("n_rows")]
    for i, c in enumerate(columns):
        measures += [F.count(F.col(c)).alias(f"v{i}"), F.approx_count_distinct(F.col(c)).alias(f"d{i}")]
    cells = [F.struct(F.lit(c).alias("column"), F.col("n_rows"), F.col(f"v{i}").alias("n_values"),
                      F.col(f"d{i}").alias("n_distinct")) for i, c in enumerate(columns)]
    return df.agg(*measures).select(F.inline(F.array(*cells)))


def _exact(df, column) -> DataFrame:
    """One column's counts, from the number of rows that hold each value."""
    each = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    none = F.lit(0).cast("bigint")
    return each.agg(F.coalesce(F.sum("n"), none).alias("n_rows"),
                    F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), none).alias("n_values"),
                    F.count("value").alias("n_distinct")).select(F.lit(column).alias("column"), "*")


def first_rows(df: DataFrame, columns, n=30, order_by=None) -> DataFrame:
    """The first rows, only the columns asked for; unknown columns are ignored.

    Any rows will do for a look, so nothing is sorted unless ``order_by`` is given
    (a top-n then, merged from per-task top-n lists).
    """
    keep = existing(df, columns)
    if not keep:
        return df.select([]).limit(0)
    if order_by:
        df = df.orderBy(*[order_by] if isinstance(order_by, str) else order_by)
    return df.select(keep).limit(n)


def sample_values(df: DataFrame, column: str, n=200) -> DataFrame:
    """A few non-null values to look at; reads only as many files as it needs."""
    return df.where(F.col(column).isNotNull()).select(column).limit(n)


def distinct_values(df: DataFrame, column: str, key=None, after=None) -> DataFrame:
    """Distinct non-null values, of the rows beyond ``after`` if a key is given."""
    rows = df.where(F.col(column).isNotNull())
    if key is not None and after is not None:
        # the typed literal keeps numbers from being compared as text
        rows = rows.where(F.col(key) > F.lit(after).cast(df.schema[key].dataType))
    return rows.select(column).distinct()


def nullify(df: DataFrame, columns) -> DataFrame:
    """The table with the columns emptied; types, names and order stay."""
    gone = set(columns)
    return df.select([F.lit(None).cast(df.schema[c].dataType).alias(c) if c in gone else F.col(c)
                      for c in df.columns])


def values_to_lose(df: DataFrame, columns) -> DataFrame:
    """``(column, rows_touched)``: how many values emptying would remove."""
    counts = df.agg(*[F.count(F.col(c)).alias(f"v{i}") for i, c in enumerate(columns)])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"v{i}").alias("rows_touched"))
        for i, c in enumerate(columns)])))
