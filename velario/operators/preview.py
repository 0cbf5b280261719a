"""Looking before writing: distinct values, rows, and values that cannot be treated."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from velario.fixed import ENCRYPT, NULLIFY
from velario.functions.identifiers import Context, transform
from velario.operators.profile import first_rows
from velario.session import saved


PREVIEW_ROWS = ("operation string, column string, kind string, tweak string, n_rows bigint, "
                "n_distinct bigint, before string, after string, error string")


def _nothing(df, schema):
    return df.sparkSession.createDataFrame([], schema)


def smallest_values(df: DataFrame, columns, n: int) -> DataFrame:
    """``(at, before, n, n_rows, n_distinct)``: the n smallest values, as text, of the column
    at each place of ``columns``, the rows that hold each, and what the column holds in all.

    One scan and one grouping by column and value serve all columns, the counts and
    the values (both need ``n``, so Spark shuffles the groups once); of the groups each task passes on its n smallest a column.
    """
    # text is its own order; other types are ordered by a column of their own
    typed = [c for c in columns if not isinstance(df.schema[c].dataType, StringType)]
    cells = F.array(*[F.struct(
        F.lit(i).alias("at"), F.col(c).cast("string").alias("before"),
        *[(F.col(t) if t == c else F.lit(None).cast(df.schema[t].dataType)).alias(f"o{j}") for j, t in enumerate(typed)])
        for i, c in enumerate(columns)])
    orders = [f"o{j}" for j in range(len(typed))]
    groups = df.select(F.inline(cells)).groupBy("at", "before", *orders).agg(F.count(F.lit(1)).alias("n"))
    totals = groups.groupBy(F.col("at").alias("of")).agg(F.sum("n").alias("n_rows"), F.count("before").alias("n_distinct"))
    # nulls come last and go after the ranking: a condition before it would make a scan of its own
    place = F.row_number().over(Window.partitionBy("at").orderBy(
        *[F.col(c).asc_nulls_last() for c in (*orders, "before")]))
    first = groups.withColumn("place", place).where((F.col("place") <= n) & F.col("before").isNotNull())
    return first.join(totals, F.col("at") == F.col("of")).select("at", "before", "n", "n_rows", "n_distinct")


def preview_values(df: DataFrame, ctx: Context, rules, nullified=(), n=8) -> DataFrame:
    """The n smallest distinct values per column: ``(operation, column, kind, tweak,
    n_rows, n_distinct, before, after, error)``.

    Columns to be emptied appear with the values about to vanish, and only on the
    way forward.
    """
    jobs = [(ENCRYPT, r.column, r) for r in rules]
    jobs += [(NULLIFY, c, None) for c in nullified] if ctx.forward else []
    if not jobs:
        return _nothing(df, PREVIEW_ROWS)
    columns = list(dict.fromkeys(j[1] for j in jobs))
    looked = saved(smallest_values(df, columns, n), "preview")       # n rows a column
    parts = []
    for operation, column, rule in jobs:
        some = looked.where(F.col("at") == columns.index(column))
        if rule:
            some = transform(some, ctx, F.col("before"), rule.kind, rule.effective_tweak, "after", "error")
        else:
            some = some.withColumns({"after": F.lit(None).cast("string"), "error": F.lit(None).cast("string")})
        parts.append(some.select(
            F.lit(operation).alias("operation"), F.lit(column).alias("column"),
            F.lit(rule.kind if rule else None).cast("string").alias("kind"),
            F.lit(rule.effective_tweak if rule else None).cast("string").alias("tweak"),
            "n_rows", "n_distinct", "before", "after", "error"))
    return reduce(DataFrame.unionByName, parts)


def preview_rows(df: DataFrame, ctx: Context, rules, nullified=(), key=(), n=30, ordered=False) -> DataFrame:
    """The first rows as they are and as they would be: the key as is, then one
    ``struct(before, after, error)`` per treated column."""
    nullified = list(nullified) if ctx.forward else []
    treated = [r.column for r in rules] + nullified
    key = [c for c in key if c not in treated]
    rows = first_rows(df, key + treated, n, key if ordered and key else None)
    for rule in rules:
        before = F.col(rule.column).cast("string")
        rows = transform(rows, ctx, before, rule.kind, rule.effective_tweak, "__after", "__error")
        rows = rows.withColumn(rule.column, F.struct(
            before.alias("before"), F.col("__after").alias("after"), F.col("__error").alias("error")))
        rows = rows.drop("__after", "__error")
    for column in nullified:
        nothing = F.lit(None).cast("string")
        rows = rows.withColumn(column, F.struct(F.col(column).cast("string").alias("before"),
                                                nothing.alias("after"), nothing.alias("error")))
    return rows.select(key + treated)


def untreatable(df: DataFrame, ctx: Context, rules) -> DataFrame:
    """``(column, value, error)``: every distinct value that would be refused.

    One scan for all rules. Refusal is decided by column expressions only, so no
    permutation runs, and only refused values are shuffled.
    """
    if not rules:
        return _nothing(df, "column string, value string, error string")
    rows = df.select(*[F.col(r.column).cast("string").alias(f"__v{i}") for i, r in enumerate(rules)])
    for i, rule in enumerate(rules):
        rows = transform(rows, ctx, F.col(f"__v{i}"), rule.kind, rule.effective_tweak, f"__n{i}", f"__e{i}")
    cells = [F.struct(F.lit(r.column).alias("column"), F.col(f"__v{i}").alias("value"), F.col(f"__e{i}").alias("error"))
             for i, r in enumerate(rules)]
    return rows.select(F.inline(F.array(*cells))).where("error is not null").distinct()
