"""Applying a map of old to new values: one equi-join, each row from its own value."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velario.functions.identifiers import Context, transform


class WriteWithoutEffect(RuntimeError):
    """A filled map matched no row: the comparison does not compare."""


def value_map(df: DataFrame, ctx: Context, column: str, kind: str, tweak: str) -> DataFrame:
    """``(old, new, error, n)`` for every distinct value, with its number of rows."""
    values = (df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("old"))
              .agg(F.count(F.lit(1)).alias("n")))
    return transform(values, ctx, F.col("old").cast("string"), kind, tweak, "new", "error").select(
        "old", "new", "error", "n")


def _looked_up(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """``rows`` with the row of ``pairs`` whose ``__key`` is ``__old``, if any; both columns go.

    A row with NULL looks nothing up. By ``__old`` alone all such rows would be sorted in
    one task, so they are dealt by what else they hold.
    """
    held = [f.name for f in rows.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    dealt = rows.withColumn("__deal", F.when(F.col("__old").isNull(), F.xxhash64(*[F.col(f"`{c}`") for c in held])).otherwise(0))
    # zero without a literal: Spark would take a literal out of the join's keys
    keyed = pairs.withColumn("__zero", F.xxhash64("__key").bitwiseAND(0))
    found = (F.col("__old") == F.col("__key")) & (F.col("__deal") == F.col("__zero"))
    return dealt.join(keyed, found, "left").drop("__old", "__key", "__deal", "__zero")


def with_mapped(df: DataFrame, ctx: Context, column: str, kind: str, tweak: str, new: str, error: str) -> DataFrame:
    """Add ``new`` and ``error`` like ``transform``, computed once per distinct value.

    The values are made distinct with partial aggregation and joined back. Spark
    broadcasts them if their bytes allow it, and splits the rows of a value that
    many rows share.
    """
    pairs = value_map(df, ctx, column, kind, tweak).select(
        F.col("old").alias("__key"), F.col("new").alias(new), F.col("error").alias(error))
    return _looked_up(df.withColumn("__old", F.col(column)), pairs)


def _check_types(df, column, pairs):
    ours, theirs = df.schema[column].dataType, pairs.schema["old"].dataType
    if ours != theirs:
        raise TypeError(f"the map holds {theirs.simpleString()} but {column} is "
                        f"{ours.simpleString()}: they would not compare exactly")


def _in_range(df, key, after, upto):
    """Typed literals: numbers are never compared as text."""
    kind, inside = df.schema[key].dataType, F.lit(True)
    if after is not None:
        inside = inside & (F.col(key) > F.lit(after).cast(kind))
    if upto is not None:
        inside = inside & (F.col(key) <= F.lit(upto).cast(kind))
    return inside


def apply_map(df: DataFrame, column: str, pairs: DataFrame, key=None, after=None, upto=None) -> DataFrame:
    """Replace ``column`` by ``new`` where it equals ``old``; other rows stay.

    ``pairs`` holds each ``old`` once. With ``key`` only rows in ``(after, upto]``
    change. One equi-join: Spark chooses by bytes whether to broadcast the map, and
    splits skewed values; rows that do not change are dealt evenly.
    """
    _check_types(df, column, pairs)
    inside = _in_range(df, key, after, upto) if key is not None else F.lit(True)
    wanted = df.withColumn("__old", F.when(inside, F.col(column)))
    columns = [F.coalesce("__new", F.col(c)).alias(c) if c == column else F.col(c) for c in df.columns]
    mapped = pairs.select(F.col("old").alias("__key"), F.col("new").alias("__new"))
    return _looked_up(wanted, mapped).select(columns)


def effect(df: DataFrame, column: str, pairs: DataFrame) -> DataFrame:
    """``(n_map, n_matched, n_effective)`` of applying a map."""
    _check_types(df, column, pairs)
    sizes = pairs.agg(F.count(F.lit(1)).alias("n_map"))
    hits = (df.groupBy(F.col(column).alias("old")).agg(F.count(F.lit(1)).alias("rows"))
            .join(pairs.select("old", "new"), "old")
            .agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n_matched"),
                 F.coalesce(F.sum(F.when(F.col("old") != F.col("new"), F.col("rows"))), F.lit(0))
                 .alias("n_effective")))
    return sizes.select("n_map", hits.select("n_matched").scalar().alias("n_matched"),
                        hits.select("n_effective").scalar().alias("n_effective"))


def check_effect(n_map: int, n_touched: int) -> int:
    """Every value due must have been replaced; one left over is a fault, not a result."""
    if n_map != n_touched:
        raise WriteWithoutEffect(f"{n_map} values were due but {n_touched} were replaced; nothing was committed")
    return n_touched
