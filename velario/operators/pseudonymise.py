"""Encrypt and decrypt columns of a DataFrame (a projection: no shuffle)."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velario.functions.identifiers import Context, transform
from velario.key import Key
from velario.operators.mapping import with_mapped
from velario.sources.wordlists import default_lists


@dataclass(frozen=True)
class Rule:
    """How to treat one column; the tweak defaults to the column's name."""

    column: str
    kind: str
    tweak: str = None

    @property
    def effective_tweak(self):
        return self.tweak or default_tweak(self.column)


def default_tweak(column: str) -> str:
    """Columns of one name share their surrogates, whatever table they are in."""
    return column.strip().lower()


def context(spark, key: Key, forward=True, lists=None, strict=False, native=False) -> Context:
    return Context(spark, key, forward, {**default_lists(), **(lists or {})}, strict, native)


def with_surrogates(df: DataFrame, ctx: Context, rules, suffix_new="__new", suffix_error="__error", mapped=()):
    """Add ``<column>__new`` and ``<column>__error`` for every rule.

    Columns named in ``mapped`` are treated once per distinct value and joined
    back, which pays where values repeat; the others row by row, without a shuffle.
    """
    for rule in rules:
        if rule.column in mapped:
            df = with_mapped(df, ctx, rule.column, rule.kind, rule.effective_tweak,
                             rule.column + suffix_new, rule.column + suffix_error)
            continue
        df = transform(df, ctx, F.col(rule.column).cast("string"), rule.kind, rule.effective_tweak,
                       rule.column + suffix_new, rule.column + suffix_error)
    return df


def _apply(df, key, rules, forward, on_bad, lists, strict, native):
    if on_bad not in ("fail", "skip"):
        raise ValueError("on_bad is 'fail' or 'skip'")
    ctx = context(df.sparkSession, key, forward, lists, strict, native)
    return replace_columns(with_surrogates(df, ctx, rules), df.columns, rules, on_bad)


def replace_columns(wide: DataFrame, columns, rules, on_bad) -> DataFrame:
    """Put the surrogates in place; other columns and their order stay."""
    treated = {rule.column for rule in rules}

    def pick(name):
        if name not in treated:
            return F.col(name)
        new, error = F.col(f"{name}__new"), F.col(f"{name}__error")
        if on_bad == "skip":
            return F.coalesce(new, F.col(name)).alias(name)
        # the message names the column and the reason, never the value
        stop = F.raise_error(F.concat(F.lit(f"untreatable value in column {name}: "), error))
        return F.when(error.isNull(), new).otherwise(stop.cast("string")).alias(name)

    return wide.select([pick(name) for name in columns])


def encrypt(df: DataFrame, key: Key, rules, on_bad="fail", lists=None, strict=False, native=False) -> DataFrame:
    """Replace the columns of ``rules`` by surrogates.

    ``on_bad='fail'`` stops the job at the first untreatable value; ``'skip'``
    leaves such values as they are - list them with ``preview.untreatable``.
    ``native`` keeps VAT numbers out of Python workers.
    """
    return _apply(df, key, rules, True, on_bad, lists, strict, native)


def decrypt(df: DataFrame, key: Key, rules, on_bad="fail", lists=None, native=False) -> DataFrame:
    """Bring surrogates back with the key, tweaks and lists they were made with."""
    return _apply(df, key, rules, False, on_bad, lists, False, native)
