"""The policy checked against the schema, fail-closed, as joins.

A policy is rows ``(table, column, strategy, kind, tweak)``, a schema rows ``(table,
column, type, nullable)``, a foreign key a row ``(t1, c1, t2, c2)``. Problems are
rows ``(level, place, rule, message)``; one with level ``errore`` blocks a run.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velario.fixed import ENCRYPT, ERROR, KEEP, LIST_TYPES, NULLIFY, STRATEGIES, TYPES, WARNING
from velario.functions.identifiers import ADDED
from velario.functions.checksums import strip

_AT = ["table", "column"]
# Only text holds a surrogate as it is: numbers lose leading zeros, dates refuse it.
_TEXT = "^(string|char|varchar)\\b"


def effective_tweak(column="column", tweak="tweak") -> Column:
    """The declared tweak, or the trimmed lower-case column name."""
    return F.coalesce(F.nullif(F.col(tweak), F.lit("")), F.lower(strip(F.col(column))))


def place() -> Column:
    return F.concat_ws(".", "table", "column")


def _problems(rows: DataFrame, at: Column, rule, message, level=ERROR) -> DataFrame:
    text = F.lit(message) if isinstance(message, str) else message
    return rows.select(F.lit(level).alias("level"), at.alias("place"), F.lit(rule).alias("rule"),
                       text.alias("message"))


def select_columns(rows: DataFrame, only: DataFrame = None) -> DataFrame:
    """Restrict rows to chosen ``(table, column)`` pairs; no selection means all."""
    return rows if only is None else rows.join(only.select(_AT).distinct(), _AT, "left_semi")


def with_strategy(policy: DataFrame, strategy) -> DataFrame:
    """Rules of one strategy in their order of treatment."""
    return policy.where(F.col("strategy") == strategy).orderBy("table", "column")


# -- single checks --------------------------------------------------------------
def unknown_tables(policy, schema):
    gone = policy.select("table").distinct().join(schema.select("table").distinct(), "table", "left_anti")
    return _problems(gone, F.col("table"), "unknown_table", "the policy names a table that does not exist")


def undeclared_columns(policy, schema):
    named = schema.join(policy.select("table").distinct(), "table", "left_semi")
    missing = named.join(policy.select(_AT), _AT, "left_anti")
    return _problems(missing, place(), "undeclared_column",
                     f"column without a rule; declare it, if only as '{KEEP}'")


def missing_columns(policy, schema):
    known = policy.join(schema.select("table").distinct(), "table", "left_semi")
    extra = known.join(schema.select(_AT), _AT, "left_anti")
    return _problems(extra, place(), "missing_column", "the policy names a column that does not exist")


def incoherent_rules(policy, schema):
    """Unknown strategies, encryption without a type, emptying a required column."""
    rules = policy.join(schema, _AT)
    strategy, kind = F.col("strategy"), F.col("kind")
    known = F.coalesce(strategy.isin(*STRATEGIES), F.lit(False))
    rule = (F.when(~known, F.struct(F.lit("unknown_strategy").alias("rule"), F.concat(
                F.lit("unknown strategy "), F.coalesce(strategy, F.lit("(none)"))).alias("message")))
            .when((strategy == ENCRYPT) & ~F.coalesce(kind.isin(*TYPES, *ADDED), F.lit(False)), F.struct(
                F.lit("no_valid_type").alias("rule"),
                F.lit(f"'{ENCRYPT}' without a valid type ({', '.join((*TYPES, *ADDED))})").alias("message")))
            .when((strategy == NULLIFY) & ~F.coalesce("nullable", F.lit(True)), F.struct(
                F.lit("nullify_required").alias("rule"),
                F.lit(f"'{NULLIFY}' on a column that must not be null").alias("message"))))
    found = rules.withColumn("__rule", rule).where(F.col("__rule").isNotNull())
    return found.select(F.lit(ERROR).alias("level"), place().alias("place"), "__rule.rule", "__rule.message")


def foreign_key_conflicts(policy, foreign_keys):
    """The two sides of a foreign key must get the same surrogates."""
    side = policy.withColumn("tweak", effective_tweak())
    one = side.select(*[F.col(c).alias(f"{c}1") for c in side.columns])
    two = side.select(*[F.col(c).alias(f"{c}2") for c in side.columns])
    pairs = (foreign_keys.join(one, (F.col("t1") == F.col("table1")) & (F.col("c1") == F.col("column1")))
             .join(two, (F.col("t2") == F.col("table2")) & (F.col("c2") == F.col("column2"))))
    involved = (F.coalesce(F.col("strategy1") == ENCRYPT, F.lit(False))
                | F.coalesce(F.col("strategy2") == ENCRYPT, F.lit(False)))

    def differs(name, rule):
        return F.when(~F.col(f"{name}1").eqNullSafe(F.col(f"{name}2")), F.struct(
            F.lit(rule).alias("rule"),
            F.concat(F.lit(f"the sides of a foreign key differ in {name}: "),
                     F.concat_ws(" / ", F.coalesce(f"{name}1", F.lit("(none)")),
                                 F.coalesce(f"{name}2", F.lit("(none)")))).alias("message")))

    strategies = differs("strategy", "fk_strategy")
    rules = F.when(strategies.isNotNull(), F.array(strategies)).otherwise(
        F.array_compact(F.array(differs("kind", "fk_type"), differs("tweak", "fk_tweak"))))
    at = F.concat(F.concat_ws(".", "t1", "c1"), F.lit(" -> "), F.concat_ws(".", "t2", "c2"))
    return pairs.where(involved).select(at.alias("place"), F.inline(rules)).select(
        F.lit(ERROR).alias("level"), "place", "rule", "message")


def ambiguous_tweaks(policy):
    """One tweak used for several types: usually columns that only share a name."""
    kind = F.when(F.col("kind").isin(*TYPES, *ADDED), F.col("kind")).otherwise("(none)")
    used = policy.where(F.col("strategy") == ENCRYPT).groupBy(effective_tweak().alias("tweak")).agg(
        # at most one entry per type, whatever the number of columns
        F.array_sort(F.collect_set(kind)).alias("kinds"))
    return _problems(used.where(F.size("kinds") > 1), F.col("tweak"), "ambiguous_tweak",
                     F.concat(F.lit("one tweak for several types: "), F.array_join("kinds", ", ")), WARNING)


def numeric_columns(policy, schema):
    risky = (policy.where(F.col("strategy") == ENCRYPT).join(schema, _AT)
             .where(~F.lower("type").rlike(_TEXT)))
    return _problems(risky, place(), "numeric_column", F.concat(
        F.lit("only text can hold a surrogate, not type "), F.col("type")))


def narrow_columns(policy, schema, lists):
    """List types do not keep the length: the longest entry must fit."""
    longest = F.lit(None).cast("int")
    for kind, which in LIST_TYPES.items():
        if which in lists:
            longest = F.when(F.col("kind") == kind, lists[which].longest).otherwise(longest)
    width = F.nullif(F.regexp_extract("type", "\\((\\d+)\\)", 1), F.lit("")).cast("int")
    tight = (policy.where((F.col("strategy") == ENCRYPT) & F.col("kind").isin(*LIST_TYPES))
             .join(schema, _AT).where(width < longest))
    return _problems(tight, place(), "narrow_column", F.concat(
        F.lit("the longest list entry does not fit into "), F.col("type")))


# -- whole checks ---------------------------------------------------------------
def check_policy(policy, schema, foreign_keys) -> DataFrame:
    """All checks of the policy against the schema; always on the whole policy."""
    return reduce(DataFrame.unionByName, [
        unknown_tables(policy, schema), undeclared_columns(policy, schema),
        missing_columns(policy, schema), incoherent_rules(policy, schema),
        foreign_key_conflicts(policy, foreign_keys), ambiguous_tweaks(policy)])


def check_columns(policy, schema, lists, only=None) -> DataFrame:
    """Checks of the columns about to be treated."""
    chosen = select_columns(policy, only)
    return numeric_columns(chosen, schema).unionByName(narrow_columns(chosen, schema, lists))


def ordered_problems(problems: DataFrame) -> DataFrame:
    """Errors first, then by place."""
    return problems.orderBy(F.col("level") != ERROR, "place", "rule")


def blocking(problems: DataFrame) -> DataFrame:
    return problems.where(F.col("level") == ERROR)


def align(policy: DataFrame, schema: DataFrame, proposals: DataFrame = None) -> DataFrame:
    """The policy brought in line with the schema, and what happened to each rule.

    ``action`` is ``kept`` (a decision, never touched), ``added`` (a new column,
    encrypted if proposed and kept in clear otherwise), ``dropped`` (the column is
    gone) or ``outside`` (its table is not part of the schema).
    """
    described = schema.select(*_AT, F.lit(True).alias("__exists"))
    known = schema.select("table").distinct().withColumn("__known", F.lit(True))
    if proposals is None:
        proposals = schema.sparkSession.createDataFrame([], "table string, column string, kind string")
    proposed = proposals.select(*_AT, F.col("kind").alias("__proposed"))
    both = (policy.withColumn("__ruled", F.lit(True)).join(described, _AT, "full")
            .join(known, "table", "left").join(proposed, _AT, "left"))
    added = F.col("__ruled").isNull()
    action = (F.when(added, "added").when(F.col("__known").isNull(), "outside")
              .when(F.col("__exists").isNull(), "dropped").otherwise("kept"))
    return both.select(
        *_AT,
        F.when(~added, F.col("strategy")).when(F.col("__proposed").isNotNull(), ENCRYPT)
        .otherwise(KEEP).alias("strategy"),
        F.when(added, F.col("__proposed")).otherwise(F.col("kind")).alias("kind"),
        F.when(~added, F.col("tweak")).alias("tweak"), action.alias("action"))


def aligned_policy(aligned: DataFrame) -> DataFrame:
    return aligned.where(F.col("action") != "dropped").drop("action")
