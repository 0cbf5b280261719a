"""What a text column holds, judged by its values."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import CharType, StringType, VarcharType

from velario.fixed import (DETECTION_MIN_VALUES, DETECTION_ORDER, DETECTION_SHARE,
                           ENCRYPT, KEEP, LIST_TYPES)
from velario.functions import checksums as C
from velario.functions import names as N
from velario.functions.identifiers import ADDED
from velario.sources.wordlists import WordList

_KELVIN = "\u212a"          # the one character that Unicode turns into an ASCII letter


def text_columns(df: DataFrame):
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, (StringType, CharType, VarcharType))]


# Up to so many entries a list stands in the plan as literals.
LITERALS = 1_000


def _form(value, ascii_only):
    """What is looked up in a list. Accented lists need Unicode composition."""
    return F.translate(N.collapse(value), _KELVIN, "K") if ascii_only else N.normalise(value)


def in_list(value, word_list):
    """Membership after normalisation, for a short list."""
    form = _form(value, all(e.isascii() for e in word_list.entries))
    return F.coalesce(form.isin(word_list.entries), F.lit(False))


def is_short(word_list) -> bool:
    return isinstance(word_list, WordList) and len(word_list) <= LITERALS


def with_membership(df: DataFrame, columns: dict, word_list) -> DataFrame:
    """``df`` with a flag under each key of ``columns``: is the value (a Column) on the list?

    A join for each, in which Spark sends a short list to all executors and puts a
    Bloom filter before the shuffle of the rows for a long one. Nothing of the list
    stands in the plan, and each entry is there once, so no row is multiplied.
    """
    entries = word_list.frame(df.sparkSession).select("entry")
    for i, (name, value) in enumerate(columns.items()):
        found = entries.select(F.col("entry").alias(f"__entry{i}"))
        df = (df.withColumn(f"__form{i}", _form(value, False)).join(found, F.col(f"__form{i}") == F.col(f"__entry{i}"), "left")
              .withColumn(name, F.col(f"__entry{i}").isNotNull()).drop(f"__form{i}", f"__entry{i}"))
    return df


def predicates(lists):
    """Type to test, in order of preference; without the types whose list is long."""
    tests = {"CF": C.cf_ok, "IBAN": C.iban_ok, "PIVA": C.piva_ok}
    for kind, which in LIST_TYPES.items():
        if is_short(lists[which]):
            tests[kind] = lambda value, which=which: in_list(value, lists[which])
    return [(kind, tests[kind]) for kind in DETECTION_ORDER if kind in tests] + [(t.name, t.valid) for t in ADDED.values()]


def pass_counts(df: DataFrame, columns, lists) -> DataFrame:
    """``(column, examined, CF, IBAN, PIVA, NOME, COGNOME)``, and added types, of all columns in one pass.

    A sum per column and type, combined on the map side: no values are shuffled
    and rows are not multiplied by the number of columns. Long lists are joined.
    """
    tests = predicates(lists)
    measures, cells = [], []
    for kind, which in LIST_TYPES.items():
        if not is_short(lists[which]):
            names = {c: f"__on_{kind}_{i}" for i, c in enumerate(columns)}
            df = with_membership(df, {name: C.strip(F.col(c)) for c, name in names.items()}, lists[which])
            tests.append((kind, names))
    for i, column in enumerate(columns):
        value = C.strip(F.col(column))
        filled = F.col(column).isNotNull() & (value != "")
        measures.append(F.count_if(filled).alias(f"e{i}"))
        measures += [F.count_if(filled & (F.col(test[column]) if isinstance(test, dict) else test(value))).alias(f"e{i}_{kind}")
                     for kind, test in tests]
        cells.append(F.struct(F.lit(column).alias("column"), F.col(f"e{i}").alias("examined"),
                              *[F.col(f"e{i}_{kind}").alias(kind) for kind, _ in tests]))
    return df.agg(*measures).select(F.inline(F.array(*cells)))


def decide(counts: DataFrame) -> DataFrame:
    """``(column, kind, passing, examined)``; kind is NULL where nothing is proposed."""
    # largest count first, and on a tie the type tested first
    ranked = [F.struct(F.col(kind).alias("passing"), F.lit(-i).alias("rank"), F.lit(kind).alias("kind"))
              for i, kind in enumerate((*DETECTION_ORDER, *ADDED)) if kind in counts.columns]
    best = F.greatest(*ranked)
    enough = F.col("examined") >= DETECTION_MIN_VALUES
    return counts.select(
        "column",
        F.when(enough & (best["passing"] > 0)
               & (best["passing"] >= DETECTION_SHARE * F.col("examined")), best["kind"]).alias("kind"),
        F.when(enough, best["passing"]).otherwise(F.lit(0).cast("bigint")).alias("passing"), "examined")


def detect(df: DataFrame, lists, columns=None, sample=None) -> DataFrame:
    """Judge the text columns of a table, over all values or a sample of each."""
    text = set(text_columns(df))
    columns = [c for c in (columns or df.columns) if c in text]
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, kind string, passing bigint, examined bigint")
    if sample is None:
        return decide(pass_counts(df, columns, lists))
    parts = [pass_counts(df.where(F.col(c).isNotNull()).select(c).limit(sample), [c], lists)
             for c in columns]
    return decide(reduce(DataFrame.unionByName, parts))


def propose(tables: dict, lists, sample=None, policy: DataFrame = None,
            review=False) -> DataFrame:
    """``(table, column, kind, passing, examined)`` for all columns worth encrypting.

    All values are judged; ``sample`` looks at so many of each column instead.

    With a policy only columns without a rule are looked at, and with ``review``
    also those kept in clear. The policy is as small as the schema.
    """
    settled = set()
    if policy is not None:
        open_rules = (F.col("strategy") == KEEP) if review else F.lit(False)
        settled = {(r["table"], r["column"]) for r in
                   policy.where(~F.coalesce(open_rules, F.lit(False))).select("table", "column").toLocalIterator()}
    parts = []
    for name, df in sorted(tables.items()):
        columns = [c for c in text_columns(df) if (name, c) not in settled]
        if columns:
            parts.append(detect(df, lists, columns, sample).select(F.lit(name).alias("table"), "*"))
    if not parts:
        spark = next(iter(tables.values())).sparkSession
        return spark.createDataFrame([], "table string, column string, kind string, passing bigint, examined bigint")
    return reduce(DataFrame.unionByName, parts).where(F.col("kind").isNotNull())


def flip_reviewed(policy: DataFrame, proposals: DataFrame) -> DataFrame:
    """Turn proposed columns that were kept in clear into encrypted ones."""
    found = proposals.select("table", "column", F.col("kind").alias("__kind"))
    hit = (F.col("strategy") == KEEP) & F.col("__kind").isNotNull()
    return policy.join(found, ["table", "column"], "left").select(
        "table", "column", F.when(hit, ENCRYPT).otherwise(F.col("strategy")).alias("strategy"),
        F.when(hit, F.col("__kind")).otherwise(F.col("kind")).alias("kind"),
        F.when(hit, None).otherwise(F.col("tweak")).alias("tweak"))
