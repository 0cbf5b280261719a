"""One column of one identifier type: value in, surrogate and refusal reason out.

Every type is a plan over the DataFrame: checks, splitting and check characters are
column expressions; permutations run as

* an Arrow function over the batch (long domains), or
* a broadcast join with a permutation table (domains fixed below 100 000).

Nothing here shuffles the data, except names whose list is a table. VAT numbers can also do without Python workers
(``Context.native``); the Arrow function is the default, for it is faster.
"""

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from velario.fixed import (DATE_DOMAIN, DIGITS, LETTERS, LIST_TYPES, MONTH_LETTERS, PLACE_DOMAIN, TYPES)
from velario.functions import checksums as C
from velario.functions import names as N
from velario.functions.ff1 import engine, permute_numerals, walk_integers
from velario.functions.ff1_native import forget_rounds, with_permuted_digits
from velario.key import Key
from velario.session import saved, ship_package
from velario.sources.wordlists import ListTable


@dataclass
class Context:
    """What a transformation needs besides the data."""

    spark: SparkSession
    key: Key
    forward: bool = True
    lists: dict = field(default_factory=dict)
    strict: bool = False
    native: bool = False          # digits without Python workers, at a lower speed

    def __post_init__(self):
        ship_package(self.spark)


# -- permutations -------------------------------------------------------------
def class_permutation(key: bytes, classes, forward: bool):
    """Arrow function: permute the characters of each class among their own places.

    ``classes`` is a list of (alphabet, tweak). A class with fewer than two
    characters in a value stays as it is; its domain would be too small.
    """
    @F.pandas_udf(StringType())
    def permute(values: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(values)
        out = np.empty(len(distinct) + 1, dtype=object)      # the last one stays None
        out[:-1] = permute_classes(engine(key), list(distinct), classes, forward)
        return pd.Series(out[codes])
    # Marked so that no optimizer rule moves the call into a lambda of what uses its
    # result (a checksum predicate, say), where it could not be evaluated.
    return permute.asNondeterministic()


def permute_classes(ff1, values, classes, forward):
    """The work of ``class_permutation``, on values that hold only those classes."""
    result = [None] * len(values)
    by_length = {}
    for i, value in enumerate(values):
        by_length.setdefault(len(value), []).append(i)
    for length, rows in by_length.items():
        if not length:
            for i in rows:
                result[i] = ""
            continue
        text = "".join([values[i] for i in rows]).encode("ascii")
        chars = np.frombuffer(text, np.uint8).reshape(len(rows), length).copy()
        for alphabet, tweak in classes:
            symbols = np.frombuffer(alphabet.encode("ascii"), np.uint8)
            numeral = np.full(256, -1, np.int64)
            numeral[symbols] = np.arange(len(symbols))
            member = numeral[chars] >= 0
            for rows_alike, places in _same_places(member):
                if len(places) < 2:
                    continue
                cells = np.ix_(rows_alike, places)
                chars[cells] = symbols[permute_numerals(ff1, numeral[chars[cells]], len(symbols),
                                                        tweak, forward)]
        joined = chars.tobytes().decode("ascii")
        for k, i in enumerate(rows):
            result[i] = joined[k * length:(k + 1) * length]
    return result


def _same_places(member):
    """Group the rows by where they have members: (rows, places) pairs."""
    if (member == member[0]).all():
        return [(np.arange(len(member)), np.flatnonzero(member[0]))]
    shapes, which = np.unique(member, axis=0, return_inverse=True)
    which = which.reshape(-1)
    return [(np.flatnonzero(which == s), np.flatnonzero(shape)) for s, shape in enumerate(shapes)]


_TABLES = {}


def permutation_table(ctx: Context, domain: int, tweak: bytes) -> DataFrame:
    """``(x, y)``: the permutation of the integers below ``domain``, made in parallel.

    It follows from key and tweak alone. Its size is the domain's, which is why
    joining it by broadcast is safe at any data size. One table serves all columns,
    passes and ranges of a session: it stays in memory only, never on disk.
    """
    key, forward = ctx.key.bytes, ctx.forward
    slot = (ctx.spark.sparkContext.applicationId, key, domain, tweak, forward)
    if slot in _TABLES:
        return _TABLES[slot]

    @F.pandas_udf(LongType())
    def walk(x: pd.Series) -> pd.Series:
        return pd.Series(walk_integers(engine(key), x.to_numpy(np.int64), domain, tweak, forward))

    slices = min(ctx.spark.sparkContext.defaultParallelism, -(-domain // 2000))
    walk = walk.asNondeterministic()
    table = ctx.spark.range(0, domain, 1, slices).select(
        F.col("id").alias("x"), walk(F.col("id")).alias("y"))
    _TABLES[slot] = table.persist(StorageLevel.MEMORY_ONLY)
    return _TABLES[slot]


def forget_tables() -> None:
    """Drop the permutation tables from memory, when a key is no longer needed."""
    forget_rounds()
    while _TABLES:
        _TABLES.popitem()[1].unpersist()


def _permuted(df, ctx, index: Column, domain, tweak, name):
    table = permutation_table(ctx, domain, tweak).select(
        F.col("x").alias("__x"), F.col("y").alias(name))
    return (df.withColumn("__index", index)
            .join(F.broadcast(table), F.col("__index") == F.col("__x"), "left")
            .drop("__index", "__x"))


def strict_error(ctx, error: Column, value: Column, canonical: Column, valid: Column) -> Column:
    if not ctx.strict:
        return error
    return F.coalesce(error, F.when(value != canonical, "non_canonical").when(~valid, "bad_checksum"))


# -- tax code -----------------------------------------------------------------
def tax_code_error(code: Column) -> Column:
    """Why an upper-cased, stripped tax code is refused, or NULL."""
    day = F.substring(code, 10, 2).try_cast("int")
    return (F.when(~code.rlike("^[0-9A-Z]{16}$"), "bad_length_or_alphabet")
            .when(~code.rlike("^[A-Z]{6}[0-9]{2}[0-9A-Z][0-9]{2}[A-Z][0-9]{3}[0-9A-Z]$"), "bad_structure")
            .when(~F.substring(code, 9, 1).rlike(f"[{MONTH_LETTERS}]"), "bad_month")
            .when(~F.when(day > 40, day - 40).otherwise(day).between(1, 31), "bad_day"))


def _tax_code(df, ctx, value, tweak, new, error):
    df = df.withColumn("__upper", F.upper(C.strip(value)))
    upper = F.col("__upper")
    df = df.withColumn(error, strict_error(ctx, tax_code_error(upper), value, upper, C.cf_ok(upper)))
    df = df.withColumn("__code", F.when(F.col(error).isNull(), upper)).drop("__upper")
    code = F.col("__code")
    day = F.substring(code, 10, 2).cast("int")
    month = F.instr(F.lit(MONTH_LETTERS), F.substring(code, 9, 1)) - 1
    female = (day > 40).cast("int")
    date = ((F.substring(code, 7, 2).cast("int") * 12 + month) * 31 + day - 40 * female - 1) * 2 + female
    place = (F.ascii(F.substring(code, 12, 1)) - 65) * 1000 + F.substring(code, 13, 3).cast("int")
    df = _permuted(df, ctx, date, DATE_DOMAIN, tweak + b"|data", "__date")
    df = _permuted(df, ctx, place, PLACE_DOMAIN, tweak + b"|comune", "__place")
    letters = class_permutation(ctx.key.bytes, [(LETTERS, tweak + b"|nome")], ctx.forward)
    df = df.withColumn("__letters", letters(F.substring(code, 1, 6)))

    date, place = F.col("__date"), F.col("__place")
    days = F.floor(date / 2)
    months = F.floor(days / 31)
    body = F.concat(
        F.col("__letters"),
        F.lpad(F.floor(months / 12).cast("string"), 2, "0"),
        F.lit(MONTH_LETTERS).substr((months % 12 + 1).cast("int"), F.lit(1)),
        F.lpad((days % 31 + 1 + 40 * (date % 2)).cast("string"), 2, "0"),
        F.char(F.floor(place / 1000) + 65),
        F.lpad((place % 1000).cast("string"), 3, "0"))
    df = df.withColumn("__body", body)
    return (df.withColumn(new, F.concat("__body", C.tax_code_letter(F.col("__body"))))
            .drop("__code", "__letters", "__date", "__place", "__body"))


# -- VAT number ---------------------------------------------------------------
def _vat_number(df, ctx, value, tweak, new, error):
    df = df.withColumn("__number", C.strip(value))
    number = F.col("__number")
    reason = F.when(~number.rlike("^[0-9]{11}$"), "not_11_digits")
    permute = class_permutation(ctx.key.bytes, [(DIGITS, tweak)], ctx.forward)
    df = df.withColumn(error, strict_error(ctx, reason, value, number, C.piva_ok(number)))
    body = F.when(F.col(error).isNull(), F.substring(number, 1, 10))
    if ctx.native:
        df = with_permuted_digits(df, ctx.key.bytes, body, 10, tweak, ctx.forward, "__body")
    else:
        df = df.withColumn("__body", permute(body))
    return df.withColumn(new, F.concat("__body", C.vat_digit(F.col("__body")))).drop("__number", "__body")


# -- IBAN ---------------------------------------------------------------------
def _iban(df, ctx, value, tweak, new, error):
    df = df.withColumn("__iban", C.compact(value))
    code = F.col("__iban")
    reason = F.when(~code.rlike("^[A-Z]{2}[0-9]{2}[0-9A-Z]{11,}$"), "bad_iban_format")
    permute = class_permutation(
        ctx.key.bytes, [(DIGITS, tweak + b"|0"), (LETTERS, tweak + b"|A")], ctx.forward)
    df = df.withColumn(error, strict_error(ctx, reason, value, code, C.iban_ok(code)))
    df = df.withColumn("__country", F.when(F.col(error).isNull(), F.substring(code, 1, 2)))
    df = df.withColumn("__bban", permute(F.when(F.col(error).isNull(), F.substring(code, 5, 1 << 30))))
    return (df.withColumn(new, F.concat("__country", C.iban_check("__country", "__bban"), "__bban"))
            .drop("__iban", "__country", "__bban"))


# -- first names and surnames ---------------------------------------------------
def list_table(ctx: Context, word_list, tweak: bytes) -> DataFrame:
    """``(entry, next, next_title)``: where each entry of a list in memory goes. List-sized."""
    to = walk_integers(engine(ctx.key.bytes), np.arange(len(word_list)), len(word_list), tweak,
                       ctx.forward)
    rows = [(e, word_list.entries[j], word_list.entries[j].title())
            for e, j in zip(word_list.entries, to.tolist())]
    return ctx.spark.createDataFrame(rows, "__entry string, __next string, __next_title string")


def _place_walk(ctx, domain, tweak):
    key, forward = ctx.key.bytes, ctx.forward

    @F.pandas_udf(LongType())
    def walk(x: pd.Series) -> pd.Series:
        return pd.Series(walk_integers(engine(key), x.to_numpy(np.int64), domain, tweak, forward))
    return walk.asNondeterministic()


def off_list_pairs(values: DataFrame, ctx: Context, entries: DataFrame, tweak: bytes) -> DataFrame:
    """``(__value, __off)`` of distinct off-list values, for a list that is a table.

    A walk that lands on an entry goes on from there. Which do is told by a join, so
    each round has a job; a round sees only the landings of the one before. Values are
    few bytes and long work, so they are dealt to all cores, whatever their bytes.
    """
    step = N.off_list_udf(ctx.key.bytes, frozenset(), tweak, ctx.forward)
    known = entries.select(F.col("entry").alias("__entry"))
    values = values.repartition(2 * ctx.spark.sparkContext.defaultParallelism, "__value")
    at, settled = values.select("__value", step(F.col("__value")).alias("__off")), []
    while True:
        at = saved(at.join(known, F.upper("__off") == F.col("__entry"), "left").select(
            "__value", "__off", (F.col("__entry").isNotNull() & N.is_canonical(F.col("__off"))).alias("__entry")), "off_list_walk")
        settled.append(at.where(~F.col("__entry")).select("__value", "__off"))
        landed = at.where("__entry")
        if landed.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        at = landed.select("__value", step(F.col("__off")).alias("__off"))


def _listed_name(which):
    def plan(df, ctx, value, tweak, new, error):
        word_list = ctx.lists[which]
        tweak = tweak + b"|" + which.encode()
        large = isinstance(word_list, ListTable)
        # a table is joined as Spark sees fit by its size; a list in memory is small
        moves = word_list.moves(_place_walk(ctx, len(word_list), tweak)) if large else F.broadcast(
            list_table(ctx, word_list, tweak))
        df = df.withColumn("__name", C.strip(value))
        name = F.col("__name")

        def told(entries):
            """The rows with their entries, whether they are listed, and why they are refused."""
            found = df.join(entries, F.upper(name) == F.col("__entry"), "left")
            found = found.withColumn("__listed", F.when(F.col("__entry").isNull(), False)
                                     .otherwise(N.is_canonical(name)))
            reason = (F.when(name == "", "empty").when(F.col("__listed"), None)
                      .otherwise(N.off_list_error(name)))
            return found.withColumn(error, strict_error(ctx, F.when(name.isNotNull(), reason), value, name, F.lit(True)))
        walking = F.when(F.col(error).isNull() & ~F.col("__listed"), name)
        if large:
            # which values are off the list is told by its entries, without a walk of all places
            entries = word_list.table.select(F.col("entry").alias("__entry"))
            values = told(entries).select(walking.alias("__value")).where("__value is not null").distinct()
            pairs = off_list_pairs(values, ctx, word_list.table, tweak + b"|unita")
            df = told(moves).withColumn("__walking", walking).join(pairs, F.col("__walking") == F.col("__value"), "left").drop(
                "__walking", "__value")
        else:
            off_list = N.off_list_udf(ctx.key.bytes, frozenset(word_list.entries), tweak + b"|unita", ctx.forward)
            df = told(moves).withColumn("__off", off_list(walking))
        listed = F.when(F.col("__listed") & F.col(error).isNull(),
                        N.restyle(name, F.col("__next"), F.col("__next_title")))
        return (df.withColumn(new, F.coalesce(listed, F.col("__off")))
                .drop("__name", "__entry", "__next", "__next_title", "__listed", "__off"))
    return plan


PLANS = {
    "CF": _tax_code,
    "PIVA": _vat_number,
    "IBAN": _iban,
    "NOME": _listed_name(LIST_TYPES["NOME"]),
    "COGNOME": _listed_name(LIST_TYPES["COGNOME"]),
}


@dataclass(frozen=True)
class IdentifierType:
    """A type of one's own: ``plan(df, ctx, value, tweak, new, error)`` adds surrogate and
    refusal, ``valid(value)`` tells values of the type, for detection."""

    name: str
    plan: object
    valid: object


ADDED = {}


def register(kind: IdentifierType) -> None:
    """Add a type: rules, detection and policy checks know it from then on."""
    if kind.name in TYPES:
        raise ValueError(f"{kind.name} is a built-in type")
    ADDED[kind.name], PLANS[kind.name] = kind, kind.plan


def forget(name: str) -> None:
    """Take an added type away."""
    if ADDED.pop(name, None):
        del PLANS[name]


def transform(df: DataFrame, ctx: Context, value: Column, kind: str, tweak: str, new: str,
              error: str) -> DataFrame:
    """Add ``new`` (surrogate or NULL) and ``error`` (reason or NULL) to every row.

    NULL in gives NULL in both. With ``ctx.forward`` false the way back is taken.
    """
    if kind not in PLANS:
        raise ValueError(f"unknown type {kind!r}; one of {', '.join(PLANS)}")
    return PLANS[kind](df, ctx, value, tweak.encode(), new, error)
