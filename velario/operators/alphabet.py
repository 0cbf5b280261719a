"""FF1 over an alphabet of one's own, as a column job."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velario.fixed import MIN_DOMAIN
from velario.functions.identifiers import class_permutation
from velario.key import Key
from velario.session import ship_package


def _least_length(radix: int) -> int:
    """Characters that give at least the smallest domain that may be permuted."""
    n = 2
    while radix ** n < MIN_DOMAIN:
        n += 1
    return n


def _job(df, key, column, alphabet, tweak, new, error, forward):
    if len(set(alphabet)) != len(alphabet) or not 2 <= len(alphabet) <= 1 << 16 or not alphabet.isascii():
        raise ValueError("an alphabet is two or more different ASCII characters")
    ship_package(df.sparkSession)
    value = F.col(column)
    permute = class_permutation(key.bytes, [(alphabet, tweak)], forward)
    foreign = F.translate(value, alphabet, "") != ""
    reason = (F.when(foreign, "foreign_character")
              .when(F.length(value) < _least_length(len(alphabet)), "too_short"))
    judged = df.withColumn(error, reason)
    return judged.withColumn(new, permute(F.when(F.col(error).isNull(), value)))


def encrypt_text(df: DataFrame, key: Key, column, alphabet: str, tweak: bytes, new, error) -> DataFrame:
    """Add ``new`` (the surrogate) and ``error`` for values over ``alphabet``.

    A character outside it, or a domain below the smallest allowed, is refused
    with a reason and gives no surrogate.
    """
    return _job(df, key, column, alphabet, tweak, new, error, True)


def decrypt_text(df: DataFrame, key: Key, column, alphabet: str, tweak: bytes, new, error) -> DataFrame:
    return _job(df, key, column, alphabet, tweak, new, error, False)
