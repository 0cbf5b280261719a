"""Card numbers, a type added through the registry: digits permuted, then the Luhn digit.

Cases: white space at the ends goes; what is not 13 to 19 digits is refused; NULL stays NULL.
"""

from pyspark.sql import functions as F

from velario.fixed import DIGITS
from velario.functions import checksums as C
from velario.functions.identifiers import IdentifierType, class_permutation, register, strict_error


def _valid(value):
    return F.coalesce(value.rlike("^[0-9]{13,19}$") & C.luhn_ok(value), F.lit(False))


def _plan(df, ctx, value, tweak, new, error):
    df = df.withColumn("__card", C.strip(value))
    card = F.col("__card")
    reason = F.when(~card.rlike("^[0-9]{13,19}$"), "not_13_to_19_digits")
    permute = class_permutation(ctx.key.bytes, [(DIGITS, tweak)], ctx.forward)
    df = df.withColumn(error, strict_error(ctx, reason, value, card, _valid(card)))
    body = F.when(F.col(error).isNull(), card.substr(F.lit(1), F.length(card) - 1))
    df = df.withColumn("__body", permute(body))
    return df.withColumn(new, F.concat("__body", C.luhn_check(F.col("__body")))).drop("__card", "__body")


CARD = IdentifierType("CARD", _plan, _valid)


def add_cards() -> None:
    """Let rules, detection and policies know the type ``CARD``."""
    register(CARD)
