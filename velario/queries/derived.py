"""Identifiers derived from the keys of the given tables, for Spark and in SQL.

The tables hold no tax code, VAT number or IBAN, so each is computed from a key by
arithmetic, once as columns and once as SQL text for the comparison.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velario.fixed import MONTH_LETTERS, TAX_CODE_ODD_WEIGHTS
from velario.functions import checksums as C
from velario.key import Key
from velario.sources.wordlists import default_names, default_surnames

KEY = Key(bytes(range(32)))
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
_OFF = ("ba", "ce", "di", "fo", "gu", "la", "me", "ni", "po", "ru", "sa", "te", "vi")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# -- VAT numbers ----------------------------------------------------------------
def vat(key) -> F.Column:
    body = F.lpad(F.col(key).cast("string"), 10, "0")
    return F.concat(body, C.vat_digit(body))


def vat_check_sql(body) -> str:
    total = " + ".join(
        f"cast(substr({body}, {p}, 1) as int)" if p % 2 else
        f"(2 * cast(substr({body}, {p}, 1) as int) // 10 + 2 * cast(substr({body}, {p}, 1) as int) % 10)"
        for p in range(1, 11))
    return f"cast((10 - ({total}) % 10) % 10 as varchar)"


def vat_sql(key) -> str:
    body = f"lpad(cast({key} as varchar), 10, '0')"
    return f"({body} || {vat_check_sql(body)})"


# -- tax codes --------------------------------------------------------------------
def _base26(key, place):
    return F.char((F.floor(F.col(key) / 26 ** place) % 26 + 65).cast("int"))


def tax_code(key) -> F.Column:
    k = F.col(key)
    letters = F.concat(*[_base26(key, p) for p in (0, 1, 2, 0, 2, 1)])
    body = F.concat(
        letters, F.lpad((k % 100).cast("string"), 2, "0"),
        F.lit(MONTH_LETTERS).substr((k % 12 + 1).cast("int"), F.lit(1)),
        F.lpad((k % 28 + 1 + 40 * (k % 2)).cast("string"), 2, "0"),
        _base26(key, 0), F.lpad((k % 1000).cast("string"), 3, "0"))
    return F.concat(body, C.tax_code_letter(body))


def tax_letter_sql(body) -> str:
    odd = "[" + ", ".join(str(TAX_CODE_ODD_WEIGHTS[c]) for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ") + "]"
    place = "strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', substr({b}, {p}, 1))"
    terms = []
    for p in range(1, 16):
        at = place.format(b=body, p=p)
        terms.append(f"{odd}[{at}]" if p % 2 else f"(case when {at} > 10 then {at} - 11 else {at} - 1 end)")
    return f"chr(cast(({' + '.join(terms)}) % 26 + 65 as int))"


def tax_body_sql(key) -> str:
    def letter(p):
        return f"chr(cast(({key} // {26 ** p}) % 26 + 65 as int))"
    return ("(" + " || ".join([letter(p) for p in (0, 1, 2, 0, 2, 1)])
            + f" || lpad(cast({key} % 100 as varchar), 2, '0') || substr('{MONTH_LETTERS}', cast({key} % 12 + 1 as int), 1)"
            + f" || lpad(cast({key} % 28 + 1 + 40 * ({key} % 2) as varchar), 2, '0') || {letter(0)}"
            + f" || lpad(cast({key} % 1000 as varchar), 3, '0'))")


# -- IBANs --------------------------------------------------------------------------
def iban(key) -> F.Column:
    bban = F.concat(F.char((F.col(key) % 26 + 65).cast("int")), F.lpad(F.col(key).cast("string"), 22, "0"))
    return F.concat(F.lit("IT"), C.iban_check(F.lit("IT"), bban), bban)


def iban_sql(key) -> str:
    """IT is 1829 in the number that is divided by 97; the leading letter is 10 to 35."""
    digits = f"lpad(cast({key} as varchar), 22, '0')"
    number = f"cast(cast({key} % 26 + 10 as varchar) || {digits} || '182900' as hugeint)"
    return (f"('IT' || lpad(cast(98 - {number} % 97 as varchar), 2, '0') || chr(cast({key} % 26 + 65 as int)) || {digits})")


# -- names ----------------------------------------------------------------------------
def _off_list(key):
    part = [F.element_at(F.array(*map(F.lit, _OFF)), ((F.floor(F.col(key) / len(_OFF) ** p)) % len(_OFF) + 1).cast("int"))
            for p in range(3)]
    return F.initcap(F.concat(*part, F.lit("ma")))


def name(key, words) -> F.Column:
    """A list entry by the key; every seventh one is not on the list."""
    entry = F.element_at(F.array(*[F.lit(e.title()) for e in words.entries]), (F.col(key) % len(words) + 1).cast("int"))
    return F.when(F.col(key) % 7 == 0, _off_list(key)).otherwise(entry)


def name_sql(key, words) -> str:
    entries = "[" + ", ".join(f"'{e.title()}'" for e in words.entries) + "]"
    off = "[" + ", ".join(f"'{s}'" for s in _OFF) + "]"
    parts = [f"{off}[({key} // {len(_OFF) ** p}) % {len(_OFF)} + 1]" for p in range(3)]
    word = f"({' || '.join(parts)} || 'ma')"
    return (f"(case when {key} % 7 = 0 then upper(substr({word}, 1, 1)) || substr({word}, 2) "
            f"else {entries}[{key} % {len(words)} + 1] end)")


def people(spark, sf_dir) -> DataFrame:
    """``customer`` with an identifier of each type."""
    return table(spark, sf_dir, "customer").select(
        "c_custkey", "c_nationkey", tax_code("c_custkey").alias("cf"), vat("c_custkey").alias("piva"),
        name("c_custkey", default_names()).alias("nome"), name("c_custkey", default_surnames()).alias("cognome"))


def accounts(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", iban("s_suppkey").alias("iban"))
