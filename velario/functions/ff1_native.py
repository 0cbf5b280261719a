"""FF1 in column expressions: no Python worker takes part.

For halves below 2^47 all but the last block of FF1's CBC-MAC is the same in every row,
and the half and the round number fill the last bytes of that block. So a round is one
AES block: the constant state with those bytes changed, encrypted by ``aes_encrypt``
(mode ECB; of the two blocks that come back the second is padding), and the first eight
bytes of it are the round's number. Each of the ten rounds is a projection over the one
before, all of them in one stage of generated code.

``aes_encrypt`` sets up a cipher for every block. Where a half has no more than
``TABLE_LIMIT`` values (five digits, as in VAT numbers), the blocks that rows can ask for
are few, whatever the rows: each is encrypted once, into a table that the rounds read.

The key is read by a scalar subquery, so it stands in no plan, explanation or event log.
"""

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from velario.fixed import MIN_DOMAIN
from velario.functions.ff1 import InvalidDomain, engine

_ROUNDS = 10
# Halves of so many values have their rounds in a table.
TABLE_LIMIT = 100_000
_TABLES = {}


def key_column(spark: SparkSession, key: bytes) -> Column:
    """The key as a column without a literal."""
    return spark.createDataFrame([(bytearray(key),)], "k binary").scalar()


def _long(value) -> Column:
    return F.lit(value).cast("bigint")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _block(key, n, radix, tweak):
    """The half's width in bytes, and the block of a round as its first bytes and the number of its last eight."""
    u, v = n // 2, n - n // 2
    width = ((radix ** v - 1).bit_length() + 7) // 8
    # AES of blocks that everybody knows: the state tells nothing of the key
    state, fixed = engine(key)._constant_state(n, radix, tweak, width)
    block = state[:, 0].astype(">u4").tobytes()
    block = bytes(a ^ b for a, b in zip(block, fixed.ljust(16, b"\0")))
    return width, block[:8], int.from_bytes(block[8:], "big"), (radix ** u, radix ** v)


def _encrypted(key: Column, block, i, half):
    """The number of a half in round i: one AES block."""
    width, first, last, moduli = block
    tail = half.bitwiseXOR(_long(_signed(last ^ (i << 8 * width))))
    text = F.concat(F.lit(first), F.unhex(F.lpad(F.hex(tail), 16, "0")))
    cipher = F.aes_encrypt(text, key, F.lit("ECB"), F.lit("PKCS"))
    whole = F.conv(F.hex(F.substring(cipher, 1, 8)), 16, 10).cast("decimal(20,0)")
    return (whole % _long(moduli[i % 2])).cast("bigint")


def round_table(spark: SparkSession, key: bytes, n: int, radix: int, tweak: bytes) -> DataFrame:
    """One row ``(rounds)``: for every value of a half, in order, its numbers in all rounds.

    Its size is the domain's. It serves both directions and all jobs of a session, and
    stays in memory only.
    """
    slot = (spark.sparkContext.applicationId, key, n, radix, tweak)
    if slot not in _TABLES:
        block = _block(key, n, radix, tweak)
        domain = block[-1][1]
        halves = spark.range(0, domain, 1, min(spark.sparkContext.defaultParallelism, -(-domain // 1000)))
        keyed = halves.select("id", key_column(spark, key).alias("__key"))
        numbers = F.array(*[_encrypted(F.col("__key"), block, i, F.col("id")).cast("int") for i in range(_ROUNDS)])
        ordered = F.array_sort(F.collect_list(F.struct("id", "numbers")))
        table = keyed.select("id", numbers.alias("numbers")).agg(F.transform(ordered, lambda x: x["numbers"]).alias("rounds"))
        _TABLES[slot] = table.persist(StorageLevel.MEMORY_ONLY)
    return _TABLES[slot]


def forget_rounds() -> None:
    """Drop the tables of rounds from memory."""
    while _TABLES:
        _TABLES.popitem()[1].unpersist()


def with_permuted(df: DataFrame, key: bytes, left: Column, right: Column, n: int, radix: int, tweak: bytes,
                  forward: bool, names) -> DataFrame:
    """``df`` with the halves (n // 2 and n - n // 2 numerals) of the permuted values
    under two new ``names``; NULL halves give NULL halves. Halves are below 2^47."""
    if radix ** n < MIN_DOMAIN:
        raise InvalidDomain(f"radix^n = {radix ** n} is below {MIN_DOMAIN}")
    u, v = n // 2, n - n // 2
    if radix ** v >= 1 << 47:
        raise ValueError("halves of 2^47 or more need the Arrow kernel")
    moduli = (radix ** u, radix ** v)
    a, b, c = (f"__{x}_{names[0]}" for x in ("left", "right", "key"))
    kept, extra = df.columns, []
    if radix ** v <= TABLE_LIMIT:
        rounds = round_table(df.sparkSession, key, n, radix, tweak).scalar()

        def number(i, half):
            return rounds[half.cast("int")][i]
    else:
        block, extra = _block(key, n, radix, tweak), [c]
        df = df.withColumn(c, key_column(df.sparkSession, key))

        def number(i, half):
            return _encrypted(F.col(c), block, i, half)

    df = df.select(*kept, *extra, left.cast("bigint").alias(a), right.cast("bigint").alias(b))
    for i in range(_ROUNDS) if forward else reversed(range(_ROUNDS)):
        m = _long(moduli[i % 2])
        if forward:
            df = df.select(*kept, *extra, F.col(b).alias(a), ((F.col(a) + number(i, F.col(b))) % m).alias(b))
        else:
            df = df.select(*kept, *extra, F.pmod(F.col(b) - number(i, F.col(a)), m).alias(a), F.col(a).alias(b))
    return df.select(*kept, F.col(a).alias(names[0]), F.col(b).alias(names[1]))


def with_permuted_digits(df: DataFrame, key: bytes, value: Column, n: int, tweak: bytes, forward: bool, new: str) -> DataFrame:
    """``df`` with the permuted string of n decimal digits under ``new``, NULL for NULL."""
    u, kept, names = n // 2, df.columns, (f"__u_{new}", f"__v_{new}")
    wide = with_permuted(df, key, F.substring(value, 1, u), F.substring(value, u + 1, n - u), n, 10, tweak, forward, names)
    halves = [F.lpad(F.col(name).cast("string"), size, "0") for name, size in zip(names, (u, n - u))]
    return wide.select(*kept, F.concat(*halves).alias(new))
