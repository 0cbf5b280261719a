"""Ordered word lists: the domain that name columns are permuted over.

``WordList`` is a list in memory; ``ListTable`` is one of any size, kept as a table with
the place of each entry, never held whole by the driver or a task. ``load`` and
``list_of`` choose by size.
"""

import hashlib
import unicodedata
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velario.fixed import FALLBACK_VERSION, MIN_DOMAIN
from velario.operators.ranges import numbered
from velario.session import saved

# Up to so many entries a list is kept in memory and travels whole to every executor.
IN_MEMORY = 200_000
# Entries whose digest is taken at once.
BLOCK = 1 << 16


class WordList:
    """Entries in file order, normalised, first occurrence kept."""

    def __init__(self, entries, name="list"):
        clean = (" ".join(unicodedata.normalize("NFC", e.strip().upper()).split()) for e in entries)
        self.entries = list(dict.fromkeys(e for e in clean if e))
        self.name = name
        if not MIN_DOMAIN <= len(self.entries) <= IN_MEMORY:
            raise ValueError(f"{name} has {len(self.entries)} entries; {MIN_DOMAIN} to "
                             f"{IN_MEMORY} are allowed in memory, more as a ListTable")

    def __len__(self):
        return len(self.entries)

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256("\n".join(self.entries).encode()).hexdigest()[:16]

    @property
    def treatment(self) -> str:
        """What decryption needs besides the key: the list and the off-list version."""
        return f"{self.fingerprint}/r{FALLBACK_VERSION}"

    @property
    def longest(self) -> int:
        return max(map(len, self.entries))

    def frame(self, spark: SparkSession) -> DataFrame:
        """The list as rows ``(pos, entry)``."""
        return spark.createDataFrame(list(enumerate(self.entries)), "pos int, entry string")


class ListTable:
    """A list of any size: the table ``(entry, pos)`` in the shared folder.

    Entries are normalised as those of ``WordList``; of equal ones the first stays.
    Places come from a range sort with the sizes of its parts as offsets.
    """

    def __init__(self, rows: DataFrame, name="list"):
        """``rows(entry, order)``: lines, and what puts them in order (unique)."""
        from velario.functions.names import normalise
        self.spark, self.name = rows.sparkSession, name
        # written as they come: else the optimizer normalises every line before what makes them distinct
        rows = saved(rows.select("entry", "order"), "list_lines")
        clean = rows.select(normalise(F.col("entry").cast("string")).alias("entry"), "order").where("entry <> ''")
        first = saved(clean.groupBy("entry").agg(F.min("order").alias("order")), "list_entries")
        places = numbered(first.select("order"), "order")
        self.table = saved(first.join(places, "order").select("entry", F.col("__number").cast("bigint").alias("pos")), "list_places")
        row = self.table.agg(F.count(F.lit(1)).alias("n"), F.max(F.length("entry")).alias("longest")).first()
        self.size, self.longest = row["n"], row["longest"]
        if self.size < MIN_DOMAIN:
            raise ValueError(f"{name} has {self.size} entries; {MIN_DOMAIN} are the least")

    def __len__(self):
        return self.size

    @cached_property
    def fingerprint(self) -> str:
        """As that of ``WordList`` up to ``BLOCK`` entries; of more, the digest of the blocks' digests."""
        block = F.floor(F.col("pos") / BLOCK)
        ordered = F.array_sort(F.collect_list(F.struct("pos", "entry")))
        one = self.table.groupBy(block.alias("block")).agg(
            F.sha2(F.array_join(F.transform(ordered, lambda x: x["entry"]), "\n"), 256).alias("digest"))
        digests = [r["digest"] for r in one.orderBy("block").toLocalIterator()]
        whole = digests[0] if len(digests) == 1 else hashlib.sha256("\n".join(digests).encode()).hexdigest()
        return whole[:16]

    @property
    def treatment(self) -> str:
        return f"{self.fingerprint}/r{FALLBACK_VERSION}"

    def frame(self, spark: SparkSession = None) -> DataFrame:
        return self.table.select("pos", "entry")

    def moves(self, permuted) -> DataFrame:
        """``(__entry, __next, __next_title)``; ``permuted`` gives the new place of a place."""
        from velario.functions.names import title
        there = self.table.select(F.col("entry").alias("__entry"), permuted(F.col("pos")).alias("pos"))
        to = self.table.select("pos", F.col("entry").alias("__next"), title(F.col("entry")).alias("__next_title"))
        return there.join(to, "pos").drop("pos")


def list_of(rows: DataFrame, name="list"):
    """``rows(entry, order)`` as a list in memory if it is short, else as a table."""
    if rows.limit(IN_MEMORY + 1).count() <= IN_MEMORY:
        return WordList([r["entry"] for r in rows.orderBy("order").toLocalIterator() if r["entry"] is not None], name)
    return ListTable(rows, name)


def load(spark: SparkSession, path: str, name=None):
    """Read a list file: one entry per line, blanks and ``#`` lines skipped."""
    lines = F.posexplode(F.split(F.col("value"), "\r\n|\r|\n")).alias("pos", "line")
    rows = (spark.read.text(path, wholetext=True).select(lines)
            .where((F.trim("line") != "") & ~F.ltrim("line").startswith("#")))
    # repeated lines go before anything is counted or leaves the executors
    first = rows.groupBy("line").agg(F.min("pos").alias("pos"))
    return list_of(first.select(F.col("line").alias("entry"), F.col("pos").alias("order")), name or path.rsplit("/", 1)[-1])


def _cross(stems, endings):
    return [s + e for s in stems.split() for e in endings.split()]


def default_names() -> WordList:
    """First names built by rule: stems of common names with usual endings."""
    return WordList(_cross("alber ales ange anto bene caro dani dona emi euge fabi fede "
                           "gabri giova giusi laure lore luci mari nico palmi rena sal serge",
                           "na no ta to la lo ra ro lina lino nella nello"), "names")


def default_surnames() -> WordList:
    """Surnames built by rule, like the names."""
    return WordList(_cross("barb ber bian bor can cap cas col cos don fab fer gal ghe lom "
                           "man mar mor pal pel ric ros sal san ser tes tor val ven zan",
                           "ini etti elli otti one ari ola uzzi acci ese ano ato ero izzo"), "surnames")


def default_lists() -> dict:
    return {"nomi": default_names(), "cognomi": default_surnames()}
