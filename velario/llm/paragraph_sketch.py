"""Document fingerprints as invertible Bloom lookup tables of paragraph digests.

A text's paragraphs are its non-empty lines, long ones cut every ``PARAGRAPH``
characters; its set of digests are their XXH64 values. A table has ``CELLS`` cells
of (count, XOR of digests, XOR of check values), and each digest is in one cell of
every third of the table. Tables of two versions subtract cell by cell: what both
hold cancels. Peeling then takes a digest out of a cell that holds a single one,
out of its other cells too, and so on until nothing is left: the digests that
differ are recovered. Where cells remain, the table was too small, and the pair is
tried again with ``GROWTH`` times the cells: as many tables, each for its share of
the digests. Only tables that failed grow further, so a cell array never gets long
and the work is linear in the digests, however long a text.

DataFrame functions only, no Python on the executors. Texts are shuffled once by
row, and as much of each text's beginning as the document before it needs. No row
is grouped by content, so copies or common lines make no hot key.

Cases: a null text is empty, with no digest, an all-zero table and likeness 1 to
another empty one; rows that repeat ``doc_id`` and text are one document, in the
order too, and get a row each; documents without ``doc_id`` come first, equal ids
are ordered by the text's hash; a lone document is its own next one; an empty
table gives no row; other columns are not read.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from velario.llm.shared import row_key, saved, texts

PARAGRAPH = 256
CELLS = 12
GROWTH = 8                   # tables for each that failed
_STEPS = CELLS + 2           # digests a table of so many cells can give at most, and a last look
_DEEPEST = 20

_CELL = "struct<n:int,k:bigint,c:bigint>"


def let(value, body):
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def digests(text):
    """The distinct paragraph digests of a text."""
    parts = F.regexp_extract_all(text, F.lit(r"[^\n]{1,%d}" % PARAGRAPH), F.lit(0))
    return F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p)))


def check(key):
    return F.xxhash64(key, F.lit(77)).bitwiseAND(F.lit(0xFFFFFFFF))


def mask(key, level):
    """A bit for each of the three cells of a digest."""
    third = CELLS // 3
    spots = F.xxhash64(key, F.lit(100 + level))
    one = F.lit(1).cast("bigint")
    bits = [F.call_function("shiftleft", one, (F.pmod(F.shiftrightunsigned(spots, 20 * t), F.lit(third))
                                               + t * third).cast("int")) for t in range(3)]
    return bits[0].bitwiseOR(bits[1]).bitwiseOR(bits[2])


def holds(mask_, i):
    return F.call_function("shiftright", mask_, i).bitwiseAND(F.lit(1)) == 1


def table(keys, level=0):
    """The cells of a set of digests."""
    items = F.transform(keys, lambda k: F.struct(k.alias("k"), check(k).alias("c"), mask(k, level).alias("m")))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("bigint").alias("k"), F.lit(0).cast("bigint").alias("c"))

    def add(cell, x):
        return F.struct((cell["n"] + 1).alias("n"), cell["k"].bitwiseXOR(x["k"]).alias("k"),
                        cell["c"].bitwiseXOR(x["c"]).alias("c"))

    return let(items, lambda all_: F.transform(
        F.sequence(F.lit(0), F.lit(CELLS - 1)),
        lambda i: F.aggregate(F.filter(all_, lambda x: holds(x["m"], i)), zero, add)))


def subtract(a, b):
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"),
                                                  x["c"].bitwiseXOR(y["c"]).alias("c")))


def peel(cells, level=0):
    """``struct(cells, ours, theirs)``: what is left, and the digests recovered of each side."""
    none = F.array().cast("array<bigint>")
    start = F.struct(cells.alias("cells"), none.alias("ours"), none.alias("theirs"), F.lit(False).alias("over"))

    def single(cell):
        return (F.abs(cell["n"]) == 1) & (cell["c"] == check(cell["k"]))

    def take(state, cell):
        key, sign = cell["k"], cell["n"]
        rest = let(F.struct(mask(key, level).alias("m"), check(key).alias("c")), lambda own: F.transform(
            state["cells"], lambda x, i: F.when(holds(own["m"], i), F.struct(
                (x["n"] - sign).alias("n"), x["k"].bitwiseXOR(key).alias("k"), x["c"].bitwiseXOR(own["c"]).alias("c")))
            .otherwise(x)))
        return F.struct(rest.alias("cells"),
                        F.when(sign > 0, F.array_append(state["ours"], key)).otherwise(state["ours"]).alias("ours"),
                        F.when(sign < 0, F.array_append(state["theirs"], key)).otherwise(state["theirs"]).alias("theirs"),
                        F.lit(False).alias("over"))

    def step(state, _):
        stop = F.struct(state["cells"].alias("cells"), state["ours"].alias("ours"), state["theirs"].alias("theirs"),
                        F.lit(True).alias("over"))
        return F.when(state["over"], state).otherwise(let(F.filter(state["cells"], single), lambda pure: F.when(
            F.size(pure) == 0, stop).otherwise(take(state, pure[0]))))

    return F.aggregate(F.sequence(F.lit(1), F.lit(_STEPS)), start, step)


def is_empty(cells):
    return F.forall(cells, lambda x: (x["n"] == 0) & (x["k"] == 0) & (x["c"] == 0))


def fingerprint(cells):
    """The cells as hexadecimal digits: 4 of the count, 16 of the digests, 8 of the checks, each cell."""
    def digits(x, n):
        return F.lpad(F.hex(x), n, "0")

    return F.lower(F.array_join(F.transform(cells, lambda x: F.concat(
        F.substring(digits(x["n"].cast("bigint").bitwiseAND(F.lit(0xFFFF)), 4), 1, 4), digits(x["k"], 16),
        digits(x["c"], 8))), ""))


def differences(pairs: DataFrame) -> DataFrame:
    """``(pair, ours, theirs)``: for ``pairs(pair, a, b)`` of digest sets, the digests
    only one side has, from their tables alone. A pair may have several rows."""
    level, work, parts = 0, pairs.select("pair", "a", "b"), []
    while True:
        tried = work.withColumn("peeled", peel(subtract(table(F.col("a"), level), table(F.col("b"), level)), level))
        tried = saved(tried.select("pair", F.when(is_empty(F.col("peeled")["cells"]), F.struct(
            F.col("peeled")["ours"].alias("ours"), F.col("peeled")["theirs"].alias("theirs"))).alias("done"),
            F.when(~is_empty(F.col("peeled")["cells"]), F.struct("a", "b")).alias("again")), "sketch_pairs")
        parts.append(tried.where("done is not null").select("pair", "done.ours", "done.theirs"))
        failed = tried.where("again is not null").select("pair", "again.a", "again.b")
        if failed.isEmpty():
            break
        if level == _DEEPEST:
            raise RuntimeError("digests that no table size tells apart")
        place = level * 3

        def share(keys, j):
            return F.filter(keys, lambda k: F.shiftrightunsigned(k, place).bitwiseAND(F.lit(GROWTH - 1)) == j)

        work = failed.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(GROWTH - 1)))).select(
            "pair", share(F.col("a"), F.col("j")).alias("a"), share(F.col("b"), F.col("j")).alias("b"))
        work = work.where("size(a) + size(b) > 0")
        level += 1
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def order(source: DataFrame) -> DataFrame:
    """``(doc_id, key_id, key_hash, n_chars, copies, next_id, next_hash)``: each document's next
    by ``doc_id``, the last one's being the first.

    Ids alone are range-partitioned; inside a range the next row is a window's, and
    the ranges meet in a table of one row each.
    """
    ids = source.groupBy("key_id", "key_hash").agg(
        F.first("doc_id").alias("doc_id"), F.first(F.char_length("text")).cast("bigint").alias("n_chars"),
        F.count(F.lit(1)).alias("copies"))
    placed = saved(ids.repartitionByRange(F.col("doc_id").asc_nulls_first(), "key_hash")
                   .withColumn("range", F.spark_partition_id()), "document_order")
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "key_hash", "key_id")
    firsts = placed.groupBy("range").agg(F.min(key).alias("low"))
    by = Window.orderBy("range")
    firsts = firsts.select("range", F.coalesce(F.lead("low").over(by), F.first("low").over(
        by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("after"))
    inside = Window.partitionBy("range").orderBy(key)
    return placed.withColumn("next", F.lead(key).over(inside)).join(firsts, "range").withColumn(
        "next", F.coalesce("next", "after")).select(
        "doc_id", "key_id", "key_hash", "n_chars", "copies", F.col("next.key_id").alias("next_id"),
        F.col("next.key_hash").alias("next_hash"))


def with_edits(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, copies, key_id, key_hash, next_id, next_hash, edited_sha256, own, edited)``
    of each document: the digests of its text and of the text whose second half
    gave way to the beginning of the next document's."""
    source = row_key(texts(docs)).select("key_id", "key_hash", "text")
    following = saved(order(row_key(texts(docs))), "next_documents")
    need = following.select(F.col("next_id").alias("key_id"), F.col("next_hash").alias("key_hash"),
                            F.col("key_id").alias("to_id"), F.col("key_hash").alias("to_hash"),
                            F.floor(F.col("n_chars") / 2).cast("int").alias("need"))
    # where no row is repeated there is nothing to sort out
    repeats = not following.where("copies > 1").isEmpty()
    distinct = source.dropDuplicates(["key_id", "key_hash"]) if repeats else source
    heads = distinct.join(need, ["key_id", "key_hash"]).select(
        F.col("to_id").alias("key_id"), F.col("to_hash").alias("key_hash"), F.substring(F.col("text"), F.lit(1), F.col("need")).alias("head"))
    wide = distinct.join(following, ["key_id", "key_hash"]).join(heads, ["key_id", "key_hash"])
    keep = (F.col("n_chars") - F.floor(F.col("n_chars") / 2)).cast("int")
    edited = wide.withColumn("edited_text", F.concat(F.substring(F.col("text"), F.lit(1), keep), "head"))
    return edited.select("doc_id", "n_chars", "copies", "key_id", "key_hash", "next_id", "next_hash",
                         F.sha2("edited_text", 256).alias("edited_sha256"), digests(F.col("text")).alias("own"),
                         digests(F.col("edited_text")).alias("edited"))


def likeness(n_a, n_b, n_differ):
    """Common digests over all digests of both; 1 for two empty sets."""
    return F.when(n_a + n_b == 0, 1.0).otherwise((n_a + n_b - n_differ) / (n_a + n_b + n_differ))


def compare(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``."""
    rows = saved(with_edits(docs), "paragraph_digests")
    others = rows.select(F.col("key_id").alias("next_id"), F.col("key_hash").alias("next_hash"),
                         F.col("own").alias("next_own"))
    both = rows.join(others, ["next_id", "next_hash"])
    pairs = both.select(F.inline(F.array(
        F.struct(F.struct("key_id", "key_hash", F.lit("edited").alias("to")).alias("pair"), F.col("own").alias("a"), F.col("edited").alias("b")),
        F.struct(F.struct("key_id", "key_hash", F.lit("next").alias("to")).alias("pair"), F.col("own").alias("a"), F.col("next_own").alias("b")))))
    n = F.size("ours") + F.size("theirs")
    to = F.col("pair.to")
    counts = differences(pairs).groupBy(F.col("pair.key_id").alias("key_id"), F.col("pair.key_hash").alias("key_hash")).agg(
        F.coalesce(F.sum(F.when(to == "edited", n)), F.lit(0)).alias("d_edited"),
        F.coalesce(F.sum(F.when(to == "next", n)), F.lit(0)).alias("d_next"))
    sizes = both.select("key_id", "key_hash", F.size("next_own").alias("n_next"))
    known = rows.join(counts, ["key_id", "key_hash"]).join(sizes, ["key_id", "key_hash"])
    result = known.select(
        "copies", "doc_id", "n_chars", "edited_sha256", fingerprint(table(F.col("own"))).alias("fingerprint"),
        fingerprint(table(F.col("edited"))).alias("edited_fingerprint"),
        likeness(F.size("own"), F.size("edited"), F.col("d_edited")).alias("near_edited"),
        likeness(F.size("own"), F.col("n_next"), F.col("d_next")).alias("near_next"))
    return result.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies")))).drop("copy", "copies")
