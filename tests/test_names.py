"""The walk of off-list names, held against a walk of one value at a time."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from velario.fixed import CONSONANTS, VOWELS
from velario.functions import names as N
from velario.functions.ff1 import engine, step_digits
from velario.operators.pseudonymise import Rule, decrypt, encrypt
from velario.queries.derived import KEY
from velario.sources.wordlists import ListTable, WordList

FF1 = engine(bytes(range(32)))
UNIT = re.compile(N.UNIT_PATTERN)


def kind_of(unit):
    return next((k, pieces.index(unit)) for k, pieces in N.PIECES.items() if unit in pieces)


def shape(word):
    return [kind_of(u)[0] for u in UNIT.findall(word)], [i for i in range(len(word) - 1) if word[i] == word[i + 1] and word[i] in VOWELS]


def plain_walk(value, entries, tweak, forward):
    places = [i for i, c in enumerate(value) if len(c.upper()) == 1 and "A" <= c.upper() <= "Z"]
    word = "".join(value[i].upper() for i in places)
    index, size = 0, 1
    for unit in UNIT.findall(word):
        kind, place = kind_of(unit)
        index, size = index * len(N.PIECES[kind]) + place, size * len(N.PIECES[kind])
    digits = max(2, len(str(size - 1)))
    while True:

        index = int(step_digits(FF1, np.array([index], np.int64 if digits <= 18 else object), digits, tweak, forward)[0])
        if index >= size:
            continue
        rest, pieces = index, []
        for kind in reversed(shape(word)[0]):
            rest, place = divmod(rest, len(N.PIECES[kind]))
            pieces.insert(0, N.PIECES[kind][place])
        found = "".join(pieces)
        if shape(found) != shape(word):
            continue
        out = list(value)
        for i, letter in zip(places, found):
            out[i] = letter if value[i].isupper() else letter.lower()
        if not N.is_entry("".join(out), entries):
            return "".join(out)


def some_values(seed, n):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        word = "".join(rng.choice(VOWELS + CONSONANTS + VOWELS * 3 + "LRSTN") for _ in range(rng.randint(4, 11)))
        word = rng.choice([word, word.lower(), word.title(), word[:2] + "'" + word[2:].lower(), word[:3] + "é" + word[3:], word[:3] + " " + word[3:]])
        size = 1
        for unit in UNIT.findall("".join(c.upper() for c in word if "A" <= c.upper() <= "Z")):
            size *= len(N.PIECES[kind_of(unit)[0]])
        if size >= 100:
            out.add(word)
    return sorted(out)


@pytest.mark.parametrize("forward", [True, False])
def test_matrices_walk_as_single_values_do(forward):
    values = some_values(3, 60) + ["AAAA BOCCA", "ssrrllbbcc", "ıſola", "Straße bella"]
    landed = N.walk_off_list(FF1, values[:30], frozenset(), b"t", forward)
    entries = frozenset(v.upper() for v in landed[:12])                  # some walks land on entries and go on
    found = N.walk_off_list(FF1, values, entries, b"t", forward)
    assert found == [plain_walk(v, entries, b"t", forward) for v in values]
    free = [(v, f) for v, f in zip(values, found) if not N.is_entry(v, entries) and not set(v) & set("ıſ")]
    back = N.walk_off_list(FF1, [f for _, f in free], entries, b"t", not forward)
    assert back == [v for v, _ in free]
    assert N.walk_off_list(FF1, [], entries, b"t", forward) == []


def test_a_list_as_a_table_gives_what_the_list_in_memory_gives(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("bcdfgl") + rng.choice("aeio") for _ in range(3)) for _ in range(400)})
    lines = words + [" " + words[0].upper() + " ", ""]
    memory = WordList(lines, "w")
    table = ListTable(spark.createDataFrame(list(enumerate(lines)), "order int, entry string"), "w")
    assert [r["entry"] for r in table.frame().orderBy("pos").collect()] == memory.entries
    assert (len(table), table.longest, table.treatment) == (len(memory), memory.longest, memory.treatment)
    names = [*words[:150], *[w.upper() for w in words[150:200]], *some_values(6, 120), None, "Di" + words[3], words[5].upper()[:4] + words[5][4:]]
    rows = spark.createDataFrame(list(enumerate(names)), "id int, cognome string")
    rules = [Rule("cognome", "COGNOME")]
    one = encrypt(rows, KEY, rules, on_bad="skip", lists={"cognomi": memory})
    two = encrypt(rows, KEY, rules, on_bad="skip", lists={"cognomi": table})
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    back = decrypt(two, KEY, rules, on_bad="skip", lists={"cognomi": table})
    assert sorted(map(tuple, back.collect())) == sorted(enumerate(names))
    plan = encrypt(rows.where("id < 3"), KEY, [Rule("cognome", "COGNOME")], lists={"cognomi": table})
    assert words[100].upper() not in plan._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        ListTable(spark.createDataFrame([(1, "one")], "order int, entry string"))


def test_native_digits_equal_the_arrow_function(spark):
    rows = spark.range(300).select(F.lpad((F.col("id") * 33_333_331 % 10 ** 10).cast("string"), 10, "0").alias("body"), "id")
    from velario.functions import checksums as C
    rows = rows.select("id", F.when(F.col("id") % 50 > 0, F.concat("body", C.vat_digit(F.col("body")))).alias("piva"))
    arrow = encrypt(rows, KEY, [Rule("piva", "PIVA")])
    native = encrypt(rows, KEY, [Rule("piva", "PIVA")], native=True)
    assert sorted(map(tuple, arrow.collect())) == sorted(map(tuple, native.collect()))
    plan = native._jdf.queryExecution().toString()
    assert "ArrowEvalPython" not in plan and KEY.bytes.hex() not in plan.lower()
    assert decrypt(native, KEY, [Rule("piva", "PIVA")], native=True).exceptAll(rows).isEmpty()


@pytest.mark.parametrize("n", [3, 9, 10, 13])
def test_native_rounds_of_short_halves_come_from_a_table(spark, n):
    from velario.functions import ff1_native as V
    from velario.functions.ff1 import permute_numerals
    rows = spark.range(60).select("id", F.when(F.col("id") % 20 > 0, F.lpad(
        (F.col("id") * 7_777_777_777_777 % 10 ** n).cast("string"), n, "0")).alias("plain")).collect()
    df = spark.createDataFrame(rows, "id long, plain string")
    there = V.with_permuted_digits(df, KEY.bytes, F.col("plain"), n, b"t", True, "there")
    back = V.with_permuted_digits(there, KEY.bytes, F.col("there"), n, b"t", False, "back")
    plan = spark._jvm.PythonSQLUtils.explainString(back._jdf.queryExecution(), "formatted").split("== Subqueries ==")[0]
    assert ("aesEncrypt" in plan) == (n > 10)                            # no block for each row where halves are short
    found = back.orderBy("id").collect()
    given = [r["plain"] for r in rows if r["plain"]]
    kernel = permute_numerals(FF1, np.array([[int(c) for c in v] for v in given], np.int64), 10, b"t", True)
    assert [r["there"] for r in found if r["plain"]] == ["".join(map(str, v)) for v in kernel]
    assert [(r["there"] is None, r["back"]) for r in found] == [(r["plain"] is None, r["plain"]) for r in rows]
    from velario.functions.identifiers import forget_tables
    forget_tables()
    assert not V._TABLES and there.orderBy("id").collect() == [r[:3] for r in found]


def test_walks_of_long_names_share_rounds_batches_and_tasks(spark, monkeypatch):
    from velario.functions import identifiers as I
    rng = random.Random(8)
    digits = np.array([n for n in range(2, 29) for _ in range(4)])
    x = np.array([rng.randrange(10 ** int(n)) for n in digits], object)
    for forward in (True, False):                                         # more than 18 digits too
        single = np.concatenate([step_digits(FF1, x[digits == n], n, b"t", forward) for n in range(2, 29)])
        assert (FF1.permute_mixed(x, digits, b"t", forward) == single).all()

    words = sorted({"".join(rng.choice("bcdfgl") + rng.choice("aeio") for _ in range(3)) for _ in range(300)})
    lists = {"cognomi": ListTable(spark.createDataFrame([*enumerate(words), (999, words[0])], "order int, entry string"), "w")}
    names = [w.title() + tail for w in words[:40] for tail in ("zolamira", "zolamiratrecosta", "zolamirabelvenidoratrecostalumi")]
    rows = spark.createDataFrame([*enumerate([*names, names[0], None])], "id int, cognome string").coalesce(1)
    rules, tasks, saved = [Rule("cognome", "COGNOME")], [], I.saved

    def watched(df, name):
        tasks.append(df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple").count("REPARTITION_BY_NUM"))
        return saved(df, name)
    monkeypatch.setattr(I, "saved", watched)
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        monkeypatch.setattr(N, "_TOGETHER", 20)
        there = encrypt(rows, KEY, rules, lists=lists).orderBy("id").collect()
        plain = rows.select("id", N.off_list_udf(KEY.bytes, frozenset(), b"cognome|cognomi|unita", True)("cognome").alias("cognome"))
        assert plain.orderBy("id").collect() == there                     # no surrogate is an entry here
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    assert tasks[0] > 0                                                   # not as few tasks as bytes ask for
    assert [r["cognome"] for r in there] == N.walk_off_list(FF1, names, frozenset(), b"cognome|cognomi|unita", True) + [
        there[0]["cognome"], None]
