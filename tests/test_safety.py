"""Data safety: what is damaged, lost or of the wrong type must stop a run."""

import glob

import pytest
from pyspark.sql import functions as F

from tests.test_runner import CODES, CONSTRAINTS, KEY, POLICY
from velario.functions import checksums as C
from velario.operators.alphabet import decrypt_text, encrypt_text
from velario.operators.mapping import WriteWithoutEffect, check_effect
from velario.operators.preview import preview_values, untreatable
from velario.operators.pseudonymise import Rule, context, decrypt, encrypt
from velario.operators.ranges import numbered
from velario.plans import policy as P
from velario.plans.runner import Runner
from velario.sources import wordlists
from velario.sources.documents import POLICY_ROWS
from velario.sources.store import TableStore


def test_a_truncated_registry_stops_everything(spark, tmp_path):
    spark.createDataFrame([(1, CODES[0], "Roma")], "id int, codice_fiscale string, citta string").write.parquet(f"{tmp_path}/c")
    store = TableStore(spark, f"{tmp_path}/store")
    store.register("clienti", f"{tmp_path}/c")
    runner = Runner(store, spark.createDataFrame(POLICY[:3], POLICY_ROWS), KEY, "db", CONSTRAINTS)
    runner.run("cifra")
    for part in glob.glob(f"{tmp_path}/store/registry/part-*"):
        data = open(part).read()
        if data:
            open(part, "w").write(data[:len(data) // 2])
    for crc in glob.glob(f"{tmp_path}/store/registry/.part-*"):
        open(crc, "w").close()
    with pytest.raises(Exception):
        runner.problems("cifra").collect()


def test_a_log_row_without_its_key_is_damage(spark, tmp_path):
    store = TableStore(spark, f"{tmp_path}/store")
    spark.createDataFrame([("db", "t", "c")], "database string, table string, column string").write.json(f"{tmp_path}/store/registry")
    with pytest.raises(Exception, match="damaged"):
        store.registry().collect()


def test_lost_surrogates_stop_the_commit():
    assert check_effect(2, 2) == 2 and check_effect(0, 0) == 0
    for due, new in ((2, 1), (2, 0)):
        with pytest.raises(WriteWithoutEffect):
            check_effect(due, new)


def test_lists_load_whole_despite_repeats(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(wordlists, "IN_MEMORY", 150)
    words = [f"name{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(140)]
    path = tmp_path / "list.txt"
    path.write_text("\n".join([words[0]] * 120 + ["# note", ""] + words))
    assert wordlists.load(spark, str(path)).entries == [w.upper() for w in words]


def test_only_text_columns_may_be_encrypted(spark):
    schema = spark.createDataFrame([("t", c, ty, True) for c, ty in (("a", "date"), ("b", "int"), ("c", "string"), ("d", "varchar(9)"),
                                                                    ("e", "interval day"))],
                                   "table string, column string, type string, nullable boolean")
    rules = schema.select("table", "column", F.lit("cifra").alias("strategy"), F.lit("PIVA").alias("kind"), F.lit(None).cast("string").alias("tweak"))
    assert sorted(r["place"] for r in P.numeric_columns(rules, schema).collect()) == ["t.a", "t.b", "t.e"]


def test_surrogates_can_be_judged_in_the_same_plan(spark):
    rows = spark.createDataFrame([("IT60X0542811101000000123456", "00743110157", CODES[0], "Mario")],
                                 "iban string, piva string, cf string, nome string")
    rules = [Rule("iban", "IBAN"), Rule("piva", "PIVA"), Rule("cf", "CF"), Rule("nome", "NOME")]
    there = encrypt(rows, KEY, rules)
    assert there.where(C.iban_ok("iban") & C.piva_ok("piva") & C.cf_ok("cf")).count() == 1
    assert decrypt(there, KEY, rules).collect() == rows.collect()


def test_no_rules_no_rows(spark):
    rows = spark.createDataFrame([("x",)], "piva string")
    assert preview_values(rows, context(spark, KEY), []).count() == 0
    assert untreatable(rows, context(spark, KEY), []).count() == 0


def test_keys_of_any_type_are_numbered(spark):
    keys = [f"k{i:04d}" for i in range(500)]
    found = {r["key"]: r["__number"] for r in numbered(spark.createDataFrame([(k,) for k in reversed(keys)], "key string"), "key").collect()}
    assert found == {k: i for i, k in enumerate(keys)}


def test_an_alphabet_of_ones_own(spark):
    rows = spark.createDataFrame([("abba",), ("aXb",), ("a",), (None,), ("",)], "v string")
    there = encrypt_text(rows, KEY, "v", "ab", b"t", "s", "e").collect()
    assert [r["e"] for r in there] == ["too_short", "foreign_character", "too_short", None, "too_short"]
    wide = spark.createDataFrame([("abbaabba" * 2,)], "v string")
    back = decrypt_text(encrypt_text(wide, KEY, "v", "ab", b"t", "s", "e"), KEY, "s", "ab", b"t", "r", "f").first()
    assert back["r"] == back["v"] != back["s"] and set(back["s"]) <= set("ab")
    with pytest.raises(ValueError):
        encrypt_text(wide, KEY, "v", "aab", b"t", "s", "e")


@pytest.mark.parametrize("only_empties", [False, True])
def test_a_run_broken_off_in_its_first_range_resumes(spark, tmp_path, only_empties):
    rows = [(i, CODES[i % 4], "Roma") for i in range(12)]
    spark.createDataFrame(rows, "id int, codice_fiscale string, citta string").write.parquet(f"{tmp_path}/c")
    store = TableStore(spark, f"{tmp_path}/store")
    store.register("clienti", f"{tmp_path}/c")
    policy = [POLICY[0], ("clienti", "codice_fiscale", "mantieni", None, None) if only_empties else POLICY[1], POLICY[2]]
    runner = Runner(store, spark.createDataFrame(policy, POLICY_ROWS), KEY, "db", CONSTRAINTS, rows_per_range=5)
    write = store.write

    def fail(*args, **kwargs):
        raise OSError("disk")

    store.write = fail
    with pytest.raises(OSError):
        runner.run("cifra")
    store.write = write
    runner.resume("cifra", "clienti")
    done = store.read("clienti")
    assert done.where("citta is not null").count() == 0 and done.count() == 12
    assert (done.where(F.col("codice_fiscale").isin(CODES)).count() == 0) != only_empties


def test_repeating_values_are_treated_once_with_the_same_result(spark, tmp_path):
    rows = [(i, None if i % 9 == 0 else CODES[i % 4] if i % 50 else "?", "Roma") for i in range(200)]
    given = spark.createDataFrame(rows, "id int, codice_fiscale string, citta string")
    given.write.parquet(f"{tmp_path}/c")
    store = TableStore(spark, f"{tmp_path}/store")
    store.register("clienti", f"{tmp_path}/c")
    runner = Runner(store, spark.createDataFrame(POLICY[:3], POLICY_ROWS), KEY, "db", CONSTRAINTS)
    report = runner.run("cifra", on_bad="skip")
    inline = encrypt(given, KEY, [Rule("codice_fiscale", "CF", "persona")], on_bad="skip")
    assert store.read("clienti").select("id", "codice_fiscale").exceptAll(inline.select("id", "codice_fiscale")).count() == 0
    logged = store.operations().where("phase = 'checked'").first()
    assert logged["rows"] == 200 and 4 <= logged["n_distinct"] <= 6         # an estimate
    done = {r["column"]: (r["rows_updated"], r["n_untreatable"]) for r in report.columns.collect()}
    bad = sum(1 for r in rows if r[1] == "?")
    assert done["codice_fiscale"] == (sum(1 for r in rows if r[1]) - bad, bad)
