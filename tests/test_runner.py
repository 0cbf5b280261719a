import pytest
from pyspark.sql import functions as F

from velario.key import Key
from velario.operators import preview
from velario.operators.pseudonymise import Rule, context
from velario.plans import registry as R
from velario.plans.runner import GateFailed, Report, Runner, UntreatableValue
from velario.sources.documents import POLICY_ROWS, load_policy, policy_key_id, save_policy, save_report
from velario.sources.store import TableStore
from velario.sources.tables import Constraints

KEY = Key(bytes(range(32)))
OTHER = Key(bytes(range(1, 33)))
CODES = ["RSSMRA85H12F205Y", "BNCLGU78T04H501C", "VRDNNA90A41F839L", "MRTPLA65M15L219C"]
CONSTRAINTS = Constraints(
    primary_keys={"clienti": ["id"], "contratti": ["id"]},
    foreign_keys=[("contratti", "cf_intestatario", "clienti", "codice_fiscale")],
    not_null={"contratti": ["cf_intestatario", "importo"]})
POLICY = [
    ("clienti", "id", "mantieni", None, None), ("clienti", "codice_fiscale", "cifra", "CF", "persona"),
    ("clienti", "citta", "azzera", None, None), ("contratti", "id", "mantieni", None, None),
    ("contratti", "cf_intestatario", "cifra", "CF", "persona"), ("contratti", "importo", "mantieni", None, None),
]


@pytest.fixture
def shop(spark, tmp_path):
    def build(dirty=False, policy=POLICY, rows_per_range=None, key=KEY):
        people = [(i, c, "Roma") for i, c in enumerate(CODES, 1)]
        if dirty:
            people.append((99, "NON-UN-CF", "Roma"))
        spark.createDataFrame(people, "id int, codice_fiscale string, citta string").write.parquet(
            str(tmp_path / "clienti"), mode="overwrite")
        deals = [(i, c, str(100 * i)) for i, c in enumerate([CODES[0], *CODES], 1)]
        spark.createDataFrame(deals, "id int, cf_intestatario string, importo string").write.parquet(
            str(tmp_path / "contratti"), mode="overwrite")
        store = TableStore(spark, str(tmp_path / "store"))
        for t in ("clienti", "contratti"):
            if store.current(t) is None:
                store.register(t, str(tmp_path / t))
        return Runner(store, spark.createDataFrame(policy, POLICY_ROWS), key, "db", CONSTRAINTS,
                      rows_per_range=rows_per_range)
    return build


def column(df, name, key="id"):
    return [r[0] for r in df.orderBy(key).select(name).collect()]


def test_round_trip_join_and_registry(shop):
    runner = shop()
    joined = lambda: runner.store.read("clienti").join(
        runner.store.read("contratti"), F.col("codice_fiscale") == F.col("cf_intestatario")).count()
    assert joined() == 5
    report = runner.run("cifra")
    assert {(r["table"], r["column"], r["rows_updated"]) for r in report.columns.collect()} == {
        ("clienti", "codice_fiscale", 4), ("clienti", "citta", 4), ("contratti", "cf_intestatario", 5)}
    treated = column(runner.store.read("clienti"), "codice_fiscale")
    assert not set(treated) & set(CODES) and joined() == 5
    assert column(runner.store.read("clienti"), "citta") == [None] * 4
    states = {(r["table"], r["column"]): r["state"] for r in R.listing(runner.store.registry(), "db").collect()}
    assert states == {("clienti", "codice_fiscale"): "cifrata", ("clienti", "citta"): "azzerata",
                      ("contratti", "cf_intestatario"): "cifrata"}
    with pytest.raises(GateFailed, match="already encrypted"):
        runner.run("cifra")
    with pytest.raises(GateFailed, match="another key"):
        Runner(runner.store, runner.policy, OTHER, "db", CONSTRAINTS).run("decifra")
    runner.run("decifra")
    assert column(runner.store.read("clienti"), "codice_fiscale") == CODES
    assert column(runner.store.read("clienti"), "citta") == [None] * 4
    assert runner.store.leftovers().isEmpty()


def test_untreatable_value_stops_before_writing(shop):
    runner = shop(dirty=True)
    with pytest.raises(UntreatableValue, match="nothing was written"):
        runner.run("cifra")
    assert runner.store.registry().isEmpty() and runner.store.current("clienti")["version"] == 1
    report = runner.run("cifra", on_bad="skip")
    assert [tuple(r) for r in report.untreatable.collect()] == [
        ("clienti", "codice_fiscale", "NON-UN-CF", "bad_length_or_alphabet")]
    assert column(runner.store.read("clienti"), "codice_fiscale")[-1] == "NON-UN-CF"


def test_fail_closed(shop):
    runner = shop(policy=POLICY[1:])
    with pytest.raises(GateFailed) as failure:
        runner.run("cifra")
    assert [p["rule"] for p in failure.value.problems] == ["undeclared_column"]


def test_single_column_and_foreign_key_tweak(shop, spark):
    runner = shop()
    only = spark.createDataFrame([("clienti", "codice_fiscale")], "table string, column string")
    runner.run("cifra", only=only)
    assert column(runner.store.read("clienti"), "citta") == ["Roma"] * 4
    assert column(runner.store.read("contratti"), "cf_intestatario") == [CODES[0], *CODES]
    assert {r["column"] for r in R.listing(runner.store.registry(), "db").collect()} == {"codice_fiscale"}
    loose = shop(policy=[(t, c, s, k, None) for t, c, s, k, _ in POLICY])
    assert "fk_tweak" in {p["rule"] for p in loose.problems("cifra").collect()}


def test_ranges_resume_like_uninterrupted(shop):
    whole = shop()
    whole.run("cifra")
    expected = column(whole.store.read("clienti"), "codice_fiscale")
    again = shop(rows_per_range=1)
    again.store.root += "-ranges"
    again.store.register("clienti", whole.store.current("clienti", 1)["path"])
    again.store.register("contratti", whole.store.current("contratti", 1)["path"])

    def stop(number):
        if number == 1:
            raise KeyboardInterrupt
    with pytest.raises(KeyboardInterrupt):
        again.run("cifra", on_range=stop)
    assert column(again.store.read("clienti"), "codice_fiscale") == CODES       # not committed
    assert again.store.leftovers().count() == 1
    entry = {r["column"]: r["last_key"] for r in R.interrupted(again.store.registry(), "db").collect()}
    assert entry == {"codice_fiscale": "2", "citta": "2"}
    with pytest.raises(GateFailed, match="never finished"):
        again.run("cifra")
    status = R.status(again.store.registry(), again.store.progress(), "db").collect()
    assert {r["percent"] for r in status} == {50}
    assert again.recover().isEmpty()
    seen = []
    report = again.resume("cifra", "clienti", on_range=seen.append)
    assert seen == [2, 3]
    assert {r["column"]: r["rows_updated"] for r in report.columns.collect()} == {"codice_fiscale": 4, "citta": 4}
    assert column(again.store.read("clienti"), "codice_fiscale") == expected
    assert R.interrupted(again.store.registry(), "db").isEmpty()


def test_recover_after_crash_around_the_commit(shop, monkeypatch):
    runner = shop()
    monkeypatch.setattr(runner, "_conclude", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        runner.run("cifra")
    monkeypatch.undo()
    assert {r["state"] for r in runner.recover().collect()} == {"cifrata", "azzerata"}
    assert R.interrupted(runner.store.registry(), "db").isEmpty()

    fresh = shop()
    fresh.store.root += "-2"
    fresh.store.register("clienti", runner.store.current("clienti", 1)["path"])
    fresh.store.register("contratti", runner.store.current("contratti", 1)["path"])
    monkeypatch.setattr(fresh.store, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        fresh.run("cifra")
    monkeypatch.undo()
    left = fresh.store.leftovers().collect()
    assert len(left) == 1 and fresh.store.count_leftover("clienti", left[0]["run"]) == 4
    with pytest.raises(ValueError):
        fresh.store.drop_leftover("clienti", left[0]["run"])
    fresh.store.drop_leftover("clienti", left[0]["run"], confirm=True)
    assert fresh.store.leftovers().isEmpty()
    assert {r["state"] for r in fresh.recover().collect()} == {"in_chiaro"}
    fresh.run("cifra")


def test_resolve_and_realign(shop, spark):
    runner = shop()
    runner.run("cifra")
    log = runner.store.registry()
    runner.store.append_registry(R.realign(log, "db"))
    log = runner.store.registry()
    assert {r["state"] for r in R.listing(log, "db").collect()} == {"in_chiaro"}
    with pytest.raises(R.InconsistentState):
        R.resolve(log, "db", "clienti", "codice_fiscale", "cifrata")
    ages = R.history(log).where("table = 'contratti'").orderBy("age").collect()
    assert [r["state"] for r in ages] == ["cifrata", "in_corso"]
    assert {p["rule"] for p in runner.problems("decifra").collect()} >= {"not_encrypted"}


def test_previews(shop):
    runner = shop(dirty=True)
    df, ctx = runner.store.read("clienti"), context(runner.spark, KEY)
    rules = [Rule("codice_fiscale", "CF", "persona")]
    rows = preview.preview_rows(df, ctx, rules, ["citta"], ["id"], ordered=True).collect()
    assert rows[0]["codice_fiscale"]["before"] == CODES[0] and rows[0]["codice_fiscale"]["after"]
    assert rows[-1]["codice_fiscale"]["error"] == "bad_length_or_alphabet"
    assert rows[0]["citta"]["before"] == "Roma" and rows[0]["citta"]["after"] is None
    values = preview.preview_values(df, ctx, rules, ["citta"]).collect()
    assert {(r["operation"], r["n_rows"], r["n_distinct"]) for r in values} == {("cifra", 5, 5), ("azzera", 5, 1)}
    back = context(runner.spark, KEY, forward=False)
    assert {r["operation"] for r in preview.preview_values(df, back, rules, ["citta"]).collect()} == {"cifra"}


def test_no_value_and_no_key_in_logs_and_plans(shop):
    runner = shop(dirty=True)
    with pytest.raises(UntreatableValue) as failure:
        runner.run("cifra")
    assert "NON-UN-CF" not in str(failure.value)
    log = runner.store.operations().toPandas().to_string()
    assert "NON-UN" not in log and CODES[0] not in log
    from velario.operators.pseudonymise import encrypt
    plan = encrypt(runner.store.read("clienti"), KEY, [Rule("codice_fiscale", "CF")])
    text = plan._jdf.queryExecution().toString()
    assert KEY.bytes.hex() not in text.lower() and repr(KEY.bytes)[2:-1] not in text
    assert KEY.id() in repr(KEY) and KEY.bytes.hex() not in repr(KEY)


def test_policy_document_round_trip(spark, tmp_path):
    policy = spark.createDataFrame(POLICY, POLICY_ROWS)
    save_policy(policy, str(tmp_path / "policy"), KEY.id())
    back = load_policy(spark, str(tmp_path / "policy"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(POLICY, key=str)
    assert policy_key_id(spark, str(tmp_path / "policy")) == KEY.id()
    save_report(Report("cifra", "db", policy, policy.limit(1)), str(tmp_path / "report"))
    saved = spark.read.json(str(tmp_path / "report" / "columns"))
    assert saved.count() == len(POLICY) and {(r["direction"], r["database"]) for r in saved.collect()} == {("cifra", "db")}
    assert spark.read.json(str(tmp_path / "report" / "untreatable")).count() == 1
    (tmp_path / "bad.json").write_text('{"formato": "x", "tabelle": {}}')
    with pytest.raises(ValueError, match="unknown format"):
        load_policy(spark, str(tmp_path / "bad.json"))
