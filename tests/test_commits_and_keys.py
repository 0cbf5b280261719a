import pytest

from velario.operators.keys import discover
from velario.queries.derived import KEY
from velario.sources.documents import POLICY_ROWS
from velario.plans import registry as R
from velario.plans.runner import Runner
from velario.sources.store import ConflictingCommit, TableStore


def test_of_two_runs_from_one_version_one_commits(spark, tmp_path):
    spark.range(8).selectExpr("id", "'x' as city").write.parquet(f"{tmp_path}/t")
    store = TableStore(spark, f"{tmp_path}/store")
    store.register("t", f"{tmp_path}/t")
    first, second = store.new_run(), store.new_run()
    for run in (first, second):
        store.write("t", run, store.read("t"))
    store.commit("t", first, 1)
    with pytest.raises(ConflictingCommit):
        store.commit("t", second, 1)
    assert store.current("t")["run"] == first and [r["run"] for r in store.leftovers().collect()] == [second]
    assert not store._create(f"{store.root}/commits/v-t-{2:012d}.json", [{"table": "t"}])       # the file of version 2 is there

    policy = spark.createDataFrame([("t", "id", "mantieni", None, None), ("t", "city", "azzera", None, None)], POLICY_ROWS)
    runner, write = Runner(store, policy, KEY, "db"), store.write

    def overtaken(table, run, rows, by_range=False):
        write(table, run, rows, by_range)
        store.commit(table, second)                                    # someone else, in the middle of the run

    store.write = overtaken
    with pytest.raises(ConflictingCommit):
        runner.run("cifra")
    assert store.current("t")["run"] == second and store.read("t").where("city is not null").count() == 8
    assert {r["state"] for r in runner.recover().collect()} == {"in_chiaro"}


def test_keys_are_found_in_the_values(spark):
    tables = {"a": spark.createDataFrame([(1, "x", None), (2, "y", 5), (3, "y", 5)], "id int, name string, other bigint"),
              "b": spark.createDataFrame([(1, 2), (2, 2), (9, None)], "id int, a_id int"),
              "c": spark.createDataFrame([], "id int, at date"), "d": spark.createDataFrame([(1.5,)], "x double")}
    columns, links = discover(tables)
    assert {(r["table"], r["column"]) for r in columns.where("is_key").collect()} == {("a", "id"), ("b", "id")}
    assert {tuple(r) for r in links.collect()} == {("b", "a_id", "a", "id"), ("b", "a_id", "b", "id")}
    counts = {(r["table"], r["column"]): (r["n_rows"], r["n_values"], r["n_distinct"]) for r in columns.collect()}
    assert counts["a", "other"] == (3, 2, 1) and counts["c", "at"] == (0, 0, 0) and ("d", "x") not in counts


def test_a_whole_table_run_tells_how_far_it_is(spark, tmp_path, monkeypatch):
    spark.range(0, 4000, 1, 60).selectExpr("id", "lpad(cast(id as string), 10, '0') as piva").write.parquet(f"{tmp_path}/t")
    store = TableStore(spark, f"{tmp_path}/store")
    store.register("t", f"{tmp_path}/t")
    policy = spark.createDataFrame([("t", "id", "mantieni", None, None), ("t", "piva", "cifra", "PIVA", None)], POLICY_ROWS)
    runner = Runner(store, policy, KEY, "db")
    runner.look, seen = 0.02, []
    note = store.log_progress
    store.log_progress = lambda run, table, done, total: (seen.append(done), note(run, table, done, total))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    monkeypatch.setattr(store, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    try:
        with pytest.raises(RuntimeError, match="lost"):
            runner.run("cifra", on_bad="skip")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(seen) >= 2 and seen == sorted(set(seen)) and 0 < seen[0] < 4000
    row = R.status(store.registry(), store.progress(), "db").first()
    assert (row["table"], row["column"], row["state"]) == ("t", "piva", "in_corso")
    assert 0 < row["percent"] <= 100 and row["seconds_left"] is not None


def test_recover_tells_by_the_rows_touched(spark, tmp_path, monkeypatch):
    spark.range(5).selectExpr("id", "cast(null as string) as piva", "lpad(cast(id as string), 11, '0') as other").write.parquet(f"{tmp_path}/t")
    store = TableStore(spark, f"{tmp_path}/store")
    store.register("t", f"{tmp_path}/t")
    policy = spark.createDataFrame([("t", "id", "mantieni", None, None), ("t", "piva", "cifra", "PIVA", None),
                                    ("t", "other", "cifra", "PIVA", None)], POLICY_ROWS)
    runner = Runner(store, policy, KEY, "db")
    monkeypatch.setattr(runner, "_conclude", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        runner.run("cifra")
    told = {r["column"]: (r["state"], r["rows"]) for r in runner.recover().collect()}
    assert told == {"piva": ("in_chiaro", 0), "other": ("cifrata", 5)}
    assert store.read("t").columns == ["id", "piva", "other"]
