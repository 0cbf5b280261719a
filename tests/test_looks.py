"""Counts and previews against plain versions, and how often their plans read the table."""

import io
from contextlib import redirect_stdout

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from velario.key import Key
from velario.operators.preview import preview_values, smallest_values, untreatable
from velario.operators.profile import profile
from velario.operators.pseudonymise import Rule, context

KEY = Key(bytes(range(32)))
SCHEMA = "a string, b bigint, c string"
ROWS = st.lists(st.tuples(st.sampled_from([None, "", "x", "10", "9", "ü"]), st.sampled_from([None, -3, 0, 9, 10, 2**62]),
                          st.none()), max_size=12)


def plan(df):
    with redirect_stdout(io.StringIO()) as out:
        df.explain("formatted")
    return out.getvalue()


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ROWS)
def test_exact_counts(spark, rows):
    found = {r["column"]: tuple(r)[1:] for r in profile(spark.createDataFrame(rows, SCHEMA), ["a", "b", "c"]).collect()}
    for i, c in enumerate("abc"):
        held = [r[i] for r in rows if r[i] is not None]
        assert found[c] == (len(rows), len(held), len(set(held)))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ROWS)
def test_smallest_values_in_their_types_order(spark, rows):
    found = smallest_values(spark.createDataFrame(rows, SCHEMA), ["a", "b", "c"], 2).collect()
    for i in range(3):
        held = {r[i] for r in rows if r[i] is not None}
        mine = [r for r in found if r["at"] == i]
        assert {r["before"] for r in mine} == {str(v) for v in sorted(held)[:2]}
        assert {(r["n_rows"], r["n_distinct"]) for r in mine} <= {(len(rows), len(held))}


def test_counts_do_not_widen_rows(spark, tmp_path):
    spark.createDataFrame([("x", 1, "y")], SCHEMA).write.parquet(str(tmp_path / "t"))
    text = plan(profile(spark.read.parquet(str(tmp_path / "t")), ["a", "b"]))
    assert "Expand" not in text and "ReadSchema: struct<a:string>" in text and "ReadSchema: struct<b:bigint>" in text


def test_untreatable_reads_once_and_gives_each_value_once(spark, tmp_path):
    rows = [("1", None), ("1", "RSSMRA85T10A562S"), (None, "short"), ("01234567897", "short")] * 3
    spark.createDataFrame(rows, "p string, f string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    found = untreatable(df, context(spark, KEY), [Rule("p", "PIVA"), Rule("f", "CF")])
    assert plan(found).count("Location: InMemoryFileIndex") == 1
    assert sorted(map(tuple, found.collect())) == [("f", "short", "bad_length_or_alphabet"), ("p", "1", "not_11_digits")]


def test_looking_reads_once(spark, tmp_path):
    spark.createDataFrame([("x", 1, "y"), (None, 2, "z")], SCHEMA).write.parquet(str(tmp_path / "t"))
    df = smallest_values(spark.read.parquet(str(tmp_path / "t")), ["a", "b"], 3)
    assert df.count() == 3
    assert sorted((r["at"], r["before"], r["n_rows"], r["n_distinct"]) for r in df.collect()) == [
        (0, "x", 2, 1), (1, "1", 2, 2), (1, "2", 2, 2)]
    df.collect()
    assert "ReusedExchange" in plan(df)


def test_a_column_ruled_and_emptied_and_one_without_values(spark):
    df = spark.createDataFrame([("01234567897", None)], "p string, e string")
    found = preview_values(df, context(spark, KEY), [Rule("p", "PIVA"), Rule("e", "PIVA")], ["p"]).collect()
    assert [(r["operation"], r["column"], r["before"], r["after"] is None) for r in found] == [
        ("cifra", "p", "01234567897", False), ("azzera", "p", "01234567897", True)]


@pytest.mark.parametrize("columns", [None, []])
def test_rows_alone(spark, columns):
    assert [tuple(r) for r in profile(spark.range(3), columns).collect()] == [(None, 3, None, None)]
