"""Queries of policy, registry and runs.

Schema rows are those of the real tables. Policies, logs and progress are derived
from rows of the tables by one SQL text, which Spark and the comparison both run.
"""

from pyspark.sql import functions as F

from velario.fixed import CLEAR, ENCRYPT, ENCRYPTED, NULLIFY
from velario.plans import policy as P
from velario.plans import registry as R
from velario.plans.runner import Runner
from velario.queries.derived import KEY, TABLES, people, table, tax_body_sql, tax_letter_sql, vat_sql
from velario.session import shared_folder
from velario.sources import documents as D
from velario.sources.store import TableStore
from velario.sources.tables import Constraints, describe
from velario.sources.wordlists import default_lists

# -- policies --------------------------------------------------------------------------
_SQL_SCHEMA = (
    "select table_name as t, column_name as c, case data_type when 'BIGINT' then 'bigint' when 'VARCHAR' then 'string' "
    "when 'DOUBLE' then 'double' when 'INTEGER' then 'int' when 'TIMESTAMP' then 'timestamp_ntz' else lower(data_type) end as ty "
    f"from information_schema.columns where table_name in ({', '.join(repr(t) for t in TABLES)})")

# A rule for most columns of ``s(t, c, ty)``: what it says follows from the name's
# length and the table's. Both engines run this text.
_RULES = """
select t, c, case when length(c) % 5 = 0 then 'azzera' when length(c) % 5 = 1 then 'mantieni'
                  when length(c) % 5 = 2 then 'distruggi' else 'cifra' end as strategy,
       case when length(c) % 3 = 0 then 'PIVA' when length(c) % 3 = 1 then 'NOME' else 'TARGA' end as kind,
       case when length(c) % 2 = 0 then 'shared' else '' end as tweak
from s where length(c) + length(t) <> 15
union all select distinct t, 'ghost', 'mantieni', cast(null as string), cast(null as string) from s where length(t) > 5
union all select distinct 'old_' || t, 'x', 'cifra', 'CF', cast(null as string) from s where length(t) > 7"""
_RULES_DUCK = _RULES.replace("as string", "as varchar")
_REQUIRED = Constraints(not_null={"customer": ["c_mktsegment", "c_name"], "orders": ["o_totalprice"]},
                        foreign_keys=[("orders", "o_custkey", "customer", "c_custkey"),
                                      ("customer", "c_nationkey", "nation", "n_nationkey"),
                                      ("lineitem", "l_partkey", "part", "p_partkey"),
                                      ("lineitem", "l_suppkey", "supplier", "s_suppkey"),
                                      ("nation", "n_regionkey", "region", "r_regionkey")])


def _schema(spark, sf_dir):
    return describe({t: table(spark, sf_dir, t) for t in TABLES}, _REQUIRED)


def _policy(spark, schema):
    schema.select(F.col("table").alias("t"), F.col("column").alias("c"), F.col("type").alias("ty")).createOrReplaceTempView("s")
    return spark.sql(_RULES).select(F.col("t").alias("table"), F.col("c").alias("column"), "strategy", "kind", "tweak")


def policy_problems(spark, sf_dir):
    """All problems of a policy with faults of every kind, against the real schema."""
    schema = _schema(spark, sf_dir)
    policy = _policy(spark, schema)
    problems = P.check_policy(policy, schema, _REQUIRED.foreign_key_rows(spark)).unionByName(
        P.check_columns(policy, schema, default_lists()))
    return P.ordered_problems(problems).select("level", "place", "rule")


def policy_align(spark, sf_dir):
    schema = _schema(spark, sf_dir)
    proposals = schema.where((F.col("type") == "string") & (F.length("column") % 2 == 1)).select(
        "table", "column", F.lit("PIVA").alias("kind"))
    return P.align(_policy(spark, schema), schema, proposals).select("table", "column", "strategy", "kind", "action")


def policy_selection(spark, sf_dir):
    """Rules to encrypt among chosen columns, with the tweak they get."""
    schema = _schema(spark, sf_dir)
    only = schema.where(F.col("table").isin("orders", "lineitem", "part")).select("table", "column")
    chosen = P.with_strategy(P.select_columns(_policy(spark, schema), only), ENCRYPT)
    return chosen.select("table", "column", P.effective_tweak().alias("tweak"))


def policy_document(spark, sf_dir):
    """A policy written as a document and read again."""
    policy = _policy(spark, _schema(spark, sf_dir))
    path = f"{shared_folder(spark)}/policy-{TableStore.new_run()}"
    D.save_policy(policy, path, KEY.id())
    back = D.load_policy(spark, path)
    return back.select("table", "column", "strategy", "kind", F.nullif("tweak", F.lit("")).alias("tweak"))


# -- the registry --------------------------------------------------------------------------
# Log rows from ``orders``: a customer is a column, the order its version.
_LOG = """
select 'db' as database, 't' || cast(o_custkey % 4 as string) as "table", 'c' || cast(o_custkey as string) as "column",
       o_orderkey as version, case when o_orderstatus = 'F' then 'cifrata' when o_orderstatus = 'P' then 'in_corso'
       when o_orderkey % 5 = 0 then 'azzerata' else 'in_chiaro' end as state,
       'PIVA' as kind, 'k' as tweak, case when o_custkey % 3 = 0 then 'other' else 'mine' end as key_id,
       case when o_orderkey % 2 = 0 then 'cifra' else 'decifra' end as operation,
       case when o_custkey % 8 = 1 then 'list-a' end as list, o_orderkey * 2 as "rows",
       case when o_orderkey % 3 = 0 then cast(o_orderkey as string) end as last_key from orders"""
_LOG_DUCK = _LOG.replace("as string", "as varchar")
_LATEST = (f"with l as ({_LOG_DUCK}), cur as (select * from l qualify row_number() over "
           "(partition by \"table\", \"column\" order by version desc) = 1)")


def _log(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    rows = spark.sql(_LOG.replace('"', "`"))
    return rows.withColumns({"run": F.lit("r"), "updated": F.lit("2024-01-01 00:00:00").cast("timestamp")}).select(
        "database", "table", "column", "version", "state", "kind", "tweak", "key_id", "operation", "list", "rows",
        "last_key", "run", "updated")


def _rules(spark, sf_dir):
    """Columns that were logged and some that never were."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.lit("db").alias("database"), F.concat(F.lit("t"), k % 4).alias("table"), F.concat(F.lit("c"), k).alias("column"),
        F.when(k % 5 == 4, NULLIFY).otherwise(ENCRYPT).alias("strategy"), F.lit("PIVA").alias("kind"), F.lit("k").alias("tweak"),
        F.when(k % 16 == 1, "list-b").when(k % 8 == 1, "list-a").alias("list"))


_RULES_SQL = ("r as (select 't' || cast(c_custkey % 4 as varchar) as \"table\", 'c' || cast(c_custkey as varchar) as \"column\", "
              "case when c_custkey % 5 = 4 then 'azzera' else 'cifra' end as strategy, case when c_custkey % 16 = 1 then 'list-b' "
              "when c_custkey % 8 = 1 then 'list-a' end as mine from customer)")
_AT = "\"table\" || '.' || \"column\" as place"


def registry_current(spark, sf_dir):
    return R.listing(_log(spark, sf_dir), "db").select("table", "column", "version", "state", "key_id", "rows")


def registry_state(spark, sf_dir):
    return R.state_of(_log(spark, sf_dir), _rules(spark, sf_dir)).select("table", "column", "state")


def registry_history(spark, sf_dir):
    return R.history(_log(spark, sf_dir)).select("table", "column", "age", "state", "rows")


def registry_interrupted(spark, sf_dir):
    return R.interrupted(_log(spark, sf_dir), "db").select("table", "column", "version")


def registry_resumable(spark, sf_dir):
    return R.resumable(_log(spark, sf_dir), _rules(spark, sf_dir), "db").select("table", "column", "last_key")


def registry_start(spark, sf_dir):
    new = _rules(spark, sf_dir).select("database", "table", "column", "kind", "tweak", F.lit(KEY.id()).alias("key_id"),
                                       F.lit(ENCRYPT).alias("operation"), "list", F.lit("r2").alias("run"))
    return R.start(_log(spark, sf_dir), new).select("table", "column", "version", "state", "list")


def registry_conclude(spark, sf_dir):
    log = _log(spark, sf_dir)
    ended = R.interrupted(log, "db").select("database", "table", "column", F.lit(ENCRYPTED).alias("state"),
                                            (F.col("rows") + 1).alias("rows"))
    return R.conclude(log, ended).select("table", "column", "version", "state", "rows", "key_id", "tweak", "list")


def registry_resolve(spark, sf_dir):
    """The first interrupted column closed by declaration."""
    log = _log(spark, sf_dir)
    one = R.interrupted(log, "db").orderBy("table", "column").first()
    return R.resolve(log, "db", one["table"], one["column"], CLEAR).select("table", "column", "version", "state", "rows")


def registry_realign(spark, sf_dir):
    return R.realign(_log(spark, sf_dir), "db").select("table", "column", "version", "state", "rows")


def guard_encrypt(spark, sf_dir):
    return R.guard_encrypt(_rules(spark, sf_dir), _log(spark, sf_dir), "db").select("level", "place", "rule")


def guard_decrypt(spark, sf_dir):
    return R.guard_decrypt(_rules(spark, sf_dir), _log(spark, sf_dir), "db", "mine").select("level", "place", "rule")


def nullify_notices(spark, sf_dir):
    rules, log = _rules(spark, sf_dir), _log(spark, sf_dir)
    there = R.nullify_notices(rules, log, "db", True).select("level", "place", "rule", F.lit("there").alias("way"))
    return there.unionByName(R.nullify_notices(rules, log, "db", False).select("level", "place", "rule", F.lit("back").alias("way")))


def registry_status(spark, sf_dir):
    """Percent done and seconds left of running columns; progress derived from orders."""
    log = _log(spark, sf_dir)
    progress = log.select("table", "column", (F.col("version") % 90).alias("done"), F.lit(100).cast("bigint").alias("total"),
                          ((F.col("version") % 90) / 2.0).alias("seconds"))
    # one column has one pace, so ties of the furthest row say the same
    return R.status(log, progress, "db").select("table", "column", "state", "percent", "seconds_left")


# -- runs ---------------------------------------------------------------------------------------
def _store(spark, sf_dir):
    """A store over people with codes, some of them damaged."""
    rows = people(spark, sf_dir).select(
        "c_custkey", F.when(F.col("c_custkey") % 25 == 0, "?").otherwise(F.col("piva")).alias("piva"), "cf",
        F.when(F.col("c_custkey") % 4 > 0, F.col("nome")).alias("nome"))
    store = TableStore(spark, f"{shared_folder(spark)}/store-{TableStore.new_run()}")
    path = store.root + "/given"
    rows.write.parquet(path)
    store.register("people", path)
    policy = spark.createDataFrame([("people", "c_custkey", "mantieni", None, None), ("people", "piva", ENCRYPT, "PIVA", None),
                                    ("people", "cf", ENCRYPT, "CF", None), ("people", "nome", NULLIFY, None, None)],
                                   D.POLICY_ROWS)
    return store, policy


def run_report(spark, sf_dir):
    """Encrypt by policy, damaged values left and reported, a column emptied."""
    store, policy = _store(spark, sf_dir)
    report = Runner(store, policy, KEY, "db", Constraints(primary_keys={"people": ["c_custkey"]})).run(on_bad="skip")
    states = R.listing(store.registry(), "db").select("table", "column", "state")
    return report.columns.join(states, ["table", "column"]).select("operation", "table", "column", "kind", "rows_updated",
                                                                   "n_untreatable", "state")


def run_there_and_back(spark, sf_dir):
    """What decryption brings back of what encryption changed."""
    store, policy = _store(spark, sf_dir)
    runner = Runner(store, policy, KEY, "db")
    runner.run(on_bad="skip")
    changed = store.read("people").select("c_custkey", F.col("piva").alias("there"), F.col("nome").alias("gone"))
    runner.run("decifra", on_bad="skip", only=spark.createDataFrame([("people", "piva"), ("people", "cf")],
                                                                     "table string, column string"))
    return store.read("people").join(changed, "c_custkey").select(
        "c_custkey", "piva", "cf", "gone", (F.col("there") != F.col("piva")).alias("changed"))


def run_untreatable(spark, sf_dir):
    store, policy = _store(spark, sf_dir)
    return Runner(store, policy, KEY, "db").run(on_bad="skip").untreatable


def range_resume(spark, sf_dir):
    """A run by ranges that is broken off and resumed, against one that is not."""
    store, policy = _store(spark, sf_dir)
    keys = Constraints(primary_keys={"people": ["c_custkey"]})
    rows = table(spark, sf_dir, "customer").count() // 100 + 1           # about a hundred ranges
    whole, other = Runner(store, policy, KEY, "db", keys), _store(spark, sf_dir)[0]
    whole.run(on_bad="skip")

    class Stop(Exception):
        pass

    def stop(number):
        if number == 1:
            raise Stop

    parts = Runner(other, policy, KEY, "db", keys, rows_per_range=rows)
    try:
        parts.run(on_bad="skip", on_range=stop)
    except Stop:
        parts.resume(ENCRYPT, "people", on_bad="skip")
    one, two = store.read("people"), other.read("people")
    differ = one.exceptAll(two).agg(F.count(F.lit(1)).alias("n_differ"))
    return two.agg(F.count(F.lit(1)).alias("n_rows"), F.count("nome").alias("n_names")).join(differ)


def run_leftovers(spark, sf_dir):
    """Staged files of a run that never was committed, counted, dropped on request."""
    store, _ = _store(spark, sf_dir)
    run = store.new_run()
    store.write("people", run, store.read("people").where(F.col("c_custkey") % 2 == 0))
    found, n = store.leftovers().count(), store.count_leftover("people", run)
    store.drop_leftover("people", run, confirm=True)
    return table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(found).alias("n_found"), F.lit(n).alias("n_left_rows"), F.lit(store.leftovers().count()).alias("n_after"))


QUERIES = {f.__name__: f for f in (
    policy_problems, policy_align, policy_selection, policy_document, registry_current, registry_state, registry_history,
    registry_interrupted, registry_resumable, registry_start, registry_conclude, registry_resolve, registry_realign,
    guard_encrypt, guard_decrypt, nullify_notices, registry_status, run_report, run_there_and_back, run_untreatable,
    range_resume, run_leftovers)}

_P = (f"with s as ({_SQL_SCHEMA}), p as ({_RULES_DUCK}), j as (select p.*, s.ty from p join s using (t, c)), "
      "must as (select * from (values " + ", ".join(f"('{t}', '{c}')" for t, cs in _REQUIRED.not_null.items() for c in cs)
      + ") v(t, c)), fk as (select * from (values " + ", ".join(repr(tuple(k)) for k in _REQUIRED.foreign_keys)
      + ") v(t1, c1, t2, c2))")
_TWEAK = "coalesce(nullif({a}.tweak, ''), lower({a}.c))"
_VALID = "('CF', 'COGNOME', 'IBAN', 'NOME', 'PIVA')"
_SIDES = ("(select fk.*, a.strategy as sa, b.strategy as sb, a.kind as ka, b.kind as kb, "
          f"{_TWEAK.format(a='a')} as ta, {_TWEAK.format(a='b')} as tb from fk join p a on a.t = t1 and a.c = c1 "
          "join p b on b.t = t2 and b.c = c2 where a.strategy = 'cifra' or b.strategy = 'cifra')")
_FK_PLACE = "t1 || '.' || c1 || ' -> ' || t2 || '.' || c2"
_E = "'errore' as level"
_STATE_SQL = f"{_LATEST}, {_RULES_SQL}, g as (select r.*, cur.state, cur.key_id, cur.list from r left join cur using (\"table\", \"column\"))"
_PIVA = vat_sql("c_custkey")
_CF = f"({tax_body_sql('c_custkey')} || {tax_letter_sql(tax_body_sql('c_custkey'))})"

ORACLES = {
    "policy_problems": _P + " " + " union all ".join([
        f"select distinct {_E}, t as place, 'unknown_table' as rule from p where t not in (select t from s)",
        f"select {_E}, t || '.' || c, 'undeclared_column' from s where t in (select t from p) and (t, c) not in (select t, c from p)",
        f"select {_E}, t || '.' || c, 'missing_column' from p where t in (select t from s) and (t, c) not in (select t, c from s)",
        f"select {_E}, t || '.' || c, 'unknown_strategy' from j where strategy = 'distruggi'",
        f"select {_E}, t || '.' || c, 'no_valid_type' from j where strategy = 'cifra' and kind not in {_VALID}",
        f"select {_E}, t || '.' || c, 'nullify_required' from j where strategy = 'azzera' and (t, c) in (select t, c from must)",
        f"select {_E}, {_FK_PLACE}, 'fk_strategy' from {_SIDES} where sa <> sb",
        f"select {_E}, {_FK_PLACE}, 'fk_type' from {_SIDES} where sa = sb and ka is distinct from kb",
        f"select {_E}, {_FK_PLACE}, 'fk_tweak' from {_SIDES} where sa = sb and ta <> tb",
        "select 'avviso', w, 'ambiguous_tweak' from (select coalesce(nullif(tweak, ''), lower(c)) as w, case when kind in "
        f"{_VALID} then kind else '(none)' end as k from p where strategy = 'cifra') group by w having count(distinct k) > 1",
        f"select {_E}, t || '.' || c, 'numeric_column' from j where strategy = 'cifra' and ty <> 'string'"]),
    "policy_align": _P + " select t as \"table\", c as \"column\", strategy, kind, case when t not in (select t from s) then 'outside' "
                    "when (t, c) not in (select t, c from s) then 'dropped' else 'kept' end as action from p union all "
                    "select t, c, case when ty = 'string' and length(c) % 2 = 1 then 'cifra' else 'mantieni' end, case when "
                    "ty = 'string' and length(c) % 2 = 1 then 'PIVA' end, 'added' from s where (t, c) not in (select t, c from p)",
    "policy_selection": _P + f" select t as \"table\", c as \"column\", {_TWEAK.format(a='j')} as tweak from j "
                        "where strategy = 'cifra' and t in ('orders', 'lineitem', 'part')",
    "policy_document": _P + " select t as \"table\", c as \"column\", strategy, kind, nullif(tweak, '') as tweak from p",
    "registry_current": _LATEST + " select \"table\", \"column\", version, state, key_id, \"rows\" from cur",
    "registry_state": f"{_LATEST}, {_RULES_SQL} select \"table\", \"column\", coalesce(state, 'in_chiaro') as state "
                      "from r left join cur using (\"table\", \"column\")",
    "registry_history": f"with l as ({_LOG_DUCK}), n as (select *, row_number() over (partition by \"table\", \"column\" "
                        "order by version desc) - 1 as age from l) select \"table\", \"column\", age, state, \"rows\" from n "
                        "where age between 1 and 20",
    "registry_interrupted": _LATEST + " select \"table\", \"column\", version from cur where state = 'in_corso'",
    "registry_resumable": f"{_LATEST}, {_RULES_SQL} select \"table\", \"column\", last_key from cur where state = 'in_corso' and last_key "
                          "is not null and operation = 'cifra' and (\"table\", \"column\") in (select \"table\", \"column\" from r "
                          "where strategy = 'cifra')",
    "registry_start": f"{_LATEST}, {_RULES_SQL} select \"table\", \"column\", coalesce(version, 0) + 1 as version, 'in_corso' as state, "
                      "mine as list from r left join cur using (\"table\", \"column\")",
    "registry_conclude": _LATEST + " select \"table\", \"column\", version + 1 as version, 'cifrata' as state, \"rows\" + 1 as \"rows\", "
                         "key_id, tweak, list from cur where state = 'in_corso'",
    "registry_resolve": _LATEST + " select \"table\", \"column\", version + 1 as version, 'in_chiaro' as state, \"rows\" from cur "
                        "where state = 'in_corso' order by \"table\", \"column\" limit 1",
    "registry_realign": _LATEST + " select \"table\", \"column\", version + 1 as version, 'in_chiaro' as state, cast(null as bigint) "
                        "as \"rows\" from cur where state in ('cifrata', 'azzerata')",
    "guard_encrypt": f"{_STATE_SQL} select {_E}, {_AT}, case state when 'cifrata' then 'already_encrypted' else 'in_progress' end as rule "
                     "from g where state in ('cifrata', 'in_corso')",
    "guard_decrypt": f"{_STATE_SQL}, w as (select *, case when coalesce(state, 'in_chiaro') = 'in_chiaro' then 'not_encrypted' "
                     "when state = 'azzerata' then 'nullified' when state = 'in_corso' then 'in_progress' when key_id <> 'mine' "
                     "then 'wrong_key' when list is not null and list is distinct from mine then 'wrong_list' end as rule from g) "
                     f"select {_E}, {_AT}, rule from w where rule is not null",
    "nullify_notices": f"{_STATE_SQL}, z as (select *, coalesce(state, 'in_chiaro') as st from g where strategy = 'azzera') "
                       f"select {_E}, {_AT}, 'in_progress' as rule, 'there' as way from z where st = 'in_corso' union all "
                       f"select 'avviso', {_AT}, 'will_be_nullified', 'there' from z where st not in ('in_corso', 'azzerata') union all "
                       f"select 'errore', {_AT}, 'in_progress', 'back' from z where st = 'in_corso' union all "
                       f"select 'avviso', {_AT}, 'stays_nullified', 'back' from z where st = 'azzerata'",
    "registry_status": _LATEST + ", far as (select \"table\", \"column\", max(version % 90) as done from l group by 1, 2) "
                       "select \"table\", \"column\", state, case when state = 'in_corso' then done end as percent, "
                       "case when state = 'in_corso' and done > 0 then (100 - done) / 2.0 end as seconds_left "
                       "from cur join far using (\"table\", \"column\")",
    "run_report": "select 'cifra' as operation, 'people' as \"table\", 'piva' as \"column\", 'PIVA' as kind, count(*) filter (where "
                  "c_custkey % 25 <> 0) as rows_updated, count(*) filter (where c_custkey % 25 = 0) as n_untreatable, 'cifrata' as state "
                  "from customer union all select 'cifra', 'people', 'cf', 'CF', count(*), 0, 'cifrata' from customer union all "
                  "select 'azzera', 'people', 'nome', null, count(*) filter (where c_custkey % 4 > 0), 0, 'azzerata' from customer",
    "run_there_and_back": f"select c_custkey, case when c_custkey % 25 = 0 then '?' else {_PIVA} end as piva, {_CF} as cf, "
                          "cast(null as varchar) as gone, c_custkey % 25 <> 0 as changed from customer",
    "run_untreatable": "select 'people' as \"table\", 'piva' as \"column\", '?' as value, 'not_11_digits' as error from customer "
                       "where c_custkey % 25 = 0 limit 1",
    "range_resume": "select count(*) as n_rows, 0 as n_names, 0 as n_differ from customer",
    "run_leftovers": "select count(*) as n_rows, 1 as n_found, count(*) filter (where c_custkey % 2 = 0) as n_left_rows, "
                     "0 as n_after from customer",
}
