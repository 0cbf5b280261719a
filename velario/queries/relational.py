"""Queries of the relational operators: counts, samples, maps, ranges, sources, detection."""

from pyspark.sql import functions as F

from velario.operators import detect as D
from velario.operators import keys as K
from velario.operators import mapping as M
from velario.operators import preview as V
from velario.operators import profile as P
from velario.operators.pseudonymise import Rule, context, decrypt, encrypt
from velario.operators.ranges import next_bound, range_bounds
from velario.queries.derived import (KEY, TABLES, name_sql, people, table, tax_body_sql, tax_letter_sql, vat,
                                     vat_sql)
from velario.sources import tables as T
from velario.session import saved
from velario.sources.wordlists import ListTable, default_lists, default_names, default_surnames

# -- sources --------------------------------------------------------------------
_CONSTRAINTS = T.Constraints(
    primary_keys={"customer": ["c_custkey"], "orders": ["o_orderkey"], "nation": ["n_nationkey"],
                  "lineitem": ["l_orderkey", "l_linenumber"]},
    foreign_keys=[("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey"),
                  ("lineitem", "l_orderkey", "orders", "o_orderkey"), ("lineitem", "l_partkey", "part", "p_partkey")],
    not_null={"customer": ["c_name"]})
_DESCRIBED = ("customer", "lineitem", "nation", "orders")


def list_tables(spark, sf_dir):
    """Tables of a catalog database, each with its rows."""
    spark.sql("CREATE DATABASE IF NOT EXISTS velario_listing")
    for t in TABLES:
        spark.sql(f"DROP TABLE IF EXISTS velario_listing.{t}")
        spark.sql(f"CREATE TABLE velario_listing.{t} USING parquet LOCATION '{sf_dir}/{t}.parquet'")
    counts = None
    for t in TABLES:
        one = P.profile(T.read_table(spark, f"velario_listing.{t}")).select(
            F.lit(f"velario_listing.{t}").alias("table"), "n_rows")
        counts = one if counts is None else counts.unionByName(one)
    return T.list_tables(spark, "velario_listing").join(counts, "table", "left")


def describe_tables(spark, sf_dir):
    """Columns with type and whether they may be null, and the rows that are."""
    frames = {t: T.read_table(spark, f"{sf_dir}/{t}.parquet", "parquet") for t in _DESCRIBED}
    columns = T.describe(frames, _CONSTRAINTS)
    counted = T.profile_tables(frames)
    return columns.join(counted, ["table", "column"]).select("table", "column", "type", "nullable",
                                                             (F.col("n_rows") - F.col("n_values")).alias("n_null"))


def foreign_keys(spark, sf_dir):
    """Declared foreign keys between described tables, and child rows without a parent."""
    frames = {t: table(spark, sf_dir, t) for t in _DESCRIBED}
    kept = T.selected_foreign_keys(_CONSTRAINTS.foreign_key_rows(spark), T.describe(frames, _CONSTRAINTS))
    orphans = None
    for t1, c1, t2, c2 in _CONSTRAINTS.foreign_keys:
        if t1 in frames and t2 in frames:
            child, parent = frames[t1].select(F.col(c1).alias("k")), frames[t2].select(F.col(c2).alias("k"))
            one = child.join(parent, "k", "left_anti").agg(F.count(F.lit(1)).alias("n_orphans")).select(
                F.lit(t1).alias("t1"), F.lit(c1).alias("c1"), "n_orphans")
            orphans = one if orphans is None else orphans.unionByName(one)
    return kept.join(orphans, ["t1", "c1"])


def _columns_sql():
    kind = ("case data_type when 'BIGINT' then 'bigint' when 'VARCHAR' then 'string' when 'DOUBLE' then 'double' "
            "when 'INTEGER' then 'int' when 'TIMESTAMP' then 'timestamp_ntz' when 'DATE' then 'date' else lower(data_type) end")
    names = ", ".join(f"'{t}'" for t in _DESCRIBED)
    must = ", ".join(f"'{t}.{c}'" for d in (_CONSTRAINTS.primary_keys, _CONSTRAINTS.not_null) for t, cs in d.items() for c in cs)
    return (f"select table_name as \"table\", column_name as \"column\", {kind} as type, "
            f"table_name || '.' || column_name not in ({must}) as nullable, 0 as n_null "
            f"from information_schema.columns where table_name in ({names})")


# -- counts and samples -----------------------------------------------------------
_STAR = {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"],
         "customer": ["c_custkey", "c_name", "c_nationkey"], "supplier": ["s_suppkey", "s_name", "s_nationkey"],
         "part": ["p_partkey", "p_name"], "orders": ["o_orderkey", "o_custkey", "o_orderdate"],
         "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]}


def _star(spark, sf_dir):
    return K.discover({t: table(spark, sf_dir, t) for t in _STAR}, _STAR)


def discovered_keys(spark, sf_dir):
    """Unique columns of the star schema, found in the values."""
    return _star(spark, sf_dir)[0]


def discovered_foreign_keys(spark, sf_dir):
    """Columns whose values are all among those of a unique column."""
    return _star(spark, sf_dir)[1]


def _star_sql(held):
    columns = [(t, c) for t, cs in _STAR.items() for c in cs]
    one = " union all ".join(f"select '{t}' as \"table\", '{c}' as \"column\", count(*) as n_rows, count({c}) as n_values, "
                             f"count(distinct {c}) as n_distinct from {t}" for t, c in columns)
    if not held:
        return f"select *, n_distinct = n_rows as is_key from ({one})"
    kinds = {c: "s" if c.endswith("name") else "d" if c.endswith("date") else "n" for _, c in columns}
    pairs = " union all ".join(
        f"select '{t1}' as t1, '{c1}' as c1, '{t2}' as t2, '{c2}' as c2, (select count(*) from {t1} where {c1} is not null and "
        f"{c1} not in (select {c2} from {t2})) as n_lost" for t1, c1 in columns for t2, c2 in columns
        if (t1, c1) != (t2, c2) and kinds[c1] == kinds[c2])
    return (f"with k as (select * from ({one}) where n_distinct = n_rows) select t1, c1, t2, c2 from ({pairs}) join k "
            "on t2 = \"table\" and c2 = \"column\" where n_lost = 0")


def column_counts(spark, sf_dir):
    return P.profile(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey", "l_returnflag", "l_shipdate"])


def row_count(spark, sf_dir):
    return P.profile(table(spark, sf_dir, "events")).select("n_rows")


def first_rows(spark, sf_dir):
    return P.first_rows(table(spark, sf_dir, "orders"), ["o_orderkey", "no_such_column", "o_orderpriority"], 30, "o_orderkey")


def sample_values(spark, sf_dir):
    """How many values the sample has, and how many of them the column holds."""
    df = table(spark, sf_dir, "customer")
    some = P.sample_values(df, "c_name", 200)
    held = some.join(df.select("c_name"), "c_name", "left_semi")
    return some.agg(F.count("c_name").alias("n_sample")).select(
        "n_sample", held.agg(F.count(F.lit(1))).scalar().alias("n_held"))


def distinct_values(spark, sf_dir):
    return P.distinct_values(table(spark, sf_dir, "lineitem"), "l_partkey")


def distinct_after_key(spark, sf_dir):
    return P.distinct_values(table(spark, sf_dir, "orders"), "o_custkey", "o_orderkey", "9000")


def nullify_column(spark, sf_dir):
    """Rows to lose, and what the emptied table still holds."""
    df = table(spark, sf_dir, "customer")
    left = P.nullify(df, ["c_mktsegment"]).agg(F.count(F.lit(1)).alias("n_rows"), F.count("c_mktsegment").alias("n_left"),
                                               F.count("c_name").alias("n_names"))
    return P.values_to_lose(df, ["c_mktsegment"]).join(left)


# -- maps ---------------------------------------------------------------------------
def _coded(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", vat("o_custkey").alias("piva"))


def _plain_pairs(df):
    """A map that can be written in SQL: the number reversed, for all but some values."""
    return (df.groupBy(F.col("piva").alias("old")).agg(F.count(F.lit(1)).alias("n"))
            .where(F.substring("old", 10, 1) != "7").select("old", F.reverse("old").alias("new"), "n"))


def map_apply(spark, sf_dir):
    df = _coded(spark, sf_dir)
    return M.apply_map(df, "piva", _plain_pairs(df))


def map_apply_range(spark, sf_dir):
    df = _coded(spark, sf_dir)
    return M.apply_map(df, "piva", _plain_pairs(df), key="o_orderkey", after=1000, upto=5000)


def map_effect(spark, sf_dir):
    df = _coded(spark, sf_dir)
    return M.effect(df, "piva", _plain_pairs(df))


def map_equals_inline(spark, sf_dir):
    """The path over distinct values gives what the path over rows gives."""
    df = _coded(spark, sf_dir)
    ctx = context(spark, KEY)
    pairs = M.value_map(df, ctx, "piva", "PIVA", "piva")
    both = df.withColumn("clear", F.col("piva"))
    mapped = M.apply_map(both, "piva", pairs).select("o_orderkey", "clear", F.col("piva").alias("mapped"))
    inline = encrypt(df, KEY, [Rule("piva", "PIVA")]).select("o_orderkey", F.col("piva").alias("inline"))
    return mapped.join(inline, "o_orderkey").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("mapped") != F.col("inline")).alias("n_differ"),
        F.count_if(F.col("mapped") != F.col("clear")).alias("n_changed"),
        F.count_distinct("mapped").alias("n_values"))


# -- ranges -------------------------------------------------------------------------
def ranges(spark, sf_dir):
    return range_bounds(table(spark, sf_dir, "orders"), "o_orderkey", 700)


def text_ranges(spark, sf_dir):
    return range_bounds(table(spark, sf_dir, "customer"), "c_name", 100)


def following_bound(spark, sf_dir):
    return next_bound(table(spark, sf_dir, "orders"), "o_orderkey", "1234", 500)


# -- detection, previews -----------------------------------------------------------
def _mixed(spark, sf_dir):
    """Columns whose kinds are told by their values: nine tenths is the bar."""
    k = F.col("c_custkey")
    return people(spark, sf_dir).select(
        F.when(k % 13 == 0, "-").otherwise(F.col("cf")).alias("codes"),
        F.when(k % 2 == 0, F.col("piva")).otherwise("x").alias("half"),
        F.when(k < 2, F.col("piva")).alias("two"), "nome", "cognome", F.col("piva").alias("numbers"))


def detect_types(spark, sf_dir):
    return D.detect(_mixed(spark, sf_dir), default_lists())


def propose_types(spark, sf_dir):
    """Only undecided columns, and with review those kept in clear."""
    policy = spark.createDataFrame([("people", "numbers", "mantieni", None, None), ("people", "codes", "cifra", "CF", None)],
                                   "table string, column string, strategy string, kind string, tweak string")
    found = D.propose({"people": _mixed(spark, sf_dir)}, default_lists(), policy=policy, review=True)
    return D.flip_reviewed(policy, found).join(found.select("table", "column", "passing"), ["table", "column"], "left")


def list_membership(spark, sf_dir):
    lists = default_lists()
    return people(spark, sf_dir).select("c_custkey", D.in_list(F.lower("nome"), lists["nomi"]).alias("is_name"),
                                        D.in_list(F.col("cognome"), lists["cognomi"]).alias("is_surname"))


def preview_values(spark, sf_dir):
    rows = _mixed(spark, sf_dir)
    found = V.preview_values(rows, context(spark, KEY), [Rule("codes", "CF"), Rule("numbers", "PIVA")], ["half"])
    return found.select("operation", "column", "kind", "tweak", "n_rows", "n_distinct", "before", "error",
                        (F.col("after") != F.col("before")).alias("changes"))


def preview_rows(spark, sf_dir):
    rows = people(spark, sf_dir).select("c_custkey", "piva", "c_nationkey")
    some = V.preview_rows(rows, context(spark, KEY), [Rule("piva", "PIVA")], ["c_nationkey"], ["c_custkey"], 30, True)
    return some.select("c_custkey", "piva.before", "piva.error", F.col("c_nationkey.before").alias("lost"),
                       (F.col("piva.before") != F.col("piva.after")).alias("changes"))


def untreatable_values(spark, sf_dir):
    rows = people(spark, sf_dir).select(
        F.when(F.col("c_custkey") % 50 == 0, F.concat(F.col("piva"), F.lit("0"))).otherwise(F.col("piva")).alias("piva"),
        F.when(F.col("c_custkey") % 40 == 0, F.substring("cf", 1, 15)).otherwise(F.col("cf")).alias("cf"))
    return V.untreatable(rows, context(spark, KEY), [Rule("piva", "PIVA"), Rule("cf", "CF")])


def _spoken(spark, sf_dir):
    """Every distinct word of all texts, as a list of any size in alphabetical order."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "[^a-z]+")).alias("entry")).where(F.length("entry") > 3)
    return ListTable(words.distinct().select("entry", F.col("entry").alias("order")), "spoken")


def word_list(spark, sf_dir):
    """A list made of all words of the texts: size, longest entry, fingerprint."""
    made = _spoken(spark, sf_dir)
    held = made.frame().agg(F.count(F.lit(1)).alias("n"), F.max(F.length("entry")).alias("longest"), F.max("pos").alias("last"))
    return held.select("n", "longest", "last", F.lit(made.longest).alias("longest_known"), F.lit(made.fingerprint).alias("fingerprint"))


def long_list_roundtrip(spark, sf_dir):
    """Names on a list of all words of the texts, and some off it, there and back by joins."""
    lists = {"cognomi": _spoken(spark, sf_dir)}
    entry = F.col("entry")
    rows = lists["cognomi"].frame().select("pos", F.when(F.col("pos") % 7 == 0, F.concat(F.initcap(entry), F.lit("zolamira")))
                                           .when(F.col("pos") % 3 == 0, F.lower(entry)).otherwise(entry).alias("cognome"))
    rules = [Rule("cognome", "COGNOME")]
    there = encrypt(rows.withColumn("original", F.col("cognome")), KEY, rules, lists=lists)
    judged = saved(there, "long_list").select("pos", "cognome", (F.col("pos") % 7 == 0).alias("off_list"), F.when(
        F.col("pos") % 7 == 0, F.col("cognome") != F.col("original")).alias("changed"))
    back = decrypt(judged, KEY, rules, lists=lists)
    distinct = judged.agg(F.count_distinct("cognome").alias("n")).select("n").scalar()
    return back.withColumn("n_distinct", distinct)


def long_list_membership(spark, sf_dir):
    """Words of part names, told by a join with a list made of a whole column."""
    brands = table(spark, sf_dir, "part").select(F.explode(F.split("p_type", " ")).alias("entry"))
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("entry"))
    entries = names.unionByName(brands).distinct()
    made = ListTable(entries.select("entry", F.col("entry").alias("order")), "names")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit(" customer#"), F.lpad(
        (F.col("o_custkey") * 2).cast("string"), 9, "0")).alias("name"))
    return D.with_membership(rows, {"listed": F.col("name")}, made).select("o_orderkey", "listed")


_CF = f"({tax_body_sql('c_custkey')} || {tax_letter_sql(tax_body_sql('c_custkey'))})"
_V, _VO = vat_sql("c_custkey"), vat_sql("o_custkey")
_MIX = (f"(select c_custkey, case when c_custkey % 13 = 0 then '-' else {_CF} end as codes, case when c_custkey % 2 = 0 then "
        f"{_V} else 'x' end as half, {_V} as numbers, case when c_custkey < 2 then {_V} end as two, "
        f"{name_sql('c_custkey', default_names())} as nome, {name_sql('c_custkey', default_surnames())} as cognome from customer)")
_ONE = "select '{c}' as \"column\", {kind} as kind, {passing} as passing, {examined} as examined from m"

QUERIES = {f.__name__: f for f in (
    list_tables, describe_tables, foreign_keys, column_counts, row_count, first_rows, sample_values, distinct_values,
    distinct_after_key, nullify_column, map_apply, map_apply_range, map_effect, map_equals_inline, ranges, text_ranges,
    following_bound, detect_types, propose_types, list_membership, preview_values, preview_rows, untreatable_values,
    word_list, long_list_roundtrip, long_list_membership,
    discovered_keys, discovered_foreign_keys)}


def _profile_sql(source, columns):
    return " union all ".join(f"select '{c}' as \"column\", count(*) as n_rows, count({c}) as n_values, "
                              f"count(distinct {c}) as n_distinct from {source}" for c in columns)


_NOT_7 = f"substr({_VO}, 10, 1) <> '7'"
_ORDERED8 = ("select '{op}' as operation, '{c}' as \"column\", {kind} as kind, {tweak} as tweak, (select count(*) from m) as n_rows, "
             "(select count(distinct {c}) from m) as n_distinct, {c} as before, {error} as error, {changes} as changes "
             "from (select distinct {c} from m where {c} is not null order by {c} limit 8)")


# the distinct words of all texts, upper-cased, with their place in order
_SPOKEN = ("select upper(w) as entry, row_number() over (order by w) - 1 as pos from (select distinct unnest(regexp_extract_all("
           "text, '[a-z]+')) as w from documents) where len(w) > 3")


def _in(words):
    return ", ".join(f"'{e}'" for e in words.entries)


_NAME, _SURNAME = name_sql("c_custkey", default_names()), name_sql("c_custkey", default_surnames())

ORACLES = {
    "list_tables": " union all ".join(f"select 'velario_listing.{t}' as \"table\", count(*) as n_rows from {t}" for t in TABLES),
    "describe_tables": _columns_sql(),
    "foreign_keys": " union all ".join(
        f"select '{t1}' as t1, '{c1}' as c1, '{t2}' as t2, '{c2}' as c2, count(*) filter (where {c1} not in "
        f"(select {c2} from {t2})) as n_orphans from {t1}" for t1, c1, t2, c2 in _CONSTRAINTS.foreign_keys if t2 != "part"),
    "column_counts": _profile_sql("lineitem", ["l_orderkey", "l_partkey", "l_returnflag", "l_shipdate"]),
    "row_count": "select count(*) as n_rows from events",
    "first_rows": "select o_orderkey, o_orderpriority from orders order by o_orderkey limit 30",
    "sample_values": "select least(200, count(c_name)) as n_sample, least(200, count(c_name)) as n_held from customer",
    "distinct_values": "select distinct l_partkey from lineitem where l_partkey is not null",
    "distinct_after_key": "select distinct o_custkey from orders where o_custkey is not null and o_orderkey > 9000",
    "nullify_column": "select 'c_mktsegment' as \"column\", count(c_mktsegment) as rows_touched, count(*) as n_rows, "
                      "0 as n_left, count(c_name) as n_names from customer",
    "map_apply": f"select o_orderkey, case when {_NOT_7} then reverse({_VO}) else {_VO} end as piva from orders",
    "map_apply_range": f"select o_orderkey, case when {_NOT_7} and o_orderkey > 1000 and o_orderkey <= 5000 "
                       f"then reverse({_VO}) else {_VO} end as piva from orders",
    "map_effect": f"select count(distinct {_VO}) as n_map, count(*) as n_matched, count(*) filter (where reverse({_VO}) <> {_VO}) "
                  f"as n_effective from orders where {_NOT_7}",
    "map_equals_inline": "select count(*) as n_rows, 0 as n_differ, count(*) as n_changed, count(distinct o_custkey) as n_values from orders",
    "ranges": "select (n - 1) // 700 as range, max(o_orderkey) as upto, count(*) as n_rows from (select o_orderkey, row_number() "
              "over (order by o_orderkey) as n from orders) group by 1",
    "text_ranges": "select (n - 1) // 100 as range, max(c_name) as upto, count(*) as n_rows from (select c_name, row_number() "
                   "over (order by c_name) as n from customer) group by 1",
    "following_bound": "select max(o_orderkey) as upto from (select o_orderkey from orders where o_orderkey > 1234 "
                       "order by o_orderkey limit 500)",
    "detect_types": f"with m as (select * from {_MIX}) " + " union all ".join([
        _ONE.format(c="codes", kind="'CF'", passing="count(*) filter (where codes <> '-')", examined="count(codes)"),
        _ONE.format(c="half", kind="cast(null as varchar)", passing="count(*) filter (where half <> 'x')", examined="count(half)"),
        _ONE.format(c="two", kind="cast(null as varchar)", passing="0", examined="count(two)"),
        _ONE.format(c="nome", kind="cast(null as varchar)", passing=f"count(*) filter (where upper(nome) in ({_in(default_names())}))",
                    examined="count(nome)"),
        _ONE.format(c="cognome", kind="cast(null as varchar)",
                    passing=f"count(*) filter (where upper(cognome) in ({_in(default_surnames())}))", examined="count(cognome)"),
        _ONE.format(c="numbers", kind="'PIVA'", passing="count(numbers)", examined="count(numbers)")]),
    "propose_types": "select 'people' as \"table\", 'numbers' as \"column\", 'cifra' as strategy, 'PIVA' as kind, "
                     "cast(null as varchar) as tweak, count(*) as passing from customer union all "
                     "select 'people', 'codes', 'cifra', 'CF', null, null from (select count(*) from customer)",
    "list_membership": f"select c_custkey, upper({_NAME}) in ({_in(default_names())}) as is_name, "
                       f"upper({_SURNAME}) in ({_in(default_surnames())}) as is_surname from customer",
    "preview_values": f"with m as (select * from {_MIX}) " + " union all ".join("(" + q + ")" for q in [
        _ORDERED8.format(op="cifra", c="codes", kind="'CF'", tweak="'codes'", changes="case when codes <> '-' then true end",
                         error="case when codes = '-' then 'bad_length_or_alphabet' end"),
        _ORDERED8.format(op="cifra", c="numbers", kind="'PIVA'", tweak="'numbers'", error="cast(null as varchar)", changes="true"),
        _ORDERED8.format(op="azzera", c="half", kind="null", tweak="null", error="null", changes="null")]),
    "preview_rows": f"select c_custkey, {_V} as before, cast(null as varchar) as error, cast(c_nationkey as varchar) as lost, "
                    f"true as changes from customer order by c_custkey limit 30",
    "untreatable_values": f"select 'piva' as \"column\", {_V} || '0' as value, 'not_11_digits' as error from customer "
                          f"where c_custkey % 50 = 0 union select 'cf', substr({_CF}, 1, 15), 'bad_length_or_alphabet' "
                          f"from customer where c_custkey % 40 = 0",
    "discovered_keys": _star_sql(False),
    "discovered_foreign_keys": _star_sql(True),
    "word_list": f"with e as ({_SPOKEN}), b as (select pos // 65536 as k, sha256(string_agg(entry, chr(10) order by pos)) as d "
                 "from e group by 1) select count(*) as n, max(len(entry)) as longest, max(pos) as last, max(len(entry)) as "
                 "longest_known, (select substr(case when count(*) = 1 then max(d) else sha256(string_agg(d, chr(10) order by k)) end, "
                 "1, 16) from b) as fingerprint from e",
    "long_list_roundtrip": f"with e as ({_SPOKEN}) select pos, case when pos % 7 = 0 then substr(entry, 1, 1) || lower(substr(entry, 2)) "
                           "|| 'zolamira' when pos % 3 = 0 then lower(entry) else entry end as cognome, pos % 7 = 0 as off_list, "
                           "case when pos % 7 = 0 then true end as changed, (select count(*) from e) as n_distinct from e",
    "long_list_membership": "select o_orderkey, 'Customer#' || lpad(cast(o_custkey * 2 as varchar), 9, '0') in "
                            "(select c_name from customer) as listed from orders",
}
