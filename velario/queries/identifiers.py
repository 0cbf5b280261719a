"""Queries of the identifier jobs: surrogates change every value, stay valid and come back."""

from pyspark.sql import functions as F

from velario.functions import checksums as C
from velario.functions.cards import add_cards
from velario.functions.identifiers import forget
from velario.operators.alphabet import decrypt_text, encrypt_text
from velario.operators.pseudonymise import Rule, decrypt, encrypt
from velario.queries.derived import (KEY, accounts, iban_sql, name_sql, people, table, tax_body_sql, tax_letter_sql,
                                     vat, vat_check_sql, vat_sql)
from velario.sources.wordlists import default_names, default_surnames


def _round_trip(df, key, column, kind, valid):
    """Encrypt, judge, decrypt in one plan: the original comes back, and nothing stayed as it was."""
    rules = [Rule(column, kind)]
    there = encrypt(df.select(key, F.col(column).alias("original"), column), KEY, rules)
    judged = there.select(key, "original", column, (F.col(column) != F.col("original")).alias("changed"),
                          valid(F.col(column)).alias("valid"))
    return decrypt(judged, KEY, rules).select(key, F.col(column).alias("value"), "changed", "valid")


def _expected(key, source, value):
    return f"select {key}, {value} as value, true as changed, true as valid from {source}"


def vat_roundtrip(spark, sf_dir):
    return _round_trip(people(spark, sf_dir), "c_custkey", "piva", "PIVA", C.piva_ok)


def tax_code_roundtrip(spark, sf_dir):
    return _round_trip(people(spark, sf_dir), "c_custkey", "cf", "CF", C.cf_ok)


def iban_roundtrip(spark, sf_dir):
    return _round_trip(accounts(spark, sf_dir), "s_suppkey", "iban", "IBAN", C.iban_ok)


def iban_valid_after_encrypt(spark, sf_dir):
    """The predicate on a surrogate in the same plan."""
    there = encrypt(accounts(spark, sf_dir), KEY, [Rule("iban", "IBAN")])
    return there.where(C.iban_ok("iban")).agg(F.count(F.lit(1)).alias("n_valid"))


def _letters_kept(v):
    return v.rlike("^[A-Za-z' ]+$")


def _name_round_trip(spark, sf_dir, column, kind):
    """A name may be its own surrogate, for its list is short; nearly all must differ."""
    rows = people(spark, sf_dir)
    back = _round_trip(rows, "c_custkey", column, kind, _letters_kept)
    there = encrypt(rows.select(F.col(column).alias("original"), column), KEY, [Rule(column, kind)])
    mostly = there.agg((F.count_if(F.col(column) != F.col("original")) >= 0.9 * F.count(F.lit(1))).alias("x"))
    return back.select("c_custkey", "value", "valid", mostly.scalar().alias("mostly_changed"))


def name_roundtrip(spark, sf_dir):
    return _name_round_trip(spark, sf_dir, "nome", "NOME")


def surname_roundtrip(spark, sf_dir):
    return _name_round_trip(spark, sf_dir, "cognome", "COGNOME")


def off_list_roundtrip(spark, sf_dir):
    """Names that no list holds, made from the words of part names: same shape, changed, and back."""
    word = F.split("p_name", " ")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.initcap(F.concat(word[0], word[1], F.substring("p_brand", 1, 3))).alias("cognome"))
    return _round_trip(rows, "p_partkey", "cognome", "COGNOME", lambda v: v.rlike("^[A-Z][a-z]+$"))


def all_rules_roundtrip(spark, sf_dir):
    """Several columns at once, in both directions, without a write in between."""
    rules = [Rule("cf", "CF"), Rule("piva", "PIVA"), Rule("nome", "NOME"), Rule("cognome", "COGNOME")]
    rows = people(spark, sf_dir).drop("c_nationkey")
    there = encrypt(rows.withColumns({"cf0": F.col("cf"), "piva0": F.col("piva")}), KEY, rules)
    there = there.withColumn("changed", (F.col("cf") != F.col("cf0")) & (F.col("piva") != F.col("piva0"))).drop("cf0", "piva0")
    return decrypt(there, KEY, rules)


def vat_native_roundtrip(spark, sf_dir):
    """Every line's VAT number without Python workers: as the Arrow function has it, and back."""
    rules = [Rule("piva", "PIVA")]
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", vat("l_orderkey").alias("piva"))
    there = encrypt(rows.withColumns({"original": F.col("piva"), "arrow": F.col("piva")}), KEY, rules, native=True)
    there = encrypt(there, KEY, [Rule("arrow", "PIVA", "piva")])
    judged = there.select("l_orderkey", "l_linenumber", "piva", (F.col("piva") == F.col("arrow")).alias("as_arrow"),
                          (F.col("piva") != F.col("original")).alias("changed"))
    return decrypt(judged, KEY, rules, native=True)


def distinct_preserved(spark, sf_dir):
    """Rows, distinct originals, distinct surrogates and unchanged values of each column."""
    rows = people(spark, sf_dir)
    rules = [Rule("cf", "CF"), Rule("piva", "PIVA")]
    wide = encrypt(rows.withColumns({"cf0": F.col("cf"), "piva0": F.col("piva")}), KEY, rules)
    counts = wide.agg(F.count(F.lit(1)).alias("n_rows"),
                      *[F.count_distinct(c).alias(f"d_{c}") for c in ("cf0", "cf", "piva0", "piva")],
                      *[F.count_if(F.col(c) == F.col(f"{c}0")).alias(f"same_{c}") for c in ("cf", "piva")])
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), "n_rows", F.col(f"d_{c}0").alias("d_before"),
                 F.col(f"d_{c}").alias("d_after"), F.col(f"same_{c}").alias("n_unchanged")) for c in ("cf", "piva")])))


def vat_join_revenue(spark, sf_dir):
    """Revenue by nation over a join on surrogates of both sides."""
    rules = [Rule("piva", "PIVA")]
    customers = encrypt(people(spark, sf_dir).select("c_custkey", "c_nationkey", "piva"), KEY, rules)
    orders = encrypt(table(spark, sf_dir, "orders").select("o_totalprice", vat("o_custkey").alias("piva")), KEY, rules)
    joined = customers.join(orders, "piva")
    return joined.groupBy("c_nationkey").agg(
        F.round(F.sum("o_totalprice"), 2).alias("revenue"), F.count(F.lit(1)).alias("n_orders"),
        F.count_if(F.col("piva") == vat("c_custkey")).alias("n_unchanged"),
        F.count_if(~C.piva_ok("piva")).alias("n_invalid"))


def alphabet_roundtrip(spark, sf_dir):
    """FF1 over an alphabet of one's own (lower-case letters, digits and space), foreign characters refused."""
    alphabet = "abcdefghijklmnopqrstuvwxyz0123456789 #"
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lower("p_name").alias("p_name"))
    rows = rows.withColumn("p_name", F.when(F.col("p_partkey") % 10 == 0, F.concat("p_name", F.lit("!")))
                           .when(F.col("p_partkey") % 11 == 0, "a").otherwise(F.col("p_name")))
    there = encrypt_text(rows, KEY, "p_name", alphabet, b"name", "surrogate", "error")
    back = decrypt_text(there, KEY, "surrogate", alphabet, b"name", "restored", "error_back")
    return back.select("p_partkey", "restored", "error", (F.col("surrogate") != F.col("p_name")).alias("changed"))


def checksum_flags(spark, sf_dir):
    """All predicates and check characters over clean and damaged codes."""
    rows = people(spark, sf_dir).select("c_custkey", "cf", "piva")
    spoiled = F.col("c_custkey") % 3 == 0
    wrong = F.when(spoiled, F.concat(F.substring("cf", 1, 15), F.lit("0"))).otherwise(F.lower("cf"))
    number = F.when(spoiled, F.concat(F.lit("9"), F.substring("piva", 2, 10))).otherwise(
        F.concat(F.substring("piva", 1, 5), F.lit(" "), F.substring("piva", 6, 6)))
    return rows.select("c_custkey", C.cf_check(F.substring("cf", 1, 15)).alias("cf_letter"), C.cf_ok(wrong).alias("cf_valid"),
                       C.piva_check(F.substring("piva", 1, 10)).alias("piva_digit"), C.piva_ok(number).alias("piva_valid"))


def iban_flags(spark, sf_dir):
    rows = accounts(spark, sf_dir)
    dotted = F.concat(F.lower(F.substring("iban", 1, 4)), F.lit(" "), F.substring("iban", 5, 10), F.lit("-."),
                      F.substring("iban", 15, 20))
    swapped = F.concat(F.lit("IT00"), F.substring("iban", 5, 23))
    return rows.select("s_suppkey", C.iban_check(F.lit("IT"), F.substring("iban", 5, 23)).alias("digits"),
                       C.iban_ok(dotted).alias("dotted_valid"), C.iban_ok(swapped).alias("swapped_valid"))


def luhn_cards(spark, sf_dir):
    """Card-like numbers in texts: which pass, and the digit that would make each body pass."""
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all(
        "text", F.lit(r"[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}"), F.lit(0))).alias("token"))
    digits = C.digits_only("token")
    return found.select("doc_id", "token", C.luhn_ok("token").alias("ok"),
                        C.luhn_check(digits.substr(F.lit(1), F.length(digits) - 1)).alias("digit"))


def card_roundtrip(spark, sf_dir):
    """Card numbers of all orders, of a type that was added: Luhn-valid surrogates, and back."""
    add_cards()
    body = F.lpad(F.col("o_orderkey").cast("string"), 15, "4")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(body, C.luhn_check(body)).alias("card"))
    try:
        return _round_trip(rows, "o_orderkey", "card", "CARD", C.luhn_ok)
    finally:
        forget("CARD")          # other queries of the session see the built-in types only


_LUHN = r"""
with t as (select doc_id, unnest(regexp_extract_all(text, '[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{4}[ -]?[0-9]{1,7}')) as token
           from documents),
d as (select *, regexp_replace(token, '[^0-9]', '', 'g') as n from t),
s as (select *, reverse(n) as r, reverse(n[1:len(n) - 1]) as b from d),
sums as (select *,
  list_sum(list_transform(range(1, len(r) + 1), lambda i: case when i % 2 = 0 then
    (2 * cast(r[i] as int)) // 10 + (2 * cast(r[i] as int)) % 10 else cast(r[i] as int) end)) as total,
  list_sum(list_transform(range(1, len(b) + 1), lambda i: case when i % 2 = 1 then
    (2 * cast(b[i] as int)) // 10 + (2 * cast(b[i] as int)) % 10 else cast(b[i] as int) end)) as body from s)
select doc_id, token, len(n) between 13 and 19 and total % 10 = 0 as ok, cast((10 - body % 10) % 10 as varchar) as digit
from sums"""

_VAT_SPOILED = "('9' || substr({v}, 2, 10))"

QUERIES = {
    "vat_roundtrip": vat_roundtrip, "tax_code_roundtrip": tax_code_roundtrip, "iban_roundtrip": iban_roundtrip,
    "iban_valid_after_encrypt": iban_valid_after_encrypt, "name_roundtrip": name_roundtrip,
    "surname_roundtrip": surname_roundtrip, "off_list_roundtrip": off_list_roundtrip,
    "all_rules_roundtrip": all_rules_roundtrip, "vat_native_roundtrip": vat_native_roundtrip,
    "distinct_preserved": distinct_preserved, "vat_join_revenue": vat_join_revenue,
    "alphabet_roundtrip": alphabet_roundtrip, "checksum_flags": checksum_flags, "iban_flags": iban_flags,
    "luhn_cards": luhn_cards, "card_roundtrip": card_roundtrip,
}

_CARDS = """
with b as (select o_orderkey, lpad(cast(o_orderkey as varchar), 15, '4') as body from orders),
s as (select *, list_sum(list_transform(range(1, 16), lambda i: case when i % 2 = 1 then
    (2 * cast(body[i] as int)) // 10 + (2 * cast(body[i] as int)) % 10 else cast(body[i] as int) end)) as total from b)
select o_orderkey, body || cast((10 - total % 10) % 10 as varchar) as value, true as changed, true as valid from s"""
_CF = f"({tax_body_sql('c_custkey')} || {tax_letter_sql(tax_body_sql('c_custkey'))})"
_V = vat_sql("c_custkey")
_SPOILED = _VAT_SPOILED.format(v=_V)

ORACLES = {
    "vat_roundtrip": _expected("c_custkey", "customer", _V),
    "tax_code_roundtrip": _expected("c_custkey", "customer", _CF),
    "iban_roundtrip": _expected("s_suppkey", "supplier", iban_sql("s_suppkey")),
    "iban_valid_after_encrypt": "select count(*) as n_valid from supplier",
    "name_roundtrip": f"select c_custkey, {name_sql('c_custkey', default_names())} as value, true as valid, true as mostly_changed from customer",
    "surname_roundtrip": f"select c_custkey, {name_sql('c_custkey', default_surnames())} as value, true as valid, "
                         "true as mostly_changed from customer",
    "off_list_roundtrip": "select p_partkey, upper(substr(w, 1, 1)) || lower(substr(w, 2)) as value, true as changed, true as valid "
                          "from (select p_partkey, split_part(p_name, ' ', 1) || split_part(p_name, ' ', 2) || substr(p_brand, 1, 3) "
                          "as w from part)",
    "vat_native_roundtrip": f"select l_orderkey, l_linenumber, {vat_sql('l_orderkey')} as piva, true as as_arrow, true as changed "
                            "from lineitem",
    "all_rules_roundtrip": f"select c_custkey, {_CF} as cf, {_V} as piva, {name_sql('c_custkey', default_names())} as nome, "
                           f"{name_sql('c_custkey', default_surnames())} as cognome, true as changed from customer",
    "distinct_preserved": f"select 'cf' as column_name, count(*) as n_rows, count(distinct {_CF}) as d_before, "
                          f"count(distinct {_CF}) as d_after, 0 as n_unchanged from customer union all "
                          f"select 'piva', count(*), count(distinct {_V}), count(distinct {_V}), 0 from customer",
    "vat_join_revenue": "select c_nationkey, round(sum(o_totalprice), 2) as revenue, count(*) as n_orders, "
                        "0 as n_unchanged, 0 as n_invalid from customer join orders on c_custkey = o_custkey "
                        "group by c_nationkey",
    "alphabet_roundtrip": "select p_partkey, case when p_partkey % 10 = 0 or p_partkey % 11 = 0 then null "
                          "else lower(p_name) end as restored, case when p_partkey % 10 = 0 then 'foreign_character' "
                          "when p_partkey % 11 = 0 then 'too_short' end as error, case when p_partkey % 10 <> 0 "
                          "and p_partkey % 11 <> 0 then true end as changed from part",
    "checksum_flags": f"select c_custkey, {tax_letter_sql(tax_body_sql('c_custkey'))} as cf_letter, c_custkey % 3 <> 0 "
                      f"as cf_valid, {vat_check_sql('lpad(cast(c_custkey as varchar), 10, chr(48))')} as piva_digit, "
                      f"c_custkey % 3 <> 0 or {vat_check_sql(_SPOILED)} = substr({_SPOILED}, 11, 1) as piva_valid from customer",
    "iban_flags": f"select s_suppkey, substr({iban_sql('s_suppkey')}, 3, 2) as digits, true as dotted_valid, "
                  f"false as swapped_valid from supplier",
    "luhn_cards": _LUHN,
    "card_roundtrip": _CARDS,
}
