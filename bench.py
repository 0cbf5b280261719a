
import json
import os
import time

from pyspark.sql import functions as F

from velario.operators import mapping
from velario.operators.pseudonymise import Rule, context, encrypt
from velario.queries.derived import KEY, people, table, tax_code, vat
from velario.session import local_session

DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", os.cpu_count()))


def run(df):
    """Seconds to compute every column of every row."""
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def best(make, times=2):
    return min(run(make()) for _ in range(times))


def off_list(spark, rows, syllables):
    """Distinct surnames that are on no list, made of given syllables."""
    k = F.col("id")
    parts = [F.element_at(F.array(*map(F.lit, syllables)), (F.floor(k / len(syllables) ** p) % len(syllables) + 1).cast("int"))
             for p in range(6)]
    return spark.range(rows).select(F.initcap(F.concat(*parts)).alias("cognome"))


def main():
    spark = local_session(cores=CPUS, name="velario-bench", memory="16g")
    spark.sparkContext.setLogLevel("ERROR")
    seconds, rates = {}, {}

    lines = table(spark, DIR, "lineitem").select(vat("l_orderkey").alias("piva"))
    n = lines.count()
    ctx = context(spark, KEY)
    run(encrypt(people(spark, DIR).limit(1000), KEY, [Rule("piva", "PIVA")]))          # start the Python workers

    seconds["vat_inline"] = best(lambda: encrypt(lines, KEY, [Rule("piva", "PIVA")]))
    rates["vat_inline_rows_s"] = n / seconds["vat_inline"]
    firsts = table(spark, DIR, "lineitem").where("l_linenumber = 1").select(vat("l_orderkey").alias("piva"))
    seconds["vat_native"] = run(encrypt(firsts, KEY, [Rule("piva", "PIVA")], native=True))
    rates["vat_native_rows_s"] = firsts.count() / seconds["vat_native"]
    distinct = lines.distinct().count()
    seconds["vat_distinct_join"] = best(lambda: mapping.apply_map(
        lines, "piva", mapping.value_map(lines, ctx, "piva", "PIVA", "piva")))
    rates["vat_distinct_values_s"] = distinct / seconds["vat_distinct_join"]

    began = time.perf_counter()
    encrypt(people(spark, DIR).select("cf").limit(1), KEY, [Rule("cf", "CF")]).collect()
    seconds["cf_tables"] = time.perf_counter() - began
    codes = table(spark, DIR, "orders").select(tax_code("o_orderkey").alias("cf"))
    seconds["cf"] = best(lambda: encrypt(codes, KEY, [Rule("cf", "CF")]))
    rates["cf_values_s_core"] = codes.count() / seconds["cf"] / CPUS

    plain, heavy = ("sa", "va", "la", "fe", "ni", "ro", "te", "mi"), ("zb", "bm", "er", "rd", "st", "la", "gr", "ot")
    for name, syllables in (("surname_plain", plain), ("surname_consonants", heavy)):
        names = off_list(spark, 200_000, syllables).repartition(CPUS)
        seconds[name] = best(lambda: encrypt(names, KEY, [Rule("cognome", "COGNOME")]))
        rates[f"{name}_values_s_core"] = 200_000 / seconds[name] / CPUS

    customers = people(spark, DIR).select("c_nationkey", "piva")
    orders = table(spark, DIR, "orders").select("o_totalprice", vat("o_custkey").alias("piva"))

    def revenue(a, b):
        return a.join(b, "piva").groupBy("c_nationkey").agg(F.sum("o_totalprice"))

    rules = [Rule("piva", "PIVA")]
    seconds["join_clear"] = best(lambda: revenue(customers, orders))
    seconds["join_surrogates"] = best(lambda: revenue(encrypt(customers, KEY, rules), encrypt(orders, KEY, rules)))

    print(json.dumps({"metric": "identifier jobs, total", "value": round(sum(seconds.values()), 2), "unit": "sec",
                      "queries": {k: round(v, 3) for k, v in seconds.items()},
                      "rates": {k: round(v) for k, v in rates.items()}, "sf": DIR.rsplit("sf", 1)[-1], "cpus": CPUS}))


if __name__ == "__main__":
    main()
