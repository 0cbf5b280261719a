"""Maps of old to new values over rows that mostly look nothing up."""

from pyspark.sql import functions as F

from velario.operators import mapping as M
from velario.operators.pseudonymise import context
from velario.queries.derived import KEY, vat


def _rows_by_task(df, column):
    """Rows of each task; the column keeps Spark from leaving the join out."""
    return [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n"), F.max(column)).collect()]


def test_rows_that_look_nothing_up_are_dealt_to_all_tasks(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled",
                                           "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        rows = spark.range(4000).select("id", F.when(F.col("id") % 5 > 0, F.concat(F.lit("v"), F.col("id") % 100)).alias("v"),
                                        F.create_map(F.lit("k"), "id").alias("more"))
        rows = rows.unionByName(rows.where("id < 10"))                       # rows and keys may come twice
        pairs = rows.where("v is not null").groupBy(F.col("v").alias("old")).agg(F.lit("x").alias("new"))
        ranged = M.apply_map(rows, "v", pairs, key="id", after=100, upto=200)
        assert max(_rows_by_task(ranged, "v")) < 1000
        got = sorted(((r["id"], r["v"], r["more"]["k"]) for r in ranged.collect()), key=str)
        want = [(i, (("x" if 100 < i <= 200 else f"v{i % 100}") if i % 5 else None), i) for i in [*range(4000), *range(10)]]
        assert got == sorted(want, key=str)

        few = spark.range(4000).select("id", F.when(F.col("id") % 40 == 0, vat("id")).alias("piva"))
        mapped = M.with_mapped(few, context(spark, KEY), "piva", "PIVA", "piva", "new", "error")
        assert mapped.columns == ["id", "piva", "new", "error"]
        assert max(_rows_by_task(mapped, "new")) < 1000
        assert mapped.where((F.col("new").isNull() != F.col("piva").isNull()) | F.col("error").isNotNull()).isEmpty()
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
