"""The policy document and the run report as files."""

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT_SUFFIX = "policy-v1"
FORMAT = "velario-policy-v1"
POLICY_ROWS = "table string, column string, strategy string, kind string, tweak string"
# Names of the fields in the document (fixed values).
_DOCUMENT = ("formato string, chiave_id string, "
             "tabelle map<string, map<string, struct<strategia: string, tipo: string, tweak: string>>>")


class InvalidPolicy(ValueError):
    pass


def load_policy(spark: SparkSession, path: str) -> DataFrame:
    """``(table, column, strategy, kind, tweak)`` from a policy document."""
    document = spark.read.schema(_DOCUMENT).json(path, multiLine=True)
    tag = document.select("formato").first()
    if tag is None or not (tag["formato"] or "").endswith(FORMAT_SUFFIX):
        raise InvalidPolicy(f"{path}: unknown format {tag and tag['formato']!r}")
    return policy_rows(document)


def policy_rows(document: DataFrame) -> DataFrame:
    rules = document.select(F.explode("tabelle").alias("table", "rules"))
    return rules.select("table", F.explode("rules").alias("column", "rule")).select(
        "table", "column", F.col("rule.strategia").alias("strategy"), F.col("rule.tipo").alias("kind"),
        F.col("rule.tweak").alias("tweak"))


def save_policy(policy: DataFrame, path: str, key_id=None) -> None:
    """Write the policy as one document; it has the size of the schema, not of the data."""
    tables = {}
    for r in policy.orderBy("table", "column").toLocalIterator():
        rule = {"strategia": r["strategy"], "tipo": r["kind"], "tweak": r["tweak"]}
        tables.setdefault(r["table"], {})[r["column"]] = {k: v for k, v in rule.items() if v is not None}
    text = json.dumps({"formato": FORMAT, "chiave_id": key_id, "tabelle": tables}, ensure_ascii=False)
    policy.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode(
        "overwrite").text(path)


def policy_key_id(spark: SparkSession, path: str):
    """The id of the key that a policy document was written for, or None."""
    return spark.read.schema(_DOCUMENT).json(path, multiLine=True).select("chiave_id").first()["chiave_id"]


def save_report(report, path: str) -> None:
    """A run's report as two JSON folders: what was done to each column, with the
    direction and the database, and every value that was left as it was."""
    about = {"direction": F.lit(report.direction), "database": F.lit(report.database)}
    report.columns.withColumns(about).write.mode("overwrite").json(f"{path}/columns")
    report.untreatable.withColumns(about).write.mode("overwrite").json(f"{path}/untreatable")
