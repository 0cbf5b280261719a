"""Tables as they come: from a catalog, from paths, over JDBC; and their description."""

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMN_ROWS = "table string, column string, type string, nullable boolean"
FOREIGN_KEY_ROWS = "t1 string, c1 string, t2 string, c2 string"
PRIMARY_KEY_ROWS = "table string, pos int, column string"


def list_tables(spark: SparkSession, database=None) -> DataFrame:
    """Names of the catalog tables, qualified if a database is named, sorted."""
    rows = spark.sql("SHOW TABLES" + (f" IN `{database}`" if database else "")).where(~F.col("isTemporary"))
    name = F.concat_ws(".", F.lit(database), F.col("tableName")) if database else F.col("tableName")
    return rows.select(name.alias("table")).orderBy("table")


def read_table(spark: SparkSession, source: str, fmt=None, schema=None, **options) -> DataFrame:
    """A catalog table, or files of a format (``parquet``, ``orc``, ``csv`` ...)."""
    if fmt is None:
        return spark.table(source)
    reader = spark.read.format(fmt).options(**options)
    return (reader.schema(schema) if schema else reader).load(source)


def jdbc_options(url, table, key=None, lower=None, upper=None, partitions=None, fetch_size=50_000):
    """Options of a JDBC scan; with a numeric key and its bounds it is read in parallel."""
    options = {"url": url, "dbtable": table, "fetchsize": str(fetch_size)}
    if key is not None:
        options |= {"partitionColumn": key, "lowerBound": str(lower), "upperBound": str(upper),
                    "numPartitions": str(partitions)}
    return options


def read_jdbc(spark: SparkSession, url, table, **kwargs) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **kwargs)).load()


class Constraints:
    """Declared keys: Spark tables and files carry none of their own.

    The document is ``{"primary_keys": {table: [column, ...]}, "foreign_keys":
    [[t1, c1, t2, c2], ...], "not_null": {table: [column, ...]}}``.
    """

    def __init__(self, primary_keys=None, foreign_keys=(), not_null=None):
        self.primary_keys = primary_keys or {}
        self.foreign_keys = sorted(tuple(fk) for fk in foreign_keys)
        self.not_null = not_null or {}

    @classmethod
    def load(cls, spark: SparkSession, path: str):
        text = spark.read.text(path, wholetext=True).first()["value"]
        return cls(**json.loads(text))

    def single_key(self, table):
        """The primary key if it is one column: ranges need a plain ``>``."""
        key = self.primary_keys.get(table) or []
        return key[0] if len(key) == 1 else None

    def foreign_key_rows(self, spark) -> DataFrame:
        return spark.createDataFrame(self.foreign_keys, FOREIGN_KEY_ROWS)

    def primary_key_rows(self, spark) -> DataFrame:
        return spark.createDataFrame(
            [(t, i, c) for t, columns in sorted(self.primary_keys.items()) for i, c in enumerate(columns)],
            PRIMARY_KEY_ROWS)


def describe(tables: dict, constraints: Constraints) -> DataFrame:
    """``(table, column, type, nullable)`` of the given DataFrames; metadata only."""
    spark = next(iter(tables.values())).sparkSession
    rows = []
    for name, df in sorted(tables.items()):
        required = set(constraints.not_null.get(name, [])) | set(constraints.primary_keys.get(name, []))
        rows += [(name, f.name, declared_type(f), f.nullable and f.name not in required)
                 for f in df.schema.fields]
    return spark.createDataFrame(rows, COLUMN_ROWS)


def declared_type(field) -> str:
    """The type with its length: catalogs keep ``varchar(n)`` in the metadata."""
    return field.metadata.get("__CHAR_VARCHAR_TYPE_STRING", field.dataType.simpleString())


def selected_foreign_keys(foreign_keys: DataFrame, schema: DataFrame) -> DataFrame:
    """Foreign keys whose two tables are both described, sorted."""
    known = schema.select("table").distinct()
    kept = (foreign_keys.join(known.withColumnRenamed("table", "t1"), "t1", "left_semi")
            .join(known.withColumnRenamed("table", "t2"), "t2", "left_semi"))
    return kept.select("t1", "c1", "t2", "c2").orderBy("t1", "c1", "t2", "c2")


def profile_tables(tables: dict, columns=None) -> DataFrame:
    """Counts of every column of every table (see ``operators.profile``)."""
    from velario.operators.profile import profile
    parts = [profile(df, (columns or {}).get(name, df.columns)).select(F.lit(name).alias("table"), "*")
             for name, df in sorted(tables.items())]
    if not parts:
        raise ValueError("no table to describe")
    return reduce(DataFrame.unionByName, parts)
